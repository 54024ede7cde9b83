"""Queries over the driver's tables for the operators on training text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionloom.llm import conversations, leaks, mixing, oracles, pii, secrets, subjects
from sessionloom.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.found(table(spark, folder, "transcript_lines"))


def p3_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return pii.redact(table(spark, folder, "transcript_lines"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.conversations(table(spark, folder, "transcript_lines")).drop("role")


def p4_inferred(spark: SparkSession, folder: str) -> DataFrame:
    """Likeliest parents of messages whose stated parent is in no line."""
    copies = conversations.messages(table(spark, folder, "transcript_lines"))
    return conversations.infer_links(copies).drop("score")


def p4_inferred_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Every message with its root and depth, lost parents inferred."""
    return conversations.inferred_trees(table(spark, folder, "transcript_lines"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.found(table(spark, folder, "transcript_lines"))


def p7_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.redact(table(spark, folder, "transcript_lines"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Token ranges of documents per output shard, at the default size."""
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source in the selection."""
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.found(table(spark, folder, "documents"), table(spark, folder, "subject_examples"))


def p10_mixtures(spark: SparkSession, folder: str) -> DataFrame:
    """Mixture of subjects of each document that has any."""
    model = subjects.fit(table(spark, folder, "documents"), table(spark, folder, "subject_examples"))
    return subjects.mixed(model).select("doc_id", "subject", "weight")


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Share of each subject in the corpus."""
    return subjects.shares(table(spark, folder, "documents"), table(spark, folder, "subject_examples"))


QUERIES = {
    f.__name__: f
    for f in (
        p3_found, p3_redacted, p4_found, p4_inferred, p4_inferred_trees, p7_found, p7_redacted, p8_found, p9_selection, p9_shares, p10_found, p10_mixtures, p10_shares,
    )
}
SQL: dict[str, str] = oracles.SQL
