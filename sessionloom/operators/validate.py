"""Checks of published material: documents with front matter, fixtures and releases.

Every check gives violations as rows (name, rule, detail), so that all of a batch
come out at once; ``plan`` refuses to go on while there are any.

Defined cases: a document without front matter violates ``front-matter``; a field
that is missing is null; equal targets violate ``collision``, once per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST = 25, 160  #: fixed values: characters of a description


def front_matter(documents: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(name, has_front_matter, body, <field>...) of documents (name, text)."""
    parts = F.split("text", r"(?m)^---[ \t]*$", 3)
    has = F.coalesce(F.col("text").startswith("---") & (F.size(parts) == 3), F.lit(False))
    head = F.when(has, parts[1])
    value = lambda f: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(head, rf"(?m)^{f}:[ \t]*(.*)$", 1), r"^[\"']|[\"']\s*$", "")), F.lit(""))
    return documents.select("name", has.alias("has_front_matter"), F.when(has, parts[2]).otherwise(F.col("text")).alias("body"), *[value(f).alias(f) for f in fields])


def check_documents(documents: DataFrame, cards: DataFrame, required: dict[str, str]) -> DataFrame:
    """Violations of documents: front matter, fields by pattern, length of the
    description, a card (``path``) that is there, and targets that collide."""
    split = front_matter(documents, tuple(dict.fromkeys(("description", "card", "target", *required))))
    found = split.join(cards.select(F.col("path").alias("card"), F.lit(True).alias("there")).distinct(), "card", "left")
    clash = split.where("target is not null").groupBy("target").agg((F.count(F.lit(1)) > 1).alias("clash"))
    found = found.join(clash, "target", "left")
    rule = lambda ok, name, detail: F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail")))
    size = F.length("description")
    rules = [
        rule(F.col("has_front_matter"), "front-matter", F.lit(None)),
        rule(size.between(LEAST, MOST), "description-length", size),
        rule(F.col("card").isNull() | F.coalesce("there", F.lit(False)), "card-missing", F.lit(None)),
        rule(~F.coalesce("clash", F.lit(False)), "collision", F.lit(None)),
        *[rule(F.col(f).rlike(p), "field", F.lit(f)) for f, p in required.items()],
    ]
    return found.select("name", F.explode(F.array(*rules)).alias("v")).where("v is not null").select("name", "v.rule", "v.detail")


def check_fixtures(files: DataFrame, versions: DataFrame, *, suffix: str = ".jsonl", sidecar: str = ".yaml") -> DataFrame:
    """Violations of fixture files (path, version): each needs its sidecar, a known
    version, and nothing else may lie beside them."""
    stem = F.regexp_replace("path", rf"(\{suffix}|\{sidecar})$", "")
    body = files.where(F.col("path").endswith(suffix)).select("path", "version", stem.alias("stem"))
    beside = files.where(F.col("path").endswith(sidecar)).select(stem.alias("stem"), F.col("path").alias("side"))
    lone = body.join(beside, "stem", "left_anti").select(F.col("path").alias("name"), F.lit("no-sidecar").alias("rule"))
    unknown = body.join(versions.select("version").distinct(), "version", "left_anti").select(F.col("path").alias("name"), F.lit("unknown-version").alias("rule"))
    orphan = beside.join(body, "stem", "left_anti").select(F.col("side").alias("name"), F.lit("stray").alias("rule"))
    other = files.where(~F.col("path").endswith(suffix) & ~F.col("path").endswith(sidecar)).select(F.col("path").alias("name"), F.lit("stray").alias("rule"))
    return lone.unionByName(unknown).unionByName(orphan).unionByName(other)


def plan(violations: DataFrame, limit: int = 1_000) -> None:
    """First of two phases: an error that lists the violations, so that the second
    (writing) starts only on a clean batch."""
    found = violations.orderBy("name", "rule").limit(limit).collect()
    if found:
        raise ValueError("; ".join(f"{r['name']}: {r['rule']}" for r in found))


def release_ready(index: DataFrame, version: str, runs: DataFrame) -> str | None:
    """Why a release can't go on, or None: the index must not hold the version, and
    the latest run (by ``started_at``, ``id``) of every check must have passed."""
    if index.where(F.col("version") == version).limit(1).count():
        return "the version is published"
    latest = runs.groupBy("name").agg(F.max_by("conclusion", F.struct("started_at", "id")).alias("conclusion"))
    bad = latest.where("coalesce(conclusion, '') <> 'success'").orderBy("name").limit(1).collect()
    return f"{bad[0]['name']} did not pass" if bad else None
