"""Queries over the driver's tables for the general training-data operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.records import batch_of, parse, text_of
from sessionloom.operators import drift, hierarchy, sanitize, shred
from sessionloom.plans import corpus, extra, oracles, statements
from sessionloom.plans.runtime import stage
from sessionloom.sources.tables import table
from sessionloom.streaming.once import surplus_lines

LINKS = pa.schema([("id", pa.string()), ("parent", pa.string()), ("line_id", pa.int64()), ("near", pa.string())])


def link_rows(lines: DataFrame) -> DataFrame:
    """(id, parent, line_id, near) of every line with a uuid; near: its file.
    Relatives stand close together in a file, so blocks are cut along its lines."""

    def run(batches):
        for batch in batches:
            out: dict[str, tuple] = {}
            for line_id, near, raw in zip(*(c.to_pylist() for c in batch.columns)):
                record = parse(raw)
                uuid = text_of(record.get("uuid")) if record is not None else None
                if uuid is not None:
                    held = out.get(uuid)
                    if held is None or held[2] > line_id:
                        out[uuid] = (uuid, text_of(record.get("parentUuid")), line_id, near)
            yield batch_of(LINKS, list(out.values()))

    return lines.select(F.col("line_id").cast("bigint"), "file_name", "raw").mapInArrow(run, "id string, parent string, line_id bigint, near string")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    lines, baseline = table(spark, folder, "transcript_lines"), table(spark, folder, "schema_baseline")
    return drift.Drift(lines, baseline).changes()


def p1_unified(spark: SparkSession, folder: str) -> DataFrame:
    """Every line in the consistent table; extras as JSON text, sorted by path."""
    lines, baseline = table(spark, folder, "transcript_lines"), table(spark, folder, "schema_baseline")
    renames = drift.Drift(lines, baseline).learn_renames()
    extras = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("extras"))))
    return drift.unify(lines, baseline, renames).withColumn("extras", extras)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    links = hierarchy.one_per_id(link_rows(table(spark, folder, "transcript_lines")), "line_id")
    solved = hierarchy.hierarchy(links, near=["near", "line_id"])
    return solved.select(F.col("id").alias("uuid"), F.coalesce("root", F.lit("")).alias("root_uuid"), "depth")


def _all_paths(spark: SparkSession, folder: str) -> DataFrame:
    links = hierarchy.one_per_id(link_rows(table(spark, folder, "transcript_lines")), "line_id")
    return hierarchy.all_paths(stage(hierarchy.hierarchy(links, near=["near", "line_id"]), "solved"))


def p2_all_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Full path, root first, of every line that has one."""
    return _all_paths(spark, folder).select(F.col("id").alias("uuid"), F.array_join("path", "/").alias("path"), F.size("path").alias("nodes"))


def p2_all_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """(uuid, descendant) of every line and all lines below it."""
    above = F.explode(F.expr("slice(path, 1, size(path) - 1)"))
    return _all_paths(spark, folder).select(above.alias("uuid"), F.col("id").alias("descendant"))


def _solved_lines(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The solved forest, and the nodes searched for: line ids divisible by 20,
    as in the checking SQL.  ``p2_all_paths`` and ``p2_all_descendants`` answer for all."""
    links = stage(hierarchy.one_per_id(link_rows(table(spark, folder, "transcript_lines")), "line_id"), "links")
    solved = stage(hierarchy.hierarchy(links, near=["near", "line_id"]), "solved")
    return solved, links.where("line_id % 20 = 0").select("id")


def p2_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Full path, root first, of every searched node that has one."""
    solved, asked = _solved_lines(spark, folder)
    found = hierarchy.paths(solved, asked)
    return found.select(F.col("id").alias("uuid"), F.array_join("path", "/").alias("path"), F.size("path").alias("nodes"))


def p2_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """(uuid, descendant) of every searched node and all nodes below it."""
    solved, asked = _solved_lines(spark, folder)
    return hierarchy.descendants(solved, asked).select(F.col("ancestor").alias("uuid"), F.col("id").alias("descendant"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    bridged = shred.bridge(table(spark, folder, "transcript_lines")).drop("path", "parent_object_id", "own_id", "body")
    # identities as bytes: half of what their hexadecimal text takes in the shuffles
    bridged = stage(bridged.withColumns({c: F.unhex(c) for c in ("object_id", "block_object_id")}), "bridge")
    said = bridged.groupBy("object_id").agg(F.any_value("node_type").alias("node_type"), F.any_value("call_id").alias("call_id"))
    return shred.nodes(bridged, said)


def p5_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct object of all messages once."""
    return shred.objects(shred.bridge(table(spark, folder, "transcript_lines"), bodies=True))


def p5_bridge(spark: SparkSession, folder: str) -> DataFrame:
    """Every occurrence of an object in a message, with its parent and ordinal."""
    return shred.bridge(table(spark, folder, "transcript_lines")).select("line_id", "path", "role", "ordinal", "object_id", "parent_object_id")


def p5_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Each entry of the usage of every message."""
    return shred.usage_table(table(spark, folder, "transcript_lines"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return surplus_lines(spark, f"{folder}/transcript_lines.parquet")


def jn07_call_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Delegation trees of subagents: root, depth and size of each subtree."""
    manifests = table(spark, folder, "manifests").select(
        F.col("agent_id").alias("id"), F.col("parent_agent_id").alias("parent"), F.col("session_id").alias("near")
    )
    once = manifests.where("id is not null").groupBy("id").agg(F.min("parent").alias("parent"), F.min("near").alias("near"))
    solved = hierarchy.hierarchy(once, near=["near"])
    return solved.select(F.col("id").alias("agent_id"), F.coalesce("root", F.lit("")).alias("root_id"), "depth")


JN07 = """with recursive n as materialized (select agent_id, min(parent_agent_id) p from manifests where agent_id is not null group by agent_id),
t as (select agent_id, agent_id root_id, 0 "depth" from n where p is null or p not in (select agent_id from n) union all select n.agent_id, t.root_id, t."depth"+1 from n join t on n.p=t.agent_id)
select agent_id, root_id, "depth" from t union all select agent_id, '', -1 from n where agent_id not in (select agent_id from t)"""

RULES = {
    "version": 1,
    "paths": [{"match": "/home/dev/", "replace": "/home/user/"}, {"match": "re:/srv/work/([a-z-]+)", "replace": "/srv/p/\\1"}],
    "identifiers": [{"match": "re:QX-\\d+", "replace": "TICKET"}],
    "options": {"uuid_seed": "seed"},
}


def san01_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Per file what rewriting every delivered line does (malformed lines are
    counted here; ``sanitize`` would refuse the file)."""
    lines = table(spark, folder, "transcript_lines").select("file_name", F.col("line_id").alias("line_no"), "raw")
    return sanitize.audit(sanitize.rewrite(lines, sanitize.load_rules(RULES)))


def san12_residual(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of the rules' matches after rewriting: no row."""
    lines = table(spark, folder, "transcript_lines").select("file_name", F.col("line_id").alias("line_no"), "raw")
    rules = sanitize.load_rules(RULES)
    kept = stage(sanitize.rewrite(lines, rules).where("state = 'kept'").select("file_name", "line_no", "out"), "kept")
    return sanitize.residual(kept, rules)


QUERIES = {f.__name__: f for f in (p1_found, p1_unified, p2_found, p2_paths, p2_descendants, p2_all_paths, p2_all_descendants, p5_found, p5_objects, p5_bridge, p5_usage, p6_found, jn07_call_tree, san01_audit, san12_residual)}
QUERIES |= {name: (lambda spark, folder, s=statement: corpus.run(spark, folder, s)) for name, statement in statements.ALL.items()}
QUERIES |= extra.QUERIES  # some take the place of a statement
SQL = oracles.SQL | {"jn07_call_tree": JN07} | {name: corpus.oracle(statement) for name, statement in statements.ALL.items()} | extra.SQL
