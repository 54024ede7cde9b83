"""Sessions on disk: transcripts, manifests, spilled results and inventories."""

from __future__ import annotations

import json
import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.functions.records import batch_of

LINES_DDL = "file_name string, slug string, line_no bigint, raw string, valid_utf8 boolean"
LINES = pa.schema([("file_name", pa.string()), ("slug", pa.string()), ("line_no", pa.int64()), ("raw", pa.string()), ("valid_utf8", pa.bool_())])
BATCH = 2_000  #: lines per Arrow batch, so a large file never is one batch


def projects_root(given: str | None = None) -> str:
    """The given root, else ``projects`` below the agent's configuration folder."""
    return given or os.path.join(os.environ.get("CLAUDE_CONFIG_DIR") or os.path.expanduser("~/.claude"), "projects")


def _binary(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)


def read_lines(spark: SparkSession, root: str, *, max_files: int | None = None, universal_newlines: bool = True) -> DataFrame:
    """Every line of every ``*.jsonl`` below ``root`` with its 1-based number.

    With ``universal_newlines`` CR and CRLF end lines as LF does; without, LF
    only.  Broken UTF-8 is replaced and flagged.  ``max_files`` keeps the first
    files by path, component by component; the listing is cut before contents
    are read.  An empty file has no lines.
    """
    found = _binary(spark, root, "*.jsonl")
    if max_files is not None:
        first = found.select("path").orderBy(F.split("path", "/")).limit(max_files)
        found = found.join(F.broadcast(first), "path", "left_semi")  # at most max_files paths
    base = root.removeprefix("file://").rstrip("/")

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py() or b""
                if universal_newlines:
                    data = data.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
                parts = data.split(b"\n")
                if parts and not parts[-1]:
                    parts.pop()
                name = path.split(base + "/", 1)[-1]
                slug = name.split("/", 1)[0]
                for i in range(0, len(parts), BATCH):
                    rows = []
                    for j, part in enumerate(parts[i : i + BATCH], i + 1):
                        text = part.decode("utf-8", "replace")
                        rows.append((name, slug, j, text, text.encode() == part))
                    yield batch_of(LINES, rows)

    return found.select("path", "content").mapInArrow(run, LINES_DDL)


def strict(lines: DataFrame) -> DataFrame:
    """The lines, or an error that names the first line that is malformed.

    A line is malformed when it is not blank and no object with a text ``type``.
    """
    v = F.try_parse_json("raw")
    kind = F.when(F.trim("raw") == "", "ok").when(v.isNull(), "malformed JSON").when(~F.schema_of_variant(v).startswith("OBJECT"), "no object")
    kind = kind.when(F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.type", "variant")), F.lit("")) != "STRING", "no type").otherwise("ok")
    bad = lines.select("file_name", "line_no", kind.alias("what")).where("what <> 'ok'").orderBy("file_name", "line_no").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['file_name']}, line {bad[0]['line_no']}: {bad[0]['what']}")
    return lines


def read_manifests(spark: SparkSession, root: str) -> DataFrame:
    """(file_name, trace, keys, readable, raw) of every ``*.meta.json``."""
    text = F.decode("content", "utf-8")
    v = F.try_parse_json(text)
    readable = v.isNotNull() & F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return _binary(spark, root, "*.meta.json").select(
        F.col("path").alias("file_name"), F.regexp_replace("path", r"\.meta\.json$", ".jsonl").alias("trace"),
        F.when(readable, F.array_distinct(F.json_object_keys(text))).alias("keys"), readable.alias("readable"), text.alias("raw"),
    )


def spilled(spark: SparkSession, root: str) -> DataFrame:
    """(path, extension, prefix, bytes) of spilled tool results; contents stay unread."""
    name = F.element_at(F.split("path", "/"), -1)
    prefix = F.substring_index(F.substring_index(name, "_", 1), ".", 1)
    files = _binary(spark, root, "*").where("path like '%/tool-results/%'")
    return files.select(
        "path", F.when(name.contains("."), F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("").alias("extension"),
        F.when(prefix == "toolu", "toolu").when(prefix.startswith("mcp-"), "mcp").otherwise("<other>").alias("prefix"), F.col("length").alias("bytes"),
    )


def size_summary(files: DataFrame) -> DataFrame:
    """count, least, truncated median and most of ``bytes``."""
    return files.agg(
        F.count("bytes").alias("n"), F.min("bytes").alias("least"), F.percentile("bytes", F.lit(0.5)).cast("bigint").alias("median"), F.max("bytes").alias("most")
    )


def session_folders(spark: SparkSession, root: str) -> DataFrame:
    """(session, child, files): folders beside a transcript of the same name."""
    paths = _binary(spark, root, "*").select("path")
    sessions = paths.where("path like '%.jsonl' and path not like '%/subagents/%'").select(F.regexp_replace("path", r"\.jsonl$", "").alias("session"))
    inside = paths.select(
        F.regexp_extract("path", r"^(.*)/([^/]+)/[^/]+$", 1).alias("session"), F.regexp_extract("path", r"^(.*)/([^/]+)/[^/]+$", 2).alias("child")
    )
    return inside.join(sessions, "session", "left_semi").groupBy("session", "child").agg(F.count(F.lit(1)).alias("files"))


def canonical_report(sections: dict[str, DataFrame], limit: int = 100_000) -> str:
    """Report sections as JSON with sorted keys; rows are aggregates and bounded."""
    out = {}
    for name, df in sections.items():
        rows = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
        if len(rows) > limit:
            raise ValueError(f"{name} is no report section: more than {limit} rows")
        out[name] = sorted(rows, key=lambda r: json.dumps(r, sort_keys=True, default=str))
    return json.dumps(out, sort_keys=True, indent=2, default=str) + "\n"
