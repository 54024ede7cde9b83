"""Messages delivered at least once: keep one copy, name the surplus.

Two chained streams.  The first reads new files, parses each line once and
appends its copy (key, tokens, line id, event time) to ``arrivals``.  The second
feeds ``arrivals`` in several micro-batches into a keyed state of seen
identifiers, in versioned tables of the shared folder:

* ``hot/<v>``: the best copy per key whose event time is within the watermark;
* ``cold/<v>``: bests that the watermark expired, appended per version and merged
  every ``MERGE`` versions, which a late arrival is looked up in;
* ``met/v=<v>``: the bests and the surplus lines that batch ``v`` decided.

Event time is the record's own timestamp, or the time of arrival where that
can't be read.  It only decides where a key's best copy lies: every key of a batch
is looked up in both tables, so a clock that runs back or ahead changes no result.

A batch reads version v-1 and writes version v of all three, then the marker
``done/<v>``; the stream's own checkpoint advances only after that.  A batch
that is run again overwrites its version, so output and state move together.

Each batch is a tournament.  Losers are named locally first: every Arrow batch
keeps one copy per key, so a key with a third of all rows sends one row per ten
thousand over the network.  The survivors meet by key in a window together with
the state's best copy.

Defined cases: lines without session or without both ids are no cases and come
out nowhere; absent or unreadable token counts are 0; ties keep the lowest line
id; unreadable lines are ignored; an empty input gives an empty table; the number
of micro-batches changes no result.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.functions.records import batch_of, instant, parse, text_of
from sessionloom.plans.runtime import scratch

MERGE = 8  #: versions of the cold table that are merged into one
FILE_ROWS = 100_000  #: copies per file of ``arrivals``, so that a large input file can span micro-batches

COPIES = pa.schema(
    [
        ("session_id", pa.string()),
        ("message_key", pa.string()),
        ("tokens", pa.int64()),
        ("line_id", pa.int64()),
        ("seen_at", pa.timestamp("us", tz="UTC")),
        ("surplus", pa.bool_()),
    ]
)
COPIES_DDL = "session_id string, message_key string, tokens bigint, line_id bigint, seen_at timestamp, surplus boolean"


def message_key(record: dict) -> str | None:
    """``m:`` and the message id, else ``u:`` and the uuid, else None."""
    message = record.get("message")
    found = text_of(message.get("id")) if isinstance(message, dict) else None
    if found:
        return "m:" + found
    found = text_of(record.get("uuid"))
    return "u:" + found if found else None


def output_tokens(record: dict) -> int:
    """``message.usage.output_tokens``; 0 where there is none."""
    message = record.get("message")
    usage = message.get("usage") if isinstance(message, dict) else None
    value = usage.get("output_tokens") if isinstance(usage, dict) else None
    try:
        return int(float(value)) if value is not None and not isinstance(value, (bool, dict, list)) else 0
    except (ValueError, OverflowError):
        return 0


def _local(batches):
    """Copies of each Arrow batch; all but the best of a key are surplus already."""
    for batch in batches:
        best: dict[tuple, tuple] = {}
        out = []
        for line_id, seen_at, raw in zip(*(c.to_pylist() for c in batch.columns)):
            record = parse(raw)
            session = text_of(record.get("sessionId")) if record is not None else None
            key = message_key(record) if session else None
            if key is None:
                continue
            at = instant(record.get("timestamp"))
            row = (session, key, output_tokens(record), line_id, seen_at if at is None else at)
            held = best.get((session, key))
            if held is None:
                best[session, key] = row
                continue
            if (-row[2], row[3]) < (-held[2], held[3]):
                best[session, key], row = row, held
            out.append((*row, True))
        out += [(*row, False) for row in best.values()]
        yield batch_of(COPIES, out)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _cold(spark: SparkSession, store: str, before: int) -> list[str]:
    """The complete cold tables of the versions below ``before``."""
    named = [f"{store}/cold/{mark}{v}" for v in range(before) for mark in ("", "merged-")]
    return [p for p in named if _exists(spark, p + "/_SUCCESS")]


def make_batch(store: str, watermark: str) -> Callable[[DataFrame, int], None]:
    """The step that folds one micro-batch into the state under ``store``."""

    def step(copies: DataFrame, version: int) -> None:
        spark = copies.sparkSession
        if _exists(spark, f"{store}/done/{version}"):
            return
        held = None
        if version and _exists(spark, f"{store}/hot/{version - 1}"):
            columns = "session_id", "message_key", "tokens", "line_id", "seen_at"
            schema = "session_id string, message_key string, tokens bigint, line_id bigint, seen_at timestamp"
            held = spark.read.schema(schema).parquet(f"{store}/hot/{version - 1}").select(*columns, F.lit(False).alias("surplus"))
            cold = _cold(spark, store, version)
            if cold:  # late arrivals: the archived best of each key that this batch has
                keys = copies.select("session_id", "message_key").distinct()
                late = spark.read.schema(schema).parquet(*cold).join(keys, ["session_id", "message_key"], "left_semi")
                held = held.unionByName(late.select(*columns, F.lit(False).alias("surplus")))
        # a line that is in the state is no new arrival: it comes out only when it loses
        every = copies.withColumn("was", F.lit(False))
        if held is not None:
            every = every.unionByName(held.withColumn("was", F.lit(True)))
        by_key = Window.partitionBy("session_id", "message_key")
        ranked = (
            every.where("not surplus")
            .withColumn("rank", F.row_number().over(by_key.orderBy(F.desc("tokens"), "line_id", F.desc("was"))))
            .withColumn("last_seen", F.max("seen_at").over(by_key))
            .withColumn("keeper", F.first("line_id").over(by_key.orderBy(F.desc("tokens"), "line_id", F.desc("was"))))
        )
        losers = every.where("surplus").select("line_id", "session_id", "message_key", "tokens", F.col("seen_at"), F.lit(False).alias("best"))
        met = ranked.select(
            "line_id", "session_id", "message_key", "tokens", F.col("last_seen").alias("seen_at"), (F.col("rank") == 1).alias("best"),
            (F.col("rank").__gt__(1) & (F.col("line_id") == F.col("keeper"))).alias("same"),
        ).where("not same").drop("same")
        met.unionByName(losers).write.mode("overwrite").partitionBy("best").parquet(f"{store}/met/v={version}")
        whole = "line_id bigint, session_id string, message_key string, tokens bigint, seen_at timestamp, best boolean"
        done = spark.read.schema(whole).parquet(f"{store}/met/v={version}")
        bests = done.where("best").drop("best")
        newest = bests.agg(F.max("seen_at").alias("t")).first()["t"]
        edge = F.lit(newest).cast("timestamp") - F.expr(f"interval {watermark}")
        fresh = F.coalesce(F.col("seen_at") >= edge, F.lit(True))  # without a time a key never expires
        bests.where(fresh).write.mode("overwrite").parquet(f"{store}/hot/{version}")
        bests.where(~fresh).write.mode("overwrite").parquet(f"{store}/cold/{version}")
        if version:
            _remove(spark, f"{store}/hot/{version - 2}")
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{store}/done/{version}")
        if version % MERGE == MERGE - 1:
            parts = _cold(spark, store, version + 1)
            spark.read.parquet(*parts).distinct().write.mode("overwrite").parquet(f"{store}/cold/merged-{version}")
            for old in parts:  # until they are gone rows are met twice, which changes nothing
                _remove(spark, old)

    return step


def _size(spark: SparkSession, path: str) -> int:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def surplus_lines(
    spark: SparkSession,
    path: str,
    *,
    seen_col: str = "ingested_at",
    watermark: str = "30 days",
    batches: int = 4,
    bytes_per_trigger: int = 64 << 30,
    store: str | None = None,
) -> DataFrame:
    """Surplus ``line_id`` of the lines under ``path``, by streams run to their end.

    What has arrived is folded in ``batches`` steps, or in more where one would
    pass ``bytes_per_trigger``.  ``store`` keeps state, output and the streams'
    checkpoints between calls; a later call then only reads files that are new.
    """
    store = store or scratch(spark, "once")
    batch = spark.read.parquet(path)
    source = os.path.basename(path.rstrip("/"))
    stream = (
        spark.readStream.schema(batch.select("line_id", seen_col, "raw").schema)
        .option("maxBytesPerTrigger", str(bytes_per_trigger))
        .parquet(f"{path.rstrip('/')[: -len(source)]}{'[' + source[0] + ']' + source[1:]}")
    )
    copies = stream.select(F.col("line_id").cast("bigint"), F.col(seen_col).cast("timestamp").alias("seen_at"), "raw").mapInArrow(_local, COPIES_DDL)
    arrivals = f"{store}/arrivals"
    before = _size(spark, arrivals) if _exists(spark, arrivals) else 0
    sink = copies.writeStream.format("parquet").option("path", arrivals).option("maxRecordsPerFile", FILE_ROWS)
    sink.option("checkpointLocation", f"{store}/parsed").trigger(availableNow=True).start().awaitTermination()
    if not _exists(spark, arrivals):
        return spark.createDataFrame([], "line_id bigint")
    each = max(1, min(bytes_per_trigger, (_size(spark, arrivals) - before) // max(1, batches)))
    query = (
        spark.readStream.schema(COPIES_DDL).option("maxBytesPerTrigger", str(each)).parquet(arrivals)
        .writeStream.foreachBatch(make_batch(store, watermark))
        .option("checkpointLocation", f"{store}/offsets")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = "line_id bigint, v int, best boolean"
    if not _exists(spark, f"{store}/met"):
        return spark.createDataFrame([], "line_id bigint")
    return spark.read.schema(schema).parquet(f"{store}/met").where("not best").select("line_id").distinct()
