"""Following growing transcript files, and stateful operators on the stream.

Defined cases: a half-written last line waits for its line feed; a file that
shrank is read again from its start; lines later than the watermark are
dropped by the windowed operators (the batch twins keep them).
"""

from __future__ import annotations

import gzip
import json
import os
import time
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class _Tail(SimpleDataSourceStreamReader):
    """Offsets are byte positions per file, so appended bytes are new data."""

    def __init__(self, root: str) -> None:
        self.root = root

    def _files(self) -> list[str]:
        return sorted(os.path.join(d, f) for d, _, names in os.walk(self.root) for f in names if f.endswith(".jsonl"))

    def initialOffset(self) -> dict:
        return {}

    def _between(self, start: dict, stop: dict | None):
        rows, reached = [], dict(start)
        for path in self._files() if stop is None else sorted(stop):
            begin, size = start.get(path, 0), os.path.getsize(path)
            if begin > size:
                begin = 0
            with open(path, "rb") as f:
                f.seek(begin)
                data = f.read((stop[path] if stop else size) - begin)
            whole = data[: data.rfind(b"\n") + 1]
            at = begin
            for part in whole.split(b"\n")[:-1]:
                rows.append((os.path.relpath(path, self.root), at, part.decode("utf-8", "replace")))
                at += len(part) + 1
            reached[path] = begin + len(whole)
        return rows, reached

    def read(self, start: dict):
        rows, reached = self._between(start, None)
        return iter(rows), reached

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._between(start, end)[0])


class TranscriptTail(DataSource):
    """``spark.readStream.format("transcript_tail").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "transcript_tail"

    def schema(self) -> str:
        return "file_name string, position bigint, raw string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Tail(self.options["path"])


def tail(spark: SparkSession, root: str) -> DataFrame:
    """A stream of the lines appended to any transcript below ``root``."""
    spark.dataSource.register(TranscriptTail)
    return spark.readStream.format("transcript_tail").load(root)


def conversation_windows(prompts: DataFrame, *, gap: str = "60 minutes", late: str = "1 day") -> DataFrame:
    """Prompts (slug, ts) per stretch without a pause longer than the gap."""
    return prompts.withWatermark("ts", late).groupBy("slug", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("prompts"))


def paired_calls(uses: DataFrame, results: DataFrame, *, within: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Open calls (file_name, id, used_at) with their results (file_name,
    tool_use_id, answered_at); unanswered ones come out once they expire."""
    u = uses.withWatermark("used_at", late)
    r = results.select(F.col("file_name").alias("r_file"), "tool_use_id", "answered_at").withWatermark("answered_at", late)
    on = (F.col("file_name") == F.col("r_file")) & (F.col("id") == F.col("tool_use_id"))
    near = (F.col("answered_at") >= F.col("used_at")) & (F.col("answered_at") <= F.col("used_at") + F.expr(f"interval {within}"))
    return u.join(r, on & near, "leftOuter").select("file_name", "id", "used_at", "answered_at")


def firing_pairs(stream: DataFrame, *, timeout: str = "1 hour") -> DataFrame:
    """Enter and end of each firing (session_id, pid, ts, ts_ms, phase).

    A killed phase ends a firing for good; a firing without an end comes out
    with nulls when event time passes its timeout.
    """
    out = "session_id string, pid bigint, start_ms double, end_ms double, ended string"
    state = "start_ms double, open boolean"
    wait = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def step(key, frames, held: GroupState):
        session, pid = key
        if held.hasTimedOut:
            start, _ = held.get
            held.remove()
            yield pd.DataFrame([(session, pid, start, None, None)], columns=["session_id", "pid", "start_ms", "end_ms", "ended"])
            return
        start, opened = held.get if held.exists else (None, False)
        done = []
        rows = sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: r.ts_ms)
        for r in rows:
            if r.phase == "enter":
                if opened:
                    done.append((session, pid, start, None, None))
                start, opened = float(r.ts_ms), True
            elif opened:
                done.append((session, pid, start, float(r.ts_ms), r.phase))
                start, opened = None, False
        if opened:
            held.update((start, True))
            held.setTimeoutTimestamp(max(int(start) + wait, held.getCurrentWatermarkMs() + 1))
        elif held.exists:
            held.remove()
        yield pd.DataFrame(done, columns=["session_id", "pid", "start_ms", "end_ms", "ended"])

    events = stream.withWatermark("ts", timeout).groupBy("session_id", "pid")
    return events.applyInPandasWithState(step, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def land_export(folder: str, body: bytes, *, content_type: str, encoding: str = "", received_ms: int | None = None) -> bool:
    """Take one pushed export into the landing folder; whether it was JSON.

    What a receiver calls per request, from any number of threads: each export is a
    file of its own, renamed into place, so the stream never sees half of one.
    Bodies that are not JSON, or do not unpack, are refused.
    """
    try:
        data = gzip.decompress(body) if encoding.lower() == "gzip" else body
        if "json" not in content_type or not isinstance(json.loads(data), dict):
            return False
    except (OSError, EOFError, ValueError):
        return False
    at = received_ms if received_ms is not None else int(time.time() * 1000)
    os.makedirs(folder, exist_ok=True)
    name = os.path.join(folder, f"{at}-{uuid.uuid4().hex}.json")
    with open(name + ".part", "wb") as f:
        f.write(json.dumps({"recv_ms": at, "raw": data.decode()}).encode())
    os.replace(name + ".part", name)
    return True


def exports(spark: SparkSession, folder: str, *, files_per_batch: int = 1_000) -> DataFrame:
    """A stream (recv_ms, raw) of the exports that land in a folder, for
    ``telemetry.flatten_exports``."""
    stream = spark.readStream.schema("recv_ms bigint, raw string").option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.json")
    return stream.json(folder)
