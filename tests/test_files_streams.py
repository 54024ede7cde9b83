import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import telemetry as T
from sessionloom.sources import files
from sessionloom.streaming import follow


@pytest.fixture
def root(tmp_path):
    sub = tmp_path / "-slug" / "s1" / "subagents"
    sub.mkdir(parents=True)
    (tmp_path / "-slug" / "s1" / "tool-results").mkdir()
    (tmp_path / "-slug" / "s1.jsonl").write_bytes('{"type":"a"}\n\nx y\r\n'.encode() + b"\xff\n")
    (tmp_path / "-slug" / "s2.jsonl").write_bytes(b"")
    (sub / "agent-1.jsonl").write_text('{"type":"b"}')
    (sub / "agent-1.meta.json").write_text('{"agentType":"x","spawnDepth":null}')
    (sub / "agent-2.meta.json").write_text("broken")
    (tmp_path / "-slug" / "s1" / "tool-results" / "toolu_1.txt").write_bytes(b"abc")
    (tmp_path / "-slug" / "s1" / "tool-results" / "mcp-x_2.json").write_bytes(b"abcde")
    return str(tmp_path)


def test_lines_have_numbers_and_flags(spark, root):
    rows = [(r["file_name"], r["line_no"], r["raw"], r["valid_utf8"]) for r in files.read_lines(spark, root).orderBy("file_name", "line_no").collect()]
    assert rows == [("-slug/s1.jsonl", 1, '{"type":"a"}', True), ("-slug/s1.jsonl", 2, "", True), ("-slug/s1.jsonl", 3, "x y", True), ("-slug/s1.jsonl", 4, "�", False), ("-slug/s1/subagents/agent-1.jsonl", 1, '{"type":"b"}', True)]
    assert "x y\r" in [r["raw"] for r in files.read_lines(spark, root, universal_newlines=False).collect()]
    assert {r["file_name"] for r in files.read_lines(spark, root, max_files=1).collect()} == {"-slug/s1/subagents/agent-1.jsonl"}
    with pytest.raises(ValueError, match="line 3: malformed"):
        files.strict(files.read_lines(spark, root))


def test_inventories(spark, root):
    m = {r["file_name"].rsplit("/", 1)[-1]: (r["readable"], r["keys"]) for r in files.read_manifests(spark, root).collect()}
    assert m == {"agent-1.meta.json": (True, ["agentType", "spawnDepth"]), "agent-2.meta.json": (False, None)}
    spills = files.spilled(spark, root)
    assert {(r["extension"], r["prefix"], r["bytes"]) for r in spills.collect()} == {(".txt", "toolu", 3), (".json", "mcp", 5)}
    assert tuple(files.size_summary(spills).first()) == (2, 3, 4, 5)
    assert {(r["child"], r["files"]) for r in files.session_folders(spark, root).collect()} == {("subagents", 3), ("tool-results", 2)}
    report = files.canonical_report({"b": spills.groupBy("prefix").count(), "a": spills.limit(0)})
    assert list(json.loads(report)) == ["a", "b"]


def test_tail_reads_appended_bytes_once(spark, tmp_path):
    path = tmp_path / "p"
    path.mkdir()
    (path / "a.jsonl").write_text("one\ntw")
    out, where = str(tmp_path / "out"), str(tmp_path / "offsets")

    def go():
        q = follow.tail(spark, str(path)).writeStream.format("parquet").option("path", out).option("checkpointLocation", where).start()
        q.processAllAvailable()
        q.stop()
        return sorted((r["position"], r["raw"]) for r in spark.read.parquet(out).collect())

    assert go() == [(0, "one")]
    with open(path / "a.jsonl", "a") as f:
        f.write("o\nthree\n")
    assert go() == [(0, "one"), (4, "two"), (8, "three")]


def test_firings_pair_on_the_stream(spark, tmp_path):
    rows = [("s", 1, 1e12, "enter"), ("s", 1, 1e12 + 5, "exit"), ("s", 2, 1e12, "enter"), ("s", 2, 1e12 + 9, "killed"), ("s", 1, 1e12 + 20, "enter"), ("s", 1, 1e12 + 26, "exit")]
    path = str(tmp_path / "in")
    df = spark.createDataFrame(rows, "session_id string, pid bigint, ts_ms double, phase string").withColumn("ts", F.timestamp_millis(F.col("ts_ms").cast("bigint")))
    df.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    q = follow.firing_pairs(stream).writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r)[1:] for r in spark.table("pairs").collect()} == {(1, 1e12, 1e12 + 5, "exit"), (2, 1e12, 1e12 + 9, "killed"), (1, 1e12 + 20, 1e12 + 26, "exit")}


def test_nearest_matching_uses_lines_once(spark):
    f = spark.createDataFrame([("s", 1, 1000, "Pre", "Bash"), ("s", 2, 1100, "Pre", None), ("s", 3, 90000, "Post", "Bash")], "session_id string, firing_id bigint, start_ms bigint, event string, target string")
    g = spark.createDataFrame([("s", 1, 1090, "Pre", "Bash"), ("s", 2, 1300, "Pre", "Read"), ("s", 3, 89000, "Post", "Bash")], "session_id string, line_no bigint, ts_ms bigint, event string, target string")
    got = {(r["firing_id"], r["line_no"], r["delta_ms"]) for r in T.match_nearest(f, g).collect()}
    assert got == {(1, 1, 90), (2, 2, 200), (3, None, None)}


def test_exports_and_debug_lines(spark):
    attr = lambda k, v: {"key": k, "value": v}
    export = {
        "resourceLogs": [{"resource": {"attributes": [attr("service.name", {"stringValue": "x"})]}, "scopeLogs": [{"logRecords": [{"timeUnixNano": "5", "body": {"stringValue": "b"}, "attributes": [attr("secret", {"stringValue": "abc"}), attr("n", {"intValue": "7"})]}]}]}],
        "resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "m", "sum": {"aggregationTemporality": 1, "dataPoints": [{"timeUnixNano": "1", "asInt": "2"}, {"timeUnixNano": "2", "asDouble": 3.5}]}}, {"name": "c", "sum": {"aggregationTemporality": 2, "dataPoints": [{"timeUnixNano": "1", "asInt": "2"}, {"timeUnixNano": "2", "asInt": "9"}]}}]}]}],
        "resourceSpans": [{"scopeSpans": [{"spans": [{"name": "sp", "traceId": "t", "spanId": "i", "startTimeUnixNano": "1", "endTimeUnixNano": "2"}]}]}],
    }
    rows = T.flatten_exports(spark.createDataFrame([(1, json.dumps(export)), (2, "broken")], "recv_ms bigint, raw string"), frozenset({"n", "service.name"}))
    got = rows.collect()
    assert sorted(r["signal"] for r in got) == ["log"] + ["metric"] * 4 + ["span"]
    log = next(r for r in got if r["signal"] == "log")
    assert log["attrs"] == {"secret": '{"redacted": true, "type": "str", "len": 3}', "n": "7"} and log["resource"] == {"service.name": "x"}
    assert {r["name"]: r["value"] for r in T.merged_metrics(rows).collect()} == {"m": 5.5, "c": 9.0}
    text = "2026-01-01T00:00:00.100Z [DEBUG] Hooks: PreToolUse:Bash [python hook.py] finished with status 2 (15ms)"
    d = T.debug_hooks(spark.createDataFrame([("f", 1, text), ("f", 2, "other")], "file_name string, line_no bigint, raw string")).collect()
    assert [(r["event"], r["target"], r["script"], r["outcome"], r["status"], r["ms"]) for r in d] == [("PreToolUse", "Bash", "hook.py", "finished", 2, 15)]
    assert d[0]["ts_ms"] == int(datetime(2026, 1, 1, tzinfo=timezone.utc).timestamp() * 1000) + 100


def test_pushed_exports_stream_into_signals(spark, tmp_path):
    import gzip
    import json

    from sessionloom.streaming import follow

    folder, out = str(tmp_path / "land"), str(tmp_path / "out")
    point = lambda t, v: {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "tokens", "sum": {"aggregationTemporality": 1, "dataPoints": [{"timeUnixNano": str(t), "asInt": v}]}}]}]}]}
    assert follow.land_export(folder, json.dumps(point(1, 5)).encode(), content_type="application/json", received_ms=1)
    assert follow.land_export(folder, gzip.compress(json.dumps(point(2, 7)).encode()), content_type="application/json", encoding="gzip", received_ms=2)
    for body, kind, coding in ((b"{}", "application/x-protobuf", ""), (b"{cut", "application/json", ""), (b"no gzip", "application/json", "gzip"), (b"[1]", "application/json", "")):
        assert not follow.land_export(folder, body, content_type=kind, encoding=coding)

    def run():
        signals = T.flatten_exports(follow.exports(spark, folder), frozenset())
        query = signals.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out)
        query.awaitTermination()
        return spark.read.parquet(out)

    assert run().count() == 2
    assert follow.land_export(folder, json.dumps(point(3, 1)).encode(), content_type="application/json; charset=utf-8", received_ms=3)
    assert [r["value"] for r in T.merged_metrics(run()).collect()] == [13.0]


def test_conversation_windows_and_paired_calls_on_the_stream(spark, tmp_path):
    from sessionloom.streaming import follow

    def rows(name, ddl, *data):
        spark.createDataFrame(list(data), ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    at = lambda h, m=0: f"2026-01-01 {h:02d}:{m:02d}:00"
    stream = lambda name, *times: (
        lambda df: df.withColumns({t: df[t].cast("timestamp") for t in times})
    )(spark.readStream.schema(spark.read.parquet(str(tmp_path / name)).schema).parquet(str(tmp_path / name)))
    rows("p", "slug string, ts string", ("a", at(1)), ("a", at(1, 59)), ("a", at(4)), ("b", at(1)), ("z", "2026-02-01 00:00:00"))
    sink = {}

    def run(df, name):
        query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / ("c" + name))).trigger(availableNow=True).start()
        query.awaitTermination()
        sink[name] = spark.table(name).collect()

    run(follow.conversation_windows(stream("p", "ts")), "windows")
    assert sorted((r["slug"], r["prompts"]) for r in sink["windows"]) == [("a", 1), ("a", 2), ("b", 1)]
    rows("u", "file_name string, id string, used_at string", ("f", "x", at(1)), ("f", "y", at(1)), ("g", "late", at(23)))
    rows("r", "file_name string, tool_use_id string, answered_at string", ("f", "x", at(1, 5)), ("g", "other", at(23)))
    run(follow.paired_calls(stream("u", "used_at"), stream("r", "answered_at")), "pairs")
    assert sorted((r["id"], r["answered_at"] is not None) for r in sink["pairs"]) == [("x", True), ("y", False)]
