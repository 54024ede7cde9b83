import pytest

from sessionloom.operators import shred
from sessionloom.streaming import once

CALL = {"type": "tool_use", "id": "t1", "name": "Read", "input": {"a": {"b": 1}}}
PART = {"type": "text", "text": "x"}


def _line(content, **more):
    return {"type": "user", "uuid": "u", "sessionId": "s", "message": {"content": content}} | more


def test_nodes_keep_order_and_links(make_lines):
    deep = {"kind": "tool_result", "toolUseId": "t1", "content": [PART, {"type": "search_result", "content": [PART, {"text": "no type"}]}]}
    df = make_lines([_line([CALL, deep, "text", None]), _line(CALL), _line("plain"), "{broken", None, {"message": 3}, _line([{"type": "tool_result", "content": []}])])
    bridged = shred.bridge(df)
    got = {tuple(r) for r in shred.nodes(bridged, shred.objects(bridged)).collect()}
    assert got == {
        (1, "0", "tool_use", "t1"), (1, "1", "tool_result", "t1"), (1, "1.0", "text", "t1"), (1, "1.1", "search_result", "t1"),
        (1, "1.1.0", "text", "t1"), (1, "1.1.1", None, "t1"), (2, "0", "tool_use", "t1"), (7, "0", "tool_result", None),
    }


def test_equal_objects_are_stored_once(make_lines):
    df = make_lines([_line([CALL]), _line([dict(reversed(CALL.items()))]), _line([CALL | {"id": "t2"}])])
    objects = shred.objects(shred.bridge(df, bodies=True)).where("node_type = 'tool_use'").collect()
    assert sorted(r["occurrences"] for r in objects) == [1, 2]


def test_lists_in_lists_and_lone_parts_are_no_nodes(make_lines):
    df = make_lines([_line([[CALL], {"type": "tool_result", "tool_use_id": "t", "content": PART}]), _line([{"type": "text", "content": [PART]}])])
    bridged = shred.bridge(df)
    assert [tuple(r) for r in shred.nodes(bridged, shred.objects(bridged)).collect()] == [(1, "1", "tool_result", "t")]


def test_messages_come_back_from_the_two_tables(make_lines):
    rows = [_line([CALL, {"#": "x", "deep": [{"b": [[{"c": 1.5}]]}, {}]}]), _line("plain"), _line([CALL]), _line([], usage={"#": {"#": None}})]
    bridged = shred.bridge(make_lines(rows), bodies=True)
    back = {r["line_id"]: r["message"] for r in shred.rebuild(bridged, shred.objects(bridged)).collect()}
    assert back == {i + 1: shred._canonical(r["message"]) for i, r in enumerate(rows)}


def test_every_object_of_a_message_is_stored(make_lines):
    import json

    deep = {"k": 1}
    for _ in range(1500):
        deep = {"d": deep}
    usage = {"output_tokens": 3, "cache": {"a": 1}}
    rows = [_line([CALL]), _line([CALL | {"id": "t2"}], message={"content": [CALL | {"id": "t2"}], "usage": usage}), _line("plain"), _line([{"a/b": "\ud800"}]), "{broken", {"message": 3}]
    bridged = shred.bridge(make_lines(rows), bodies=True)
    objects = {r["object_id"]: r for r in shred.objects(bridged).collect()}
    below = [r for r in objects.values() if r["node_type"] == "tool_use" or json.loads(r["body"]) == {"b": 1} or list(json.loads(r["body"])) == ["a"]]
    assert len(below) == 5  # two calls, their input, its object, and usage.cache
    found = {(r["line_id"], r["path"]): r for r in bridged.collect()}
    assert len(found) == 4 + 6 + 1 + 2 and found[1, "/content/0/input/a"]["parent_object_id"] == found[2, "/content/0/input"]["object_id"]
    assert found[2, "/usage/cache"]["ordinal"] == 0 and found[2, ""]["role"] == "message" and found[3, ""]["parent_object_id"] is None

    def whole(value):
        if isinstance(value, dict) and list(value) == ["#"]:
            return whole(json.loads(objects[value["#"]]["body"]))
        return {k: whole(v) for k, v in value.items()} if isinstance(value, dict) else [whole(v) for v in value] if isinstance(value, list) else value

    for i in (1, 2, 3, 4):
        assert whole(json.loads(found[i, ""]["body"])) == rows[i - 1]["message"]
    assert shred.bridge(make_lines([_line(deep)]), bodies=True).count() == 1502
    assert [tuple(r) for r in shred.usage_table(make_lines(rows)).collect()] == [(2, None, "output_tokens", "3"), (2, None, "cache", '{"a":1}')]


def _copy(key, tokens, session="s", **more):
    usage = {} if tokens is None else {"usage": {"output_tokens": tokens}}
    return {"type": "assistant", "uuid": f"u-{key}", "sessionId": session, "message": {"id": key, **usage}} | more


ROWS = [
    _copy("a", 1), _copy("a", 5), _copy("a", 5), _copy("a", None), _copy("a", 9, session="other"), {"type": "user", "uuid": "w", "sessionId": "s"},
    {"type": "user", "uuid": "w", "sessionId": "s"}, {"type": "ai-title", "sessionId": "s"}, "{broken", "", _copy("b", "7"), _copy("b", 6),
]


@pytest.mark.parametrize("files", [1, 4])
def test_one_copy_stays(spark, make_lines, tmp_path, files):
    path = str(tmp_path / "lines.parquet")
    make_lines(ROWS).repartition(files).write.parquet(path)
    got = {r[0] for r in once.surplus_lines(spark, path, bytes_per_trigger=1 if files > 1 else 1 << 30).collect()}
    assert got == {1, 3, 4, 7, 12}


def test_state_expires_and_late_copies_are_looked_up(spark, make_lines, tmp_path):
    from pyspark.sql import functions as F

    path, store = str(tmp_path / "lines.parquet"), str(tmp_path / "store")
    old = make_lines([_copy("a", 3)])
    old.write.parquet(path)
    assert once.surplus_lines(spark, path, store=store, watermark="1 day").count() == 0
    new = make_lines([_copy("z", 1)]).withColumn("line_id", F.col("line_id") + 10).withColumn("ingested_at", F.expr("ingested_at + interval 60 days"))
    new.write.mode("append").parquet(path)
    assert once.surplus_lines(spark, path, store=store, watermark="1 day").count() == 0  # a's state goes cold
    new = make_lines([_copy("q", 1)]).withColumn("line_id", F.col("line_id") + 20).withColumn("ingested_at", F.expr("ingested_at + interval 90 days"))
    new.write.mode("append").parquet(path)
    once.surplus_lines(spark, path, store=store, watermark="1 day")
    late = make_lines([_copy("a", 2), _copy("a", 8)]).withColumn("line_id", F.col("line_id") + 30)
    late.write.mode("append").parquet(path)
    got = {r[0] for r in once.surplus_lines(spark, path, store=store, watermark="1 day").collect()}
    assert got == {1, 31}


def test_many_batches_and_merged_state_give_the_same_lines(spark, make_lines, tmp_path, monkeypatch):
    monkeypatch.setattr(once, "MERGE", 2)
    monkeypatch.setattr(once, "FILE_ROWS", 5)
    # event times a month apart, running back and forth: keys go cold and come back
    rows = [_copy(f"k{i % 7}", i * 37 % 11, timestamp=f"20{20 + i * 5 % 6}-0{1 + i % 9}-01T00:00:00Z" if i % 4 else None) for i in range(60)]
    path = str(tmp_path / "lines.parquet")
    make_lines(rows).repartition(4).write.parquet(path)
    best = {}
    for i, r in enumerate(rows, 1):
        best[r["message"]["id"]] = min(best.get(r["message"]["id"], (1, 0)), (-r["message"]["usage"]["output_tokens"], i))
    store = str(tmp_path / "store")
    got = {r[0] for r in once.surplus_lines(spark, path, batches=6, store=store, watermark="1 day").collect()}
    assert got == set(range(1, 61)) - {i for _, i in best.values()}
    assert len(list((tmp_path / "store" / "done").iterdir())) >= 4 and any("merged" in p.name for p in (tmp_path / "store" / "cold").iterdir())


def test_empty_table(spark, make_lines, tmp_path):
    path = str(tmp_path / "lines.parquet")
    make_lines([]).write.parquet(path)
    assert once.surplus_lines(spark, path).count() == 0
