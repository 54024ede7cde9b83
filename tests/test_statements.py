"""Statements against the checking engine over the small driver tables, and edge cases."""

import glob
import os

import pytest

from sessionloom import queries
from sessionloom.operators import tables
from sessionloom.plans import corpus, statements

DATA = "/root/testdata/sf0.001"
SOME = ("src04_line_classes", "ag04_type_keys", "ag07_system_subtypes", "ag15_tool_cycle", "mt01_snapshots", "mt07_cost", "mt20_retry_rate", "ag28_firings", "jn14_overlaps", "ag27_denial_markers")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SOME)
def test_statement_equals_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = c.execute(queries.SQL[name])
    there = [d[0] for d in cursor.description]
    assert sorted(there) == columns
    tidy = lambda v: round(v, 4) if isinstance(v, float) else v
    want = sorted((tuple(tidy(r[there.index(x)]) for x in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(tidy(r[x]) for x in columns) for r in df.collect()), key=repr) == want


def test_absent_null_and_wrong_types_stay_apart(spark, make_lines):
    rows = [{"type": "assistant", "message": m} for m in ({}, {"stop_reason": None}, {"stop_reason": 3}, {"stop_reason": "x"}, {"stop_reason": [1]}, {"stop_reason": 1.0}, {"stop_reason": {}}, {"stop_reason": False})]
    got = [r["k_stop_reason"] for r in tables.lines(make_lines(rows)).orderBy("line_id").collect()]
    assert got == ["absent", "null", "int", "str", "list", "float", "dict", "bool"]


def test_lines_of_any_kind(spark, make_lines):
    raws = ["", "  ", None, "{cut", "[1]", "3", '{"type": 5}', '{"a": 1}', '{"type": "user", "message": "text"}']
    classes = [r["class"] for r in tables.classified(make_lines(raws)).orderBy("line_id").collect()]
    assert classes == ["blank", "blank", "blank", "parse_error", "non_object", "non_object", "object", "object", "object"]
    lines = tables.lines(make_lines(raws))
    assert [r["type"] for r in lines.orderBy("line_id").collect()] == ["<no-type>", "<no-type>", "user"]
    assert tables.blocks(lines).count() == 0


def test_pairing_stays_within_a_file_and_last_wins(spark, make_lines, tmp_path):
    use = lambda name: {"type": "assistant", "message": {"content": [{"type": "tool_use", "id": "t", "name": name}]}}
    result = {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "t", "is_error": True}]}}
    rows = [("a", use("Read")), ("a", use("Edit")), ("a", result), ("b", result)]
    make_lines(rows).write.parquet(str(tmp_path / "transcript_lines.parquet"))
    got = corpus.run(spark, str(tmp_path), statements.ALL["mt19_error_rate"]).collect()
    assert [(r["tool"], r["calls"], r["errors"]) for r in got] == [("Edit", 1, 1)]
    assert corpus.run(spark, str(tmp_path), statements.ALL["ag16_identity"]).first().asDict() == {"blocks_seen": 2, "resolved": 1, "orphaned": 1}


def test_empty_corpus(spark, make_lines, tmp_path):
    make_lines([]).write.parquet(str(tmp_path / "transcript_lines.parquet"))
    for name in ("ag02_types", "mt02_tokens", "mt20_retry_rate", "ag24_tags"):
        assert corpus.run(spark, str(tmp_path), statements.ALL[name]).count() == 0


def test_worked_cost_example(spark):
    row = spark.sql("select round((2741*5.0D + 329*25.0D + 0*5.0D*0.1 + 0*5.0D*1.25 + 19227*5.0D*2)/1000000, 7) c").first()
    assert row["c"] == 0.2142


WHOLE = ("ag15_cycle_keys", "ag27_denials", "jn14_firing_overlaps")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", WHOLE)
def test_whole_statement_equals_oracle(spark, name):
    test_statement_equals_oracle(spark, name)


def _checked(spark, folder, table, name):
    """Rows of a statement, the same from the checking engine."""
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    df = corpus.run(spark, folder, statements.ALL[name])
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(c.execute(f"select {', '.join(df.columns)} from ({queries.SQL[name]})").fetchall(), key=repr)
    return got


def test_both_firings_of_an_overlap_are_marked(spark, make_lines, tmp_path):
    make_lines([]).write.parquet(str(tmp_path / "transcript_lines.parquet"))
    fired = [("s", 1, 0, 10), ("s", 2, 10, 20), ("s", 3, 30, None), ("s", 4, 40, 90), ("s", 5, 50, 55), ("s", 6, 80, 85), ("t", 7, 0, 5)]
    rows = [(s, p, float(at), phase) for s, p, a, b in fired for at, phase in ((a, "enter"), (b, "exit")) if at is not None]
    df = spark.createDataFrame([(*r, None, None, None, None, None, None) for r in rows], "session_id string, pid bigint, ts_ms double, phase string, hook_event string, tool_use_id string, decision string, duration_ms double, tool string, route string")
    df.write.parquet(str(tmp_path / "dispatch.parquet"))
    got = {p: x for _, p, x in _checked(spark, str(tmp_path), "dispatch", "jn14_firing_overlaps")}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: True, 6: True, 7: False}


def test_denials_are_reported_by_kind(spark, make_lines, tmp_path):
    part = lambda t, **more: {"type": "tool_result", "tool_use_id": "t", "content": t, **more}
    line = lambda kind, *content, **more: {"type": "user", "toolDenialKind": kind, "message": {"content": list(content)}, **more}
    rows = [
        line("rule", part("It has been denied", is_error=True), part("x"), version="1.10.0"), line("rule", part([3, {"type": "image"}, {"type": "odd", "text": "blocked"}]), version="1.9.0"),
        line("rule", version="x"), line("Not Enum"), line(None, part("", is_error=None)), line(["a"], part([], is_error="yes")),
        {"type": "user", "message": {"content": [part("permission")]}},
    ]
    make_lines(rows).write.parquet(str(tmp_path / "transcript_lines.parquet"))
    got = {r[0]: r[1:] for r in _checked(spark, str(tmp_path), "transcript_lines", "ag27_denials")}
    assert got == {
        "rule": (3, "1.9.0", "1.10.0", 2, "<absent>=1, <no-tool-result>=1, true=1", "<no-tool-result>=1, blocked-phrase=1, has-been-denied-phrase=1", 1),
        "<non-enum len=8>": (1, None, None, 0, "<no-tool-result>=1", "<no-tool-result>=1", 0),
        "<null>": (1, None, None, 0, "<null>=1", "no-marker=1", 0), "<other>": (1, None, None, 0, "<other>=1", "no-marker=1", 0),
    }


def test_conditional_keys_count_where_the_envelope_is_a_lone_object(spark, make_lines, tmp_path):
    use = {"type": "assistant", "message": {"content": [{"type": "tool_use", "id": "t", "name": "Edit"}]}}
    result = {"type": "tool_result", "tool_use_id": "t"}
    line = lambda tur, n=1: {"type": "user", "toolUseResult": tur, "message": {"content": [result] * n}}
    rows = [use, line({"structuredPatch": None, "prompt": "p"}), line({"toolStats": {}}), line({"prompt": "p"}, 2), line("text"), line(None, 2)]
    make_lines(rows).write.parquet(str(tmp_path / "transcript_lines.parquet"))
    assert _checked(spark, str(tmp_path), "transcript_lines", "ag15_cycle_keys") == [("Edit", 7, 2, 2, 0, 1, 2, 1, 1, 1)]
