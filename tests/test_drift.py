from sessionloom.operators import drift

BASE = [
    ("user", "type", "str", True), ("user", "uuid", "str", True), ("user", "cwd", "str", True), ("user", "isMeta", "bool", False),
    ("user", "message", "dict", True), ("user", "message.content", "str", True), ("user", "message.content", "list", True),
    ("user", "message.content[].type", "str", False), ("user", "message.content[].text", "str", False),
]


def _base(spark):
    return spark.createDataFrame(BASE, "record_type string, field_path string, json_type string, is_required boolean")


def _user(i, **more):
    return {"type": "user", "uuid": f"u-{i}", "cwd": f"/home/dev/p{i % 3}", "message": {"content": "hi"}} | more


def test_departures_and_learned_renames(spark, make_lines):
    rows = [("a.jsonl", _user(i)) for i in range(12)]
    for i in range(12):
        r = _user(i)
        r["workdir"] = r.pop("cwd")
        rows.append(("b.jsonl", r))
    rows.append(("c.jsonl", _user(1, cwd=None)))  # null is neither absence nor a retyping
    rows.append(("d.jsonl", _user(1, cwd=7, extra=1)))
    gone = _user(1)
    del gone["uuid"]
    rows.append(("e.jsonl", gone))
    rows.append(("f.jsonl", {"type": "other", "x": 1}))
    named = {"recordType" if k == "type" else k: v for k, v in _user(2).items()}
    rows += [("g.jsonl", named), ("g.jsonl", {"recordType": "unheard"})]
    rows += [("h.jsonl", ""), ("h.jsonl", "{broken"), ("h.jsonl", "[1]"), ("h.jsonl", None)]
    rows += [("i.jsonl", _user(1, message={"content": {"kind": "text", "text": "x"}})), ("i.jsonl", _user(1, message={"content": [{"type": "text", "text": "y"}]}))]
    found = drift.Drift(make_lines(rows), _base(spark))
    assert found.learn_renames()["workdir"] == "cwd"
    got = {tuple(r) for r in found.changes().collect()}
    assert got == {
        ("b.jsonl", "user", "cwd", "renamed"), ("d.jsonl", "user", "cwd", "retyped"), ("d.jsonl", "user", "extra", "added"),
        ("e.jsonl", "user", "uuid", "removed"), ("f.jsonl", "other", "type", "added"), ("g.jsonl", "user", "type", "renamed"),
        ("g.jsonl", "unheard", "type", "added"), ("i.jsonl", "user", "message.content", "retyped"), ("i.jsonl", "user", "message.content[].type", "renamed"),
    }


def test_empty_table_gives_empty_report(spark, make_lines):
    assert drift.Drift(make_lines([]), _base(spark)).changes().count() == 0


def test_unify_keeps_everything(spark, make_lines):
    r = _user(1, extra={"a": [1]})
    r["workdir"] = r.pop("cwd")
    df = make_lines([r, "{broken"]).withColumnRenamed("slug", "uuid")  # a clashing column
    out = drift.unify(df, _base(spark), {"workdir": "cwd"}).orderBy("line_id").collect()
    assert out[0]["cwd"] == "/home/dev/p1" and out[0]["uuid"] == "u-1" and out[0]["in_uuid"] == "-p"
    assert out[0]["extras"] == {"extra": '{"a": [1]}'} and out[0]["readable"] and not out[1]["readable"]


def test_unified_query_keeps_added_fields_and_folds_blocks(spark, make_lines, tmp_path):
    import json

    from sessionloom import queries

    rows = [_user(i) for i in range(12)]
    for i in range(12):
        block = {"kind": "text", "text": f"words {i}", "more": 1} if i % 2 else {"type": "text", "text": f"words {i}"}
        rows.append(_user(i, zeta={"a": [i]}, message={"content": [block, "bare"], "speed": "fast", "usage": {"tier": 2}}))
    make_lines([*rows, "{broken"]).write.parquet(str(tmp_path / "transcript_lines.parquet"))
    _base(spark).write.parquet(str(tmp_path / "schema_baseline.parquet"))
    out = queries.p1_unified(spark, str(tmp_path)).orderBy("line_id").collect()
    extras = json.loads(out[13]["extras"])
    assert list(extras) == sorted(extras) and {k: json.loads(v) for k, v in extras.items()} == {"message.speed": "fast", "message.usage": {"tier": 2}, "message.usage.tier": 2, "zeta": {"a": [1]}}
    want = [{"type": "text", "text": "words 1", "more": 1}, "bare"]
    assert json.loads(out[13]["message__content"]) == want and json.loads(out[13]["message"])["content"] == want
    assert out[0]["extras"] == "{}" and not out[24]["readable"]


def test_renamed_fields_fold_at_every_level():
    back = {"": {"b": "a"}, "message": {"m2": "m"}, "message.usage": {"u2": "u"}, "message.content[]": {"kind": "type"}}
    got = drift._fold_back({"b": 1, "message": {"m2": 1, "usage": {"u2": 1, "u": 2}, "content": {"kind": 1}}}, back)
    assert got == {"a": 1, "message": {"m": 1, "usage": {"u2": 1, "u": 2}, "content": {"type": 1}}}


def test_matching_is_of_maximum_weight():
    assert drift.match([[0.9, 0.8], [0.85, 0.0]]) == [1, 0]
    assert drift.match([[0.1, 0.5, 0.4]]) == [1]
    assert drift.match([]) == []


def test_two_emitters_rename_one_field_and_versions_keep_apart(spark, make_lines):
    rows = [("a.jsonl", _user(i, version="1.0.0")) for i in range(20)]
    for name, other, version in (("b.jsonl", "workdir", "1.1.0"), ("c.jsonl", "cwdPath", "1.1.0"), ("d.jsonl", "currentCwd", "1.2.0")):
        for i in range(12):
            r = _user(i, version=version)
            r[other] = r.pop("cwd")
            rows.append((name, r))
    base = BASE + [("user", "version", "str", False)]
    base = spark.createDataFrame(base, "record_type string, field_path string, json_type string, is_required boolean")
    found = drift.Drift(make_lines(rows), base)
    assert found.learn_renames() == {"workdir": "cwd", "cwdPath": "cwd", "currentCwd": "cwd"}
    assert {tuple(r) for r in found.changes().collect()} == {(f, "user", "cwd", "renamed") for f in ("b.jsonl", "c.jsonl", "d.jsonl")}


def test_profiles_do_not_depend_on_partitions(spark, make_lines):
    rows = [_user(i, tag=f"{'abcdefghijklmnop'[i % 16]}{'xyz'[i % 3]}{'qrstu'[i % 5]}{i}" * (1 + i % 7)) for i in range(900)]
    lines = make_lines(rows)
    one, many = (drift.Drift(lines.repartition(n), _base(spark)).profiles() for n in (1, 7))
    assert one == many and len(one["", "uuid"]["sketch"]) == drift.SKETCH and len(one["", "tag"]["shapes"]) == drift.SHAPES


def test_learned_names_serve_other_operators(spark, make_lines):
    from sessionloom.functions.records import Aliases
    from sessionloom.operators import shred

    part = lambda i, kind: {"type": "user", "uuid": f"u-{i}", "cwd": f"/home/dev/p{i % 3}", "message": {"content": [{kind: "text", "text": f"t{i}"}, {kind: "tool_use", "id": f"c{i}"}]}}
    base = spark.createDataFrame(BASE + [("user", "message.content[].id", "str", False)], "record_type string, field_path string, json_type string, is_required boolean")
    lines = make_lines([("a.jsonl", part(i, "type")) for i in range(12)] + [("b.jsonl", part(i, "blockType")) for i in range(12)])
    renames = drift.Drift(lines, base).learn_renames()
    assert renames == {"message.content[].blockType": "message.content[].type"}
    bridged = shred.bridge(lines, aliases=Aliases.learned(renames))
    got = shred.nodes(bridged, shred.objects(bridged)).collect()
    assert sorted((r["line_id"], r["node_type"], r["ref_id"]) for r in got) == [(i + 1, "tool_use", f"c{i % 12}") for i in range(24)]
