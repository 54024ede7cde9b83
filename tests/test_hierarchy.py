import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sessionloom.operators import hierarchy as H


def brute(parents: dict):
    out = {}
    for v in parents:
        path, x = [], v
        while x is not None and x in parents and x not in path:
            path.append(x)
            x = parents[x]
        loop = x is not None and x in parents
        out[v] = (None, -1, None) if loop else (path[-1], len(path) - 1, list(reversed(path)))
    return out


def check(spark, parents: dict, block: int, near=None):
    rows = [(k, p, (near or {}).get(k, k), i, 1) for i, (k, p) in enumerate(parents.items())]
    df = spark.createDataFrame(rows, "id string, parent string, near string, n bigint, w bigint")
    solved = H.hierarchy(df, near=["near"], weights=("w",), block=block).cache()
    got = {r["id"]: r for r in solved.collect()}
    want = brute(parents)
    assert len(got) == len(parents)
    for v, (root, depth, path) in want.items():
        r = got[v]
        assert (r["root"], r["depth"]) == (root, depth), v
        if root is None:
            assert r["lft"] is None and r["size"] is None
            continue
        assert r["above_w"] == depth + 1
        below = {x for x, (_, _, p) in want.items() if p and v in p}
        inside = {x for x in got if got[x]["root"] == root and got[x]["lft"] is not None and r["lft"] <= got[x]["lft"] <= r["rgt"]}
        assert inside == below and r["size"] == len(below), v
    return solved, want


def test_blocks_cut_chains_trees_and_cycles(spark):
    random.seed(3)
    parents = {"c0": None} | {f"c{i}": f"c{i - 1}" for i in range(1, 60)}
    parents |= {"x": "y", "y": "z", "z": "x", "below": "x", "below2": "below", "self": "self", "lost": "nowhere", "": None, "of empty": ""}
    parents |= {f"t{i}": f"c{random.randrange(60)}" if i < 5 else f"t{random.randrange(i)}" for i in range(80)}
    near = {k: f"{random.randrange(100):03d}" for k in parents}
    solved, want = check(spark, parents, block=17, near=near)
    some = solved.select("id").where("id in ('c0', 'c30', 't3', 't70', 'x')")
    got = {}
    for r in H.descendants(solved, some, width=8).collect():
        got.setdefault(r["ancestor"], set()).add(r["id"])
    for v in ("c0", "c30", "t3", "t70"):
        assert got.get(v, set()) == {x for x, (_, _, p) in want.items() if p and v in p[:-1]}
    paths = {r["id"]: r["path"] for r in H.paths(solved, some).collect()}
    assert paths == {v: want[v][2] for v in ("c0", "c30", "t3", "t70")}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-1, 24), min_size=1, max_size=25), st.integers(3, 30))
def test_any_functional_graph(spark, links, block):
    check(spark, {f"n{i}": None if p < 0 else f"n{p}" for i, p in enumerate(links)}, block)


def test_empty(spark):
    df = spark.createDataFrame([], "id string, parent string, near string")
    assert H.hierarchy(df, near=["near"]).count() == 0


def test_one_per_id_keeps_the_lowest(spark):
    df = spark.createDataFrame([("a", "p", 2, "n"), ("a", None, 1, "m"), ("b", "a", 3, "n")], "id string, parent string, o int, near string")
    assert {tuple(r) for r in H.one_per_id(df, "o").collect()} == {("a", None, "m", 1), ("b", "a", "n", 3)}


def test_odd_lines_crash_no_query(spark, make_lines, tmp_path):
    """Lone surrogates, a cycle, nulls, a long text and clashing columns in one table."""
    from pyspark.sql import functions as F

    from sessionloom import queries

    rows = [
        '{"type":"user","uuid":"\\ud800","sessionId":"\\ud800","message":{"id":"\\udfff","content":"\\ud800 x"},"\\ud801":"\\ud802"}',
        {"type": "user", "uuid": "y", "parentUuid": "y", "sessionId": "s", "message": {"id": "m", "content": [None, [], {}, "t"], "usage": {"output_tokens": "1e400"}}},
        {"type": None, "uuid": None, "message": None}, None, "", "{cut", {"type": "user", "uuid": "z", "sessionId": "s", "timestamp": "0000-99", "message": {"content": "word " * 100_000}},
        '{"type":"user","uuid":"c","parentUuid":"\\ud800","sessionId":"\\ud800","message":{"content":"y"}}',
    ]
    df = make_lines(rows)
    df = df.unionByName(df).withColumns({c: F.lit("clash") for c in ("id", "parent", "row", "near", "block", "version", "path", "body")})
    df.write.parquet(str(tmp_path / "transcript_lines.parquet"))
    spark.createDataFrame([("user", "uuid", "str", True)], "record_type string, field_path string, json_type string, is_required boolean").write.parquet(str(tmp_path / "schema_baseline.parquet"))
    counts = {n: queries.QUERIES[n](spark, str(tmp_path)).count() for n in ("p1_found", "p1_unified", "p2_found", "p5_found", "p5_objects", "p5_usage", "san12_residual")}
    assert counts["p1_unified"] == 16 and counts["p2_found"] == 4
    found = {r["uuid"]: (r["root_uuid"], r["depth"]) for r in queries.QUERIES["p2_found"](spark, str(tmp_path)).collect()}
    assert found == {"\\ud800": ("\\ud800", 0), "c": ("\\ud800", 1), "y": ("", -1), "z": ("z", 0)}
    assert sorted(r[0] for r in queries.QUERIES["p6_found"](spark, str(tmp_path)).collect()) == [1, 2, 7, 8]


def test_all_paths_of_any_cut(spark):
    random.seed(5)
    parents = {"c0": None} | {f"c{i}": f"c{i - 1}" for i in range(1, 60)}
    parents |= {"x": "y", "y": "x", "below": "x", "self": "self", "lost": "nowhere", "é": "lost", "": None, "of empty": ""}
    parents |= {f"t{i}": f"c{random.randrange(60)}" if i < 5 else f"t{random.randrange(i)}" for i in range(80)}
    solved, want = check(spark, parents, block=17)
    for width, steps, batch in ((1, 50, 1), (8, 200, 30), (256, 10**6, 10**5)):
        rows = H.all_paths(solved, width=width, steps=steps, batch=batch).collect()
        assert len(rows) == len({r["id"] for r in rows})
        assert {r["id"]: r["path"] for r in rows} == {v: path for v, (root, _, path) in want.items() if root is not None}
    assert H.all_paths(solved.where("lft is null")).count() == 0


def test_every_line_has_its_path_and_descendants(spark, make_lines, tmp_path):
    """The checking SQL without its choice of one line id in 20 gives the same rows."""
    import duckdb

    from sessionloom import queries

    rows = [{"uuid": f"u{i}", "parentUuid": f"u{i - 1 if i % 9 else i // 2}" if i else None} for i in range(70)]
    rows += [{"uuid": "a", "parentUuid": "b"}, {"uuid": "b", "parentUuid": "a"}, {"uuid": "under", "parentUuid": "a"}, {"uuid": "u3", "parentUuid": "u60"}, "{cut", None]
    make_lines(rows).write.parquet(str(tmp_path / "transcript_lines.parquet"))
    db = duckdb.connect()
    db.sql(f"create view transcript_lines as from '{tmp_path}/transcript_lines.parquet/*.parquet'")
    for whole, part, choice in (("p2_all_paths", "p2_paths", " where line_id % 20 = 0"), ("p2_all_descendants", "p2_descendants", "n.line_id % 20 = 0 and ")):
        sql = queries.SQL[part]
        assert sql.count(choice) == 1
        every = sorted(db.sql(sql.replace(choice, "")).fetchall())
        got = queries.QUERIES[whole](spark, str(tmp_path))
        assert got.columns == queries.QUERIES[part](spark, str(tmp_path)).columns
        assert sorted(map(tuple, got.collect())) == every and len(every) > len(db.sql(sql).fetchall())
