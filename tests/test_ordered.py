import random

import pytest

from sessionloom.operators import ordered


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_before_equals_a_plain_walk(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice(["a", "a", "a", "b", None, "c"]), i, rng.choice([None, 1, 2, 5]), rng.choice(["x", None, "y"])) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, o int, v int, s string").repartition(5)
    got = {r["o"]: (r["total"], r["most"], r["least"], r["previous"]) for r in ordered.before(df, ["g"], ["o"], block=block, total=("sum", "v"), most=("max", "v"), least=("min", "v"), previous=("last", "s")).collect()}
    seen: dict = {}
    for g, o, v, s in rows:
        values, last = seen.setdefault(g, ([], [None]))
        known = [x for x in values if x is not None]
        assert got[o] == (sum(known) if known else None, max(known, default=None), min(known, default=None), last[0])
        values.append(v)
        last[0] = s
    places = {r["o"]: r["place"] for r in ordered.ranked(df, ["o"], "place", block=block).collect()}
    assert places == {i: i + 1 for i in range(120)}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "g string, o int, v int")
    assert ordered.before(df, ["g"], ["o"], total=("sum", "v")).count() == 0 and ordered.ranked(df, ["o"], "place").count() == 0


@pytest.mark.parametrize("later", [False, True])
def test_asof_is_strict_and_null_safe(spark, later):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", None]), rng.choice([None, *range(12)]), rng.choice([None, 3, 8])) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, g string, o int, v int").repartition(3)
    got = {r["id"]: r["found"] for r in ordered.asof(df, ["g"], "o", "v", "found", later=later, block=7).collect()}
    for i, g, o, _ in rows:
        some = [v for _, h, p, v in rows if h == g and o is not None and p is not None and v is not None and (p > o if later else p < o)]
        assert got[i] == ((min(some) if later else max(some)) if some else None)
