"""Parent-child links of unknown depth to full hierarchies.

The forest is cut into fragments by range-partitioning the nodes on an ordering
that keeps relatives together, so a hot group is split over many tasks and each
task solves a bounded block in memory:

1. per block: local root, local depth and local subtree sizes, upward;
2. the small graph of fragments (a local root and the node it hangs on) is
   solved by pointer doubling: after round k every fragment knows its ancestor
   2^k above and the summed size within 2^k below, so sizes of whole subtrees
   come out in log2(depth) rounds; fragments whose pointers never end are on a
   cycle or below one;
3. per block again: total sizes including hanging fragments, and each sibling
   gets its preorder range by prefix sums, downward;
4. fragment offsets are summed along the fragments' ancestor pointers.

Result per node: ``root``, ``depth``, ``size``, the nested-set range ``lft`` to
``rgt`` within its root, and ``above_<w>`` per weight column, the sum of the
weight over the path from the root to the node, itself included.  Nodes on or
below a cycle have null root and range and depth -1.

Defined cases: a null parent or one that is no node makes a root of depth 0; a
node that is its own parent is a cycle; repeated ids must be reduced first
(``one_per_id``: the row of the lowest order value holds); an empty table gives
an empty result; ids of any text, the empty text included.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.plans.runtime import partitions_for, stage

BLOCK = 150_000  #: nodes that one task solves in memory
STEPS = 1_000_000  #: steps of paths that one task of ``all_paths`` writes
BATCH = 100_000  #: steps of paths after which ``all_paths`` hands on a batch


def one_per_id(edges: DataFrame, order: str) -> DataFrame:
    """One row per id, that of the lowest ``order``, with that row's other columns."""
    rest = [c for c in edges.columns if c not in ("id", order)]
    return edges.groupBy("id").agg(F.min_by(F.struct(*rest), F.col(order)).alias("r"), F.min(order).alias(order)).select("id", "r.*", order)


def _links(ids: np.ndarray, parents: np.ndarray) -> np.ndarray:
    """Position of each parent in ids; -1 where it is null or elsewhere."""
    at = pd.Index(ids).get_indexer(parents)
    at[pd.isna(parents)] = -1
    return at


def _upward(link: np.ndarray) -> np.ndarray:
    """Nodes from the leaves up, children before parents; cycles stay out."""
    n = len(link)
    waiting = np.bincount(link[link >= 0], minlength=n).tolist()
    up = link.tolist()
    order = [i for i in range(n) if not waiting[i]]
    for i in order:
        p = up[i]
        if p >= 0:
            waiting[p] -= 1
            if not waiting[p]:
                order.append(p)
    return np.array(order, dtype=np.int64)


def _local(link: np.ndarray, weights: list[np.ndarray]):
    """Local root (-1 on or below a cycle), depth and weight sums from the root."""
    n = len(link)
    order = _upward(link)
    up = link.tolist()
    root, depth = [-1] * n, [0] * n
    above = [w.tolist() for w in weights]
    for i in reversed(order.tolist()):
        p = up[i]
        if p < 0:
            root[i] = i
        elif root[p] >= 0:
            root[i], depth[i] = root[p], depth[p] + 1
            for a in above:
                a[i] += a[p]
    return order, np.array(root), np.array(depth), [np.array(a) for a in above]


def hierarchy(edges: DataFrame, *, near: list[str], weights: tuple[str, ...] = (), carry: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """Solve the forest of ``edges`` (``id``, ``parent``, the ``near`` columns and
    integer weight columns; ids unique).  ``near`` orders relatives together;
    ``carry`` names further columns that the result keeps, so no join is needed."""
    weights = tuple(weights)
    kept = [f"c_{c}" for c in carry]
    base = edges.select("id", "parent", *near, *[F.col(w).cast("bigint").alias(f"w_{w}") for w in weights], *[F.col(c).alias(k) for c, k in zip(carry, kept)])
    base = stage(base, "forest")
    count = base.count()
    parts = partitions_for(count, block)
    blocks = base.repartitionByRange(parts, *near, "id").withColumn("block", F.spark_partition_id())
    ws = [f"w_{w}" for w in weights]
    above = [f"a_{w}" for w in weights]

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, parents = pdf["id"].to_numpy(object), pdf["parent"].to_numpy(object)
        link = _links(ids, parents)
        order, root, depth, sums = _local(link, [pdf[w].to_numpy(np.int64) for w in ws])
        size = np.zeros(len(ids), np.int64)
        np.add.at(size, root[root >= 0], 1)
        out = pd.DataFrame({"id": ids, "parent": parents, "block": pdf["block"]})
        out["frag"] = np.where(root >= 0, ids[root], None)
        out["d"] = depth
        out["n"] = size
        out["looped"] = root < 0
        for w, a, s in zip(ws, above, sums):
            out[w], out[a] = pdf[w], s
        for k in kept:
            out[k] = pdf[k]
        return out

    ddl = "id string, parent string, block int, frag string, d bigint, n bigint, looped boolean"
    ddl += "".join(f", {w} bigint, {a} bigint" for w, a in zip(ws, above))
    held_ddl = "".join(f", {k} {base.schema[k].dataType.simpleString()}" for k in kept)
    ddl += held_ddl
    solved = stage(_in_blocks(blocks, first, ddl), "blocks")
    # fragments: local roots, with the fragment and node they hang on
    tops = solved.where("frag = id").select(
        F.col("id").alias("f"), F.col("n"), F.col("parent").alias("hang"), F.col("block").alias("own_block")
    )
    hung = tops.where("hang is not null").select("f", "hang")
    hosts = solved.select(
        F.col("id").alias("hang"), F.col("frag").alias("up"), (F.col("d") + 1).alias("step"), F.col("block").alias("host_block"),
        "looped", *above,
    )
    joined = hung.join(hosts, "hang")
    frags = (
        tops.join(joined.select("f", F.col("up"), "step", "host_block", "looped", *above), "f", "left")
        .withColumn("looped", F.coalesce("looped", F.lit(False)))
        .withColumn("up", F.when(F.col("looped"), F.col("f")).otherwise(F.col("up")))  # below a local cycle: points at itself for ever
    )
    frags = stage(frags, "fragments")
    sized, ancestry = _double(frags, above)
    # total sizes of hanging fragments, met by their host blocks
    hanging = frags.where("up is not null and not looped").select("f", "hang", "host_block").join(sized, "f")

    def second(pdf: pd.DataFrame, extra: pd.DataFrame) -> pd.DataFrame:
        ids, parents = pdf["id"].to_numpy(object), pdf["parent"].to_numpy(object)
        link = _links(ids, parents)
        order = _upward(link)
        size = np.ones(len(ids), np.int64)
        at = pd.Index(ids).get_indexer(extra["hang"].to_numpy(object)) if len(extra) else np.array([], np.int64)
        if len(extra):
            np.add.at(size, at, extra["total"].to_numpy(np.int64))
        size, up = size.tolist(), link.tolist()
        steps = order.tolist()
        for i in steps:
            if up[i] >= 0:
                size[up[i]] += size[i]
        lft, free = [0] * len(ids), [1] * len(ids)  # free: next unused offset below a node
        for i in reversed(steps):
            p = up[i]
            if p >= 0:
                lft[i] = lft[p] + free[p]
                free[p] += size[i]
        starts = []
        for i, total in zip(at.tolist(), extra["total"].tolist() if len(extra) else []):
            starts.append(lft[i] + free[i])
            free[i] += total
        out = pd.DataFrame({"id": ids, "parent": parents, "frag": pdf["frag"], "d": pdf["d"], "lft": lft, "size": size})
        out["start_of"] = None
        for a in (*above, *kept):
            out[a] = pdf[a]
        if starts:
            more = pd.DataFrame({"start_of": extra["f"].to_numpy(object), "lft": starts})
            out = pd.concat([out, more], ignore_index=True)
        return out

    ddl2 = "id string, parent string, frag string, d bigint, lft bigint, size bigint, start_of string" + "".join(f", {a} bigint" for a in above) + held_ddl
    left = solved.select("id", "parent", "frag", "d", "block", *above, *kept).groupBy("block")
    right = hanging.select("f", "hang", "total", F.col("host_block").alias("block")).groupBy("block")
    numbered = stage(left.cogroup(right).applyInPandas(second, ddl2), "numbered")
    begun = numbered.where("start_of is not null").select(F.col("start_of").alias("f"), F.col("lft").alias("rel"))
    offsets = _offsets(ancestry, begun, above)
    local = numbered.where("start_of is null")
    whole = local.join(offsets.withColumnRenamed("f", "frag"), "frag", "left")
    ok = F.col("root").isNotNull()
    return whole.select(
        "id", "parent", F.col("root"),
        F.when(ok, F.col("d") + F.col("steps")).otherwise(-1).cast("int").alias("depth"),
        F.when(ok, F.col("size")).alias("size"),
        F.when(ok, F.col("lft") + F.col("offset")).alias("lft"),
        F.when(ok, F.col("lft") + F.col("offset") + F.col("size") - 1).alias("rgt"),
        *[F.when(ok, F.col(a) + F.col(f"o_{a}")).alias(f"above_{w}") for a, w in zip(above, weights)],
        *[F.col(k).alias(c) for c, k in zip(carry, kept)],
    )


def _in_blocks(blocks: DataFrame, solve, ddl: str) -> DataFrame:
    """Apply ``solve`` to each partition as a whole; partitions are bounded blocks."""

    def run(batches):
        held = [b for b in batches if len(b)]
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    return blocks.mapInPandas(run, ddl)


def _double(frags: DataFrame, above: list[str]) -> tuple[DataFrame, DataFrame]:
    """Total subtree size per fragment by pointer doubling over ancestor links.

    Returns (f, total) and the fragments with their links; a fragment on or
    below a cycle gets a null ``total``.
    """
    cur = frags.select("f", F.col("up").alias("p"), F.col("n").alias("s"))
    before = -1
    pending = cur.where("p is not null").count()
    while pending and pending != before:
        gain = cur.where("p is not null").groupBy(F.col("p").alias("f")).agg(F.sum("s").alias("g"))
        # solved fragments hop no more: they stay out of the join on the pointer, where all would meet on null
        jump = cur.where("p is not null").select(F.col("f").alias("p"), F.col("p").alias("pp"))
        hopped = cur.where("p is not null").join(jump, "p", "left").select("f", F.col("pp").alias("p"), "s")
        every = hopped.unionByName(cur.where("p is null"))
        cur = stage(every.join(gain, "f", "left").select("f", "p", (F.col("s") + F.coalesce("g", F.lit(0))).alias("s")), "sizes")
        before, pending = pending, cur.where("p is not null").count()
    totals = cur.where("p is null").select("f", F.col("s").alias("total"))
    return totals, frags


def _offsets(frags: DataFrame, begun: DataFrame, above: list[str]) -> DataFrame:
    """(f, root, steps, offset, o_<a>) per fragment: sums along ancestor links."""
    sums = ["steps", "offset", *[f"o_{a}" for a in above]]
    cur = frags.join(begun, "f", "left").select(
        "f", F.col("up").alias("p"), F.coalesce("step", F.lit(0)).alias("steps"), F.coalesce("rel", F.lit(0)).alias("offset"),
        *[F.coalesce(F.col(a), F.lit(0)).alias(f"o_{a}") for a in above],
        F.col("f").alias("root"),
    )
    cur = stage(cur, "offsets")
    before, pending = -1, cur.where("p is not null").count()
    while pending and pending != before:
        hop = cur.select(F.col("f").alias("p"), F.col("p").alias("pp"), F.col("root").alias("rr"), *[F.col(s).alias(f"h_{s}") for s in sums])
        hopped = cur.where("p is not null").join(hop, "p", "left").select(
            "f", F.col("pp").alias("p"), *[(F.col(s) + F.coalesce(F.col(f"h_{s}"), F.lit(0))).alias(s) for s in sums], F.coalesce("rr", "root").alias("root")
        )
        cur = stage(hopped.unionByName(cur.where("p is null").select(*hopped.columns)), "offsets")
        before, pending = pending, cur.where("p is not null").count()
    return cur.where("p is null").select("f", "root", *sums)


def _bucketed(solved: DataFrame, width: int) -> DataFrame:
    return solved.where("lft is not null").withColumn("bucket", F.expr(f"lft div {width}"))


def descendants(solved: DataFrame, of: DataFrame, *, width: int = 1024) -> DataFrame:
    """(ancestor, id) for each id of ``of`` and every node in its range.

    Ranges are split into buckets, so the join is on (root, bucket).
    """
    tops = solved.join(of.select("id").distinct(), "id", "left_semi").where("lft is not null")
    spans = tops.select(
        F.col("id").alias("ancestor"), "root", F.col("lft").alias("a"), F.col("rgt").alias("b"),
        F.explode(F.sequence(F.expr(f"lft div {width}"), F.expr(f"rgt div {width}"))).alias("bucket"),
    )
    return spans.join(_bucketed(solved, width), ["root", "bucket"]).where("lft > a and lft <= b").select("ancestor", "id")


def paths(solved: DataFrame, of: DataFrame) -> DataFrame:
    """(id, path) from the root to each id of ``of``, by the ranges around it.

    The nodes that have descendants are ancestors; an ancestor's range covers
    dyadic intervals, and a node looks up the dyadic intervals that hold it, so
    rows grow with depth of the asked nodes only.
    """
    asked = solved.join(of.select("id").distinct(), "id", "left_semi").where("lft is not null")
    # only the levels that the node's own tree reaches: one per doubling of its size
    tops = solved.where("depth = 0").select("root", F.ceil(F.log2(F.col("size") + 1)).cast("int").alias("most"))
    asked = asked.join(tops, "root").select("id", "root", F.col("lft").alias("x"), F.explode(F.expr("sequence(0, most)")).alias("k"))
    points = asked.withColumn("cell", F.expr("shiftright(x, k)"))
    spans = solved.where("lft is not null").select(
        F.col("id").alias("over"), "root", F.col("lft").alias("a"), F.col("rgt").alias("b"), F.col("depth").alias("at"),
        F.ceil(F.log2(F.col("size") + 1)).cast("int").alias("k"),
    )
    spans = spans.withColumn("cell", F.explode(F.expr("sequence(shiftright(a, k), shiftright(b, k))")))
    met = points.join(spans, ["root", "k", "cell"]).where("a <= x and x <= b")
    return met.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "over"))), lambda s: s["over"]).alias("path"))


def all_paths(solved: DataFrame, *, width: int = 256, steps: int = STEPS, batch: int = BATCH) -> DataFrame:
    """(id, path) from the root to every node that has a range; ``solved`` is read twice.

    Rows in preorder need only the stack of open nodes.  Trees are cut into
    buckets of ``width`` positions; a node stands in its own bucket and in each
    that begins inside its range, where it is an ancestor of the first node.
    Each path is written once and none passes a shuffle, so shuffled rows grow
    with the nodes and 1/``width`` of the steps.
    """
    work = solved.where("lft is not null").agg(F.sum(F.col("depth").cast("bigint") + 1)).first()[0] or 0
    placed = solved.where("lft is not null").select(
        "id", "root", "depth", "lft", F.explode(F.expr(f"sequence(lft div {width}, rgt div {width})")).alias("bucket")
    )
    placed = placed.repartition(partitions_for(work, steps, 1), "root", "bucket").sortWithinPartitions("root", "bucket", "lft")

    def run(batches):
        at, opened = None, []
        ids, flat, ends = [], [], [0]

        def made():
            path = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), path], ["id", "path"])

        for rows in batches:
            for node, root, depth, own, bucket in zip(*(c.to_pylist() for c in rows.columns)):
                if (root, bucket) != at:
                    at, opened = (root, bucket), []
                del opened[depth:]
                opened.append(node)
                if own:
                    ids.append(node)
                    flat.extend(opened)
                    ends.append(len(flat))
                    if len(flat) >= batch:
                        yield made()
                        ids, flat, ends = [], [], [0]
        yield made()

    own = F.expr(f"bucket = lft div {width}").alias("own")
    return placed.select("id", "root", "depth", own, "bucket").mapInArrow(run, "id string, path array<string>")
