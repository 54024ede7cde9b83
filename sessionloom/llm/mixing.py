"""Mixing sources to target weights in tokens of a public tokenizer.

Each source's records are laid end to end in a pseudorandom order and cut into
blocks of a fixed number of tokens.  Block counts per source come from the
target shares and the repeat caps (water-filling); source counts per output
shard are multinomial draws conditioned on those totals; the j-th slot of a
source maps through a keyed permutation of its block indices, a fresh one per
repeat, and slots and blocks meet by a join on (source, block).

Defined cases: null and blank texts have no tokens and are left out; source
names are compared in one writing (case, spaces, hyphens); sources without a
target, targets without documents, null or non-positive shares take no part;
shares are relative to their sum; the last block of a source may be shorter; a
cap below one leaves the source out; an empty corpus gives empty tables.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sessionloom.functions.records import batch_of
from sessionloom.plans.runtime import stage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK_TOKENS = 512
SHARD_BLOCKS = 256
SEED = 20260
STRETCH_ROWS = 100_000  #: records per stretch of the order; results don't depend on it
GROUP = 1024  #: shards whose counts one task draws
MOST_DRAWN = 1_000_000_000  #: blocks up to which counts are drawn at once

#: Fixed value: the pre-tokenisation pattern of the 50k byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a vocabulary file, once per process."""
    found = _encoders.get(path)
    if found is None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        found = _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return found


def one_writing(column):
    """A source name in lower case with single underscores."""
    return F.regexp_replace(F.lower(F.trim(column)), r"[\s_-]+", "_")


def sizes(documents: DataFrame, vocabulary: str = VOCABULARY, *, id_col="doc_id") -> DataFrame:
    """(doc_id, source, tokens) of every document with text and source."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("tokens", pa.int64())])

    def run(batches):
        encode = encoder(vocabulary)
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            yield batch_of(schema, [(d, s, len(encode.encode_ordinary(t))) for d, s, t in rows])

    source = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), one_writing(F.col("source")).alias("source"), "text")
    kept = source.where("source is not null and source <> '' and text is not null and trim(text) <> ''")
    return kept.mapInArrow(run, "doc_id bigint, source string, tokens bigint")


def pieces(sized: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """(source, block, doc_id, first, last) token ranges of records in blocks.

    Positions are prefix sums: within stretches of the pseudorandom order, plus
    the totals of earlier stretches, so no window runs over a whole source.
    """
    bits = max(1, math.ceil(math.log2(max(2, sized.count() / STRETCH_ROWS))))
    # the least 63 bits of a hash order the records, the highest of these cut the order into stretches
    order = F.xxhash64(F.lit(seed), "doc_id").bitwiseAND((1 << 63) - 1)
    placed = sized.withColumn("order", order).withColumn("stretch", F.shiftrightunsigned("order", 63 - bits))
    totals = placed.groupBy("source", "stretch").agg(F.sum("tokens").alias("n"))
    before = totals.withColumn(
        "before", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("n")
    within = Window.partitionBy("source", "stretch").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.withColumn("inner", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(before, ["source", "stretch"])
    spans = at.select("source", "doc_id", "tokens", (F.col("before") + F.col("inner")).alias("start")).where("tokens > 0")
    first, last = F.expr(f"start div {block_tokens}"), F.expr(f"(start + tokens - 1) div {block_tokens}")
    cut = spans.withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("start"), F.col("block") * block_tokens) - F.col("start")
    high = F.least(F.col("start") + F.col("tokens"), (F.col("block") + 1) * block_tokens) - F.col("start")
    return cut.select("source", "block", "doc_id", low.alias("first"), high.alias("last"))


def allot(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, float]:
    """Tokens per source: as close to the shares as the caps allow.

    Without a total the largest one is taken at which every share is met
    exactly; with one, capped sources give what they have and the rest is
    shared among the others in proportion.
    """
    live = {s: (w, c) for s, (w, c) in targets.items() if tokens.get(s, 0) > 0 and w and w > 0 and c and c >= 1}
    if not live:
        return {}
    whole = sum(w for w, _ in live.values())
    if total is None:
        return {s: w / whole * min(c * tokens[s] / (v / whole) for s, (v, c) in live.items()) for s, (w, _) in live.items()}
    out: dict[str, float] = {}
    rest, open_ = float(total), dict(live)
    while open_:
        weight = sum(w for w, _ in open_.values())
        full = [s for s, (w, c) in open_.items() if rest * w / weight >= c * tokens[s]]
        if not full:
            return out | {s: rest * w / weight for s, (w, _) in open_.items()}
        for s in full:
            out[s] = float(open_.pop(s)[1] * tokens[s])
        rest = total - sum(out.values())
    return out


def shard_counts(totals: dict[str, int], shard_blocks: int = SHARD_BLOCKS, seed=SEED) -> list[dict[str, int]]:
    """Multinomial draws per shard, conditioned on the totals being used up."""
    names = sorted(totals)
    left = np.array([totals[s] for s in names], np.int64)
    rng = np.random.default_rng(seed)
    out = []
    while left.sum():
        take = min(shard_blocks, int(left.sum()))
        drawn = rng.multivariate_hypergeometric(left, take, method="marginals")
        left -= drawn
        out.append({s: int(n) for s, n in zip(names, drawn) if n})
    return out


def group_counts(totals: dict[str, int], group_blocks: int, seed: int = SEED) -> list[dict[str, int]]:
    """Counts per group of shards: drawn, or where there are too many blocks to
    draw from at once, in proportion with the remainders spread evenly."""
    every = sum(totals.values())
    if every < MOST_DRAWN:
        return shard_counts(totals, group_blocks, seed)
    groups = -(-every // group_blocks)
    return [{s: (g + 1) * n // groups - g * n // groups for s, n in totals.items()} for g in range(groups)]


def permuted(index: int, size: int, key: str) -> int:
    """Place of an index under a keyed pseudorandom permutation of range(size)
    (a four-round Feistel network on the next even number of bits, walked until
    the value is in range)."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    x = index
    while True:
        left, right = x >> half, x & mask
        for r in range(4):
            h = int.from_bytes(hashlib.blake2b(f"{key}:{r}:{right}".encode(), digest_size=8).digest(), "little")
            left, right = right, left ^ (h & mask)
        x = left << half | right
        if x < size:
            return x


def slots(spark: SparkSession, totals: dict[str, int], blocks: dict[str, int], shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, group: int | None = None) -> DataFrame:
    """(shard, source, block, repeat) of every slot of the output.

    The driver draws counts for groups of shards only; the counts of shards, their
    slots and permuted indices are made in tasks, one group at a time.
    """
    per = (group or GROUP) * shard_blocks
    rows, used, first = [], dict.fromkeys(totals, 0), 0
    for g, counts in enumerate(group_counts(totals, per, seed)):
        names = sorted(counts)
        rows.append((g, first, names, [used[s] for s in names], [counts[s] for s in names], [blocks[s] for s in names]))
        for s in names:
            used[s] += counts[s]
        first += -(-sum(counts.values()) // shard_blocks)
    schema = pa.schema([("shard", pa.int64()), ("source", pa.string()), ("block", pa.int64()), ("repeat", pa.int32())])

    def run(batches):
        for batch in batches:
            for g, first, names, starts, counts, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                at, size = dict(zip(names, starts)), dict(zip(names, sizes))
                out = []
                for shard, drawn in enumerate(shard_counts(dict(zip(names, counts)), shard_blocks, (seed, g)), first):
                    for s, n in drawn.items():
                        for i in range(at[s], at[s] + n):
                            again, index = divmod(i, size[s])
                            out.append((shard, s, permuted(index, size[s], f"{seed}:{s}:{again}"), again))
                        at[s] += n
                    if len(out) >= 100_000:
                        yield batch_of(schema, out)
                        out = []
                yield batch_of(schema, out)

    frame = spark.createDataFrame(rows, "g bigint, first bigint, names array<string>, starts array<bigint>, counts array<bigint>, sizes array<bigint>")
    return frame.repartition(max(1, min(len(rows), 10_000)), "g").mapInArrow(run, "shard bigint, source string, block bigint, repeat int")


def mix(documents: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The selection (shard, source, block, repeat, doc_id, first, last) and the
    report (source, target_share, actual_share, tokens, available, most_repeats)."""
    spark = documents.sparkSession
    wanted: dict[str, tuple[float, int]] = {}
    for r in targets.select(one_writing(F.col("source")).alias("source"), "target_share", "repeat_cap").collect():  # a configuration table
        if r["source"] is not None and r["target_share"] is not None and r["repeat_cap"] is not None:
            wanted.setdefault(r["source"], (r["target_share"], r["repeat_cap"]))
    named = sizes(documents, vocabulary)
    sized = stage(named.where(F.col("source").isin(sorted(wanted))), "sizes")
    tokens = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("tokens").alias("n")).collect() if r["n"]}
    share = allot(tokens, wanted, total_tokens)
    blocks = {s: math.ceil(tokens[s] / block_tokens) for s in share}
    # a source's last block is shorter, so slots are counted in its mean block
    totals = {s: min(round(n * blocks[s] / tokens[s]), wanted[s][1] * blocks[s]) for s, n in share.items()}
    totals = {s: n for s, n in totals.items() if n}
    laid = stage(pieces(sized, block_tokens), "pieces")
    chosen = slots(spark, totals, blocks)
    selection = chosen.join(laid, ["source", "block"]).select("shard", "source", "block", "repeat", "doc_id", "first", "last")
    whole = sum(w for s, (w, c) in wanted.items() if s in share) or 1.0
    goal = spark.createDataFrame([(s, w / whole if s in share else 0.0, tokens.get(s, 0)) for s, (w, _) in sorted(wanted.items())] or [], "source string, target_share double, available bigint")
    got = selection.groupBy("source").agg(F.sum(F.col("last") - F.col("first")).alias("tokens"), (F.max("repeat") + 1).alias("most_repeats"))
    every = got.agg(F.sum("tokens").alias("whole"))
    report = goal.join(got, "source", "left").join(F.broadcast(every))  # one row
    report = report.select(
        "source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.col("whole")).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        "available", F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
    )
    return selection, report
