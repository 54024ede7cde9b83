"""Rebuilding conversations from message rows.

Every message that names a parent gets candidate parents: the message it names,
those whose ids it mentions, and the one before it in time.  A candidate's score
adds a named link, closeness in time, a mention of the candidate's ids, lexical
overlap and a change of speaker; the likeliest is chosen.  A message whose named
parent is in no line is scored against all earlier messages of its session.
Scoring runs over blocks of messages in order of time (range partitions, so a
session with a third of all rows is many tasks); what a block can't see is met by
a join.  The likeliest links form trees, solved by the hierarchy operator, and
turns are numbered by sums along the tree path, with no window or group over a
whole session.  Which conversations are sound is checked last: one with an
inferred link is broken.

Defined cases: unreadable lines, lines without ``uuid`` or session and side
chains are outside the main thread; a uuid counts once (lowest line id); equal
newest timestamps keep the leaf of the lowest line id; a timestamp that can't be
read is older than any other; an empty table gives no conversations.
"""

from __future__ import annotations

from math import log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.records import STATED, Aliases, batch_of, blocks, field, instant, parse, text_of
from sessionloom.operators.hierarchy import hierarchy
from sessionloom.plans.runtime import partitions_for, stage

MESSAGES = pa.schema(
    [
        ("line_id", pa.int64()),
        ("session_id", pa.string()),
        ("uuid", pa.string()),
        ("parent", pa.string()),
        ("ts", pa.int64()),
        ("role", pa.string()),
        ("asks", pa.int32()),
        ("blank", pa.int32()),
        ("words", pa.list_(pa.int32())),
        ("mentions", pa.list_(pa.string())),
    ]
)
MESSAGES_DDL = (
    "line_id bigint, session_id string, uuid string, parent string, ts bigint, role string, asks int, blank int, "
    "words array<int>, mentions array<string>"
)
#: Weights of a candidate link, per feature.  Time counts as the logarithm of the seconds apart,
#: overlap as the third power of the share of words: common words give every pair a small one.
WEIGHTS = {"stated": 100.0, "time": -7.0, "mention": 8.0, "overlap": 8.0, "turn": 0.3}
FAR = log1p(6 * 3600)  #: from six hours on messages count as equally far apart
ASKING, OFFERED = 500, 20_000  #: asking messages and candidates that meet in one task at a time; links don't depend on it
BLOCK = 20_000  #: messages scored in one task; links don't depend on it


def millis(value) -> int:
    """A timestamp written as ISO text or epoch milliseconds; lowest if unreadable."""
    found = instant(value)
    return -(1 << 62) if found is None else found // 1000


def _is(value) -> bool:
    return value is True or (isinstance(value, str) and value.lower() == "true")


def messages(lines: DataFrame, *, id_col="line_id", raw_col="raw", aliases: Aliases = STATED) -> DataFrame:
    """The main thread's lines with word hashes and mentioned ids; ``role`` is null
    for lines that only link.  Each batch keeps one copy of a message."""
    from zlib import crc32

    def run(batches):
        for batch in batches:
            out: dict[tuple, tuple] = {}
            for line_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                record = parse(raw)
                if record is None or _is(record.get("isSidechain")):
                    continue
                uuid, session = text_of(record.get("uuid")), text_of(record.get("sessionId"))
                if uuid is None or session is None:
                    continue
                role = field(record, "type", aliases.record)
                asks = blank = 0
                words: list[int] = []
                mentions: list[str] = []
                if role not in ("user", "assistant") or _is(record.get("isMeta")) or _is(record.get("isApiErrorMessage")):
                    role = None
                message = record.get("message")
                content = message.get("content") if isinstance(message, dict) else None
                parts = blocks(message) if isinstance(message, dict) else []
                if role == "user":
                    kinds = [field(b, "type", aliases.block) for b in parts if isinstance(b, dict)]
                    asks = int("tool_result" not in kinds)
                texts = [content] if isinstance(content, str) else [b["text"] for b in parts if isinstance(b, dict) and isinstance(b.get("text"), str)]
                blank = int(not any(t.strip() for t in texts))
                held = out.get((session, uuid))
                if held is not None and held[0] <= line_id:
                    continue
                words = sorted({crc32(w.encode("utf-8", "replace")) & 0x7FFFFFFF for t in texts for w in t.lower().split()})
                for b in parts:
                    if isinstance(b, dict):
                        mentions += [x for x in (text_of(b.get("id")), text_of(field(b, "tool_use_id", aliases.block))) if x]
                at = text_of(record.get("sourceToolAssistantUUID"))
                mentions += [at] if at else []
                out[session, uuid] = (line_id, session, uuid, text_of(record.get("parentUuid")), millis(record.get("timestamp")), role, asks, blank, words, mentions)
            yield batch_of(MESSAGES, list(out.values()))

    source = lines.select(F.col(id_col).cast("bigint").alias("line_id"), F.col(raw_col).alias("raw"))
    return source.mapInArrow(run, MESSAGES_DDL)


def reduced(copies: DataFrame) -> DataFrame:
    """Each message of a session once, the copy of the lowest line id."""
    rest = [c for c in copies.columns if c not in ("session_id", "uuid")]
    return copies.groupBy("session_id", "uuid").agg(F.min_by(F.struct(*rest), "line_id").alias("m")).select("session_id", "uuid", "m.*")


def _score(named: bool, apart: int, mentioned: bool, mine: set, others: set, turned: bool) -> float:
    """How likely a candidate is the parent; ``apart`` in milliseconds."""
    shared = len(mine & others)
    score = WEIGHTS["time"] * min(1.0, log1p(abs(apart) / 1000.0) / FAR) + WEIGHTS["overlap"] * (shared / max(1, len(mine) + len(others) - shared)) ** 3
    return score + WEIGHTS["stated"] * named + WEIGHTS["mention"] * mentioned + WEIGHTS["turn"] * turned


LINKED = pa.schema(
    [(c, MESSAGES.field(c).type) for c in ("session_id", "uuid", "parent", "line_id", "ts", "role", "asks", "blank")] + [("likely", pa.string()), ("score", pa.float64())]
)
LINKED_DDL = "session_id string, uuid string, parent string, line_id bigint, ts bigint, role string, asks int, blank int, likely string, score double"


def _linked(batches):
    """The likeliest parent of each message of a block, among the candidates in it;
    null where the message names none, or one that is not in the block."""
    some = [b for b in batches if len(b)]
    if not some:
        return
    held = pa.Table.from_batches(some)
    held = held.sort_by([(c, "ascending") for c in ("session_id", "ts", "line_id")]).combine_chunks()
    rows = list(zip(*(held[c].to_pylist() for c in ("session_id", "ts", "line_id", "uuid", "parent", "role", "asks", "blank", "mentions"))))
    bags = held["words"].combine_chunks()
    starts, words = bags.offsets.to_numpy(), bags.values.to_numpy()  # numbers stay packed until a pair is scored
    at = {(r[0], r[3]): i for i, r in enumerate(rows)}
    owner: dict[tuple, int] = {}  # call id -> the first message that has it
    for i, r in enumerate(rows):
        for x in r[8]:
            owner.setdefault((r[0], x), i)

    def bag(i: int) -> set:
        return set(words[starts[i] : starts[i + 1]].tolist())

    out = []
    for i, (session, ts, line_id, uuid, parent, role, asks, blank, mentions) in enumerate(rows):
        best, mine = None, bag(i) if parent is not None else set()
        named = at.get((session, parent)) if parent is not None else None
        if named is not None:
            told = {j for x in mentions for j in (owner.get((session, x)), at.get((session, x))) if j is not None and j < i}
            offered = told | {named} | ({i - 1} if i and rows[i - 1][0] == session else set())
            for j in offered - {i} if named != i else offered:
                r = rows[j]
                score = _score(j == named, ts - r[1], j in told, mine, bag(j), role is not None and r[5] is not None and r[5] != role)
                if best is None or (score, r[1], r[3]) > best:
                    best = (score, r[1], r[3])
        out.append((session, uuid, parent, line_id, ts, role, asks, blank, best[2] if best else None, best[0] if best else None))
    yield batch_of(LINKED, out)


def linked(one: DataFrame) -> DataFrame:
    """Every message with its likeliest parent, its score and whether it had to be
    inferred (``inferred``); ``likely`` is null where it names no parent, or nothing
    comes before it."""
    blocks_ = one.repartitionByRange(partitions_for(one.count(), BLOCK), "session_id", "ts", "line_id")
    seen = stage(blocks_.mapInArrow(_linked, LINKED_DDL), "linked")
    # a named parent in another block: its features come by a join; staged, so that a few of them are sent, many shuffled
    apart = stage(seen.where("parent is not null and likely is null").drop("likely", "score"), "apart")
    side = one.select("session_id", F.col("uuid").alias("parent"), F.col("ts").alias("p_ts"), F.col("role").alias("p_role"), F.col("words").alias("p_words"))
    met = apart.join(side, ["session_id", "parent"]).join(one.select("session_id", "uuid", "words"), ["session_id", "uuid"])
    shared = F.size(F.array_intersect("words", "p_words")) / F.greatest(F.size(F.array_union("words", "p_words")), F.lit(1))
    turned = F.coalesce(F.col("role") != F.col("p_role"), F.lit(False)).cast("double")
    score = F.lit(WEIGHTS["stated"]) + WEIGHTS["time"] * F.least(F.lit(1.0), F.log1p(F.abs(F.col("ts") - F.col("p_ts")) / 1000.0) / FAR) + WEIGHTS["overlap"] * F.pow(shared, 3) + WEIGHTS["turn"] * turned
    met = stage(met.withColumn("likely", F.col("parent")).withColumn("score", score).select(*seen.columns), "met")
    lost = stage(apart.join(met.select("session_id", "uuid"), ["session_id", "uuid"], "left_anti"), "lost")
    inferred = _inferred(one, lost).select("session_id", "uuid", F.col("parent").alias("likely"), "score")
    every = seen.where("parent is null or likely is not null").unionByName(met).withColumn("inferred", F.lit(False))
    return every.unionByName(lost.join(inferred, ["session_id", "uuid"], "left").withColumn("inferred", F.lit(True)))


class _Asking:
    """The messages of one session that ask for a parent, indexed by word and mention."""

    def __init__(self, rows: list) -> None:
        self.keys = [r["uuid"] for r in rows]
        self.ts = np.array([r["ts"] for r in rows], np.int64)
        self.lines = np.array([r["line_id"] for r in rows], np.int64)
        self.roles = np.array([r["role"] or "" for r in rows])
        self.sizes = np.array([len(r["words"]) for r in rows])
        words: dict[int, list[int]] = {}
        ids: dict[str, list[int]] = {}
        own: dict[str, list[int]] = {}
        for i, r in enumerate(rows):
            own.setdefault(r["uuid"], []).append(i)
            for w in r["words"]:
                words.setdefault(w, []).append(i)
            for x in set(r["mentions"]):
                ids.setdefault(x, []).append(i)
        self.words = {w: np.array(at) for w, at in words.items()}
        self.ids, self.own = ids, own
        self.best: list[tuple | None] = [None] * len(rows)
        self.high = np.full(len(rows), -np.inf)

    def offer(self, uuid: str, ts: int, line_id: int, role: str | None, words: list[int], mentions: list[str]) -> None:
        """Score a candidate against all of them; keep it where it is the best."""
        met = [self.words[w] for w in words if w in self.words]
        shared = np.bincount(np.concatenate(met), minlength=len(self.ts)) if met else 0
        score = WEIGHTS["time"] * np.minimum(1.0, np.log1p(np.abs(self.ts - ts) / 1000.0) / FAR) + WEIGHTS["overlap"] * (shared / np.maximum(self.sizes + len(words) - shared, 1)) ** 3
        named = {i for x in {uuid, *mentions} for i in self.ids.get(x, ())}
        if named:
            score[list(named)] += WEIGHTS["mention"]
        if role:
            score += WEIGHTS["turn"] * ((self.roles != role) & (self.roles != ""))
        fit = (score >= self.high) & ((self.ts > ts) | (self.ts == ts) & (self.lines > line_id))
        for i in self.own.get(uuid, ()):
            fit[i] = False
        for i in np.flatnonzero(fit).tolist():
            new = (float(score[i]), ts, uuid)
            if self.best[i] is None or new > self.best[i]:
                self.best[i], self.high[i] = new, new[0]


OFFERS = pa.schema([("session_id", pa.string()), ("uuid", pa.string()), ("parent", pa.string()), ("score", pa.float64()), ("p_ts", pa.int64())])


def _inferred(one: DataFrame, lost: DataFrame) -> DataFrame:
    """(session_id, uuid, parent, score): the likeliest of all earlier messages of
    the session for each of the ``lost`` messages.

    The asking messages of a session and its candidates are cut into parts, and
    each two parts meet in a task that keeps the best offer per asking message.
    Only sessions that ask are shuffled.
    """
    features = one.select("session_id", "uuid", "ts", "line_id", "role", "words", "mentions")
    asking = stage(features.join(lost.select("session_id", "uuid"), ["session_id", "uuid"], "left_semi"), "asking")
    asks = stage(asking.groupBy("session_id").agg(F.ceil(F.count(F.lit(1)) / ASKING).cast("int").alias("chunks")), "asks")
    sized = one.join(asks, "session_id").groupBy("session_id", "chunks").agg(F.ceil(F.count(F.lit(1)) / OFFERED).cast("int").alias("slices"))
    sized = stage(sized, "sized")
    part = lambda n: F.pmod(F.xxhash64("uuid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asking.join(sized, "session_id").withColumn("chunk", part("chunks")).withColumn("slice", every("slices"))
    right = features.join(sized, "session_id").withColumn("slice", part("slices")).withColumn("chunk", every("chunks"))

    def meet(asked: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        columns = ["session_id", "uuid", "parent", "score", "p_ts"]
        if not len(asked):
            return pd.DataFrame([], columns=columns)
        a = _Asking(asked.to_dict("records"))
        for r in offered.itertuples(index=False):
            a.offer(r.uuid, r.ts, r.line_id, r.role, list(r.words), list(r.mentions))
        session = asked["session_id"].iloc[0]
        return pd.DataFrame([(session, a.keys[i], b[2], b[0], b[1]) for i, b in enumerate(a.best) if b is not None], columns=columns)

    by = ["session_id", "chunk", "slice"]
    left = left.select(*[F.col(c).alias(c) for c in left.columns])  # columns of its own: both sides come from one table
    offers = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(meet, "session_id string, uuid string, parent string, score double, p_ts bigint")
    best = offers.groupBy("session_id", "uuid").agg(F.max_by(F.struct("parent", "score"), F.struct("score", "p_ts", "parent")).alias("b"))
    return best.select("session_id", "uuid", "b.parent", "b.score")


def infer_links(copies: DataFrame) -> DataFrame:
    """(session_id, uuid, parent, score) for messages whose named parent is in no line."""
    one = stage(reduced(copies), "links")
    known = one.select("session_id", F.col("uuid").alias("parent"))
    return _inferred(one, one.where("parent is not null").join(known, ["session_id", "parent"], "left_anti"))


MARK = "\u001f"  #: between session and uuid in the ids of the forest


def _forest(links: DataFrame) -> DataFrame:
    """Links as rows of a forest: ids hold the session, so no join is needed to know it."""
    mark = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws(MARK, "session_id", c))
    return links.withColumn("id", mark("uuid")).withColumn("stated", F.col("parent")).withColumn("parent", mark("likely"))


def inferred_trees(lines: DataFrame, *, id_col="line_id", raw_col="raw") -> DataFrame:
    """(session_id, uuid, parent, root, depth) of every message by its likeliest
    link; root null and depth -1 on or below a cycle."""
    one = stage(reduced(messages(lines, id_col=id_col, raw_col=raw_col)), "messages")
    nodes = stage(_forest(linked(one)).select("id", "parent", "session_id", "ts"), "inferred")
    at = lambda c, i: F.split(c, MARK, 2)[i]
    solved = hierarchy(nodes, near=["session_id", "ts"])
    return solved.select(at("id", 0).alias("session_id"), at("id", 1).alias("uuid"), at("parent", 1).alias("parent"), at("root", 1).alias("root"), "depth")


def conversations(lines: DataFrame, *, id_col="line_id", raw_col="raw") -> DataFrame:
    """(session_id, turn_no, uuid, role) of the messages of each kept session."""
    one = stage(reduced(messages(lines, id_col=id_col, raw_col=raw_col)), "messages")
    nodes = _forest(linked(one)).select(
        "id", "parent", "session_id", "ts", "line_id", "role", "asks", "blank", "inferred", F.col("stated").isNull().alias("opens"),
        F.col("role").isNotNull().cast("int").alias("turns"), F.coalesce((F.col("role") == "assistant").cast("int"), F.lit(0)).alias("answers"),
    )
    forest = hierarchy(nodes, near=["session_id", "ts"], weights=("turns", "answers"), carry=("ts", "line_id", "role", "asks", "blank", "inferred", "opens"))
    split = F.split("id", MARK, 2)
    tree = stage(forest.drop("parent").withColumn("session_id", split[0]), "tree")
    # sound: exactly one message names no parent, every named parent is there, no cycle: then every node has that root
    rooted = tree.groupBy("session_id").agg(
        F.sum((F.col("depth") == 0).cast("int")).alias("roots"),
        F.sum(((F.col("depth") == 0) & F.col("opens")).cast("int")).alias("openings"),
        F.sum((F.col("depth") < 0).cast("int")).alias("looped"),
        F.sum(F.col("inferred").cast("int")).alias("inferred"),
        F.max(F.when(F.col("size") == 1, F.struct("ts", -F.col("line_id"), "lft"))).alias("leaf"),
    )
    sound = rooted.where("roots = 1 and openings = 1 and looped = 0 and inferred = 0").select("session_id", F.col("leaf.lft").alias("at"))
    path = tree.join(sound, "session_id").where("lft <= at and at <= rgt and role is not null")
    path = path.select("session_id", split[1].alias("uuid"), "role", "asks", "blank", F.col("above_turns").alias("turn_no"), F.col("above_answers").alias("answers"))
    path = stage(path, "path")
    # two prompts with no answer between them have the same number of answers before them
    prompts = path.where("asks = 1 and role = 'user'").groupBy("session_id", "answers").agg(F.count(F.lit(1)).alias("n"), F.min("blank").alias("blank"))
    asked = prompts.groupBy("session_id").agg(F.max("n").alias("n"), F.min("blank").alias("blank"))
    last = path.groupBy("session_id").agg(F.max_by("role", "turn_no").alias("last"))
    kept = asked.where("n = 1 and blank = 0").join(last.where("last = 'assistant'"), "session_id").select("session_id")
    return path.join(kept, "session_id").select("session_id", F.col("turn_no").cast("int").alias("turn_no"), "uuid", "role")
