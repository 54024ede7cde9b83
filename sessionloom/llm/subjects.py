"""Subject areas of documents by seeded non-negative factorisation.

The text is read once and kept as numbered terms by sentence (words and word
pairs; a term's number is a 63-bit hash, so no vocabulary has to be agreed on
first).  The document-term matrix is factored into document mixtures and
components by alternating multiplicative updates of the Kullback-Leibler
objective.  One component per subject is seeded by and tied to the example texts;
a fixed background component holds the corpus's own term frequencies, so a term
spread over all subjects goes there.  Words that no example has join the component
of the documents they occur in.

Anchored, a term stays in the one component that holds it almost alone.  The
components are then disjoint, so a multiplicative update of a sentence's mixture
settles at once: the weights of its terms by component.  A sentence treats the
subject that has most of its mixture, a text's mixture is the sum over its
sentences, and its subjects are those that at least three of its sentences treat.

Components are tables by term.  A pass over the rows gets the values of its terms
from a broadcast up to ``SENT`` terms, by a join on the term beyond; results are
the same.

Defined cases: null and blank texts have no subject; examples with a null
subject only mark words as general; a sentence with no term of a component
treats nothing; repeated sentences and documents count each time; an empty corpus
gives empty tables; two terms of one number would count as one (of a billion terms
about one pair).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.records import batch_of
from sessionloom.plans.runtime import stage

LEAST_SENTENCES = 3  #: sentences that make a subject of a text
GENERAL = 3  #: subjects whose examples share a word for it to be general
FRAME = 5  #: subjects whose examples share a word for its pairs to be dropped too
LEAST_SEEN = 3  #: sentences a term must be in
SENT = 1_000_000  #: terms up to which their values are sent to the tasks; beyond it rows meet them by a join
SWEEPS, INNER = 8, 6  #: updates of the components; of the mixtures within each
TIE = 0.05  #: weight that keeps components at their seeds
PURE = 0.85  #: share of a term's weight that its subject must have to count
AGREE = 0.33  #: share of a text's other treated sentences, without the term, that agree with it
DOUBT = 20.0  #: occurrences of no subject added to a term that no example has
CLEAR = 0.6  #: share of a sentence's weight that the subject it treats must have

_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_SPLIT = re.compile(r"(?<=[.!?])[\s\"')*_]+|\n+")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")


def sentences(text: str) -> list[str]:
    """Sentences of a text; code in fences is none, lines end sentences."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "```" in text:
        text = _FENCE.sub("\n", text)
    return [s for s in _SPLIT.split(text) if s.strip()]


def terms(sentence: str, frame: set[str]) -> set[str]:
    """Words of three letters or more, and pairs of neighbouring words neither
    of which belongs to the frame of sentences."""
    words = _WORD.findall(sentence.casefold())
    inner = [len(w) > 2 and w not in frame for w in words]
    return {w for w, ok in zip(words, inner) if ok} | {f"{a} {b}" for a, b, x, y in zip(words, words[1:], inner, inner[1:]) if x and y}


def number_of(term: str) -> int:
    """A term's number; the lowest bit tells pairs from words."""
    h = xxhash.xxh3_64_intdigest(term.encode("utf-8", "surrogatepass")) >> 1
    return h & ~1 | (" " in term)


def _read_examples(examples: DataFrame):
    """Terms per subject in the examples, general terms and frame words."""
    homes: dict[str, set] = defaultdict(set)
    rows = examples.select("text", "subject").collect()  # a fixed labelled table
    for text, subject in rows:
        for s in sentences(text or ""):
            for t in terms(s, set()):
                homes[t].add(subject)
    frame = {t for t, h in homes.items() if " " not in t and (None in h or len(h) >= FRAME)}
    general = {t for t, h in homes.items() if None in h or len(h) >= GENERAL}
    seen: dict[str, Counter] = defaultdict(Counter)
    for text, subject in rows:
        if subject is not None:
            for s in sentences(text or ""):
                seen[subject].update(terms(s, frame) - general)
    return seen, general, frame


ROWS = pa.schema([("doc_id", pa.int64()), ("sents", pa.list_(pa.int32())), ("terms", pa.list_(pa.int64()))])


def numbered(documents: DataFrame, general: set[str], frame: set[str], *, id_col="doc_id") -> DataFrame:
    """(row, doc_id, sents, terms) of each text with terms: their numbers and the
    sentence of each, general terms left out."""

    def run(batches):
        words: dict[str, int] = {}  # -2: outside pairs too, -1: general
        pairs: dict[tuple[str, str], int] = {}

        def ids(sentence: str) -> set[int]:
            """Numbers of ``terms(sentence, frame)`` that are not general."""
            row, before = set(), None
            for w in _WORD.findall(sentence.casefold()):
                n = words.get(w)
                if n is None:
                    n = words[w] = -2 if len(w) <= 2 or w in frame else -1 if w in general else number_of(w)
                if n == -2:
                    before = None
                    continue
                row.add(n)
                if before is not None:
                    n = pairs.get((before, w))
                    if n is None:
                        pair = f"{before} {w}"
                        n = pairs[before, w] = -1 if pair in general else number_of(pair)
                    row.add(n)
                before = w
            row.discard(-1)
            return row

        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sents: list[int] = []
                found: list[int] = []
                for i, sentence in enumerate(sentences(text or "")):
                    row = ids(sentence)
                    sents += [i] * len(row)
                    found += row
                if found:
                    out.append((doc, sents, found))
                if len(words) + len(pairs) > 500_000:
                    words.clear()
                    pairs.clear()
            yield batch_of(ROWS, out)

    source = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), "text")
    made = source.mapInArrow(run, "doc_id bigint, sents array<int>, terms array<bigint>")
    return stage(made.withColumn("row", F.monotonically_increasing_id()), "rows")


class _Cells:
    """The terms of some rows that a table knows, with their values: ``row`` (place
    in the batch, ascending), ``sent``, ``term`` and ``values``, all of one length."""

    def __init__(self, docs, row, sent, term, values) -> None:
        self.docs, self.row, self.sent, self.term, self.values = docs, row, sent, term, values


def _arrays(table: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Terms in order, and their values; for tables of a checked size."""
    held = table.select("term", *columns).toArrow()
    ids = held["term"].to_numpy()
    order = np.argsort(ids)
    return ids[order], np.stack([held[c].to_numpy().astype(float) for c in columns], 1)[order]


def _meet(rows: DataFrame, table: DataFrame | tuple, columns: list[str], known: int):
    """Rows, and the function that makes ``_Cells`` of a batch of them, with the
    columns of a table of ``known`` terms."""
    places = lambda lists: np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    flat = lambda batch, name: batch.column(name).flatten().to_numpy()
    if known <= SENT:
        shared = rows.sparkSession.sparkContext.broadcast(table if isinstance(table, tuple) else _arrays(table, columns))

        def cells(batch) -> _Cells:
            ids, values = shared.value
            term = flat(batch, "terms")
            at = np.searchsorted(ids, term)
            at[at == len(ids)] = 0
            hit = ids[at] == term if len(ids) else np.zeros(len(term), bool)
            return _Cells(batch.column("doc_id"), places(batch.column("terms"))[hit], flat(batch, "sents")[hit], term[hit], values[at[hit]] if len(ids) else np.zeros((0, len(columns))))

        return rows.select("doc_id", "sents", "terms"), cells
    each = rows.select("row", "doc_id", F.explode(F.arrays_zip("sents", "terms")).alias("c")).select("row", "doc_id", F.col("c.sents").alias("sent"), F.col("c.terms").alias("term"))
    again = each.join(table.select("term", *columns), "term").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.collect_list(F.struct("sent", "term", *columns)).alias("c"))
    again = again.select("doc_id", F.col("c.sent").alias("sents"), F.col("c.term").alias("terms"), *[F.col(f"c.{c}").alias(c) for c in columns])

    def cells(batch) -> _Cells:
        values = np.stack([flat(batch, c).astype(float) for c in columns], 1)
        return _Cells(batch.column("doc_id"), places(batch.column("terms")), flat(batch, "sents"), flat(batch, "terms"), values)

    return again, cells


def _pieces(batches, cells, each: int = 500):
    """The cells of small slices of the batches, so that values stay few at a time."""
    for batch in batches:
        for i in range(0, len(batch), each):
            yield cells(batch.slice(i, each))


def mixtures(row: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mixture of each row, and the share of each of its terms by component."""
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    lengths = np.diff(np.append(starts, len(row)))
    w = np.full((len(starts), values.shape[1]), 1.0 / values.shape[1])
    for i in range(INNER):
        held = np.repeat(w, lengths, axis=0)
        per = 1.0 / np.maximum(np.einsum("ij,ij->i", held, values), 1e-300)
        if i == INNER - 1:  # only the last shares are asked for
            share = held * values * per[:, None]
            w = np.add.reduceat(share, starts, axis=0)
        else:
            w = w * np.add.reduceat(values * per[:, None], starts, axis=0)
        w /= np.maximum(w.sum(1, keepdims=True), 1e-300)
    return w, share


class Model:
    """Subjects, the rows they were fitted on and the anchored components: a table
    (term, component, weight)."""

    def __init__(self, subjects: list[str], rows: DataFrame, anchored: DataFrame) -> None:
        self.subjects, self.rows, self.anchored = subjects, rows, anchored


def _state(rows: DataFrame, seen: dict[str, Counter], subjects: list[str]) -> DataFrame:
    """Terms with their background share, seeds and doubt."""
    spark = rows.sparkSession

    def count(batches):
        for batch in batches:
            term, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), pa.array(n, pa.int64())], names=["term", "n"])

    counted = rows.select("terms").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    seeds: dict[int, list[float]] = {}
    for k, s in enumerate(subjects):
        for t, n in seen[s].items():
            others = sum(seen[o][t] for o in subjects if o != s)
            seeds.setdefault(number_of(t), [0.0] * len(subjects))[k] = n * (n / (n + others)) ** 2
    whole = [sum(v[k] for v in seeds.values()) or 1.0 for k in range(len(subjects))]
    ddl = "term bigint, " + ", ".join(f"s{k} double" for k in range(len(subjects)))
    seeded = spark.createDataFrame([(t, *(x / w for x, w in zip(v, whole))) for t, v in seeds.items()], ddl)  # a fixed labelled table's terms
    every = counted.where(F.col("n") >= LEAST_SEEN).join(seeded.withColumn("seeded", F.lit(True)), "term", "full")
    every = every.withColumn("n", F.coalesce("n", F.lit(1))).withColumn("seeded", F.coalesce("seeded", F.lit(False)))
    every = stage(every.fillna(0.0, [f"s{k}" for k in range(len(subjects))]), "terms")
    total = every.agg(F.sum("n").alias("n")).first()["n"] or 1
    return every.select("term", "seeded", *[f"s{k}" for k in range(len(subjects))], (F.col("n") / total).alias("b"))


def fit(documents: DataFrame, examples: DataFrame, sweeps: int = SWEEPS, *, id_col="doc_id") -> Model:
    """Components of the whole corpus, seeded by the examples, and anchored."""
    seen, general, frame = _read_examples(examples)
    subjects = sorted(seen)
    rows = numbered(documents, general, frame, id_col=id_col)
    state = _state(rows, seen, subjects)
    size = len(subjects)
    h, x = [f"h{k}" for k in range(size + 1)], [f"x{k}" for k in range(size + 1)]
    start = [(0.8 * F.col(f"s{k}") + 0.2 * F.col("b")).alias(h[k]) for k in range(size)]
    parts = state.select("term", *start, F.col("b").alias(h[size]))
    summed, known = None, state.count()
    near = known <= SENT  # then the components stay with the driver between sweeps
    if near:
        parts = _arrays(parts, h)
        ids, seeds = _arrays(state, [f"s{k}" for k in range(size)])
    for _ in range(sweeps):
        source, cells = _meet(rows, parts, h, known)

        def update(batches, cells=cells):
            for c in _pieces(batches, cells):
                if not len(c.row):
                    continue
                _, share = mixtures(c.row, c.values)
                term, back = np.unique(c.term, return_inverse=True)
                sums = [np.bincount(back, share[:, k], minlength=len(term)) for k in range(size + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(term, pa.int64()), *[pa.array(a) for a in sums]], names=["term", *x])

        partial = source.mapInArrow(update, "term bigint, " + ", ".join(f"{c} double" for c in x))
        summed = partial.groupBy("term").agg(*[F.sum(c).alias(c) for c in x])
        if near:
            summed = _arrays(summed, x)
            fresh = np.zeros(parts[1].shape)
            fresh[np.searchsorted(ids, summed[0])] = summed[1]
            fresh /= np.maximum(fresh.sum(0), 1e-300)
            fresh = np.hstack([(1 - TIE) * fresh[:, :size] + TIE * seeds, parts[1][:, size:]])
            parts = (ids, fresh)
        else:
            summed = stage(summed, "sweep")
            whole = summed.agg(*[F.sum(c).alias(c) for c in x]).first()
            share = [(1 - TIE) * F.coalesce(F.col(x[k]), F.lit(0.0)) / max(whole[x[k]] or 0.0, 1e-300) + TIE * F.col(f"s{k}") for k in range(size)]
            parts = state.join(summed, "term", "left").select("term", *[c.alias(h[k]) for k, c in enumerate(share)], F.col("b").alias(h[size]))
    if near:
        table = pa.table({"term": pa.array(summed[0], pa.int64()), **{c: pa.array(summed[1][:, k]) for k, c in enumerate(x)}})
        summed = rows.sparkSession.createDataFrame(table)
    return Model(subjects, rows, _anchored(rows, state, summed, x))


def _anchored(rows: DataFrame, state: DataFrame, summed: DataFrame, x: list[str]) -> DataFrame:
    """(term, component, weight) of the terms that one component holds almost alone
    and that the rest of their texts agree with."""
    size = len(x) - 1
    most, total = F.greatest(*x[:-1]) if size > 1 else F.col(x[0]), sum((F.col(c) for c in x[1:]), F.col(x[0]))
    doubt = F.when(F.col("seeded"), 1.0).otherwise(DOUBT)
    sure = (most > 0) & (most / total >= PURE) & (most / (total + doubt) >= 0.5)
    pair = F.when(F.col("term").bitwiseAND(1) == 1, 2.0).otherwise(1.0)
    component = F.array_position(F.array(*x[:-1]), most) - 1
    pure = state.join(summed, "term").where(sure).select("term", component.cast("int").alias("component"), (most / total * pair).alias("weight"))
    pure = stage(pure, "pure")
    agreed = _agreement(rows, pure, size)
    kept = pure.join(agreed, "term", "left").where(F.coalesce("agree", F.lit(1.0)) >= AGREE)
    return stage(kept.select("term", "component", "weight"), "anchored")


def _told(c: _Cells, size: int):
    """Per sentence its row, its mixture over the anchored components and the
    subject it treats (-1: none); and the sentence of each cell."""
    key, back = np.unique(c.row.astype(np.int64) << 32 | c.sent, return_inverse=True)
    mixture = np.bincount(back * size + c.values[:, 0].astype(np.int64), c.values[:, 1], minlength=len(key) * size).reshape(len(key), size)
    mixture /= np.maximum(mixture.sum(1, keepdims=True), 1e-300)
    told = mixture.argmax(1)
    told[mixture[np.arange(len(key)), told] < CLEAR - 1e-12] = -1
    return key >> 32, mixture, told, back


def _agreement(rows: DataFrame, pure: DataFrame, size: int) -> DataFrame:
    """(term, agree): per term, the mean share of a text's other sentences that agree.

    Terms of phrases that go with any subject (an example happened to hold
    them) stand beside sentences of every subject and get a low share.  Only
    sentences that treat a subject and do not have the term count as others.  Ten
    texts that half agree are added, so that rare terms are not judged by a few.
    """
    source, cells = _meet(rows, pure, ["component", "weight"], pure.count())

    def run(batches):
        for c in _pieces(batches, cells):
            if not len(c.row):
                continue
            row, _, told, back = _told(c, size)
            n = int(c.row.max()) + 1
            clear = told >= 0
            every = np.bincount(row[clear] * size + told[clear], minlength=n * size).reshape(n, size)
            kind = told[back]
            some = kind >= 0
            r, t, k, own = c.row[some], c.term[some], kind[some], c.values[some, 0].astype(np.int64)
            number, place = np.unique(t, return_inverse=True)
            pair, first, inner = np.unique(r * len(number) + place, return_index=True, return_inverse=True)
            held = np.bincount(inner, minlength=len(pair))
            same = np.bincount(inner, (k == own).astype(float), minlength=len(pair))
            r, own = r[first], own[first]
            rest = every.sum(1)[r] - held
            ok = rest > 0
            share = (every[r, own] - same)[ok] / rest[ok]
            place = place[first][ok]
            yield pa.RecordBatch.from_arrays(
                [pa.array(number), pa.array(np.bincount(place, minlength=len(number)), pa.int64()), pa.array(np.bincount(place, share, minlength=len(number)))], names=["term", "n", "x"]
            )

    summed = source.mapInArrow(run, "term bigint, n bigint, x double").groupBy("term").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    return summed.select("term", ((F.col("x") + 5.0) / (F.col("n") + 10.0)).alias("agree"))


MIXED = pa.schema([("doc_id", pa.int64()), ("subject", pa.string()), ("sentences", pa.int32()), ("weight", pa.float64())])


def mixed(model: Model) -> DataFrame:
    """(doc_id, subject, sentences, weight): per text of the fitted corpus its
    mixture of subjects and the number of sentences that treat each."""
    source, cells = _meet(model.rows, model.anchored, ["component", "weight"], model.anchored.count())
    subjects, size = model.subjects, len(model.subjects)

    def run(batches):
        for c in _pieces(batches, cells):
            out = []
            if len(c.row):
                row, mixture, told, _ = _told(c, size)
                n = len(c.docs)
                clear = told >= 0
                count = np.bincount(row[clear] * size + told[clear], minlength=n * size).reshape(n, size)
                weight = np.stack([np.bincount(row, mixture[:, k], minlength=n) for k in range(size)], 1)
                weight /= np.maximum(weight.sum(1, keepdims=True), 1e-300)
                docs = c.docs.to_pylist()
                for i, k in zip(*np.nonzero(weight)):
                    out.append((docs[i], subjects[k], int(count[i, k]), float(weight[i, k])))
            yield batch_of(MIXED, out)

    return source.mapInArrow(run, "doc_id bigint, subject string, sentences int, weight double")


def found(documents: DataFrame, examples: DataFrame) -> DataFrame:
    """(doc_id, subject) of the subjects that three sentences or more treat."""
    counted = mixed(fit(documents, examples))
    return counted.where(F.col("sentences") >= LEAST_SENTENCES).select("doc_id", "subject")


def shares(documents: DataFrame, examples: DataFrame) -> DataFrame:
    """(subject, documents, share, sentence_share) over the corpus."""
    counted = mixed(fit(documents, examples)).where("sentences > 0")
    total = documents.agg(F.count(F.lit(1)).alias("all"))
    by = counted.groupBy("subject").agg(
        F.sum((F.col("sentences") >= LEAST_SENTENCES).cast("int")).alias("documents"), F.sum("sentences").alias("n")
    )
    by = stage(by, "subjects")  # a row per subject
    one = by.join(F.broadcast(total)).join(F.broadcast(by.agg(F.sum("n").alias("said"))))  # two single rows
    return one.select("subject", "documents", (F.col("documents") / F.col("all")).alias("share"), (F.col("n") / F.col("said")).alias("sentence_share"))
