"""Evaluation texts leaking into training text, by q-gram lemma filtering.

Held-out questions are few and fixed; their size is checked before they are
broadcast.  Documents stream through once:

1. both sides are brought to one writing (compatibility forms, case, marks,
   punctuation, line breaks and markup fall away) and become words;
2. shared character q-grams are looked up and counted per item in overlapping
   diagonal bands of (document word - question word) in which they begin: a word
   that stands for another moves no later one, however long it is;
3. regions are kept when the count reaches the q-gram lemma's bound for the
   least region that can be a leak: fifteen words of which at most two are other
   words (every longer leak contains one, see ``least_shared``);
4. kept regions are verified by alignment of words within the band: at least
   fifteen words of the question, with at most one in eight other, missing or
   put between.

Defined cases: null and blank texts and questions give no rows; questions of
fewer than fifteen words (after their instruction) can't leak; an opening
instruction is a first sentence that at least ``SHARED`` items have; repeated
documents give a row each; the same item twice in a document gives one row.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.functions.records import batch_of

Q = 8  #: characters per q-gram
LEAST = 15  #: words in a row that make a leak
ONE_IN = 8  #: of so many words one may be another
BAND = 16  #: diagonals (words) in a band; bands overlap by half
MARGIN = 4 * LEAST  #: words around a region that verification looks at
SHARED = 3  #: items that share a first sentence for it to be an instruction
MAX_ITEMS = 100_000  #: items that are broadcast

_MARKUP = re.compile(r"<[^<>\n]{1,80}>|&[a-z]{2,8};|&#\d+;|\[([^\]\n]*)\]\([^)\n]*\)")
_WORDS = re.compile(r"[^\W_]+", re.U)
_HYPHENATED = re.compile(r"(?<=\w)[-­‐‑]\s*\n\s*(?=\w)")
_INNER = re.compile(r"(?<=\w)['’](?=\w)|[*_`~](?=\w)|(?<=\w)[*_`~]")
_UNSEEN = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
#: Letters of other scripts that look like Latin ones.
_LOOKALIKES = str.maketrans("аеорсухіјѕԁԛԝвкмнтгαεορυικντχ", "aeopcyxijsdqwbkmhtraeopuikvtx")


def words_of(text: str) -> list[str]:
    """The words of a text in one writing."""
    text = _HYPHENATED.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_UNSEEN)
    text = _MARKUP.sub(lambda m: " " + (m[1] or "") + " ", text)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        text = text.casefold()
        if re.search(r"[a-z]", text):
            text = text.translate(_LOOKALIKES)
    if any(c in text for c in "'’*_`~"):
        text = _INNER.sub("", text)
    return _WORDS.findall(text.casefold())


def instructions(questions: list[str]) -> set[str]:
    """First sentences that several items share."""
    firsts = Counter(q.strip().partition(".")[0].strip() for q in questions if q and "." in q.strip()[:-1])
    return {s for s, n in firsts.items() if n >= SHARED}


def strip_instruction(question: str, shared: set[str]) -> str:
    """The question without the shared sentences it opens with."""
    rest = question.strip()
    while True:
        first, dot, more = rest.partition(".")
        if not dot or first.strip() not in shared or not more.strip():
            return rest
        rest = more.strip()


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Rolling 64-bit hashes of all q-grams of an array of code points."""
    if len(codes) < Q:
        return np.zeros(0, np.uint64)
    n = len(codes) - Q + 1
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(Q):
            h = h * np.uint64(1_000_003) + codes[k : k + n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def _word_of(words: list[str], at: np.ndarray) -> np.ndarray:
    """The word in which each position of the joined words lies."""
    return np.searchsorted(np.cumsum([len(w) + 1 for w in words]), at, side="right")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def least_shared(words: list[str]) -> int:
    """Lemma bound: q-grams that any leaking region of the item still shares.

    A window of n >= 15 words with at most n/8 others has a 15-word part with
    at most two others; a word of length l in the part's text breaks at most
    l + Q - 1 q-grams.
    """
    lengths = [len(w) for w in words]
    least = None
    for i in range(len(words) - LEAST + 1):
        part = sorted(lengths[i : i + LEAST], reverse=True)
        shared = sum(part) + LEAST - 1 - (Q - 1) - sum(x + Q - 1 for x in part[: 1 + LEAST // ONE_IN])
        least = shared if least is None else min(least, shared)
    return max(1, least or 1)


class Items:
    """The questions as words, a q-gram table and lemma bounds."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        shared = instructions([q for _, q in rows if q])
        self.ids, self.words = [], []
        for item, question in rows:
            words = words_of(strip_instruction(question, shared)) if question else []
            if len(words) >= LEAST:
                self.ids.append(item)
                self.words.append(words)
        grams, owner, place = [], [], []
        for i, words in enumerate(self.words):
            h = _hashes(_codes(" ".join(words)))
            grams.append(h)
            owner.append(np.full(len(h), i, np.int64))
            place.append(_word_of(words, np.arange(len(h))))
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.owner = np.concatenate(owner)[order] if grams else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if grams else np.zeros(0, np.int64)
        self.grams, self.start, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.grams & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.bound = np.array([least_shared(w) for w in self.words], np.int64)
        vocabulary = sorted({w for words in self.words for w in words})
        self.number = {w: i for i, w in enumerate(vocabulary)}
        self.numbers = [np.array([self.number[w] for w in words], np.int32) for words in self.words]

    def regions(self, words: list[str]) -> dict[int, list[tuple[int, int, int]]]:
        """item -> (first word, last word, least diagonal) of the bands that meet the bound."""
        h = _hashes(_codes(" ".join(words)))
        at = np.flatnonzero(self.seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(at):
            return {}
        row = np.searchsorted(self.grams, h[at])
        row[row == len(self.grams)] = 0
        good = self.grams[row] == h[at]
        at, row = at[good], row[good]
        if not len(at):
            return {}
        n = self.count[row]
        pick = np.repeat(self.start[row], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        owner = self.owner[pick]
        # an item that misses the bound over the whole text misses it in each band
        enough = (np.bincount(owner, minlength=len(self.bound)) >= self.bound)[owner]
        if not enough.any():
            return {}
        owner, word = owner[enough], _word_of(words, np.repeat(at, n)[enough])
        diagonal = word - self.place[pick][enough] + (1 << 20)
        out: dict[int, list[tuple[int, int, int]]] = {}
        for shift in (0, BAND // 2):  # two layouts of bands, so that every drift up to half a band lies in one
            key = owner << np.int64(40) | (diagonal + shift) // BAND
            keys, back, total = np.unique(key, return_inverse=True, return_counts=True)
            kept = np.flatnonzero(total >= self.bound[(keys >> np.int64(40))])
            if not len(kept):
                continue
            low = np.full(len(keys), 1 << 40)
            high = np.zeros(len(keys), np.int64)
            np.minimum.at(low, back, word)
            np.maximum.at(high, back, word)
            for k in kept.tolist():
                band = int(keys[k] & ((1 << 40) - 1)) * BAND - shift - (1 << 20)
                out.setdefault(int(keys[k] >> 40), []).append((int(low[k]), int(high[k]), band))
        return out

    def aligned(self, item: int, words: np.ndarray, least: int) -> bool:
        """Whether an alignment on the diagonals from ``least`` through the band holds
        a leak.  An equal word counts 1, another in its place 1 - ONE_IN, one that is
        missing or put between -ONE_IN; a leak is an alignment of LEAST places or
        more, missing ones aside, whose sum is not negative.

        ``best[d, l]``: the highest sum of an alignment that ends on diagonal d after
        l places (LEAST stands for more).
        """
        question, none = self.numbers[item], -(1 << 30)
        n, width = len(question), BAND + 1
        best = np.full((width, LEAST + 1), none, np.int64)
        for j in range(max(0, -least - width), len(words)):
            places = j - least - np.arange(width)  # question words that meet word j
            inside = (places >= 0) & (places < n)
            if not inside.any():
                if places.max() < 0:
                    continue
                if places.min() >= n:
                    break
            equal = inside & (question[np.clip(places, 0, n - 1)] == words[j])
            step = np.where(equal, 1, 1 - ONE_IN)[:, None]
            from_here = np.where(inside[:, None], np.maximum(best, np.where(np.arange(LEAST + 1) == 0, 0, none)) + step, none)
            fresh = np.full_like(best, none)
            fresh[:, 1:] = from_here[:, :-1]
            fresh[:, LEAST] = np.maximum(fresh[:, LEAST], from_here[:, LEAST])
            fresh[1:] = np.maximum(fresh[1:], best[:-1] - ONE_IN)  # a word put between: one diagonal on
            for d in range(width - 2, -1, -1):  # a missing word: one diagonal back
                if 0 <= places[d] < n:
                    fresh[d] = np.maximum(fresh[d], fresh[d + 1] - ONE_IN)
            best = fresh
            if best[:, LEAST].max() >= 0:
                return True
        return False

    def verify(self, item: int, words: np.ndarray) -> bool:
        """Whether the words hold a leaking window of the item.

        On each diagonal an equal word counts 1 and another one 1 - ONE_IN, so a
        window is within the budget exactly when its sum is not negative.
        """
        question = self.numbers[item]
        n, m = len(question), len(words)
        if m < LEAST:
            return False
        padded = np.full(m + 2 * n, -2, np.int32)
        padded[n : n + m] = words
        # row d: the document words against the question at offset d - n
        windows = np.lib.stride_tricks.sliding_window_view(padded, n)
        value = np.where(windows == question, 1, 1 - ONE_IN)
        value[windows == -2] = -ONE_IN * n
        few = np.flatnonzero((value == 1).sum(1) >= LEAST - LEAST // ONE_IN)
        if not len(few):
            return False
        sums = np.zeros((len(few), n + 1), np.int64)
        np.cumsum(value[few], axis=1, out=sums[:, 1:])
        lowest = np.minimum.accumulate(sums, axis=1)
        return bool((sums[:, LEAST:] >= lowest[:, : n + 1 - LEAST]).any())

    def leaks(self, text: str) -> list[int]:
        """Ids of the items that a document's text leaks."""
        words = words_of(text)
        if len(words) < LEAST:
            return []
        found = []
        regions = self.regions(words)
        if not regions:
            return []
        numbers = np.array([self.number.get(w, -1) for w in words], np.int32)
        for item, spans in regions.items():
            for low, high, band in sorted(set(spans)):
                a = max(0, low - MARGIN)
                part = numbers[a : high + MARGIN]
                if self.verify(item, part) or self.aligned(item, part, band - a):
                    found.append(self.ids[item])
                    break
        return sorted(found)


FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64())])


def leaks(documents: DataFrame, items: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", question_col="question") -> DataFrame:
    """(doc_id, item_id) of every document that leaks an item."""
    rows = items.select(F.col(item_col).cast("bigint"), question_col).limit(MAX_ITEMS + 1).collect()
    if len(rows) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} items; run the search in blocks of items")
    held = documents.sparkSession.sparkContext.broadcast(Items(sorted((r[0], r[1]) for r in rows if r[0] is not None and r[1])))

    def run(batches):
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    out += [(doc, item) for item in held.value.leaks(text)]
            yield batch_of(FOUND, out)

    source = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id bigint, item_id bigint")
