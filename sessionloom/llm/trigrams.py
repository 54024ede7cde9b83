"""Trigram index over texts, and what a regex requires of a text.

The plan of a regex is a formula over lower-case ASCII trigrams that every
match must satisfy: ("and", [..]), ("or", [..]), a trigram, ("run", class, n) or
None for "any text".  It is derived from the parsed pattern: runs of literals and
small classes require their trigrams, alternatives require one branch, optional
parts nothing.  A long repetition of a class holds no certain trigram, but so many
characters of the class in a row, which are the same trigrams over a coarser
alphabet: these have postings of their own.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

import numpy as np


FEW, MANY = 8, 64  #: members of a class, and texts of a run, up to which they are spelt out
LONG = 12  #: repetitions of a class from which they are indexed as a run


def _members(arg) -> list[str] | None:
    """The ASCII characters of a class; None for others and for negated ones."""
    out: list[str] = []
    for op, value in arg:
        if op is C.LITERAL and value < 128:
            out.append(chr(value))
        elif op is C.RANGE and value[1] < 128:
            out += [chr(x) for x in range(value[0], value[1] + 1)]
        else:
            return None
    return out


def _join(op: str, parts: list):
    if op == "or":
        if not parts or any(p is None for p in parts):
            return None
    else:
        parts = [p for p in parts if p is not None]
        if not parts:
            return None
    flat = []
    for p in parts:
        if isinstance(p, tuple) and p[0] == op:
            flat += p[1]
        elif p not in flat:
            flat.append(p)
    return flat[0] if len(flat) == 1 else (op, flat)


def _grams(run: str) -> list[str]:
    run = run.lower()
    return [run[i : i + 3] for i in range(len(run) - 2)] if run.isascii() else []


def _need(seq) -> tuple[object, list[str] | None]:
    """Formula of a parsed sequence, and its exact texts when few are possible."""
    parts, runs = [], [""]

    def close():
        options = [_join("and", _grams(r)) for r in runs]
        parts.append(_join("or", options) if len(options) > 1 else options[0])

    for op, arg in seq:
        texts = None
        inner = None
        if op is C.LITERAL:
            texts = [chr(arg)]
        elif op is C.IN:
            items = _members(arg)
            if items is not None and len({x.lower() for x in items}) <= FEW:
                texts = sorted({x.lower() for x in items})
        elif op is C.SUBPATTERN:
            inner, texts = _need(arg[3])
        elif op is C.BRANCH:
            branches = [_need(b) for b in arg[1]]
            inner = _join("or", [b[0] for b in branches])
            if all(b[1] is not None for b in branches):
                texts = [t for b in branches for t in b[1]]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, what = arg
            got, exact = _need(what)
            one = _members(what[0][1]) if len(what) == 1 and what[0][0] is C.IN else None
            if low >= LONG and one is not None:
                inner = ("run", "".join(sorted({y for x in one for y in (x.lower(), x.upper()) if y.isascii()})), low)
            elif low >= 1:
                inner = got
                if low == high == 1:
                    texts = exact
            elif (low, high) == (0, 1) and exact is not None:
                texts = ["", *exact]
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue
        if texts is not None and len(texts) * len(runs) <= MANY:
            runs = list(dict.fromkeys(a + t.lower() for a in runs for t in texts))
        else:
            close()
            runs = [""]
            if inner is not None:
                parts.append(inner)
    whole = runs if not parts and len(runs) <= MANY else None
    close()
    return _join("and", parts), whole


def required(pattern: str, flags: int = 0):
    """Formula of trigrams that every match of the pattern holds."""
    return _need(_parser.parse(pattern, flags))[0]


def grams_of(formula) -> set[str]:
    if formula is None:
        return set()
    if isinstance(formula, str):
        return {formula}
    if formula[0] == "run":
        return set()
    return set().union(*(grams_of(p) for p in formula[1]))


class Index:
    """Postings of the needed trigrams over a list of chunks.

    Chunks are joined into one byte array and every position's trigram is
    looked up at once; a posting is a column of a chunk-by-trigram bit matrix.
    """

    _tables: dict[tuple, np.ndarray] = {}

    def __init__(self, chunks: list[str], grams: list[str]) -> None:
        self.column = {g: i for i, g in enumerate(grams)}
        key = tuple(grams)
        table = Index._tables.get(key)
        if table is None:
            table = np.zeros(1 << 24, np.uint16)
            for g, i in self.column.items():
                a, b, c = g.encode()
                table[a << 16 | b << 8 | c] = i + 1
            Index._tables[key] = table
        self.bits = np.zeros((len(chunks), len(grams)), bool)
        data = [c.encode("utf-8", "replace") for c in chunks]
        # zero bytes between chunks keep trigrams from spanning two
        joined = np.frombuffer(b"\0\0".join(data), np.uint8)
        ends = np.cumsum([len(d) + 2 for d in data])
        self.joined, self.ends, self.runs = joined, ends, {}
        if len(joined) < 3:
            return
        low = joined + (((joined >= 65) & (joined <= 90)).astype(np.uint8) << 5)
        code = low[:-2].astype(np.int32)
        code <<= 8
        code |= low[1:-1]
        code <<= 8
        code |= low[2:]
        which = table[code]
        at = np.flatnonzero(which)
        self.bits[np.searchsorted(ends, at, side="right"), which[at] - 1] = True

    def run(self, members: str, least: int) -> np.ndarray:
        """Chunks with so many characters of a class in a row."""
        gaps = self.runs.get(members)
        if gaps is None:
            inside = np.zeros(256, bool)
            inside[np.frombuffer(members.encode(), np.uint8)] = True
            others = np.flatnonzero(~inside[self.joined])
            edges = np.concatenate([[-1], others, [len(self.joined)]])
            gaps = self.runs[members] = (edges[:-1] + 1, np.diff(edges) - 1)
        found = np.zeros(len(self.bits), bool)
        found[np.searchsorted(self.ends, gaps[0][gaps[1] >= least], side="right")] = True
        return found

    def candidates(self, formula) -> np.ndarray:
        """Chunks whose postings satisfy the formula, as a boolean column."""
        if formula is None:
            return np.ones(len(self.bits), bool)
        if isinstance(formula, str):
            return self.bits[:, self.column[formula]]
        if formula[0] == "run":
            return self.run(*formula[1:])
        found = self.candidates(formula[1][0])
        for part in formula[1][1:]:
            more = self.candidates(part)
            found = found & more if formula[0] == "and" else found | more
        return found


def compiled(patterns: list[tuple[str, str]]):
    """[(kind, regex, formula)] and the sorted list of all their trigrams."""
    plans = [(kind, re.compile(p), required(p)) for kind, p in patterns]
    return plans, sorted(set().union(*(grams_of(f) for _, _, f in plans)))
