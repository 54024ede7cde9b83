"""Skip-chain conditional random field over candidate mentions of one document.

Nodes are candidate mentions with a binary label (entity or not).  A node's own
potential is a weighted sum of features; neighbouring mentions on one line share
a chain edge and mentions with the same key (a surname, a run of digits) share a
skip edge, however far apart, whose potential rewards equal labels; the first
mentions of two keys that are alike (one character apart, marks aside) share a
weaker one.  Loopy sum-product message passing gives each node's marginal.

Each two equal mentions are joined, however many there are.  In a large group
mentions in the same state (own potential, chain neighbours) send the same
messages, so these are kept once for each pair of states.
"""

from __future__ import annotations

import unicodedata
from math import exp, log

import numpy as np

SWEEPS = 60  #: rounds of message passing at most; it stops when messages settle, and damps those that swing from the tenth on
STAR = 6  #: with more equal mentions than this, a hub stands for the edges between all; labels don't depend on it


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + exp(-x)) if x > -30 else exp(x)


class _Group:
    """Messages between each two of a hub's members, by their states."""

    def __init__(self, members: list[int], weight: float, state: list[int]) -> None:
        self.members, self.weight = members, weight
        place: dict[int, int] = {}
        self.row = [place.setdefault(state[m], len(place)) for m in members]
        self.first = [members[self.row.index(r)] for r in range(len(place))]
        self.count = np.bincount(self.row).astype(float)
        self.sent = np.zeros((len(place), len(place)))
        self.heard = [0.0] * len(place)

    def step(self, belief: list[float], keep: float = 0.0) -> float:
        """One sweep that keeps a part of the old messages; the largest change of one."""
        h = np.clip(np.array([belief[m] for m in self.first])[:, None] - self.sent.T, -30, 30)
        fresh = np.log((np.exp(h + self.weight) + 1.0) / (np.exp(h) + exp(self.weight)))
        alone = np.flatnonzero(self.count == 1)
        fresh[alone, alone] = 0.0  # a mention tells itself nothing
        fresh = keep * self.sent + (1 - keep) * fresh
        moved = float(np.abs(fresh - self.sent).max())
        self.sent, self.heard = fresh, (self.count @ fresh - fresh.diagonal()).tolist()
        return moved


def _states(unary: list[float], edges: list[tuple[int, int, float]], hub: list[int]) -> list[int]:
    """Nodes with equal numbers get equal messages in every sweep."""
    near: dict[int, list[tuple[float, int]]] = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((w, b))
        near.setdefault(b, []).append((w, a))
    known: dict = {}
    state = [known.setdefault(x, len(known)) for x in zip(unary, hub)]
    classes = len(known)
    for _ in range(SWEEPS):
        known = {}
        state = [known.setdefault((s, tuple(sorted((w, state[m]) for w, m in near.get(n, ())))), len(known)) for n, s in enumerate(state)]
        if len(known) == classes:  # no class was split, so none will be
            break
        classes = len(known)
    return state


def marginals(unary: list[float], edges: list[tuple[int, int, float]], mentions: int | None = None) -> list[float]:
    """P(entity) per node; ``unary`` in log-odds, edges with agreement weights.

    Nodes from ``mentions`` on are hubs: their edges stand for edges between
    each two of their members, and they get no marginal.
    """
    groups: list[_Group] = []
    if mentions is not None and mentions < len(unary):
        members: dict[int, list[int]] = {}
        weight: dict[int, float] = {}
        for a, b, w in edges:
            if b >= mentions:
                members.setdefault(b, []).append(a)
                weight[b] = w
        unary, edges = unary[:mentions], [e for e in edges if e[1] < mentions]
        hub = [-1] * mentions
        for b, group in members.items():
            for m in group:
                hub[m] = b
        state = _states(unary, edges, hub)
        groups = [_Group(group, weight[b], state) for b, group in members.items()]
    if not edges and not groups:
        return [_sigmoid(u) for u in unary]
    near: list[list[int]] = [[] for _ in unary]
    ends = []
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            near[y].append(len(ends))
            ends.append((x, y, w))
    reverse = [i ^ 1 for i in range(len(ends))]
    message = [0.0] * len(ends)  # log-odds that the source tells the target

    def beliefs() -> list[float]:
        found = [u + sum(message[i] for i in near[n]) for n, u in enumerate(unary)]
        for g in groups:
            for m, r in zip(g.members, g.row):
                found[m] += g.heard[r]
        return found

    for sweep in range(SWEEPS):
        keep = 0.5 if sweep >= 10 else 0.0
        belief = beliefs()
        moved = max((g.step(belief, keep) for g in groups), default=0.0)
        fresh = []
        for i, (x, _, w) in enumerate(ends):
            h = belief[x] - message[reverse[i]]
            h = max(-30.0, min(30.0, h))
            new = keep * message[i] + (1 - keep) * log((exp(h + w) + 1.0) / (exp(h) + exp(w)))
            moved = max(moved, abs(new - message[i]))
            fresh.append(new)
        message = fresh
        if moved < 1e-3:
            break
    return [_sigmoid(b) for b in beliefs()]


def skip_edges(keys: list[str | None], weight: float, unary: list[float]) -> list[tuple[int, int, float]]:
    """Edges between nodes of equal key; large groups get a hub node, appended to
    ``unary``, that stands for them, so edges stay linear in the nodes."""
    groups: dict[str, list[int]] = {}
    for i, k in enumerate(keys):
        if k is not None:
            groups.setdefault(k, []).append(i)
    edges = []
    for members in groups.values():
        if len(members) > STAR:
            unary.append(0.0)
            edges += [(i, len(unary) - 1, weight) for i in members]
        else:
            edges += [(a, b, weight) for n, a in enumerate(members) for b in members[n + 1 :]]
    return edges


def _bare(key: str) -> str:
    """A key without marks on its letters."""
    return "".join(c for c in unicodedata.normalize("NFKD", key) if not unicodedata.combining(c)).replace("ß", "ss")


def similar_edges(keys: list[str | None], weight: float) -> list[tuple[int, int, float]]:
    """Edges between the first mentions of keys that are alike: equal without marks,
    or with one character left out of either (six characters or more).

    Keys meet by what is left of them, so no two keys are compared one by one; a
    chain joins the keys that meet, in the order of their mentions.
    """
    first: dict[str, int] = {}
    for i, k in enumerate(keys):
        if k is not None:
            first.setdefault(k, i)
    met: dict[str, list[int]] = {}
    for k, i in first.items():
        bare = _bare(k)
        forms = {bare} | ({bare[:j] + bare[j + 1 :] for j in range(len(bare))} if 6 <= len(bare) <= 64 else set())
        for f in forms:
            met.setdefault(f, []).append(i)
    pairs = {(a, b) for group in met.values() for a, b in zip(group, group[1:])}
    return [(a, b, weight) for a, b in sorted(pairs)]
