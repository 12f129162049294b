"""What tracked boxes look like: galleries of vectors, proposals of tracks, and crossings."""

from __future__ import annotations

import itertools
from collections import deque

import numpy as np

#: Weight of what a track looked like so far, in its smoothed vector.
SMOOTH = 0.9
#: A track that goes on by its own proposals alone loses score by this for each frame, as 1 - ln(1 + FADE * frames).
FADE = 0.05
#: Score of a perfect proposal; overlap above which the better of a proposal and a detection stands for both.
PROPOSAL, SUPPRESS = 0.6, 0.7
#: Overlap from which tracks are in a crossing, and frames for which they must be apart again before it is settled.
TOUCH, APART = 0.3, 3
#: Largest set of tracks in one crossing for which all orders are compared; beyond, the solver decides.
ORDERS = 6


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


class Gallery:
    """The latest vectors of a track, as many as it may keep, and their smoothed mean."""

    __slots__ = ("kept", "smooth", "alone")

    def __init__(self, size: int, first: np.ndarray):
        self.kept: deque = deque([unit(first)] if size else [], maxlen=size or None)
        self.smooth = unit(first)
        self.alone = 0  # frames in a row without a detection of its own

    def add(self, v: np.ndarray) -> None:
        v = unit(v)
        self.kept.append(v)
        self.smooth = unit(SMOOTH * self.smooth + (1 - SMOOTH) * v)
        self.alone = 0


def nearest(galleries: list[Gallery], vectors: np.ndarray) -> np.ndarray:
    """Cosine distance of each vector to the nearest one of each gallery."""
    i, j = (x.ravel() for x in np.indices((len(galleries), len(vectors))))
    return nearest_of(galleries, vectors, i, j).reshape(len(galleries), len(vectors))


def nearest_of(galleries: list[Gallery], vectors: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosine distance of vector j to the nearest one of gallery i, for pairs in the order of i."""
    v, out = unit(vectors), np.zeros(len(i))
    own, begin = np.unique(i, return_index=True)
    for g, a, b in zip(own.tolist(), begin.tolist(), np.append(begin, len(i))[1:].tolist(), strict=True):
        out[a:b] = 1 - (np.stack(galleries[g].kept) @ v[j[a:b]].T).max(axis=0)
    return out


def smoothed(galleries: list[Gallery], vectors: np.ndarray) -> np.ndarray:
    """Cosine distance of each vector to each smoothed one."""
    i, j = (x.ravel() for x in np.indices((len(galleries), len(vectors))))
    return smoothed_of(galleries, vectors, i, j).reshape(len(galleries), len(vectors))


def smoothed_of(galleries: list[Gallery], vectors: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosine distance of vector j to the smoothed one of gallery i."""
    return 1 - (np.stack([g.smooth for g in galleries])[i] * unit(vectors)[j]).sum(-1) if len(i) else np.zeros(0)


def reliability(hits: int, alone: int) -> float:
    """Of a track: zero until it has three updates by detections, then fading while it goes on alone."""
    return max(0.0, 1 - np.log(1 + FADE * alone)) if hits - alone > 2 else 0.0


def proposals(t, rows: np.ndarray, frame: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Detections and proposals of tracks that are left when the better scored suppress those that they overlap, and score ``least`` or more.

    Proposals have no looks (not a number), and are of their track's class.
    """
    from .kernels import overlapping

    k = np.flatnonzero(t.seen >= frame - 2)
    score = PROPOSAL * np.array([reliability(int(t.hits[i]), t.seen_as[i].alone) for i in k.tolist()])
    own = np.column_stack([t.boxes(k), score, t.cls[k], np.full((len(k), rows.shape[1] - 6), np.nan)]) if len(k) else rows[:0]
    both, detected = np.concatenate([rows, own]), np.arange(len(rows) + len(own)) < len(rows)
    order, stays = np.lexsort((~detected, -both[:, 4])), np.zeros(len(both), bool)
    a, b, sim = overlapping(both[:, :4], both[:, :4])
    covers: dict[int, list[int]] = {}
    for i, j in zip(a[sim > SUPPRESS].tolist(), b[sim > SUPPRESS].tolist(), strict=True):
        covers.setdefault(i, []).append(j)
    for i in order.tolist():
        stays[i] = not any(stays[j] for j in covers.get(i, ()))
    stays &= both[:, 4] >= least
    for i in k.tolist():
        t.seen_as[i].alone += 1  # until a detection says otherwise
    return both[stays & detected], both[stays & ~detected]


class Crossings:
    """Tracks that overlap may take over each other's boxes. What each looked like before is remembered until they have parted, and decides then who is who."""

    def __init__(self, gain: float):
        self.gain = gain
        self.groups: list[dict] = []  # members: id to looks before; apart: frames since they last touched

    def solve(self, t, frame: int) -> None:
        from .kernels import overlapping

        live = np.flatnonzero(t.seen == frame)
        boxes, ids = t.boxes(live), t.id[live].tolist()
        i, j, sim = overlapping(boxes, boxes)
        pairs = [x[(sim > TOUCH) & (i < j)].tolist() for x in (i, j)]
        touched: dict[int, set[int]] = {}
        for i, j in zip(*pairs, strict=True):
            touched.setdefault(ids[i], set()).add(ids[j])
            self._join(ids[i], ids[j], {ids[n]: t.seen_as[live[n]].smooth.copy() for n in (i, j)})
        at, alive = {int(i): int(n) for i, n in zip(ids, live.tolist(), strict=True)}, set(t.id.tolist())
        for g in list(self.groups):
            for gone in [i for i in g["members"] if i not in alive]:
                del g["members"][gone]
            members = sorted(g["members"])
            if len(members) < 2:
                self.groups.remove(g)
                continue
            here = [i for i in members if i in at]
            if len(here) < len(members) or any(not touched.get(i, set()).isdisjoint(here) for i in here):
                g["apart"] = 0
                g["since"] = {}
                continue
            g["apart"] += 1
            for i in members:  # only what they look like since they parted counts
                g["since"].setdefault(i, []).append(t.seen_as[at[i]].kept[-1])
            if g["apart"] >= APART:
                self._settle(t, at, members, g)
                self.groups.remove(g)

    def _join(self, a: int, b: int, looks_before: dict) -> None:
        mine = [g for g in self.groups if a in g["members"] or b in g["members"]]
        members = dict(looks_before)
        for g in mine:
            members |= g["members"]  # the looks from before the first touch
            self.groups.remove(g)
        self.groups.append({"members": members, "apart": 0, "since": {}})

    def _settle(self, t, at: dict, members: list[int], g: dict) -> None:
        cost = np.array([[1 - float(g["members"][i] @ unit(np.mean(g["since"][j], axis=0))) for j in members] for i in members])
        order = best_order(cost)
        if np.trace(cost) - cost[np.arange(len(members)), order].sum() <= self.gain:
            return
        slots = [at[i] for i in members]
        before = [t.seen_as[s] for s in slots]
        for i, j in enumerate(order):  # the box of member j is who member i was
            t.id[slots[j]] = members[i]
            t.seen_as[slots[j]] = before[i]
            t.seen_as[slots[j]].add(g["since"][members[j]][-1])


def best_order(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the assignment of least cost; rows keep their own column unless another is better."""
    n = len(cost)
    if n <= ORDERS:
        return np.array(min(itertools.permutations(range(n)), key=lambda p: (round(sum(cost[i, j] for i, j in enumerate(p)), 12), sum(i != j for i, j in enumerate(p)))))
    from ..metrics.assignment import assign

    return assign(cost)[1]
