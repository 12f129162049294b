"""Periodic runs of words: harmonic grid, prefix hashes, binary search of common extensions.

A run is a stretch of consecutive words with smallest period q and length of ``max(LEAST, POWER * q)`` or more that no
neighbouring word extends keeping period q. Words of a run after its first q ones repeat and can be cut.

A run of period q matches itself, moved by q, over ``max(LEAST - q, 2 * q)`` words or more. So for each period a grid of
points is laid, half of that apart (rounded up): some point's block, a step long, lies within the match. There are
n/1 + n/2 + n/3 ... grid points, n log n in all. Blocks are compared by prefix hashes for all (period, point) pairs at once;
pairs whose blocks agree are extended to both sides, all at once too, by binary search over the same hashes. What comes out
is verified word by word (a period whose hashes clash is scanned plainly), and of equal stretches the smallest period stays.

The pairs of a text of n words are the first ones of one table, sorted by the words that a pair needs; so a worker builds it
once, up to ``TABLE`` words. Longer texts make theirs in pieces of about ``PIECE`` pairs.

Edge cases: words are split at ASCII white space and left unchanged; null and empty texts have no words and no runs; rows
that share an id, repeat or have none are told apart, since each is worked on alone; an empty table gives an empty result;
other columns are carried along untouched, and the new ones are named by arguments.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_slices

#: Least words and least periods of a run.
LEAST, POWER = 24, 3
TABLE, PIECE = 1 << 14, 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def step(q: np.ndarray) -> np.ndarray:
    """Words between grid points of a period, and of the block compared at each."""
    return np.maximum(q, (LEAST - q + 1) // 2)


def _grid(periods: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All (period, point) pairs of a text of n words whose blocks lie inside it."""
    g = step(periods)
    count = np.maximum(0, (n - periods - g) // g + 1)
    q = np.repeat(periods, count)
    first = np.repeat(np.cumsum(count) - count, count)
    return q, (np.arange(len(q)) - first) * np.repeat(g, count)


class Tables:
    """What does not depend on a text: powers, and the pairs of short texts by the words that they need."""

    def __init__(self):
        q, at = _grid(np.arange(1, TABLE // POWER + 1), TABLE)
        need = np.maximum(at + q + step(q), np.maximum(LEAST, POWER * q))
        order = np.argsort(need, kind="stable")
        self.q, self.at, self.need = q[order], at[order], need[order]
        self.base, self.inverse = _powers(_BASE, TABLE + 1), _powers(_INVERSE, TABLE + 1)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the base and its inverse; a long text's are not kept."""
        if n < len(self.base):
            return self.base, self.inverse
        return _powers(_BASE, n + 1), _powers(_INVERSE, n + 1)

    def pairs(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if n <= TABLE:
            m = int(np.searchsorted(self.need, n, "right"))
            yield self.q[:m], self.at[:m]
            return
        q, last = 1, n // POWER
        while q <= last:
            # Periods below LEAST / POWER have about n / 8 points each, others n / q.
            upto = min(last, q + max(0, int(PIECE / (n / max(q, LEAST // POWER)))))
            yield _grid(np.arange(q, upto + 1), n)
            q = upto + 1


_tables: list[Tables] = []


def tables() -> Tables:
    if not _tables:
        _tables.append(Tables())
    return _tables[0]


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Text:
    """A text's word numbers with their prefix hashes."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.n = ids, len(ids)
        self.base, inverse = tables().powers(self.n)
        self.total = np.zeros(self.n + 1, np.uint64)
        np.add.accumulate(_mixed(ids) * inverse[: self.n], out=self.total[1:])

    def alike(self, at: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the words at ``at`` and ``at + q`` agree over ``length`` words, by their hashes."""
        t, there = self.total, at + q
        return t[at + length] - t[at] == (t[there + length] - t[there]) * self.base[q]

    def extended(self, at: np.ndarray, q: np.ndarray, known: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
        """Longest common extension of all pairs at once, forwards (1) or backwards (-1), between ``known`` and ``most`` words."""
        low, high = known.copy(), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            good = self.alike(at if way > 0 else at - mid, q, mid)
            low, high = np.where(good, mid, low), np.where(good, high, mid - 1)
        return low

    def plain(self, q: int) -> list[tuple[int, int]]:
        """(start, end) of the stretches of period q that are long enough, word by word."""
        same = np.concatenate([[False], self.ids[:-q] == self.ids[q:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        a, b = edge[::2], edge[1::2] + q
        return [(int(x), int(y)) for x, y in zip(a, b, strict=True) if y - x >= max(LEAST, POWER * q)]

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) by start, then period."""
        least: dict[tuple[int, int], int] = {}
        for q, at in tables().pairs(self.n):
            g = step(q)
            hit = np.flatnonzero(self.alike(at, q, g))
            if not len(hit):
                continue
            q, at, g = q[hit], at[hit], g[hit]
            order = np.lexsort((at, q))
            q, at, g = q[order], at[order], g[order]
            new = np.ones(len(q), bool)
            new[1:] = (q[1:] != q[:-1]) | (at[1:] != at[:-1] + g[1:])  # neighbouring points that agree lie in one match
            q, at, g = q[new], at[new], g[new]
            start = at - self.extended(at, q, np.zeros_like(at), at, -1)
            end = at + q + self.extended(at, q, g, self.n - q - at, 1)
            long = end - start >= np.maximum(LEAST, POWER * q)
            for p, a, b in sorted(set(zip(q[long].tolist(), start[long].tolist(), end[long].tolist(), strict=True))):
                own = [(a, b)] if np.array_equal(self.ids[a : b - p], self.ids[a + p : b]) else self.plain(p)
                for stretch in own:
                    least[stretch] = min(p, least.get(stretch, p))
        return sorted(((a, b - a, p) for (a, b), p in least.items()), key=lambda r: (r[0], r[2]))


def runs_of(parts: list[bytes]) -> list[tuple[int, int, int]]:
    if len(parts) < LEAST:
        return []
    numbers: dict[bytes, int] = {}
    return Text(np.array([numbers.setdefault(w, len(numbers)) for w in parts], np.int64)).runs()


def repeated(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words some run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge)[:-1] > 0


def most_repeated(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest exact length by period; ties go to the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None


def find(docs: DataFrame, text: str = "text", carry: list[str] | None = None, n_words: str = "n_words", runs: str = "runs", best: str = "best", collapsed: str = "collapsed") -> DataFrame:
    """``docs`` (or of its columns those to ``carry``) with their number of words, runs, most repeated run (null: none) and the words that stay, joined by one space.

    Each row is worked on alone, so nothing is shuffled, and a lost executor's rows are simply worked on again.
    """
    (own,) = fresh(docs, "words")
    source = docs.withColumn(own, F.coalesce(F.col(text).cast("binary"), F.lit(b"")))
    docs = docs if carry is None else docs.select(*[F.col(f"`{c}`") for c in carry])
    source = source.select(*[F.col(f"`{c}`") for c in docs.columns], own)
    names = [n_words, runs, best, collapsed]
    carried = docs.columns
    pair = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    clash = {c.lower() for c in carried} & {c.lower() for c in names}
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already; name the new ones by arguments")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, sizes, kept = [], [], []
        for raw in batch.column(batch.num_columns - 1).to_pylist():
            parts = raw.split()
            mine = runs_of(parts)
            gone = repeated(len(parts), mine).tolist() if mine else None
            found.append(mine)
            sizes.append(len(parts))
            kept.append(b" ".join(parts if gone is None else [w for w, g in zip(parts, gone, strict=True) if not g]).decode("utf-8", "replace"))
        as_dict = lambda r: None if r is None else dict(zip(("start", "length", "period"), r, strict=True))
        new = [pa.array(sizes, pa.int64()), pa.array([[as_dict(r) for r in mine] for mine in found], pa.list_(pair)), pa.array([as_dict(most_repeated(m)) for m in found], pair), pa.array(kept, pa.string())]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*carried, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_slices(source, fn, f"{fields}, `{n_words}` bigint, `{runs}` {_RUNS}, `{best}` struct<start:bigint,length:bigint,period:bigint>, `{collapsed}` string")
