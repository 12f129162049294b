"""Minimum-cost assignment by shortest augmenting paths, in NumPy."""

from __future__ import annotations

import numpy as np


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a minimum-cost assignment of min(rows, columns) pairs. Costs are finite."""
    cost = np.asarray(cost, float)
    if not cost.size:
        return np.zeros(0, int), np.zeros(0, int)
    if cost.shape[0] > cost.shape[1]:
        columns, rows = assign(cost.T)
        order = np.argsort(rows)
        return rows[order], columns[order]
    n, m = cost.shape
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)  # the row that holds a column
    for row in range(n):
        slack, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        at, column, reached = row, -1, 0.0
        while True:
            reduced = cost[at] - row_price[at] - col_price + reached
            better = ~done & (reduced < slack)
            slack[better], came[better] = reduced[better], column
            column = int(np.where(done, np.inf, slack).argmin())
            reached = slack[column]
            done[column] = True
            if owner[column] < 0:
                break
            at = owner[column]
        visited = done.copy()
        visited[column] = False
        gain = reached - slack[visited]
        row_price[row] += reached
        row_price[owner[visited]] += gain
        col_price[visited] -= gain
        while column >= 0:  # flip the path
            previous = came[column]
            owner[column] = owner[previous] if previous >= 0 else row
            column = previous
    columns = np.flatnonzero(owner >= 0)
    order = np.argsort(owner[columns])
    return owner[columns][order], columns[order]


def assign_within(cost: np.ndarray, limit: float) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Matches whose cost stays within ``limit``, chosen so that leaving a pair unmatched costs the limit; then the unmatched rows and columns.

    Pairs beyond the limit are never matched, so each connected part of the others is a problem of its own.
    """
    i, j = np.nonzero(cost <= limit)
    return assign_pairs(*cost.shape, i, j, cost[i, j], limit)


def assign_pairs(n: int, m: int, i: np.ndarray, j: np.ndarray, cost: np.ndarray, limit: float) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """The same for n rows and m columns of which only the pairs (i, j) may match, at ``cost``: memory goes with the pairs."""
    good = cost <= limit
    i, j, cost = i[good], j[good], cost[good]
    own = dict(zip(zip(i.tolist(), j.tolist(), strict=True), cost.tolist(), strict=True))
    found = []
    for rows, columns in _parts(i, j):
        if len(rows) == len(columns) == 1:
            found.append((rows[0], columns[0]))
            continue
        k, j = len(rows), len(columns)
        square = np.full((k + j, k + j), limit / 2.0)
        square[:k, :j] = [[own.get((r, c), 1e3 + limit) for c in columns] for r in rows]
        square[k:, j:] = 0.0
        found += [(rows[r], columns[c]) for r, c in zip(*assign(square), strict=True) if r < k and c < j and square[r, c] <= limit]
    found.sort()
    left, right = {r for r, _ in found}, {c for _, c in found}
    return found, [r for r in range(n) if r not in left], [c for c in range(m) if c not in right]


def _parts(r: np.ndarray, c: np.ndarray) -> list[tuple[list[int], list[int]]]:
    """Rows and columns of each connected part of a bipartite graph of edges (r, c)."""
    by_row, by_column = {}, {}
    for i, j in zip(r.tolist(), c.tolist(), strict=True):
        by_row.setdefault(i, []).append(j)
        by_column.setdefault(j, []).append(i)
    parts, done = [], set()
    for i in by_row:
        if i in done:
            continue
        done.add(i)
        rows, columns, open_ = [i], set(by_row[i]), list(by_row[i])
        while open_:
            for k in by_column[open_.pop()]:
                if k not in done:
                    done.add(k)
                    rows.append(k)
                    new = [j for j in by_row[k] if j not in columns]
                    columns.update(new)
                    open_ += new
        parts.append((sorted(rows), sorted(columns)))
    return parts
