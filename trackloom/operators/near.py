"""Boxes that a fold keeps, by the cells of a grid, so that a new one is compared only with those near it."""

from __future__ import annotations

import math
from collections.abc import Hashable


class Near:
    """Boxes (x, y, w, h) under keys. Boxes of more than ``many`` cells, or without finite sides, are candidates everywhere."""

    def __init__(self, cell: float = 128.0, many: int = 64):
        self.cell, self.many = cell, many
        self.boxes: dict[Hashable, tuple] = {}
        self.held: dict[tuple[int, int], set] = {}
        self.wide: set = set()

    def _cells(self, box) -> list[tuple[int, int]] | None:
        x, y, w, h = box
        if not all(map(math.isfinite, (x, y, x + w, y + h))):
            return None
        across, down = (range(math.floor(a / self.cell), math.floor((a + n) / self.cell) + 1) for a, n in ((x, w), (y, h)))
        if len(across) * len(down) > self.many:
            return None
        return [(i, j) for i in across for j in down]

    def put(self, key: Hashable, box: tuple) -> None:
        self.drop(key)
        self.boxes[key], cells = box, self._cells(box)
        if cells is None:
            self.wide.add(key)
        else:
            for c in cells:
                self.held.setdefault(c, set()).add(key)

    def drop(self, key: Hashable) -> None:
        if key not in self.boxes:
            return
        for c in self._cells(self.boxes.pop(key)) or ():
            self.held[c].discard(key)
            if not self.held[c]:
                del self.held[c]
        self.wide.discard(key)

    def around(self, box: tuple) -> set:
        """Keys of all boxes that overlap ``box``, and of others."""
        cells = self._cells(box)
        return set(self.boxes) if cells is None else self.wide.union(*[self.held.get(c, ()) for c in cells])
