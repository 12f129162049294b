"""What trackers know of places: regions with a direction of travel, the picture's border, vehicles that stand."""

from __future__ import annotations

from collections import deque

import numpy as np

#: Observations of a track by which it is judged to stand, and so many frames of regions' history.
STEPS, WAY = 10, 28

#: An excursion of this many frames is repaired, a way is taken over so many, shorter ways than this have no direction.
EXCURSION, WINDOW, SHORTEST = 15, 10, 3.0

#: Squared steps over squared diagonals of standing tracks, off-centre share that looks stolen, frames of grace, limit of squared distance, longer buffer.
STANDING, STOLEN, GRACE, DRIFT, HOLD = 0.02**2, 0.05, 8, 9.21, 10

#: Share of its size that a lost track may lie outside, if it is slow or fast, and the squared speed between.
BORDER, FAST_BORDER, FAST = 0.1, 0.02, 4.0


def inside(point: np.ndarray, polygon: np.ndarray) -> bool:
    """By the crossings of a ray to the right."""
    a, b = polygon, np.roll(polygon, -1, 0)
    spans = (a[:, 1] > point[1]) != (b[:, 1] > point[1])
    rise = np.where(spans, b[:, 1] - a[:, 1], 1.0)
    return bool((spans & (point[0] < a[:, 0] + (b[:, 0] - a[:, 0]) * (point[1] - a[:, 1]) / rise)).sum() % 2)


def onto_border(point: np.ndarray, polygon: np.ndarray) -> np.ndarray:
    """The nearest point of the border."""
    a, side = polygon, np.roll(polygon, -1, 0) - polygon
    share = np.clip(((point - a) * side).sum(1) / np.maximum((side**2).sum(1), 1e-9), 0, 1)
    near = a + share[:, None] * side
    return near[((near - point) ** 2).sum(1).argmin()]


def within_cone(begin: np.ndarray, end: np.ndarray, region: np.ndarray) -> np.ndarray:
    """``end``, turned about ``begin`` into the cone of the ways from a region's entry (its first two corners) to its exit (the other two, crosswise)."""
    unit = lambda v: v / (np.linalg.norm(v) + 1e-9)
    way, first, second = end - begin, unit(region[2] - region[0]), unit(region[3] - region[1])
    length = np.linalg.norm(way)
    if length < SHORTEST:
        return end
    axis, half = unit(first + second), np.arccos(np.clip(first @ second, -1, 1)) / 2
    off = np.arctan2(axis[0] * way[1] - axis[1] * way[0], axis @ way)
    if abs(off) <= half:
        return end
    c, s = np.cos(np.copysign(half, off)), np.sin(np.copysign(half, off))
    return begin + length * np.array([c * axis[0] - s * axis[1], s * axis[0] + c * axis[1]])


def settle(way: deque, regions: list[np.ndarray]) -> np.ndarray:
    """The last point of ``way``, corrected. A short excursion from its region is moved onto the border, in ``way`` itself."""
    region = next((r for r in regions if len(r) >= 3 and inside(way[-1], r)), None)
    if region is None:
        return way[-1]
    held = [inside(p, region) for p in way]
    out = next((i for i in range(len(way) - 2, -1, -1) if not held[i]), None)
    back = None if out is None else next((i for i in range(out - 1, -1, -1) if held[i]), None)
    if back is not None and out - back <= EXCURSION:
        for i in range(back + 1, out + 1):
            way[i] = onto_border(way[i], region)
    if len(region) == 4 and len(way) > WINDOW:
        way[-1] = within_cone(way[-1 - WINDOW], way[-1], region)
    return way[-1]


def left_picture(boxes: np.ndarray, speed: np.ndarray, width: float, height: float) -> np.ndarray:
    """Which lost tracks reach out of the picture by more than their share."""
    share = np.where((speed**2).sum(1) > FAST, FAST_BORDER, BORDER)
    x, y, w, h = boxes.T
    return (x + w > width + share * w) | (x < -share * w) | (y + h > height + share * h) | (y + h < -share * h)


def stood(path, least: int) -> bool | None:
    """Whether the median step of (x, y, diagonal) was small; None for a path shorter than ``least``."""
    p = np.array(path)
    if len(p) < least:
        return None
    return bool(np.median(((p[1:, :2] - p[:-1, :2]) ** 2).sum(1) / np.maximum(p[1:, 2] ** 2, 1.0)) < STANDING)


def announced(rows: np.ndarray, public: np.ndarray, least: float) -> np.ndarray:
    """The rows that a public detection stands for: each takes the free row that overlaps it most, if by more than ``least``."""
    from .kernels import overlap

    sim, found = overlap(rows[:, :4], public), []
    for j in range(sim.shape[1] if len(rows) else 0):
        i = sim[:, j].argmax()
        if sim[i, j] > least:
            found.append(i)
            sim[i] = -1.0
    return rows[sorted(found)]
