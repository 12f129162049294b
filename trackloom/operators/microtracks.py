"""Rare appearances: detections without ids, grouped on line into micro-tracks by place and time."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import fold_sorted


@dataclass(frozen=True)
class Options:
    confidence: float = 0.2  # detections above take part
    near: float = 5.0  # distance of centres within which a detection continues a track
    latency: int = 5  # detections before a track can raise an alert
    ratio: float = 0.5  # least share of positive votes among the last ``latency``
    hold: int = 3  # frames without a detection after which a track ends
    ignored_confidence: float = 0.6  # tracks below, which stand, are ignored where they stood
    ignored_spread: float = 1.0  # greatest deviation of their distance from their mean place
    ignored_near: float = 5.0
    ignored_for: int = 200


RESULT = "frame bigint, x double, y double, confidence double, n int, votes int"


def unlike(boxes: np.ndarray) -> np.ndarray:
    """Which boxes, from the most confident on, overlap none before them by more than a thousandth of the smaller."""
    low, high = np.maximum(boxes[:, None, :2], boxes[None, :, :2]), np.minimum(boxes[:, None, :2] + boxes[:, None, 2:], boxes[None, :, :2] + boxes[None, :, 2:])
    size = boxes[:, 2] * boxes[:, 3]
    share = np.clip(high - low, 0, None).prod(2) / np.maximum(np.minimum(size[:, None], size[None]), 1e-9)
    return ~np.tril(share > 0.001, -1).any(1)


class MicroTracks:
    """Tracks and ignored places of one sequence. A frame is worked on when the next one begins."""

    def __init__(self, options: Options):
        self.options, self.frame, self.rows = options, None, []
        self.tracks: list[dict] = []
        self.ignored: list[list] = []  # place, last frame

    def step(self, frame: int, conf: float, vote: bool, x: float, y: float, w: float, h: float) -> list[tuple]:
        out = []
        if self.frame is not None and frame != self.frame:
            out = self._frame()
        self.frame = frame
        self.rows.append((conf, x, y, w, h, vote))
        return out

    def end(self) -> list[tuple]:
        return self._frame() if self.frame is not None else []

    def _frame(self) -> list[tuple]:
        o, now, out = self.options, self.frame, []
        self._end(now - 1)  # frames without detections have passed
        rows = sorted((r for r in self.rows if r[0] > o.confidence), key=lambda r: (-r[0], r[1:]))
        self.rows = []
        if rows:
            clear = unlike(np.array([r[1:5] for r in rows]))
            for (conf, x, y, w, h, vote), ok in zip(rows, clear.tolist(), strict=True):
                if ok:
                    self._place(now, np.array([x + w / 2, y + h / 2]), conf, vote)
        for t in self.tracks:
            seen = t["seen"]
            if not t["active"]:
                t["seen"] = seen[-1:]
            elif len(seen) >= o.latency and seen[-1][0] == now:
                if self._is_ignored(t):
                    t["active"] = False
                    continue
                last = seen[-o.latency :]
                votes = sum(s[3] for s in last)
                if votes >= o.ratio * o.latency:
                    centre = seen[-1][1]
                    out.append((now, float(centre[0]), float(centre[1]), float(seen[-1][2]), t["n"], votes))
                    self._ignore(t)
                    t["active"], t["seen"] = False, seen[-1:]
        self._end(now)
        return out

    def _end(self, now: int) -> None:
        """Ends tracks that were not seen for long, as of a frame, and forgets ignored places."""
        o = self.options
        for t in self.tracks:
            if t["seen"][-1][0] <= now - o.hold:
                self._ignore(t)
        self.tracks = [t for t in self.tracks if t["seen"][-1][0] > now - o.hold]
        for t in self.tracks:
            t["seen"] = t["seen"][-o.latency :]
        self.ignored = [p for p in self.ignored if p[1] > now - o.ignored_for]

    def _place(self, now: int, centre: np.ndarray, conf: float, vote: bool) -> None:
        far = [float(np.linalg.norm(centre - t["seen"][-1][1])) for t in self.tracks]
        for k in np.argsort(far, kind="stable"):
            if far[k] < self.options.near and self.tracks[k]["seen"][-1][0] < now:
                self.tracks[k]["seen"].append((now, centre, conf, vote))
                self.tracks[k]["n"] += 1
                return
        self.tracks.append({"seen": [(now, centre, conf, vote)], "active": True, "n": 1})

    @staticmethod
    def _spread(t: dict) -> tuple[np.ndarray, float]:
        centres = np.array([s[1] for s in t["seen"]])
        mean = centres.mean(axis=0)
        return mean, float(np.linalg.norm(centres - mean, axis=1).std())

    def _ignore(self, t: dict) -> None:
        if not t["active"] or np.mean([s[2] for s in t["seen"]]) >= self.options.ignored_confidence:
            return
        place, spread = self._spread(t)
        if spread >= self.options.ignored_spread:
            return
        last = t["seen"][-1][0]
        for p in self.ignored:
            if np.linalg.norm(p[0] - place) < self.options.ignored_near:
                p[:] = [place, last]
                return
        self.ignored.append([place, last])

    def _is_ignored(self, t: dict) -> bool:
        place, spread = self._spread(t)
        if np.median([s[2] for s in t["seen"]]) >= self.options.ignored_confidence or spread >= self.options.ignored_spread:
            return False
        for p in self.ignored:
            if np.linalg.norm(p[0] - place) < self.options.ignored_near:
                p[1] = t["seen"][-1][0]
                return True
        return False


def rare_appearances(detections: DataFrame, key: str, options: Options) -> DataFrame:
    """key and ``RESULT``: alerts of detections (key, frame, conf, vote, x, y, w, h), one per micro-track that got enough votes.

    What a task holds is a sequence's live micro-tracks, its ignored places and one frame.
    """
    rows = detections.select(key, F.col("frame").cast("long").alias("frame"), F.col("conf").cast("double").alias("conf"), F.col("vote").cast("boolean").alias("vote"), *[F.col(c).cast("double").alias(c) for c in "xywh"])
    return fold_sorted(rows, [key], ["frame", "conf", "x", "y", "w", "h", "vote"], lambda: MicroTracks(options), RESULT)
