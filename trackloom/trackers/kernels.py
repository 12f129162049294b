"""Frame-by-frame trackers over the detections of one sequence.

All share one loop: predict, associate in stages, update, start and end tracks. A tracker is a set of parameters of that
loop; see ``TRACKERS``. All live tracks are one set of arrays, and every step takes all of them at once; only options that
look at places (``places``) or looks (``looks``) go through tracks one by one. There are no pixels here: what a box looks like
is a vector that comes with it, and camera motion is out of scope.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np

from ..metrics.assignment import assign_pairs
from . import looks, places
from .kalman import BoxFilter


@dataclass(frozen=True)
class Options:
    high: float = 0.6  # score from which a detection takes part in the first stage
    low: float = 0.1  # and in the second
    start: float = 0.7  # and may start a track
    first: float = 0.8  # largest cost of the first stage
    second: float = 0.5
    unconfirmed: float = 0.7
    buffer: int = 30  # frames that a lost track is kept
    min_hits: int = 1  # updates before a track is shown
    two_stage: bool = True
    fuse_score: bool = True
    form: str = "xyah"
    similarity: str = "iou"  # iou, hmiou, ciou or giou
    direction: float = 0.0  # weight of velocity-direction consistency
    delta: int = 3  # frames back for that direction
    corners: bool = False  # direction of the four corners instead of the centre
    confidence: float = 0.0  # weight of the score difference
    rematch: bool = False  # last observations against what is left
    revise: bool = False  # after a gap, replay the path between the observations
    by_class: bool = False  # classes don't match each other
    freeze: bool = False  # tracks that others cover stand still instead of drifting
    calm_start: float = 1.0  # a start is suppressed if it overlaps a live track more than this
    duplicate: float = 0.15  # two tracks nearer than this are one
    cascade: float = 0.0  # squared distance within which tracks match first by how recently they were seen; 0: no such stage
    flat: bool = False  # scores count only for who takes part
    public: float = 0.0  # a start needs a public detection that it overlaps more than this; 0: it needs none
    regions: tuple = ()  # polygons that tracks keep to; four corners (two of the entry, two of the exit) give a direction, too
    picture: tuple[float, float] | None = None  # width and height: lost tracks that leave it match no more
    gallery: int = 0  # vectors of looks that a track keeps; 0: looks are not used
    alike: float = 0.2  # largest distance of looks at which the cascade matches
    looks: float = 0.0  # weight of the distance to a track's smoothed looks
    nearest: tuple[float, float] | None = None  # largest distances of looks (halved) and of overlap at which looks may lower the cost
    proposals: bool = False  # tracks propose where they are, scored by how reliably they were seen, against detections
    reunite: float = 0.0  # least gain in looks for which tracks that parted after crossing swap their ids; 0: they never do
    parked: tuple[float, ...] = ()  # classes whose standing tracks are held longer and guarded against passing ones


TRACKERS: dict[str, Options] = {
    "sort": Options(two_stage=False, fuse_score=False, first=0.7, min_hits=3, buffer=1, start=0.3, high=0.3),
    "bytetrack": Options(),
    "bytetrack_plus": Options(freeze=True, calm_start=0.5),
    "ocsort": Options(fuse_score=False, first=0.7, direction=0.2, rematch=True, revise=True, form="xywh"),
    "hybridsort": Options(fuse_score=False, first=0.75, similarity="hmiou", direction=0.05, corners=True, confidence=0.2, rematch=True, revise=True, form="xywh"),
    "botsort": Options(form="xywh"),
    "fasttracker": Options(freeze=True, calm_start=0.7, buffer=60),
    "class_aware": Options(by_class=True, freeze=True),
    "deepsort_motion": Options(two_stage=False, fuse_score=False, first=0.7, min_hits=3, high=0.3, start=0.3, cascade=9.4877),
}
TRACKERS |= {
    "deepsort": replace(TRACKERS["deepsort_motion"], gallery=100),
    "hybridsort_reid": replace(TRACKERS["hybridsort"], gallery=1, looks=0.5),
    "botsort_reid": replace(TRACKERS["botsort"], gallery=1, nearest=(0.25, 0.5)),
    "motdt": Options(two_stage=False, fuse_score=False, high=0.4, start=0.6, min_hits=1, cascade=9.4877, gallery=30, alike=0.8, first=0.5, proposals=True),
    "bytetrack_reid": replace(TRACKERS["bytetrack"], gallery=30, reunite=0.1),
    "bytetrack_ciou": replace(TRACKERS["bytetrack_plus"], parked=(0.0, 1.0), similarity="ciou", first=0.9, fuse_score=False),
    "bytetrack_guarded": replace(TRACKERS["bytetrack_plus"], parked=(0.0, 1.0), picture=(1920.0, 1080.0)),
    "ocsort_by_class": replace(TRACKERS["ocsort"], by_class=True, flat=True),
    "hybridsort_by_class": replace(TRACKERS["hybridsort"], by_class=True, flat=True),
}

#: Starts tracks only where a public detection is; needs a table of these.
PUBLIC = replace(TRACKERS["bytetrack"], public=0.88)


class Tracks:
    """Live tracks as arrays with a row for each, in the order of their start."""

    def __init__(self, options: Options):
        self.options, self.filter, self.next, self.depth = options, BoxFilter(options.form), 1, options.delta + 1
        none = np.zeros(0, np.int64)
        self.id, self.born, self.seen, self.hits, self.frozen = none, none, none, none, none.astype(bool)
        self.score, self.cls, self.mean, self.cov, self.last = np.zeros(0), np.zeros(0), np.zeros((0, 8)), np.zeros((0, 3, 4)), np.zeros((0, 4))
        self.ring, self.ring_at = np.zeros((0, self.depth, 4)), np.zeros((0, self.depth), np.int64)  # the latest observations and their frames
        self.votes: list[dict] = []
        self.path: list[deque] = []  # (x, y, diagonal) of the latest observations
        self.way: list[deque] = []  # the latest centres, for regions
        self.seen_as: list[looks.Gallery] = []
        self.saved: list[tuple | None] = []  # frame, mean, covariance and path before an update that looks stolen

    def __len__(self) -> int:
        return len(self.id)

    _ARRAYS = ("id", "born", "seen", "hits", "frozen", "score", "cls", "mean", "cov", "last", "ring", "ring_at")

    def start(self, frame: int, rows: np.ndarray) -> None:
        k = len(rows)
        mean, cov = self.filter.initiate(self.filter.measure(rows[:, :4]))
        ring, ring_at = np.zeros((k, self.depth, 4)), np.full((k, self.depth), -1)
        ring[:, frame % self.depth], ring_at[:, frame % self.depth] = rows[:, :4], frame
        at = np.full(k, frame)
        new = (np.arange(self.next, self.next + k), at, at, np.ones(k, np.int64), np.zeros(k, bool), rows[:, 4], rows[:, 5], mean, cov, rows[:, :4], ring, ring_at)
        for name, more in zip(self._ARRAYS, new, strict=True):
            setattr(self, name, np.concatenate([getattr(self, name), more]))
        self.votes += [{r[5]: r[4]} for r in rows]
        self.path += [deque([p], places.STEPS) for p in _spots(rows)]
        self.way += [deque(maxlen=places.WAY) for _ in rows]
        self.seen_as += [looks.Gallery(self.options.gallery, r[6:]) for r in rows]
        self.saved += [None] * k
        self.next += k

    def keep(self, stays: np.ndarray) -> None:
        if not stays.all():
            for name in self._ARRAYS:
                setattr(self, name, getattr(self, name)[stays])
            for name in ("votes", "path", "way", "saved", "seen_as"):
                setattr(self, name, [v for v, s in zip(getattr(self, name), stays, strict=True) if s])

    def boxes(self, k=slice(None)) -> np.ndarray:
        return self.filter.to_tlwh(self.mean[k])

    def predict(self, frame: int) -> None:
        self.mean[self.seen < frame - 1, 7] = 0.0  # no growth while unseen
        self.mean[self.frozen, 4:] *= 0.5
        self.mean, self.cov = self.filter.predict(self.mean, self.cov)

    def update(self, k: np.ndarray, frame: int, rows: np.ndarray) -> None:
        if not len(k):
            return
        if self.options.parked:
            for i, p in zip(k.tolist(), _spots(rows), strict=True):
                self.path[i].append(p)
        gap = self.seen[k] < frame - 1 if self.options.revise else np.zeros(len(k), bool)
        if gap.any():
            self.replay(k[gap], frame, rows[gap])
        on = k[~gap]
        if len(on):
            self.mean[on], self.cov[on] = self.filter.update(self.mean[on], self.cov[on], self.filter.measure(rows[~gap, :4]))
        self.seen[k] = frame
        self.hits[k] += 1
        self.score[k], self.last[k] = rows[:, 4], rows[:, :4]
        self.ring[k, frame % self.depth], self.ring_at[k, frame % self.depth] = rows[:, :4], frame
        if self.options.gallery:
            for i, r in zip(k.tolist(), rows, strict=True):
                if not np.isnan(r[6:]).any():  # a proposal has no looks
                    self.seen_as[i].add(r[6:])
        for i, r in zip(k.tolist(), rows, strict=True):
            votes = self.votes[i]
            votes[r[5]] = votes.get(r[5], 0.0) + r[4]
            self.cls[i] = max(votes, key=lambda c: (votes[c], -c)) if len(votes) > 1 else r[5]

    def replay(self, k: np.ndarray, frame: int, rows: np.ndarray) -> None:
        """Filters along the straight line from the last observation, instead of the drift."""
        last, steps = self.last[k], frame - self.seen[k]
        mean, cov = self.filter.initiate(self.filter.measure(last))
        mean[:, 4:] = (self.filter.measure(rows[:, :4]) - self.filter.measure(last)) / steps[:, None]
        for n in range(1, steps.max() + 1):
            on = steps >= n
            ahead = self.filter.predict(mean[on], cov[on])
            mean[on], cov[on] = self.filter.update(*ahead, self.filter.measure(last[on] + (rows[on, :4] - last[on]) * n / steps[on, None]))
        self.mean[k], self.cov[k] = mean, cov

    def earlier(self, k: np.ndarray) -> np.ndarray:
        """The observation ``delta`` frames before the last one, or the most recent after it."""
        out, open_ = self.last[k].copy(), np.ones(len(k), bool)
        for n in range(self.options.delta, 0, -1):
            at = self.seen[k] - n
            hit = open_ & (self.ring_at[k, at % self.depth] == at)
            out[hit] = self.ring[k[hit], (at % self.depth)[hit]]
            open_ &= ~hit
        return out


def _spots(rows: np.ndarray) -> list[tuple]:
    return [(x + w / 2, y + h / 2, float(np.hypot(w, h))) for x, y, w, h in rows[:, :4].tolist()]


def overlap(a: np.ndarray, b: np.ndarray, kind: str = "iou") -> np.ndarray:
    """Similarity matrix of tlwh boxes."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    return _similar(np.asarray(a, float)[:, None], np.asarray(b, float)[None], kind)


def meeting(low: np.ndarray, high: np.ndarray, others_low: np.ndarray, others_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), in their order, of areas (rows of two coordinates) that share a point: a sweep along the axis on which fewer meet."""
    if not len(low) or not len(others_low):
        return np.zeros(0, int), np.zeros(0, int)
    best = None
    for d in (0, 1):
        order = np.argsort(others_low[:, d], kind="stable")
        begin = np.searchsorted(np.maximum.accumulate(others_high[order, d]), low[:, d], "left")
        n = np.maximum(np.searchsorted(others_low[order, d], high[:, d], "right") - begin, 0)
        if best is None or n.sum() < best[2].sum():
            best = order, begin, n
    order, begin, n = best
    i = np.repeat(np.arange(len(low)), n)
    j = order[np.arange(len(i)) + np.repeat(begin - np.cumsum(n) + n, n)]
    meets = ((low[i] <= others_high[j]) & (others_low[j] <= high[i])).all(1)
    i, j = i[meets], j[meets]
    order = np.lexsort((j, i))
    return i[order], j[order]


def overlapping(a: np.ndarray, b: np.ndarray, kind: str = "iou") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j, similarity of the pairs of tlwh boxes whose similarity is above zero; only boxes that meet are compared, but for giou."""
    a, b = np.asarray(a, float).reshape(-1, 4), np.asarray(b, float).reshape(-1, 4)
    if kind == "giou":
        i, j = (x.ravel() for x in np.indices((len(a), len(b))))
    else:
        i, j = meeting(a[:, :2], a[:, :2] + a[:, 2:], b[:, :2], b[:, :2] + b[:, 2:])
    sim = _similar(a[i], b[j], kind)
    good = sim > 0
    return i[good], j[good], sim[good]


def _similar(a: np.ndarray, b: np.ndarray, kind: str) -> np.ndarray:
    low, high = np.maximum(a[..., :2], b[..., :2]), np.minimum(a[..., :2] + a[..., 2:], b[..., :2] + b[..., 2:])
    cut = np.clip(high - low, 0, None)
    inter = cut[..., 0] * cut[..., 1]
    union = a[..., 2] * a[..., 3] + b[..., 2] * b[..., 3] - inter
    out = inter / np.maximum(union, 1e-9)
    if kind == "iou":
        return out
    span = np.maximum(a[..., :2] + a[..., 2:], b[..., :2] + b[..., 2:]) - np.minimum(a[..., :2], b[..., :2])
    if kind == "hmiou":
        return out * cut[..., 1] / np.maximum(span[..., 1], 1e-9)
    if kind == "ciou":
        gap = ((a[..., :2] + a[..., 2:] / 2 - b[..., :2] - b[..., 2:] / 2) ** 2).sum(-1)
        turn = lambda x: np.arctan(x[..., 2] / np.maximum(x[..., 3], 1e-9))
        v = 4 / np.pi**2 * (turn(a) - turn(b)) ** 2
        return np.clip(out - gap / np.maximum((span**2).sum(-1), 1e-9) - v * v / np.maximum(1 - out + v, 1e-9), 0, 1)
    hull = span[..., 0] * span[..., 1]
    return (out - (hull - union) / np.maximum(hull, 1e-9) + 1) / 2


def _points(boxes: np.ndarray, corners: bool) -> np.ndarray:
    x, y, w, h = boxes.T
    at = [(x, y), (x + w, y), (x, y + h), (x + w, y + h)] if corners else [(x + w / 2, y + h / 2)]
    return np.stack([np.stack(p, -1) for p in at], 1)


def _direction_bonus(t: Tracks, k: np.ndarray, rows: np.ndarray, i: np.ndarray, j: np.ndarray, o: Options) -> np.ndarray:
    """How well, for pairs (i, j), the way from the last observation to a detection agrees with the way so far, from -0.5 to 0.5."""
    last = _points(t.last[k], o.corners)
    own = last - _points(t.earlier(k), o.corners)
    step = _points(rows[:, :4], o.corners)[j] - last[i]
    norm = np.linalg.norm(own, axis=-1)
    cos = (own[i] * step).sum(-1) / np.maximum(norm[i] * np.linalg.norm(step, axis=-1), 1e-9)
    bonus = (0.5 - np.arccos(np.clip(cos, -1, 1)) / np.pi).mean(-1) * rows[j, 4]
    return np.where(norm.any(1)[i], bonus, 0.0)


Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _cost(t: Tracks, k: np.ndarray, rows: np.ndarray, o: Options, first: bool) -> Pairs:
    """Tracks, detections and costs of the pairs that may match: those that overlap and, if classes count, are of one."""
    i, j, sim = overlapping(t.boxes(k), rows[:, :4], o.similarity)
    if o.by_class:
        alike = t.cls[k[i]] == rows[j, 5]
        i, j, sim = i[alike], j[alike], sim[alike]
    cost = 1 - (sim * rows[j, 4] if first and o.fuse_score else sim)
    if first and o.direction:
        cost = cost - o.direction * _direction_bonus(t, k, rows, i, j, o)
    if first and o.looks:
        cost = cost + o.looks * looks.smoothed_of([t.seen_as[n] for n in k.tolist()], rows[:, 6:], i, j)
    if first and o.nearest:
        far = looks.smoothed_of([t.seen_as[n] for n in k.tolist()], rows[:, 6:], i, j) / 2
        cost = np.minimum(cost, np.where((far > o.nearest[0]) | (1 - sim > o.nearest[1]), 1.0, far))
    if o.confidence:
        cost = cost + o.confidence * np.abs(t.score[k[i]] - rows[j, 4])
    return i, j, cost


def _match(t: Tracks, k: np.ndarray, rows: np.ndarray, frame: int, pairs: Pairs, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Updates the tracks ``k`` that get a detection; the others, and the detections left."""
    found, left, free = assign_pairs(len(k), len(rows), *pairs, limit)
    if found:
        i, j = np.array(found).T
        if t.options.parked:
            _suspect(t, k[i], frame, rows[j])
        t.update(k[i], frame, rows[j])
    return k[left], rows[free]


def _stage(t: Tracks, k: np.ndarray, rows: np.ndarray, frame: int, o: Options, limit: float, first: bool) -> tuple[np.ndarray, np.ndarray]:
    return _match(t, k, rows, frame, _cost(t, k, rows, o, first), limit) if len(k) and len(rows) else (k, rows)


def _cascade(t: Tracks, k: np.ndarray, rows: np.ndarray, frame: int, o: Options) -> tuple[np.ndarray, np.ndarray]:
    """Tracks seen one frame ago choose first, then those of two frames, and so on, each by the filter's distance to a detection."""
    left = []
    for age in np.unique(frame - t.seen[k]):
        own = k[frame - t.seen[k] == age]
        if len(rows):
            i, j, far = t.filter.gated(t.mean[own], t.cov[own], t.filter.measure(rows[:, :4]), o.cascade, meeting)
            limit = o.cascade
            if o.gallery:  # motion says who may match, looks who does
                far, limit = looks.nearest_of([t.seen_as[n] for n in own.tolist()], rows[:, 6:], i, j), o.alike
            own, rows = _match(t, own, rows, frame, (i, j, far), limit)
        left.append(own)
    return np.sort(np.concatenate(left)) if left else k, rows


def _suspect(t: Tracks, k: np.ndarray, frame: int, rows: np.ndarray) -> None:
    """Saves standing tracks that are about to jump: a passing object may be taking them along."""
    for i, (x, y, diagonal) in zip(k.tolist(), _spots(rows), strict=True):
        if t.cls[i] not in t.options.parked or t.hits[i] < 10 or t.seen[i] != frame - 1 or t.saved[i] is not None:
            continue
        still = places.stood(t.path[i], 5)
        if (_at_rest(t, i) if still is None else still) and np.hypot(x - t.mean[i, 0], y - t.mean[i, 1]) > places.STOLEN * diagonal:
            t.saved[i] = (frame, t.mean[i].copy(), t.cov[i].copy(), t.path[i].copy())


def _at_rest(t: Tracks, i: int) -> bool:
    box = t.boxes([i])[0]
    return bool((t.mean[i, 4:6] ** 2).sum() / max(box[2] ** 2 + box[3] ** 2, 1.0) < places.STANDING)


def _waits(t: Tracks, frame: int) -> np.ndarray:
    """Lost tracks of guarded classes that stood when they were last seen."""
    out = np.zeros(len(t), bool)
    if len(t):
        size = t.boxes()[:, 2:]
        rest = (t.mean[:, 4:6] ** 2).sum(1) / np.maximum((size**2).sum(1), 1.0) < places.STANDING
        for i in np.flatnonzero(rest & (t.seen < frame) & np.isin(t.cls, t.options.parked)).tolist():
            out[i] = places.stood(t.path[i], 2) is not False
    return out


def _revert(t: Tracks, frame: int, rows: np.ndarray) -> None:
    """After the grace, or once lost: a saved track that left its expected place goes back to where it stood, or to a free detection there, and is lost."""
    spots = np.array(_spots(rows)).reshape(-1, 3)
    for i in [i for i, saved in enumerate(t.saved) if saved is not None]:
        since, mean, cov, path = t.saved[i]
        n, lost = frame - since, t.seen[i] < frame
        if not lost and n < places.GRACE:
            continue
        t.saved[i] = None
        if not lost:
            size = t.filter.to_tlwh(mean[None])[0, 2:]
            spread = np.minimum(cov[0, :2] + n * n * cov[2, :2], 0.25 * size**2)
            far = ((t.mean[i, :2] - mean[:2] - n * mean[4:6]) ** 2 / np.maximum(spread, 1.0)).sum()
            if far <= places.DRIFT or places.stood(list(path)[-6:], 5) is False:
                continue
            t.seen[i] = frame - 1
        t.mean[i], t.cov[i], t.path[i] = mean, cov, path
        t.mean[i, :2], t.mean[i, 4:6] = np.median(np.array(path)[:, :2], axis=0), 0.0
        box = t.boxes([i])[0]
        near, best = 0.5 * np.hypot(*box[2:]), None
        live, away = t.mean[t.seen == frame, :2], np.hypot(spots[:, 0] - t.mean[i, 0], spots[:, 1] - t.mean[i, 1])
        for j in np.flatnonzero(away < near).tolist():
            (x, y, diagonal), off = spots[j], away[j]
            if off < near and not (np.hypot(live[:, 0] - x, live[:, 1] - y) < 0.5 * diagonal).any():
                near, best = off, j
        if best is not None:
            t.mean[i, :4], t.mean[i, 4:] = t.filter.measure(rows[best, :4])[0], 0.0


def run(frames: dict[int, np.ndarray], options: Options, public: dict[int, np.ndarray] | None = None) -> list[tuple]:
    """``stream`` over frames that are given as a table: frame to rows."""
    return [row for shown in stream(sorted(frames.items(), key=lambda f: f[0]), options, public) for row in shown]


def _every_frame(frames: Iterable[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
    """``frames`` with those between them, without rows."""
    last = None
    for frame, rows in frames:
        for between in range(frame if last is None else last + 1, frame):
            yield between, rows[:0]
        yield frame, rows
        last = frame


def stream(frames: Iterable[tuple[int, np.ndarray]], options: Options, public: dict[int, np.ndarray] | None = None) -> Iterator[list[tuple]]:
    """frames, in order: frame and (n, 6 + m) rows of x, y, w, h, score, class and, if the options use them, m numbers of looks. Gives for each frame (frame, id, x, y, w, h, score, class), ids from 1.

    public: frame to (n, 4) boxes, for trackers that start tracks only there. Only the live tracks and a frame are held.
    """
    o, t, begin = options, Tracks(options), None
    crossings = looks.Crossings(o.reunite)
    regions = [np.asarray(r, float) for r in o.regions]
    for frame, rows in _every_frame(frames):
        begin = frame if begin is None else begin
        rows = rows[np.lexsort(tuple(rows.T[::-1]))] if len(rows) else rows  # order of input doesn't matter
        if len(t):
            t.predict(frame)
        if o.freeze and len(t) > 1:
            boxes = t.boxes()
            i, j, cover = overlapping(boxes, boxes)
            covered = np.zeros(len(t), bool)
            covered[i[(cover > 0.7) & (i != j)]] = True
            t.frozen = covered & (t.seen < frame - 1)
        high = rows[rows[:, 4] >= o.high]
        low = rows[(rows[:, 4] >= o.low) & (rows[:, 4] < o.high)]
        if o.flat:
            high, low = (np.column_stack([r[:, :4], np.ones(len(r)), r[:, 5:]]) for r in (high, low))
        proposed = rows[:0]
        if o.proposals:
            high, proposed = looks.proposals(t, high, frame, o.high)
        known = (t.hits > 1) | (t.born == begin)
        left, unsure = np.flatnonzero(known), np.flatnonzero(~known)
        if o.picture and len(left):
            gone = places.left_picture(t.boxes(left), t.mean[left, 4:6], *o.picture)
            left = left[~(gone & (t.seen[left] < frame - 1))]
        if o.cascade:
            left, high = _cascade(t, left, high, frame, o)
            late = left[t.seen[left] < frame - 1]
            recent, high = _stage(t, left[t.seen[left] == frame - 1], high, frame, o, o.first, True)
            left = np.sort(np.concatenate([late, recent]))
        else:
            left, high = _stage(t, left, high, frame, o, o.first, True)
        if o.two_stage:
            _stage(t, left[t.seen[left] >= frame - 1], low, frame, o, o.second, False)
            left = left[t.seen[left] != frame]
        if o.rematch and len(left) and len(high):
            i, j, sim = overlapping(t.last[left], high[:, :4])
            alike = t.cls[left[i]] == high[j, 5] if o.by_class else np.ones(len(i), bool)
            left, high = _match(t, left, high, frame, (i[alike], j[alike], 1 - sim[alike]), 0.7)
        if len(proposed):  # what no detection stands for: tracks go on by their own proposals
            own = left[(t.seen[left] >= frame - 2) & (t.seen[left] != frame)]
            _stage(t, own, proposed, frame, o, o.second, False)
        dead, high = _stage(t, unsure, high, frame, o, o.unconfirmed, True)
        stays = frame - t.seen <= o.buffer
        if o.parked:
            _revert(t, frame, rows)
            waits = _waits(t, frame)
            stays |= waits & (frame - t.seen <= places.HOLD * o.buffer)
            if waits.any() and len(high):
                spots, at = np.array(_spots(high)), t.mean[waits, :2]
                reach = 0.5 * spots[:, 2:]
                i, j = meeting(spots[:, :2] - reach, spots[:, :2] + reach, at, at)
                near = np.hypot(spots[i, 0] - at[j, 0], spots[i, 1] - at[j, 1]) < 0.5 * spots[i, 2]
                high = np.delete(high, np.unique(i[near]), axis=0)
        stays[dead] = False
        if o.public:
            high = places.announced(high, (public or {}).get(frame, np.zeros((0, 4))), o.public)
        high = high[high[:, 4] >= o.start]
        if len(high):
            calm = _calm(t.boxes(t.seen == frame), high, o) if o.calm_start < 1 else np.ones(len(high), bool)
            t.start(frame, high[calm])
            stays = np.concatenate([stays, np.ones(int(calm.sum()), bool)])
        t.keep(stays)
        if o.reunite:
            crossings.solve(t, frame)
        _without_twins(t, o.duplicate)
        shown = t.seen == frame
        if regions:
            for i in np.flatnonzero(shown).tolist():
                t.way[i].append(t.mean[i, :2].copy())
                t.mean[i, :2] = places.settle(t.way[i], regions)
        if frame - begin >= o.min_hits:
            shown &= t.hits >= o.min_hits
        if o.min_hits > 1:
            shown &= (t.hits > 1) | (t.born == begin)
        k = np.flatnonzero(shown)
        yield [(frame, i, *b, s, c) for i, b, s, c in zip(t.id[k].tolist(), t.boxes(k).tolist(), t.score[k].tolist(), t.cls[k].tolist(), strict=True)]


def _calm(live: np.ndarray, rows: np.ndarray, o: Options) -> np.ndarray:
    """Which detections may start a track: those that no live track, an earlier one of these included, overlaps much."""
    _, j, sim = overlapping(live, rows[:, :4])
    calm = np.ones(len(rows), bool)
    calm[j[sim > o.calm_start]] = False
    i, j, sim = overlapping(rows[:, :4], rows[:, :4])
    for a, b in zip(*(x[(sim > o.calm_start) & (i < j)].tolist() for x in (i, j)), strict=True):  # by the earlier, whose turn has come
        if calm[a]:
            calm[b] = False
    return calm


def _without_twins(t: Tracks, near: float) -> None:
    """Of a live and a lost track that overlap almost wholly the one with the shorter life goes."""
    if len(t) < 2 or (t.seen == t.seen[0]).all():
        return
    boxes, gone = t.boxes(), set()
    i, j, sim = overlapping(boxes, boxes)
    for i, j in zip(*(x[(1 - sim < near) & (i < j)].tolist() for x in (i, j)), strict=True):
        if t.seen[i] != t.seen[j] and i not in gone and j not in gone:
            gone.add(j if t.seen[i] - t.born[i] >= t.seen[j] - t.born[j] else i)
    if gone:
        stays = np.ones(len(t), bool)
        stays[list(gone)] = False
        t.keep(stays)
