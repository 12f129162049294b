"""Alert rules with a memory, each a small fold over the sorted rows of a key."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .folds import fold_sorted
from .near import Near


def iou(a: tuple, b: tuple) -> float:
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h) if w > 0 and h > 0 else 0.0


def cosine(a: list[float], b: list[float]) -> float:
    n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0


@dataclass
class _Rule:
    def end(self) -> list[tuple]:
        return []


@dataclass
class _Votes(_Rule):
    """After ``dwell`` of presence without a gap, enough of the last ``size`` votes agree; then nothing for ``cooldown``."""

    dwell: int
    gap: int
    size: int
    ratio: float
    cooldown: int
    begin: int | None = None
    last: int | None = None
    quiet: int | None = None
    votes: deque = field(default_factory=deque)

    def step(self, ms: int, vote: bool) -> list[tuple]:
        if self.last is None or ms - self.last > self.gap:
            self.begin = ms
            self.votes.clear()
        self.last = ms
        if self.quiet is not None and ms < self.quiet:
            return []
        self.votes.append(bool(vote))
        if len(self.votes) > self.size:
            self.votes.popleft()
        if ms - self.begin < self.dwell or len(self.votes) < self.size or sum(self.votes) < self.ratio * self.size:
            return []
        out = [(ms, sum(self.votes))]
        self.votes.clear()
        self.quiet = ms + self.cooldown
        return out


def votes_with_cooldown(rows: DataFrame, keys: list[str], dwell: int, gap: int, size: int, ratio: float, cooldown: int) -> DataFrame:
    """keys, ms, votes: alerts of rows (keys, ms, vote)."""
    return fold_sorted(rows.selectExpr(*keys, "cast(ms as bigint) ms", "vote"), keys, ["ms", "vote"], lambda: _Votes(dwell, gap, size, ratio, cooldown), "ms bigint, votes int")


@dataclass
class _Burst(_Rule):
    """``least`` detections within ``span``, no two of them nearer than ``spacing``; then nothing for ``quiet``."""

    span: int
    spacing: int
    least: int
    quiet: int
    taken: deque = field(default_factory=deque)
    until: int | None = None

    def step(self, ms: int) -> list[tuple]:
        if self.until is not None and ms < self.until or self.taken and ms - self.taken[-1] < self.spacing:
            return []
        self.taken.append(ms)
        while self.taken[0] < ms - self.span:
            self.taken.popleft()
        if len(self.taken) < self.least:
            return []
        out = [(ms, self.taken[0])]
        self.taken.clear()
        self.until = ms + self.quiet
        return out


def bursts(rows: DataFrame, keys: list[str], span: int, spacing: int, least: int, quiet: int) -> DataFrame:
    """keys, ms, since: alerts of rows (keys, ms)."""
    return fold_sorted(rows.selectExpr(*keys, "cast(ms as bigint) ms"), keys, ["ms"], lambda: _Burst(span, spacing, least, quiet), "ms bigint, since bigint")


@dataclass
class _History(_Rule):
    """The ``size`` latest places that raised an alert, the one used last in front. A candidate on one of them, or one that looks like it nearby, is seen before and brings it to the front."""

    size: int
    overlap: float
    alike: float
    kept: list = field(default_factory=list)

    def step(self, ms: int, id_: int, cls: int, x: float, y: float, w: float, h: float, looks: list[float]) -> list[tuple]:
        box = (x, y, w, h)
        for n, (c, b, v, first) in enumerate(self.kept):
            near = iou(b, box)
            if c == cls and (near > self.overlap or near > 0 and looks is not None and v is not None and cosine(v, looks) > self.alike):
                self.kept.insert(0, (c, box, looks, first))
                del self.kept[n + 1]
                return [(ms, id_, True, first)]
        self.kept.insert(0, (cls, box, looks, id_))
        del self.kept[self.size :]
        return [(ms, id_, False, id_)]


def seen_before(rows: DataFrame, key: str, size: int, overlap: float, alike: float) -> DataFrame:
    """key, ms, id, seen, first: whether each candidate (key, ms, id, cls, x, y, w, h, looks) matches the history, and whose alert it matches."""
    own = rows.selectExpr(key, "cast(ms as bigint) ms", "cast(id as bigint) id", "cast(cls as bigint) cls", *[f"cast({c} as double) {c}" for c in "xywh"], "cast(looks as array<double>) looks")
    return fold_sorted(own, [key], ["ms", "id"], lambda: _History(size, overlap, alike), "ms bigint, id bigint, seen boolean, first bigint")


@dataclass
class _Lines(_Rule):
    """Lines crossed in their order, the last one ``shortest`` to ``longest`` after the first. A first line starts anew; any other out of turn ends the attempt."""

    n: int
    shortest: int
    longest: int
    at: list = field(default_factory=list)

    def step(self, ms: int, line: int) -> list[tuple]:
        if self.at and ms - self.at[0] > self.longest:
            self.at = []
        if line == 0:
            self.at = [ms]
            return []
        if line != len(self.at):
            self.at = []
            return []
        self.at.append(ms)
        if len(self.at) < self.n:
            return []
        first, self.at = self.at[0], []
        return [(first, ms)] if ms - first >= self.shortest else []


def lines_in_order(rows: DataFrame, keys: list[str], n: int, shortest: int, longest: int) -> DataFrame:
    """keys, first, last: passages over lines 0 to n - 1 of crossings (keys, ms, line)."""
    return fold_sorted(rows.selectExpr(*keys, "cast(ms as bigint) ms", "cast(line as int) line"), keys, ["ms", "line"], lambda: _Lines(n, shortest, longest), "first bigint, last bigint")


@dataclass
class _Faces(_Rule):
    """Matches of a person are gathered from the first one on; after ``hold``, or with ``enough`` of them, the best one is told. The person is told again only after ``expire`` without a match."""

    hold: int
    enough: int
    expire: int
    gathered: list = field(default_factory=list)
    told: bool = False
    last: int | None = None

    def step(self, ms: int, camera: int, score: float) -> list[tuple]:
        out = self._due(ms)
        if self.last is not None and ms - self.last > self.expire:
            self.told = False
        self.last = ms
        if not self.told:
            self.gathered.append((score, -ms, camera))
            if len(self.gathered) >= self.enough:
                out += self._tell(ms)
        return out

    def _due(self, ms: int) -> list[tuple]:
        if self.gathered and ms > -self.gathered[0][1] + self.hold:
            return self._tell(-self.gathered[0][1] + self.hold)
        return []

    def _tell(self, at: int) -> list[tuple]:
        score, ms, camera = max(self.gathered)
        out = [(at, -ms, camera, score, len(self.gathered))]
        self.gathered, self.told = [], True
        return out

    def end(self) -> list[tuple]:
        return self._tell(-self.gathered[0][1] + self.hold) if self.gathered else []


def held_matches(rows: DataFrame, person: str, hold: int, enough: int, expire: int) -> DataFrame:
    """person, told_at, ms, camera, score, n: the best of each person's gathered matches (person, ms, camera, score)."""
    own = rows.selectExpr(person, "cast(ms as bigint) ms", "cast(camera as bigint) camera", "cast(score as double) score")
    return fold_sorted(own, [person], ["ms", "camera", "score"], lambda: _Faces(hold, enough, expire), "told_at bigint, ms bigint, camera bigint, score double, n int")


@dataclass
class _Plates(_Rule):
    """A vehicle is told once. A plate that stays where it was told, by overlap, within ``parked`` of its last sighting there, is a parked car's and not told under another id."""

    overlap: float
    parked: int
    told: set = field(default_factory=set)
    still: dict = field(default_factory=dict)  # last sighting of each plate that stays, in the order in which they came
    near: Near = field(default_factory=Near)
    due: deque = field(default_factory=deque)
    came: int = 0

    def step(self, ms: int, vehicle: int, plate: str, x: float, y: float, w: float, h: float) -> list[tuple]:
        box = (x, y, w, h)
        while self.due and ms - self.due[0][0] > self.parked:
            at, k = self.due.popleft()
            if self.still.get(k) == at:  # not sighted since
                del self.still[k]
                self.near.drop(k)
        around = self.near.around(box) if self.overlap >= 0 else self.still
        there = min((k for k in around if iou(self.near.boxes[k], box) > self.overlap), default=None)
        k = self.came if there is None else there
        self.still[k] = ms
        self.near.put(k, box)
        self.due.append((ms, k))
        if there is not None:
            return []
        self.came += 1
        if vehicle in self.told:
            return []
        self.told.add(vehicle)
        return [(ms, vehicle, plate)]


def plates_once(rows: DataFrame, key: str, overlap: float, parked: int) -> DataFrame:
    """key, ms, vehicle, plate: the plates (key, ms, vehicle, plate, x, y, w, h) that are told."""
    own = rows.selectExpr(key, "cast(ms as bigint) ms", "cast(vehicle as bigint) vehicle", "plate", *[f"cast({c} as double) {c}" for c in "xywh"])
    return fold_sorted(own, [key], ["ms", "vehicle", "plate"], lambda: _Plates(overlap, parked), "ms bigint, vehicle bigint, plate string")
