"""The entity registry: who is there, who is gone, and whom to ignore.

An entity (an id at a camera) is created by its first sighting and updated by later ones. ``gap`` after its last sighting it is
removed; if it is sighted again it is reactivated; ``keep`` gaps and one instant after its last sighting it is purged and
forgotten. An entity that is removed with low mean confidence and without having moved is listed, with its place. A new
entity is listed from the start if it has low confidence or stands, with the same class, on a listed place; it is unlisted
once it has moved far enough (twice as far, if it never was confident). A listed place is forgotten ``listed_for`` after the
last sighting of who was there.

``Registry`` is the fold of one camera. ``registry`` runs it over a table, ``registry_stream`` over a stream, where rows wait
until the watermark has passed them, so that the order of arrival within the allowed lateness doesn't matter, and event-time
timers remove, purge and forget. Both give the same rows up to the watermark.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import fold_sorted
from ..operators.near import Near


@dataclass(frozen=True)
class Options:
    gap: int = 5_000  # time without a sighting after which an entity is removed
    keep: int = 10  # gaps after which it is purged
    confidence: float = 0.5  # below: low
    span: float = 20.0  # movement of the centre, along the longer axis, up to which an entity stands
    place: float = 0.6  # IoU above which a new entity stands on a listed place
    same: float = 0.95  # IoU above which a removed entity's place is listed already
    listed_for: int = 600_000


@dataclass
class Entity:
    first: int
    last: int
    active: bool
    listed: bool
    cls: int
    n: int
    total: float  # of confidence
    best: float
    left: float  # extremes of the centre
    right: float
    top: float
    bottom: float
    box: tuple[float, float, float, float]
    votes: dict[int, int] = field(default_factory=dict)

    @property
    def span(self) -> float:
        return max(self.right - self.left, self.bottom - self.top)


def iou(a, b) -> float:
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / (a[2] * a[3] + b[2] * b[3] - w * h)


#: Result columns of the registry: what happened to which entity, and whether it is listed after that.
RESULT = "ms bigint, id bigint, event string, cls bigint, listed boolean"
#: Columns of a sighting, after the camera.
SIGHTING = ["ms", "id", "cls", "conf", "x", "y", "w", "h"]


class Registry:
    """Entities and listed places of one camera. Times of sightings do not go back."""

    def __init__(self, options: Options):
        self.options = options
        self.entities: dict[int, Entity] = {}
        self.places: dict[int, tuple[int, int, tuple]] = {}  # of an entity: class, last sighting, box
        self.near: dict[int, Near] = {}  # of a class: its places
        self.old: list[tuple[int, int]] = []  # (last sighting, id) of places
        self.due: list[tuple[int, int]] = []  # (time, id) at which an entity may have to change
        self.touched: set[int] = set()
        self.moved_places: set[int] = set()

    def _plan(self, id_: int) -> None:
        e, o = self.entities[id_], self.options
        heapq.heappush(self.due, (e.last + (o.gap if e.active else o.keep * o.gap) + 1, id_))

    def expire(self, until: int) -> list[tuple]:
        """Removes and purges what is due up to a time, in order of time and id."""
        o, out = self.options, []
        while self.due and self.due[0][0] <= until:
            at, id_ = heapq.heappop(self.due)
            e = self.entities.get(id_)
            if e is None or at != e.last + (o.gap if e.active else o.keep * o.gap) + 1:
                continue  # sighted since
            self.touched.add(id_)
            if e.active:
                e.active = False
                if e.listed or (e.total / e.n <= o.confidence and e.span <= o.span):
                    e.listed = True
                    self._list(id_, e, at)
                out.append((at, id_, "removed", e.cls, e.listed))
                self._plan(id_)
            else:
                del self.entities[id_]
                out.append((at, id_, "purged", e.cls, e.listed))
        return out

    def place(self, id_: int, cls: int, last: int, box: tuple) -> None:
        """Lists a place."""
        self._unplace(id_)
        self.places[id_] = (cls, last, box)
        self.near.setdefault(cls, Near()).put(id_, box)
        heapq.heappush(self.old, (last, id_))

    def _unplace(self, id_: int) -> None:
        if id_ in self.places:
            self.near[self.places.pop(id_)[0]].drop(id_)

    def _placed(self, cls: int, box: tuple, over: float) -> bool:
        """Whether a listed place of the class overlaps the box by more than ``over``."""
        near = self.near.get(cls)
        return near is not None and any(iou(near.boxes[k], box) > over for k in (near.around(box) if over >= 0 else near.boxes))

    def _list(self, id_: int, e: Entity, at: int) -> None:
        self._forget(at)
        if not self._placed(e.cls, e.box, self.options.same):
            self.place(id_, e.cls, e.last, e.box)
            self.moved_places.add(id_)

    def _forget(self, at: int) -> None:
        while self.old and self.old[0][0] + self.options.listed_for < at:
            last, id_ = heapq.heappop(self.old)
            if id_ in self.places and self.places[id_][1] == last:
                self._unplace(id_)
                self.moved_places.add(id_)

    def step(self, ms: int, id_: int, cls: int, conf: float, x: float, y: float, w: float, h: float) -> list[tuple]:
        out, o, box = self.expire(ms), self.options, (x, y, w, h)
        cx, cy = x + w / 2, y + h / 2
        e = self.entities.get(id_)
        self.touched.add(id_)
        if e is None:
            self._forget(ms)
            listed = conf < o.confidence or self._placed(cls, box, o.place)
            self.entities[id_] = Entity(ms, ms, True, listed, cls, 1, conf, conf, cx, cx, cy, cy, box, {cls: 1})
            out.append((ms, id_, "created", cls, listed))
            self._plan(id_)
            return out
        if not e.active:
            e.active = True
            out.append((ms, id_, "reactivated", e.cls, e.listed))
        moved = cx < e.left or cx > e.right or cy < e.top or cy > e.bottom
        e.last, e.n, e.total, e.best, e.box = ms, e.n + 1, e.total + conf, max(e.best, conf), box
        e.left, e.right, e.top, e.bottom = min(e.left, cx), max(e.right, cx), min(e.top, cy), max(e.bottom, cy)
        e.votes[cls] = e.votes.get(cls, 0) + 1
        most = max(e.votes, key=lambda c: (e.votes[c], -c))
        if most != e.cls and e.votes[most] > e.votes[e.cls]:
            e.cls = most
            out.append((ms, id_, "changed", e.cls, e.listed))
        if e.listed and moved and e.span > o.span * (1 if e.best > o.confidence else 2):
            e.listed = False
            out.append((ms, id_, "unlisted", e.cls, False))
        self._plan(id_)
        return out

    def end(self) -> list[tuple]:
        """The table ends: what has not come due by then stays as it is."""
        return []


def registry(sightings: DataFrame, camera: str, options: Options) -> DataFrame:
    """camera and ``RESULT`` of sightings (camera, ms, id, cls, conf, x, y, w, h); equal times go by id."""
    rows = sightings.select(camera, *[F.col(c).cast("long").alias(c) for c in SIGHTING[:3]], *[F.col(c).cast("double").alias(c) for c in SIGHTING[3:]])
    return fold_sorted(rows, [camera], SIGHTING, lambda: Registry(options), RESULT)


_STATE = "first bigint, last bigint, active boolean, listed boolean, kind bigint, n bigint, total double, best double, left double, right double, top double, bottom double, box array<double>, kinds array<bigint>, counts array<bigint>"
_PLAIN = [f.name for f in fields(Entity)][:12]


def _packed(e: Entity) -> tuple:
    return (*[getattr(e, name) for name in _PLAIN], list(e.box), list(e.votes), list(e.votes.values()))


def _unpacked(v: tuple) -> Entity:
    return Entity(*v[:12], tuple(v[12]), dict(zip(v[13], v[14], strict=True)))


class Processor(StatefulProcessor):
    """State of a camera: its entities, its listed places, and rows that the watermark has not passed."""

    def __init__(self, options: Options, kind: str):
        self.options, self.kind = options, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entities = handle.getMapState("entities", "id bigint", _STATE)
        self.places = handle.getMapState("places", "id bigint", "kind bigint, last bigint, box array<double>")
        self.waiting = handle.getListState("waiting", "ms bigint, id bigint, kind bigint, conf double, x double, y double, w double, h double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            values = [tuple(r) for r in pdf[SIGHTING].astype({"ms": object, "id": object, "cls": object}).itertuples(index=False, name=None)]
            if values:
                self.waiting.appendList(values)
                first = min([v[0] for v in values] + ([first] if first is not None else []))
        if first is not None:
            self.handle.registerTimer(first)
        yield self._frame(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        fold = Registry(self.options)
        for k, v in self.entities.iterator():
            fold.entities[k[0]] = _unpacked(v)
            fold._plan(k[0])
        for k, v in self.places.iterator():
            fold.place(k[0], v[0], v[1], tuple(v[2]))
        rows = sorted(tuple(r) for r in self.waiting.get())
        now = [r for r in rows if r[0] <= until]
        out = [x for r in now for x in fold.step(*r)] + fold.expire(until)
        later = rows[len(now) :]
        if now:
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
        for id_ in fold.touched:
            if id_ in fold.entities:
                self.entities.updateValue((id_,), _packed(fold.entities[id_]))
            elif self.entities.containsKey((id_,)):
                self.entities.removeKey((id_,))
        for id_ in fold.moved_places:
            if id_ in fold.places:
                cls, last, box = fold.places[id_]
                self.places.updateValue((id_,), (cls, last, list(box)))
            elif self.places.containsKey((id_,)):
                self.places.removeKey((id_,))
        following = [later[0][0]] if later else []
        o = self.options
        following += [e.last + (o.gap if e.active else o.keep * o.gap) + 1 for e in fold.entities.values()]
        if following:
            self.handle.registerTimer(max(min(following), until + 1))
        elif fold.places:  # nobody is left: places are forgotten when they are due
            self.handle.registerTimer(max(min(last for _, last, _ in fold.places.values()) + o.listed_for + 1, until + 1))
            fold._forget(until)
            for id_ in fold.moved_places - set(fold.places):
                if self.places.containsKey((id_,)):
                    self.places.removeKey((id_,))
        yield self._frame(key, out)

    def _frame(self, key, out: list[tuple]) -> pd.DataFrame:
        names = [c.strip().split()[0] for c in RESULT.split(",")]
        pdf = pd.DataFrame(out, columns=names).astype({"ms": "int64", "id": "int64", "cls": "int64", "listed": "bool"})
        pdf.insert(0, self.kind, [key[0]] * len(pdf))
        return pdf.astype({self.kind: object, "event": object})

    def close(self) -> None:
        pass


def registry_stream(sightings: DataFrame, camera: str, late: str, options: Options) -> DataFrame:
    """The registry over a stream of sightings with an event time ``ts``; needs the RocksDB state store.

    Rows that the watermark has passed are dropped, as is usual. A camera's state is bounded by the entities of the last
    ``keep`` gaps, the places of the last ``listed_for`` and the rows of the allowed lateness.
    """
    rows = sightings.withWatermark("ts", late).select(F.col(camera), "ts", F.unix_millis("ts").alias("ms"), *[F.col(c).cast("long").alias(c) for c in SIGHTING[1:3]], *[F.col(c).cast("double").alias(c) for c in SIGHTING[3:]])
    kind = sightings.schema[camera].dataType.simpleString()
    return rows.groupBy(camera).transformWithStateInPandas(statefulProcessor=Processor(options, camera), outputStructType=f"{camera} {kind}, {RESULT}", outputMode="Append", timeMode="EventTime")
