"""Monitors of a state or score over time: samplers and debounced flags, as folds over sorted groups."""

from __future__ import annotations

from collections import Counter, deque
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import fold_sorted


@dataclass(frozen=True)
class Sampler:
    period: int  # time between samples
    longest: int  # time after which a sample is due even without motion
    latency: int = 3  # samples that are voted over
    valid: int = 2  # votes that a state needs
    motion: float = 1.0  # least motion that calls for a sample

    SAMPLES = "ms bigint, event bigint, state string, denoised string, changed_at bigint, was string, lasted bigint"


class _Samples:
    """A state is taken over once enough of the last samples have it, dated back by a period. Until all of them agree, samples are taken twice as often, motion or not."""

    def __init__(self, o: Sampler):
        self.o, self.last, self.next, self.dense = o, None, None, False
        self.votes: deque = deque(maxlen=o.latency)
        self.current, self.since = None, None

    def step(self, ms: int, event: int, state: str, motion: float) -> list[tuple]:
        o = self.o
        called = self.last is None or self.dense or (motion is not None and motion >= o.motion) or ms - self.last >= o.longest
        if not called or (self.next is not None and ms < self.next):
            return []
        self.last = ms
        self.votes.append(state)
        best, n = max(Counter(self.votes).items(), key=lambda kv: kv[1])  # of equal counts the one met first
        denoised = best if n >= o.valid else None
        changed = was = lasted = None
        if denoised is not None and denoised != self.current:
            changed, was = ms - o.period, self.current
            lasted = changed - self.since if self.since is not None else 0
            self.current, self.since = denoised, changed
        self.dense = n < o.latency
        self.next = ms + (o.period // 2 if self.dense else o.period)
        return [(ms, event, state, denoised, changed, was, lasted)]

    def end(self) -> list[tuple]:
        return []


def sampled(rows: DataFrame, key: str, event: str, options: Sampler) -> DataFrame:
    """key and ``SAMPLES`` of rows (key, ms, event, state, motion): a row per sample, with the change of state that it led to."""
    own = rows.select(key, F.col("ms").cast("long").alias("ms"), F.col(event).cast("long").alias("event"), "state", F.col("motion").cast("double").alias("motion"))
    return fold_sorted(own, [key], ["ms", "event"], lambda: _Samples(options), Sampler.SAMPLES)


@dataclass(frozen=True)
class Quality:
    first: int  # time from the first sample on that calibrates
    period: int  # between samples
    factor: int = 4  # samples are taken so much more often while a flag is examined
    shortest: int = 1  # but never more often than this
    consecutive: int = 3  # results in a row that turn the debounced flag
    transition: int = 1  # time after which degradation lasts
    quantile: float = 0.1
    bias: float = 0.0

    FLAGS = "ms bigint, event bigint, threshold double, degraded boolean, debounced boolean, state string, flag int"


def quantile(values: list[float], q: float) -> float:
    """Quantile with linear interpolation."""
    v = sorted(values)
    at = q * (len(v) - 1)
    low = int(at)
    return v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * (at - low)


class _Flags:
    """Regular; examined more densely once a sample is degraded; in transition while short degradation lasts. Flags: 0 none, 1 short, 2 lasting."""

    def __init__(self, o: Quality):
        self.o, self.begin, self.scores, self.threshold = o, None, [], None
        self.next, self.state, self.start, self.flag = None, "regular", None, 0
        self.anchor, self.row, self.resumes = False, 0, None

    def _enter(self, state: str, start: int) -> None:
        self.state, self.start = state, start

    def _dense(self) -> int:
        return max(self.o.shortest, self.o.period // self.o.factor)

    def step(self, ms: int, event: int, score: float) -> list[tuple]:
        o = self.o
        if score is None:
            return []
        self.begin = ms if self.begin is None else self.begin
        if self.next is not None and ms < self.next:
            return []
        if ms - self.begin < o.first:
            self.scores.append(score)
            self.next = ms + o.period
            return []
        if self.threshold is None:
            self.threshold = quantile(self.scores, o.quantile) - o.bias
            self.scores = []
        bad, wait = score <= self.threshold, o.period
        if bad == self.anchor:
            self.row = 0
        else:
            self.row += 1
            if self.row >= o.consecutive:
                self.anchor, self.row = bad, 0
        if self.state == "regular":
            if bad:
                self._enter("examined", ms)
                self.row = 0
        elif self.state == "examined":
            if ms - self.start >= o.period:
                self._enter("transition", ms)
                self.flag, self.resumes = 1, None
            elif self.row == 0:
                if not self.anchor:
                    self._enter("regular", ms)
                    self.flag, self.resumes = 0, None
                elif self.resumes is not None:  # one good sample was noise: the transition goes on from its own start
                    self._enter("transition", self.resumes)
                    self.resumes = None
                else:
                    self.flag = 1
        elif not bad and self.resumes is None and self.flag < 2:
            self.resumes = self.start
            self._enter("examined", ms)
            self.row = 0
        elif ms - self.start >= o.transition:
            if self.anchor:
                self.flag = 2
            else:
                self._enter("regular", ms)
                self.flag = 0
        if self.state == "examined":
            wait = self._dense()
        self.next = ms + wait
        return [(ms, event, self.threshold, bad, self.anchor, self.state, self.flag)]

    def end(self) -> list[tuple]:
        return []


def quality(rows: DataFrame, key: str, event: str, options: Quality) -> DataFrame:
    """key and ``FLAGS`` of rows (key, ms, event, score): a row per sample after the calibration. What is held of a group is its first period's samples."""
    own = rows.select(key, F.col("ms").cast("long").alias("ms"), F.col(event).cast("long").alias("event"), F.col("score").cast("double").alias("score"))
    return fold_sorted(own, [key], ["ms", "event"], lambda: _Flags(options), Quality.FLAGS)
