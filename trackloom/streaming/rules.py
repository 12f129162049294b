"""Continuous forms of the event rules. Each takes and gives a streaming (or batch) DataFrame with an event time column ``ts``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def period_counts(events: DataFrame, keys: list[str], period: str, late: str) -> DataFrame:
    """Counts, means and extremes per tumbling period."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", period), *keys)
    return w.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "mean", "lo", "hi")


def appearances(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """First event of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, keys: list[str], gap: str, late: str) -> DataFrame:
    """Presence sessions that a gap closes, with their length in seconds."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    start, end = F.col("session_window.start"), F.col("session_window.end")
    return s.select(*keys, start.alias("start"), end.alias("end"), "n", (end.cast("long") - start.cast("long")).alias("seconds"))


def trigger_presence(triggers: DataFrame, presence: DataFrame, key: str, before: str, after: str, late: str) -> DataFrame:
    """Triggers with presence around them, by an interval join of two streams; those without have a null presence time."""
    t = triggers.withWatermark("ts", late).alias("t")
    p = presence.withWatermark("ts", late).alias("p")
    near = F.expr(f"t.{key} = p.{key} AND p.ts >= t.ts - INTERVAL {before} AND p.ts <= t.ts + INTERVAL {after}")
    return t.join(p, near, "leftOuter").select(F.col(f"t.{key}").alias(key), F.col("t.ts").alias("ts"), F.col("p.ts").alias("presence"))


def _stateful(events: DataFrame, key: str, late: str, expire_ms: int, fold, out: str, state: str) -> DataFrame:
    """``fold(key, rows sorted by ms, state) -> (output rows, new state)`` per key; a key's state goes ``expire_ms`` of event time after its last row."""
    columns = [c.strip().split()[0] for c in out.split(",")]

    def step(k: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            return
        rows = pd.concat(list(batches)).sort_values("ms")
        found, now = fold(k[0], rows, group.get[0] if group.exists else None)
        if now is not None:
            group.update((now,))
            group.setTimeoutTimestamp(int(max(rows["ms"].max(), group.getCurrentWatermarkMs())) + expire_ms)
        yield pd.DataFrame(found, columns=columns).astype({"ms": "int64"})

    timed = events.withColumn("ms", F.unix_millis("ts")).withWatermark("ts", late)
    return timed.groupBy(key).applyInPandasWithState(step, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def debounced(events: DataFrame, key: str, gap_ms: int, late: str, expire_ms: int) -> DataFrame:
    """Events (key, ts) that are ``gap_ms`` after the last that was let through; the state is the time of that one."""

    def fold(k, rows, last):
        out = []
        for t in rows["ms"].tolist():
            if last is None or t >= last + gap_ms:
                out.append((k, t))
                last = t
        return out, last

    return _stateful(events.select(key, "ts"), key, late, expire_ms, fold, f"{key} {events.schema[key].dataType.simpleString()}, ms long", "last long")


def door_states(events: DataFrame, key: str, late: str, expire_ms: int, open_at: float = 66, closed_at: float = 33) -> DataFrame:
    """Transitions of a score (ts, value) between open and closed; scores in between leave the state as it is."""

    def fold(k, rows, now):
        out = []
        for ms, value in rows[["ms", "value"]].itertuples(index=False):
            new = "open" if value >= open_at else "closed" if value < closed_at else now
            if now is not None and new != now:
                out.append((k, ms, f"{now}>{new}"))
            now = new
        return out, now

    return _stateful(events.select(key, "ts", "value"), key, late, expire_ms, fold, f"{key} {events.schema[key].dataType.simpleString()}, ms long, change string", "now string")
