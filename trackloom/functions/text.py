"""Plates, paths, run names, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that recognition confuses, with the cost of taking one for the other.
CONFUSED = [("0", "O", 0.2), ("0", "D", 0.4), ("1", "I", 0.2), ("1", "L", 0.4), ("2", "Z", 0.3), ("5", "S", 0.3), ("6", "G", 0.4), ("8", "B", 0.3)]
_COST = {p: c for a, b, c in CONFUSED for p in ((a, b), (b, a))}


def weighted_distance(a: str | None, b: str | None) -> float | None:
    """Edit distance in which confusable characters cost less to substitute; null if either is."""
    if a is None or b is None:
        return None
    row = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], float(i)
        for j, y in enumerate(b, 1):
            change = last + (0.0 if x == y else _COST.get((x, y), 1.0))
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, change)
    return row[-1]


def plate_similarity(query: Column, seen: Column) -> Column:
    """1 - distance / longer length, by plain edit distance (JVM side)."""
    return 1 - F.levenshtein(query, seen) / F.greatest(F.length(query), F.length(seen), F.lit(1))


def safe_component(name: Column) -> Column:
    return F.regexp_replace(name, "[^0-9A-Za-z._-]", "_")


def run_id(*tags: Column, fps: Column) -> Column:
    """Tags joined by underscores; a rate of 7.5 reads fps7p5."""
    rate = F.regexp_replace(F.regexp_replace(fps.cast("string"), "\\.0$", ""), "\\.", "p")
    return F.concat_ws("_", *tags, F.when(fps.isNotNull(), F.concat(F.lit("fps"), rate)))


def duration(seconds: Column) -> Column:
    """1h02m03s, 2m03s or 3s."""
    s = seconds.cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    long = F.concat(h.cast("string"), F.lit("h"), two(m), F.lit("m"), two(r), F.lit("s"))
    return F.when(h > 0, long).when(m > 0, F.concat(m.cast("string"), F.lit("m"), two(r), F.lit("s"))).otherwise(F.concat(r.cast("string"), F.lit("s")))


def clock24(text: Column, closing: bool) -> Column:
    """Minute of the day of "HH:MM AM"; midnight as the end of a window is the end of the day."""
    hour = F.split(text, "[: ]")[0].cast("int") % 12 + F.when(F.upper(text).endswith("PM"), 12).otherwise(0)
    minute = hour * 60 + F.split(text, "[: ]")[1].cast("int")
    return F.when((minute == 0) & F.lit(closing), 1440).otherwise(minute)


def config_hash(config: Column) -> Column:
    """First 16 hex digits of the sha256 of a map's sorted entries as JSON."""
    return F.substring(F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(config)))), 256), 1, 16)
