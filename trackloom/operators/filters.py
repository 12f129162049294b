"""Predicates and row filters over detections, entities and findings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import box, ioa


def resolve_policy(keep: set[int] | None, drop: set[int], excluded: set[int] = frozenset()) -> tuple[set[int] | None, set[int]]:
    """Class policy without the excluded ids: they leave the keep set and join the drop set. keep None means all."""
    return (None if keep is None else keep - set(excluded)), drop | set(excluded)


def by_policy(cls: Column, keep: set[int] | None, drop: set[int], missing: int | None = None) -> Column:
    """Drop goes before keep. A missing class passes both, unless ``missing`` gives its stand-in."""
    c = cls if missing is None else F.coalesce(cls, F.lit(missing))
    ok = ~c.isin(*drop) if drop else F.lit(True)
    if keep is not None:
        ok = ok & (c.isin(*keep) if keep else F.lit(False))
    return F.coalesce(ok, F.lit(True))


def remap(cls: Column, mapping: dict[int, int], default: int | None) -> Column:
    """Class id in another space; classes that map to null are to be dropped."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[cls], F.lit(default))


def advance(df: DataFrame, **criteria: object) -> DataFrame:
    """Conjunction of equality (a value) and membership (a collection) predicates."""
    for name, want in criteria.items():
        df = df.filter(F.col(name).isin(*want) if isinstance(want, (list, tuple, set, range)) else F.col(name) == want)
    return df


def zone(cell: Column, green: Iterable[int], red: Iterable[int]) -> Column:
    return F.when(cell.isin(*green), "green").when(cell.isin(*red), "red")


def without_contained(inner: DataFrame, outer: DataFrame, keys: list[str], least: float) -> DataFrame:
    """Boxes of ``inner`` that no box of ``outer`` in the same frame covers to more than ``least`` of their area."""
    a, b = inner.alias("a"), outer.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [ioa(box(alias="a"), box(alias="b")) > least]
    return a.join(b, on, "left_anti")


def attributes_match(have: Column, want: dict[str, list[str]], strict: bool = False) -> Column:
    """Each wanted key has one of its values; a key that is missing passes unless strict. have: map<string, array<string>>."""
    ok = F.lit(True)
    for key, values in want.items():
        found = F.arrays_overlap(have[key], F.array(*[F.lit(v) for v in values]))
        ok = ok & F.coalesce(found, F.lit(not strict))
    return ok


def custom_object_match(ids: Column, positive: list[int], negative: list[int], complete: Column) -> Column:
    """True if a positive id is there and no negative one; null (undecided) while incomplete without a positive id."""
    pos = F.arrays_overlap(ids, F.array(*[F.lit(x).cast("bigint") for x in positive]))
    neg = F.arrays_overlap(ids, F.array(*[F.lit(x).cast("bigint") for x in negative]))
    return F.when(neg, False).when(pos, True).when(complete, False)


def confidence_stage(score: Column, low: Column, high: Column) -> Column:
    return F.when(score >= high, "high").when(score >= low, "low").otherwise("rejected")


def max_mask(df: DataFrame, keys: list[str], value: str, mask: str = "is_max") -> DataFrame:
    return df.withColumn(mask, (F.max(value).over(Window.partitionBy(*keys)) == F.col(value)).cast("int"))


def in_schedule(weekday: Column, minute: Column, times: dict[int, list[tuple[int, int]]]) -> Column:
    """weekday 0 (Sunday) to 6; minute of the day; windows include both ends, and one from 0 to 0 is the whole day."""
    ok = F.lit(False)
    for day, windows in times.items():
        for start, end in windows:
            ok = ok | ((weekday == day) & (F.lit(True) if start == end == 0 else minute.between(start, end)))
    return ok


def normalize_fps(value: Column) -> Column:
    return F.when(~F.lower(F.trim(value)).isin("", "none", "—", "-"), F.expr(f"try_cast({value._jc.toString()} as double)"))


def spaced(df: DataFrame, keys: list[str], time: str, gap: int) -> DataFrame:
    """Rows accepted by a greedy debounce: the first, then each that is ``gap`` after the last accepted.

    What is accepted depends on what was accepted before, which a lag can't tell; an aggregate over each key's ordered times
    folds it without Python. Keys are expected to be bounded (one alert, one camera).
    """
    fold = F.aggregate(
        F.array_sort(F.collect_list(time)),
        F.array().cast("array<bigint>"),
        lambda acc, t: F.when((F.size(acc) == 0) | (t >= F.element_at(acc, -1) + gap), F.array_append(acc, t)).otherwise(acc),
    )
    return df.groupBy(*keys).agg(fold.alias("accepted")).select(*keys, F.explode("accepted").alias(time))
