"""Aggregations beyond the built-in ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(df: DataFrame, keys: list[str], value: str, p: float, name: str) -> DataFrame:
    """Percentile whose rank is round(p * (n - 1)), halves to even, over the sorted values."""
    n = df.groupBy(*keys).agg(F.count(value).alias("__n"))
    ranked = df.filter(F.col(value).isNotNull()).withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(value)) - 1)
    return ranked.join(n, keys).filter(F.col("__r") == F.bround(p * (F.col("__n") - 1))).select(*keys, F.col(value).alias(name))


def histogram_percentile(df: DataFrame, keys: list[str], bin_: Column, p: float, name: str = "bin") -> DataFrame:
    """First bin at which the cumulative count reaches p of all."""
    counts = df.groupBy(*keys, bin_.alias(name)).agg(F.count(F.lit(1)).alias("__n"))
    total = F.sum("__n").over(Window.partitionBy(*keys))
    so_far = F.sum("__n").over(Window.partitionBy(*keys).orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumns({"__s": so_far, "__t": total}).filter(F.col("__s") >= p * F.col("__t")).groupBy(*keys).agg(F.min(name).alias(name))


def islands(df: DataFrame, keys: list[str], time: str, gap: int) -> DataFrame:
    """keys, island, start, end, n: runs in which consecutive times are at most ``gap`` apart."""
    by = Window.partitionBy(*keys).orderBy(time)
    new = F.when(F.col(time) - F.lag(time).over(by) <= gap, 0).otherwise(1)
    runs = df.withColumn("island", new)
    runs = runs.withColumn("island", F.sum("island").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "island").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("n"))


def runs_of(df: DataFrame, keys: list[str], time: str, state: str) -> DataFrame:
    """keys, state, start, end, n: maximal runs of equal state in time order."""
    by = Window.partitionBy(*keys).orderBy(time)
    new = F.when(F.col(state).eqNullSafe(F.lag(state).over(by)) & F.lag(time).over(by).isNotNull(), 0).otherwise(1)
    runs = df.withColumn("run", new).withColumn("run", F.sum("run").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run", state).agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("n"))
