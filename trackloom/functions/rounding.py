"""Rounding as the oracles do it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, places: int) -> Column:
    """A double rounded half away from zero after it is scaled, as DuckDB does; Spark's ``round`` rounds the shortest decimal form, so ties fall otherwise."""
    return F.round(value.cast("double") * 10.0**places, 0) / 10.0**places
