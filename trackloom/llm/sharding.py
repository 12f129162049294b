"""Sharding by longest processing time: groups sorted by size go to the least-loaded shard through a heap.

Rows of a group stay together. A group of at least ``total / (shards * GRAIN)`` is scheduled by itself, of which there can
be ``shards * GRAIN`` at most; smaller groups are first put into ``shards * GRAIN`` bundles by their hash, and the bundles
are scheduled like groups. What the driver holds is thus bounded by arithmetic, not by the data.

Edge cases: a null text has no bytes and forms a group; groups whose hashes collide merely share a shard; equal sizes are
scheduled in order of their key; repeated rows are rows of one group with slots of their own; an empty table stays empty.
Columns of the input stay as they are, whatever they are called, but for those named like an added one, which it replaces.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

#: Scheduled units per shard, of each kind.
GRAIN = 1024
#: Rows of a shard are numbered in so many chunks at a time.
CHUNKS = 64


def schedule(units: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """(key, size) units to shards: largest first, ties by key, each to the least-loaded shard (ties: the lowest)."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for key, size in sorted(units, key=lambda u: (-u[1], u[0])):
        load, s = heapq.heappop(heap)
        out[key] = s
        heapq.heappush(heap, (load + size, s))
    return out


def assign(df: DataFrame, group, size, shards: int, shard: str = "shard") -> DataFrame:
    """Adds ``shard``. group: a long column, equal for rows that must stay together; size: a long column."""
    spark, units = df.sparkSession, shards * GRAIN
    g, s, b, one, rest_ = fresh(df, "group", "size", "bundle", "lone", "rest")
    keyed = df.withColumns({g: group, s: size})
    groups = keyed.groupBy(g).agg(F.sum(s).alias("bytes"))
    total = keyed.agg(F.sum(s)).first()[0] or 0
    alone = F.col("bytes") * units >= F.lit(max(1, total))
    bundle = F.pmod(F.xxhash64(g), F.lit(units))
    # Keys of lone groups are their hash, those of bundles their number; the flag keeps them apart.
    load = groups.groupBy(alone.alias("alone"), F.when(alone, F.col(g)).otherwise(bundle).alias("key")).agg(F.sum("bytes").alias("bytes"))
    rows = load.collect()  # at most 2 * units
    ids = {(r["alone"], r["key"]): i for i, r in enumerate(sorted(rows, key=lambda r: (r["alone"], r["key"])))}
    placed = schedule([(ids[r["alone"], r["key"]], r["bytes"]) for r in rows], shards)
    lone = spark.createDataFrame([(k, placed[i]) for (a, k), i in ids.items() if a], f"{g} long, {one} int")
    rest = spark.createDataFrame([(k, placed[i]) for (a, k), i in ids.items() if not a], f"{b} long, {rest_} int")
    out = keyed.join(F.broadcast(lone), g, "left").withColumn(b, F.when(F.col(one).isNull(), bundle))
    out = out.join(F.broadcast(rest), b, "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c != shard], F.coalesce(one, rest_).alias(shard))


def number(df: DataFrame, order: list, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard: counts of (shard, chunk) give each chunk its first slot, rows are ordered within chunks only."""
    c, n, f, p = fresh(df, "chunk", "n", "first", "place")
    dealt = df.withColumn(c, F.pmod(F.xxhash64(*order), F.lit(CHUNKS)).cast("int"))
    counts = dealt.groupBy(shard, c).agg(F.count(F.lit(1)).alias(n))
    before = F.sum(n).over(Window.partitionBy(shard).orderBy(c).rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select(F.col(shard), F.col(c), F.coalesce(before, F.lit(0)).alias(f))
    place = F.row_number().over(Window.partitionBy(shard, c).orderBy(*order))
    out = dealt.withColumn(p, place).join(F.broadcast(first), [shard, c])
    return out.select(*[F.col(f"`{x}`") for x in df.columns if x != slot], (F.col(f) + F.col(p) - 1).alias(slot))


def shard_documents(docs: DataFrame, shards: int = 40, text: str = "text") -> DataFrame:
    """Adds size, text_crc32, shard and slot to documents: equal texts stay together and shards get near-equal bytes."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16
    crc = F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long")
    sized = docs.withColumns({"size": size, "text_crc32": crc})
    return assign(sized, F.xxhash64(F.col(text)), F.col("size"), shards)
