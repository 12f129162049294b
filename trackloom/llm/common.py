"""Shared plumbing of the corpus operators: durable intermediates, Arrow batch mapping, clash-free columns."""

from __future__ import annotations

import contextlib
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker turns into objects at once; bounds its memory whatever the Arrow batch size is.
SLICE_ROWS = 256

#: Rows of an Arrow batch, at most; texts can be long, and the default of 10,000 rows is for narrow ones.
BATCH_ROWS = 1024

#: Spark setting under which an execution's shuffle files go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediates: the cluster's ``spark.checkpoint.dir``; a temp folder only where the master is local and none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_dirs.setdefault(app, tempfile.mkdtemp(prefix="trackloom-"))
    return f"{base.rstrip('/')}/trackloom-{app}"


@contextlib.contextmanager
def dropping_shuffles(spark: SparkSession):
    """Shuffle files of what runs inside go as soon as it is written, not when the driver's JVM happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


class Scratch:
    """Parquet intermediates of one operator call; superseded ones can be dropped early.

    Files stay until ``drop`` because lazily evaluated results read them; ``clear(spark)`` removes all of an application.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def write(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` and reads it back: cuts the lineage, and a lost executor costs no recomputation."""
        path, self._n = f"{self.base}/{self._n}", self._n + 1
        with dropping_shuffles(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def bucketed(self, df: DataFrame, *key: str) -> DataFrame:
        """Writes ``df`` as a table bucketed and sorted by ``key``: later joins on it shuffle only their other side."""
        path, self._n = f"{self.base}/{self._n}", self._n + 1
        n, name = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"trackloom_{uuid.uuid4().hex}"
        with dropping_shuffles(self.spark):
            df.repartition(n, *key).write.bucketBy(n, *key).sortBy(*key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
        out = self.spark.table(name)
        out._scratch_path, out._scratch_table = path, name
        return out

    def discard(self, *tables: DataFrame) -> None:
        """Removes bucketed tables that nothing reads any more."""
        for df in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {df._scratch_table}")
            remove_path(self.spark, df._scratch_path)

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            remove_path(self.spark, df._scratch_path)


def remove_path(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def clear(spark: SparkSession, tags: tuple[str, ...] = ()) -> None:
    """Removes every intermediate of this application, or those of some operators; frames that still read them fail from then on."""
    for tag in tags or ("",):
        for status in _glob(spark, f"{shared_dir(spark)}/{tag}*"):
            remove_path(spark, status.getPath().toString())


def _glob(spark: SparkSession, pattern: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jpath) or []


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` whose function sees at most ``SLICE_ROWS`` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                out = fn(batch.slice(at, SLICE_ROWS))
                if out is not None and out.num_rows:
                    yield out

    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))  # idle workers keep what a batch took
    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    return [next(c for k in itertools.count() if (c := f"__{name}_{k}") not in taken) for name in names]


#: A key is common if it holds this share of the rows, or more; so there are as many common keys at most.
COMMON = 1000


def spread_join(rows: DataFrame, table: DataFrame, key: str, held: str, total: int) -> DataFrame:
    """``rows`` (``total`` of them) with the columns of ``table``, which has each key once and in ``held`` its number of rows.

    Common keys, ``COMMON`` at most by arithmetic, are broadcast, so that none of them gathers its rows in one task; the others are shuffled.
    """
    common = F.col(held) * COMMON >= total
    few = F.broadcast(table.filter(common).drop(held))
    rest = rows.join(F.broadcast(table.filter(common).select(key)), key, "left_anti").join(table.filter(~common).drop(held), key)
    return rows.join(few, key).unionByName(rest)


#: Stands for a null id: it sorts last.
LAST = (1 << 63) - 1


def single_ids(docs: DataFrame, name: str, doc_id: str, text: str, scratch: Scratch) -> DataFrame:
    """``docs`` with a long ``name`` in the order of their ids (null last) that only rows of equal id and equal text (null as empty) share.

    That is the id itself where no two texts have the same. Otherwise rows of one id go by their text's hash: the distinct
    (id, hash) are sorted and numbered once, as a written table that the rows are joined to.
    """
    (own, h1, h2) = fresh(docs, "id", "h1", "h2")
    d = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST))
    if docs.select(d.alias("d")).groupBy("d").count().filter("count > 1").isEmpty():
        return docs.withColumn(name, d)
    raw = utf8(f"`{text}`")
    keyed = docs.withColumns({own: d, h1: F.xxhash64(raw), h2: F.xxhash64(raw, F.lit(1))})
    keys = keyed.select(own, h1, h2).distinct()
    if keys.groupBy(own).count().filter("count > 1").isEmpty():  # repeated rows only
        return docs.withColumn(name, d)
    # Partitions follow one another in the order of ids, and so do the numbers of their rows.
    ranks = scratch.write(keys.repartitionByRange(own, h1, h2).sortWithinPartitions(own, h1, h2).withColumn(name, F.monotonically_increasing_id()))
    return keyed.join(ranks, [own, h1, h2]).drop(own, h1, h2)


def utf8(name: str):
    """The text column as bytes, null as empty: workers then skip decoding."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def fold(of, modulus: int):
    """crc32 of the id as text, modulo; null ids give null."""
    return F.crc32(of.cast("string").cast("binary")) % modulus


def input_bytes(df: DataFrame) -> int:
    """Size of the scanned files as the optimizer knows it (pruned to the selected columns, no job)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
