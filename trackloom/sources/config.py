"""Configuration: merged when a plan is made, and small JSON files that are replaced as a whole."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def deep_merge(base: dict, update: dict) -> dict:
    """``base`` with the values of ``update``; where both hold a mapping, the mappings are merged. Neither is changed."""
    out = dict(base)
    for key, value in update.items():
        both = isinstance(out.get(key), dict) and isinstance(value, dict)
        out[key] = deep_merge(out[key], value) if both else value
    return out


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_json(spark: SparkSession, value, path: str) -> None:
    """Writes beside the target and renames, so that a reader sees the old file or the new one."""
    target, fs = _path(spark, path)
    beside, _ = _path(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    try:
        out.write(json.dumps(value, sort_keys=True).encode())
    finally:
        out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.isAbsolute() and target.toUri().getScheme() else fs.getUri())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, target, options)


def read_json(spark: SparkSession, path: str):
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
