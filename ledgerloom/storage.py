"""Intermediate tables in the folder that driver and executors share, and their removal."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; without that setting a temporary one, on a single machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/ledgerloom/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back: lineage ends there."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Remove at the end what was written inside, but for what the yielded function wrote.

    Frames that read other tables of the block must not be used after it.
    """
    first, kept = len(_written), set()

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = materialise(df, name)
        kept.add(_written[-1])
        return out

    yield keep  # an error leaves the tables for inspection
    for path in _written[first:]:
        if path not in kept:
            delete(spark, path)
    _written[first:] = [p for p in _written[first:] if p in kept]
