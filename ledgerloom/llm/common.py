"""Shared plumbing: the shared work folder, written tables, ranks over a total order."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..storage import materialise, scratch, work_dir

__all__ = ["materialise", "scratch", "work_dir"]

#: A table of at most so many bytes may be broadcast; larger ones are merge-joined.
BROADCAST_BYTES = 8 << 20
#: A key is hot above this share of all rows, so there are fewer than 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 1000


#: Bytes of rows that a Python worker is sent at once (one row may have more).
BATCH_BYTES = 4 << 20


def arrow_map(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over batches of bounded size; a worker gives back what it freed when a task ends."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _one_thread()
        try:
            yield from function(batches)
        finally:
            _release()

    return df.mapInArrow(run, schema)


@cache
def _one_thread() -> None:
    """Linear algebra of this worker on one thread: a task has one core, and threads that wait for each other spin."""
    try:
        with open("/proc/self/maps") as maps:
            loaded = {line.split()[-1] for line in maps if "blas" in line}
    except OSError:  # another system
        return
    for path in loaded:
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            try:
                getattr(ctypes.CDLL(path), name)(1)
            except (OSError, AttributeError):
                continue


def _release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checked_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", row_bytes: int = 80) -> DataFrame:
    """Broadcast `small` only after counting it; beyond the bound both sides are merge-joined.

    `small` must be a written table, so that counting it is cheap and that beyond the bound
    both sides of the join are plain exchanges, whose skewed partitions Spark splits.
    `row_bytes`: what one of its rows takes in memory, at most.
    """
    most = BROADCAST_BYTES // row_bytes
    if small.limit(most + 1).count() <= most:
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("merge"), on, how)


#: Partial sums met in one task.
FAN_IN = 32


def tree_sum(sums: DataFrame) -> np.ndarray | None:
    """The sum of the float64 vectors in `sums` (at long, counted from 0; sums binary), FAN_IN at a time in a tree; None of no rows."""

    def added(key, group):
        import pandas as pd

        total = sum(np.frombuffer(x) for x in group.sort_values("at")["sums"])
        return pd.DataFrame({"at": [key[0]], "sums": [total.tobytes()]})

    sums = materialise(sums, "sums")
    n = sums.count()
    while n > FAN_IN:
        sums = materialise(sums.withColumn("up", F.expr(f"at div {FAN_IN}L")).groupBy("up").applyInPandas(added, "at long, sums binary"), "sums")
        n = -(-n // FAN_IN)
    total = None
    for r in sums.orderBy("at").toLocalIterator():
        total = np.frombuffer(r["sums"]).copy() if total is None else total + np.frombuffer(r["sums"])
    return total


def ordered(df: DataFrame, cols: list[str], name: str, carry: str | None = None) -> DataFrame:
    """Add `rank`, the position from 0 of each row in the order of `cols` (ties: any order).

    Rows are dealt by range and sorted in their partitions, so no task holds more than a
    partition. `carry` names a numeric column: `before` is then its sum over all earlier rows.
    """
    spark = df.sparkSession
    spread = df.repartitionByRange(shuffle_partitions(spark), *cols).sortWithinPartitions(*cols)
    table = materialise(spread.withColumn("_at", F.monotonically_increasing_id()), name)
    table = table.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    sums = [F.count(F.lit(1)).alias("_n")]
    # one row a partition: as few as the partitions, however large the table
    parts = table.groupBy("_part").agg(*sums)
    earlier = W.Window.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    out = table.join(F.broadcast(parts), "_part").withColumn("rank", F.col("_first") + F.col("_at"))
    return out.drop("_part", "_at", "_first")


def running_sums(df: DataFrame, order: list[str], values: list[str], name: str) -> DataFrame:
    """Replace each decimal column of `values` by its running sum, this row included, in `order`."""
    spark = df.sparkSession
    spread = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    table = materialise(spread.withColumn("_at", F.monotonically_increasing_id()), name)
    table = table.withColumn("_part", F.shiftright("_at", 33))
    parts = table.groupBy("_part").agg(*[F.sum(v).cast("decimal(38,0)").alias(f"_{v}") for v in values])
    earlier = W.Window.orderBy("_part").rowsBetween(W.Window.unboundedPreceding, -1)
    parts = parts.select("_part", *[F.coalesce(F.sum(f"_{v}").over(earlier).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias(f"_{v}") for v in values])
    within = W.Window.partitionBy("_part").orderBy("_at").rowsBetween(W.Window.unboundedPreceding, 0)
    for v in values:
        table = table.withColumn(v, F.sum(v).over(within).cast("decimal(38,0)"))
    out = table.join(F.broadcast(parts), "_part")
    for v in values:
        out = out.withColumn(v, (F.col(v) + F.col(f"_{v}")).cast("decimal(38,0)"))
    return out.drop("_part", "_at", *[f"_{v}" for v in values])


def id_remainder(doc_id: Column, k: int = 5) -> Column:
    """crc32 of the id as text, modulo k; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k).cast("int")


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that `df` lacks, whatever the case."""
    have = {c.lower() for c in df.columns}
    while any(c.startswith(name.lower()) for c in have):
        name += "_"
    return name


def text_hash(text: Column) -> Column:
    """Tells the texts of one id apart; null is the empty text."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def without(docs: DataFrame, gone: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """The rows of `docs` whose (doc_id, text_hash) is not in the written table `gone`, with their columns.

    Of the rows of one (doc_id, text_hash) in `once` any one stays.
    """
    names = [fresh_name(docs, n) for n in ("_hash", "_id", "_none")]
    key = lambda i, h: [h.alias(names[0]), F.coalesce(i.cast("long"), F.lit(0)).alias(names[1]), i.isNull().alias(names[2])]
    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], *key(F.col("doc_id"), text_hash(F.col("text"))))
    left = checked_join(keyed, gone.select(*key(F.col("doc_id"), F.col("text_hash"))), names, "left_anti")
    if once is not None and not once.isEmpty():
        doubled = once.select(*key(F.col("doc_id"), F.col("text_hash")))
        single = checked_join(left, doubled, names, "left_semi").dropDuplicates(names)
        left = checked_join(left, doubled, names, "left_anti").unionByName(single)
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def hot_split_join(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of `rows` with the written table `groups` (one row a key; `size`: its rows).

    Rows of hot keys stay where they are: there are fewer than 1 / HOT_SHARE such keys, whatever
    the input, and they are broadcast. The rest is merge-joined.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) > HOT_SHARE * total)
    few = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.hint("merge"), key)
    return few.unionByName(rest)
