"""Tables that are written: upserts, once-only inserts, JSON lines, CSV, immutable and staged outputs.

Every write goes through Spark's committer, so a lost executor leaves nothing half done. An upsert
rewrites only the partitions that its rows touch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..storage import delete


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def last_write(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows of one key the last in `order`."""
    place = F.row_number().over(W.Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_n", place).where("_n = 1").drop("_n")


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], order: str, partition: str) -> None:
    """Rows replace those of equal keys in the table at `path`; within the batch the last in `order` counts.

    `partition` is one of the keys: only its values among the rows are rewritten.
    """
    fresh = last_write(rows, keys, order).drop(order)
    if exists(spark, path):
        from ..storage import materialise

        touched = fresh.select(partition).distinct()
        # rewritten partitions are read before they are replaced
        old = spark.read.schema(fresh.schema).parquet(path).join(touched, partition, "left_semi").join(fresh.select(*keys), keys, "left_anti")
        fresh = materialise(fresh.unionByName(old.select(*fresh.columns)), "upsert")
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def insert_missing(spark: SparkSession, path: str, rows: DataFrame, keys: list[str]) -> None:
    """Append the rows whose keys the table at `path` lacks, once each."""
    fresh = rows.dropDuplicates(keys)
    if exists(spark, path):
        fresh = fresh.join(spark.read.schema(rows.schema).parquet(path).select(*keys), keys, "left_anti")
    fresh.write.mode("append").parquet(path)


def replace_filings(path: str, rows: DataFrame) -> None:
    """Replace everything of the filings among the rows: delete and insert by partition."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("filing_id").parquet(path)


def write_json_lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, its fields in the order of their names, nulls kept."""
    rows.select(*[F.col(f"`{c}`") for c in sorted(rows.columns)]).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str, columns: list[str], mode: str = "errorifexists") -> None:
    """The named columns with a header; a column that the rows lack is empty."""
    rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]).write.mode(mode).option("header", True).csv(path)


def publish(rows: DataFrame, path: str) -> None:
    """Write once: an output that is there already is an error, never overwritten."""
    rows.write.mode("errorifexists").parquet(path)


def swap(spark: SparkSession, staged: str, live: str) -> None:
    """Put a whole staged table in the place of the live one; a staged one without its success marker is refused."""
    if not exists(spark, f"{staged}/_SUCCESS"):
        raise ValueError(f"{staged} is not whole")
    jvm = spark.sparkContext._jvm
    new, at, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (staged, live, f"{live}.previous"))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(old):
        delete(spark, f"{live}.previous")
    if fs.exists(at) and not fs.rename(at, old):
        raise OSError(f"{live} can't be set aside")
    if not fs.rename(new, at):
        fs.rename(old, at)
        raise OSError(f"{staged} can't be put in place")
