"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 of the normalised text. A batch
is reduced to one row per digest before it meets the index, a sort-merge anti-join leaves the
digests the index lacks, and these are appended. Built-in expressions only.

Defined cases: a null text counts as empty, and empty texts are copies of each other; rows that
repeat both id and text are one document and are all marked as kept or dropped together (the
pipeline's stage leaves one of them); a null id never wins over another id; an empty batch leaves
the index as it was; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_join, fresh_name, hot_split_join, materialise, shuffle_partitions, work_dir


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    # a lone space is left alone: only runs that change are rewritten
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t-\r][ \t-\r]*| [ \t-\r]+", " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """Digests seen so far with the id that stays for each, in `buckets` sorted buckets at `path`.

    The number of buckets is stored beside the index (`<path>-settings`) when it is made, and is
    taken from there ever after, whatever the session's settings or the argument say: files
    bucketed by one number and read by another would hide known digests. Files without that
    record, from a writer that was lost before it made one, are refused.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, settings = spark, f"{path}-settings"
        stored = self._stored(settings)
        if stored is None:
            if self._exists(path):
                raise ValueError(f"{path} holds files but no number of buckets: remove it or write {settings}")
            stored = buckets or shuffle_partitions(spark)
            spark.createDataFrame([(stored,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(settings)
        self.buckets = stored
        self.name = "digest_index_" + hashlib.sha1(path.encode()).hexdigest()[:16]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def _stored(self, settings: str) -> int | None:
        return self.spark.read.schema("buckets int").parquet(settings).first()[0] if self._exists(f"{settings}/_SUCCESS") else None

    def close(self) -> None:
        """Take the table out of the catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append_new(self, groups: DataFrame) -> None:
        """Append the digests of `groups` (digest, keep_id; one row each) that the index lacks.

        Running it again after a failure is harmless: what was appended is found by the join.
        """
        fresh = groups.join(self.rows().hint("merge"), "digest", "left_anti").select("digest", "keep_id")
        out = fresh.repartition(self.buckets, "digest").write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
        out.mode("append").saveAsTable(self.name)


def _decided(docs: DataFrame, index: DigestIndex | None) -> tuple[DataFrame, DataFrame]:
    """Written tables: (doc_id, digest) of every row, and (digest, keep_id, group_size) of every digest among them."""
    spark = docs.sparkSession
    own = index or DigestIndex(spark, work_dir(spark, "digest-index"))
    rows = materialise(docs.select(F.col("doc_id").cast("long"), digest(F.col("text")).alias("digest")), "digests")
    groups = materialise(rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "digest-groups")
    own.append_new(groups)
    stays = materialise(groups.drop("keep_id").join(own.rows().hint("merge"), "digest"), "digest-stays")
    if index is None:
        own.close()
    return rows, stays


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """doc_id, keep_id, group_size (rows of this batch), kept and text_sha256 for every row.

    With an index that other batches have filled, keep_id is the id that stayed then.
    """
    rows, stays = _decided(docs, index)
    return hot_split_join(rows, stays, "digest", "group_size").select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of `docs` that stay, with their columns: exactly one of each text, of the smallest id.

    A row is decided by its own text and id; an id that stands for several texts keeps each of
    them that is first of its kind. Of rows that repeat both, any one stays.
    """
    rows, stays = _decided(docs, index)
    marked = hot_split_join(rows, stays, "digest", "group_size")
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = materialise(marked.where(~first).select("digest", "doc_id").distinct(), "exact-gone")
    again = materialise(marked.where(first).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "exact-again")
    own, number = fresh_name(docs, "_digest"), fresh_name(docs, "_id")
    texts = docs.withColumn(own, digest(F.col("text"))).withColumn(number, F.col("doc_id").cast("long"))
    gone = gone.select(F.col("digest").alias(own), F.coalesce("doc_id", F.lit(0)).alias(number), F.col("doc_id").isNull().alias(f"{number}null"))
    texts = texts.withColumn(f"{number}null", F.col(number).isNull()).withColumn(number, F.coalesce(number, F.lit(0)))
    left = checked_join(texts, gone, [own, number, f"{number}null"], "left_anti")
    if not again.isEmpty():
        again = again.withColumnRenamed("digest", own)
        once = checked_join(left, again, [own], "left_semi").dropDuplicates([own])
        left = checked_join(left, again, [own], "left_anti").unionByName(once)
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
