"""Shards that all hold the sources in the same mixture: proportional stratified interleaving.

Within each source the rows are put in a seeded order and ranked; rank r of n becomes the
fraction (2r + 1) / 2n; all rows are sorted by that fraction and cut into runs whose counts
differ by one at most. Each run then holds a proportional stretch of every source. Built-in
expressions only; both rankings are dealt by range, so a source of any size is split.

Defined cases: rows of a null source form a source of their own; a null text has size 8 and the
checksum of the empty text; a null id is ordered first; repeated rows are placed like any others;
with fewer rows than shards the first shards of the cut hold them; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_join, materialise, ordered


def proportional_shards(docs: DataFrame, n_shards: int = 24, seed: str = "ledgerloom") -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot and grown_shard (null: the law is `rows`)."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.select(
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    base = base.withColumn("stratum", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    base = base.withColumn("draw", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    base = materialise(base, "shard-rows")  # the range sampling below then reads short rows only
    tie = ["draw", "doc_id", "text_crc32"]
    ranked = materialise(ordered(base, ["stratum", *tie], "shard-strata"), "shard-ranked")
    strata = materialise(ranked.groupBy("stratum").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")), "shard-counts")
    total = strata.agg(F.sum("n")).first()[0] or 0
    frac = (2 * (F.col("rank") - F.col("first")) + 1).cast("double") / (2 * F.col("n")).cast("double")
    mixed = materialise(checked_join(ranked, strata, ["stratum"]).withColumn("frac", frac).drop("rank", "first", "n"), "shard-fractions")
    placed = ordered(mixed, ["frac", *tie], "shard-order")
    shard = F.expr(f"(rank * {n_shards}L) div {max(total, 1)}L")
    placed = placed.withColumn("shard", shard.cast("int"))
    slot = F.expr(f"rank - ((shard * {total}L + {n_shards - 1}L) div {n_shards}L)")
    return placed.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
