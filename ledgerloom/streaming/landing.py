"""Structured Streaming over a landing folder of filing packages (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.filings import read_packages, to_facts
from ..storage import materialise


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Append the facts of every new ZIP to a table partitioned by filing; a filing that returns replaces its partition."""

    def store(batch: DataFrame, _: int) -> None:
        writer = to_facts(materialise(read_packages(batch), "landed")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("filing_id").parquet(out)

    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.zip").load(folder)
    named = source.select(F.regexp_extract("path", r"([^/]+)\.zip$", 1).alias("filing_id"), "content")
    return named.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
