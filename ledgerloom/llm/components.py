"""Connected components by hooking and contraction, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_join, materialise


def components(links: DataFrame) -> DataFrame:
    """(key, root) for every key of the undirected links (a, b): the same root for all that are connected.

    In a round every key hooks to its smallest neighbour, and the links are drawn again between
    what the keys hooked to; each round has fewer keys, and no component meets in one task.
    """
    edges = materialise(links.select("a", "b").where("a <> b").distinct(), "cc-links")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = materialise(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).select("v", F.least("v", "p").alias("p")), "cc-hooks")
        if labels is None:
            labels = hooks.select(F.col("v").alias("key"), F.col("p").alias("root"))
        else:
            moved = checked_join(labels.withColumnRenamed("root", "v"), hooks, ["v"], "left")
            labels = materialise(moved.select("key", F.coalesce("p", "v").alias("root")), "cc-labels")
        drawn = checked_join(edges.withColumnRenamed("a", "v"), hooks, ["v"]).select(F.col("p").alias("a"), F.col("b").alias("v"))
        drawn = checked_join(drawn, hooks, ["v"]).select("a", F.col("p").alias("b")).where("a <> b")
        edges = materialise(drawn.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links")
        if edges.isEmpty():
            return labels
