"""BM25 over scopes as joins, reranking, and the search for texts that hold claims word for word."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import narrative as nv
from ..functions.text import collapse, tokens


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, pattern: str = "[a-z0-9]+") -> DataFrame:
    """(qid, scope, doc_id, score) of each document that shares a term with a query of its scope.

    docs: scope, doc_id, text; queries: qid, scope, text. Inverse document frequencies are those of
    the scope; documents without tokens count in its size and mean length. Only the terms of the
    queries are looked up: their list is joined before anything is counted by document.
    """
    words = docs.select("scope", "doc_id", tokens(F.col("text"), pattern).alias("words")).withColumn("length", F.size("words"))
    stats = words.groupBy("scope").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean"))
    asked = queries.select("qid", "scope", F.explode(tokens(F.col("text"), pattern)).alias("term")).groupBy("qid", "scope", "term").agg(F.count(F.lit(1)).alias("times"))
    terms = asked.select("scope", "term").distinct()
    tf = words.select("scope", "doc_id", "length", F.explode("words").alias("term")).join(terms, ["scope", "term"], "left_semi")
    tf = tf.groupBy("scope", "term", "doc_id", "length").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df"))
    weighted = tf.join(df, ["scope", "term"]).join(stats, "scope")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean = F.when(F.col("mean") == 0, 1.0).otherwise(F.col("mean"))
    own = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
    weighted = weighted.select("scope", "term", "doc_id", own.alias("w"))
    return asked.join(weighted, ["scope", "term"]).groupBy("qid", "scope", "doc_id").agg(F.sum(F.col("times") * F.col("w")).alias("score"))


def top_k(scored: DataFrame, k: int, keys: list[str], score: str = "score", digits: int = 6) -> DataFrame:
    """The first k rows of each key by score, then id; Spark prunes each partition to k before the shuffle."""
    window = W.Window.partitionBy(*keys).orderBy(F.desc(F.round(score, digits)), "doc_id")
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def with_unscored(scored: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """`scored` and, with score 0, the documents of each query's scope that share no term with it."""
    every = queries.select("qid", "scope").distinct().join(docs.select("scope", "doc_id"), "scope")
    return every.join(scored.select("qid", "doc_id", "score"), ["qid", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def candidates(k: int) -> int:
    """How many documents the first phase takes for the best k."""
    return max(10, 3 * k)


def reranked(scored: DataFrame, queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The best k of max(10, 3 k) candidates of each query.

    What counts: a cue of the query in the heading, the whole subheading in the query, words shared
    with subheading, first line and heading, and a fifth of the score. queries: qid, query; chunks:
    doc_id, heading, subheading, lead. Ties: bonus, score, rank of the first phase.
    """
    first = top_k(scored, candidates(k), ["qid"]).withColumnRenamed("rank", "_first")
    both = first.join(queries.select("qid", "query"), "qid").join(chunks.select("doc_id", "heading", "subheading", "lead"), "doc_id")
    for c in ("query", "heading", "subheading", "lead"):
        both = both.withColumn(c, nv.heading(F.col(c))).withColumn(f"_{c}", nv.query_tokens(F.col(c)))
    low, head = F.lower("query"), F.lower("heading")
    has = lambda *names: F.size(F.array_intersect("_query", F.array(*map(F.lit, names)))) == len(names)
    said = lambda c, phrase: F.contains(c, F.lit(phrase))
    cue = (
        F.when(said(low, "financial statements") & said(head, "financial statements"), 4.0).when(has("management", "discussion", "analysis") & said(head, "management") & said(head, "analysis"), 4.0)
        .when(said(low, "risk factors") & said(head, "risk factors"), 4.0).when(has("business") & (head == "business"), 2.5).otherwise(0.0)
    )
    exact = F.when((F.col("subheading") != "") & F.contains(low, F.lower("subheading")), 2.0).otherwise(0.0)
    shared = lambda c: F.size(F.array_intersect("_query", c))
    both = both.withColumn("bonus", cue + exact + 2.5 * shared("_subheading") + 1.25 * shared("_lead") + 0.5 * shared("_heading"))
    both = both.withColumn("combined", F.col("bonus") + 0.2 * F.round("score", 6))
    order = W.Window.partitionBy("qid").orderBy(F.desc(F.round("combined", 6)), F.desc("bonus"), F.desc(F.round("score", 6)), "_first")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "doc_id", "rank", "combined", "bonus", "score")


def supported(docs: DataFrame, items: DataFrame, block_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id) where the document's text holds the whole item, white space aside, wherever the item begins and ends.

    The items are a query set: they are read on the driver in blocks of bounded size, and every
    document meets each block where it is read, in one pass of an Aho-Corasick automaton. No shuffle.
    Empty items are held by nothing.
    """
    texts = docs.select(F.col("doc_id").cast("long"), collapse(F.coalesce(F.col("text"), F.lit(""))).alias("body"))
    claims = items.select(F.col("item_id").cast("long"), collapse(F.col("text")).alias("claim")).where("claim <> ''")
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long")
    for block in _blocks(claims, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            by_claim: dict[str, list[int | None]] = {}
            for item, claim in sent.value:
                by_claim.setdefault(claim, []).append(item)
            automaton = ahocorasick.Automaton()
            for claim, ids in by_claim.items():
                automaton.add_word(claim, ids)
            automaton.make_automaton()
            for batch in batches:
                rows, found = [], []
                for k, body in enumerate(batch.column("body").to_pylist()):
                    own = {i for _, ids in automaton.iter(body) for i in ids}
                    rows += [k] * len(own)
                    found += own
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(found, pa.int64())], ["doc_id", "item_id"])

        out = out.unionByName(texts.mapInArrow(run, "doc_id long, item_id long"))
    return out.distinct()


def _blocks(claims: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for row in claims.toLocalIterator():  # one partition at a time
        block.append((row[0], row[1]))
        size += len(row[1])
        if size > block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block
