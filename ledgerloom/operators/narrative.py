"""Item sections, annotated paragraphs and overlapping chunks of filing texts.

Lines, paragraphs and their flags are arrays in the row of their text, so nothing is shuffled but the
section offsets; only the greedy packing of one section, which depends on its own past, runs in Python.

Defined cases: a null or empty text has no chunks; a text without item lines is one section without
item; sections of fewer than 80 characters are left out after their ends are set; a paragraph longer
than a chunk is a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import narrative as nv
from ..functions.text import mask_numbers
from .chunking import pack

LEAST_SECTION = 80


def sections(texts: DataFrame, key: str) -> DataFrame:
    """key, item, heading, start and end (half-open, in characters) of every item section."""
    lines = texts.select(key, F.length("text").alias("_size"), F.posexplode(F.split("text", "\n")).alias("_line", "_body"))
    slim = lines.select(key, "_size", "_line", F.length("_body").alias("_n"), F.regexp_extract(F.trim("_body"), nv.ITEM, 1).alias("item"), F.regexp_extract(F.trim("_body"), nv.ITEM, 2).alias("_title"))
    by_line = W.Window.partitionBy(key).orderBy("_line")
    start = F.coalesce(F.sum(F.col("_n") + 1).over(by_line.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    hits = slim.withColumn("start", start.cast("long")).where("item <> ''")
    out = hits.withColumn("end", F.coalesce(F.lead("start").over(by_line), F.col("_size")).cast("long")).withColumn("item", F.upper("item"))
    title = F.nullif(nv.heading(F.col("_title")), F.lit(""))
    return out.where(f"end - start >= {LEAST_SECTION}").select(key, "item", F.coalesce(title, F.concat(F.lit("Item "), F.col("item"))).alias("heading"), "start", "end")


def section_texts(texts: DataFrame, key: str) -> DataFrame:
    """key, item, heading, start and text of every section; the whole text where there is none."""
    found = sections(texts, key)
    slim = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "item", "heading"))).alias("_s"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end"), F.lit(None).cast("string").alias("item"), F.lit(None).cast("string").alias("heading")))
    both = texts.select(key, "text").where("text IS NOT NULL").join(slim, key, "left").withColumn("_s", F.explode(F.coalesce("_s", whole)))
    cut = F.expr("substring(text, CAST(_s.start + 1 AS INT), CAST(_s.end - _s.start AS INT))")
    return both.select(key, "_s.item", "_s.heading", "_s.start", cut.alias("text"))


def annotated(parts: DataFrame) -> DataFrame:
    """With `paragraphs`: start, end, text, sub (a subheading's own heading) of each paragraph that is not noise, in order."""
    raw = F.split("text", "\n\n")
    # the offset of each piece: what stands before it and the breaks between
    offsets = F.aggregate(
        F.transform("_raw", F.length), F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("n")),
        lambda s, n: F.struct(F.array_append(s["at"], s["n"]).alias("at"), (s["n"] + n + 2).alias("n")), lambda s: s["at"],
    )
    body = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    lead = lambda x: F.length(x) - F.length(F.regexp_replace(x, r"(?U)^\s+", ""))
    whole = F.transform("_raw", lambda x, i: F.struct((F.get(F.col("_at"), i) + lead(x)).alias("start"), body(x).alias("text"), nv.heading(x).alias("own")))
    sub = lambda p: F.when(F.length(p["own"]).between(3, 120) & nv.subheading_of(p["own"]), p["own"])
    full = F.transform("_p", lambda p: F.struct(p["start"], (p["start"] + F.length(p["text"])).alias("end"), p["text"], sub(p).alias("sub")))
    rows = parts.withColumn("_raw", raw).withColumn("_at", offsets).withColumn("_p", whole)
    rows = rows.withColumn("_p", F.filter("_p", lambda p: ~nv.noise_of(p["own"])))
    return rows.withColumn("paragraphs", full).drop("_raw", "_at", "_p")


def _runs(rows: DataFrame, size: int, overlap: int) -> DataFrame:
    """With `runs`: the first paragraph and the number of paragraphs of each chunk."""
    kind = pa.list_(pa.struct([("first", pa.int32()), ("count", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[(p["start"], p["end"]) for p in own or []] for own in batch.column("paragraphs").to_pylist()]
            found = [[{"first": i, "count": j - i} for i, j in pack(own, size, overlap)] for own in spans]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "runs"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{shape}, runs array<struct<first:int,count:int>>")


def narrative_chunks(texts: DataFrame, key: str, size: int = 3500, overlap: int = 450) -> DataFrame:
    """The chunks of every section with item, heading, subheading, path, offsets, raw, masked and retrieval text."""
    rows = annotated(section_texts(texts, key)).drop("text")
    rows = _runs(rows, size, overlap).select(key, "item", "heading", F.col("start").alias("_base"), "paragraphs", F.posexplode("runs").alias("chunk_index", "_r"))
    own = F.slice("paragraphs", F.col("_r.first") + 1, F.col("_r.count"))
    subs = lambda xs: F.filter(F.transform(xs, lambda p: p["sub"]), lambda s: s.isNotNull())
    before = subs(F.slice("paragraphs", F.lit(1), F.col("_r.first") + 1))
    sub = F.coalesce(F.when(F.size(before) > 0, F.try_element_at(before, F.lit(-1))), F.get(subs(own), 0))
    rows = rows.withColumn("_own", own).withColumn("subheading", sub)
    text = F.array_join(F.transform("_own", lambda p: p["text"]), "\n\n")
    rows = rows.select(
        key, "item", "heading", "subheading", F.col("chunk_index").cast("long").alias("chunk_index"), (F.col("_base") + F.get("_own", 0)["start"]).alias("char_start"),
        (F.col("_base") + F.element_at("_own", -1)["end"]).alias("char_end"), text.alias("text_raw"),
    )
    rows = rows.withColumn("text_masked", mask_numbers(F.col("text_raw"))).withColumn("text_sha1", F.sha1("text_masked"))
    path = nv.heading_path(F.col("item"), F.col("heading"), F.col("subheading"))
    return rows.withColumn("heading_path", path).withColumn("retrieval_text", nv.retrieval_text(F.col("item"), F.col("heading"), F.col("subheading"), F.col("text_masked")))


def benchmark_candidates(chunks: DataFrame, filing: str, order: list[str], stop: list[str], per_filing: int, limit: int, seed: str = "") -> DataFrame:
    """Questions from chunks: the best of each filing, equal questions of a filing once, the first `limit` by hash.

    Adds query, label, quality and place. Best: more quality, longer question, then `order`.
    """
    section, sub, masked = F.col("heading"), F.col("subheading"), F.col("text_masked")
    rows = nv.with_query(chunks, stop).where(F.col("query").isNotNull() & nv.benchmarkable(section, sub, masked, F.col("lines")))
    rows = rows.withColumn("quality", nv.candidate_quality(section, sub, F.col("lines"), F.col("query")))
    best = W.Window.partitionBy(filing).orderBy(F.desc("quality"), F.desc(F.length("query")), *order)
    rows = rows.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= per_filing)
    drawn = F.sha1(F.concat_ws("|", F.lit(seed), filing, *[F.col(c).cast("string") for c in order]))
    rows = rows.withColumn("_h", drawn)
    once = W.Window.partitionBy(filing, F.lower("query")).orderBy("_h", *order)
    rows = rows.withColumn("_o", F.row_number().over(once)).where("_o = 1")
    # orderBy with limit keeps `limit` rows a partition, so the window is over no more
    first = rows.orderBy("_h", *order).limit(limit)
    return first.withColumn("place", F.row_number().over(W.Window.orderBy("_h", *order)).cast("long")).drop("_n", "_o", "_h")
