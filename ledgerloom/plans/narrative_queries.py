"""Queries on narrative text: sections, paragraph flags, chunks and the questions built from them, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import narrative as nv
from ..operators.narrative import benchmark_candidates, narrative_chunks, sections
from ..sources.views import sql as run_sql

_NL = "chr(10) || chr(10)"
_PIECES = [
    "'FORM 10-K 2024 | Page 3'", "'Item 1. Business'", "'OVERV IEW'", "replace(coalesce(text, ''), chr(10), chr(10) || chr(10))", "'Item 1A: Risk Factors'", "'(continued)'",
    "'Market Risks and Rates'", "coalesce(text, '')", "'Item 2 - Properties'", "'PART II'", "'Item 7'", "'Notes to Consolidated Financial Statements'", "coalesce(text, '')",
]
#: A filing's text made of each document; the same in both engines.
TEXTS_SQL = f"SELECT doc_id, {f' || {_NL} || '.join(_PIECES)} AS text FROM documents"
#: Chunk-shaped rows of each document.
ROWS_SQL = """SELECT doc_id, source AS filing_id, replace(coalesce(text, ''), chr(10), chr(10) || chr(10)) AS text_masked,
  CASE doc_id % 5 WHEN 0 THEN 'Risk Factors' WHEN 1 THEN 'Business' WHEN 2 THEN 'Management''s Discussion and Analysis' WHEN 3 THEN 'Financial Statements' END AS heading,
  CASE doc_id % 3 WHEN 0 THEN 'Credit Losses and Provisions' WHEN 1 THEN 'December 31, 2024' END AS subheading, CAST(1 + doc_id % 9 AS VARCHAR(2)) AS item FROM documents"""
STOP = "also been have include including item management other primarily reported results this while year".split()


def narrative_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(run_sql(spark, sf_dir, TEXTS_SQL), "doc_id").select("doc_id", "item", "heading", "start", "end")


def narrative_chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of every section of every text."""
    return narrative_chunks(run_sql(spark, sf_dir, TEXTS_SQL), "doc_id").drop("text_raw")


def paragraph_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of each text that are noise, subheadings, generic lines and item markers."""
    rows = run_sql(spark, sf_dir, TEXTS_SQL).select("doc_id", F.explode(F.split("text", "\n\n")).alias("p"))
    n = lambda c: F.sum(c.cast("long"))
    p = F.col("p")
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), n(nv.noise(p)).alias("noise"), n(nv.subheading(p)).alias("subheadings"), n(nv.generic_line(p)).alias("generic"),
        n(nv.item_marker(nv.heading(p))).alias("markers"), F.sum(F.length(nv.heading(p))).cast("long").alias("chars"),
    )


def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, ROWS_SQL).withColumn("lines", nv.content_lines(F.col("text_masked")))
    path = nv.heading_path(F.col("item"), F.col("heading"), F.col("subheading"))
    text = nv.retrieval_text(F.col("item"), F.col("heading"), F.col("subheading"), F.col("text_masked"))
    index = nv.index_text(F.col("item"), F.col("heading"), F.col("subheading"), F.col("text_masked"), F.col("lines"))
    return rows.select("doc_id", path.alias("path"), F.md5(text).alias("retrieval"), F.md5(index).alias("indexed"))


def benchmark_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three chunks of each filing as questions, equal ones once, the first forty by hash."""
    out = benchmark_candidates(run_sql(spark, sf_dir, ROWS_SQL), "filing_id", ["doc_id"], STOP, per_filing=3, limit=40, seed="q")
    return out.select("filing_id", "doc_id", "label", "query", F.col("quality").cast("long").alias("quality"), "place")


QUERIES = {f.__name__: f for f in (narrative_sections, narrative_chunk_pack, paragraph_flags, heading_paths, benchmark_questions)}

# --- the same rules as SQL expressions ---

_N = r"[^\s\p{Ll}\p{Lt}]"
_U = r"\p{Lu}"
_MORE = f"{_U}{_N}+|{_N}+{_U}{_N}*"
_LONG = f"{_U}{_N}{{3,}}|{_N}{_U}{_N}{{2,}}|{_N}{{2}}{_U}{_N}+|{_N}{{3,}}{_U}{_N}*"
_SHORT = f"{_U}{_N}{{1,2}}|{_N}{_U}{_N}?|{_N}{{2}}{_U}"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(map(_text, values)) + ")"


def _heading(x: str) -> str:
    flat = rf"trim(regexp_replace({x}, '[\s\x0B\x{{00A0}}\x{{0085}}\x{{2028}}\x{{2029}}]+', ' ', 'g'))"
    # every word between two spaces of its own, so that matches do not share one
    return rf"trim(replace(regexp_replace(' ' || replace({flat}, ' ', '  ') || ' ', ' ({_U})  ({_MORE}) | ({_LONG})  ({_SHORT}) ', ' \1\2\3\4 ', 'g'), '  ', ' '))"


def _alpha(own: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace(lower({own}), '&', ' and '), '[^a-z\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _rx(own: str, pattern: str) -> str:
    return f"regexp_matches({own}, {_text(pattern)})"


def _noise(own: str) -> str:
    counter, bars = _rx(own, r"(?i)(?:\||page\s*)\s*\d+\s*$"), f"(length({own}) - length(replace({own}, '|', '')))"
    header = f"({own} <> '' AND len(string_split({own}, ' ')) <= 14 AND (({_rx(own, r'(?i)\bform\s+10-[kq]\b')} AND ({counter} OR {bars} > 0 OR {_rx(own, r'\b20\d{2}\b')})) OR ({bars} >= 2 AND {counter})))"
    bare = f"({_rx(own, nv.ITEM)} AND trim(regexp_extract({own}, {_text(nv.ITEM)}, 2)) = '')"
    marks = _rx(own, r"(?i)^page\s+\d+$|^\((?:continued|unaudited)\)$|^part\s*[ivx]+$")
    return f"({own} = '' OR {header} OR {marks} OR {_rx(f'replace({own}, {_text(" ")}, {_text("")})', '(?i)^part[ivx]+$')} OR {bare})"


def _subheading(own: str) -> str:
    alpha = f"regexp_extract_all({own}, '[A-Za-z][A-Za-z&''/.-]*')"
    share = lambda test: f"(len(list_filter({alpha}, lambda w: {test}))::DOUBLE / len({alpha}))"
    joined, titled = share(f"lower(w) IN {_in(nv.CONNECTORS)}"), share("regexp_matches(w, '^[A-Z]')")
    capitals, words = share("upper(w) = w AND length(w) > 1"), f"len(string_split({own}, ' '))"
    fits = f"length({own}) BETWEEN 3 AND 120 AND NOT {_rx(own, '[.;?!]$')} AND {words} BETWEEN 1 AND 12 AND len({alpha}) > 0"
    style = f"NOT ({joined} > 0.45 AND len({alpha}) > 4) AND NOT ({words} > 8 AND {capitals} < 0.6) AND ({titled} >= 0.8 OR {capitals} >= 0.6)"
    return f"coalesce(NOT {_noise(own)} AND NOT {_rx(own, nv.ITEM_MARKER)} AND {fits} AND {style}, false)"


def _generic(own: str) -> str:
    low, plain = f"lower({own})", _alpha(own)
    compact = f"replace({plain}, ' ', '')"
    named = f"(len(string_split({own}, ' ')) <= 10 AND len(list_filter(string_split({low}, ' '), lambda w: regexp_replace(w, '[.,]+$', '') IN {_in(nv.SUFFIXES)})) > 0)"
    return (
        f"({own} = '' OR {low} IN {_in(nv.GENERIC_NOTES)} OR {plain} IN {_in(nv.GENERIC_NOTES)} OR (starts_with({compact}, 'notesto') AND contains({compact}, 'financialstatements'))"
        f" OR ((starts_with({low}, 'notes to ') OR starts_with({plain}, 'notes to ')) AND contains({plain}, 'financial statements')) OR contains({low}, 'table of contents') OR contains({plain}, 'index to financial statements')"
        f" OR {_rx(own, r'(?i)^\(\s*tabular amounts .*?(?:as noted|per share data|ratios).*?\)\s*$')} OR {plain} IN ('none', 'none.', 'unaudited', 'continued') OR {_rx(plain, nv.MONTH)}"
        f" OR {_rx(plain, r'^part\s+[ivx]+\s*item\b')} OR {plain} IN {_in(nv.GENERIC_SECTIONS)} OR {_rx(own, nv.ITEM_MARKER)} OR {named})"
    )


def _tokens_sql(x: str) -> str:
    """Distinct words of a text without stop words."""
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), {_WORDS}), lambda w: w NOT IN {_in([*nv.QUERY_STOP, *nv.SUFFIXES, 'num'])}))"


_WORDS = "'" + nv.WORD.replace("'", "''") + "'"


def _questions_sql() -> str:
    stops = _in([*STOP, *nv.QUERY_STOP, *nv.SUFFIXES, "num"])
    query_stops = _in([*nv.QUERY_STOP, *nv.SUFFIXES, "num"])
    words = lambda x: f"regexp_extract_all(lower({x}), {_WORDS})"
    ordered = lambda xs: f"list_filter({xs}, lambda w, i: list_position({xs}, w) = i)"
    return f"""WITH r AS ({ROWS_SQL}),
      p AS (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS i, ps FROM (SELECT doc_id, string_split(text_masked, chr(10) || chr(10)) AS ps FROM r)),
      h AS (SELECT doc_id, i, {_heading('ps[i]')} AS own FROM p),
      g AS (SELECT doc_id, i, own, {_rx('own', nv.ITEM_MARKER)} AS marker, {_generic('own')} AS generic FROM h),
      k AS (SELECT doc_id, own, min(i) AS i FROM (SELECT doc_id, i, own, row_number() OVER (PARTITION BY doc_id, lower(own) ORDER BY i) AS n FROM g WHERE NOT generic) WHERE n = 1 GROUP BY 1, 2),
      c AS (SELECT doc_id, list(own ORDER BY i) AS ls, string_agg(own, chr(10) || chr(10) ORDER BY i) AS body FROM k GROUP BY 1),
      m AS (SELECT doc_id, sum(marker::INT) AS markers FROM g GROUP BY 1),
      a AS (SELECT r.*, ls, body, subheading = 'Credit Losses and Provisions' AS says,
                   CASE WHEN subheading IS NOT NULL AND lower(heading) LIKE '%financial statements%' THEN 'footnote_note' WHEN subheading IS NOT NULL THEN 'subheading_chunk' WHEN heading IS NULL THEN NULL
                        WHEN lower(heading) LIKE '%management%' THEN 'mda' WHEN lower(heading) LIKE '%risk%' THEN 'risk_factors' ELSE 'section_chunk' END AS label
            FROM r JOIN c USING (doc_id) JOIN m USING (doc_id) WHERE markers < 2 AND (heading IS NOT NULL OR coalesce(subheading = 'Credit Losses and Provisions', false))),
      t AS (SELECT *, {words("coalesce(heading, '')")} AS hw, {words("coalesce(subheading, '')")} AS sw, list_filter({words('body')}, lambda w: w NOT IN {stops}) AS bw FROM a),
      kw AS (SELECT *, list_slice({ordered('fw')}, 1, 6) AS ks FROM (SELECT *, list_filter(bw, lambda w: NOT list_contains(hw, w) AND NOT list_contains(sw, w)) AS fw FROM t)),
      q AS (SELECT *, CASE WHEN says THEN subheading ELSE list_filter(ls, lambda x: len({words('x')}) BETWEEN 2 AND 10)[1] END AS title,
                   CASE label WHEN 'footnote_note' THEN CASE WHEN heading IS NOT NULL THEN 'financial statements' END WHEN 'mda' THEN 'management discussion analysis' WHEN 'risk_factors' THEN 'risk factors'
                        ELSE CASE WHEN lower(heading) IN {_in(nv.HEADINGS)} THEN heading END END AS prefix FROM kw),
      b AS (SELECT *, trim(CASE WHEN concat_ws(' ', prefix, title) <> '' THEN concat_ws(' ', prefix, title) || ' ' || array_to_string(ks, ' ') WHEN heading IS NOT NULL THEN heading || ' ' || array_to_string(ks, ' ')
                                ELSE array_to_string(list_slice(ks, 1, 5), ' ') END) AS query FROM q WHERE label IS NOT NULL AND len(ks) > 0),
      s AS (SELECT *, CASE WHEN heading IS NOT NULL THEN 5 ELSE -2 END + CASE WHEN says THEN 3 ELSE 0 END + CASE WHEN subheading = 'December 31, 2024' THEN -6 ELSE 0 END
                   + least(4, len(list_distinct(list_filter({words('ls[1]')}, lambda w: w NOT IN {query_stops})))) + least(4, len(list_distinct(list_filter({words('query')}, lambda w: w NOT IN {query_stops})))) AS quality FROM b),
      w AS (SELECT *, row_number() OVER (PARTITION BY filing_id ORDER BY quality DESC, length(query) DESC, doc_id) AS n, sha1('q|' || filing_id || '|' || doc_id) AS x FROM s),
      u AS (SELECT *, row_number() OVER (PARTITION BY filing_id, lower(query) ORDER BY x, doc_id) AS o FROM w WHERE n <= 3),
      f AS (SELECT *, row_number() OVER (ORDER BY x, doc_id) AS place FROM u WHERE o = 1)
      SELECT filing_id, doc_id, label, query, CAST(quality AS BIGINT) AS quality, place FROM f WHERE place <= 40"""


def _paths_sql() -> str:
    return f"""WITH r AS ({ROWS_SQL}),
      p AS (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS i, ps FROM (SELECT doc_id, string_split(text_masked, chr(10) || chr(10)) AS ps FROM r)),
      h AS (SELECT doc_id, i, {_heading('ps[i]')} AS own FROM p),
      k AS (SELECT doc_id, i, own, row_number() OVER (PARTITION BY doc_id, lower(own) ORDER BY i) AS n FROM h WHERE NOT {_generic('own')}),
      c AS (SELECT doc_id, string_agg(own, chr(10) ORDER BY i) AS body FROM k WHERE n = 1 GROUP BY 1)
      SELECT doc_id, concat_ws(' > ', 'Item ' || item, heading, subheading) AS path,
        md5(concat_ws(chr(10), 'Item: ' || item, 'Section: ' || heading, 'Subsection: ' || subheading, 'Content:', text_masked)) AS retrieval,
        md5(concat_ws(chr(10), 'Item ' || item, heading, CASE WHEN subheading = 'Credit Losses and Provisions' THEN subheading END, coalesce(body, CASE WHEN {_heading('text_masked')} <> '' THEN {_heading('text_masked')} ELSE '' END))) AS indexed
      FROM r LEFT JOIN c USING (doc_id)"""


ORACLE_SQL = {
    "narrative_sections": f"""WITH d AS ({TEXTS_SQL}), l AS (SELECT doc_id, length(text) AS size, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM d)),
        o AS (SELECT doc_id, size, i, trim(ls[i]) AS body, coalesce(sum(length(ls[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l),
        h AS (SELECT *, regexp_extract(body, {_text(nv.ITEM)}, 1) AS item, trim(regexp_extract(body, {_text(nv.ITEM)}, 2)) AS title FROM o),
        s AS (SELECT doc_id, upper(item) AS item, CASE WHEN title <> '' THEN title ELSE 'Item ' || upper(item) END AS heading, CAST(start AS BIGINT) AS start, CAST(coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY i), size) AS BIGINT) AS "end" FROM h WHERE item <> '')
        SELECT * FROM s WHERE "end" - start >= 80""",
    "paragraph_flags": f"""WITH d AS ({TEXTS_SQL}), p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p FROM d), h AS (SELECT doc_id, {_heading('p')} AS own FROM p)
        SELECT doc_id, count(*) AS n, CAST(sum({_noise('own')}::INT) AS BIGINT) AS noise, CAST(sum({_subheading('own')}::INT) AS BIGINT) AS subheadings, CAST(sum({_generic('own')}::INT) AS BIGINT) AS generic,
               CAST(sum({_rx('own', nv.ITEM_MARKER)}::INT) AS BIGINT) AS markers, CAST(sum(length(own)) AS BIGINT) AS chars FROM h GROUP BY 1""",
    "heading_paths": _paths_sql(),
    "benchmark_questions": _questions_sql(),
}
