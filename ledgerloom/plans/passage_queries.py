"""Queries on passages, audit opinions and questions that filings do not answer, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import narrative as nv
from ..operators import narrative_tasks as nt
from ..operators import passages as ps
from ..sources.views import sql as run_sql
from ..sources.views import table
from ..storage import materialise
from . import narrative_queries as nq


def extractive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passage that answers for each chunk, its label, and whether it holds an excluded phrase."""
    planted = "CASE WHEN doc_id % 9 = 0 THEN concat('Forward-Looking Statements', chr(10), chr(10), text_masked) WHEN doc_id % 7 = 0 THEN concat('Accounting policies of it', chr(10), chr(10), text_masked) ELSE text_masked END"
    rows = run_sql(spark, sf_dir, f"SELECT doc_id, heading, subheading, {planted} AS text_masked FROM ({nq.ROWS_SQL}) r").withColumn("lines", nv.content_lines(F.col("text_masked")))
    text, none = F.col("text_masked"), F.lit(None).cast("string")
    rows = rows.withColumn("answer", ps.extractive_answer(text, F.col("lines")))
    label = ps.narrative_label(F.col("heading"), F.col("subheading"), none, text)
    return rows.select("doc_id", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce(label, F.lit("")).alias("label"), ps.excluded(F.col("heading"), F.col("subheading"), text).alias("excluded"))


# planted passages, by document
_OPINION = "In our opinion, the consolidated financial statements present fairly, in all material respects, what they show."
_NONE = "We do not express an opinion on the financial statements of it."
_MATTER = "We identified the valuation of goodwill as a critical audit matter."
CHUNKS_SQL = f"""SELECT source AS filing_id, concat('c', CAST(doc_id AS VARCHAR(12))) AS chunk_id, 'main.htm' AS source_file, CAST(doc_id AS BIGINT) AS char_start, concat('Begin', '. ', CASE doc_id % 9
  WHEN 0 THEN '{_OPINION}' WHEN 1 THEN '{_NONE}' WHEN 2 THEN 'We have audited the accompanying balance sheets of it.' WHEN 3 THEN 'Report of Independent Registered Public Accounting Firm.' WHEN 4 THEN '{_MATTER}'
  WHEN 5 THEN 'There were no critical audit matters and we identified one as a critical audit matter.' WHEN 6 THEN 'How the critical audit matter was addressed in the audit.' ELSE 'In our opinion this is well.' END, ' End of it') AS text
  FROM documents WHERE doc_id % 4 <> 3"""


def audit_opinions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ps.audit_opinions(run_sql(spark, sf_dir, CHUNKS_SQL))
    return out.select("filing_id", "chunk_id", F.col("score").cast("long").alias("score"), "excerpt")


def critical_matters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ps.critical_matters(run_sql(spark, sf_dir, CHUNKS_SQL))
    return out.select("filing_id", "chunk_id", F.col("score").cast("long").alias("score"), "excerpt")


def document_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ps.sentences(table(spark, sf_dir, "documents"), "doc_id").withColumn("fit", ps.fit_sentence(F.col("text")))


_RULES = [(("th", "er"), "first"), (("on",), "second"), (("st", "re"), "third")]


def word_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stem and topic of every distinct word."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), r"[ \n]")).alias("word")).where("word <> ''").distinct()
    return words.select("word", ps.stem(F.col("word")).alias("stem"), F.coalesce(ps.topic(F.col("word"), _RULES), F.lit("")).alias("topic"))


#: Tasks made of each document's first words.
_W = [f"split_part(replace(coalesce(text, ''), chr(10), ' '), ' ', {k})" for k in range(1, 13)]
TASKS_SQL = f"""SELECT concat('t', lpad(CAST(doc_id AS VARCHAR(9)), 7, '0')) AS task_id, source AS filing_id, concat('k', CAST(doc_id % 7 AS VARCHAR(2))) AS ticker, concat('FY', CAST(2020 + doc_id % 4 AS VARCHAR(4))) AS period_key,
  CASE WHEN doc_id % 3 = 0 THEN 'accounting_policy' ELSE 'footnote_note' END AS label, concat('What is said of ', {_W[0]}, ' ', {_W[1]}, '?') AS question, concat({_W[0]}, ' ', {_W[1]}, ' ', {_W[2]}, ' ', {_W[3]}, ' ', {_W[4]}) AS retrieval_query,
  CAST(NULL AS VARCHAR(9)) AS item, concat('Note ', {_W[5]}) AS heading, concat({_W[6]}, ' ', {_W[7]}) AS subheading, CAST(NULL AS VARCHAR(9)) AS heading_path, concat({" , ' ', ".join(_W)}) AS retrieval_text FROM documents WHERE doc_id % 2 = 0 OR doc_id % 5 = 0"""
FOCUS_STOP = ["the", "and", "note"]


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = run_sql(spark, sf_dir, TASKS_SQL)
    return materialise(nt.prepared(tasks.drop("retrieval_text"), None, FOCUS_STOP), "narrative-tasks")


def filing_token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nt.filing_tokens(run_sql(spark, sf_dir, TASKS_SQL)).select("filing_id", F.size("filing_words").cast("long").alias("n"), F.md5(F.array_join("filing_words", " ")).alias("words"))


def narrative_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of five types that the source's filing does not answer, each from the first acceptable donor."""
    return nt.unanswerable(_prepared(spark, sf_dir), nt.filing_tokens(run_sql(spark, sf_dir, TASKS_SQL))).select("source_task", "negative_type", "donor_task", F.md5("question").alias("question"))


def narrative_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions as asked, in capitals, reworded, and of nothing, routed to the tasks of their filing."""
    tasks = _prepared(spark, sf_dir)
    kind = F.pmod(F.xxhash64("task_id"), F.lit(4))
    text = F.when(kind == 0, F.col("question")).when(kind == 1, F.concat(F.upper("question"), F.lit(" ?"))).when(kind == 2, F.concat(F.lit("Tell me of the "), "scope", F.lit(" note: "), "retrieval_query", F.lit(" "), "question")).otherwise("zzz qqq")
    out = nt.routed(tasks.select("filing_id", F.col("task_id").alias("question_id"), text.alias("question"), kind.alias("kind")), tasks)
    return out.select("question_id", F.col("kind").cast("long").alias("kind"), F.coalesce("task_id", F.lit("")).alias("task_id"), F.coalesce("code", F.lit("")).alias("code"))


QUERIES = {f.__name__: f for f in (extractive_answers, audit_opinions, critical_matters, document_sentences, word_topics, filing_token_sets, narrative_negatives, narrative_routing)}


def _ordered_tokens(x: str) -> str:
    found = f"list_filter(regexp_extract_all(lower({x}), {nq._WORDS}), lambda w: w NOT IN {nq._in([*nv.QUERY_STOP, *nv.SUFFIXES, 'num'])})"
    return f"list_filter({found}, lambda w, i: list_position({found}, w) = i)"


def _without(xs: str, *others: str) -> str:
    return f"list_filter({xs}, lambda w: " + " AND ".join(f"NOT list_contains({o}, w)" for o in others) + ")"


def _key(x: str) -> str:
    return f"trim(regexp_replace(lower(trim(regexp_replace({x}, '[\\s\\x0B\\x{{00A0}}]+', ' ', 'g'))), '[\\s?.!]+$', ''))"


_EXCLUDED_SQL = " OR ".join(f"contains(body, {nq._text(p)})" for p in ps.EXCLUDED)
_PREPARED_SQL = f"""WITH t AS ({TASKS_SQL}),
  fw AS (SELECT filing_id, list(DISTINCT w) AS fw FROM (SELECT filing_id, unnest(list_concat({_ordered_tokens('retrieval_text')}, {_ordered_tokens('heading')}, {_ordered_tokens('subheading')})) AS w FROM t) GROUP BY 1),
  a AS (SELECT t.*, coalesce(nullif({nq._heading('subheading')}, ''), nullif({nq._heading('heading')}, ''), 'this note') AS scope, {_ordered_tokens('retrieval_query')} AS qw, {_ordered_tokens('question')} AS uw, {_key('question')} AS qk FROM t),
  b AS (SELECT a.*, {_ordered_tokens('scope')} AS sw, coalesce(fw, []) AS fw FROM a LEFT JOIN fw USING (filing_id)),
  c AS (SELECT *, {_without("list_filter(CASE WHEN len(qw) > 0 THEN qw ELSE uw END, lambda w: w NOT IN ('the', 'and', 'note'))", 'sw')} AS f0 FROM b),
  p AS (SELECT *, CASE WHEN len(f0) > 0 THEN f0 ELSE list_filter(sw, lambda w: w NOT IN ('the', 'and', 'note')) END AS focus FROM c)"""
_TRANSFER = f"list_concat({_without('list_slice(d.focus, 1, 8)', 's.sw')}, {_without(_without('d.qw', 's.fw', 's.sw'), _without('list_slice(d.focus, 1, 8)', 's.sw'))})"
_SCOPE_NEW = _without("d.sw", "s.fw", "s.sw")
_FIRST = f"list_concat(list_slice({_SCOPE_NEW}, 1, 3), list_slice({_without(_without('list_slice(d.focus, 1, 6)', 's.fw', 's.sw'), 'd.sw')}, 1, 3))"
_ATTRIBUTE = f"CASE WHEN len({_FIRST}) >= 2 THEN {_FIRST} ELSE list_slice({_without('d.qw', 's.fw')}, 1, 4) END"

ORACLE_SQL = {
    "extractive_answers": f"""WITH r AS (SELECT doc_id, heading, subheading, CASE WHEN doc_id % 9 = 0 THEN concat('Forward-Looking Statements', chr(10), chr(10), text_masked) WHEN doc_id % 7 = 0 THEN concat('Accounting policies of it', chr(10), chr(10), text_masked) ELSE text_masked END AS t FROM ({nq.ROWS_SQL})),
        e AS (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS i, ps FROM (SELECT doc_id, string_split(t, chr(10) || chr(10)) AS ps FROM r)), h AS (SELECT doc_id, i, trim(regexp_replace(ps[i], '[\\s\\x0B\\x{{00A0}}\\x{{0085}}\\x{{2028}}\\x{{2029}}]+', ' ', 'g')) AS flat, {nq._heading('ps[i]')} AS own FROM e),
        f AS (SELECT doc_id, arg_min(flat, i) AS flat FROM h WHERE NOT {nq._generic('own')} GROUP BY 1),
        w AS (SELECT doc_id, CASE WHEN length(flat) <= 320 THEN flat ELSE coalesce(nullif(regexp_extract(substring(flat, 1, 320), '(?s)^(.+) [^ ]*$', 1), ''), substring(flat, 1, 320)) END AS answer FROM f),
        b AS (SELECT r.*, lower(concat_ws(' ', heading, subheading, t)) AS body FROM r)
        SELECT b.doc_id, coalesce(answer, '') AS answer, CASE WHEN subheading IS NOT NULL AND lower(heading) LIKE '%financial statements%' AND NOT ({_EXCLUDED_SQL}) THEN CASE WHEN contains(body, 'accounting polic') THEN 'accounting_policy' ELSE 'footnote_note' END ELSE '' END AS label,
               ({_EXCLUDED_SQL}) AS excluded FROM b LEFT JOIN w USING (doc_id)""",
    "audit_opinions": f"""WITH c AS ({CHUNKS_SQL}), m AS (SELECT filing_id, max((char_start % 9 = 3)::INT) AS marked FROM c GROUP BY 1),
        s AS (SELECT c.filing_id, chunk_id, char_start, CASE char_start % 9 WHEN 0 THEN 50 WHEN 1 THEN 45 WHEN 2 THEN CASE WHEN marked = 1 THEN 20 END END AS score, CASE char_start % 9 WHEN 0 THEN '{_OPINION}' WHEN 1 THEN '{_NONE}' ELSE 'We have audited the accompanying balance sheets of it.' END AS excerpt FROM c JOIN m USING (filing_id))
        SELECT filing_id, chunk_id, CAST(score AS BIGINT) AS score, excerpt FROM s WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY filing_id ORDER BY score DESC, char_start, chunk_id) = 1""",
    "critical_matters": f"""WITH s AS (SELECT filing_id, chunk_id, char_start, CASE char_start % 9 WHEN 4 THEN 35 WHEN 6 THEN 15 END AS score, CASE char_start % 9 WHEN 4 THEN '{_MATTER}' ELSE 'How the critical audit matter was addressed in the audit.' END AS excerpt FROM ({CHUNKS_SQL}))
        SELECT filing_id, chunk_id, CAST(score AS BIGINT) AS score, excerpt FROM s WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY filing_id ORDER BY score DESC, char_start, chunk_id) = 1""",
    "word_topics": "WITH w AS (SELECT DISTINCT unnest(string_split_regex(coalesce(text, ''), '[ \\n]')) AS word FROM documents), s AS (SELECT word, regexp_replace(lower(word), '^[.''’\\-_]+|[.''’\\-_]+$', '', 'g') AS own FROM w WHERE word <> '') SELECT word, CASE "
    + " ".join(f"WHEN length(own) > {len(e) + 4} AND own LIKE '%{e}' THEN left(own, length(own) - {len(e)})" for e in ps.ENDINGS)
    + " ELSE own END AS stem, CASE WHEN contains(lower(word), 'th') AND contains(lower(word), 'er') THEN 'first' WHEN contains(lower(word), 'on') THEN 'second' WHEN contains(lower(word), 'st') AND contains(lower(word), 're') THEN 'third' ELSE '' END AS topic FROM s",
    "filing_token_sets": f"WITH t AS ({TASKS_SQL}), w AS (SELECT DISTINCT filing_id, unnest(list_concat({_ordered_tokens('retrieval_text')}, {_ordered_tokens('heading')}, {_ordered_tokens('subheading')})) AS w FROM t) SELECT filing_id, count(*) AS n, md5(string_agg(w, ' ' ORDER BY w)) AS words FROM w GROUP BY 1",
    "narrative_negatives": _PREPARED_SQL + f""",
      k AS (SELECT s.task_id AS st, s.filing_id AS fi, 'same_filing_wrong_note' AS ty, d.task_id AS dt, d.filing_id AS df, 'In the ' || s.scope || ' note, ' || regexp_replace(d.question, '[ ?]+$', '') || '?' AS q FROM p s JOIN p d ON s.filing_id = d.filing_id AND s.task_id <> d.task_id AND lower(s.scope) <> lower(d.scope)
        UNION ALL SELECT s.task_id, s.filing_id, 'same_issuer_wrong_period', d.task_id, d.filing_id, 'For this period, does the ' || s.scope || ' note discuss ' || array_to_string(list_slice({_TRANSFER}, 1, 6), ' ') || '?' FROM p s JOIN p d ON s.ticker = d.ticker AND s.filing_id <> d.filing_id AND s.period_key <> d.period_key WHERE len({_TRANSFER}) >= 3
        UNION ALL SELECT s.task_id, s.filing_id, 'unsupported_attribute', d.task_id, d.filing_id, 'Does the ' || s.scope || ' note discuss ' || array_to_string(list_slice({_ATTRIBUTE}, 1, 4), ' ') || '?' FROM p s JOIN p d ON s.label = d.label AND s.filing_id <> d.filing_id WHERE len({_ATTRIBUTE}) >= 2
        UNION ALL SELECT s.task_id, s.filing_id, 'cross_label_query_transfer', d.task_id, d.filing_id, d.question FROM p s JOIN p d ON s.label <> d.label AND s.filing_id <> d.filing_id WHERE len({_without('d.qw', 's.fw')}) >= 3
        UNION ALL SELECT s.task_id, s.filing_id, 'cross_filing_query_transfer', d.task_id, d.filing_id, 'Does the ' || s.scope || ' note discuss ' || array_to_string(list_slice({_TRANSFER}, 1, 6), ' ') || '?' FROM p s JOIN p d ON s.label = d.label AND s.filing_id <> d.filing_id WHERE len({_TRANSFER}) >= 3),
      f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY st, ty ORDER BY df, dt) = 1),
      u AS (SELECT *, {_key('q')} AS qk FROM f), v AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.filing_id = u.fi AND p.qk = u.qk) QUALIFY row_number() OVER (PARTITION BY fi, qk ORDER BY st, ty) = 1)
      SELECT st AS source_task, ty AS negative_type, dt AS donor_task, md5(q) AS question FROM v""",
}
