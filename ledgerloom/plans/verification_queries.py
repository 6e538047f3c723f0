"""Queries on proposals, packs, profiles and releases, all made of the star schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import verification as vf
from ..sources.views import sql as run_sql
from ..sources.views import table

#: One task a line; its remainders by 11, 7 and 5 say what is wrong with proposal, observation and computation.
PROPOSALS_SQL = """SELECT concat(CAST(l_orderkey AS VARCHAR(12)), '-', CAST(l_linenumber AS VARCHAR(3)), '-', CAST(l_partkey AS VARCHAR(9))) AS id, CAST(l_quantity AS VARCHAR(20)) AS v, CAST(l_partkey % 11 AS INT) AS a, CAST(l_suppkey % 7 AS INT) AS b, CAST(l_orderkey % 5 AS INT) AS c, CAST(l_linenumber % 2 AS INT) AS r FROM lineitem"""


def proposal_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals with their failed checks and what becomes of them."""
    rows = run_sql(spark, sf_dir, PROPOSALS_SQL)
    a, b, c, r, i, v = (F.col(x) for x in ("a", "b", "c", "r", "id", "v"))
    ids = lambda *x: F.array(*[F.lit(y) for y in x]).cast("array<string>")
    none = F.lit(None).cast("string")
    refused = c == 0  # the evidence refuses
    status = F.when(refused, "REFUSAL").otherwise("OK")
    value, unit, code = F.when(~refused, v), F.when(~refused, F.lit("usd")), F.when(refused, "MISSING_INPUT")
    found = F.when(refused, ids()).otherwise(ids("e1", "e2"))
    task = F.struct(i.alias("task_id"), F.lit("f").alias("filing_id"), F.lit("m").alias("metric"), F.lit("FY1").alias("period_key"), ids("e1", "e2", "e3").alias("evidence_ids"), ids("MISSING_INPUT", vf.INJECTION).alias("allowed_codes"), (a == 9).alias("hostile"))
    action = F.when(a == 1, "GUESS").when(refused | (a == 10) | ((a == 9) & (b < 4)), "REFUSE").otherwise("ANSWER")
    proposal = F.struct(
        F.when(a == 0, "another").otherwise(i).alias("task_id"), action.alias("action"), F.when(a == 2, "FY2").otherwise("FY1").alias("period_key"), F.when(action == "ANSWER", F.when(a == 3, "1").otherwise(F.concat(v, F.lit("0")))).alias("value"),
        F.when(action == "ANSWER", F.when(a == 4, "eur").otherwise("iso4217:USD")).alias("unit"), F.when(a == 5, "text").otherwise(none).alias("answer_text"), F.lit(0).alias("n_claims"),
        F.when(a == 6, ids("e9")).when(a == 7, ids("e1")).otherwise(found).alias("evidence_ids"), F.when(action == "REFUSE", F.when(a == 9, vf.INJECTION).when(a == 10, "OTHER").otherwise("MISSING_INPUT")).alias("refusal_code"),
    )
    seen = F.struct(
        i.alias("task_id"), F.when(b == 1, "g").otherwise("f").alias("filing_id"), F.lit("m").alias("metric"), F.when(b == 2, "FY2").otherwise("FY1").alias("period_key"), status.alias("status"), F.when(b == 3, F.concat(F.lit("9"), value)).otherwise(value).alias("value"),
        unit.alias("unit"), found.alias("evidence_ids"), code.alias("refusal_code"),
    )
    computed = F.struct(status.alias("status"), value.alias("value"), unit.alias("unit"), found.alias("evidence_ids"), code.alias("refusal_code"))
    rows = rows.select("id", task.alias("task"), proposal.alias("proposal"), F.when(b != 0, seen).alias("observation"), computed.alias("computed"), r.alias("repairs"))
    out = vf.verify_quant(rows)
    return out.groupBy(F.array_join("failed", ",").alias("failed"), "disposition").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("checks")).cast("long").alias("n_checks"))


def context_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as evidence of their order: packs in order of rank, or why there is none."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("task_id"), F.concat(F.lit("e"), F.col("l_partkey").cast("string")).alias("evidence_id"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_linenumber").cast("int")).alias("rank"),
        F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("content"), F.col("l_quantity"),
    )
    out = vf.context_packs(rows, F.col("l_quantity").cast("long") * 100, fixed=1000)
    return out.select("task_id", "n_items", "n_tokens", F.coalesce("code", F.lit("")).alias("code"), F.coalesce(F.array_join(F.transform("pack", lambda e: e["evidence_id"]), ","), F.lit("")).alias("pack"))


def gold_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a planted key at some depth, or the word elsewhere."""
    body = F.concat(F.lit('{"a":{"b":[{"'), F.element_at(F.array(*map(F.lit, ["text", "Gold_Value", "targets", "solution"])), (F.col("doc_id") % 4 + 1).cast("int")), F.lit('" : "target"}]}}'))
    return table(spark, sf_dir, "documents").select("doc_id", vf.leaks_gold(body).alias("leaks"))


INPUTS_SQL = """SELECT CAST(l_orderkey AS BIGINT) AS task_id, CASE WHEN l_suppkey % 5 = 0 THEN NULL WHEN l_suppkey % 2 = 0 THEN 'usd' ELSE 'pure' END AS unit, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE concat('c', CAST(l_partkey % 4 AS VARCHAR(3))) END AS context_id,
  CAST(CASE WHEN l_orderkey % 4 = 0 THEN -1 WHEN l_orderkey % 4 = 1 THEN 0 ELSE l_partkey % 3 END AS INT) AS d, CASE WHEN l_linenumber % 2 = 0 THEN 'prior_year_period_end_asof' ELSE 'current_period_end_asof' END AS selector,
  CASE WHEN l_partkey % 13 = 0 THEN 'ASOF_20241399' WHEN l_partkey % 11 = 0 THEN 'FY2024' ELSE concat('ASOF_2024', CASE WHEN l_orderkey % 7 < 5 THEN '1231' ELSE concat('0', CAST(1 + l_linenumber AS VARCHAR(2)), '01') END) END AS period_key FROM lineitem WHERE l_linenumber < 9"""


def input_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, INPUTS_SQL)
    dims = F.when(F.col("d") == 0, F.create_map().cast("map<string,string>")).when(F.col("d") > 0, F.create_map(F.lit("axis"), F.col("d").cast("string")))
    out = vf.profiles(rows.withColumn("dimensions", dims), ["task_id"])
    return out.select("task_id", "unit_profile", "context_profile", F.when(F.length("dimension_profile") == 16, "DIGEST").otherwise(F.col("dimension_profile")).alias("dimension_profile"))


def asof_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vf.asof_bindings(run_sql(spark, sf_dir, INPUTS_SQL), "task_id")


_ASKED = [
    "What does the footnote of K1 say of leases in 2024?", "What accounting policy does K1 follow for its leases in 2024?", "What does K1 say?", "What does the footnote of K1 say of leases in 2024? Really", "What does the footnote of ZZ say of leases in 2024?",
    "What does the footnote of K1 say of leases in that year?", "What does the note of K1 say of its leases in 2024?", "Financial statements of K1 with a footnote on leases in 2024?", " What does the footnote of K1 say of leases in 2024?", "What does the  footnote of K1 say of leases in 2024?",
]


def question_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten questions, dealt to the orders, with what is wrong with them."""
    text = F.element_at(F.array(*map(F.lit, _ASKED)), (F.col("o_orderkey") % 10 + 1).cast("int"))
    kind = F.when(F.col("o_orderkey") % 10 == 1, "accounting_policy").otherwise("footnote_note")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(vf.question_problem(text, F.lit("k1"), F.lit("Name Of It"), F.lit("FY2024"), kind), F.lit("")).alias("problem"))


def release_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between a release of orders and the next."""
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 6 > 0, F.col("o_orderpriority")).alias("priority"))
    new = old.where("id % 9 <> 0").withColumn("status", F.when(F.col("id") % 4 == 0, "X").otherwise(F.col("status"))).withColumn("priority", F.when(F.col("id") % 10 == 0, "none").otherwise(F.col("priority")))
    new = new.unionByName(old.where("id % 8 = 0").withColumn("id", -F.col("id") - 1))
    return vf.changed(old, new, "id", ["status", "priority"]).groupBy("change", F.array_join("columns", ",").alias("columns")).agg(F.count(F.lit(1)).alias("n"))


def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of a corpus whose issuers are customers and whose filings are orders."""
    issuers = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 7 > 0, F.col("c_custkey")).alias("cik"), F.when(F.col("c_custkey") % 7 == 0, "unresolved").when(F.col("c_custkey") % 5 == 0, "duplicate_cik").otherwise("resolved").alias("status"))
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    state = lambda test, yes, no: F.when(test, yes).otherwise(no)
    filings = o.select(state(F.col("o_orderkey") % 4 > 0, "resolved", "missing").alias("status"))
    downloads = o.where("o_orderkey % 4 > 0").select(F.when(F.col("o_orderkey") % 9 == 0, "failed").when(F.col("o_orderkey") % 3 == 0, "cached").otherwise("downloaded").alias("status"))
    ingests = o.where("o_orderkey % 4 > 0 AND o_orderkey % 9 > 0").select(state(F.col("o_orderkey") % 10 > 0, "ingested", "error").alias("status"))
    return vf.data_quality(issuers, filings, downloads, ingests)


QUERIES = {f.__name__: f for f in (proposal_verification, context_packs, gold_leaks, input_profiles, asof_bindings, question_checks, release_changes, data_quality)}

_AFTER = "k.sv AND NOT k.other AND NOT k.stops"
ORACLE_SQL = {
    "proposal_verification": f"""WITH x AS ({PROPOSALS_SQL}),
      y AS (SELECT *, c = 0 AS refused, CASE WHEN a = 1 THEN 'GUESS' WHEN c = 0 OR a = 10 OR (a = 9 AND b < 4) THEN 'REFUSE' ELSE 'ANSWER' END AS action, a = 0 AS other, a = 9 AS hostile, b <> 0 AS seen FROM x),
      z AS (SELECT *, action <> 'GUESS' AS sv, action = 'REFUSE' AS ref, action = 'ANSWER' AS ans, CASE WHEN action = 'REFUSE' THEN CASE WHEN a = 9 THEN '{vf.INJECTION}' WHEN a = 10 THEN 'OTHER' ELSE 'MISSING_INPUT' END END AS pc FROM y),
      k AS (SELECT *, hostile AND ref AND pc = '{vf.INJECTION}' AS stops FROM z),
      l AS (SELECT *, CASE WHEN NOT other THEN ['SCHEMA_VALID' || CASE WHEN sv THEN '+' ELSE '-' END] ELSE [] END || ['TASK_MATCH' || CASE WHEN other THEN '-' ELSE '+' END]
        || CASE WHEN sv AND NOT other THEN ['EVIDENCE_VALID' || CASE WHEN a = 6 THEN '-' ELSE '+' END, 'PERIOD_MATCH' || CASE WHEN a = 2 THEN '-' ELSE '+' END, 'PROMPT_INJECTION_CLEAR' || CASE WHEN hostile AND NOT coalesce(pc = '{vf.INJECTION}', false) THEN '-' ELSE '+' END] ELSE [] END
        || CASE WHEN sv AND NOT other AND ref AND (stops OR seen) THEN ['REFUSAL_VALID' || CASE WHEN stops OR (pc = 'MISSING_INPUT' AND refused) THEN '+' ELSE '-' END] ELSE [] END
        || CASE WHEN {_AFTER} THEN ['TOOL_OBSERVATION_PRESENT' || CASE WHEN seen THEN '+' ELSE '-' END] ELSE [] END
        || CASE WHEN {_AFTER} AND seen THEN ['OBSERVATION_SCOPE_VALID' || CASE WHEN b = 1 THEN '-' ELSE '+' END, 'OBSERVATION_PERIOD_MATCH' || CASE WHEN b = 2 THEN '-' ELSE '+' END, 'STATUS_MATCH' || CASE WHEN ans = NOT refused THEN '+' ELSE '-' END,
             'CITATIONS_MATCH' || CASE WHEN a = 6 OR (a = 7) THEN '-' ELSE '+' END, 'OBSERVATION_EVIDENCE_VALID' || CASE WHEN b = 2 OR (b = 3 AND NOT refused) THEN '-' ELSE '+' END] ELSE [] END
        || CASE WHEN {_AFTER} AND seen AND ans THEN ['ANSWER_SHAPE_VALID' || CASE WHEN a = 5 THEN '-' ELSE '+' END, 'VALUE_MATCH' || CASE WHEN refused OR (a = 3 AND CAST(v AS DOUBLE) <> 1) THEN '-' ELSE '+' END,
             'ARITHMETIC_VALID' || CASE WHEN refused OR (a = 3 AND CAST(v AS DOUBLE) <> 1) OR b = 3 THEN '-' ELSE '+' END, 'UNIT_MATCH' || CASE WHEN refused OR a = 4 THEN '-' ELSE '+' END] ELSE [] END AS ch FROM k),
      f AS (SELECT *, list_transform(list_filter(ch, lambda t: t LIKE '%-'), lambda t: left(t, length(t) - 1)) AS failed FROM l)
      SELECT array_to_string(failed, ',') AS failed, CASE WHEN len(failed) = 0 AND ans THEN 'RELEASED' WHEN len(failed) = 0 THEN 'SAFE_REFUSAL' WHEN r >= 1 OR other THEN 'FAILED' ELSE 'REPAIR_REQUIRED' END AS disposition, count(*) AS n, CAST(sum(len(ch)) AS BIGINT) AS n_checks FROM f GROUP BY 1, 2""",
    "context_packs": """WITH e AS (SELECT l_orderkey AS task_id, 'e' || l_partkey AS id, CASE WHEN l_suppkey % 3 > 0 THEN l_linenumber ELSE 2147483647 END AS rk, CAST(l_quantity AS BIGINT) * 100 AS t FROM lineitem),
        g AS (SELECT task_id, count(*) AS n_items, CAST(sum(t) + 1000 AS BIGINT) AS n_tokens, count(DISTINCT id) AS d, string_agg(id, ',' ORDER BY rk, id) AS pack FROM e GROUP BY 1)
        SELECT task_id, n_items, n_tokens, CASE WHEN n_items > 5 THEN 'EVIDENCE_LIMIT_EXCEEDED' WHEN d < n_items THEN 'DUPLICATE_EVIDENCE' WHEN n_tokens > 14336 THEN 'CONTEXT_OVERFLOW' ELSE '' END AS code, CASE WHEN n_items > 5 OR d < n_items OR n_tokens > 14336 THEN '' ELSE pack END AS pack FROM g""",
    "gold_leaks": "SELECT doc_id, doc_id % 4 IN (1, 3) AS leaks FROM documents",
    "input_profiles": f"""WITH i AS ({INPUTS_SQL}) SELECT task_id, coalesce(string_agg(DISTINCT unit, '|' ORDER BY unit), 'UNSPECIFIED') AS unit_profile, CASE WHEN count(context_id) = 0 THEN 'UNSPECIFIED' ELSE left(sha256(string_agg(DISTINCT context_id, '|' ORDER BY context_id)), 16) END AS context_profile,
        CASE WHEN max(d) = -1 THEN 'UNSPECIFIED' WHEN max(d) = 0 THEN 'DIMENSIONLESS' ELSE 'DIGEST' END AS dimension_profile FROM i GROUP BY 1""",
    "asof_bindings": f"""WITH i AS ({INPUTS_SQL}), g AS (SELECT task_id, selector, min(period_key) AS period_key, count(DISTINCT period_key) AS d, max((period_key IN ('ASOF_20241399', 'FY2024'))::INT) AS bad FROM i GROUP BY 1, 2), b AS (SELECT * FROM g WHERE d = 1 AND bad = 0)
        SELECT task_id, selector, period_key FROM b WHERE selector LIKE 'current%' OR task_id IN (SELECT task_id FROM b WHERE selector LIKE 'current%')""",
    "question_checks": "SELECT o_orderkey, ['', '', 'LENGTH', 'NOT_ONE_QUESTION', 'NO_ISSUER', 'NO_YEAR', 'SUBTYPE', 'FRAGMENT', 'NOT_STRIPPED', 'NOT_NORMALISED'][CAST(o_orderkey % 10 + 1 AS INT)] AS problem FROM orders",
    "release_changes": """WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS s, CASE WHEN o_orderkey % 6 > 0 THEN o_orderpriority END AS p FROM orders), b AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'X' ELSE s END AS s, CASE WHEN id % 10 = 0 THEN 'none' ELSE p END AS p FROM a WHERE id % 9 <> 0 UNION ALL SELECT -id - 1, s, p FROM a WHERE id % 8 = 0),
        j AS (SELECT a.id AS ai, b.id AS bi, a.s IS DISTINCT FROM b.s AS ds, a.p IS DISTINCT FROM b.p AS dp FROM a FULL OUTER JOIN b ON a.id = b.id),
        k AS (SELECT CASE WHEN ai IS NULL THEN 'added' WHEN bi IS NULL THEN 'removed' WHEN ds OR dp THEN 'changed' ELSE 'same' END AS change, CASE WHEN ai IS NULL OR bi IS NULL THEN '' ELSE concat_ws(',', CASE WHEN ds THEN 'status' END, CASE WHEN dp THEN 'priority' END) END AS columns FROM j)
        SELECT change, columns, count(*) AS n FROM k GROUP BY 1, 2""",
    "data_quality": """WITH c AS (SELECT count(*) AS issuers, CAST(sum((c_custkey % 7 > 0 AND c_custkey % 5 > 0)::INT) AS BIGINT) AS ri, sum((c_custkey % 7 > 0)::INT) AS k FROM customer),
        o AS (SELECT count(*) AS filings, CAST(sum((o_orderkey % 4 > 0)::INT) AS BIGINT) AS rf, sum((o_orderkey % 4 > 0 AND o_orderkey % 9 > 0)::INT) AS dl, sum((o_orderkey % 4 > 0 AND o_orderkey % 9 > 0 AND o_orderkey % 10 > 0)::INT) AS ig FROM orders)
        SELECT issuers, ri AS resolved_issuers, filings, rf AS resolved_filings, round(k::DOUBLE / greatest(1, issuers), 6) AS resolution_rate, round(dl::DOUBLE / greatest(1, rf), 6) AS download_rate, round(ig::DOUBLE / greatest(1, dl), 6) AS ingest_rate FROM c, o""",
}
