"""Queries on tasks and evidence over the filing-shaped views, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, tasks
from ..operators.selection import canonical_facts
from ..sources.views import FACTS_SQL, FILED_SQL, facts_canon
from ..sources.views import sql as run_sql
from ..storage import materialise
from . import metrics
from .metric_queries import RAW_SQL, answers_sql
from .specs import SPECS

NAMES = ["gross_margin", "current_ratio"]


def _specs() -> list:
    return [s for s in SPECS if s.name in NAMES]


def _answered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    facts = facts_canon(spark, sf_dir)
    return materialise(metrics.answers(facts, None, _specs()), "answers"), facts


def _tasks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    answers, facts = _answered(spark, sf_dir)
    return materialise(tasks.holdout_split(tasks.task_specs(answers, facts)), "tasks"), answers


def task_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every task with its target, its distractors and its negative type."""
    rows, _ = _tasks(spark, sf_dir)
    free = F.array_join(F.transform("distractors", lambda d: d["fact_evidence_id"]), ",")
    return rows.select("task_id", "filing_id", "metric", "period_key", "status", F.coalesce("negative_type", F.lit("")).alias("negative_type"), F.array_join("concepts", ",").alias("concepts"), free.alias("distractors"))


def task_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _tasks(spark, sf_dir)
    return tasks.hard_negatives(rows).select("filing_id", "metric", "period_key", "negative_type", "detail", "negative_id")


def task_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _tasks(spark, sf_dir)
    return rows.select("ticker", F.col("fiscal_year").cast("long").alias("fiscal_year"), "split").distinct()


def task_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _tasks(spark, sf_dir)
    return tasks.datasets(rows).groupBy("dataset", "task_family", F.col("template").cast("long").alias("template")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("question")).cast("long").alias("chars"), F.count("code").alias("n_code"))


def task_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of all tasks, some with another operation, period or schema, executed on the answers."""
    rows, answers = _tasks(spark, sf_dir)
    year = F.col("fiscal_year")
    plans = rows.select(
        "task_id", "filing_id", "metric", F.when(year % 5 == 1, "FY1900").otherwise(F.col("period_key")).alias("period_key"), F.when(year % 5 == 2, "other").otherwise(tasks.EXECUTOR).alias("executor_op"),
        F.when(year % 5 == 3, "other.v9").otherwise(tasks.SCHEMA).alias("output_schema"),
    )
    return tasks.execute_plans(plans, answers).groupBy("metric", "status", F.coalesce("refusal_code", F.lit("")).alias("refusal_code")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("evidence_ids")).cast("long").alias("n_evidence"))


def task_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that name a metric in words, by its key, both, or none, routed to tasks."""
    rows, _ = _tasks(spark, sf_dir)
    words = F.replace("metric", F.lit("_"), F.lit(" "))
    other = F.when(F.col("metric") == "gross_margin", "current ratio").otherwise("gross margin")
    text = F.when(F.col("fiscal_year") % 4 == 0, F.concat(F.lit("Show "), words, F.lit(" for "), "period_key")).when(F.col("fiscal_year") % 4 == 1, F.concat(F.lit("Unlike "), other, F.lit(", what is ("), "metric", F.lit(") at "), "period_key", F.lit("?"))).when(
        F.col("fiscal_year") % 4 == 2, F.concat(F.lit("How did it go in "), "period_key")).otherwise(F.concat(F.lit("Show "), words, F.lit(" for x"), "period_key"))
    asked = rows.select("filing_id", F.col("task_id").alias("question_id"), text.alias("question"), (F.col("fiscal_year") % 4).cast("long").alias("kind"))
    found = tasks.routed(asked, rows)
    verdict = F.when(F.col("task_id").isNull(), "none").when(F.col("task_id") == F.col("question_id"), "own").otherwise("other")
    return found.groupBy("kind", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def validator_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traps that come of data-quality findings: raw event facts, one task for each canonical fact."""
    chosen, found = canonical_facts(run_sql(spark, sf_dir, f"WITH {RAW_SQL} SELECT * FROM raw"))
    chosen, found = materialise(chosen, "chosen"), materialise(found, "findings")
    answers = chosen.select(
        F.col("canon_id").alias("answer_id"), "filing_id", F.col("concept_norm").alias("metric"), F.concat_ws("~", "period_key", "unit_canon").alias("period_key"), F.lit("OK").alias("status"),
        F.lit(None).cast("string").alias("refusal_code"), F.array("fact_evidence_id").alias("evidence_ids"),
    )
    facts = chosen.select("filing_id", F.concat_ws("~", "period_key", "unit_canon").alias("period_key"), "concept_norm", "fact_evidence_id", "unit_canon", "value_num")
    out = tasks.hard_negatives(tasks.task_specs(answers, facts, found))
    return out.groupBy("filing_id", "negative_type").agg(F.count(F.lit(1)).alias("n"))


#: Evidence of one gross margin a filing, spoilt in one of several ways: by issuer, and by quarter.
EVIDENCE_SQL = f"""WITH {FILED_SQL}, b AS (SELECT CAST(k AS INT) AS k, fy, fq, filing_id, concat('Q', CAST(fq AS VARCHAR(1)), '_', CAST(fy AS VARCHAR(4))) AS pk, day, net, off, CAST(k % 9 AS INT) AS how FROM filed)
  SELECT filing_id AS task_id, 1 AS pos, concat(filing_id, ':r') AS evidence_id, CASE WHEN how = 8 AND fq = 2 THEN 'elsewhere' ELSE filing_id END AS filing_id, 'revenue' AS input,
    CASE WHEN how = 6 THEN '0' WHEN how = 7 THEN 'n/a' ELSE CAST(net AS VARCHAR(40)) END AS value, 'iso4217:USD' AS unit, CASE WHEN how = 4 AND fq = 1 THEN 'FY1990' ELSE pk END AS period_key,
    'us-gaap:Revenues' AS concept, 'c1' AS context_id, 'E' AS entity_id, CAST(how AS INT) AS how, k, fq, day, pk FROM b
  UNION ALL SELECT filing_id, 2, concat(filing_id, ':c'), filing_id, 'cogs', CAST(off AS VARCHAR(40)), CASE WHEN how = 3 THEN 'shares' WHEN how = 3 + fq THEN 'EUR' ELSE ' usd' END, pk, CASE WHEN how = 1 AND fq = 3 THEN 'us-gaap:Assets' ELSE 'us-gaap_CostOfRevenue' END,
    CASE WHEN how = 5 AND fq = 4 THEN 'c2' ELSE 'c1' END, CASE WHEN how = 5 AND fq = 3 THEN 'F' ELSE 'E' END, how, k, fq, day, pk FROM b WHERE NOT (how = 1 AND fq < 3)
  UNION ALL SELECT filing_id, 3, concat(filing_id, ':r2'), filing_id, 'revenue', CAST(net + 1 AS VARCHAR(40)), 'USD', pk, 'us-gaap:Revenues', 'c1', 'E', how, k, fq, day, pk FROM b WHERE how = 2"""


def evidence_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gross margins recomputed from their evidence, or the first refusal."""
    rows = materialise(run_sql(spark, sf_dir, EVIDENCE_SQL), "evidence")
    per = rows.groupBy("task_id").agg(F.max("how").alias("how"), F.max("k").alias("k"), F.max("fq").alias("fq"), F.max("day").alias("period_end"), F.max("pk").alias("pk"))
    metric = F.when(F.col("k") == 24, "no_such_metric").when(F.col("k") == 23, "current_ratio").otherwise("gross_margin")
    asked = per.select(
        "task_id", F.array("task_id").alias("filing_ids"), metric.alias("metric"), F.col("pk").alias("period_key"), "period_end", F.lit("E").alias("entity_id"), F.lit("US").alias("jurisdiction"),
        F.array(*map(F.lit, ["MISSING_INPUT", "AMBIGUOUS_CONTEXT", "PERIOD_NOT_SUPPORTED", "DIVISION_BY_ZERO"])).alias("allowed_codes"),
    )
    empty = F.create_map().cast("map<string,string>")
    out = evidence.evaluate(asked, rows.drop("how", "k", "fq", "day", "pk").withColumn("dimensions", empty).withColumn("scenario", F.lit(None).cast("string")))
    return out.select("task_id", "status", F.coalesce("refusal_code", F.lit("")).alias("refusal_code"), F.round("number", 6).alias("value"), F.coalesce("unit", F.lit("")).alias("unit"), F.array_join("evidence_ids", ",").alias("evidence"))


def evidence_materialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts that answers name, resolved by id, with what is wrong with some of them."""
    answers, facts = _answered(spark, sf_dir)
    known = facts.withColumn("entity_identifier", F.col("ticker"))
    doubled = known.unionByName(known.where("fiscal_year = 1995 AND concept_norm = 'us-gaap_CostOfRevenue'"))
    ids = answers.where("status = 'OK'").select(
        F.col("answer_id").alias("task_id"), F.col("ticker").alias("issuer"), F.when(F.col("fiscal_year") == 1996, "someone else").otherwise(F.col("ticker")).alias("entity_id"),
        F.posexplode(F.when(F.col("fiscal_year") == 1997, F.concat("evidence_ids", F.array(F.lit("nothing")))).otherwise(F.col("evidence_ids"))).alias("pos", "fact_evidence_id"),
    )
    out = evidence.materialised(ids, doubled)
    return out.groupBy(F.coalesce("problem", F.lit("")).alias("problem"), F.coalesce("task_problem", F.lit("")).alias("task_problem")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("task_id").alias("n_tasks"))


QUERIES = {f.__name__: f for f in (task_specs, task_hard_negatives, task_splits, task_datasets, task_plans, task_routing, validator_hard_negatives, evidence_evaluation, evidence_materialised)}

_T = f"""WITH {FACTS_SQL},
  base AS (SELECT DISTINCT filing_id, ticker, period_type, period_key, fiscal_year FROM facts_canon),
  gm AS (SELECT b.*, 'gross_margin' AS metric, 'OK' AS status, CAST(NULL AS VARCHAR) AS code, list_sort([r.concept_norm, 'us-gaap_CostOfRevenue']) AS concepts,
           list_sort([r.fact_evidence_id, b.filing_id || ':us-gaap_CostOfRevenue:' || b.period_key]) AS ev
         FROM base b JOIN facts_canon r ON r.filing_id = b.filing_id AND r.period_key = b.period_key AND r.concept_norm IN ('us-gaap_Revenues', 'us-gaap_SalesRevenueNet') WHERE b.period_type IN ('FY', 'Q', 'YTD')),
  cr AS (SELECT b.*, 'current_ratio' AS metric, CASE WHEN l.value_num = 0 THEN 'REFUSAL' ELSE 'OK' END AS status, CASE WHEN l.value_num = 0 THEN 'ZERO_DENOMINATOR' END AS code,
           CASE WHEN l.value_num = 0 THEN [] ELSE ['us-gaap_AssetsCurrent', 'us-gaap_LiabilitiesCurrent'] END AS concepts,
           CASE WHEN l.value_num = 0 THEN [] ELSE list_sort([b.filing_id || ':us-gaap_AssetsCurrent:' || b.period_key, l.fact_evidence_id]) END AS ev
         FROM base b JOIN facts_canon l ON l.filing_id = regexp_replace(b.filing_id, '-A$', '') AND l.period_key = b.period_key AND l.concept_norm = 'us-gaap_LiabilitiesCurrent' WHERE b.period_type = 'ASOF'),
  t AS (SELECT *, sha1('quant|' || sha1(metric || '|' || filing_id || '|' || period_key || coalesce('|' || code, '') || '|v0')) AS task_id FROM (SELECT * FROM gm UNION ALL SELECT * FROM cr)),
  fl AS (SELECT filing_id, period_key, list(concept_norm ORDER BY concept_norm, fact_evidence_id) AS cs, list(fact_evidence_id ORDER BY concept_norm, fact_evidence_id) AS es FROM facts_canon GROUP BY 1, 2),
  d AS (SELECT t.*, list_slice(list_filter(es, lambda e, i: NOT list_contains(concepts, cs[i]) AND NOT list_contains(ev, e)), 1, 4) AS free,
               'e' AS x, (('0x' || substr(sha1('holdout|v1|' || ticker || ':' || fiscal_year), 1, 8))::BIGINT % 5) = 0 AS held FROM t JOIN fl USING (filing_id, period_key))"""
_NEGATIVES = """, s AS (SELECT d.*, (SELECT min(o.period_key) FROM t o WHERE o.filing_id = d.filing_id AND o.metric = d.metric AND o.period_key <> d.period_key) AS sibling FROM d),
  n AS (SELECT task_id, filing_id, metric, period_key, 'zero_denominator' AS negative_type, code AS detail, code AS k FROM s WHERE status = 'REFUSAL'
    UNION ALL SELECT task_id, filing_id, metric, period_key, 'distractor', array_to_string(free, ','), 'distractor' FROM s WHERE status = 'OK' AND len(free) > 0
    UNION ALL SELECT task_id, filing_id, metric, period_key, 'period_trap', sibling, 'period-trap' FROM s WHERE status = 'OK' AND sibling IS NOT NULL
    UNION ALL SELECT task_id, filing_id, metric, period_key, 'wrong_evidence_map', array_to_string(list_concat(list_slice(ev, 2, 9), list_slice(free, 1, 1)), ','), 'wrong-evidence-map' FROM s WHERE status = 'OK')
  SELECT filing_id, metric, period_key, negative_type, detail, sha1('hard-negative|' || task_id || '|' || k) AS negative_id FROM n"""
_QUESTION = """CASE ('0x' || substr(sha1('question|' || task_id), 1, 8))::BIGINT % 3 WHEN 0 THEN 'What is ' || metric || ' of ' || ticker || ' for ' || period_key || '?'
  WHEN 1 THEN 'Using filing ' || filing_id || ', compute ' || metric || ' for ' || period_key || '.' ELSE 'Report the ' || metric || ' that ' || ticker || ' shows in ' || period_key || '.' END"""

ORACLE_SQL = {
    "task_specs": _T + " SELECT task_id, filing_id, metric, period_key, status, CASE WHEN code IS NOT NULL THEN 'zero_denominator' ELSE '' END AS negative_type, array_to_string(concepts, ',') AS concepts, array_to_string(free, ',') AS distractors FROM d",
    "task_hard_negatives": _T + _NEGATIVES,
    "task_splits": _T + " SELECT DISTINCT ticker, CAST(fiscal_year AS BIGINT) AS fiscal_year, CASE WHEN held THEN 'eval_holdout' ELSE 'train' END AS split FROM d",
    "task_datasets": _T + f""", r AS (SELECT *, ('0x' || substr(sha1('question|' || task_id), 1, 8))::BIGINT % 3 AS template, length({_QUESTION}) AS chars, unnest(CASE WHEN held THEN ['eval'] WHEN status = 'OK' THEN ['qa', 'code'] ELSE ['refusal'] END) AS dataset FROM d)
        SELECT dataset, 'quant_metric:' || metric || ':' || lower(status) AS task_family, template, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars, count(CASE WHEN dataset = 'code' THEN 1 END) AS n_code FROM r GROUP BY 1, 2, 3""",
    "task_plans": _T + """, p AS (SELECT *, CASE fiscal_year % 5 WHEN 1 THEN 'TASK_NOT_SUPPORTED' WHEN 2 THEN 'UNSUPPORTED_REQUEST' WHEN 3 THEN 'UNSUPPORTED_REQUEST' ELSE coalesce(code, '') END AS rc FROM d)
        SELECT metric, CASE WHEN rc = '' THEN 'OK' ELSE 'REFUSAL' END AS status, rc AS refusal_code, count(*) AS n, CAST(sum(CASE WHEN rc = '' THEN len(ev) ELSE 0 END) AS BIGINT) AS n_evidence FROM p GROUP BY 1, 2, 3""",
    "task_routing": _T + " SELECT CAST(fiscal_year % 4 AS BIGINT) AS kind, CASE WHEN fiscal_year % 4 < 2 THEN 'own' ELSE 'none' END AS verdict, count(*) AS n FROM d GROUP BY 1, 2",
    "evidence_evaluation": f"""WITH {FILED_SQL}, b AS (SELECT CAST(k AS INT) AS k, fq, filing_id, net, off, k % 9 AS how FROM filed),
        c AS (SELECT *, CASE WHEN k = 24 THEN 'UNSUPPORTED' WHEN k = 23 THEN 'PERIOD_NOT_SUPPORTED' WHEN how = 8 AND fq = 2 THEN 'AMBIGUOUS_CONTEXT' WHEN how = 7 THEN 'MISSING_INPUT' WHEN how = 2 THEN 'AMBIGUOUS_CONTEXT' WHEN how = 4 AND fq = 1 THEN 'PERIOD_NOT_SUPPORTED'
               WHEN how = 1 AND fq < 3 THEN 'MISSING_INPUT' WHEN how = 3 THEN 'INCOMPATIBLE' WHEN how = 1 AND fq = 3 THEN 'AMBIGUOUS_CONTEXT' WHEN how = 5 AND fq IN (3, 4) THEN 'AMBIGUOUS_CONTEXT' WHEN how = 3 + fq THEN 'INCOMPATIBLE' WHEN how = 6 THEN 'DIVISION_BY_ZERO' END AS raw FROM b)
        SELECT filing_id AS task_id, CASE WHEN raw IS NULL THEN 'OK' ELSE 'REFUSAL' END AS status, coalesce(CASE WHEN raw IN ('UNSUPPORTED', 'INCOMPATIBLE') THEN 'MISSING_INPUT' ELSE raw END, '') AS refusal_code,
               CASE WHEN raw IS NULL THEN round(CAST(net - off AS DOUBLE) / CAST(net AS DOUBLE), 6) END AS value, CASE WHEN raw IS NULL THEN 'pure' ELSE '' END AS unit, CASE WHEN raw IS NULL THEN filing_id || ':r,' || filing_id || ':c' ELSE '' END AS evidence FROM c""",
    "evidence_materialised": _T + """, e AS (SELECT task_id, fiscal_year, metric, unnest(CASE WHEN fiscal_year = 1997 THEN list_append(ev, 'nothing') ELSE ev END) AS id FROM d WHERE status = 'OK'),
        p AS (SELECT *, CASE WHEN id = 'nothing' THEN 'MISSING_EVIDENCE' WHEN fiscal_year = 1995 AND id LIKE '%us-gaap_CostOfRevenue:%' THEN 'DUPLICATE_EVIDENCE' WHEN fiscal_year = 1996 THEN 'FOREIGN_ENTITY' ELSE '' END AS problem FROM e),
        v AS (SELECT task_id, max(problem) AS tp FROM p GROUP BY 1)
        SELECT problem, tp AS task_problem, count(*) AS n, count(DISTINCT task_id) AS n_tasks FROM p JOIN v USING (task_id) GROUP BY 1, 2""",
    "validator_hard_negatives": f"""WITH {RAW_SQL},
        ranked AS (SELECT *, rank() OVER (PARTITION BY filing_id, concept_norm, value_type, period_key, unit_canon ORDER BY (source_anchor IS NULL)::INT, (context_id IS NULL)::INT) AS rk FROM raw WHERE dimension_count = 0),
        best AS (SELECT filing_id, concept_norm, period_key, unit_canon, count(DISTINCT coalesce(context_id, '-') || '|' || value_num) AS n_distinct FROM ranked WHERE rk = 1 GROUP BY 1, 2, 3, 4),
        c AS (SELECT filing_id, concept_norm, period_key || '~' || unit_canon AS pk FROM best WHERE n_distinct = 1),
        amb AS (SELECT DISTINCT filing_id FROM (SELECT filing_id FROM best WHERE n_distinct > 1 UNION ALL SELECT filing_id FROM raw GROUP BY filing_id, concept_norm, period_key, unit_canon HAVING min(dimension_count) > 0)),
        mis AS (SELECT DISTINCT filing_id FROM (SELECT filing_id FROM raw WHERE dimension_count = 0 GROUP BY filing_id, concept_norm, period_key, unit_canon HAVING count(DISTINCT value_num) > 1)),
        n AS (SELECT filing_id, 'wrong_evidence_map' AS negative_type FROM c
          UNION ALL SELECT c.filing_id, 'distractor' FROM c WHERE EXISTS (SELECT 1 FROM c o WHERE o.filing_id = c.filing_id AND o.pk = c.pk AND o.concept_norm <> c.concept_norm)
          UNION ALL SELECT c.filing_id, 'period_trap' FROM c WHERE EXISTS (SELECT 1 FROM c o WHERE o.filing_id = c.filing_id AND o.concept_norm = c.concept_norm AND o.pk <> c.pk)
          UNION ALL SELECT c.filing_id, 'context_ambiguity' FROM c JOIN amb USING (filing_id) UNION ALL SELECT c.filing_id, 'unit_trap' FROM c JOIN mis USING (filing_id))
        SELECT filing_id, negative_type, count(*) AS n FROM n GROUP BY 1, 2""",
}
