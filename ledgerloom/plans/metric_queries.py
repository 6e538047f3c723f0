"""Registered queries of the metric engine and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.selection import canonical_facts
from ..sources.views import FACTS_SQL, facts_canon
from ..sources.views import sql as run_sql
from . import metrics
from .specs import ASSETS, COGS, REVENUE, SPECS, Spec


def _six(value: Column) -> Column:
    return F.round(value.cast("double"), 6)


def _edges(facts: DataFrame) -> DataFrame:
    """Calculation edges of every filing but those of the year's first quarter."""
    parts = {"us-gaap_Assets": ["us-gaap_AssetsCurrent", "us-gaap_AssetsNoncurrent"], "us-gaap_Liabilities": ["us-gaap_LiabilitiesCurrent", "us-gaap_LiabilitiesNoncurrent"]}
    pairs = F.array(*[F.struct(F.lit(p).alias("parent"), F.lit(c).alias("child")) for p, cs in parts.items() for c in cs])
    filings = facts.where("fiscal_quarter > 1").select("filing_id").distinct()
    return filings.select("filing_id", F.explode(pairs).alias("_e")).select("filing_id", "_e.*", F.lit(1.0).alias("weight"))


def _answers(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> DataFrame:
    facts = facts_canon(spark, sf_dir)
    specs = [s for s in SPECS if names is None or s.name in names]
    return metrics.answers(facts, _edges(facts), specs)


def _shown() -> list:
    return ["filing_id", "period_key", "metric", "status", F.coalesce("refusal_code", F.lit("")).alias("refusal_code"), _six(F.col("value")).alias("value"), F.size("evidence_ids").cast("long").alias("n_evidence")]


def _metric_query(*names: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _answers(spark, sf_dir, list(names) or None).select(*_shown())

    return query


# --- the same in SQL: every request as rows, looked up by correlated ranks ---


def _sql_term(formula, inputs: dict[str, int]) -> str:
    if isinstance(formula, str):
        return f"v{inputs[formula]}"
    op, args = formula[0], [_sql_term(a, inputs) for a in formula[2 if formula[0] == "rollup" else 1 :]]
    if op == "abs":
        return f"abs({args[0]})"
    if op == "divide":
        return f"(CAST({args[0]} AS DOUBLE) / CAST({args[1]} AS DOUBLE))"
    if op == "subtract":
        return f"({args[0]} - {args[1]})"
    if op == "average":
        return f"(CAST({' + '.join(args)} AS DOUBLE) / {len(args)})"
    return "(" + " + ".join(args) + ")"


def _sql_zero(formula, inputs: dict[str, int]) -> str:
    return f"{_sql_term(formula[2], inputs)} = 0" if formula[0] == "divide" else "false"


def answers_sql(specs: list[Spec]) -> str:
    asked = metrics.requests(specs)
    req = ", ".join(f"({n}, {k}, '{alias}', '{selector}')" for (aliases, selector), n in asked.items() for k, alias in enumerate(aliases))
    kinds = ", ".join(f"({n}, '{p}')" for r, n in asked.items() for p in sorted({p for s in specs if r in s.inputs.values() for p in s.periods}))
    ctes = f"""WITH {FACTS_SQL},
      req(request, pos, alias, selector) AS (VALUES {req}), kinds(request, kind) AS (VALUES {kinds}),
      base AS (SELECT DISTINCT filing_id, ticker, period_type, period_key, period_end, fiscal_year AS fy, fiscal_quarter AS fq, is_ytd FROM facts_canon),
      asked AS (SELECT DISTINCT b.*, r.request, r.selector,
                  CASE WHEN selector = 'previous_quarter' AND fq = 1 THEN fy - 1 ELSE fy END AS ty,
                  CASE WHEN selector = 'previous_quarter' THEN (CASE WHEN fq = 1 THEN 4 ELSE fq - 1 END) ELSE fq END AS tq
                FROM base b JOIN kinds ON kind = period_type JOIN req r USING (request)),
      slots AS (
        SELECT *, 'x' AS slot, period_type AS t_type, period_key AS t_key, fy AS t_fy, fq AS t_fq FROM asked WHERE selector = 'current'
        UNION ALL SELECT *, 'x', period_type, CASE period_type WHEN 'FY' THEN 'FY' || (fy - 1) WHEN 'YTD' THEN 'YTD_Q' || fq || '_' || (fy - 1) ELSE 'Q' || fq || '_' || (fy - 1) END, fy - 1, CASE WHEN period_type = 'FY' THEN 4 ELSE fq END
                  FROM asked WHERE selector = 'prior_year_same_period' AND period_type <> 'ASOF'
        UNION ALL SELECT *, 'x', 'ASOF', 'ASOF_' || strftime(period_end, '%Y%m%d'), fy, fq FROM asked WHERE selector = 'current_period_end_asof'
        UNION ALL SELECT *, 'x', 'ASOF', 'ASOF_' || strftime(period_end - INTERVAL 1 YEAR, '%Y%m%d'), fy - 1, fq FROM asked WHERE selector = 'prior_year_period_end_asof'
        UNION ALL SELECT asked.*, 'q' || n, 'Q', 'Q' || n || '_' || ty, ty, n FROM asked, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE selector IN ('current_quarter', 'previous_quarter') AND n <= tq
        UNION ALL SELECT asked.*, 'y' || n, 'YTD', 'YTD_Q' || n || '_' || ty, ty, n FROM asked, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE selector IN ('current_quarter', 'previous_quarter') AND n <= tq),
      hits AS (
        SELECT s.filing_id, s.period_key, s.request, s.slot, f.value_num, f.value_text, f.fact_evidence_id, f.filing_id AS ff,
               rank() OVER (PARTITION BY s.filing_id, s.period_key, s.request, s.slot ORDER BY r.pos, (f.filing_id <> s.filing_id)::INT, (f.source_anchor IS NULL)::INT) AS rk
        FROM slots s JOIN req r USING (request) JOIN facts_canon f ON f.ticker = s.ticker AND f.concept_norm = r.alias AND f.period_type = s.t_type AND f.period_key = s.t_key
             AND f.fiscal_year = s.t_fy AND f.fiscal_quarter = s.t_fq),
      exact AS (
        SELECT filing_id, period_key, request, slot, CASE WHEN count(DISTINCT value_num) > 1 THEN 'AMBIGUOUS_CONTEXT' END AS code, arg_min(value_num, ff || fact_evidence_id) AS v
        FROM hits WHERE rk = 1 GROUP BY 1, 2, 3, 4),
      close AS (
        SELECT a.filing_id, a.period_key, a.request, f.value_num, f.fact_evidence_id, (f.filing_id <> a.filing_id)::INT AS other,
               rank() OVER (PARTITION BY a.filing_id, a.period_key, a.request ORDER BY r.pos, abs(date_diff('day', f.period_end, (CASE WHEN a.selector LIKE 'prior%' THEN a.period_end - INTERVAL 1 YEAR ELSE a.period_end END)::DATE))) AS rk
        FROM asked a JOIN req r USING (request) JOIN facts_canon f ON f.ticker = a.ticker AND f.concept_norm = r.alias AND f.period_type = 'ASOF'
             AND abs(date_diff('day', f.period_end, (CASE WHEN a.selector LIKE 'prior%' THEN a.period_end - INTERVAL 1 YEAR ELSE a.period_end END)::DATE)) <= 7
        WHERE a.selector LIKE '%asof'),
      near AS (SELECT filing_id, period_key, request, CASE WHEN count(DISTINCT value_num) > 1 THEN 'AMBIGUOUS_CONTEXT' END AS code, arg_min(value_num, other || fact_evidence_id) AS v FROM close WHERE rk = 1 GROUP BY 1, 2, 3),
      wide AS (
        SELECT filing_id, period_key, request, max(v) FILTER (slot = 'x') AS x, max(code) FILTER (slot = 'x') AS xc, count(*) FILTER (slot = 'x') AS xn,
               {", ".join(f"max(v) FILTER (slot = '{s}{n}' AND code IS NULL) AS {s}{n}, coalesce(max(code) FILTER (slot = '{s}{n}'), 'MISSING_INPUT') AS {s}c{n}" for s in "qy" for n in range(1, 5))}
        FROM exact GROUP BY 1, 2, 3),
      d1 AS (SELECT *, coalesce(q1, y1) AS e1, CASE WHEN coalesce(q1, y1) IS NULL THEN yc1 END AS f1, CASE WHEN coalesce(q1, y1) IS NULL THEN 0 ELSE 1 END AS g1 FROM wide),
      d2 AS (SELECT *, coalesce(q2, y2 - e1) AS e2, CASE WHEN q2 IS NOT NULL THEN NULL WHEN f1 IS NOT NULL THEN f1 WHEN y2 IS NULL THEN yc2 END AS f2, CASE WHEN q2 IS NULL THEN 1 + g1 ELSE 1 END AS g2 FROM d1),
      d3 AS (SELECT *, coalesce(q3, y3 - e2) AS e3, CASE WHEN q3 IS NOT NULL THEN NULL WHEN f2 IS NOT NULL THEN f2 WHEN y3 IS NULL THEN yc3 END AS f3, CASE WHEN q3 IS NULL THEN 1 + g2 ELSE 1 END AS g3 FROM d2),
      d4 AS (SELECT *, coalesce(q4, y4 - e3) AS e4, CASE WHEN q4 IS NOT NULL THEN NULL WHEN f3 IS NOT NULL THEN f3 WHEN y4 IS NULL THEN yc4 END AS f4, CASE WHEN q4 IS NULL THEN 1 + g3 ELSE 1 END AS g4 FROM d3),
      got AS (
        SELECT a.filing_id, a.period_key, a.period_type, a.request,
               CASE WHEN a.selector LIKE '%quarter' THEN CASE tq WHEN 1 THEN e1 WHEN 2 THEN e2 WHEN 3 THEN e3 ELSE e4 END
                    WHEN a.selector LIKE '%asof' AND coalesce(xn, 0) = 0 THEN CASE WHEN n.code IS NULL THEN n.v END WHEN xc IS NULL THEN x END AS v,
               CASE WHEN a.selector LIKE '%quarter' THEN CASE tq WHEN 1 THEN coalesce(f1, CASE WHEN e1 IS NULL THEN 'MISSING_INPUT' END) WHEN 2 THEN coalesce(f2, CASE WHEN e2 IS NULL THEN 'MISSING_INPUT' END)
                                                              WHEN 3 THEN coalesce(f3, CASE WHEN e3 IS NULL THEN 'MISSING_INPUT' END) ELSE coalesce(f4, CASE WHEN e4 IS NULL THEN 'MISSING_INPUT' END) END
                    WHEN a.selector LIKE '%asof' AND coalesce(xn, 0) = 0 THEN CASE WHEN n.filing_id IS NULL THEN 'MISSING_INPUT' ELSE n.code END
                    WHEN coalesce(xn, 0) = 0 THEN 'MISSING_INPUT' ELSE xc END AS code,
               CASE WHEN a.selector LIKE '%quarter' THEN CASE tq WHEN 1 THEN g1 WHEN 2 THEN g2 WHEN 3 THEN g3 ELSE g4 END ELSE 1 END AS g
        FROM asked a LEFT JOIN d4 USING (filing_id, period_key, request) LEFT JOIN near n USING (filing_id, period_key, request)),
      pivoted AS (
        SELECT filing_id, period_key, period_type, {", ".join(f"max(v) FILTER (request = {n}) AS v{n}, max(code) FILTER (request = {n}) AS c{n}, max(g) FILTER (request = {n}) AS g{n}" for n in asked.values())}
        FROM got GROUP BY 1, 2, 3)"""
    parts = []
    for spec in specs:
        ns = {k: asked[r] for k, r in spec.inputs.items()}
        code = "coalesce(" + ", ".join([f"c{n}" for n in ns.values()] + [f"CASE WHEN {_sql_zero(spec.formula, ns)} THEN 'ZERO_DENOMINATOR' END"]) + ")"
        used = set(ns.values())
        parts.append(
            f"SELECT filing_id, period_key, '{spec.name}' AS metric, CASE WHEN {code} IS NULL THEN 'OK' ELSE 'REFUSAL' END AS status, coalesce({code}, '') AS refusal_code, "
            f"CASE WHEN {code} IS NULL THEN round(CAST({_sql_term(spec.formula, ns)} AS DOUBLE), 6) END AS value, "
            f"CAST(CASE WHEN {code} IS NULL THEN {' + '.join(f'g{n}' for n in sorted(used))} ELSE 0 END AS BIGINT) AS n_evidence "
            f"FROM pivoted WHERE period_type IN ({', '.join(repr(p) for p in spec.periods)})"
        )
    return ctes + " " + " UNION ALL ".join(parts)


def _sql(*names: str) -> str:
    return answers_sql([s for s in SPECS if not names or s.name in names])


def metric_refusal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answers(spark, sf_dir)
    return rows.groupBy("metric", "status", F.coalesce("refusal_code", F.lit("")).alias("refusal_code")).agg(F.count(F.lit(1)).alias("n"))


def metric_rollup_sum_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _answers(spark, sf_dir, ["total_assets_rollup", "total_liabilities_rollup", "liabilities_and_equity_rollup"]).where("status = 'OK'")
    return rows.groupBy("metric", "rollup_source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(24,2)")).cast("double").alias("total"))


def alias_priority_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = facts_canon(spark, sf_dir)
    base = metrics.periods(facts).where("period_type = 'FY'")
    spec = Spec("both", "usd", ("FY",), {"revenue": REVENUE, "cogs": COGS}, ("subtract", "revenue", "cogs"))
    got = metrics.resolve(facts, base, [spec])
    return got.select("filing_id", "period_key", F.col("request").cast("long"), F.coalesce("input.code", F.lit("")).alias("code"), F.coalesce("input.concept", F.lit("")).alias("concept"), _six(F.col("input.value")).alias("value"))


def nearest_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = facts_canon(spark, sf_dir)
    base = metrics.periods(facts).where("period_type = 'FY'")
    spec = Spec("ends", "usd", ("FY",), {"now": (ASSETS, "current_period_end_asof"), "then": (ASSETS, "prior_year_period_end_asof")}, ("sum", "now", "then"))
    got = metrics.resolve(facts, base, [spec])
    return got.select("filing_id", "period_key", F.col("request").cast("long"), F.coalesce("input.code", F.lit("")).alias("code"), _six(F.col("input.value")).alias("value"))


def ytd_derived_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = facts_canon(spark, sf_dir)
    base = metrics.periods(facts).where("period_type IN ('Q', 'YTD')")
    spec = Spec("quarter", "usd", ("Q", "YTD"), {"revenue": (REVENUE, "current_quarter")}, ("sum", "revenue"))
    got = metrics.resolve(facts, base, [spec])
    return got.select("filing_id", "period_key", F.coalesce("input.code", F.lit("")).alias("code"), _six(F.col("input.value")).alias("value"), F.size("input.evidence").cast("long").alias("n_evidence"))


# raw facts made of events: users are filings, event types concepts, days periods
RAW_SQL = """
raw AS (
  SELECT CAST(user_id AS VARCHAR(20)) AS filing_id, event_type AS concept_norm, 'numeric' AS value_type, CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS period_key,
         CASE WHEN event_id % 11 = 0 THEN 'pure' ELSE 'usd' END AS unit_canon, CAST(value AS DECIMAL(38,6)) AS value_num, CAST(NULL AS VARCHAR(10)) AS value_text,
         CASE WHEN event_id % 3 = 0 THEN CAST(NULL AS VARCHAR(20)) ELSE concat('a', CAST(event_id AS VARCHAR(20))) END AS source_anchor,
         CASE WHEN event_id % 13 = 0 THEN CAST(NULL AS VARCHAR(20)) ELSE concat('c', CAST(event_id % 2 AS VARCHAR(20))) END AS context_id,
         CAST(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS INT) AS dimension_count, concat('e', CAST(event_id AS VARCHAR(20))) AS fact_evidence_id,
         CAST(event_id % 1000000 AS INT) AS fact_ordinal, 'main.htm' AS source_file, CASE WHEN event_id % 17 = 0 THEN 'DUR_OTHER' ELSE 'ASOF' END AS period_type
  FROM events)
"""
_BEST_SQL = f"""WITH {RAW_SQL},
  ranked AS (SELECT *, rank() OVER (PARTITION BY filing_id, concept_norm, value_type, period_key, unit_canon ORDER BY (source_anchor IS NULL)::INT, (context_id IS NULL)::INT) AS rk FROM raw WHERE dimension_count = 0),
  best AS (SELECT filing_id, concept_norm, value_type, period_key, unit_canon, count(DISTINCT coalesce(context_id, '-') || '|' || value_num) AS n_distinct,
                  arg_min(fact_evidence_id, coalesce(source_anchor, '') || '|' || fact_evidence_id) AS fact_evidence_id, arg_min(value_num, coalesce(source_anchor, '') || '|' || fact_evidence_id) AS value_num,
                  min((source_anchor IS NULL)::INT) AS na, min((context_id IS NULL)::INT) AS nc
           FROM ranked WHERE rk = 1 GROUP BY 1, 2, 3, 4, 5)"""


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"WITH {RAW_SQL} SELECT * FROM raw")


def canon_fact_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, _ = canonical_facts(_raw(spark, sf_dir))
    return chosen.select("canon_id", "filing_id", "concept_norm", "period_key", "unit_canon", "fact_evidence_id", _six(F.col("value_num")).alias("value"), "selection_reason")


def validator_unit_scale_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = canonical_facts(_raw(spark, sf_dir))
    return found.where("code = 'UNIT_SCALE_MISMATCH'").select("filing_id", "entity_key")


def validator_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found = canonical_facts(_raw(spark, sf_dir))
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("filing_id").alias("n_filings"))


QUERIES = {
    "metric_all_ratio_specs": _metric_query(),
    "metric_gross_margin": _metric_query("gross_margin"),
    "metric_yoy_growth": _metric_query("yoy_revenue_growth", "yoy_net_income_growth"),
    "metric_qoq_growth": _metric_query("qoq_revenue_growth", "qoq_net_income_growth"),
    "metric_avg_balance_roa": _metric_query("roa", "roe", "asset_turnover", "equity_multiplier"),
    "metric_refusal_mix": metric_refusal_mix,
    "metric_rollup_sum_source": metric_rollup_sum_source,
    "metric_ytd_derived_quarter": ytd_derived_quarter,
    "alias_priority_lookup": alias_priority_lookup,
    "nearest_asof_join": nearest_asof,
    "canon_fact_selection": canon_fact_selection,
    "validator_unit_scale_mismatch": validator_unit_scale_mismatch,
    "validator_distribution": validator_distribution,
}


def _wrapped(specs: list[Spec], select: str) -> str:
    text = answers_sql(specs)
    at = text.index("pivoted AS (")
    end = text.index("FROM got GROUP BY 1, 2, 3)", at) + len("FROM got GROUP BY 1, 2, 3)")
    return text[:end] + " " + select


_BOTH = Spec("both", "usd", ("FY",), {"revenue": REVENUE, "cogs": COGS}, ("subtract", "revenue", "cogs"))
_ENDS = Spec("ends", "usd", ("FY",), {"now": (ASSETS, "current_period_end_asof"), "then": (ASSETS, "prior_year_period_end_asof")}, ("sum", "now", "then"))
_QUARTER = Spec("quarter", "usd", ("Q", "YTD"), {"revenue": (REVENUE, "current_quarter")}, ("sum", "revenue"))
_GOT = "SELECT filing_id, period_key, CAST(request AS BIGINT) AS request, coalesce(code, '') AS code, round(CAST(v AS DOUBLE), 6) AS value FROM got"

ORACLE_SQL = {
    "metric_all_ratio_specs": _sql(),
    "metric_gross_margin": _sql("gross_margin"),
    "metric_yoy_growth": _sql("yoy_revenue_growth", "yoy_net_income_growth"),
    "metric_qoq_growth": _sql("qoq_revenue_growth", "qoq_net_income_growth"),
    "metric_avg_balance_roa": _sql("roa", "roe", "asset_turnover", "equity_multiplier"),
    "metric_refusal_mix": f"SELECT metric, status, refusal_code, count(*) AS n FROM ({_sql()}) GROUP BY 1, 2, 3",
    "metric_rollup_sum_source": f"""SELECT metric, CASE WHEN metric <> 'liabilities_and_equity_rollup' AND filing_id NOT LIKE '%Q1' THEN 'calculation_linkbase' ELSE 'explicit_override' END AS rollup_source,
        count(*) AS n, CAST(sum(CAST(value AS DECIMAL(24,2))) AS DOUBLE) AS total FROM ({_sql("total_assets_rollup", "total_liabilities_rollup", "liabilities_and_equity_rollup")}) WHERE status = 'OK' GROUP BY 1, 2""",
    "metric_ytd_derived_quarter": _wrapped([_QUARTER], "SELECT filing_id, period_key, coalesce(code, '') AS code, round(CAST(v AS DOUBLE), 6) AS value, CAST(CASE WHEN code IS NULL THEN g ELSE 0 END AS BIGINT) AS n_evidence FROM got"),
    "alias_priority_lookup": _wrapped([_BOTH], """SELECT g.filing_id, g.period_key, CAST(request AS BIGINT) AS request, coalesce(code, '') AS code, round(CAST(v AS DOUBLE), 6) AS value,
        CASE WHEN code IS NOT NULL THEN '' WHEN request = 0 THEN (SELECT CASE WHEN n_nationkey % 3 = 1 THEN 'us-gaap_SalesRevenueNet' ELSE 'us-gaap_Revenues' END FROM nation WHERE g.filing_id LIKE n_name || '-%')
             ELSE 'us-gaap_CostOfRevenue' END AS concept FROM got g"""),
    "nearest_asof_join": _wrapped([_ENDS], _GOT),
    "canon_fact_selection": f"""{_BEST_SQL}
        SELECT sha1(filing_id || '|' || concept_norm || '|' || period_key || '|' || value_type || '|' || unit_canon) AS canon_id, filing_id, concept_norm, period_key, unit_canon, fact_evidence_id, round(CAST(value_num AS DOUBLE), 6) AS value,
               'dimensionless-first; ' || CASE WHEN na = 1 THEN 'synthetic-locator' ELSE 'anchored' END || '; ' || CASE WHEN nc = 1 THEN 'context-missing' ELSE 'context-bound' END AS selection_reason
        FROM best WHERE n_distinct = 1""",
    "validator_unit_scale_mismatch": f"""WITH {RAW_SQL} SELECT filing_id, concept_norm || '|' || period_key || '|' || unit_canon AS entity_key FROM raw WHERE dimension_count = 0
        GROUP BY filing_id, concept_norm, period_key, unit_canon HAVING count(DISTINCT value_num) > 1""",
    "validator_distribution": f"""{_BEST_SQL},
        found AS (SELECT DISTINCT filing_id, 'PERIOD_ALIGNMENT_FAIL' AS code, coalesce(context_id, source_anchor, source_file || '::ord=' || lpad(CAST(fact_ordinal AS VARCHAR), 6, '0')) AS entity_key, concept_norm FROM raw WHERE period_type = 'DUR_OTHER'
          UNION ALL SELECT filing_id, 'UNIT_SCALE_MISMATCH', concept_norm || '|' || period_key || '|' || unit_canon, concept_norm FROM raw WHERE dimension_count = 0 GROUP BY filing_id, concept_norm, period_key, unit_canon HAVING count(DISTINCT value_num) > 1
          UNION ALL SELECT filing_id, 'CONTEXT_SELECTION_AMBIGUOUS', concept_norm || '|' || period_key || '|' || unit_canon, concept_norm FROM best WHERE n_distinct > 1
          UNION ALL SELECT filing_id, 'CONTEXT_SELECTION_AMBIGUOUS', concept_norm || '|' || period_key || '|' || unit_canon, concept_norm FROM raw GROUP BY filing_id, concept_norm, period_key, unit_canon HAVING min(dimension_count) > 0)
        SELECT code, count(*) AS n, count(DISTINCT filing_id) AS n_filings FROM found GROUP BY 1""",
}
