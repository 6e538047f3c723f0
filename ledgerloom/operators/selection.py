"""Ranked matches: canonical facts, alias priority, best match or ambiguity, nearest date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.numbers import digest
from ..functions.periods import classified


def with_periods(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """Facts with their fiscal periods; filings are few beside facts, their join key is the filing."""
    own = filings.select("filing_id", "report_date", "fiscal_year_focus", "fiscal_period_focus")
    rows = classified(facts.join(own, "filing_id"), "start_date", "end_date", "instant_date", "report_date", "fiscal_year_focus", "fiscal_period_focus")
    return rows.drop("report_date", "fiscal_year_focus", "fiscal_period_focus")


def top_or_ambiguous(rows: DataFrame, keys: list[str], order: list[Column], distinct: Column, pick: Column) -> DataFrame:
    """For each key the rows that come first in `order`: `chosen` is the least `pick` of them, `n_distinct` counts their values of `distinct`.

    One shuffle: the window and the aggregate share their keys.
    """
    window = W.Window.partitionBy(*keys).orderBy(*order)
    top = rows.withColumn("_r", F.rank().over(window)).where("_r = 1")
    return top.groupBy(*keys).agg(F.min(pick).alias("chosen"), F.size(F.collect_set(distinct)).alias("n_distinct"))


def canonical_facts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(canonical facts, findings): one fact for each filing, concept, type, period and unit.

    Facts without dimensions only; anchored before not, with a context before without. Several best
    candidates are accepted if they agree on context, unit, value and text.
    """
    keys = ["filing_id", "concept_norm", "value_type", "period_key", "unit_canon"]
    anchored, bound = F.col("source_anchor").isNull().cast("int"), F.col("context_id").isNull().cast("int")
    plain = facts.where("dimension_count = 0")
    signature = F.to_json(F.struct("context_id", "unit_canon", "value_num", "value_text"))
    rest = [c for c in facts.columns if c not in keys]
    pick = F.struct(F.coalesce("source_anchor", F.lit("")).alias("_a"), F.col("fact_evidence_id").alias("_e"), *rest)
    best = top_or_ambiguous(plain, keys, [anchored, bound], signature, pick)
    canon_id = digest(F.col("filing_id"), F.col("concept_norm"), F.col("period_key"), F.col("value_type"), F.col("unit_canon"))
    reason = F.concat_ws("; ", F.lit("dimensionless-first"), F.when(F.col("source_anchor").isNull(), "synthetic-locator").otherwise("anchored"), F.when(F.col("context_id").isNull(), "context-missing").otherwise("context-bound"))
    chosen = best.where("n_distinct = 1").select(*keys, *[F.col(f"chosen.{c}") for c in rest])
    chosen = chosen.withColumn("canon_id", canon_id).withColumn("selection_reason", reason)
    return chosen, findings(facts, best)


def findings(facts: DataFrame, best: DataFrame) -> DataFrame:
    """filing_id, code, entity_key of every data-quality finding, once each.

    Values differ if they differ as numbers: 100 and 100.0 are one (as text they would be two).
    """
    ref = F.coalesce("source_anchor", F.concat(F.col("source_file"), F.lit("::ord="), F.lpad(F.col("fact_ordinal").cast("string"), 6, "0")))
    none = F.coalesce("unit_canon", F.lit("none"))
    group = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("concept_norm", "value_type", "period_key", "unit_canon")])
    missing = facts.where("fact_evidence_id IS NULL").select("filing_id", F.lit("MISSING_EVIDENCE_ID").alias("code"), ref.alias("entity_key"), "concept_norm")
    odd = facts.where("period_type = 'DUR_OTHER' OR period_key = 'UNKNOWN_PERIOD'")
    odd = odd.select("filing_id", F.lit("PERIOD_ALIGNMENT_FAIL").alias("code"), F.coalesce("context_id", ref).alias("entity_key"), "concept_norm")
    numeric = facts.where("dimension_count = 0 AND value_type = 'numeric' AND value_num IS NOT NULL")
    clash = numeric.groupBy("filing_id", "concept_norm", "period_key", "unit_canon").agg(F.countDistinct("value_num").alias("n")).where("n > 1")
    clash = clash.select("filing_id", F.lit("UNIT_SCALE_MISMATCH").alias("code"), F.concat_ws("|", "concept_norm", "period_key", none).alias("entity_key"), "concept_norm")
    keys = ["filing_id", "concept_norm", "value_type", "period_key", "unit_canon"]
    dims = facts.groupBy(*keys).agg(F.max((F.col("dimension_count") == 0).cast("int")).alias("any")).where("any = 0")
    unsure = best.where("n_distinct > 1").select(*keys).unionByName(dims.select(*keys))
    unsure = unsure.select("filing_id", F.lit("CONTEXT_SELECTION_AMBIGUOUS").alias("code"), group.alias("entity_key"), "concept_norm")
    return missing.unionByName(odd).unionByName(clash).unionByName(unsure).distinct()


def nearest_asof_join(left: DataFrame, right: DataFrame, on: list[str], left_date: str, right_date: str, days: int) -> DataFrame:
    """Pairs of rows at most `days` apart, in either direction, with `day_delta`.

    Dates are dealt to stretches of 2 * days + 1 days. What a left row reaches lies in two of them at
    most, so it is doubled and the join stays an equi join.
    """
    width = 2 * days + 1
    stretch = lambda day: F.floor(day / F.lit(width))
    at = F.unix_date(F.col(left_date))
    reach = F.sequence(stretch(at - days), stretch(at + days))
    spread = left.withColumn("_stretch", F.explode(reach))
    other = right.withColumnRenamed(right_date, "matched_date") if right_date not in left.columns else right.withColumn("matched_date", F.col(right_date))
    paired = spread.join(other.withColumn("_stretch", stretch(F.unix_date("matched_date"))), [*on, "_stretch"]).drop("_stretch")
    return paired.withColumn("day_delta", F.abs(F.datediff(F.col("matched_date"), F.col(left_date)))).where(F.col("day_delta") <= days)
