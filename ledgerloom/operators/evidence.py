"""Metrics recomputed from the evidence of a task, with refusals in a fixed order.

Evidence comes as rows that say which input of which task they stand for. Each check is a count
over the rows of one (task, input); the first failing check of the first input in the metric's
order is the refusal, then those over all inputs, then the formula's. No row is looked at twice.

Unlike the corpus engine a division wants equal units, the evidence keeps its own order, a value's
text is canonical, and periods must match the selector exactly.

Defined cases: a task without evidence lacks its first input; a null dimension map is malformed, an
empty one is not; evidence of a filing outside the task's scope makes the context ambiguous.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import EXACT, canonical_decimal
from ..functions.periods import shift_year
from ..plans.metrics import compile_formula
from ..plans.specs import CURRENT, END, LAST_END, LAST_QUARTER, PRIOR_YEAR, SPECS, THIS_QUARTER, Spec
from ..schemas import AMBIGUOUS, MISSING, PERIODS, UNITS, ZERO

UNSUPPORTED = "UNSUPPORTED_REQUEST"
# Dimensions and members of current creditors, local names of UK inputs.
CURRENT_CREDITORS = {"financialinstrumentcurrentnoncurrentdimension": "currentfinancialinstruments", "maturitiesorexpirationperiodsdimension": "withinoneyear"}
UK_INPUTS = {"assets_current": ["currentassets"], "liabilities_current": ["creditorsamountsfallingduewithinoneyear", "currentliabilities", "creditors"]}


def local_name(name: Column) -> Column:
    """After the last colon or underscore, lower case, letters and digits only; nothing left is null."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(F.trim(name), "([^:_]*)$", 1)), "[^a-z0-9]", ""), F.lit(""))


def plain_unit(unit: Column) -> Column:
    """Lower case, without the ISO 4217 prefix; blank is null."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(unit)), "^iso4217:", ""), "^iso4217_", ""), F.lit(""))


def expected_period(selector: Column, key: Column, end: Column) -> Column:
    """The period key that a selector asks for, given the task's key and the end of its period."""
    year = F.regexp_extract(key, r"(\d{4})$", 1).try_cast("int")
    prefix, full = F.regexp_extract(key, r"^((?:YTD_)?Q[1-4])_\d{4}$", 1), F.regexp_extract(key, r"^FY(\d{4})$", 1)
    quarter = F.regexp_extract(key, r"^(?:YTD_)?Q([1-4])_\d{4}$", 1).try_cast("int")
    before = F.when(full != "", F.concat(F.lit("FY"), year - 1)).when(prefix != "", F.concat(prefix, F.lit("_"), year - 1))
    named = lambda q, y: F.when(quarter.isNotNull(), F.concat(F.lit("Q"), q, F.lit("_"), y))
    back = named(F.when(quarter == 1, 4).otherwise(quarter - 1), F.when(quarter == 1, year - 1).otherwise(year))
    asof = lambda day: F.concat(F.lit("ASOF_"), F.date_format(day, "yyyyMMdd"))
    return (
        F.when(selector == CURRENT, key).when(selector == PRIOR_YEAR, before).when(selector == THIS_QUARTER, named(quarter, year))
        .when(selector == LAST_QUARTER, back).when(selector == END, asof(end)).when(selector == LAST_END, asof(shift_year(end, -1)))
    )


def period_type(key: Column) -> Column:
    return F.when(key.startswith("ASOF_"), "ASOF").when(key.startswith("FY"), "FY").when(key.startswith("YTD_Q"), "YTD").when(key.startswith("Q"), "Q")


def plain_dimensions(dimensions: Column) -> Column:
    """Local names of axes and members; null if the map, or a name in it, is missing."""
    named = F.transform(F.map_entries(dimensions), lambda e: F.struct(local_name(e["key"]).alias("axis"), local_name(e["value"]).alias("member")))
    return F.when(dimensions.isNotNull() & ~F.exists(named, lambda e: e["axis"].isNull() | e["member"].isNull()), named)


def _special(jurisdiction: Column, name: Column, scenario: Column, dimensions: Column) -> Column:
    allowed = reduce(lambda a, b: a | b, [(F.get(dimensions, 0)["axis"] == k) & (F.get(dimensions, 0)["member"] == v) for k, v in CURRENT_CREDITORS.items()])
    return F.coalesce((jurisdiction == "UK") & (name == "liabilities_current") & (scenario == "CURRENT_CREDITOR_ALLOWLIST") & (F.size(dimensions) == 1) & allowed, F.lit(False))


def _inputs(spark: SparkSession, specs: list[Spec]) -> DataFrame:
    """metric, periods, input, pos, selector and aliases of every input: a few dozen rows."""
    import re

    local = lambda alias: re.sub("[^a-z0-9]", "", re.split("[:_]", alias)[-1].lower())
    rows = [(s.name, list(s.periods), k, n, selector, [local(a) for a in aliases]) for s in specs for n, (k, (aliases, selector)) in enumerate(s.inputs.items())]
    return spark.createDataFrame(rows, "metric string, periods array<string>, input string, pos int, selector string, aliases array<string>")


def evaluate(tasks: DataFrame, evidence: DataFrame, specs: list[Spec] = SPECS) -> DataFrame:
    """task_id, status, value (canonical text), number, unit, evidence_ids and refusal_code of every task.

    tasks: task_id, filing_ids (the scope), metric, period_key, period_end, entity_id, jurisdiction, allowed_codes.
    evidence: task_id, pos, evidence_id, filing_id, input, value (text), unit, period_key, concept, context_id, entity_id, dimensions, scenario.
    """
    spec_rows = _inputs(tasks.sparkSession, specs)
    known = spec_rows.select("metric", "periods").distinct()
    base = tasks.join(F.broadcast(known), "metric", "left")
    wanted = base.join(F.broadcast(spec_rows.drop("periods")), "metric").select("task_id", "metric", "input", F.col("pos").alias("at"), "selector", "aliases", "jurisdiction", F.col("period_key").alias("task_period"), "period_end")
    scope = base.select("task_id", "filing_ids")
    rows = evidence.join(scope, "task_id").withColumn("foreign", ~F.coalesce(F.array_contains("filing_ids", F.col("filing_id")), F.lit(False)))
    foreign = rows.groupBy("task_id").agg(F.max(F.col("foreign").cast("int")).alias("foreign"))
    own = wanted.join(rows.where("NOT foreign").drop("filing_ids", "foreign"), ["task_id", "input"], "left")
    number = F.when(F.trim("value").rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim("value").try_cast(EXACT))
    dims = plain_dimensions(F.col("dimensions"))
    uk = F.create_map(*[x for k, v in UK_INPUTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    aliases = F.when((F.col("jurisdiction") == "UK") & F.col("input").isin(*UK_INPUTS), F.try_element_at(uk, F.col("input"))).otherwise(F.col("aliases"))
    own = own.withColumn("number", number).withColumn("unit_", plain_unit(F.col("unit"))).withColumn("dims", dims).withColumn("name", local_name(F.col("concept")))
    own = own.withColumn("special", _special(F.col("jurisdiction"), F.col("input"), F.col("scenario"), F.col("dims")))
    own = own.withColumn("want", expected_period(F.col("selector"), F.col("task_period"), F.col("period_end")))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    unfit = (
        ~F.coalesce(F.array_contains(aliases, F.col("name")), F.lit(False)) | blank("context_id") | blank("entity_id") | F.col("dims").isNull()
        | ((F.size("dims") > 0) & ~F.col("special")) | ((F.size("dims") == 0) & F.col("scenario").isNotNull())
    )
    here = F.col("evidence_id").isNotNull()
    n = lambda test: F.sum(F.when(test, 1).otherwise(0))
    context = F.when(here, F.struct(F.col("period_key").alias("p"), F.col("special").alias("s"), F.trim("context_id").alias("c")))
    per = own.groupBy("task_id", "metric", "input", "at").agg(
        n(here).alias("n"), n(here & F.col("number").isNull()).alias("no_number"), F.count_distinct("number").alias("n_values"), F.count_distinct(F.when(here, F.coalesce("unit_", F.lit("")))).alias("n_units"),
        F.min("number").alias("value"), F.min("unit_").alias("unit"), F.count_distinct("period_key").alias("n_periods"), n(here & F.col("period_key").isNull()).alias("no_period"),
        F.min("period_key").alias("period"), F.min("want").alias("want"), F.min("selector").alias("selector"), n(here & unfit).alias("unfit"), F.collect_set(F.trim("entity_id")).alias("entities"), F.collect_set(context).alias("contexts"),
        F.transform(F.array_sort(F.collect_set(F.when(here, F.struct("pos", "evidence_id")))), lambda s: s["evidence_id"]).alias("evidence"),
    )
    code = (
        F.when((F.col("n") == 0) | (F.col("no_number") > 0), MISSING).when((F.col("n_values") != 1) | (F.col("n_units") != 1), AMBIGUOUS)
        .when(~F.coalesce(F.col("unit").rlike("^[a-z]{3}$"), F.lit(False)), UNITS).when((F.col("n_periods") != 1) | (F.col("no_period") > 0), PERIODS)
        .when(~F.coalesce(F.col("period") == F.col("want"), F.lit(False)), PERIODS).when(F.col("unfit") > 0, AMBIGUOUS)
    )
    per = per.withColumn("code", code)
    resolved = F.struct("code", "value", "unit", F.lit(None).cast("string").alias("concept"), F.array_distinct("evidence").alias("evidence"))
    names = sorted({k for s in specs for k in s.inputs})
    wide = per.groupBy("task_id", "metric").agg(
        F.min_by("code", F.when(F.col("code").isNotNull(), F.col("at"))).alias("first"), F.array_distinct(F.flatten(F.collect_list("entities"))).alias("entities"),
        F.collect_set(F.struct("selector", "period")).alias("picked"), F.flatten(F.collect_list("contexts")).alias("contexts"), *[F.max(F.when(F.col("input") == k, resolved)).alias(f"i_{k}") for k in names],
    )
    all_of = base.join(wide.drop("metric"), "task_id", "left").join(foreign, "task_id", "left")
    seen = F.array_distinct("contexts")
    periods = F.array_distinct(F.transform(seen, lambda c: c["p"]))
    of = lambda p, special: F.size(F.array_distinct(F.transform(F.filter(seen, lambda c: (c["p"] == p) & (c["s"] == F.lit(special))), lambda c: c["c"])))
    clash = F.exists(periods, lambda p: (of(p, False) > 1) | (of(p, True) > 1) | ((of(p, True) > 0) & (of(p, False) != 1)))
    twice = F.exists("picked", lambda a: F.size(F.filter("picked", lambda b: b["selector"] == a["selector"])) > 1)
    formula = F.lit(None).cast("string")
    value, unit, ids = F.lit(None).cast("double"), F.lit(None).cast("string"), F.array().cast("array<string>")
    for spec in specs:
        term = compile_formula(spec.formula, {k: F.col(f"i_{k}") for k in spec.inputs}, units_in_divide=True)
        here_too = F.col("metric") == spec.name
        formula = F.when(here_too, term.code).otherwise(formula)
        value = F.when(here_too, term.value.cast("double")).otherwise(value)
        unit = F.when(here_too, term.unit).otherwise(unit)
        ids = F.when(here_too, F.array_distinct(term.evidence)).otherwise(ids)
    raw = (
        F.when(F.col("periods").isNull(), UNSUPPORTED).when(~F.coalesce(F.array_contains("periods", period_type(F.col("period_key"))), F.lit(False)), PERIODS)
        .when(F.col("foreign") == 1, AMBIGUOUS).when(F.col("first").isNotNull(), F.col("first")).when(F.size("entities") != 1, AMBIGUOUS).when(twice, PERIODS)
        .when(~F.coalesce(F.get("entities", 0) == F.trim("entity_id"), F.lit(False)), AMBIGUOUS).when(clash, AMBIGUOUS).otherwise(formula)
    )
    out = all_of.withColumn("_code", raw)
    allowed = lambda c: F.array_contains("allowed_codes", c)
    fallback = F.when(allowed(MISSING), MISSING).when(allowed(AMBIGUOUS), AMBIGUOUS).when(allowed(UNSUPPORTED), UNSUPPORTED).otherwise(F.col("_code"))
    mapped = F.when(F.col("_code").isNull(), None).when((F.col("_code") == ZERO) & allowed("DIVISION_BY_ZERO"), "DIVISION_BY_ZERO").when(F.array_contains("allowed_codes", F.col("_code")), F.col("_code")).otherwise(fallback)
    fine = F.col("_code").isNull()
    return out.select(
        "task_id", "metric", F.when(fine, "OK").otherwise("REFUSAL").alias("status"), F.when(fine, canonical_decimal(value.cast(EXACT))).alias("value"), F.when(fine, value).alias("number"),
        F.when(fine, unit).alias("unit"), F.when(fine, ids).otherwise(F.array().cast("array<string>")).alias("evidence_ids"), mapped.alias("refusal_code"),
    )


def materialised(ids: DataFrame, facts: DataFrame, most: int = 5) -> DataFrame:
    """The facts that tasks name as evidence, in order, with the content line; `problem` says why a task's evidence can't stand.

    ids: task_id, entity_id, issuer, pos, fact_evidence_id. Problems: an id that no fact or several
    facts have, a fact of another entity or issuer, more than `most` ids.
    """
    counted = facts.groupBy("fact_evidence_id").agg(
        F.count(F.lit(1)).alias("n_facts"), *[F.min(c).alias(c) for c in ("filing_id", "ticker", "concept_norm", "period_key", "unit_canon", "value_num", "value_text", "entity_identifier")]
    )
    rows = ids.join(counted, "fact_evidence_id", "left")
    wrong = (
        F.when(F.col("n_facts").isNull(), "MISSING_EVIDENCE").when(F.col("n_facts") > 1, "DUPLICATE_EVIDENCE").when(~F.col("entity_identifier").eqNullSafe(F.col("entity_id")), "FOREIGN_ENTITY")
        .when(~F.col("ticker").eqNullSafe(F.col("issuer")), "FOREIGN_ISSUER")
    )
    shown = F.coalesce(canonical_decimal(F.col("value_num")), F.col("value_text"), F.lit(""))
    content = F.concat_ws(" | ", "concept_norm", "period_key", F.coalesce("unit_canon", F.lit("")), shown)
    rows = rows.withColumn("problem", wrong).withColumn("content", content)
    # a task names a handful of facts
    over = rows.groupBy("task_id").agg(F.count(F.lit(1)).alias("_n"), F.min(F.when(F.col("problem").isNotNull(), F.struct("pos", "problem"))).alias("_p"))
    verdict = over.select("task_id", F.when(F.col("_n") > most, "TOO_MUCH_EVIDENCE").otherwise(F.col("_p.problem")).alias("task_problem"))
    return rows.join(verdict, "task_id")
