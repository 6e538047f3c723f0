"""Tasks made of answers: specifications, distractors, traps, splits, datasets, plans and their execution.

Every operator is a plan over the answers of `plans.metrics.answers`; nothing is grouped beyond one
filing's period or one metric of a filing.

Defined cases: an answer without a ticker is keyed by its filing; a period without facts has no
distractors; with one issuer-year, or none, nothing is held out; a plan with an unknown operation or
a changed schema is refused, not raised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.numbers import canonical_decimal, digest, hash_share

EXECUTOR, SCHEMA, VERSION = "answer_metric_spec", "structured_answer.v1", "v1"
DISTRACTORS = 4
#: The type of a negative by refusal.
NEGATIVE = {
    "MISSING_INPUT": "missing_input", "AMBIGUOUS_CONTEXT": "ambiguous_context", "INCOMPATIBLE_UNITS": "incompatible_units",
    "PERIOD_NOT_SUPPORTED": "period_not_supported", "ZERO_DENOMINATOR": "zero_denominator",
}
TEMPLATES = ["What is {metric} of {ticker} for {period}?", "Using filing {filing}, compute {metric} for {period}.", "Report the {metric} that {ticker} shows in {period}."]


def negative_type(code: Column) -> Column:
    out = F.when(code.isNull(), None)
    for refusal, name in NEGATIVE.items():
        out = out.when(code == refusal, name)
    return out.otherwise("deterministic_refusal")


def distractors(tasks: DataFrame, facts: DataFrame, used: str = "concepts", most: int = DISTRACTORS) -> DataFrame:
    """`tasks` with the first `most` facts, by concept and id, of the same filing and period whose concept and evidence it does not use.

    The facts of a filing's period meet once, whatever the number of its tasks.
    """
    fact = F.struct("concept_norm", "fact_evidence_id", "unit_canon", F.col("value_num").cast("string").alias("value"))
    held = facts.groupBy("filing_id", "period_key").agg(F.array_sort(F.collect_list(fact)).alias("_facts"))
    joined = tasks.join(held, ["filing_id", "period_key"], "left")
    none = F.expr("array_repeat(named_struct('concept_norm', '', 'fact_evidence_id', '', 'unit_canon', '', 'value', ''), 0)")
    free = F.filter(F.coalesce("_facts", none), lambda f: ~F.array_contains(F.col(used), f["concept_norm"]) & ~F.array_contains(F.col("evidence_ids"), f["fact_evidence_id"]))
    return joined.withColumn("distractors", F.slice(free, 1, most)).drop("_facts")


def task_specs(answers: DataFrame, facts: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """One task for each answer: target, concepts used, distractors, negative type and the filing's validator codes."""
    used = facts.select(F.explode(F.array("fact_evidence_id")).alias("_e"), "concept_norm")
    own = answers.select("answer_id", F.explode("evidence_ids").alias("_e")).join(used, "_e").groupBy("answer_id").agg(F.array_sort(F.collect_set("concept_norm")).alias("concepts"))
    tasks = answers.join(own, "answer_id", "left").withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>")))
    tasks = tasks.withColumn("task_id", digest("quant", F.col("answer_id"))).withColumn("negative_type", F.when(F.col("status") == "REFUSAL", negative_type(F.col("refusal_code"))))
    tasks = distractors(tasks, facts)
    if findings is None:
        return tasks.withColumn("validator_codes", F.array().cast("array<string>"))
    codes = findings.groupBy("filing_id").agg(F.array_sort(F.collect_set("code")).alias("validator_codes"))
    return tasks.join(codes, "filing_id", "left").withColumn("validator_codes", F.coalesce("validator_codes", F.array().cast("array<string>")))


def deduplicated(tasks: DataFrame, order: list[str]) -> DataFrame:
    """One row of each task, the first in `order`, with the validator codes of all of them."""
    rest = [c for c in tasks.columns if c not in ("task_id", "validator_codes")]
    merged = tasks.groupBy("task_id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_t"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("validator_codes")))).alias("validator_codes"))
    return merged.select("task_id", "_t.*", "validator_codes")


def siblings(tasks: DataFrame) -> DataFrame:
    """With `sibling`: the least other period of the filing's metric; two least ones are kept, so no pairs are made."""
    two = tasks.groupBy("filing_id", "metric").agg(F.slice(F.array_sort(F.collect_set("period_key")), 1, 2).alias("_p"))
    first, second = F.get("_p", 0), F.get("_p", 1)
    joined = tasks.join(two, ["filing_id", "metric"])
    return joined.withColumn("sibling", F.when(first == F.col("period_key"), second).otherwise(first)).drop("_p")


def hard_negatives(tasks: DataFrame) -> DataFrame:
    """negative_id, task_id, filing_id, metric, period_key, negative_type and detail: refusals themselves, and for answers distractor, period trap, context and unit traps, and a wrong evidence map."""
    rows = siblings(tasks)
    ok = F.col("status") == "OK"
    free = F.transform("distractors", lambda d: d["fact_evidence_id"])
    kind = lambda test, name, key, detail: F.when(test, F.struct(F.lit(name).alias("negative_type") if isinstance(name, str) else name.alias("negative_type"), key.alias("_k"), detail.alias("detail")))
    mutated = F.concat(F.slice("evidence_ids", 2, 1_000_000), F.slice(free, 1, 1))
    has = lambda code: ok & F.array_contains("validator_codes", code)
    kinds = F.array_compact(F.array(
        kind(~ok, F.col("negative_type"), F.coalesce("refusal_code", F.lit("refusal")), F.col("refusal_code")),
        kind(ok & (F.size("distractors") > 0), "distractor", F.lit("distractor"), F.array_join(free, ",")),
        kind(ok & F.col("sibling").isNotNull(), "period_trap", F.lit("period-trap"), F.col("sibling")),
        kind(has("CONTEXT_SELECTION_AMBIGUOUS"), "context_ambiguity", F.lit("context-ambiguity"), F.lit("CONTEXT_SELECTION_AMBIGUOUS")),
        kind(has("UNIT_SCALE_MISMATCH"), "unit_trap", F.lit("unit-trap"), F.lit("UNIT_SCALE_MISMATCH")),
        kind(ok, "wrong_evidence_map", F.lit("wrong-evidence-map"), F.array_join(mutated, ",")),
    ))
    out = rows.select("task_id", "filing_id", "metric", "period_key", F.explode(kinds).alias("_n")).select("task_id", "filing_id", "metric", "period_key", "_n.*")
    return out.withColumn("negative_id", digest("hard-negative", F.col("task_id"), F.col("_k"))).drop("_k")


def holdout_split(tasks: DataFrame, version: str = "v1", key: Column | None = None) -> DataFrame:
    """With `split`: eval_holdout for a fifth of the issuer-years by hash; the last one only where the hash takes none or all."""
    key = F.concat_ws(":", F.coalesce("ticker", "filing_id"), F.coalesce(F.col("fiscal_year").cast("string"), F.lit("None"))) if key is None else key
    keyed = tasks.withColumn("_key", key)
    drawn = hash_share(F.concat(F.lit(f"holdout|{version}|"), F.col("_key"))) % 5 == 0
    # one row, whatever the tasks
    all_keys = keyed.select("_key").distinct().agg(F.count(F.lit(1)).alias("_n"), F.sum(drawn.cast("int")).alias("_eval"), F.max("_key").alias("_last"))
    eval_key = F.when(F.col("_n") <= 1, False).when(F.col("_eval").isin(0) | (F.col("_eval") == F.col("_n")), F.col("_key") == F.col("_last")).otherwise(drawn)
    return keyed.join(F.broadcast(all_keys)).withColumn("split", F.when(eval_key, "eval_holdout").otherwise("train")).drop("_key", "_n", "_eval", "_last")


def question(task_id: Column, metric: Column, ticker: Column, filing: Column, period: Column) -> tuple[Column, Column]:
    """(template, text): the template is drawn by the task's hash."""
    n = (hash_share(F.concat(F.lit("question|"), task_id)) % len(TEMPLATES)).cast("int")
    fill = lambda t: F.concat(*[{"metric": metric, "ticker": F.coalesce(ticker, F.lit("UNKNOWN")), "filing": filing, "period": period}[p] if p in ("metric", "ticker", "filing", "period") else F.lit(p) for p in _parts(t) if p])
    return n, F.element_at(F.array(*[fill(t) for t in TEMPLATES]), n + 1)


def _parts(template: str) -> list[str]:
    return template.replace("{", "\0").replace("}", "\0").split("\0")


def datasets(tasks: DataFrame) -> DataFrame:
    """Rows for the data sets: held-out tasks to `eval`, answers to `qa` and `code`, refusals to `refusal`; partition the sink by `dataset`."""
    target = F.when(F.col("split") == "eval_holdout", F.array(F.lit("eval"))).when(F.col("status") == "OK", F.array(F.lit("qa"), F.lit("code"))).otherwise(F.array(F.lit("refusal")))
    n, text = question(F.col("task_id"), F.col("metric"), F.col("ticker"), F.col("filing_id"), F.col("period_key"))
    rows = tasks.withColumn("template", n).withColumn("question", text).withColumn("dataset", F.explode(target))
    family = F.concat_ws(":", F.lit("quant_metric"), "metric", F.lower("status"))
    return rows.withColumn("task_family", family).withColumn("code", F.when(F.col("dataset") == "code", code_target(F.col("task_id"), F.col("metric"), F.col("filing_id"), F.col("period_key"))))


def code_target(task_id: Column, metric: Column, filing: Column, period: Column) -> Column:
    """A script that runs the task's plan."""
    plan = F.to_json(plan_of(task_id, metric, filing, period))
    return F.concat(F.lit("import json\n\nplan = json.loads("), F.to_json(F.array(plan)), F.lit("[0])\nanswer = execute(plan)\n"))


def plan_of(task_id: Column, metric: Column, filing: Column, period: Column) -> Column:
    fields = {"executor_op": F.lit(EXECUTOR), "filing_id": filing, "metric": metric, "output_schema": F.lit(SCHEMA), "period_key": period, "plan_version": F.lit(VERSION), "task_id": task_id}
    return F.struct(*[c.alias(k) for k, c in fields.items()])


def execute_plans(plans: DataFrame, answers: DataFrame) -> DataFrame:
    """The structured answer of each plan (task_id, filing_id, metric, period_key, executor_op, output_schema): status, value, unit, evidence_ids, refusal_code."""
    valid = (F.col("executor_op") == EXECUTOR) & (F.col("output_schema") == SCHEMA)
    own = answers.select("filing_id", "metric", "period_key", F.lit(True).alias("_found"), "status", "value", "unit", "evidence_ids", "refusal_code")
    joined = plans.join(own, ["filing_id", "metric", "period_key"], "left")
    known = valid & F.coalesce("_found", F.lit(False))
    code = F.when(~valid | F.col("executor_op").isNull() | F.col("output_schema").isNull(), "UNSUPPORTED_REQUEST").when(F.col("_found").isNull(), "TASK_NOT_SUPPORTED").otherwise(F.col("refusal_code"))
    return joined.select(
        "task_id", "filing_id", "metric", "period_key", F.when(known, F.col("status")).otherwise("REFUSAL").alias("status"), F.when(known, F.col("value")).alias("value"),
        F.when(known, F.col("unit")).alias("unit"), F.when(known, F.col("evidence_ids")).otherwise(F.array().cast("array<string>")).alias("evidence_ids"), code.alias("refusal_code"),
    )


def routed(questions: DataFrame, tasks: DataFrame, filing: str = "filing_id") -> DataFrame:
    """With task_id: the one task of the question's filing whose metric and period the question names.

    A metric in parentheses wins over one named in words, a longer name over a shorter one, likewise
    the longest period key between word boundaries. No task, or several, leaves it null.
    """
    pairs = questions.join(tasks.select(filing, "task_id", "metric", "period_key"), filing)
    low = F.lower("question")
    words = F.replace(F.lower("metric"), F.lit("_"), F.lit(" "))
    weight = F.when(F.contains(low, F.concat(F.lit("("), F.lower("metric"), F.lit(")"))), 1000 + F.length("metric")).when(F.contains(low, F.lower("metric")) | F.contains(low, words), F.length("metric"))
    # a key is letters, digits and _: a word boundary on both sides
    at = F.when(F.regexp_like(low, F.concat(F.lit(r"\b"), F.lower("period_key"), F.lit(r"\b"))), F.length("period_key"))
    scored = pairs.withColumn("_m", weight).withColumn("_p", at).where("_m IS NOT NULL AND _p IS NOT NULL")
    order = W.Window.partitionBy("question_id").orderBy(F.desc("_m"), F.desc("_p"))
    best = scored.withColumn("_r", F.rank().over(order)).where("_r = 1").groupBy("question_id").agg(F.when(F.count(F.lit(1)) == 1, F.max("task_id")).alias("task_id"))
    return questions.join(best, "question_id", "left")


def structured_value(value: Column) -> Column:
    return canonical_decimal(value)
