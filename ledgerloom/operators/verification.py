"""Proposals checked against recomputed evidence; context packs, profiles, bindings and record checks.

A proposal is a row, every check a boolean column, and the outcome follows from those that failed.

Defined cases: a proposal of another task fails for good; one without a task, or of no known action,
has no valid schema; evidence over the cap or over the token limit is refused, never cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import value_equal

MAX_TOKENS, MAX_EVIDENCE = 14_336, 5
INJECTION = "PROMPT_INJECTION_DETECTED"
# Keys that would give an answer away.
GOLD_KEYS = (
    "answerability canonical_answer correct_answer expected_answer expected_chunk_ids expected_evidence_ids expected_refusal_code expected_status expected_value extractive_answer gold "
    "gold_answer gold_label gold_value ground_truth is_answerable label_answer reference_answer solution source_answer_id target target_answer target_status target_value"
).split()


def leaks_gold(record: Column) -> Column:
    """Whether a JSON text has, at any depth, a key that gives the answer away."""
    return F.coalesce(record.rlike(f'"(?i:{"|".join(GOLD_KEYS)})"\\s*:'), F.lit(False))


def same_unit(a: Column, b: Column) -> Column:
    plain = lambda u: F.regexp_replace(F.lower(F.trim(u)), "^iso4217[:_]", "")
    return F.coalesce(plain(a) == plain(b), F.lit(False)) | (a.isNull() & b.isNull())


def verify_quant(proposals: DataFrame) -> DataFrame:
    """With checks (name to boolean), failed (their names in order) and disposition of quantitative proposals.

    Columns: task (task_id, filing_id, metric, period_key, evidence_ids, allowed_codes, hostile), proposal (task_id, action,
    period_key, value, unit, answer_text, n_claims, evidence_ids, refusal_code), observation (the same task's, as a tool reported it:
    task_id, filing_id, metric, period_key, status, value, unit, evidence_ids, refusal_code), computed (status, value,
    unit, evidence_ids, refusal_code, as `operators.evidence.evaluate` gives them) and repairs (0 or 1).

    Dispositions: RELEASED and SAFE_REFUSAL where nothing failed, else REPAIR_REQUIRED the first time, FAILED after a repair
    or for a proposal of another task.
    """
    t, p, o, c = ((lambda f, s=s: F.col(f"{s}.{f}")) for s in ("task", "proposal", "observation", "computed"))
    yes = lambda x: F.coalesce(x, F.lit(False))
    inside = lambda a, b: F.size(F.array_except(a, b)) == 0
    equal_sets = lambda a, b: yes(inside(a, b) & inside(b, a))
    schema = p("task_id").isNotNull() & p("action").isin("ANSWER", "REFUSE")
    other = p("task_id").isNotNull() & (p("task_id") != t("task_id"))
    answer, refuse = p("action") == "ANSWER", p("action") == "REFUSE"
    injected = refuse & (p("refusal_code") == INJECTION)
    stops = t("hostile") & injected  # nothing after the refusal's own check counts
    seen = F.col("observation").isNotNull()
    value_same = lambda a, b: yes(value_equal(a.cast("string"), b.cast("string")) & a.isNotNull() & b.isNotNull())
    expected = F.when(c("status") == "OK", c("evidence_ids")).otherwise(o("evidence_ids"))
    reproduced = (o("status") == c("status")) & (o("period_key") == t("period_key")) & ((o("status") != "OK") | (value_same(o("value"), c("value")) & same_unit(o("unit"), c("unit")) & equal_sets(o("evidence_ids"), c("evidence_ids"))))
    refusal = F.when(stops, F.array_contains(t("allowed_codes"), INJECTION)).otherwise(F.array_contains(t("allowed_codes"), p("refusal_code")) & (o("status") == "REFUSAL") & (p("refusal_code") == o("refusal_code")))
    final, after = schema & ~other, schema & ~other & ~stops
    checks = [
        ("SCHEMA_VALID", ~other, schema), ("TASK_MATCH", F.lit(True), ~other),
        ("EVIDENCE_VALID", final, inside(p("evidence_ids"), t("evidence_ids"))),
        ("PERIOD_MATCH", final, (p("period_key") == t("period_key")) | (refuse & p("period_key").isNull())),
        ("PROMPT_INJECTION_CLEAR", final, ~t("hostile") | injected),
        ("REFUSAL_VALID", final & refuse & (stops | seen), refusal), ("TOOL_OBSERVATION_PRESENT", after, seen),
        ("OBSERVATION_SCOPE_VALID", after & seen, (o("task_id") == t("task_id")) & (o("filing_id") == t("filing_id")) & (o("metric") == t("metric"))),
        ("OBSERVATION_PERIOD_MATCH", after & seen, o("period_key") == t("period_key")),
        ("STATUS_MATCH", after & seen, (answer & (o("status") == "OK")) | (refuse & (o("status") == "REFUSAL"))),
        ("CITATIONS_MATCH", after & seen, equal_sets(expected, p("evidence_ids"))), ("OBSERVATION_EVIDENCE_VALID", after & seen, reproduced),
        ("ANSWER_SHAPE_VALID", after & seen & answer, p("value").isNotNull() & p("answer_text").isNull() & (F.coalesce(p("n_claims"), F.lit(0)) == 0)),
        ("VALUE_MATCH", after & seen & answer, (c("status") == "OK") & value_same(p("value"), c("value"))),
        ("ARITHMETIC_VALID", after & seen & answer, (o("status") == "OK") & (c("status") == "OK") & value_same(p("value"), o("value"))),
        ("UNIT_MATCH", after & seen & answer, (c("status") == "OK") & same_unit(p("unit"), c("unit"))),
    ]
    made = F.array_compact(F.array(*[F.when(yes(applies), F.struct(F.lit(name).alias("name"), yes(test).alias("passed"))) for name, applies, test in checks]))
    out = proposals.withColumn("checks", made).withColumn("failed", F.transform(F.filter("checks", lambda x: ~x["passed"]), lambda x: x["name"]))
    fine, final_failure = F.size("failed") == 0, (F.col("repairs") >= 1) | other
    return out.withColumn("disposition", F.when(fine & answer, "RELEASED").when(fine, "SAFE_REFUSAL").when(final_failure, "FAILED").otherwise("REPAIR_REQUIRED"))


def context_packs(evidence: DataFrame, tokens: Column, fixed: int = 0, most: int = MAX_TOKENS, items: int = MAX_EVIDENCE) -> DataFrame:
    """One row a task: its evidence in the order of (rank, id) whole, its tokens, and the code of what does not fit.

    evidence: task_id, evidence_id, rank, content. Too many items are counted, not gathered.
    """
    sized = evidence.withColumn("_t", tokens).withColumn("_r", F.coalesce("rank", F.lit(2**31 - 1)))
    counts = sized.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_items"), (F.sum("_t") + fixed).alias("n_tokens"), F.count_distinct("evidence_id").alias("_d"))
    code = F.when(F.col("n_items") > items, "EVIDENCE_LIMIT_EXCEEDED").when(F.col("_d") < F.col("n_items"), "DUPLICATE_EVIDENCE").when(F.col("n_tokens") > most, "CONTEXT_OVERFLOW")
    counts = counts.withColumn("code", code).drop("_d")
    fits = sized.join(counts.where("code IS NULL").select("task_id"), "task_id", "left_semi")
    held = fits.groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "evidence_id", "content"))), lambda e: F.struct(e["evidence_id"], e["content"])).alias("pack"))
    return counts.join(held, "task_id", "left")


def source_entity(row: list[str], metadata: list[str], fallback: list[str]) -> Column:
    """The strongest issuer identifier: the first of the row's own, then of its metadata, then the fallbacks, that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in (*row, *metadata, *fallback)])


def profiles(inputs: DataFrame, keys: list[str]) -> DataFrame:
    """unit, context and dimension profile of each task from its inputs (unit, context_id, dimensions): sorted sets, digests, or that there are none."""
    units, contexts = F.array_sort(F.collect_set("unit")), F.array_sort(F.collect_set("context_id"))
    dims = F.array_sort(F.collect_set(F.to_json(F.array_sort(F.map_entries("dimensions")))))
    any_dims, known = F.max((F.size("dimensions") > 0).cast("int")), F.count("dimensions")
    return inputs.groupBy(*keys).agg(
        F.coalesce(F.nullif(F.array_join(units, "|"), F.lit("")), F.lit("UNSPECIFIED")).alias("unit_profile"),
        F.when(F.size(contexts) > 0, F.substring(F.sha2(F.array_join(contexts, "|"), 256), 1, 16)).otherwise("UNSPECIFIED").alias("context_profile"),
        F.when(known == 0, "UNSPECIFIED").when(any_dims == 0, "DIMENSIONLESS").otherwise(F.substring(F.sha2(F.array_join(dims, "|"), 256), 1, 16)).alias("dimension_profile"),
    )


def asof_bindings(inputs: DataFrame, task: str) -> DataFrame:
    """(task, selector, period_key): the one exact balance date of each as-of selector; the prior year's only beside the current one's.

    inputs: task, selector, period_key. A malformed key, or two, bind nothing.
    """
    current, prior = "current_period_end_asof", "prior_year_period_end_asof"
    day = F.try_to_date(F.regexp_extract(F.coalesce("period_key", F.lit("")), r"^ASOF_(\d{8})$", 1), "yyyyMMdd")
    rows = inputs.where(F.col("selector").isin(current, prior)).withColumn("_day", day)
    per = rows.groupBy(task, "selector").agg(F.count(F.lit(1)).alias("_n"), F.count("_day").alias("_ok"), F.count_distinct("period_key").alias("_d"), F.min("period_key").alias("period_key"))
    bound = per.where("_n = _ok AND _d = 1").select(task, "selector", "period_key")
    have = bound.where(F.col("selector") == current).select(task)
    return bound.where(F.col("selector") == current).unionByName(bound.where(F.col("selector") == prior).join(have, task, "left_semi"))


def question_problem(question: Column, ticker: Column, name: Column, period_key: Column, subtype: Column) -> Column:
    """Why a narrative question can't stand: its length, marks, fragments, or that it names no issuer, year or subtype; null if it can."""
    low = F.lower(question)
    n = F.size(F.regexp_extract_all(question, F.lit(r"([A-Za-z0-9][A-Za-z0-9'’.-]*)"), 1))
    marks = F.length(question) - F.length(F.replace(question, F.lit("?"), F.lit("")))
    year = F.nullif(F.regexp_extract(period_key, r"((?:19|20)\d{2})", 1), F.lit(""))
    said = lambda c: F.coalesce((c != "") & F.contains(low, F.lower(c)), F.lit(False))
    words = {"footnote_note": ["footnote"], "accounting_policy": ["accounting", "policy"], "auditor_report_opinion_language": ["auditor", "opinion"], "critical_audit_matter": ["critical audit matter", "auditor"]}
    fits = F.lit(False)
    for kind, markers in words.items():
        held = subtype == kind
        for m in markers:
            held = held & F.contains(low, F.lit(m))
        fits = fits | F.coalesce(held, F.lit(False))
    return (
        F.when(question.isNull() | (question != F.trim(question)), "NOT_STRIPPED").when(~n.between(8, 40), "LENGTH").when((marks != 1) | ~question.endswith("?"), "NOT_ONE_QUESTION")
        .when(low.startswith("financial statements ") | F.contains(question, F.lit("...")), "FRAGMENT").when(question.rlike("\n|  "), "NOT_NORMALISED")
        .when(~(said(ticker) | said(name)), "NO_ISSUER").when(year.isNull() | ~F.coalesce(F.contains(question, year), F.lit(False)), "NO_YEAR").when(~fits, "SUBTYPE")
    )


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and change (added, removed, changed, same) between two releases, with the columns that differ."""
    a, b = old.select(F.col(key), F.struct(*columns).alias("a")), new.select(F.col(key), F.struct(*columns).alias("b"))
    both = a.join(b, key, "full_outer")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns]))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(differ) > 0, "changed").otherwise("same")
    return both.select(key, kind.alias("change"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), differ).otherwise(F.array().cast("array<string>")).alias("columns"))


def data_quality(issuers: DataFrame, filings: DataFrame, downloads: DataFrame, ingests: DataFrame) -> DataFrame:
    """One row: counts and rates of issuers resolved, filings downloaded and filings ingested."""
    n = lambda test: F.coalesce(F.sum(test.cast("long")), F.lit(0))
    is_ = lambda c, *v: F.coalesce(F.col(c).isin(*v), F.lit(False))
    a = issuers.agg(F.count(F.lit(1)).alias("issuers"), n(is_("status", "resolved")).alias("resolved_issuers"), n(F.col("cik").isNotNull()).alias("_cik"))
    b = filings.agg(F.count(F.lit(1)).alias("filings"), n(is_("status", "resolved")).alias("resolved_filings"))
    c = downloads.agg(n(is_("status", "downloaded", "cached")).alias("downloaded"))
    d = ingests.agg(n(is_("status", "ingested")).alias("ingested"))
    row = a.join(b).join(c).join(d)  # one row each
    over = lambda x, y: F.round(F.col(x) / F.greatest(F.lit(1), F.col(y)), 6)
    return row.select("issuers", "resolved_issuers", "filings", "resolved_filings", over("_cik", "issuers").alias("resolution_rate"), over("downloaded", "resolved_filings").alias("download_rate"), over("ingested", "downloaded").alias("ingest_rate"))

