"""Metrics set at a time: all inputs of all metrics are resolved in one join, formulas are columns.

A request is what an input asks for: concepts in order of priority and a period selector. Every
period of every filing meets every request that applies to it; requests are a plan-time list of
some two dozen, whatever the data. A refusal is a row, never an exception: the first refused input
in the metric's order, else what the formula refuses, left before right.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import digest
from ..functions.periods import shift_year
from ..operators.selection import nearest_asof_join, top_or_ambiguous
from ..schemas import AMBIGUOUS, MISSING, PERIODS, UNITS, ZERO
from .specs import CURRENT, END, LAST_END, LAST_QUARTER, PRIOR_YEAR, SPECS, THIS_QUARTER, Spec

UNIT = "usd"
#: Days that a balance may lie from the end of the period.
NEAR_DAYS = 7
PERIOD = ["filing_id", "ticker", "period_type", "period_key", "period_end", "fiscal_year", "fiscal_quarter", "is_ytd"]
_EXACT = "decimal(38,6)"


def requests(specs: list[Spec]) -> dict[tuple, int]:
    out: dict[tuple, int] = {}
    for spec in specs:
        for request in spec.inputs.values():
            out.setdefault(request, len(out))
    return out


def periods(facts: DataFrame) -> DataFrame:
    return facts.select(*PERIOD).distinct()


def _targets(selector: str) -> Column:
    """Array of struct(slot, t_type, t_key, t_year, t_quarter, t_ytd) that the selector looks up; empty: the period does not support it."""
    year, quarter, kind, end = (F.col(c) for c in ("fiscal_year", "fiscal_quarter", "period_type", "period_end"))

    def row(slot: str | Column, t: Column | str, key: Column, y: Column, q: Column, ytd: Column | bool) -> Column:
        lit = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(lit(slot).alias("slot"), lit(t).alias("t_type"), key.alias("t_key"), y.cast("int").alias("t_year"), q.cast("int").alias("t_quarter"), lit(ytd).alias("t_ytd"))

    def asof(years: int) -> Column:
        day = shift_year(end, years)
        return row("x", "ASOF", F.concat(F.lit("ASOF_"), F.date_format(day, "yyyyMMdd")), year + years, quarter, False)

    empty = F.expr("array_repeat(named_struct('slot', '', 't_type', '', 't_key', '', 't_year', 0, 't_quarter', 0, 't_ytd', false), 0)")
    if selector == CURRENT:
        return F.array(row("x", kind, F.col("period_key"), year, quarter, F.col("is_ytd")))
    if selector == PRIOR_YEAR:
        prefix = F.when(kind == "YTD", "YTD_Q").otherwise("Q")
        same = row("x", kind, F.concat(prefix, quarter, F.lit("_"), year - 1), year - 1, quarter, F.col("is_ytd"))
        full = row("x", "FY", F.concat(F.lit("FY"), year - 1), year - 1, F.lit(4), False)
        return F.when(year.isNull(), empty).when((kind == "ASOF") & end.isNotNull(), F.array(asof(-1))).when(kind.isin("Q", "YTD") & quarter.isNotNull(), F.array(same)).when(kind == "FY", F.array(full)).otherwise(empty)
    if selector in (END, LAST_END):
        return F.when(end.isNull(), empty).otherwise(F.array(asof(0 if selector == END else -1)))
    back = selector == LAST_QUARTER
    y = F.when(quarter == 1, year - 1).otherwise(year) if back else year
    q = F.when(quarter == 1, 4).otherwise(quarter - 1) if back else quarter
    # the quarter itself and what it can be derived from
    each = [row(f"{p.lower()[0]}{n}", p, F.concat(F.lit(f"{prefix}{n}_"), y), y, F.lit(n), p == "YTD") for n in range(1, 5) for p, prefix in (("Q", "Q"), ("YTD", "YTD_Q"))]
    return F.when(year.isNull() | quarter.isNull(), empty).otherwise(F.filter(F.array(*each), lambda s: s["t_quarter"] <= q))


def _picked(rows: DataFrame, keys: list[str], order: list[Column], tie: list[Column]) -> DataFrame:
    """code, value, unit, concept, evidence of the best match for each key."""
    pick = F.struct(*[c.alias(f"_{k}") for k, c in enumerate(tie)], F.col("value_num").alias("value"), F.col("unit_canon").alias("unit"), F.col("concept_norm").alias("concept"), F.col("fact_evidence_id").alias("evidence"))
    best = top_or_ambiguous(rows, keys, order, F.to_json(F.struct("value_num", "value_text")), pick)
    code = F.when(F.col("n_distinct") > 1, AMBIGUOUS)
    return best.select(*keys, code.alias("code"), "chosen.value", "chosen.unit", "chosen.concept", F.array("chosen.evidence").alias("evidence"))


def resolve(facts: DataFrame, base: DataFrame, specs: list[Spec] = SPECS, ytd_mode: str = "reference") -> DataFrame:
    """PERIOD columns, request and the resolved input: struct(code, value, unit, concept, evidence).

    ytd_mode `reference`: a quarter that is not reported is the year to date less the previous
    quarter; `cumulative`: less the previous year to date.
    """
    asked = requests(specs)
    wanted_in = {r: sorted({p for s in specs if r in s.inputs.values() for p in s.periods}) for r in asked}
    each = []
    for (aliases, selector), n in asked.items():
        applies = F.col("period_type").isin(*wanted_in[aliases, selector])
        each.append(F.when(applies, F.struct(F.lit(n).alias("request"), F.array(*map(F.lit, aliases)).alias("aliases"), F.lit(selector).alias("selector"), _targets(selector).alias("targets"))))
    rows = base.select(*PERIOD, F.explode(F.array_compact(F.array(*each))).alias("_r")).select(*PERIOD, "_r.*")
    keys = [*PERIOD, "request"]
    looked = rows.select(*keys, "aliases", F.explode("targets").alias("_t")).select(*keys, "_t.*", F.posexplode("aliases").alias("alias_pos", "alias"))
    found = facts.select(
        F.col("ticker").alias("f_ticker"), F.col("filing_id").alias("f_filing"), "concept_norm", "unit_canon", "value_num", "value_text", "fact_evidence_id", "source_anchor",
        F.col("period_type").alias("f_type"), F.col("period_key").alias("f_key"), F.col("period_end").alias("f_end"),
        F.col("fiscal_year").alias("f_year"), F.col("fiscal_quarter").alias("f_quarter"), F.col("is_ytd").alias("f_ytd"),
    ).where(F.col("unit_canon") == UNIT)
    matches = looked.join(
        found,
        (looked.ticker.eqNullSafe(found.f_ticker)) & (looked["alias"] == found.concept_norm) & (looked.t_type == found.f_type) & (looked.t_key == found.f_key)
        & looked.t_year.eqNullSafe(found.f_year) & looked.t_quarter.eqNullSafe(found.f_quarter) & (F.coalesce(looked.t_ytd, F.lit(False)) == F.coalesce(found.f_ytd, F.lit(False))),
    )
    own, anchored = (F.col("f_filing") != F.col("filing_id")).cast("int"), F.col("source_anchor").isNull().cast("int")
    exact = _picked(matches, [*keys, "slot"], [F.col("alias_pos"), own, anchored], [F.col("f_filing"), F.col("fact_evidence_id")])
    # nearest balances, for the selectors of period ends
    ends = rows.where(F.col("selector").isin(END, LAST_END) & F.col("period_end").isNotNull())
    ends = ends.withColumn("target", F.when(F.col("selector") == END, F.col("period_end")).otherwise(shift_year(F.col("period_end"), -1)))
    ends = ends.select(*keys, "target", F.posexplode("aliases").alias("alias_pos", "concept_norm"))
    balances = found.where("f_type = 'ASOF'").withColumnRenamed("f_ticker", "ticker")
    close = nearest_asof_join(ends, balances, ["ticker", "concept_norm"], "target", "f_end", NEAR_DAYS)
    near = _picked(close, keys, [F.col("alias_pos"), F.col("day_delta")], [own, F.col("fact_evidence_id")])
    fields = ["code", "value", "unit", "concept", "evidence"]
    slots = ["x", "q1", "q2", "q3", "q4", "y1", "y2", "y3", "y4"]
    shape = F.struct(*fields)
    wide = exact.groupBy(*keys).agg(*[F.max(F.when(F.col("slot") == s, shape)).alias(s) for s in slots])
    out = rows.select(*keys, "selector", F.size("targets").alias("n_targets"))
    same = lambda a, b: reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in keys])
    out = out.join(wide, same(out, wide), "left").select(*[out[c] for c in (*keys, "selector", "n_targets")], *slots)
    near = near.select(*keys, shape.alias("near"))
    out = out.join(near, same(out, near), "left").select(*[out[c] for c in (*keys, "selector", "n_targets", *slots)], "near")
    # step by step: each quarter builds on the one before
    for name, column in _derived(ytd_mode):
        out = out.withColumn(name, column)
    return out.select(*keys, _resolved().alias("input"))


def _refused(code: str | Column) -> Column:
    code = F.lit(code) if isinstance(code, str) else code
    return F.struct(code.alias("code"), F.lit(None).cast(_EXACT).alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("concept"), F.array().cast("array<string>").alias("evidence"))


def _ok(c: Column) -> Column:
    return c.isNotNull() & c["code"].isNull()


def _direct(c: Column) -> Column:
    return F.when(c.isNull(), _refused(MISSING)).otherwise(c)


def _derived(ytd_mode: str) -> list[tuple[str, Column]]:
    """d1 to d4: each quarter as reported, or derived from the year to date."""
    out = [("d1", F.when(_ok(F.col("q1")), F.col("q1")).otherwise(_direct(F.col("y1"))))]
    for n in (2, 3, 4):
        now = F.col(f"y{n}")
        less = F.col(f"d{n - 1}") if ytd_mode == "reference" or n == 2 else _direct(F.col(f"y{n - 1}"))
        step = F.struct(
            F.lit(None).cast("string").alias("code"), (now["value"] - less["value"]).cast(_EXACT).alias("value"), now["unit"].alias("unit"),
            now["concept"].alias("concept"), F.concat(now["evidence"], less["evidence"]).alias("evidence"),
        )
        made = (
            F.when(less["code"].isNotNull(), _refused(less["code"])).when(~_ok(now), _refused(F.coalesce(now["code"], F.lit(MISSING))))
            .when(now["value"].isNull() | less["value"].isNull(), _refused(MISSING)).otherwise(step)
        )
        out.append((f"d{n}", F.when(_ok(F.col(f"q{n}")), F.col(f"q{n}")).otherwise(made)))
    return out


def _resolved() -> Column:
    back = F.col("selector") == LAST_QUARTER
    target = F.when(back, F.when(F.col("fiscal_quarter") == 1, 4).otherwise(F.col("fiscal_quarter") - 1)).otherwise(F.col("fiscal_quarter"))
    by_quarter = F.element_at(F.array("d1", "d2", "d3", "d4"), F.coalesce(target, F.lit(1)).cast("int"))
    at_end = F.when(F.col("x").isNull(), _direct(F.col("near"))).otherwise(F.col("x"))
    return (
        F.when(F.col("n_targets") == 0, _refused(PERIODS))
        .when(F.col("selector").isin(THIS_QUARTER, LAST_QUARTER), by_quarter)
        .when(F.col("selector").isin(END, LAST_END), at_end)
        .otherwise(_direct(F.col("x")))
    )


class Term:
    """A compiled formula: columns of value, unit, refusal code and evidence."""

    def __init__(self, value: Column, unit: Column, code: Column, evidence: Column):
        self.value, self.unit, self.code, self.evidence = value, unit, code, evidence


def compile_formula(formula: str | tuple, inputs: dict[str, Column], units_in_divide: bool = False) -> Term:
    """The formula over resolved inputs as columns; `multiply` and numbers are extensions. `units_in_divide`: both sides need one unit."""
    none = F.lit(None).cast("string")
    if isinstance(formula, (int, float)):
        return Term(F.lit(formula).cast(_EXACT), none, none, F.array().cast("array<string>"))
    if isinstance(formula, str):
        c = inputs[formula]
        return Term(c["value"], c["unit"], F.coalesce(c["code"], F.when(c["value"].isNull(), MISSING)), c["evidence"])
    op, args = formula[0], formula[1:]
    if op == "rollup":
        args = args[1:]
    terms = [compile_formula(a, inputs, units_in_divide) for a in args]
    code = F.coalesce(*[t.code for t in terms]) if len(terms) > 1 else terms[0].code
    evidence = F.concat(*[t.evidence for t in terms])
    first = terms[0]
    if op == "abs":
        return Term(F.abs(first.value), first.unit, code, evidence)
    if op == "divide":
        a, b = (t.value.cast("double") for t in terms)
        other = F.when(~terms[0].unit.eqNullSafe(terms[1].unit), UNITS) if units_in_divide else F.lit(None).cast("string")
        return Term(F.try_divide(a, b), F.lit("pure"), F.coalesce(code, other, F.when(terms[1].value == 0, ZERO)), evidence)
    if op == "multiply":
        return Term(terms[0].value * terms[1].value, first.unit, code, evidence)
    apart = reduce(lambda x, y: x | y, [~first.unit.eqNullSafe(t.unit) for t in terms[1:]], F.lit(False))
    code = F.coalesce(code, F.when(apart, UNITS))
    total = reduce(lambda x, y: x - y if op == "subtract" else x + y, [t.value for t in terms])
    if op == "average":
        total = total.cast("double") / len(terms)
    return Term(total, first.unit, code, evidence)


def answers(facts: DataFrame, edges: DataFrame | None = None, specs: list[Spec] = SPECS, base: DataFrame | None = None, ytd_mode: str = "reference") -> DataFrame:
    """One answer or refusal for every period of every filing and every metric that applies to it."""
    asked = requests(specs)
    resolved = resolve(facts, periods(facts) if base is None else base, specs, ytd_mode)
    wide = resolved.groupBy(*PERIOD).agg(*[F.max(F.when(F.col("request") == n, F.col("input"))).alias(f"r{n}") for n in asked.values()])
    if edges is not None:
        wide = wide.join(_children(edges), "filing_id", "left")
    # metrics of one shape, such as a ratio of two inputs, share an expression: each is compiled once over input places
    shapes: dict[tuple, int] = {}
    rows = []
    for spec in specs:
        place = {k: f"i{n}" for n, k in enumerate(spec.inputs)}
        shape = shapes.setdefault(_placed(spec.formula, place), len(shapes))
        targets = F.array(*map(F.lit, spec.formula[1])) if spec.formula[0] == "rollup" else F.lit(None).cast("array<string>")
        fields = [F.lit(spec.name).alias("metric"), F.lit(shape).alias("shape"), F.lit(spec.unit).alias("spec_unit"), targets.alias("targets"), F.array(*[F.col(f"r{asked[r]}") for r in spec.inputs.values()]).alias("inputs")]
        rows.append(F.when(F.col("period_type").isin(*spec.periods), F.struct(*fields)))
    children = ["children"] if edges is not None else []
    out = wide.select(*PERIOD, *children, F.explode(F.array_compact(F.array(*rows))).alias("_a")).select(*PERIOD, *children, "_a.*")
    most = max(len(s.inputs) for s in specs)
    out = out.select(*[c for c in out.columns if c != "inputs"], *[F.get("inputs", n).alias(f"i{n}") for n in range(most)])
    held = F.array(*[F.col(f"i{n}") for n in range(most)])
    value, code = F.lit(None).cast("double"), F.lit(None).cast("string")
    for shape, n in shapes.items():
        term = compile_formula(shape, {f"i{k}": F.col(f"i{k}") for k in range(most)})
        value, code = F.when(F.col("shape") == n, term.value.cast("double")).otherwise(value), F.when(F.col("shape") == n, term.code).otherwise(code)
    out = out.withColumn("refusal_code", F.coalesce(*[F.col(f"i{n}")["code"] for n in range(most)], code)).withColumn("value", F.when(F.col("refusal_code").isNull(), value))
    fine = F.col("refusal_code").isNull()
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(held, lambda i: i.isNotNull()), lambda i: i["evidence"]))))
    source = F.lit("explicit_override")
    if edges is not None:
        parts = F.transform(F.filter(held, lambda i: i.isNotNull()), lambda i: i["concept"])
        covered = F.exists("targets", lambda t: F.coalesce(F.size(F.array_except(parts, F.try_element_at("children", t))) == 0, F.lit(False)))
        source = F.when(covered, "calculation_linkbase").otherwise(source)
    out = out.withColumn("unit", F.when(fine, F.col("spec_unit"))).withColumn("evidence_ids", F.when(fine, ids).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("rollup_source", F.when(fine & F.col("targets").isNotNull(), source))
    out = out.select(*PERIOD, "metric", "refusal_code", "value", "unit", "evidence_ids", "rollup_source")
    status = F.when(F.col("refusal_code").isNull(), "OK").otherwise("REFUSAL")
    key = digest(F.col("metric"), F.col("filing_id"), F.concat_ws("|", "period_key", "refusal_code"), "v0")
    return out.withColumn("status", status).withColumn("answer_id", key)


def _placed(formula, place: dict[str, str]):
    """The formula over input places; a rollup is the sum of its parts."""
    if isinstance(formula, str):
        return place[formula]
    if not isinstance(formula, tuple):
        return formula
    op, args = formula[0], formula[2:] if formula[0] == "rollup" else formula[1:]
    return ("sum" if op == "rollup" else op, *[_placed(a, place) for a in args])


def _children(edges: DataFrame) -> DataFrame:
    """filing_id and the map from a total to the parts that count positively."""
    sets = edges.where("weight > 0").groupBy("filing_id", "parent").agg(F.collect_set("child").alias("c"))
    return sets.groupBy("filing_id").agg(F.map_from_entries(F.collect_list(F.struct("parent", "c"))).alias("children"))
