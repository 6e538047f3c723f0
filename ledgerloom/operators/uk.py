"""Filings of the UK register: dates and numbers as they print them, the choice of a current fact, two metrics, archive policy.

Defined cases: a filing without a period end supports no period; without a company number its facts
must agree on one entity; facts without an instant never stand for a balance; a null text has no
status and no chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.numbers import EXACT, canonical_decimal
from ..functions.text import collapse

# Missing-value texts, transform families, concepts and dimension members, phrases.
NO_NUMBER = ["", "-", "--", "–", "—", "nil", "n/a"]
ZERO_DASH, DOT_DECIMAL, COMMA_DECIMAL = ["numdash", "zerodash", "numzerodash"], ["numdotdecimal", "numcommadot", "numspacedot"], ["numcommadecimal", "numdotcomma", "numspacecomma"]
CURRENT_ASSETS, CURRENT_LIABILITIES = ["currentassets"], ["creditorsamountsfallingduewithinoneyear", "currentliabilities", "creditors"]
CURRENT = {"financialinstrumentcurrentnoncurrentdimension": "currentfinancialinstruments", "maturitiesorexpirationperiodsdimension": "withinoneyear"}
LATER = {"financialinstrumentcurrentnoncurrentdimension": "noncurrentfinancialinstruments", "maturitiesorexpirationperiodsdimension": "afteroneyear"}
ACCOUNTS = [
    ("micro-entity", "micro_entity"), ("micro entity", "micro_entity"), ("total exemption full", "total_exemption_full"), ("small companies regime", "small_company"),
    ("abridged accounts", "abridged"), ("dormant company", "dormant"),
]
AUDIT = [
    ("independent auditor's report", "AUDITED"), ("independent auditors' report", "AUDITED"), ("exemption from audit", "AUDIT_EXEMPT"),
    ("exempt from the requirements relating to the audit", "AUDIT_EXEMPT"), ("unaudited", "UNAUDITED"),
]
FRAMEWORKS = [
    ("frs 105", "FRS_105"), ("frs 102", "FRS_102"), ("uk-adopted international accounting standards", "UK_ADOPTED_IFRS"),
    ("uk adopted international accounting standards", "UK_ADOPTED_IFRS"), ("international financial reporting standards", "IFRS"),
]
DATE_FORMS = ["yyyyMMdd", "ddMMyyyy", "ddMMyy", "d MMMM yyyy", "d MMM yyyy", "d M yyyy", "d M yy", "MMMM d yyyy", "MMM d yyyy", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d/M/yy", "d-M-yy", "d.M.yy"]
MEMBER_BYTES, RATIO, NAME_CHARS, DEPTH = 64 << 20, 250, 512, 16


def uk_date(text: Column) -> Column:
    """The date of an ISO or display text: ordinals and commas dropped, then the first of fifteen forms that fits; two-digit years 69 to 99 are of the last century."""
    bare = collapse(F.replace(F.regexp_replace(collapse(text), r"(?i)(?<=\d)(?:st|nd|rd|th)\b", ""), F.lit(","), F.lit(" ")))
    iso = F.regexp_extract(bare, r"^(\d{4}-\d{2}-\d{2})(?:[T ].*)?$", 1)

    def of(titled: Column) -> Column:
        return F.coalesce(*[_as_form(titled, form) for form in DATE_FORMS])

    named = F.get(F.transform(F.array(F.initcap(bare)), of), 0)  # months as English prints them; the text is worked out once
    return F.when(iso != "", F.try_to_date(iso, "yyyy-MM-dd")).otherwise(named)


def _as_form(titled: Column, form: str) -> Column:
    """The date if the text has the form."""
    shape = "".join({"d": r"\d{1,2}", "M": r"\d{1,2}", "y": "Y"}.get(c, "\\" + c if c in "/.-" else c) for c in _letters(form))
    pattern = "^" + shape.replace("YYYY", r"\d{4}").replace("YY", r"\d{2}").replace("L", "[A-Za-z]+") + "$"
    pattern = {"yyyyMMdd": r"^\d{8}$", "ddMMyyyy": r"^\d{8}$", "ddMMyy": r"^\d{6}$"}.get(form, pattern)
    day = F.to_date(F.try_to_timestamp(titled, F.lit(form)))
    if "yyyy" not in form:  # 2000 to 2099 as read: the later ones are of the century before
        day = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
    return F.when(titled.rlike(pattern), day)


def _letters(form: str) -> str:
    """With L for a month's name."""
    return form.replace("MMMM", "L").replace("MMM", "L")


def uk_transform(fmt: Column, text: Column) -> tuple[Column, Column]:
    """(text as a plain number, whether the format is known) by the numeric transform families; without a format the text as it is."""
    name = F.regexp_replace(F.lower(F.regexp_extract(fmt, "([^:]*)$", 1)), "[^a-z0-9]", "")
    bare = collapse(text)
    tight = F.translate(bare, " '", "")
    known = name.isin(*ZERO_DASH, *DOT_DECIMAL, *COMMA_DECIMAL)
    none = F.coalesce(fmt, F.lit("")) == ""
    out = (
        F.when(none, text).when(name.isin(*ZERO_DASH), F.when(F.lower(bare).isin(*NO_NUMBER), "0").otherwise(bare)).when(name.isin(*DOT_DECIMAL), F.replace(tight, F.lit(","), F.lit("")))
        .when(name.isin(*COMMA_DECIMAL), F.replace(F.replace(tight, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    )
    return out, none | F.coalesce(known, F.lit(False))


def _first_phrase(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    out = F.when(F.contains(text, F.lit(rules[0][0])), rules[0][1])
    for phrase, label in rules[1:]:
        out = out.when(F.contains(text, F.lit(phrase)), label)
    return out.otherwise(other)


def account_type(text: Column) -> Column:
    return _first_phrase(F.lower(text), ACCOUNTS, "unknown")


def audit_status(text: Column) -> Column:
    return _first_phrase(F.translate(F.lower(text), "’‘", "''"), AUDIT, "UNKNOWN")


def reporting_framework(text: Column) -> Column:
    return _first_phrase(F.lower(text), FRAMEWORKS, "UNKNOWN")


def _creditor(members: dict[str, str]) -> Column:
    """A generic creditors fact with one dimension, of a listed member, and no scenario; dimensions are local names."""
    one = F.get(F.map_entries("dimensions"), 0)
    listed = reduce(lambda a, b: a | b, [(one["key"] == k) & (one["value"] == v) for k, v in members.items()])
    return F.coalesce((F.col("concept_local") == "creditors") & ~F.col("has_scenario") & (F.size("dimensions") == 1) & listed, F.lit(False))


def entity_key(text: Column) -> Column:
    folded = F.upper(F.regexp_replace(F.trim(text), r"\s+", ""))
    return F.nullif(F.when(text.rlike("[^0-9A-Z ]"), folded).otherwise(F.replace(text, F.lit(" "), F.lit(""))), F.lit(""))  # most identifiers have nothing to fold


def select_current(facts: DataFrame, filings: DataFrame, roles: dict[str, list[str]]) -> DataFrame:
    """For each filing and role (a name and its concepts) the one fact of its balance, or a typed refusal.

    Seven stages, each over what the one before left: concept, period end, entity, context (default
    ones before listed current creditors), completeness (all candidates must be numbers), one
    distinct value and unit, least ordinal. `diagnostics` holds the ids of the first two distinct
    candidates of the stage before the one that failed.

    facts: filing_id, ordinal, fact_evidence_id, concept_local, instant, entity_identifier, dimensions (local names), has_segment,
    has_scenario, value_num, unit_canon, unit_type, is_nil, continuation_valid, transform_supported, context_id.
    filings: filing_id, period_end, company_number.
    """
    names = list(roles)
    chosen = _current(facts, filings, roles, diagnostics=True)
    each = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"code{k}").alias("code"), F.col(f"fact{k}").alias("fact"), F.col(f"diagnostics{k}").alias("diagnostics")) for k, r in enumerate(names)])
    return chosen.select("filing_id", F.explode(each).alias("_r")).select("filing_id", "_r.*")


def _current(facts: DataFrame, filings: DataFrame, roles: dict[str, list[str]], diagnostics: bool = False) -> DataFrame:
    """As `select_current`, a row for each filing: code, fact and, if asked for, diagnostics of its k-th role.

    One shuffle of what the stages read, one aggregate by filing. The stages that look at a whole group
    are settled after it: entities agree if the least is the greatest, and default contexts and listed
    creditors are summed up apart, of which the first count where there are any.
    """
    default = F.coalesce(F.size("dimensions"), F.lit(0)) <= 0
    plain = (F.col("concept_local") != "creditors") & default & ~F.col("has_segment") & ~F.col("has_scenario")
    whole = F.col("value_num").isNotNull() & ~F.col("is_nil") & F.coalesce("continuation_valid", F.lit(True)) & F.coalesce("transform_supported", F.lit(True))
    # the diagnostics tell candidates apart by what a reader sees of them
    seen = F.struct("context_id", F.map_entries("dimensions").alias("d"), "entity_identifier", "is_nil", "instant", "unit_canon", "value_num")
    asked = F.col("concept_local").isin(*{c for concepts in roles.values() for c in concepts})
    own = facts.where(asked).select(
        "filing_id", "ordinal", "fact_evidence_id", "concept_local", "instant", entity_key(F.col("entity_identifier")).alias("entity"), plain.alias("plain"), _creditor(CURRENT).alias("creditor"),
        _creditor(LATER).alias("later"), whole.alias("whole"), "value_num", "unit_canon", "unit_type", *[F.to_json(seen).alias("seen")] * diagnostics,
    )
    rows = filings.select("filing_id", "period_end", entity_key(F.col("company_number")).alias("company")).join(own, "filing_id", "left")
    named = F.col("company").isNotNull()
    rows = rows.withColumn("_s2", F.coalesce(F.col("instant") == F.col("period_end"), F.lit(False)))
    rows = rows.withColumn("_p3", F.col("_s2") & F.when(named, F.coalesce(F.col("entity") == F.col("company"), F.lit(False))).otherwise(F.col("entity").isNotNull()))
    # 0: a default context, 1: a listed current creditor
    rows = rows.withColumn("_rank", F.when(F.col("_p3") & F.col("plain"), 0).when(F.col("_p3") & F.col("creditor"), 1))
    value = (F.col("value_num"), F.coalesce("unit_canon", F.lit("")).alias("unit"))
    fact = F.struct("ordinal", "fact_evidence_id", "concept_local", "value_num", "unit_canon", "unit_type")
    ranked, part = F.col("_rank").isNotNull(), ~F.coalesce("whole", F.lit(False))
    # one bit for each set that has a member: of stages 1, 2 and 3, of what is not due later, and for each rank of stage 4 and of its facts that are no numbers
    of_rank = lambda r: F.coalesce(F.col("_rank") == r, F.lit(False))
    sets = [F.lit(True), F.col("_s2"), F.col("_p3"), F.col("_p3") & ~F.col("later"), of_rank(0), of_rank(1), of_rank(0) & part, of_rank(1) & part]
    rows = rows.withColumn("_bits", reduce(lambda x, y: x + y, [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(sets)]))
    sums, d = [F.max("period_end").alias("period_end"), F.max(named).alias("named")], F.struct("ordinal", "fact_evidence_id", "seen") if diagnostics else None
    for k, concepts in enumerate(roles.values()):
        s1 = F.coalesce(F.col("concept_local").isin(*concepts), F.lit(False))
        s2, s5 = s1 & F.col("_s2"), s1 & ranked & ~part
        sums += [
            F.coalesce(F.bit_or(F.when(s1, F.col("_bits"))), F.lit(0)).alias(f"bits{k}"), F.min(F.when(s2, F.col("entity"))).alias(f"lo{k}"), F.max(F.when(s2, F.col("entity"))).alias(f"hi{k}"),
            F.min(F.when(s5, F.struct("_rank", *value))).alias(f"least{k}"), F.max(F.when(s5, F.struct(-F.col("_rank"), *value))).alias(f"most{k}"), F.min(F.when(s5, F.struct("_rank", fact.alias("fact")))).alias(f"f{k}"),
        ]
        if diagnostics:
            stages = {"1": s1, "2": s2, "3": s1 & F.col("_p3"), "40": s1 & of_rank(0), "41": s1 & of_rank(1), "50": s5 & of_rank(0), "51": s5 & of_rank(1)}
            sums += [F.array_sort(F.collect_set(F.when(s, d))).alias(f"d{k}{at}") for at, s in stages.items()]
    out = rows.groupBy("filing_id").agg(*sums)
    for k in range(len(roles)):
        has = lambda bit: F.col(f"bits{k}").bitwiseAND(1 << bit) != 0  # noqa: B023, E731
        own_ids, any_plain = F.col("named") | F.coalesce(F.col(f"lo{k}") == F.col(f"hi{k}"), F.lit(False)), has(4)
        none, off, no_entity = ~has(0), F.col("period_end").isNull() | ~has(1), ~(own_ids & has(2))
        no_context, broken = ~has(4) & ~has(5), F.when(any_plain, has(6)).otherwise(has(7))
        late = no_context & ~has(3)
        same = (F.col(f"least{k}.value_num") == F.col(f"most{k}.value_num")) & (F.col(f"least{k}.unit") == F.col(f"most{k}.unit"))
        code = (
            F.when(none, "MISSING_INPUT").when(off, "PERIOD_NOT_SUPPORTED").when(no_entity, "AMBIGUOUS_CONTEXT").when(late, "MISSING_INPUT").when(no_context, "AMBIGUOUS_CONTEXT")
            .when(broken, "MISSING_INPUT").when(~same, "AMBIGUOUS_CONTEXT")
        )
        out = out.withColumn(f"code{k}", code).withColumn(f"fact{k}", F.when(F.col(f"code{k}").isNull(), F.col(f"f{k}.fact")))
        if diagnostics:
            nothing = F.array().cast("array<struct<ordinal:int,fact_evidence_id:string,seen:string>>")
            d4, d5 = (F.when(any_plain, F.col(f"d{k}{s}0")).otherwise(F.col(f"d{k}{s}1")) for s in (4, 5))
            at = F.when(none, nothing).when(off, F.col(f"d{k}1")).when(no_entity, F.col(f"d{k}2")).when(late, nothing).when(no_context, F.col(f"d{k}3")).when(broken, d4).when(~same, d5).otherwise(F.slice(d5, 1, 1))
            out = out.withColumn(f"_d{k}", at)
            distinct_seen = F.filter(f"_d{k}", lambda x, i: F.array_position(F.transform(f"_d{k}", lambda y: y["seen"]), x["seen"]) == i + 1)  # noqa: B023
            out = out.withColumn(f"diagnostics{k}", F.transform(F.slice(distinct_seen, 1, 2), lambda x: x["fact_evidence_id"]))
    return out.select("filing_id", *[f"{c}{k}" for k in range(len(roles)) for c in ("code", "fact", *["diagnostics"] * diagnostics)])


def quant_answers(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """filing_id, metric, status, value (canonical text), number, unit, evidence_ids and refusal_code of current ratio and working capital.

    Liabilities count as positive. An unclear context or period is refused before a missing input;
    both sides must be one currency; a zero denominator is refused.
    """
    chosen = _current(facts, filings, {"assets": CURRENT_ASSETS, "liabilities": CURRENT_LIABILITIES})
    rows = chosen.select("filing_id", *[F.struct(F.col(f"code{k}").alias("code"), F.col(f"fact{k}").alias("fact")).alias(side) for k, side in enumerate(("assets", "liabilities"))])
    both = F.col("assets.code").isNull() & F.col("liabilities.code").isNull()
    unclear = lambda c: F.when(F.col(c).isin("AMBIGUOUS_CONTEXT", "PERIOD_NOT_SUPPORTED"), F.col(c))
    left = F.col("assets.fact.value_num")
    right = F.when(F.col("liabilities.fact.concept_local").isin(*CURRENT_LIABILITIES), F.abs(F.col("liabilities.fact.value_num"))).otherwise(F.col("liabilities.fact.value_num"))
    unit = F.col("assets.fact.unit_canon")
    money = (F.col("assets.fact.unit_type") == "currency") & (F.col("liabilities.fact.unit_type") == "currency") & (F.coalesce(unit, F.lit("")) != "") & unit.eqNullSafe(F.col("liabilities.fact.unit_canon"))
    base = F.when(~both, F.coalesce(unclear("assets.code"), unclear("liabilities.code"), F.lit("MISSING_INPUT"))).when(~F.coalesce(money, F.lit(False)), "INCOMPATIBLE_UNITS")
    metric = lambda name, code, value, u: F.struct(F.lit(name).alias("metric"), code.alias("refusal_code"), F.when(code.isNull(), value.cast("double")).alias("number"), F.when(code.isNull(), u).alias("unit"), F.when(code.isNull(), canonical_decimal(value.cast(EXACT))).alias("value"))
    kinds = F.array(
        metric("current_ratio", F.coalesce(base, F.when(right == 0, "DIVISION_BY_ZERO")), F.try_divide(left.cast("double"), right.cast("double")), F.lit("pure")),
        metric("working_capital", F.coalesce(base, F.lit(None).cast("string")), left - right, unit),
    )
    ids = F.array("assets.fact.fact_evidence_id", "liabilities.fact.fact_evidence_id")
    out = rows.withColumn("_e", ids).select("filing_id", "_e", F.explode(kinds).alias("_m")).select("filing_id", "_e", "_m.*")
    fine = F.col("refusal_code").isNull()
    return out.withColumn("status", F.when(fine, "OK").otherwise("REFUSAL")).withColumn("evidence_ids", F.when(fine, F.col("_e")).otherwise(F.array().cast("array<string>"))).drop("_e")


def unique_labels(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys no other row has: of doubled ones none is kept."""
    n = F.count(F.lit(1)).over(W.Window.partitionBy(*keys))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


# --- archives ---


def member_policy(archive_bytes: Column) -> Column:
    """The code of the first rule that a ZIP member breaks, null if none; columns as `ZipInfo` has them, and `duplicate`."""
    name = F.col("name")
    parts = F.split(name, "/")
    unsafe = (
        (F.coalesce(name, F.lit("")) == "") | (F.length(name) > NAME_CHARS) | name.rlike(r"[\x00-\x1f\x7f]") | F.contains(name, F.lit("\\")) | name.startswith("/") | name.rlike("^[A-Za-z]:")
        | (F.size(parts) > DEPTH) | F.exists(parts, lambda p: p.isin("", ".", "..")) | F.contains(name, F.lit(":"))
    )
    mode = F.shiftright(F.col("external_attr"), 16).bitwiseAND(0xF000)
    bounds = (F.col("size") < 0) | (F.col("packed") < 0) | (F.col("offset") < 0) | (F.col("offset") >= archive_bytes) | (F.col("packed") > archive_bytes) | ~F.col("crc").between(0, 0xFFFFFFFF)
    return (
        F.when(unsafe, "UNSAFE_MEMBER_NAME").when(F.col("duplicate"), "DUPLICATE_MEMBER_NAME").when(F.col("flags").bitwiseAND(0x41) != 0, "ENCRYPTED_MEMBER").when(~F.col("method").isin(0, 8), "UNSUPPORTED_COMPRESSION")
        .when((F.col("system") == 3) & ~mode.isin(0, 0x8000), "NON_REGULAR_MEMBER").when(bounds, "INVALID_MEMBER_METADATA").when(F.col("size") > MEMBER_BYTES, "MEMBER_SIZE_LIMIT_EXCEEDED")
        .when((F.col("size") > 0) & ((F.col("packed") == 0) | (F.col("size") > RATIO * F.col("packed"))), "COMPRESSION_RATIO_LIMIT_EXCEEDED")
    )


def planned(members: DataFrame, seed: str, limit: int | None = None) -> DataFrame:
    """The XHTML members of each archive in seeded order, the first `limit` of them (the feature), each with its policy code.

    members: archive, archive_bytes, member_index, name, size, packed, offset, crc, flags, method, system, external_attr.
    Rejected members are not replaced: the cut comes before the policy.
    """
    chosen = members.where(F.lower("name").rlike(r"\.(xhtml|html|htm)$") & ~F.col("name").endswith("/"))
    chosen = chosen.withColumn("duplicate", F.count(F.lit(1)).over(W.Window.partitionBy("archive", "name")) > 1)
    drawn = F.sha2(F.concat_ws("\x1f", F.lit(seed), F.col("name")), 256)
    place = F.row_number().over(W.Window.partitionBy("archive").orderBy(drawn, "name", "offset", "member_index"))
    chosen = chosen.withColumn("place", place - 1)
    if limit is not None:
        chosen = chosen.where(F.col("place") < limit)
    return chosen.withColumn("code", member_policy(F.col("archive_bytes")))


def sentence_chunks(docs: DataFrame, key: str, size: int = 1200) -> DataFrame:
    """key, chunk_index, text and sha256 of chunks of whole sentences; a sentence longer than a chunk is cut, and ends the chunk before it."""

    def packed(text: str | None) -> list[str]:
        import re

        chunks: list[str] = []
        held: list[str] = []
        length = 0
        for sentence in (s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", text or "")):
            if not sentence:
                continue
            if held and (length + len(sentence) + 1 > size or len(sentence) > size):
                chunks.append(" ".join(held))
                held, length = [], 0
            if len(sentence) > size:
                chunks += [sentence[k : k + size] for k in range(0, len(sentence), size)]
            else:
                held.append(sentence)
                length += len(sentence) + 1
        return chunks + ([" ".join(held)] if held else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [packed(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, pa.list_(pa.string()))], [key, "_c"])

    rows = docs.select(F.col(key).cast("long"), F.col("text").cast("string")).mapInArrow(run, f"{key} long, _c array<string>")
    return rows.select(key, F.posexplode("_c").alias("chunk_index", "text")).withColumn("sha256", F.sha2("text", 256))
