"""Queries on UK filings: facts made of order lines, dates, numbers, phrases and archive members, with their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import parse_number_uk
from ..operators import uk
from ..sources.uk_packages import read_uk_facts, stored_package
from ..sources.views import sql as run_sql
from ..sources.views import table

#: Each order is a filing, each line a fact; `how` spoils some of its properties.
FACTS_SQL = """SELECT CAST(l_orderkey AS VARCHAR(20)) AS filing_id, CAST(l_linenumber AS INT) AS ordinal, concat('e', CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(9))) AS fact_evidence_id,
  CASE CAST(l_linenumber AS INT) % 3 WHEN 0 THEN 'creditors' WHEN 1 THEN 'currentassets' ELSE 'currentliabilities' END AS concept_local,
  CASE WHEN l_suppkey % 7 = 0 THEN '2023-12-31' ELSE '2024-12-31' END AS instant, CASE WHEN l_partkey % 13 = 0 THEN 'other' ELSE ' 0012 34' END AS entity_identifier,
  CASE WHEN CAST(l_linenumber AS INT) % 3 = 0 THEN CAST(l_partkey % 3 AS INT) ELSE 0 END AS dim, l_suppkey % 11 = 0 AS has_segment, l_partkey % 17 = 0 AS has_scenario,
  CASE WHEN l_suppkey % 19 = 0 THEN NULL WHEN l_partkey % 23 = 0 THEN CAST(0 AS DECIMAL(38,6)) ELSE CAST(-l_quantity AS DECIMAL(38,6)) END AS value_num, CASE WHEN l_orderkey % 5 = 0 AND l_linenumber = 2 THEN 'eur' ELSE 'gbp' END AS unit_canon,
  CASE WHEN l_orderkey % 29 = 0 THEN 'pure' ELSE 'currency' END AS unit_type, l_partkey % 31 = 0 AS is_nil FROM lineitem"""
_FILINGS_SQL = "SELECT DISTINCT CAST(l_orderkey AS VARCHAR(20)) AS filing_id, CASE WHEN l_orderkey % 37 = 0 THEN NULL ELSE '2024-12-31' END AS period_end, CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE '001234' END AS company_number FROM lineitem"


def uk_quant_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current ratio and working capital of every filing, through the seven stages of the choice of its facts."""
    axis, member = "maturitiesorexpirationperiodsdimension", ["", "withinoneyear", "afteroneyear"]
    dims = F.when(F.col("dim") == 0, F.create_map().cast("map<string,string>"))
    for k in (1, 2):
        dims = dims.when(F.col("dim") == k, F.create_map(F.lit(axis), F.lit(member[k])))
    yes = F.lit(True)
    facts = run_sql(spark, sf_dir, FACTS_SQL).withColumn("dimensions", dims).withColumn("instant", F.to_date("instant"))
    facts = facts.withColumn("continuation_valid", yes).withColumn("transform_supported", yes).withColumn("context_id", F.lit("c"))
    filings = run_sql(spark, sf_dir, _FILINGS_SQL).withColumn("period_end", F.to_date("period_end"))
    out = uk.quant_answers(facts, filings)
    return out.select("filing_id", "metric", "status", F.coalesce("refusal_code", F.lit("")).alias("refusal_code"), F.round("number", 6).alias("value"), F.coalesce("unit", F.lit("")).alias("unit"), F.array_join("evidence_ids", ",").alias("evidence"))


_AXIS = '<xbrldi:explicitMember dimension="uk-core:MaturitiesOrExpirationPeriodsDimension">{}</xbrldi:explicitMember>'


def _contexts() -> tuple[pa.Array, pa.Array]:
    """The segment and scenario of a context, at 4 * dim + 2 * has_segment + has_scenario; an axis stands in the segment, but alone in a scenario."""
    segments, scenarios = [], []
    for dim in ("", "uk-core:WithinOneYear", "uk-core:AfterOneYear"):
        axis = _AXIS.format(dim) if dim else ""
        for has_segment, has_scenario in ((False, False), (False, True), (True, False), (True, True)):
            segments.append(f"<xbrli:segment>{axis}</xbrli:segment>" if has_segment or dim and not has_scenario else "")
            scenarios.append(f"<xbrli:scenario>{axis if not segments[-1] else ''}</xbrli:scenario>" if has_scenario else "")
    return pa.array(segments), pa.array(scenarios)


def _printed(values: pa.Array) -> pa.Array:
    """Numbers with thousands and all decimals, negative ones in parentheses, unclear where there is none."""
    text = values.cast(pa.string())
    text = pc.if_else(pc.less(values, 0), pc.binary_join_element_wise("(", pc.utf8_slice_codeunits(text, 1), ")", ""), text)
    large = pc.fill_null(pc.greater_equal(pc.abs(values), 1000), False)
    if pc.any(large).as_py():
        text = pa.array([t if not is_large else f"({-v:,f})" if v < 0 else f"{v:,f}" for t, v, is_large in zip(text.to_pylist(), values.to_pylist(), large.to_pylist())], pa.string())
    return pc.fill_null(text, "unclear")


def _documents(facts: pa.Table, starts: np.ndarray) -> pa.Array:
    """The inline documents of filings whose facts begin at the given rows."""
    of = lambda name: facts[name].combine_chunks()
    joined = lambda *parts: pc.binary_join_element_wise(*parts, "", null_handling="replace", null_replacement="None")
    ends = np.append(starts[1:], len(facts))
    place = pa.array(np.arange(len(facts)) - np.repeat(starts, ends - starts)).cast(pa.string())
    flag = lambda name: pc.fill_null(of(name), False).cast(pa.int32())
    kind = pc.add(pc.multiply(pc.fill_null(of("dim"), 0), 4), pc.add(pc.multiply(flag("has_segment"), 2), flag("has_scenario")))
    segment, scenario = (t.take(kind) for t in _contexts())
    tag = joined(of("ordinal").cast(pa.string()), "-", place)
    # numbers that are no money stay apart by their unit, as the facts hold them
    money, gbp = pc.not_equal(of("unit_type"), "pure"), pc.equal(of("unit_canon"), "gbp")
    unit = pc.if_else(money, joined("iso4217:", pc.utf8_upper(of("unit_canon"))), pc.if_else(gbp, "xbrli:pure", "xbrli:shares"))
    names = pa.array(["uk-core:Creditors", "uk-core:CurrentAssets", "uk-core:CurrentLiabilities"]).take(pc.index_in(of("concept_local"), pa.array(["creditors", "currentassets", "currentliabilities"])))
    nil = pc.if_else(pc.fill_null(of("is_nil"), False), ' xsi:nil="true"', "")
    made = joined(
        '<xbrli:context id="c', tag, '"><xbrli:entity><xbrli:identifier scheme="x">', of("entity_identifier"), "</xbrli:identifier>", segment, "</xbrli:entity><xbrli:period><xbrli:instant>", of("instant"), "</xbrli:instant></xbrli:period>", scenario, "</xbrli:context>",
        '<xbrli:unit id="u', tag, '"><xbrli:measure>', unit, "</xbrli:measure></xbrli:unit>",
        '<p><ix:nonFraction id="', of("fact_evidence_id"), '" name="', names, '" contextRef="c', tag, '" unitRef="u', tag, '" format="ixt2:numdotdecimal" scale="0"', nil, ">", _printed(of("value_num")), "<ix:exclude> *</ix:exclude></ix:nonFraction>",
    )
    return joined("<html><body>", pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, len(facts)), pa.int32()), made), ""))


def _packages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A package for each filing, of facts that come together; within it they are put in the order of their ordinals."""

    def made(facts: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ordinals, filing = facts["ordinal"].to_numpy(), np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(facts))))
        if np.any((np.diff(ordinals) < 0) & (np.diff(filing) == 0)):
            facts = facts.take(pa.array(np.lexsort((ordinals, filing))))
        files = facts["filing_id"].combine_chunks().take(pa.array(starts))
        documents = _documents(facts, starts).cast(pa.binary())
        for k in range(0, len(files), 1000):
            content = [stored_package("accounts.html", d.as_py()) for d in documents.slice(k, 1000)]
            yield pa.RecordBatch.from_arrays([files.slice(k, 1000), pa.array(content, pa.binary())], ["filing_id", "content"])

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        ids = held["filing_id"].combine_chunks()
        starts = np.append(0, np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)) + 1)
        if len(starts) > 1:  # the last filing may go on in the next batch
            yield from made(held.slice(0, starts[-1]), starts[:-1])
            held = held.slice(starts[-1])
    if held is not None:
        yield from made(held, np.array([0]))


def uk_parsed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same metrics from inline documents made of the same facts, packed, parsed and put through the seven stages."""
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey IS NOT NULL").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = lines.repartition("l_orderkey").sortWithinPartitions("l_orderkey")  # each filing's facts together
    held = run_sql(spark, sf_dir, FACTS_SQL, lineitem=lines)
    filings = run_sql(spark, sf_dir, _FILINGS_SQL).withColumn("period_end", F.to_date("period_end"))
    out = uk.quant_answers(read_uk_facts(held.mapInArrow(_packages, "filing_id string, content binary")), filings)
    ids = F.array_join(F.transform("evidence_ids", lambda e: F.substring_index(e, "id=", -1)), ",")
    unit = F.when((F.col("metric") == "working_capital") & (F.col("status") == "OK"), F.col("unit")).when(F.col("status") == "OK", "pure").otherwise("")
    return out.select("filing_id", "metric", "status", F.coalesce("refusal_code", F.lit("")).alias("refusal_code"), F.round("number", 6).alias("value"), unit.alias("unit"), ids.alias("evidence"))


def uk_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates printed in many forms and read back."""
    day = F.col("o_orderdate").cast("date")
    forms = ["yyyy-MM-dd", "yyyyMMdd", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "dd/MM/yyyy", "dd.MM.yy", "d-M-yyyy"]
    text = F.element_at(F.array(*[F.date_format(day, f) for f in forms], F.concat(F.date_format(day, "d"), F.lit("th "), F.upper(F.date_format(day, "MMMM")), F.lit("  "), F.year(day)), F.lit("the 5th"), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00"))), (F.col("o_orderkey") % 11 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", uk.uk_date(text).cast("string").alias("day"))


def uk_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices printed as the transform families print them, and read back with sign and brackets."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    dotted, kind = F.format_number(price, 2), (F.col("l_orderkey") % 6).cast("int")
    text = F.element_at(F.array(dotted, F.translate(F.translate(F.translate(dotted, ",", "~"), ".", ","), "~", "."), F.lit(" - "), F.concat(F.lit("("), dotted, F.lit(")")), F.translate(dotted, ",", " "), F.lit("fixed")), kind + 1)
    fmt = F.element_at(F.array(*map(F.lit, ["ixt:numdotdecimal", "ixt2:num-comma-decimal", "ixt:numdash", "", "ixt:numspacedot", "ixt:fixedfalse"])), kind + 1)
    plain, known = uk.uk_transform(fmt, text)
    sign = F.when(F.col("l_linenumber") == 1, "-")
    value = parse_number_uk(plain, sign, F.lit(False))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), known.alias("known"), F.round(value.cast("double"), 6).alias("value"))


_PHRASES = [
    "", " prepared under the small companies regime and FRS 102", " micro-entity accounts, FRS 105, exempt from the requirements relating to the audit", " Independent Auditor’s Report, UK-adopted international accounting standards",
    " unaudited abridged accounts", " exemption from audit of a dormant company, International Financial Reporting Standards",
]


def uk_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of accounts, audit status and framework of documents that end in one of six phrases."""
    text = F.concat(F.coalesce("text", F.lit("")), F.element_at(F.array(*map(F.lit, _PHRASES)), (F.col("doc_id") % 6 + 1).cast("int")))
    return table(spark, sf_dir, "documents").select("doc_id", uk.account_type(text).alias("account_type"), uk.audit_status(text).alias("audit_status"), uk.reporting_framework(text).alias("framework"))


#: Archive members made of parts.
MEMBERS_SQL = """SELECT concat('a', CAST(p_size % 7 AS VARCHAR(3))) AS archive, CAST(1000000000 AS BIGINT) AS archive_bytes, CAST(p_partkey AS BIGINT) AS member_index,
  CASE p_partkey % 12 WHEN 0 THEN concat('../x', CAST(p_partkey AS VARCHAR(12)), '.html') WHEN 1 THEN 'twice.html' WHEN 2 THEN concat('b/', CAST(p_partkey AS VARCHAR(12)), '.txt') WHEN 3 THEN concat('/abs', CAST(p_partkey AS VARCHAR(12)), '.htm')
    ELSE concat('f/', CAST(p_partkey AS VARCHAR(12)), '.xhtml') END AS name,
  CAST(CASE WHEN p_partkey % 31 = 0 THEN 70000000 ELSE 1000 * p_size END AS BIGINT) AS size, CAST(CASE WHEN p_partkey % 29 = 0 THEN 1 ELSE 500000 END AS BIGINT) AS packed, CAST(CASE WHEN p_partkey % 23 = 0 THEN 2000000000 ELSE p_partkey END AS BIGINT) AS "offset",
  CAST(7 AS BIGINT) AS crc, CAST(CASE WHEN p_partkey % 19 = 0 THEN 1 ELSE 0 END AS INT) AS flags, CAST(CASE WHEN p_partkey % 17 = 0 THEN 12 ELSE 8 END AS INT) AS method, CAST(3 AS INT) AS system,
  CAST(CASE WHEN p_partkey % 37 = 0 THEN 1073741824 ELSE 0 END AS BIGINT) AS external_attr FROM part"""


def uk_archive_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first forty members of each archive in seeded order, with the rule that each breaks."""
    rows = run_sql(spark, sf_dir, MEMBERS_SQL.replace('"offset"', "`offset`"))
    return uk.planned(rows, "7", 40).select("archive", "member_index", F.col("place").cast("long").alias("place"), F.coalesce("code", F.lit("")).alias("code"))


def uk_sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uk.sentence_chunks(table(spark, sf_dir, "documents"), "doc_id")


QUERIES = {f.__name__: f for f in (uk_quant_tasks, uk_parsed_tasks, uk_dates, uk_numbers, uk_phrases, uk_archive_plan, uk_sentence_chunks)}

_FUNNEL = f"""WITH f AS ({FACTS_SQL}), g AS ({_FILINGS_SQL}), roles(role, concept) AS (VALUES ('assets', 'currentassets'), ('liabilities', 'currentliabilities'), ('liabilities', 'creditors')),
  a AS (SELECT g.filing_id, g.period_end, g.company_number, r.role, f.*EXCLUDE (filing_id), upper(replace(trim(entity_identifier), ' ', '')) AS entity FROM g CROSS JOIN (SELECT DISTINCT role FROM roles) r LEFT JOIN (SELECT f.*, role AS rr FROM f JOIN roles ON concept = concept_local) f ON f.filing_id = g.filing_id AND f.rr = r.role),
  s2 AS (SELECT *, coalesce(instant = period_end, false) AS p2, count(DISTINCT CASE WHEN coalesce(instant = period_end, false) THEN entity END) OVER (PARTITION BY filing_id, role) AS ids FROM a),
  s3 AS (SELECT *, p2 AND CASE WHEN company_number IS NOT NULL THEN coalesce(entity = company_number, false) ELSE ids = 1 END AS p3 FROM s2),
  s4 AS (SELECT *, p3 AND concept_local <> 'creditors' AND dim = 0 AND NOT has_segment AND NOT has_scenario AS direct, concept_local = 'creditors' AND NOT has_scenario AS cr FROM s3),
  s5 AS (SELECT *, max(coalesce(direct, false)::INT) OVER (PARTITION BY filing_id, role) AS anyd FROM s4),
  s6 AS (SELECT *, CASE WHEN anyd = 1 THEN direct ELSE p3 AND cr AND dim = 1 END AS p4 FROM s5),
  s7 AS (SELECT *, p4 AND value_num IS NOT NULL AND NOT is_nil AS p5 FROM s6),
  c AS (SELECT filing_id, role, max(period_end) AS pe, count(ordinal) AS n1, sum(coalesce(p2, false)::INT) AS n2, sum(coalesce(p3, false)::INT) AS n3, sum(coalesce(p4, false)::INT) AS n4, sum(coalesce(p5, false)::INT) AS n5,
               sum(coalesce(p3 AND cr AND dim = 2, false)::INT) AS nl, count(DISTINCT CASE WHEN p5 THEN value_num || '|' || unit_canon END) AS nv, min(value_num) FILTER (p5) AS v, min(unit_canon) FILTER (p5) AS u, min(unit_type) FILTER (p5) AS ut, arg_min(fact_evidence_id, ordinal) FILTER (p5) AS e FROM s7 GROUP BY 1, 2),
  k AS (SELECT *, CASE WHEN n1 = 0 THEN 'MISSING_INPUT' WHEN pe IS NULL OR n2 = 0 THEN 'PERIOD_NOT_SUPPORTED' WHEN n3 = 0 THEN 'AMBIGUOUS_CONTEXT' WHEN n4 = 0 AND nl = n3 THEN 'MISSING_INPUT' WHEN n4 = 0 THEN 'AMBIGUOUS_CONTEXT'
                      WHEN n5 <> n4 THEN 'MISSING_INPUT' WHEN nv <> 1 THEN 'AMBIGUOUS_CONTEXT' END AS code FROM c),
  w AS (SELECT filing_id, max(code) FILTER (role = 'assets') AS ac, max(code) FILTER (role = 'liabilities') AS lc, max(e) FILTER (role = 'assets') AS ae, max(e) FILTER (role = 'liabilities') AS le, max(v) FILTER (role = 'assets') AS av,
               abs(max(v) FILTER (role = 'liabilities')) AS lv, max(u) FILTER (role = 'assets') AS au, max(u) FILTER (role = 'liabilities') AS lu, max(ut) AS ut FROM k GROUP BY 1),
  b AS (SELECT *, CASE WHEN ac IS NOT NULL OR lc IS NOT NULL THEN coalesce(CASE WHEN ac <> 'MISSING_INPUT' THEN ac END, CASE WHEN lc <> 'MISSING_INPUT' THEN lc END, 'MISSING_INPUT') WHEN ut <> 'currency' OR au <> lu THEN 'INCOMPATIBLE_UNITS' END AS code FROM w)"""

ORACLE_SQL = {
    "uk_quant_tasks": _FUNNEL + """ SELECT filing_id, 'current_ratio' AS metric, CASE WHEN code IS NULL AND lv <> 0 THEN 'OK' ELSE 'REFUSAL' END AS status, coalesce(code, CASE WHEN lv = 0 THEN 'DIVISION_BY_ZERO' ELSE '' END) AS refusal_code,
          CASE WHEN code IS NULL AND lv <> 0 THEN round(CAST(av AS DOUBLE) / CAST(lv AS DOUBLE), 6) END AS value, CASE WHEN code IS NULL AND lv <> 0 THEN 'pure' ELSE '' END AS unit, CASE WHEN code IS NULL AND lv <> 0 THEN ae || ',' || le ELSE '' END AS evidence FROM b
        UNION ALL SELECT filing_id, 'working_capital', CASE WHEN code IS NULL THEN 'OK' ELSE 'REFUSAL' END, coalesce(code, ''), CASE WHEN code IS NULL THEN round(CAST(av - lv AS DOUBLE), 6) END, CASE WHEN code IS NULL THEN au ELSE '' END, CASE WHEN code IS NULL THEN ae || ',' || le ELSE '' END FROM b""",
    "uk_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 9 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders",
    "uk_numbers": """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, l_orderkey % 6 <> 5 AS known,
        round(CASE l_orderkey % 6 WHEN 2 THEN 0 WHEN 3 THEN -CAST(l_extendedprice AS DECIMAL(18,2)) WHEN 5 THEN NULL ELSE CASE WHEN l_linenumber = 1 THEN -1 ELSE 1 END * CAST(l_extendedprice AS DECIMAL(18,2)) END::DOUBLE, 6) AS value FROM lineitem""",
    "uk_phrases": """SELECT doc_id, CASE doc_id % 6 WHEN 1 THEN 'small_company' WHEN 2 THEN 'micro_entity' WHEN 4 THEN 'abridged' WHEN 5 THEN 'dormant' ELSE 'unknown' END AS account_type,
        CASE doc_id % 6 WHEN 2 THEN 'AUDIT_EXEMPT' WHEN 3 THEN 'AUDITED' WHEN 4 THEN 'UNAUDITED' WHEN 5 THEN 'AUDIT_EXEMPT' ELSE 'UNKNOWN' END AS audit_status,
        CASE doc_id % 6 WHEN 1 THEN 'FRS_102' WHEN 2 THEN 'FRS_105' WHEN 3 THEN 'UK_ADOPTED_IFRS' WHEN 5 THEN 'IFRS' ELSE 'UNKNOWN' END AS framework FROM documents""",
    "uk_archive_plan": f"""WITH m AS ({MEMBERS_SQL}), x AS (SELECT *, count(*) OVER (PARTITION BY archive, name) AS same FROM m WHERE regexp_matches(lower(name), '\\.(xhtml|html|htm)$')),
        p AS (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY sha256('7' || chr(31) || name), name, "offset", member_index) - 1 AS place FROM x)
        SELECT archive, member_index, place, CASE WHEN name LIKE '/%' OR name LIKE '../%' THEN 'UNSAFE_MEMBER_NAME' WHEN same > 1 THEN 'DUPLICATE_MEMBER_NAME' WHEN flags = 1 THEN 'ENCRYPTED_MEMBER' WHEN method = 12 THEN 'UNSUPPORTED_COMPRESSION'
          WHEN external_attr > 0 THEN 'NON_REGULAR_MEMBER' WHEN "offset" >= archive_bytes THEN 'INVALID_MEMBER_METADATA' WHEN size > 67108864 THEN 'MEMBER_SIZE_LIMIT_EXCEEDED' WHEN size > 250 * packed THEN 'COMPRESSION_RATIO_LIMIT_EXCEEDED' ELSE '' END AS code FROM p WHERE place < 40""",
}
ORACLE_SQL["uk_parsed_tasks"] = ORACLE_SQL["uk_quant_tasks"]
