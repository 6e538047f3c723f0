"""Queries on filing packages: each filing of the star-schema views is packed as a ZIP and read back."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import date
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import filings
from ..sources.views import FILED_SQL
from ..sources.views import sql as run_sql
from ..storage import materialise

_HEAD = (
    '<?xml version="1.0"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:ix="http://www.xbrl.org/2013/inlineXBRL" xmlns:xbrli="http://www.xbrl.org/2003/instance" '
    'xmlns:xbrldi="http://xbrl.org/2006/xbrldi" xmlns:us-gaap="http://fasb.org/us-gaap/2020" xmlns:dei="http://xbrl.sec.gov/dei/2020"><body>'
)


def _document(r: dict) -> tuple[str, str]:
    """The main document and the split part of one filing; tags cross and stay open on purpose."""
    day: date = r["day"]
    begin = date(day.year, day.month - 2, 1)
    entity = f'<xbrli:entity><xbrli:identifier scheme="x">CIK{r["k"] + 1:010d}</xbrli:identifier>'
    span = f"<xbrli:period><xbrli:startDate>{begin}</xbrli:startDate><xbrli:endDate>{day}</xbrli:endDate></xbrli:period>"
    income = r["net"] - r["off"] - r["tax"]
    shown = f"({-income:,.2f})" if income < 0 else f"$ {income:,.2f}"

    def number(concept: str, text: str, context: str = "c2", unit: str = "usd", rest: str = "") -> str:
        return f'<p><ix:nonFraction name="{concept}" contextRef="{context}" unitRef="{unit}" decimals="2" {rest}>{text}</ix:nonFraction>'

    def words(concept: str, text: str, rest: str = "") -> str:
        return f'<td><ix:nonNumeric name="{concept}" contextRef="c1" {rest}>{text}</ix:nonNumeric>'

    main = _HEAD + '<link:schemaRef xlink:href="http://x/main.xsd"/>' + (
        f'<xbrli:context id="c1">{entity}</xbrli:entity>{span}</xbrli:context>'
        f'<xbrli:context id="c2">{entity}</xbrli:entity><xbrli:period><xbrli:instant>{day}</xbrli:instant></xbrli:period></xbrli:context>'
        f'<xbrli:context id="c3">{entity}<xbrli:segment><xbrldi:explicitMember dimension="a:Axis">a:Member</xbrldi:explicitMember></xbrli:segment></xbrli:entity>{span}</xbrli:context>'
        '<xbrli:unit id="usd"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit><xbrli:unit id="sh"><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:unit>'
        '<xbrli:unit id="eps"><xbrli:divide><xbrli:unitNumerator><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unitNumerator><xbrli:unitDenominator>'
        '<xbrli:measure>xbrli:shares</xbrli:measure></xbrli:unitDenominator></xbrli:divide></xbrli:unit><xbrli:unit id="one"><xbrli:measure>xbrli:pure</xbrli:measure></xbrli:unit>'
    )
    main += "<b><i>unclosed " + "".join([
        number("us-gaap:Revenues", f"{r['net']:,.2f}", "c1", rest='id="f1"'),
        number("us-gaap:NetIncomeLoss", shown, "c1"),
        "</i>",
        number("us-gaap:Assets", f"{r['anet'] / Decimal(1000):,.5f}", rest='id="f3" scale="3"'),
        number("us-gaap:Liabilities", f"{r['atax']}", rest='id="f4" sign="-"'),
        number("us-gaap:EarningsPerShareBasic", "1.25", "c1", "eps", 'id="f5"'),
        number("dei:EntityCommonStockSharesOutstanding", f"{r['qty']}", "c2", "sh", 'id="f6"'),
        number("us-gaap:PreferredStockValue", "—", rest='id="f7" format="ixt:fixed-zero"'),
        number("us-gaap:NumberOfReportableSegments", "twenty-one", "c1", "one", 'id="f8" format="ixt-sec:numwordsen"'),
        words("dei:DocumentType", "10-K" if r["fq"] == 4 else "10-Q", 'id="f9"'),
        words("dei:AmendmentFlag", "☐", 'id="f10" format="ixt:fixed-false"'),
        words("dei:DocumentPeriodEndDate", f"{day:%B} {day.day}, {day.year}", 'id="f11" format="ixt:date-monthname-day-year-en"'),
        words("dei:DocumentFiscalYearFocus", str(r["fy"]), 'id="f12"'),
        words("dei:DocumentFiscalPeriodFocus", "FY" if r["fq"] == 4 else f"Q{r['fq']}", 'id="f13"'),
        words("us-gaap:DebtTermDuration", "eighteen", 'id="f14" format="ixt-sec:durmonth"'),
        words("us-gaap:PolicyTextBlock", "first", 'id="f15" continuedAt="k1"'),
        '<ix:continuation id="k1" continuedAt="k2"> second </ix:continuation><ix:continuation id="k2" continuedAt="k1">third</ix:continuation>',
        number("us-gaap:Revenues", f"{r['qty']}", "c3", rest='id="f16"'),
        number("us-gaap:Goodwill", "5", rest='id="f17" xsi:nil="true"'),
    ])
    return main + "</b>", _HEAD + number("us-gaap:Cash", f"{r['tax']}", rest='id="g1"') + "</html>"


#: Parent, child, weight, order of the calculation arcs; the presentation and definition arcs join the same ends.
_ARCS = [("Assets", "AssetsCurrent", "1.0", "1"), ("Assets", "AssetsNoncurrent", "1.0", "x"), ("GrossProfit", "Revenues", "y", "2.5"), ("GrossProfit", "CostOfRevenue", "-1", "3")]


def _linkbase(kind: str) -> str:
    names = sorted({n for a in _ARCS for n in a[:2]})
    locators = "".join(f'<link:loc xlink:label="l_{n}" xlink:href="t.xsd#us-gaap_{n}"/>' for n in names)
    if kind == "label":
        own = "".join(f'<link:label xlink:label="t_{n}" xlink:role="std" xml:lang="en-US">{n} text</link:label><link:labelArc xlink:from="l_{n}" xlink:to="t_{n}"/>' for n in names)
    else:
        own = "".join(f'<link:{kind}Arc xlink:from="l_{a}" xlink:to="l_{b}" weight="{w}" order="{o}"/>' for a, b, w, o in _ARCS)
        own += f'<link:{kind}Arc xlink:from="l_Assets" xlink:to="gone"/>'
    return f'<link:linkbase xmlns:link="l" xmlns:xlink="k"><link:{kind}Link xlink:role="r/{kind}">{locators}{own}</link:{kind}Link></link:linkbase>'


def _package(r: dict) -> bytes:
    main, part = _document(r)
    stem = f"t{r['k']}-{r['day']:%Y%m%d}"
    members = [("deep/skip.htm", main), ("ex99.htm", "<p>exhibit</p>" * (2000 if r["k"] % 3 else 1)), (f"{stem}.htm", main)]
    members += [(f"{stem}_d2.htm", part)] if r["k"] % 2 == 0 else []
    members += [(f"{stem}.xsd", "<schema/>")] if r["k"] % 3 else []
    members += [(f"{stem}_{k[:3]}.xml", _linkbase(k)) for k in ("label", "presentation", "calculation", "definition")]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members:
            z.writestr(name, text)
    return out.getvalue()


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(filing_id, zip_name, content) of every filing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 50):
                rows = batch.slice(k, 50).to_pylist()
                names = [f"T{r['k']}_{r['k'] + 1:010d}-{r['fy'] % 100:02d}-{r['fq']:06d}.zip" for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r["filing_id"] for r in rows]), pa.array(names), pa.array([_package(r) for r in rows], pa.binary())], ["filing_id", "zip_name", "content"])

    filed = run_sql(spark, sf_dir, f"WITH {FILED_SQL} SELECT CAST(k AS INT) AS k, fy, fq, filing_id, day, net, off, tax, qty, anet, atax FROM filed")
    return materialise(filed.mapInArrow(run, "filing_id string, zip_name string, content binary"), "packages")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(filings.read_packages(packages(spark, sf_dir)), "package-rows")


def filing_main_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main document of every package and its parts."""
    listed = filings.list_members(packages(spark, sf_dir)).withColumn("main", filings.main_document(F.col("members"), F.lit(None).cast("string")))
    return listed.select("filing_id", "main", F.array_join(filings.document_parts(F.col("members"), F.col("main")), ",").alias("parts"), F.size("members").cast("long").alias("n_members"))


def filing_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every inline fact with its type, unit, exact value and context."""
    facts = filings.to_facts(_raw(spark, sf_dir))
    return facts.select(
        "filing_id", F.when(F.col("source_anchor").isNotNull(), F.col("fact_evidence_id")).alias("fact_evidence_id"), F.col("fact_ordinal").cast("long").alias("fact_ordinal"), "concept_norm", "value_type", "unit_canon", F.round(F.col("value_num").cast("double"), 6).alias("value_num"),
        F.when(F.col("value_type") != "numeric", F.col("value_text")).alias("value_text"), "context_period_key", F.col("dimension_count").cast("long").alias("dimension_count"),
    )


def filing_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, fiscal focus, report date, ticker, CIK and accession of each filing."""
    own = packages(spark, sf_dir)
    names = filings.list_members(own).withColumn("main", filings.main_document(F.col("members"), F.lit(None).cast("string"))).select("filing_id", "main").join(own.select("filing_id", "zip_name"), "filing_id")
    out = filings.headers(filings.to_facts(materialise(filings.read_packages(own), "package-rows")), names)
    return out.withColumn("fiscal_year_focus", F.col("fiscal_year_focus").cast("long")).withColumn("report_date", F.col("report_date").cast("string"))


def filing_taxonomies(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filings.taxonomies(_raw(spark, sf_dir))
    return out.select("filing_id", F.array_join("schema_refs", " ").alias("schema_refs"), F.array_join("taxonomies", " ").alias("taxonomies"))


def linkbase_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arcs of the presentation, calculation and definition linkbases, and the labels, of every package."""
    raw = materialise(filings.read_linkbases(packages(spark, sf_dir)), "linkbase-rows")
    kinds = [filings.edges(raw, k).select("filing_id", F.lit(k).alias("kind"), "role", "parent", "child", "weight", "place") for k in ("presentation", "calculation", "definition")]
    named = filings.labels(raw).select("filing_id", F.lit("label").alias("kind"), "role", F.col("concept").alias("parent"), F.col("text").alias("child"), F.lit(None).cast("double").alias("weight"), F.lit(None).cast("double").alias("place"))
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).unionByName(named)


QUERIES = {f.__name__: f for f in (filing_main_document, filing_facts, filing_headers, filing_taxonomies, linkbase_edges)}

_STEM = "'t' || CAST(k AS INT) || '-' || strftime(day, '%Y%m%d')"
_QUARTER, _INSTANT = "'Q' || fq || '_' || fy", "'ASOF_' || strftime(day, '%Y%m%d')"


def _facts_sql() -> str:
    rows = [
        (1, "us-gaap_Revenues", "numeric", "usd", "net", None, _QUARTER, 0), (2, "us-gaap_NetIncomeLoss", "numeric", "usd", "net - off - tax", None, _QUARTER, 0),
        (3, "us-gaap_Assets", "numeric", "usd", "anet", None, _INSTANT, 0), (4, "us-gaap_Liabilities", "numeric", "usd", "-atax", None, _INSTANT, 0),
        (5, "us-gaap_EarningsPerShareBasic", "numeric", "per_share", "1.25", None, _QUARTER, 0), (6, "dei_EntityCommonStockSharesOutstanding", "numeric", "shares", "qty", None, _INSTANT, 0),
        (7, "us-gaap_PreferredStockValue", "numeric", "usd", "0", None, _INSTANT, 0), (8, "us-gaap_NumberOfReportableSegments", "numeric", "pure", "21", None, _QUARTER, 0),
        (9, "dei_DocumentType", "string", None, None, "CASE fq WHEN 4 THEN '10-K' ELSE '10-Q' END", _QUARTER, 0), (10, "dei_AmendmentFlag", "bool", None, None, "'false'", _QUARTER, 0),
        (11, "dei_DocumentPeriodEndDate", "date", None, None, "CAST(day AS VARCHAR)", _QUARTER, 0), (12, "dei_DocumentFiscalYearFocus", "string", None, None, "CAST(fy AS VARCHAR)", _QUARTER, 0),
        (13, "dei_DocumentFiscalPeriodFocus", "string", None, None, "CASE fq WHEN 4 THEN 'FY' ELSE 'Q' || fq END", _QUARTER, 0), (14, "us-gaap_DebtTermDuration", "duration", None, None, "'P18M'", _QUARTER, 0),
        (15, "us-gaap_PolicyTextBlock", "string", None, None, "'first second third'", _QUARTER, 0), (16, "us-gaap_Revenues", "numeric", "usd", "qty", None, _QUARTER, 1),
        (17, "us-gaap_Goodwill", "numeric", "usd", "NULL", None, _INSTANT, 0),
    ]
    anchor = f"filing_id || '::' || {_STEM} || '.htm#f'"
    select = []
    for n, concept, kind, unit, value, text, key, dims in rows:
        evidence = f"{anchor} || {n}" if n != 2 else "NULL"
        unit_sql = f"'{unit}'" if unit else "NULL"
        select.append(f"SELECT filing_id, {evidence} AS fact_evidence_id, {n} AS fact_ordinal, '{concept}' AS concept_norm, '{kind}' AS value_type, {unit_sql} AS unit_canon, CAST({value or 'NULL'} AS DOUBLE) AS value_num, {text or 'NULL'} AS value_text, {key} AS context_period_key, {dims} AS dimension_count FROM filed")
    select.append(f"SELECT filing_id, filing_id || '::' || {_STEM} || '_d2.htm#g1', 1, 'us-gaap_Cash', 'numeric', 'usd', CAST(tax AS DOUBLE), NULL, {_INSTANT}, 0 FROM filed WHERE k % 2 = 0")
    return f"WITH {FILED_SQL} SELECT filing_id, fact_evidence_id, CAST(fact_ordinal AS BIGINT) AS fact_ordinal, concept_norm, value_type, unit_canon, round(value_num, 6) AS value_num, value_text, context_period_key, CAST(dimension_count AS BIGINT) AS dimension_count FROM (" + " UNION ALL ".join(select) + ")"


def _edges_sql() -> str:
    number = lambda t, other: t if t.replace(".", "").replace("-", "").isdigit() else other
    rows = [(k, f"r/{k}", f"us-gaap_{a}", f"us-gaap_{b}", number(w, "1.0"), number(o, "0.0")) for k in ("presentation", "calculation", "definition") for a, b, w, o in _ARCS]
    rows += [("label", "std", f"us-gaap_{n}", f"{n} text", "NULL", "NULL") for n in sorted({n for a in _ARCS for n in a[:2]})]
    values = ", ".join(f"('{k}', '{r}', '{a}', '{b}', CAST({w} AS DOUBLE), CAST({o} AS DOUBLE))" for k, r, a, b, w, o in rows)
    return f"WITH {FILED_SQL} SELECT filing_id, v.* FROM filed CROSS JOIN (VALUES {values}) v(kind, role, parent, child, weight, place)"


ORACLE_SQL = {
    "filing_main_document": f"""WITH {FILED_SQL} SELECT filing_id, {_STEM} || '.htm' AS main, {_STEM} || '.htm' || CASE WHEN k % 2 = 0 THEN ',' || {_STEM} || '_d2.htm' ELSE '' END AS parts,
        CAST(7 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 3 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS n_members FROM filed""",
    "filing_facts": _facts_sql(),
    "filing_headers": f"""WITH {FILED_SQL} SELECT filing_id, CASE fq WHEN 4 THEN '10-K' ELSE '10-Q' END AS form_type, CAST(fy AS BIGINT) AS fiscal_year_focus, CASE fq WHEN 4 THEN 'FY' ELSE 'Q' || fq END AS fiscal_period_focus,
        CAST(day AS VARCHAR) AS report_date, 'T' || CAST(k AS INT) AS ticker, CAST(CAST(k AS INT) + 1 AS VARCHAR) AS cik, lpad(CAST(CAST(k AS INT) + 1 AS VARCHAR), 10, '0') || '-' || lpad(CAST(fy % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(fq AS VARCHAR), 6, '0') AS accession FROM filed""",
    "filing_taxonomies": f"WITH {FILED_SQL} SELECT filing_id, 'http://x/main.xsd' AS schema_refs, 'http://fasb.org/us-gaap/2020 http://xbrl.org/2006/xbrldi http://xbrl.sec.gov/dei/2020' AS taxonomies FROM filed",
    "linkbase_edges": _edges_sql(),
}
