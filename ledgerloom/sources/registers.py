"""Constituents, issuers and filing lists: readers, normalised names, ranked matches, manifests, JSON lines.

Defined cases: rows without a ticker are left out; a filing without a date fails a cutoff; an issuer
without a match keeps its row with the reason; a null name has no key and matches nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.periods import strict_date

# Column names that a snapshot may use, suffixes of company names, search phrases.
TICKERS, NAMES, LEIS = ["ticker", "symbol", "epic"], ["company_name", "name", "security", "issuer"], ["lei", "legal_entity_identifier"]
KEYWORDS, COUNTRIES = ["nsm_keyword", "search_keyword", "keyword"], ["issuer_country", "country"]
SUFFIXES = ["PLC", "LTD", "GROUP", "HOLDINGS", "HOLDING", "CO", "CORP", "CORPORATION", "INC", "THE"]


def read_constituents(spark: SparkSession, path: str, uk: bool = False) -> DataFrame:
    """ticker (upper case), company_name and, for the UK, lei, nsm_keyword and issuer_country, of a CSV with any of the known headers, with or without a byte order mark."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    have = {c.lstrip("﻿").strip().lower(): c for c in raw.columns}
    first = lambda names: next((F.trim(F.col(f"`{have[n]}`")) for n in names if n in have), None)
    ticker, name = first(TICKERS if uk else TICKERS[:2]), first(NAMES if uk else NAMES[:3])
    if ticker is None or (uk and name is None):
        raise ValueError("the snapshot needs a ticker or symbol column" + (" and a company name" if uk else ""))
    none = F.lit(None).cast("string")
    rows = raw.select(
        F.upper(ticker).alias("ticker"), F.coalesce(none if name is None else name, F.lit("")).alias("company_name"), *([] if not uk else [
            F.upper(F.nullif(none if first(LEIS) is None else first(LEIS), F.lit(""))).alias("lei"), F.nullif(none if first(KEYWORDS) is None else first(KEYWORDS), F.lit("")).alias("nsm_keyword"),
            F.coalesce(F.nullif(none if first(COUNTRIES) is None else first(COUNTRIES), F.lit("")), F.lit("UK")).alias("issuer_country"),
        ]),
    )
    kept = rows.where("coalesce(ticker, '') <> ''")
    return kept.where("company_name <> ''") if uk else kept


def read_json_lines(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """JSON lines by a declared schema, blank lines left out; with `key` doubled or missing keys and rows that are no objects are an error."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if key is None:
        return lines.select(F.from_json("value", schema).alias("_r")).select("_r.*")
    parsed = lines.select(F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("_r"), "value").select("_r.*", "value")
    bad = parsed.where(F.col("_corrupt").isNotNull() | ~F.ltrim("value").startswith("{") | F.col(key).isNull()).limit(1).count()
    if bad:
        raise ValueError(f"{path}: a row is no object or has no {key}")
    if parsed.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"{path}: {key} is doubled")
    return parsed.drop("_corrupt", "value")


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple[str, str]]]] = []
        self.open: list[int] = []
        self.cell: list[str] | None = None
        self.kind = ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "table":
            self.close_cell()
            self.open.append(len(self.tables))
            self.tables.append([])
        elif tag == "tr" and self.open:
            self.close_cell()
            self.tables[self.open[-1]].append([])
        elif tag in ("td", "th") and self.open:
            self.close_cell()
            self.cell, self.kind = [], tag

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr", "table"):
            self.close_cell()
        if tag == "table" and self.open:
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.cell is not None and data.strip():
            self.cell.append(data.strip())

    def close_cell(self) -> None:
        if self.cell is not None and self.open:
            rows = self.tables[self.open[-1]]
            if not rows:
                rows.append([])
            rows[-1].append((self.kind, " ".join(" ".join(self.cell).split())))
        self.cell = None


def table_records(html: str | None, required: list[str]) -> list[dict[str, str]]:
    """The rows of the first table whose header row has all required headers, short rows filled up."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    parser.close_cell()
    for rows in parser.tables:
        heads = [text for kind, text in rows[0] if kind == "th"] if rows else []
        if heads and {h.lower() for h in required} <= {h.lower() for h in heads}:
            return [dict(zip(heads, [t for _, t in row] + [""] * len(heads), strict=False)) for row in rows[1:] if row]
    return []


def html_tables(pages: DataFrame, key: str, required: list[str], html: str = "html") -> DataFrame:
    """key, row (from 0) and cells (map from header to text) of the wanted table of every page that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.map_(pa.string(), pa.string()))
        for batch in batches:
            found = [[list(r.items()) for r in table_records(x, required)] for x in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, kind)], [key, "_rows"])

    rows = pages.select(F.col(key).cast("long"), F.col(html).cast("string").alias("_html")).mapInArrow(run, f"{key} long, _rows array<map<string,string>>")
    return rows.select(key, F.posexplode("_rows").alias("row", "cells"))


# --- names ---


def company_name(name: Column) -> Column:
    """Upper case words: & is AND, forms of PLC, LTD, INC and CO are one, THE is left out."""
    text = F.replace(F.upper(name), F.lit("&"), F.lit(" AND "))
    for form in ("P.L.C.", "P.L.C", "PLC."):
        text = F.replace(text, F.lit(form), F.lit(" PLC "))
    for pattern, short in ((r"\bPUBLIC LIMITED COMPANY\b", " PLC "), (r"\bLIMITED\b", " LTD "), (r"\bINCORPORATED\b", " INC "), (r"\bCOMPANY\b", " CO ")):
        text = F.regexp_replace(text, pattern, short)
    words = F.filter(F.split(F.regexp_replace(text, "[^A-Z0-9]+", " "), " "), lambda w: ~w.isin("", "THE"))
    return F.coalesce(F.array_join(words, " "), F.lit(""))


def core_name(name: Column) -> Column:
    """The normalised name without suffixes at its end; one of suffixes alone has no core."""
    return F.regexp_replace(company_name(name), rf"(?:^|\s+)(?:(?:{'|'.join(SUFFIXES)})(?:\s+|$))+$", "")


def name_list(names: Column) -> Column:
    """The normalised names of a field that lists several, by semicolon or bar."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(names, F.lit("")), "[;|]"), company_name), lambda n: n != ""))


def search_names(name: Column) -> Column:
    """What to search for: the name, its normal form, with plc, its core, and the core with plc and group plc."""
    normal, core = company_name(name), core_name(name)
    plc = F.array_contains(F.split(normal, " "), "PLC")
    own = F.when((core != "") & (core != name) & (core != normal), core)
    found = F.array(name, normal, F.when((normal != "") & ~plc, F.concat(name, F.lit(" plc"))), own, F.concat(own, F.lit(" plc")), F.concat(own, F.lit(" group plc")))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""))


def ticker_variants(ticker: Column) -> Column:
    own = F.array(ticker, F.replace(ticker, F.lit("."), F.lit("-")), F.replace(ticker, F.lit("/"), F.lit("-")))
    return F.array_distinct(F.filter(F.transform(own, lambda t: F.upper(F.trim(t))), lambda t: t != ""))


# --- matches ---


def resolve_tickers(constituents: DataFrame, tickers: DataFrame, order: str) -> DataFrame:
    """Each constituent with the CIK of its first ticker variant that is listed; of several with one CIK the first in `order` is canonical and enabled."""
    spread = constituents.select("*", F.posexplode(ticker_variants(F.col("ticker"))).alias("_pos", "_variant"))
    hits = spread.join(tickers.select(F.col("ticker").alias("_variant"), "cik"), "_variant").groupBy(order).agg(F.min_by("cik", "_pos").alias("cik"))
    rows = constituents.join(hits, order, "left")
    first = F.first("ticker").over(W.Window.partitionBy("cik").orderBy(order))
    place = F.row_number().over(W.Window.partitionBy("cik").orderBy(order))
    known = F.col("cik").isNotNull()
    status = F.when(~known, "unresolved").when(F.col("_n") == 1, "resolved").otherwise("duplicate_cik")
    rows = rows.withColumn("_n", place).withColumn("canonical_ticker", F.when(known, first))
    return rows.withColumn("status", status).withColumn("ingest_enabled", known & (F.col("_n") == 1)).drop("_n")


def match_reports(issuers: DataFrame, reports: DataFrame, issuer: str, report: str) -> DataFrame:
    """(issuer, report, kind) by LEI, else normalised name, else core name: three equi joins, of each pair the strongest kind."""
    left = issuers.select(issuer, F.nullif(F.upper(F.trim("lei")), F.lit("")).alias("lei"), F.nullif(company_name(F.col("company_name")), F.lit("")).alias("name"), F.nullif(core_name(F.col("company_name")), F.lit("")).alias("core"))
    right = reports.select(report, F.upper(F.trim("lei")).alias("lei"), name_list(F.col("company")).alias("names"))
    by_lei = left.select(issuer, "lei").join(right.select(report, "lei"), "lei").select(issuer, report, F.lit(0).alias("rank"))
    named = right.select(report, F.explode("names").alias("name"))
    by_name = left.select(issuer, "name").join(named, "name").select(issuer, report, F.lit(1).alias("rank"))
    cored = named.select(report, core_name(F.col("name")).alias("core"))
    by_core = left.select(issuer, "core").join(cored, "core").select(issuer, report, F.lit(2).alias("rank"))
    best = by_lei.unionByName(by_name).unionByName(by_core).groupBy(issuer, report).agg(F.min("rank").alias("rank"))
    return best.select(issuer, report, F.element_at(F.array(*map(F.lit, ["lei_exact", "company_exact", "company_core"])), F.col("rank") + 1).alias("kind"))


def best_report(candidates: DataFrame, keys: list[str], kind: str, id_column: str) -> DataFrame:
    """The first candidate of each key: annual reports tagged before directly uploaded, others the other way round, then the newest."""
    tagged = F.when(F.col("tag_esef") == "Tagged", 2).when(F.col("tag_esef") == "Untagged", 1).otherwise(0)
    direct = F.when(F.col("source") == "Direct Upload", 1).otherwise(0)
    lead = [tagged, direct] if kind == "annual_financial_report" else [direct, tagged]
    order = [F.desc(c) for c in (*lead, F.coalesce("publication_date", F.lit("")), F.coalesce("document_date", F.lit("")))]
    place = F.row_number().over(W.Window.partitionBy(*keys).orderBy(*order, id_column))
    return candidates.withColumn("_n", place).where("_n = 1").drop("_n")


def first_term(hits: DataFrame, keys: list[str], term_pos: str) -> DataFrame:
    """The hits of the first search term that has any, for each key."""
    return hits.withColumn("_r", F.rank().over(W.Window.partitionBy(*keys).orderBy(term_pos))).where("_r = 1").drop("_r")


# --- filings of an issuer ---


def recent_filings(submissions: DataFrame, form: str, key: str, cutoff: str | None = None) -> DataFrame:
    """key, accession, filed_at, report_date, primary_doc and place (newest first) of the filings of one form.

    submissions holds the parallel arrays forms, accessions, filing_dates, report_dates and primary_docs; shorter ones give nulls.
    """
    names = {"form": "forms", "accession": "accessions", "filed_at": "filing_dates", "report_date": "report_dates", "primary_doc": "primary_docs"}
    zipped = F.arrays_zip(*[F.col(c).alias(k) for k, c in names.items()])
    rows = submissions.select(key, F.explode(zipped).alias("_f")).select(key, *[F.col(f"_f.{k}").alias(k) for k in names]).where((F.col("form") == form) & (F.coalesce("accession", F.lit("")) != ""))
    filed, reported = strict_date(F.col("filed_at")), strict_date(F.col("report_date"))
    if cutoff is not None:
        rows = rows.where(filed <= F.lit(cutoff).cast("date"))
    order = W.Window.partitionBy(key).orderBy(reported.desc_nulls_last(), filed.desc_nulls_last(), F.desc("accession"))
    return rows.withColumn("place", F.row_number().over(order))


def trailing_years(filings: DataFrame, key: str, years: int) -> DataFrame:
    """Those of the `years` years that end with the newest filing's; the newest alone where nothing is dated, or for one year."""
    if years <= 1:
        return filings.where("place = 1")
    effective = F.coalesce(strict_date(F.col("report_date")), strict_date(F.col("filed_at")))
    anchor = F.first(F.year(effective)).over(W.Window.partitionBy(key).orderBy("place"))
    rows = filings.withColumn("_year", F.year(effective)).withColumn("_anchor", anchor)
    return rows.where((F.col("place") == 1) | (F.col("_year").between(F.col("_anchor") - (years - 1), F.col("_anchor")))).drop("_year", "_anchor")


def target_valid(accession: Column, cik: Column, url: Column) -> Column:
    """Whether a resolved filing's URL is exactly that of its CIK and accession number in the archive."""
    path = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik.cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), accession, F.lit("-xbrl.zip"))
    return F.coalesce(accession.rlike(r"^\d{10}-\d{2}-\d{6}$") & (cik > 0) & (url == path), F.lit(False))


def binding_problems(manifest: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that manifest and ledger do not hold exactly once each (null is a value): n_manifest, n_ledger."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    a, b = count(manifest, "n_manifest").alias("a"), count(ledger, "n_ledger").alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    both = a.join(b, same, "full_outer").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], F.coalesce("n_manifest", F.lit(0)).alias("n_manifest"), F.coalesce("n_ledger", F.lit(0)).alias("n_ledger"))
    return both.where("n_manifest <> 1 OR n_ledger <> 1")


def file_problems(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem) of ledger rows whose file (as `binaryFile` gives it: path, length, content) is missing or of other size or SHA-256."""
    own = files.select("path", "length", F.sha2("content", 256).alias("sha256"))
    joined = ledger.select("path", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha256")).join(own, "path", "left")
    problem = F.when(F.col("length").isNull(), "missing").when(F.col("length") != F.col("_bytes"), "size").when(F.col("sha256") != F.lower("_sha256"), "sha256")
    return joined.select("path", problem.alias("problem")).where("problem IS NOT NULL")
