"""Queries on constituents, issuers, reports and filing lists made of the star schema, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import block_sample, guarded_holdout, quotas, rotated
from ..sources import registers as rg
from ..sources.views import sql as run_sql
from ..sources.views import table

CONSTITUENTS_SQL = """SELECT CAST(c_custkey AS BIGINT) AS id, concat('T', CAST(c_custkey % 97 AS VARCHAR(9)), CASE WHEN c_custkey % 3 = 0 THEN '.B' WHEN c_custkey % 3 = 1 THEN '/A' ELSE '' END) AS ticker FROM customer"""
LISTED_SQL = """SELECT DISTINCT concat('T', CAST(k AS VARCHAR(9)), s) AS ticker, CAST(k % 40 AS BIGINT) AS cik FROM (SELECT c_custkey % 97 AS k, CASE WHEN c_custkey % 3 = 0 THEN '-B' WHEN c_custkey % 2 = 0 THEN '-A' ELSE '' END AS s FROM customer) x"""


def issuer_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constituents matched to listed tickers by variants; of those with one CIK the first is canonical."""
    out = rg.resolve_tickers(run_sql(spark, sf_dir, CONSTITUENTS_SQL), run_sql(spark, sf_dir, LISTED_SQL), "id")
    return out.select("id", "ticker", "cik", "status", "canonical_ticker", "ingest_enabled")


ISSUERS_SQL = """SELECT CAST(s_suppkey AS BIGINT) AS issuer, CASE WHEN s_suppkey % 10 = 0 THEN concat('lei', CAST(s_suppkey AS VARCHAR(9))) END AS lei,
  concat(CASE WHEN s_suppkey % 2 = 0 THEN 'The ' ELSE '' END, 'Acme & ', s_name, CASE s_suppkey % 4 WHEN 0 THEN ' P.L.C.' WHEN 1 THEN ' Holdings Limited' WHEN 2 THEN ' Public Limited Company' ELSE ' Group plc' END) AS company_name FROM supplier"""
REPORTS_SQL = """SELECT CAST(s_suppkey AS BIGINT) AS report, CASE WHEN s_suppkey % 20 = 0 THEN concat('LEI', CAST(s_suppkey AS VARCHAR(9))) END AS lei,
  concat('Other Ltd; ', CASE WHEN s_suppkey % 3 = 0 THEN concat('ACME AND ', s_name, ' HOLDINGS LTD') WHEN s_suppkey % 3 = 1 THEN concat('Acme and ', s_name, ' PLC.') ELSE concat('Acme & ', s_name, ', Inc.|Another Co') END) AS company,
  CASE s_suppkey % 3 WHEN 0 THEN 'Tagged' WHEN 1 THEN 'Untagged' END AS tag_esef, CASE WHEN s_suppkey % 2 = 0 THEN 'Direct Upload' ELSE 'Feed' END AS source,
  concat('2024-', lpad(CAST(1 + s_suppkey % 12 AS VARCHAR(2)), 2, '0'), '-01') AS publication_date, CAST(NULL AS VARCHAR(10)) AS document_date, CAST(s_suppkey % 25 AS BIGINT) AS pool FROM supplier"""


def report_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issuers matched to reports by LEI, name or core name."""
    return rg.match_reports(run_sql(spark, sf_dir, ISSUERS_SQL), run_sql(spark, sf_dir, REPORTS_SQL), "issuer", "report")


def company_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form, core and search names of issuers."""
    name = F.col("company_name")
    return run_sql(spark, sf_dir, ISSUERS_SQL).select("issuer", rg.company_name(name).alias("name"), rg.core_name(name).alias("core"), F.array_join(rg.search_names(name), " / ").alias("variants"))


def best_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of each pool that an annual and a half-year request would take."""
    rows = run_sql(spark, sf_dir, REPORTS_SQL)
    annual = rg.best_report(rows, ["pool"], "annual_financial_report", "report").select("pool", F.col("report").alias("annual"))
    half = rg.best_report(rows, ["pool"], "half_year_report", "report").select("pool", F.col("report").alias("half_year"))
    return annual.join(half, "pool")


def first_search_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("issuer"), F.col("l_quantity").cast("long").alias("term_pos"), F.col("l_linenumber").cast("long").alias("hit"))
    return rg.first_term(rows, ["issuer"], "term_pos")


def _submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer the parallel arrays of a submissions document; report dates are fewer than filings."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority")
    one = F.struct("o_orderkey", "day", "o_orderpriority")
    held = rows.groupBy(F.col("o_custkey").alias("cik")).agg(F.array_sort(F.collect_list(one)).alias("_o"))
    of = lambda f: F.transform("_o", f)
    reports = F.transform(F.slice("_o", F.lit(1), F.greatest(F.size("_o") - 1, F.lit(0))), lambda o: F.when(o["o_orderkey"] % 4 == 0, None).otherwise(F.date_sub(o["day"], 40).cast("string")))
    return held.select(
        "cik", of(lambda o: F.when(F.substring(o["o_orderpriority"], 1, 1).isin("1", "2"), "10-K").otherwise("8-K")).alias("forms"), of(lambda o: F.concat(F.lit("a"), o["o_orderkey"].cast("string"))).alias("accessions"),
        of(lambda o: F.when(o["o_orderkey"] % 9 == 0, "unknown").otherwise(o["day"].cast("string"))).alias("filing_dates"), reports.alias("report_dates"), of(lambda o: F.lit("main.htm")).alias("primary_docs"),
    )


def recent_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annual filings of each issuer up to a cutoff, newest first."""
    out = rg.recent_filings(_submissions(spark, sf_dir), "10-K", "cik", "1997-06-30")
    return out.select("cik", "accession", "filed_at", "report_date", F.col("place").cast("long").alias("place"))


def trailing_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of the three years that end with the newest."""
    out = rg.trailing_years(rg.recent_filings(_submissions(spark, sf_dir), "10-K", "cik"), "cik", 3)
    return out.select("cik", "accession", F.col("place").cast("long").alias("place"))


MANIFEST_SQL = """SELECT CAST(o_custkey AS BIGINT) AS cik, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS form_type, concat(lpad(CAST(o_custkey AS VARCHAR(10)), 10, '0'), '-24-', lpad(CAST(o_orderkey % 1000000 AS VARCHAR(6)), 6, '0')) AS accession, CAST(o_orderkey AS BIGINT) AS o FROM orders"""
_URL_SQL = """concat('https://www.sec.gov/Archives/edgar/data/', CAST(CASE WHEN o % 5 = 0 THEN cik + 1 ELSE cik END AS VARCHAR(10)), '/', replace(accession, '-', ''), '/', accession, CASE WHEN o % 11 = 0 THEN '-xbrl.zip?x=1' ELSE '-xbrl.zip' END)"""


def target_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, f"SELECT o, cik, accession, {_URL_SQL} AS url FROM ({MANIFEST_SQL}) m")
    return rows.select("o", rg.target_valid(F.col("accession"), F.col("cik"), F.col("url")).alias("valid"))


def manifest_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a manifest and a ledger with missing, doubled and further rows do not share one to one."""
    rows = run_sql(spark, sf_dir, MANIFEST_SQL)
    ledger = rows.where("o % 13 <> 0").unionByName(rows.where("o % 17 = 0")).unionByName(rows.where("o % 19 = 0").withColumn("cik", F.col("cik") + 1_000_000))
    out = rg.binding_problems(rows.drop("o"), ledger.drop("o"), ["cik", "form_type", "accession"])
    return out.select("cik", F.coalesce("form_type", F.lit("")).alias("form_type"), "accession", "n_manifest", "n_ledger")


def html_constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The constituents in the second table of one page for each region."""
    nation = table(spark, sf_dir, "nation")
    cells = F.concat(F.lit("<tr><td><a href='#'>"), F.col("n_name"), F.lit("</a></td><td>"), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise("</td><td>x &amp; y"), F.lit("</td></tr>"))
    body = nation.groupBy(F.col("n_regionkey").cast("long").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", cells.alias("c")))), lambda s: s["c"]), "").alias("body"))
    html = F.concat(F.lit("<table><tr><th>Other</th></tr><tr><td>no</td></tr></table><table><tr><th>Symbol</th><th> Security\n</th><th>Note</th></tr>"), F.col("body"), F.lit("</table>"))
    out = rg.html_tables(body.select("page_id", html.alias("html")), "page_id", ["symbol", "security"])
    return out.select("page_id", F.col("row").cast("long").alias("row"), F.col("cells")["Symbol"].alias("symbol"), F.col("cells")["Security"].alias("security"), F.col("cells")["Note"].alias("note"))


def holdout_with_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations split by hash with so rare a share that none is drawn: the last row is held out."""
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return guarded_holdout(rows, "n_name", "issuer-holdout|v9|", ["n_nationkey"], parts=1_000_003).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "split")


def rotated_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten metrics in an order that begins at another one for each issuer."""
    issuers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("issuer"))
    rows = issuers.withColumn("metric", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return rotated(rows, ["issuer"], "metric", "issuer", 10).select("issuer", F.col("metric").cast("long").alias("metric"), F.col("place").cast("long").alias("place"))


def stratum_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five documents of each source by stable rank."""
    out = block_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 5, "s1", "doc_id")
    return out.select("doc_id", "source", F.col("place").cast("long").alias("place"))


def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced samples of two order states, by quota."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("fy"))
    return quotas(rows, "o_orderstatus", {"F": 12, "O": 11}, ["o_orderpriority", "fy"], "o_orderkey", "7").select("o_orderkey", "o_orderstatus", "o_orderpriority", "fy", "pick")


QUERIES = {
    f.__name__: f
    for f in (
        issuer_tickers, report_matches, company_keys, best_reports, first_search_term, recent_filings, trailing_filings, target_urls, manifest_binding, html_constituents, holdout_with_guard,
        rotated_metrics, stratum_blocks, quota_sample,
    )
}


def _name(x: str) -> str:
    text = f"replace(replace(replace(replace(upper({x}), '&', ' AND '), 'P.L.C.', ' PLC '), 'P.L.C', ' PLC '), 'PLC.', ' PLC ')"
    for pattern, short in (("PUBLIC LIMITED COMPANY", "PLC"), ("LIMITED", "LTD"), ("INCORPORATED", "INC"), ("COMPANY", "CO")):
        text = f"regexp_replace({text}, '\\b{pattern}\\b', ' {short} ', 'g')"
    return f"array_to_string(list_filter(string_split(regexp_replace({text}, '[^A-Z0-9]+', ' ', 'g'), ' '), lambda w: w NOT IN ('', 'THE')), ' ')"


def _core(x: str) -> str:
    return f"regexp_replace({x}, '(^| +)(({'|'.join(rg.SUFFIXES)})( +|$))+$', '')"


_FILED_SQL = """f AS (SELECT o_custkey AS cik, 'a' || o_orderkey AS accession, CASE WHEN o_orderkey % 9 = 0 THEN 'unknown' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS filed_at,
    CASE WHEN o_orderkey % 4 = 0 OR row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = count(*) OVER (PARTITION BY o_custkey) THEN NULL ELSE CAST(CAST(CAST(o_orderdate AS DATE) - 40 AS DATE) AS VARCHAR) END AS report_date, o_orderpriority FROM orders),
  k AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY report_date DESC NULLS LAST, CASE WHEN filed_at <> 'unknown' THEN filed_at END DESC NULLS LAST, accession DESC) AS place FROM f WHERE substr(o_orderpriority, 1, 1) IN ('1', '2') {0})"""

ORACLE_SQL = {
    "issuer_tickers": f"""WITH c AS ({CONSTITUENTS_SQL}), l AS ({LISTED_SQL}),
        v AS (SELECT id, 0 AS pos, ticker AS t FROM c UNION ALL SELECT id, 1, replace(ticker, '.', '-') FROM c UNION ALL SELECT id, 2, replace(ticker, '/', '-') FROM c),
        h AS (SELECT v.id, arg_min(cik, pos) AS cik FROM v JOIN l ON l.ticker = v.t GROUP BY 1), j AS (SELECT c.id, c.ticker, cik FROM c LEFT JOIN h USING (id)),
        n AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY id) AS n, first_value(ticker) OVER (PARTITION BY cik ORDER BY id) AS f FROM j)
        SELECT id, ticker, cik, CASE WHEN cik IS NULL THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'duplicate_cik' END AS status, CASE WHEN cik IS NOT NULL THEN f END AS canonical_ticker, cik IS NOT NULL AND n = 1 AS ingest_enabled FROM n""",
    "report_matches": f"""WITH i AS (SELECT issuer, upper(lei) AS lei, {_name('company_name')} AS name FROM ({ISSUERS_SQL})), ic AS (SELECT *, {_core('name')} AS core FROM i),
        r AS (SELECT report, upper(lei) AS lei, unnest(string_split_regex(company, '[;|]')) AS part FROM ({REPORTS_SQL})), rn AS (SELECT DISTINCT report, lei, {_name('part')} AS name FROM r), rc AS (SELECT *, {_core('name')} AS core FROM rn),
        p AS (SELECT issuer, report, 0 AS rk FROM ic JOIN (SELECT DISTINCT report, lei FROM rc) x ON x.lei = ic.lei UNION ALL SELECT issuer, report, 1 FROM ic JOIN rc ON rc.name = ic.name AND ic.name <> '' UNION ALL SELECT issuer, report, 2 FROM ic JOIN rc ON rc.core = ic.core AND ic.core <> '')
        SELECT issuer, report, CASE min(rk) WHEN 0 THEN 'lei_exact' WHEN 1 THEN 'company_exact' ELSE 'company_core' END AS kind FROM p GROUP BY 1, 2""",
    "company_keys": f"""WITH i AS (SELECT issuer, company_name, {_name('company_name')} AS name FROM ({ISSUERS_SQL})), c AS (SELECT *, {_core('name')} AS core FROM i),
        v AS (SELECT *, [company_name, name] || CASE WHEN NOT list_contains(string_split(name, ' '), 'PLC') THEN [company_name || ' plc'] ELSE [] END || CASE WHEN core <> '' AND core <> company_name AND core <> name THEN [core, core || ' plc', core || ' group plc'] ELSE [] END AS vs FROM c)
        SELECT issuer, name, core, array_to_string(list_filter(vs, lambda x, i: list_position(vs, x) = i), ' / ') AS variants FROM v""",
    "best_reports": f"""WITH r AS (SELECT *, CASE tag_esef WHEN 'Tagged' THEN 2 WHEN 'Untagged' THEN 1 ELSE 0 END AS t, CASE source WHEN 'Direct Upload' THEN 1 ELSE 0 END AS d FROM ({REPORTS_SQL})),
        k AS (SELECT pool, report, row_number() OVER (PARTITION BY pool ORDER BY t DESC, d DESC, publication_date DESC, report) AS a, row_number() OVER (PARTITION BY pool ORDER BY d DESC, t DESC, publication_date DESC, report) AS h FROM r)
        SELECT pool, max(report) FILTER (a = 1) AS annual, max(report) FILTER (h = 1) AS half_year FROM k GROUP BY 1""",
    "first_search_term": "SELECT l_orderkey AS issuer, CAST(l_quantity AS BIGINT) AS term_pos, CAST(l_linenumber AS BIGINT) AS hit FROM lineitem QUALIFY rank() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_quantity AS BIGINT)) = 1",
    "recent_filings": f"WITH {_FILED_SQL.format(chr(32) + 'AND CASE WHEN filed_at <> ' + chr(39) + 'unknown' + chr(39) + ' THEN CAST(filed_at AS DATE) <= DATE ' + chr(39) + '1997-06-30' + chr(39) + ' END')} SELECT cik, accession, filed_at, report_date, place FROM k",
    "trailing_filings": f"""WITH {_FILED_SQL.format('')}, y AS (SELECT *, year(CAST(coalesce(report_date, CASE WHEN filed_at <> 'unknown' THEN filed_at END) AS DATE)) AS y FROM k),
        a AS (SELECT cik, y AS anchor FROM y WHERE place = 1) SELECT y.cik, accession, place FROM y JOIN a ON a.cik = y.cik WHERE place = 1 OR y.y BETWEEN anchor - 2 AND anchor""",
    "target_urls": f"SELECT o, o % 5 <> 0 AND o % 11 <> 0 AND cik > 0 AS valid FROM ({MANIFEST_SQL})",
    "manifest_binding": f"""WITH m AS ({MANIFEST_SQL}), l AS (SELECT cik, form_type, accession FROM m WHERE o % 13 <> 0 UNION ALL SELECT cik, form_type, accession FROM m WHERE o % 17 = 0 UNION ALL SELECT cik + 1000000, form_type, accession FROM m WHERE o % 19 = 0),
        u AS (SELECT cik, coalesce(form_type, '') AS form_type, accession, 1 AS a, 0 AS b FROM m UNION ALL SELECT cik, coalesce(form_type, ''), accession, 0, 1 FROM l)
        SELECT cik, form_type, accession, CAST(sum(a) AS BIGINT) AS n_manifest, CAST(sum(b) AS BIGINT) AS n_ledger FROM u GROUP BY 1, 2, 3 HAVING sum(a) <> 1 OR sum(b) <> 1""",
    "html_constituents": """SELECT CAST(n_regionkey AS BIGINT) AS page_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS row, n_name AS symbol, CAST(n_nationkey AS VARCHAR) AS security, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'x & y' END AS note FROM nation""",
    "holdout_with_guard": """WITH h AS (SELECT n_nationkey, ('0x' || substr(sha1('issuer-holdout|v9|' || n_name), 1, 8))::BIGINT % 1000003 = 0 AS e FROM nation)
        SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CASE WHEN e OR ((SELECT sum(e::INT) FROM h) = 0 AND n_nationkey = (SELECT max(n_nationkey) FROM nation)) THEN 'eval' ELSE 'train' END AS split FROM h""",
    "rotated_metrics": "SELECT CAST(s_suppkey AS BIGINT) AS issuer, m AS metric, (m - s_suppkey % 10 + 10) % 10 + 1 AS place FROM supplier CROSS JOIN (SELECT unnest(range(0, 10)) AS m)",
    "stratum_blocks": "SELECT doc_id, source, place FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('s1|source|' || doc_id), doc_id) AS place FROM documents) WHERE place <= 5",
}
