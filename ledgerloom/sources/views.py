"""Filing-shaped projections of the star-schema tables, as SQL that several engines read alike.

Each nation is an issuer and each calendar quarter of its customers' orders one filing: quarterly
and year-to-date flows, year totals with the fourth quarter, and balances at the quarter's end.
Odd issuers report only year-to-date flows after the first quarter; every third issuer uses another
revenue concept; some facts are reported twice, some balances lie a few days off the quarter's end.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..storage import materialise

#: CTEs up to `filed`, one row for each filing.
FILED_SQL = """
lines AS (
  SELECT n_nationkey AS k, n_name AS ticker, CAST(year(o_orderdate) AS INT) AS fy, CAST(quarter(o_orderdate) AS INT) AS fq,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,2)) AS net,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS tax,
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS off,
         CAST(l_quantity AS DECIMAL(18,2)) AS qty
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
quarters AS (
  SELECT k, ticker, fy, fq, CAST(sum(net) AS DECIMAL(24,2)) AS net, CAST(sum(tax) AS DECIMAL(24,2)) AS tax, CAST(sum(off) AS DECIMAL(24,2)) AS off, CAST(sum(qty) AS DECIMAL(24,2)) AS qty
  FROM lines GROUP BY k, ticker, fy, fq),
sums AS (
  SELECT *, CAST(sum(net) OVER y AS DECIMAL(24,2)) AS ynet, CAST(sum(tax) OVER y AS DECIMAL(24,2)) AS ytax, CAST(sum(off) OVER y AS DECIMAL(24,2)) AS yoff,
         CAST(sum(net) OVER a AS DECIMAL(24,2)) AS anet, CAST(sum(tax) OVER a AS DECIMAL(24,2)) AS atax, CAST(sum(off) OVER a AS DECIMAL(24,2)) AS aoff, CAST(sum(qty) OVER a AS DECIMAL(24,2)) AS aqty
  FROM quarters WINDOW y AS (PARTITION BY k, fy ORDER BY fq), a AS (PARTITION BY k ORDER BY fy, fq)),
filed AS (
  SELECT *, concat(ticker, '-', CAST(fy AS VARCHAR(4)), 'Q', CAST(fq AS VARCHAR(1))) AS filing_id,
         CAST(concat(CAST(fy AS VARCHAR(4)), CASE fq WHEN 1 THEN '-03-31' WHEN 2 THEN '-06-30' WHEN 3 THEN '-09-30' ELSE '-12-31' END) AS DATE) AS day
  FROM sums)
"""
#: CTEs from `filed` to `facts_canon`.
_REST_SQL = """
flows AS (
  SELECT filing_id, ticker, k, fy, fq, day, 'us-gaap_Revenues' AS base, net AS q, ynet AS y FROM filed
  UNION ALL SELECT filing_id, ticker, k, fy, fq, day, 'us-gaap_CostOfRevenue', off, yoff FROM filed
  UNION ALL SELECT filing_id, ticker, k, fy, fq, day, 'us-gaap_NetIncomeLoss', net - off - tax, ynet - yoff - ytax FROM filed
  UNION ALL SELECT filing_id, ticker, k, fy, fq, day, 'us-gaap_OperatingIncomeLoss', net - off, ynet - yoff FROM filed
  UNION ALL SELECT filing_id, ticker, k, fy, fq, day, 'us-gaap_NetCashProvidedByUsedInOperatingActivities', net - tax, ynet - ytax FROM filed WHERE k % 5 <> 4
  UNION ALL SELECT filing_id, ticker, k, fy, fq, day, 'us-gaap_PaymentsToAcquirePropertyPlantAndEquipment', off, yoff FROM filed),
points AS (
  SELECT filing_id, ticker, k, fy, fq, day, 'us-gaap_Assets' AS concept, anet AS v FROM filed
  UNION ALL SELECT filing_id, ticker, k, fy, fq, day, 'us-gaap_AssetsCurrent', anet - aoff FROM filed
  UNION ALL SELECT filing_id, ticker, k, fy, fq, day, 'us-gaap_AssetsNoncurrent', aoff FROM filed
  UNION ALL SELECT filing_id, ticker, k, fy, fq, day, 'us-gaap_Liabilities', atax FROM filed
  UNION ALL SELECT filing_id, ticker, k, fy, fq, day, 'us-gaap_LiabilitiesCurrent', CASE WHEN k = 7 THEN 0 ELSE atax - 1 END FROM filed
  UNION ALL SELECT filing_id, ticker, k, fy, fq, day, 'us-gaap_LiabilitiesNoncurrent', CASE WHEN k = 7 THEN atax ELSE 1 END FROM filed
  UNION ALL SELECT filing_id, ticker, k, fy, fq, day, 'us-gaap_StockholdersEquity', anet - atax FROM filed
  UNION ALL SELECT filing_id, ticker, k, fy, fq, day, 'us-gaap_CashAndCashEquivalentsAtCarryingValue', aqty FROM filed
  UNION ALL SELECT filing_id, ticker, k, fy, fq, day, 'us-gaap_ShortTermInvestments', aoff FROM filed WHERE k % 4 <> 3
  UNION ALL SELECT filing_id, ticker, k, fy, fq, day, 'us-gaap_AccountsReceivableNetCurrent', atax FROM filed
  UNION ALL SELECT filing_id, ticker, k, fy, fq, day, 'us-gaap_InventoryNet', aqty + fq FROM filed),
placed AS (
  SELECT filing_id, ticker, k, base AS concept, 'Q' AS period_type, concat('Q', CAST(fq AS VARCHAR(1)), '_', CAST(fy AS VARCHAR(4))) AS period_key, day, fy, fq, false AS is_ytd, q AS v FROM flows WHERE k % 2 = 0 OR fq = 1
  UNION ALL SELECT filing_id, ticker, k, base, 'YTD', concat('YTD_Q', CAST(fq AS VARCHAR(1)), '_', CAST(fy AS VARCHAR(4))), day, fy, fq, true, y FROM flows WHERE fq IN (2, 3) OR (fq = 4 AND k % 2 = 1)
  UNION ALL SELECT filing_id, ticker, k, base, 'FY', concat('FY', CAST(fy AS VARCHAR(4))), day, fy, 4, false, y FROM flows WHERE fq = 4
  UNION ALL SELECT filing_id, ticker, k, concept, 'ASOF', concat('ASOF_', CAST(fy AS VARCHAR(4)), CASE WHEN fq = 4 AND k % 6 = 5 THEN '1229' ELSE CASE fq WHEN 1 THEN '0331' WHEN 2 THEN '0630' WHEN 3 THEN '0930' ELSE '1231' END END),
         CASE WHEN fq = 4 AND k % 6 = 5 THEN CAST(concat(CAST(fy AS VARCHAR(4)), '-12-29') AS DATE) ELSE day END, fy, fq, false, v FROM points),
named AS (
  SELECT *, CASE WHEN concept = 'us-gaap_Revenues' AND k % 3 = 1 THEN 'us-gaap_SalesRevenueNet' ELSE concept END AS concept_norm FROM placed),
facts_canon AS (
  SELECT filing_id, ticker, concat(filing_id, ':', concept_norm, ':', period_key) AS fact_evidence_id, concept_norm, period_type, period_key, day AS period_end,
         fy AS fiscal_year, fq AS fiscal_quarter, is_ytd, 'usd' AS unit_canon, CAST(v AS DECIMAL(38,6)) AS value_num, CAST(NULL AS VARCHAR(10)) AS value_text,
         CASE WHEN k % 5 = 2 THEN CAST(NULL AS VARCHAR(10)) ELSE 'anchor' END AS source_anchor
  FROM named
  UNION ALL
  SELECT concat(filing_id, '-A'), ticker, concat(filing_id, '-A:', concept_norm, ':', period_key), concept_norm, period_type, period_key, day, fy, fq, is_ytd, 'usd',
         CAST(v + CASE WHEN k % 4 = 0 THEN 5 ELSE 0 END AS DECIMAL(38,6)), CAST(NULL AS VARCHAR(10)), 'anchor'
  FROM named WHERE fy % 3 = 0 AND fq = 2 AND concept LIKE '%Assets%')
"""

FACTS_SQL = f"{FILED_SQL}, {_REST_SQL}"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(spark: SparkSession, sf_dir: str, text: str, **frames: DataFrame) -> DataFrame:
    """Run SQL over the tables of `sf_dir` that it names, and over `frames`.

    The views last for this call only and have names of their own, so queries on other folders in one session are apart.
    """
    words = set(re.findall(r"\w+", text))
    known = {name: table(spark, sf_dir, name) for name in words.intersection(TABLES)} | frames
    own = {name: f"{name}_{uuid.uuid4().hex}" for name in known}
    for name, frame in known.items():
        frame.createOrReplaceTempView(own[name])
        text = re.sub(rf"(?<=\b(?:FROM|JOIN) ){name}\b", own[name], re.sub(rf"\b(FROM|JOIN)\s+{name}\b", rf"\1 {name}", text))
    out = spark.sql(text)
    for name in own.values():
        spark.catalog.dropTempView(name)
    return out


def facts_canon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts, written once: what follows reads them several times."""
    filed = materialise(sql(spark, sf_dir, f"WITH {FILED_SQL} SELECT * FROM filed"), "filed")
    return materialise(sql(spark, sf_dir, f"WITH {_REST_SQL} SELECT * FROM facts_canon", filed=filed), "facts")


#: Facts, contexts and units with dangling references, for the raw joins.
RAW_JOIN_SQL = """
f AS (SELECT o_orderkey % 97 AS filing_id, o_custkey AS context_id, o_orderkey % 5000 AS unit_id FROM orders),
c AS (SELECT DISTINCT o_orderkey % 97 AS filing_id, c_custkey AS context_id, c_acctbal AS acctbal FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 3 <> 0),
u AS (SELECT DISTINCT o_orderkey % 97 AS filing_id, p_partkey AS unit_id, p_brand AS brand FROM orders JOIN part ON o_orderkey % 5000 = p_partkey)
"""
