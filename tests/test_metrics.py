"""The metric engine on three small filings of one issuer, against figures worked out by hand."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import canonical_decimal, parse_number, parse_number_uk
from ledgerloom.operators.selection import canonical_facts, with_periods
from ledgerloom.plans import metrics
from ledgerloom.schemas import FACTS, FILINGS

D = date.fromisoformat
FILED = [("acme-20241231", "ACME", D("2024-12-31"), 2024, "FY"), ("acme-20250331", "ACME", D("2025-03-31"), 2025, "Q1"), ("acme-20250630", "ACME", D("2025-06-30"), 2025, "Q2")]
CONTEXTS = {
    "fy24": ("2024-01-01", "2024-12-31"), "e23": "2023-12-31", "e24": "2024-12-31", "q1": ("2025-01-01", "2025-03-31"), "e1": "2025-03-31",
    "q2": ("2025-04-01", "2025-06-30"), "y2": ("2025-01-01", "2025-06-30"), "p2": ("2024-04-01", "2024-06-30"), "e2": "2025-06-30",
}
VALUES = {
    "acme-20241231": {
        "fy24": {"Revenues": 1000, "CostOfGoodsSold": 400, "NetIncomeLoss": 150, "NetCashProvidedByUsedInOperatingActivities": 210, "PaymentsToAcquirePropertyPlantAndEquipment": 80},
        "e23": {"Assets": 1200, "StockholdersEquity": 550}, "e24": {"Assets": 1500, "StockholdersEquity": 700, "AssetsCurrent": 600, "LiabilitiesCurrent": 300},
    },
    "acme-20250331": {"q1": {"Revenues": 260, "NetIncomeLoss": 42}},
    "acme-20250630": {
        "q2": {"Revenues": 310, "CostOfGoodsSold": 135, "NetIncomeLoss": 55, "NetCashProvidedByUsedInOperatingActivities": 75}, "y2": {"Revenues": 570}, "p2": {"Revenues": 260, "NetIncomeLoss": 44},
        "e2": {"AssetsCurrent": 680, "AssetsNoncurrent": 980, "LiabilitiesCurrent": 340, "CashAndCashEquivalentsAtCarryingValue": 220, "ShortTermInvestments": 70, "AccountsReceivableNetCurrent": 180, "InventoryNet": 210},
    },
}


@pytest.fixture(scope="module")
def parts(spark):
    from decimal import Decimal

    rows = []
    for filing, contexts in VALUES.items():
        for context, facts in contexts.items():
            at = CONTEXTS[context]
            days = (None, None, D(at)) if isinstance(at, str) else (D(at[0]), D(at[1]), None)
            for name, value in facts.items():
                n = len(rows)
                rows.append((filing, "ACME", f"f{n}", n, "main.htm", f"a{n}", f"us-gaap_{name}", "numeric", "usd", Decimal(value), None, context, 0, *days))
    n = len(rows)
    rows.append(("acme-20250630", "ACME", f"f{n}", n, "main.htm", f"a{n}", "us-gaap_InventoryNet", "numeric", "usd", Decimal(215), None, "e2", 0, None, None, D("2025-06-30")))
    rows.append(("acme-20241231", "ACME", f"f{n + 1}", n + 1, "main.htm", f"a{n + 1}", "us-gaap_Revenues", "numeric", "usd", Decimal(320), None, "seg", 1, D("2024-01-01"), D("2024-12-31"), None))
    facts = with_periods(spark.createDataFrame(rows, FACTS), spark.createDataFrame(FILED, FILINGS))
    canon, found = canonical_facts(facts)
    edges = spark.createDataFrame([("acme-20250630", "us-gaap_Assets", c, 1.0) for c in ("us-gaap_AssetsCurrent", "us-gaap_AssetsNoncurrent")], "filing_id string, parent string, child string, weight double")
    out = {(r.metric, r.filing_id, r.period_key): r for r in metrics.answers(canon, edges).collect()}
    return canon, found, out


@pytest.mark.parametrize(
    "metric, filing, period, value",
    [
        ("current_ratio", "acme-20250630", "ASOF_20250630", 2), ("yoy_revenue_growth", "acme-20250630", "Q2_2025", 0.192308), ("qoq_revenue_growth", "acme-20250630", "Q2_2025", 0.192308),
        ("operating_cash_flow_margin", "acme-20250630", "Q2_2025", 0.241935), ("free_cash_flow", "acme-20241231", "FY2024", 130), ("quality_of_earnings_ratio", "acme-20241231", "FY2024", 1.4),
        ("roa", "acme-20241231", "FY2024", 0.111111), ("equity_multiplier", "acme-20241231", "FY2024", 2.16), ("yoy_net_income_growth", "acme-20250630", "Q2_2025", 0.25),
        ("qoq_net_income_growth", "acme-20250630", "Q2_2025", 0.309524), ("total_assets_rollup", "acme-20250630", "ASOF_20250630", 1660),
    ],
)
def test_golden(parts, metric, filing, period, value):
    row = parts[2][metric, filing, period]
    assert row.status == "OK" and row.value == pytest.approx(value, abs=1e-6)


def test_conflict_refuses_and_is_reported(parts):
    canon, found, out = parts
    assert out["current_assets_rollup", "acme-20250630", "ASOF_20250630"].refusal_code == "MISSING_INPUT"
    codes = {(r.code, r.concept_norm) for r in found.collect()}
    assert {("UNIT_SCALE_MISMATCH", "us-gaap_InventoryNet"), ("CONTEXT_SELECTION_AMBIGUOUS", "us-gaap_InventoryNet")} <= codes
    assert [int(r.value_num) for r in canon.where("concept_norm = 'us-gaap_Revenues' AND period_key = 'FY2024'").collect()] == [1000]


def test_rollup_source(parts):
    assert parts[2]["total_assets_rollup", "acme-20250630", "ASOF_20250630"].rollup_source == "calculation_linkbase"


def test_numbers(spark):
    cases = [("$1,234.50", 1234.5), ("(5)", -5), ("−7", -7), ("N/A", None), ("—", None), ("", None), ("NaN", None), (None, None), (" 1 000 ", 1000)]
    rows = spark.createDataFrame([(a,) for a, _ in cases], "t string").select(parse_number(F.col("t")).alias("v"), canonical_decimal(parse_number(F.col("t"))).alias("c"))
    got = rows.collect()
    assert [None if r.v is None else float(r.v) for r in got] == [b for _, b in cases]
    assert got[0].c == "1234.5" and got[8].c == "1000"
    uk = spark.createDataFrame([("500", "-"), ("(5)", "-"), ("-", None)], "t string, s string").select(parse_number_uk(F.col("t"), F.col("s"), F.lit(False)).alias("v")).collect()
    assert [None if r.v is None else int(r.v) for r in uk] == [-500, -5, None]


def test_periods(spark):
    from ledgerloom.functions.periods import classified

    rows = [
        (None, None, D("2024-02-29"), D("2024-12-31"), 2024, "FY", "ASOF_20240229", 2023), (D("2024-01-01"), D("2024-06-30"), None, D("2024-06-30"), 2024, "Q2", "YTD_Q2_2024", 2024),
        (D("2023-07-01"), D("2024-06-30"), None, D("2024-06-30"), 2024, "FY", "FY2024", 2024), (D("2024-04-01"), D("2024-06-30"), None, D("2024-06-30"), 2024, "FY", "Q4_2024", 2024),
        (D("2024-01-01"), D("2024-01-31"), None, D("2024-12-31"), 2024, "FY", "DUR_20240101_20240131", 2023), (D("2024-01-01"), None, None, D("2024-12-31"), 2024, "FY", "UNKNOWN_PERIOD", None),
    ]
    df = spark.createDataFrame([r[:6] for r in rows], "s date, e date, i date, r date, y int, f string")
    got = classified(df, "s", "e", "i", "r", "y", "f").collect()
    assert [r.period_key for r in got] == [r[6] for r in rows]
    assert [r.fiscal_year for r in got] == [r[7] for r in rows]


def test_extensions(spark):
    from ledgerloom.plans.specs import Spec

    one = F.struct(F.lit(None).cast("string").alias("code"), F.lit(3).cast("decimal(38,6)").alias("value"), F.lit("usd").alias("unit"), F.lit("c").alias("concept"), F.array(F.lit("e")).alias("evidence"))
    term = metrics.compile_formula(("multiply", "a", 2), {"a": one})
    assert Spec and float(spark.range(1).select(term.value.alias("v")).first().v) == 6
