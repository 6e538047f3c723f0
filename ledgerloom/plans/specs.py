"""The metric library: inputs by name, and formulas over them."""

from __future__ import annotations

# Concepts, in order of priority.
REVENUE = ("us-gaap_Revenues", "us-gaap_RevenueFromContractWithCustomerExcludingAssessedTax", "us-gaap_SalesRevenueNet")
COGS = ("us-gaap_CostOfGoodsSold", "us-gaap_CostOfGoodsAndServicesSold", "us-gaap_CostOfRevenue")
CASH_FLOW = ("us-gaap_NetCashProvidedByUsedInOperatingActivities", "us-gaap_NetCashProvidedByUsedInOperatingActivitiesContinuingOperations")
CAPEX = ("us-gaap_PaymentsToAcquirePropertyPlantAndEquipment", "us-gaap_PaymentsToAcquireProductiveAssets")
NET_INCOME = ("us-gaap_NetIncomeLoss",)
OPERATING_INCOME = ("us-gaap_OperatingIncomeLoss",)
CASH = ("us-gaap_CashAndCashEquivalentsAtCarryingValue",)
INVESTMENTS = ("us-gaap_ShortTermInvestments",)
RECEIVABLES = ("us-gaap_AccountsReceivableNetCurrent",)
INVENTORY = ("us-gaap_InventoryNet",)
ASSETS, ASSETS_CURRENT, ASSETS_NONCURRENT = ("us-gaap_Assets",), ("us-gaap_AssetsCurrent",), ("us-gaap_AssetsNoncurrent",)
LIABILITIES, LIABILITIES_CURRENT, LIABILITIES_NONCURRENT = ("us-gaap_Liabilities",), ("us-gaap_LiabilitiesCurrent",), ("us-gaap_LiabilitiesNoncurrent",)
EQUITY = ("us-gaap_StockholdersEquity",)
LIABILITIES_AND_EQUITY = ("us-gaap_LiabilitiesAndStockholdersEquity",)

FLOW, POINT, YEAR, QUARTER = ("FY", "Q", "YTD"), ("ASOF",), ("FY",), ("Q",)
CURRENT, PRIOR_YEAR = "current", "prior_year_same_period"
THIS_QUARTER, LAST_QUARTER = "current_quarter", "previous_quarter"
END, LAST_END = "current_period_end_asof", "prior_year_period_end_asof"


class Spec:
    """A metric: `inputs` maps names, in the order in which they are resolved, to (concepts, selector)."""

    def __init__(self, name: str, unit: str, periods: tuple, inputs: dict, formula: tuple):
        self.name, self.unit, self.periods, self.formula = name, unit, periods, formula
        self.inputs = {k: v if isinstance(v[0], tuple) else (v, CURRENT) for k, v in inputs.items()}


def ratio(a, b) -> tuple:
    return ("divide", a, b)


def growth(now: str, then: str) -> tuple:
    return ("divide", ("subtract", now, then), ("abs", then))


def _growth(name: str, what: tuple, noun: str, quarterly: bool) -> Spec:
    if quarterly:
        now, then, pair = f"current_quarter_{noun}", f"previous_quarter_{noun}", (THIS_QUARTER, LAST_QUARTER)
    else:
        now, then, pair = f"current_{noun}", f"prior_{noun}", (CURRENT, PRIOR_YEAR)
    return Spec(name, "pure", QUARTER if quarterly else FLOW, {now: (what, pair[0]), then: (what, pair[1])}, growth(now, then))


def _ends(noun: str, what: tuple) -> dict:
    return {f"ending_{noun}": (what, END), f"beginning_{noun}": (what, LAST_END)}


def _mean(noun: str) -> tuple:
    return ("average", f"ending_{noun}", f"beginning_{noun}")


SPECS = [
    Spec("current_ratio", "pure", POINT, {"assets_current": ASSETS_CURRENT, "liabilities_current": LIABILITIES_CURRENT}, ratio("assets_current", "liabilities_current")),
    Spec("quick_assets", "usd", POINT, {"cash": CASH, "short_term_investments": INVESTMENTS, "accounts_receivable": RECEIVABLES}, ("sum", "cash", "short_term_investments", "accounts_receivable")),
    Spec("quick_ratio", "pure", POINT, {"cash": CASH, "short_term_investments": INVESTMENTS, "accounts_receivable": RECEIVABLES, "liabilities_current": LIABILITIES_CURRENT}, ratio(("sum", "cash", "short_term_investments", "accounts_receivable"), "liabilities_current")),
    Spec("cash_ratio", "pure", POINT, {"cash": CASH, "liabilities_current": LIABILITIES_CURRENT}, ratio("cash", "liabilities_current")),
    Spec("working_capital", "usd", POINT, {"assets_current": ASSETS_CURRENT, "liabilities_current": LIABILITIES_CURRENT}, ("subtract", "assets_current", "liabilities_current")),
    Spec("gross_profit", "usd", FLOW, {"revenue": REVENUE, "cogs": COGS}, ("subtract", "revenue", "cogs")),
    Spec("gross_margin", "pure", FLOW, {"revenue": REVENUE, "cogs": COGS}, ratio(("subtract", "revenue", "cogs"), "revenue")),
    Spec("operating_margin", "pure", FLOW, {"operating_income": OPERATING_INCOME, "revenue": REVENUE}, ratio("operating_income", "revenue")),
    Spec("net_margin", "pure", FLOW, {"net_income": NET_INCOME, "revenue": REVENUE}, ratio("net_income", "revenue")),
    Spec("debt_to_equity", "pure", POINT, {"liabilities": LIABILITIES, "equity": EQUITY}, ratio("liabilities", "equity")),
    Spec("debt_ratio", "pure", POINT, {"liabilities": LIABILITIES, "assets": ASSETS}, ratio("liabilities", "assets")),
    Spec("equity_ratio", "pure", POINT, {"equity": EQUITY, "assets": ASSETS}, ratio("equity", "assets")),
    Spec("current_assets_rollup", "usd", POINT, {"cash": CASH, "short_term_investments": INVESTMENTS, "accounts_receivable": RECEIVABLES, "inventory": INVENTORY}, ("rollup", ASSETS_CURRENT, "cash", "short_term_investments", "accounts_receivable", "inventory")),
    Spec("total_assets_rollup", "usd", POINT, {"assets_current": ASSETS_CURRENT, "assets_noncurrent": ASSETS_NONCURRENT}, ("rollup", ASSETS, "assets_current", "assets_noncurrent")),
    Spec("total_liabilities_rollup", "usd", POINT, {"liabilities_current": LIABILITIES_CURRENT, "liabilities_noncurrent": LIABILITIES_NONCURRENT}, ("rollup", LIABILITIES, "liabilities_current", "liabilities_noncurrent")),
    Spec("liabilities_and_equity_rollup", "usd", POINT, {"liabilities": LIABILITIES, "equity": EQUITY}, ("rollup", LIABILITIES_AND_EQUITY, "liabilities", "equity")),
    _growth("yoy_revenue_growth", REVENUE, "revenue", False),
    _growth("yoy_net_income_growth", NET_INCOME, "net_income", False),
    _growth("qoq_revenue_growth", REVENUE, "revenue", True),
    _growth("qoq_net_income_growth", NET_INCOME, "net_income", True),
    Spec("operating_cash_flow_margin", "pure", FLOW, {"operating_cash_flow": CASH_FLOW, "revenue": REVENUE}, ratio("operating_cash_flow", "revenue")),
    Spec("free_cash_flow", "usd", FLOW, {"operating_cash_flow": CASH_FLOW, "capital_expenditures": CAPEX}, ("subtract", "operating_cash_flow", "capital_expenditures")),
    Spec("free_cash_flow_margin", "pure", FLOW, {"operating_cash_flow": CASH_FLOW, "capital_expenditures": CAPEX, "revenue": REVENUE}, ratio(("subtract", "operating_cash_flow", "capital_expenditures"), "revenue")),
    Spec("quality_of_earnings_ratio", "pure", FLOW, {"operating_cash_flow": CASH_FLOW, "net_income": NET_INCOME}, ratio("operating_cash_flow", "net_income")),
    Spec("cfo_minus_net_income", "usd", FLOW, {"operating_cash_flow": CASH_FLOW, "net_income": NET_INCOME}, ("subtract", "operating_cash_flow", "net_income")),
    Spec("roa", "pure", YEAR, {"net_income": NET_INCOME, **_ends("assets", ASSETS)}, ratio("net_income", _mean("assets"))),
    Spec("roe", "pure", YEAR, {"net_income": NET_INCOME, **_ends("equity", EQUITY)}, ratio("net_income", _mean("equity"))),
    Spec("asset_turnover", "pure", YEAR, {"revenue": REVENUE, **_ends("assets", ASSETS)}, ratio("revenue", _mean("assets"))),
    Spec("equity_multiplier", "pure", YEAR, {**_ends("assets", ASSETS), **_ends("equity", EQUITY)}, ratio(_mean("assets"), _mean("equity"))),
]
