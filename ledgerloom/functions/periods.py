"""Fiscal periods as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days (exclusive) of a year, a quarter and the two year-to-date spans.
YEAR, QUARTER, HALF, THREE_QUARTERS = (330, 370), (80, 110), (170, 205), (260, 300)


def strict_date(text: Column) -> Column:
    """A date only from yyyy-mm-dd; anything else is null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def add_months_keeping_end(day: Column, months: Column | int) -> Column:
    """The last day of a month moves to the last day of the other month."""
    moved = F.add_months(day, months)
    return F.when(day == F.last_day(day), F.last_day(moved)).otherwise(moved)


def shift_year(day: Column, years: int) -> Column:
    """The same day in another year; 29 February becomes 28."""
    return F.add_months(day, 12 * years)


def _key(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def _within(days: Column, band: tuple[int, int]) -> Column:
    return days.between(*band)


def calendar_quarter_end(day: Column) -> Column:
    """1 to 4 where the day ends a calendar quarter."""
    return F.when((day == F.last_day(day)) & (F.month(day) % 3 == 0), F.quarter(day))


def raw_period_key(start: Column, end: Column, instant: Column) -> Column:
    """The key by calendar alone, as on contexts."""
    days = F.datediff(end, start)
    span = (
        F.when(_within(days, YEAR), F.concat(F.lit("FY"), F.year(end)))
        .when(_within(days, QUARTER) & calendar_quarter_end(end).isNotNull(), F.concat(F.lit("Q"), F.quarter(end), F.lit("_"), F.year(end)))
        .otherwise(F.concat(F.lit("DUR_"), _key(start), F.lit("_"), _key(end)))
    )
    return F.when(instant.isNotNull(), F.concat(F.lit("ASOF_"), _key(instant))).when(start.isNotNull() & end.isNotNull(), span).otherwise(F.lit("UNKNOWN_PERIOD"))


def focus_quarter(focus: Column) -> Column:
    upper = F.upper(focus)
    return F.when(upper == "FY", F.lit(4)).when(upper.rlike("^Q[1-4]$"), F.try_element_at(F.split(upper, ""), F.lit(2)).try_cast("int"))


def fiscal_year_end(report_date: Column, focus: Column) -> Column:
    """The end of the fiscal year that the report's focus implies."""
    upper = F.upper(focus)
    ahead = F.when(upper.isin("FY", "Q4"), 0).when(upper == "Q3", 3).when(upper == "Q2", 6).when(upper == "Q1", 9)
    return F.when(ahead.isNotNull(), add_months_keeping_end(report_date, ahead.cast("int")))


def classified(df: DataFrame, start: str, end: str, instant: str, report_date: str, year_focus: str, focus: str) -> DataFrame:
    """Add period_type, period_key, period_start, period_end, fiscal_year, fiscal_quarter and is_ytd.

    Step by step, so that no expression holds copies of the ones before.
    """
    start, end, instant, report, year_focus, focus = (F.col(c) for c in (start, end, instant, report_date, year_focus, focus))
    col = F.col
    df = df.withColumn("_at", F.coalesce(instant, end)).withColumn("_year_end", fiscal_year_end(report, focus))
    # half-even, as the rule for fiscal years is; a zero year counts as unknown
    past = F.when(col("_at") <= report, F.nullif((year_focus - F.bround(F.datediff(report, col("_at")) / F.lit(364.25), 0)).cast("int"), F.lit(0)))
    before = F.month(col("_at")) * 100 + F.dayofmonth(col("_at")) <= F.month(col("_year_end")) * 100 + F.dayofmonth(col("_year_end"))
    by_end = F.when(col("_year_end").isNotNull(), F.when(before, F.year(col("_at"))).otherwise(F.year(col("_at")) + 1))
    df = df.withColumn("_inferred", F.coalesce(past, by_end))
    df = df.withColumn("_month", F.make_date(col("_inferred"), F.month(col("_year_end")), F.lit(1)))
    df = df.withColumn("_q4", F.date_add(col("_month"), F.least(F.dayofmonth(col("_year_end")), F.dayofmonth(F.last_day(col("_month")))) - 1))
    for q, months in ((1, -9), (2, -6), (3, -3), (4, 0)):
        df = df.withColumn(f"_end{q}", add_months_keeping_end(col("_q4"), months))
    inferred = F.coalesce(*[F.when(col("_at") == col(f"_end{q}"), F.lit(q)) for q in (1, 2, 3, 4)])
    same_day = (F.month(end) == F.month(report)) & (F.dayofmonth(end) == F.dayofmonth(report))
    by_focus = F.when(instant.isNotNull() | same_day, focus_quarter(focus))
    df = df.withColumn("_quarter", F.coalesce(inferred, by_focus, calendar_quarter_end(col("_at"))))
    df = df.withColumn("_days", F.datediff(end, start)).withColumn("_year", F.coalesce(col("_inferred"), F.year(col("_at"))))
    days = col("_days")
    kind = (
        F.when(instant.isNotNull(), "ASOF").when(start.isNull() | end.isNull(), "DUR_OTHER").when(_within(days, YEAR), "FY").when(_within(days, QUARTER), "Q")
        .when(_within(days, HALF) | _within(days, THREE_QUARTERS), "YTD").otherwise("DUR_OTHER")
    )
    df = df.withColumn("period_type", kind)
    kind, known = col("period_type"), instant.isNotNull() | (start.isNotNull() & end.isNotNull())
    by_kind = F.when(kind == "FY", 4).when(kind == "Q", F.coalesce(col("_quarter"), F.lit(1))).when(kind == "YTD", F.coalesce(col("_quarter"), F.when(days <= HALF[1], 2).otherwise(3)))
    df = df.withColumn("fiscal_quarter", F.when(known, F.coalesce(by_kind, col("_quarter"))).cast("int"))
    df = df.withColumn("fiscal_year", F.when(known, col("_year")).otherwise(F.year(end)).cast("int"))
    named = F.concat(F.when(kind == "YTD", "YTD_Q").otherwise("Q"), col("fiscal_quarter"), F.lit("_"), col("fiscal_year"))
    key = (
        F.when(kind == "ASOF", F.concat(F.lit("ASOF_"), _key(instant))).when(~known, "UNKNOWN_PERIOD").when(kind == "FY", F.concat(F.lit("FY"), col("fiscal_year")))
        .when(kind == "DUR_OTHER", F.concat(F.lit("DUR_"), _key(start), F.lit("_"), _key(end))).otherwise(named)
    )
    df = df.withColumn("period_key", key).withColumn("period_start", F.coalesce(instant, start)).withColumn("period_end", F.coalesce(instant, end)).withColumn("is_ytd", kind == "YTD")
    return df.drop("_at", "_year_end", "_inferred", "_month", "_q4", "_end1", "_end2", "_end3", "_end4", "_quarter", "_days", "_year")
