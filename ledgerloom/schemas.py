"""Shapes of the engine's tables. Money is decimal(38, 6); dates are dates; nothing is inferred."""

from __future__ import annotations

#: One row for each reported fact, with its context and unit resolved.
FACTS = (
    "filing_id string, ticker string, fact_evidence_id string, fact_ordinal int, source_file string, source_anchor string, concept_norm string, "
    "value_type string, unit_canon string, value_num decimal(38,6), value_text string, context_id string, dimension_count int, "
    "start_date date, end_date date, instant_date date"
)
FILINGS = "filing_id string, ticker string, report_date date, fiscal_year_focus int, fiscal_period_focus string"
#: What canonical selection adds.
PERIOD = "period_type string, period_key string, period_start date, period_end date, fiscal_year int, fiscal_quarter int, is_ytd boolean"
EDGES = "filing_id string, parent string, child string, weight double"

MISSING, AMBIGUOUS, UNITS, PERIODS, ZERO = "MISSING_INPUT", "AMBIGUOUS_CONTEXT", "INCOMPATIBLE_UNITS", "PERIOD_NOT_SUPPORTED", "ZERO_DENOMINATOR"
