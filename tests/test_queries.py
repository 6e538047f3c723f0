"""Registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from ledgerloom.plans import corpus_queries, filing_queries, metric_queries, narrative_queries, passage_queries, register_queries, score_queries, task_queries, uk_queries, verification_queries

SF = "/root/testdata/sf0.001"
MODULES = (metric_queries, corpus_queries, filing_queries, narrative_queries, passage_queries, task_queries, uk_queries, register_queries, score_queries, verification_queries)
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}


def canon(frame):
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return ""
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in frame[sorted(frame.columns)].astype(object).values.tolist())


def test_nulls_are_one_whatever_the_type():
    frames = [pd.DataFrame({"a": [None, "x"], "b": pd.array([1, None], "Int64")}), pd.DataFrame({"b": [1.0, float("nan")], "a": pd.array([None, "x"], "string")})]
    assert canon(frames[0]) == canon(frames[1]) == [("", "1.000000"), ("x", "")]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, con, name):
    ours, theirs = entry.queries()[name](spark, SF).toPandas(), con.sql(ORACLE[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canon(ours) == canon(theirs)
