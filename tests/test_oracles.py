"""Every registered query with a SQL oracle against DuckDB, and the rest for
running, at sf0.001 (the driver repeats this at sf0.01)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF001

TABLES = ["events", "documents", "benchmark", "labels", "conversations"]
QUERIES = {k: f for k, f in entry.queries().items() if f.__module__.startswith("topictone.") and ".llm." not in f.__module__}
ORACLES = {k: sql for k, sql in entry.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf, cols):
    return sorted((tuple(_norm(r[c]) for c in cols) for r in pdf.to_dict("records")),
                  key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF001).toPandas()
    want = con.execute(ORACLES[name]).fetchdf()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert len(got) == len(want)
    assert _rows(got, cols) == _rows(want, cols)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF001).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"adj_sentiment", "topic_baseline", "pos_prob"} <= set(df.columns)
