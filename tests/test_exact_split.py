"""Splits of exact sizes against a sort on the driver."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from topictone.operators import exact_split as E
from topictone.operators.exact_split import assign_exact_split, exact_sizes


def _order(text, label):
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    return md5(f"42:{text or ''}") + md5(f"{str(text is None).lower()}:{label if label is not None else ''}")


def _brute(rows):
    train, ev, _ = exact_sizes(len(rows))
    ranked = sorted(rows, key=lambda r: _order(*r))
    return Counter((t, n, "train" if i < train else "eval" if i < train + ev else "test") for i, (t, n) in enumerate(ranked))


@pytest.mark.parametrize("n, want", [(0, (0, 0, 0)), (1, (0, 0, 1)), (2, (1, 0, 1)), (10, (7, 1, 2)), (1000, (700, 150, 150)), (10**12, (7 * 10**11, 15 * 10**10, 15 * 10**10))])
def test_sizes(n, want):
    assert exact_sizes(n) == want


HOT = [("same", 1)] * 700
ROWS = {
    "plain": [(f"text {i}", i % 2) for i in range(1000)],
    "hot": HOT + [(f"t{i}", i % 3) for i in range(301)],                       # equal rows around an end
    "one": [("x", 0)] * 997,                                                  # both ends inside one value
    "labels": [("same", i % 5) for i in range(400)] + [("same", None)] * 50,  # equal keys, other columns differ
    "nulls": [(None, 0)] * 120 + [("", 0)] * 110 + [(f"w{i}", None) for i in range(170)],
    "two": [("a", 1), ("b", 0)],
}


@pytest.mark.parametrize("name, few, parts", [*((name, 4096, 5) for name in sorted(ROWS)), ("hot", 2, 1), ("labels", 2, 1)])
def test_equal_to_a_sort(spark, monkeypatch, name, few, parts):
    monkeypatch.setattr(E, "FEW", few)
    df = spark.createDataFrame(ROWS[name], "text string, label int").repartition(parts)
    got = Counter((r.text, r.label, r.split) for r in assign_exact_split(df, ["text"]).collect())
    assert got == _brute(ROWS[name])


def test_empty_dropped_and_other_columns(spark):
    schema = "text string, label int, m map<string,int>, s struct<a:int,b:string>"
    assert assign_exact_split(spark.createDataFrame([], "text string, label int"), ["text"]).count() == 0
    rows = [(None if i % 4 == 0 else f"t{i}", i, None, (i, "x")) for i in range(100)]
    out = assign_exact_split(spark.createDataFrame(rows, schema), ["text"], tie_cols=["label"], text_col="text")
    assert out.columns == ["text", "label", "m", "s", "split"] and out.count() == 75
    whole = assign_exact_split(spark.createDataFrame(rows, schema), ["text"], tie_cols=["label"])
    assert {r["split"]: r["count"] for r in whole.groupBy("split").count().collect()} == {"train": 70, "eval": 15, "test": 15}


def test_no_sort_no_window_and_one_pass(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("text"))
    plan = assign_exact_split(df, ["text"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "Exchange" not in plan and plan.count("Range") == 1
