"""Multi-line CSV cut into small splits against Spark's own one-task reader."""

import io
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topictone.sources.comments import read_comments
from topictone.sources.csv_records import LineState, csv_records

SPLIT = "spark.sql.files.maxPartitionBytes"
OPEN_COST = "spark.sql.files.openCostInBytes"


@pytest.fixture
def small_splits(spark):
    held = {c: spark.conf.get(c) for c in (SPLIT, OPEN_COST)}
    spark.conf.set(OPEN_COST, "1")

    def cut(size):
        spark.conf.set(SPLIT, str(size))
    yield cut
    for c, v in held.items():
        spark.conf.set(c, v)


def one_task(spark, path, names):
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return (spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
            .option("enforceSchema", False).csv(path))


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def field(rng):
    kind = rng.randrange(8)
    body = "".join(rng.choice(["a", "b ", ",", "\n", '""', "é", "数", "\r\n", "x", " "]) for _ in range(rng.randrange(0, 12)))
    if kind < 4:
        return '"' + body + '"'
    plain = body.replace('""', 'q"q').replace(",", ";").replace("\n", "").replace("\r", "")
    return plain if not plain.startswith('"') else "p" + plain


def text_of(rng, n, end):
    return "id,评论,c" + end + "".join(f"{i},{field(rng)},{field(rng)}{end}" + (end if rng.random() < 0.1 else "") for i in range(n))


@pytest.mark.parametrize("seed,end,size", [(1, "\n", 17), (2, "\r\n", 40), (3, "\n", 90), (4, "\r\n", 100_000)])
def test_rows_are_those_of_one_task(spark, tmp_path, small_splits, seed, end, size):
    """LF files as by Spark's reader; CRLF files as by pandas, which leaves a CRLF inside
    quotes as it is (Spark's makes it LF)."""
    rng = random.Random(seed)
    files = [text_of(rng, 12, end).encode() for _ in range(2)]
    for k, data in enumerate(files):
        (tmp_path / f"f{k}.csv").write_bytes(data)
    small_splits(size)
    got = read_comments(spark, str(tmp_path), "评论", na_values=None)
    assert got.columns == ["id", "评论", "c"]
    assert got.rdd.getNumPartitions() > 8 or size > 100
    if end == "\n":
        assert rows(got) == rows(one_task(spark, str(tmp_path), got.columns))
    want = pd.concat([pd.read_csv(io.BytesIO(x), dtype=str, keep_default_na=False) for x in files])
    assert sorted(tuple(x or "" for x in r) for r in got.collect()) == sorted(map(tuple, want.to_numpy()))


def test_bom_unclosed_quote_short_and_long_rows(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_bytes('﻿"评论",b\n"x\ny",1\nonly\n1,2,3\n\n"never closed,\nmore'.encode())
    small_splits(15)
    got = read_comments(spark, str(tmp_path), "评论", na_values=None)
    assert got.columns == ["评论", "b"]
    assert rows(got) == rows(one_task(spark, str(tmp_path), ["评论", "b"]))


def test_header_over_several_lines_and_splits(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_bytes('"评\n论","b ""c"""\n1,"2\n3"\n'.encode())
    small_splits(9)
    got = read_comments(spark, str(tmp_path), "评\n论")
    assert got.columns == ["评\n论", 'b "c"'] and [tuple(r) for r in got.collect()] == [("1", "2\n3")]


def test_other_headers_raise_and_no_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("评论,b\n1,2\n")
    (tmp_path / "b.csv").write_text("b,评论\n1,2\n")
    with pytest.raises(ValueError, match="different headers"):
        read_comments(spark, str(tmp_path))
    with pytest.raises(ValueError, match="available columns"):
        read_comments(spark, str(tmp_path / "a.csv"), "text")
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "c.csv").write_text("评论,b\n")
    assert read_comments(spark, str(tmp_path / "c")).collect() == []
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "d.csv").write_text("")
    with pytest.raises(ValueError, match="available columns"):
        read_comments(spark, str(tmp_path / "d"))


def test_partition_folders(spark, tmp_path, small_splits):
    df = spark.createDataFrame([(i, f"line {i}\n\"quoted\", {i}", "ab"[i % 2]) for i in range(40)], "id int, `评论` string, k string")
    path = str(tmp_path / "out")
    df.write.partitionBy("k").option("header", True).option("escape", '"').csv(path)
    small_splits(150)
    got = read_comments(spark, path)
    assert sorted(map(tuple, got.select(F.col("id").cast("int"), "评论", "k").collect())) == sorted(map(tuple, df.collect()))


def test_a_megabyte_record_over_many_splits(spark, tmp_path, small_splits):
    long = "line, \"\" of text\n" * 60_000
    (tmp_path / "a.csv").write_text(f'评论,b\nx,1\n"{long}",2\ny,3\n')
    small_splits(100_000)
    records, _ = csv_records(spark, str(tmp_path))
    assert sorted(r["n"] for r in records.select(F.length("record").alias("n")).collect()) == [3, 3, len(long) + 4]
    got = read_comments(spark, str(tmp_path)).filter("b = 2").first()["评论"]
    assert got == long.replace('""', '"')


def test_line_states():
    s = LineState(",")
    outside = {b"": False, b"a,b": False, b'"a,b': True, b'"a",b': False, b'"a""': True, b'"a"""': False, b'a"b,c': False, b'"a"b,c': False,
               b'"a"b"c,d': False, b'x,"': True, b'x,""': False, b'x, "y': False, b'"a",,"': True}
    assert {k: s.ends_open(k, False) for k in outside} == outside
    inside = {b"": True, b"a,b": True, b'a",b': False, b'a""b': True, b'"': False, b'",': False, b'","': True, b'x"y,z': False, b'""': True, b'"""': False}
    assert {k: s.ends_open(k, True) for k in inside} == inside
