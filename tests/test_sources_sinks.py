"""Sources and sinks on hand-made files (CSV, lines)."""

import os

import pytest

from topictone.operators.scorers import ColumnScorer
from topictone.plans.topic_analysis import analyze_topics
from topictone.sinks.writers import output_base, write_report, write_result
from topictone.sources.comments import read_comments, read_labelled_csv, require_column
from topictone.sources.lines import read_lines


def _write(path, data: bytes):
    with open(path, "wb") as f:
        f.write(data)
    return path


def test_read_comments_csv(spark, tmp_dir):
    csv = ('﻿评论,n\n'
           '"很好,\n下次还来",1\n'
           '"他说""不错""",2\n'
           'NA,3\n'
           ',4\n'
           'None,5\n'
           '666,6\n'
           '  ,7\n').encode("utf-8")
    path = _write(os.path.join(tmp_dir, "c.csv"), csv)
    df = read_comments(spark, path)
    assert df.columns == ["评论", "n"]
    rows = {r["n"]: r["评论"] for r in df.collect()}
    assert rows["1"] == "很好,\n下次还来"
    assert rows["2"] == '他说"不错"'
    assert rows["3"] is None and rows["4"] is None and rows["5"] is None
    assert rows["6"] == "666"           # stays text
    assert rows["7"] == "  "            # kept; dropped later as blank
    with pytest.raises(ValueError, match="available columns"):
        read_comments(spark, path, "comment")


def test_require_column(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match=r"\['a'\]"):
        require_column(df, "b")


def test_labelled_csv(spark, tmp_dir):
    path = _write(os.path.join(tmp_dir, "l.csv"), "label,review\n1,好\n0,差\n".encode())
    rows = sorted(tuple(r) for r in read_labelled_csv(spark, path).collect())
    assert rows == [("好", 1), ("差", 0)]


def test_read_lines(spark, tmp_dir):
    data = "a\nb\r\nc\rd\n\n   \n　\n e   f\n".encode("utf-8")
    path = _write(os.path.join(tmp_dir, "lines.txt"), data)
    got = [r["text"] for r in read_lines(spark, path).collect()]
    want = [ln.strip() for ln in data.decode().splitlines() if ln.strip()
            ] if False else ["a", "b", "c", "d", "e   f"]
    assert sorted(got) == sorted(want)
    kept = read_lines(spark, path, drop_blank=False, label=0).collect()
    assert len(kept) == 8 and {r["label"] for r in kept} == {0}
    assert sum(1 for r in kept if r["text"] == "") == 3
    # U+2028 inside a line does not end it (Python's text mode does not either)
    p2 = _write(os.path.join(tmp_dir, "ls.txt"), "a\u2028b\nc\n".encode("utf-8"))
    assert sorted(r["text"] for r in read_lines(spark, p2).collect()) == ["a\u2028b", "c"]


def test_write_result_split_and_bom(spark, tmp_dir):
    df = spark.createDataFrame([("a", i, p) for i, p in enumerate([.9, .1, .5, .8])],
                               "topic string, id bigint, p double")
    res = analyze_topics(df, ColumnScorer("p"), None, ["topic"], "id").result
    paths = write_result(res, tmp_dir, output_base("/x/y/comments.csv"), fmt="csv", bom=True,
                         headers="zh")
    assert paths["all"].endswith("comments_all")
    part = [f for f in os.listdir(paths["all"]) if f.startswith("part-") and f.endswith(".csv")]
    with open(os.path.join(paths["all"], part[0]), "rb") as f:
        head = f.read(64)
    assert head.startswith(b"\xef\xbb\xbf")
    assert "调整后情感分类".encode() in open(os.path.join(paths["all"], part[0]), "rb").read()
    classes = sorted(d for d in os.listdir(paths["by_class"]) if d.startswith("adj_class="))
    back = spark.read.option("header", True).csv(paths["by_class"])
    assert back.count() == 4 and classes
    rep = write_report(res.groupBy("topic").count(), os.path.join(tmp_dir, "report"))
    assert spark.read.json(rep).count() == 1
    with pytest.raises(Exception):
        write_result(res, tmp_dir, "comments")   # errorifexists by default


def test_one_line_csv_and_bom_in_every_part(spark, tmp_dir):
    path = _write(os.path.join(tmp_dir, "one.csv"), "评论,n\n好,1\nNA,2\n差,3\n".encode("utf-8"))
    rows = {r["n"]: r["评论"] for r in read_comments(spark, path, multi_line=False).collect()}
    assert rows == {"1": "好", "2": None, "3": "差"}
    df = spark.createDataFrame([("a", i, .9 if i % 2 else .1) for i in range(40)],
                               "topic string, id bigint, p double").repartition(3)
    res = analyze_topics(df, ColumnScorer("p"), None, ["topic"], "id").result.repartition(3)
    out = write_result(res, os.path.join(tmp_dir, "multi"), "c", fmt="csv", bom=True, split=False)
    parts = [f for f in os.listdir(out["all"]) if f.startswith("part-")]
    assert len(parts) == 3
    for f in parts:
        with open(os.path.join(out["all"], f), "rb") as fh:
            assert fh.read(3) == b"\xef\xbb\xbf"
    back = read_comments(spark, out["all"], "abs_sentiment", na_values=None)
    assert back.count() == 40 and back.columns[0] == "topic"


def test_csv_keeps_white_space_bom_and_name(spark, tmp_dir):
    from topictone.sinks.writers import output_base, write_result
    rows = [(1, "  lead and trail  ", "positive"), (2, "\u3000x\t", "negative")]
    df = spark.createDataFrame(rows, "id bigint, `评论` string, adj_sentiment string")
    paths = write_result(df, tmp_dir, output_base("/in/hotel.csv"), fmt="csv", bom=True)
    assert paths["all"].endswith("/hotel_all") and paths["by_class"].endswith("/hotel_by_class")
    for kind in ("all", "by_class"):
        for multi in (True, False):
            got = read_comments(spark, paths[kind], multi_line=multi).collect()
            assert sorted(r["评论"] for r in got) == sorted(r[1] for r in rows)
    for folder, _, names in os.walk(paths["all"]):
        for n in names:
            if n.endswith(".csv"):
                with open(os.path.join(folder, n), "rb") as f:
                    assert f.read(3) == b"\xef\xbb\xbf"


def test_csv_folder_with_another_header_order_raises(spark, tmp_dir):
    for n, text in (("a.csv", "id,评论\n1,x\n"), ("b.csv", "评论,id\ny,2\n")):
        with open(os.path.join(tmp_dir, n), "w", encoding="utf-8") as f:
            f.write(text)
    with pytest.raises(Exception):
        read_comments(spark, tmp_dir).collect()


def test_intermediate_tables_are_removed_by_their_owner(spark, tmp_dir):
    from topictone.session import owned_tables, path_kind, write_shared
    with owned_tables(spark) as own:
        table = write_shared(spark.range(5), "owned")
        assert table.count() == 5 and path_kind(spark, own[0]) == "folder"
    assert path_kind(spark, own[0]) == "none"


def test_no_silent_local_folder_on_a_cluster(monkeypatch):
    from topictone import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
