"""Text expressions against Python's own definitions."""

from hypothesis import given, settings
from hypothesis import strategies as st

from topictone.config import TokenConfig
from topictone.functions.text import is_valid_text, null_to_empty, strip_col, tokens

BLANKS = [None, "", "   ", "　", " ", "\t", "\u001c", "\u0085", " ",
          "​", "﻿", " a　", " b ", " c d "]


def test_blanks_match_python(spark):
    df = spark.createDataFrame(list(enumerate(BLANKS)), "id bigint, text string")
    rows = df.select("id", is_valid_text("text").alias("ok"), strip_col("text").alias("s"),
                     null_to_empty("text").alias("e")).orderBy("id").collect()
    for r, t in zip(rows, BLANKS):
        want_ok = isinstance(t, str) and bool(t.strip())
        assert bool(r["ok"]) == want_ok, repr(t)
        assert r["s"] == (t.strip() if t is not None else None), repr(t)
        assert r["e"] == (t if t is not None else "")


def test_every_whitespace_code_point(spark):
    chars = [chr(c) for c in range(0x3001) if chr(c).isspace()] + ["​", "﻿", "x"]
    df = spark.createDataFrame([(i, c + "x" + c) for i, c in enumerate(chars)], "id int, t string")
    got = {r["id"]: r["s"] for r in df.select("id", strip_col("t").alias("s")).collect()}
    for i, c in enumerate(chars):
        assert got[i] == (c + "x" + c).strip(), hex(ord(c))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=("Cs",)),
                        max_size=12), min_size=1, max_size=20))
def test_strip_property(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["id"]: (r["s"], r["ok"]) for r in
           df.select("id", strip_col("t").alias("s"), is_valid_text("t").alias("ok")).collect()}
    for i, t in enumerate(texts):
        assert got[i][0] == t.strip()
        assert bool(got[i][1]) == bool(t.strip())


def test_tokens(spark):
    rows = [(1, "房间很OK！good123 下次"), (2, "！？。，,.!"), (3, None),
            (4, " ".join(f"w{i}" for i in range(300))), (5, "纯中文评论")]
    df = spark.createDataFrame(rows, "id int, text string")
    whole = {r["id"]: r["t"] for r in df.select("id", tokens("text").alias("t")).collect()}
    cut = {r["id"]: r["t"] for r in
           df.select("id", tokens("text", TokenConfig(max_length=128)).alias("t")).collect()}
    assert whole[1] == ["房", "间", "很", "ok", "good123", "下", "次"]
    assert whole[2] == [] and whole[3] == []
    assert len(whole[4]) == 300 and len(cut[4]) == 128 and cut[4][0] == "w0"
    assert whole[5] == list("纯中文评论")


def test_array_helpers(spark):
    from topictone.functions.labels import argmax_index, positive_probability
    df = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.2, 0.8]), (3, [0.7]), (4, [0.9, 0.1])],
                               "id int, probs array<double>")
    got = {r["id"]: (r["a"], r["p"]) for r in df.select(
        "id", argmax_index("probs").alias("a"), positive_probability("probs").alias("p")).collect()}
    assert got[1] == (0, 0.5)      # a tie picks class 0, like numpy's argmax
    assert got[2] == (1, 0.8) and got[3] == (0, 0.7) and got[4] == (0, 0.1)


def test_tokens_of_every_code_point(spark):
    """The pattern that names ASCII first finds what the plain one does."""
    from pyspark.sql import functions as F
    chars = spark.range(1, 0x110000).filter("id NOT BETWEEN 55296 AND 57343").select(
        F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    text = chars.select(F.concat(F.lit("a"), "c", "c", F.lit("7 "), "c", F.lit("_"), "c").alias("t"))
    plain = F.regexp_extract_all("t", F.lit("\\p{IsHan}|[\\p{L}\\p{N}&&[^\\p{IsHan}]]+"), 0)
    row = text.select(F.size(plain).alias("n"), (tokens("t", TokenConfig(lowercase=False, max_length=None)) == plain).alias("same")).agg(
        F.count_if("same").alias("same"), F.count_if(F.col("n") > 2).alias("more")).first()
    assert row["same"] == 0x110000 - 1 - 2048 and row["more"] > 100_000
