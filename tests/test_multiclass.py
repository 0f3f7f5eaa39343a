"""n-class naive Bayes and softmax against plain Python."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from topictone.config import JoinConfig
from topictone.functions.labels import log_sum_exp, softmax
from topictone.operators.multiclass import fit_classes
from topictone.operators.nb import fit_nb

TRAIN = [("red red apple", "fruit"), ("green apple pear", "fruit"), ("fast red car", "car"), ("car engine", "car"),
         ("sun rain wind", "weather"), ("rain rain rain", "weather"), ("", "car"), (None, "fruit"), ("not learnt", None), ("nor this", "other")]
TEXTS = ["red car", "rain apple rain", "pear", "unknown words only", "", None, "red " * 5000, "Rain RAIN"]
CLASSES = ["car", "fruit", "weather"]


def _brute():
    rows = [(t or "", c) for t, c in TRAIN if c in CLASSES]
    counts = {c: Counter(w for t, k in rows if k == c for w in t.lower().split()) for c in CLASSES}
    vocab = set().union(*counts.values())
    k = {w: [round(math.log((counts[c][w] + 1) / (sum(counts[c].values()) + len(vocab))) * 1e6) for c in CLASSES] for w in vocab}
    priors = [round(math.log(sum(x == c for _, x in rows) / len(rows)) * 1e6) for c in CLASSES]
    out = {}
    for i, t in enumerate(TEXTS):
        z = [p + sum(k[w][j] for w in (t or "").lower().split() if w in k) for j, p in enumerate(priors)]
        e = [math.exp((x - max(z)) / 1e6) for x in z]
        out[i] = (CLASSES[z.index(max(z))], [x / sum(e) for x in e])
    return out


@pytest.mark.parametrize("cfg", [JoinConfig(), JoinConfig(0, 0)])
def test_scores_equal_plain_python(spark, cfg):
    train = spark.createDataFrame(TRAIN, "text string, name string").repartition(5)
    model = fit_classes(train, "text", "name", classes=CLASSES, join_cfg=cfg)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").withColumn("k", F.lit("kept"))
    want = _brute()
    got = {r.id: r for r in model.score(df, "text", "id").collect()}
    assert sorted(got) == sorted(want)
    for i, (name, probs) in want.items():
        assert got[i]["class"] == name and got[i].k == "kept"
        assert got[i].probs == pytest.approx(probs, abs=6e-5) and got[i].confidence == max(got[i].probs)


def test_ties_edges_and_errors(spark):
    train = spark.createDataFrame([("a", 3), ("b", 1), ("c", 2)], "text string, label int")
    model = fit_classes(train, "text", "label")
    assert model.classes == [1, 2, 3]
    df = spark.createDataFrame([(1, "zzz"), (2, "a"), (3, None)], "id int, text string")
    assert {r.id: r["class"] for r in model.score(df, "text", "id").collect()} == {1: 1, 2: 3, 3: 1}   # a tie: the first
    assert model.score(df.limit(0), "text", "id").count() == 0
    with pytest.raises(ValueError, match="not unique"):
        model.score(df.unionAll(df), "text", "id")
    with pytest.raises(ValueError, match="class"):
        fit_classes(train, "text", "label", classes=[1, 9])
    with pytest.raises(ValueError, match="classes"):
        fit_classes(train.filter("label = 1"), "text", "label")


def test_two_classes_agree_with_the_binary_model(spark):
    rows = [(f"w{i % 7} w{i % 5} {'good' if i % 3 else 'bad'}", int(i % 3 > 0)) for i in range(60)]
    train = spark.createDataFrame(rows, "text string, label int")
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "id int, text string")
    p2 = {r.id: r.pos_prob for r in fit_nb(train, "text", "label").score(df, "text", "id").collect()}
    pn = {r.id: r.probs[1] for r in fit_classes(train, "text", "label").score(df, "text", "id").collect()}
    assert all(abs(p2[i] - pn[i]) < 2e-4 for i in p2)


def test_softmax(spark):
    rows = [([0.0, 0.0],), ([1000.0, 999.0, -5000.0],), ([-800.0, -801.0],), ([3.0],), ([],), (None,)]
    got = spark.createDataFrame(rows, "z array<double>").select(softmax("z").alias("p"), log_sum_exp("z").alias("l")).collect()
    s = 1 / (1 + math.exp(-1))
    assert got[0].p == [0.5, 0.5] and got[1].p == pytest.approx([s, 1 - s, 0]) and got[2].p == pytest.approx([s, 1 - s])
    assert got[3].p == [1.0] and got[4].p == [] and got[5].p is None
    assert got[0].l == pytest.approx(math.log(2)) and got[1].l == pytest.approx(1000 + math.log(1 + math.exp(-1))) and got[4].l is None


def test_packed_sums_move_a_row_per_chunk_and_token(spark):
    """Plain sums, with empty and null texts, unknown tokens and repeated rows; the join
    sees each token of a chunk once, however many texts hold it."""
    from pyspark.sql import functions as F

    from topictone.functions.text import tokens
    from topictone.operators.packed import packed_sums

    rows = [(i, "x", " ".join(f"w{(i * j) % 17}" for j in range(i % 9))) for i in range(300)] + [(7, "x", None), (None, None, "w1 w1 new")]
    df = spark.createDataFrame(rows, "id long, `odd name` string, text string").repartition(3)
    weights = spark.createDataFrame([(f"w{j}", [j, -10**12 * j]) for j in range(17)], "token string, k array<bigint>")
    seen = []

    def weigh(pairs):
        seen.append((pairs.count(), pairs.select("__tt_chunk").distinct().count()))
        return pairs.join(weights, "token")

    got = packed_sums(df, tokens(F.col("text")), 2, weigh).collect()
    count = lambda t: [int(w[1:]) for w in (t or "").split() if w != "new"]
    want = [(i, s, [sum(count(t)), -10**12 * sum(count(t))], len((t or "").split())) for i, s, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert seen[0][1] == 3 and seen[0][0] <= 3 * 17 + 1
