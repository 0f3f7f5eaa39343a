"""Scorers: naive Bayes against a brute-force Python version, the hashed
Spark ML pipeline, split and encoding."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from topictone.config import TokenConfig
from topictone.operators.encode import build_vocabulary, encode_fixed
from topictone.operators.hashed import fit_hashed
from topictone.operators.nb import NBModel, fit_nb
from topictone.operators.predict import accuracy, predict
from topictone.operators.prep import assign_split, split_sizes

TRAIN = [("房间很好 服务 good", 1), ("很好 下次 还来", 1), ("great stay good bed", 1),
         ("nice clean room", 1), ("好 好 好", 1), ("friendly staff good", 1),
         ("super 很好", 1), ("clean and quiet", 1), ("good value", 1), ("推荐 很好", 1),
         ("太差 了 dirty", 0), ("bad service 差", 0), ("dirty room bad", 0), ("noisy bad", 0),
         ("差 差", 0), ("never again", 0), ("rude staff bad", 0), ("terrible 太差", 0),
         ("smelly room", 0), ("broken 差", 0)]


def tok(t):
    return re.findall(r"[一-鿿]|[^\W_一-鿿]+", (t or "").lower())


def brute_nb(train, texts):
    n = {0: Counter(), 1: Counter()}
    rows = Counter()
    for t, y in train:
        n[y].update(tok(t))
        rows[y] += 1
    vocab = set(n[0]) | set(n[1])
    s0, s1, v = sum(n[0].values()), sum(n[1].values()), len(vocab)
    k = {w: round((math.log((n[1][w] + 1) / (s1 + v)) - math.log((n[0][w] + 1) / (s0 + v))) * 1e6)
         for w in vocab}
    prior = round(math.log(rows[1] / rows[0]) * 1e6)
    out = []
    for t in texts:
        z = prior + sum(k.get(w, 0) for w in tok(t))
        x = max(-30.0, min(30.0, z / 1e6))
        out.append((z, round(1 / (1 + math.exp(-x)), 4)))
    return out


def test_nb_matches_brute_force(spark):
    train = spark.createDataFrame(TRAIN, "text string, label int")
    model = fit_nb(train, "text", "label")
    texts = ["很好 good", "bad 差 dirty", "", None, "unknownword", "好 " * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = {r["id"]: (r["nb_z"], r["pos_prob"]) for r in
           model.score(df, "text", "id", keep_z=True).collect()}
    want = brute_nb(TRAIN, texts)
    for i in range(len(texts)):
        assert got[i][0] == want[i][0]
        assert got[i][1] == pytest.approx(want[i][1], abs=1e-4)
    # without a key column a key is generated, and results are the same
    nokey = model.score(df.select("text"), "text").collect()
    assert sorted(r["pos_prob"] for r in nokey) == sorted(v[1] for v in got.values())


def test_nb_one_class_raises(spark):
    one = spark.createDataFrame([(t, 1) for t, _ in TRAIN[:5]], "text string, label int")
    with pytest.raises(ValueError, match="both classes"):
        fit_nb(one, "text", "label")


def test_nb_save_load(spark, tmp_dir):
    train = spark.createDataFrame(TRAIN, "text string, label int")
    model = fit_nb(train, "text", "label", normalise="mean")
    model.save(tmp_dir + "/m")
    back = NBModel.load(spark, tmp_dir + "/m")
    df = spark.createDataFrame([(1, "很好"), (2, "bad")], "id bigint, text string")
    a = sorted(tuple(r) for r in model.score(df, "text", "id").collect())
    b = sorted(tuple(r) for r in back.score(df, "text", "id").collect())
    assert a == b and back.normalise == "mean"


def test_predict_keeps_each_rows_confidence(spark):
    train = spark.createDataFrame(TRAIN, "text string, label int")
    model = fit_nb(train, "text", "label")
    df = spark.createDataFrame([(1, "很好 good great"), (2, "bad 差 dirty"), (3, "   ")],
                               "id bigint, text string")
    rows = {r["id"]: r for r in predict(df, model, "text", "id", keep_prob=True).collect()}
    assert rows[1]["label"] == 1 and rows[2]["label"] == 0
    for r in rows.values():    # every row gets its own confidence
        p = r["pos_prob"]
        assert r["confidence"] == pytest.approx(p if p > .5 else 1 - p, abs=1e-9)
    assert 3 in rows            # blanks are scored in plain prediction


def test_hashed_pipeline_and_no_exchange(spark, tmp_dir):
    data = spark.createDataFrame(TRAIN * 3, "text string, label int")
    fit = fit_hashed(data, data, "text", "label", num_features=1 << 10, reg_grid=(0.0, 0.1),
                     max_iter=20)
    assert fit.grid.filter("chosen").count() == 1
    gold = data.withColumnRenamed("label", "gold")
    scored = predict(gold, fit.model, "text", None, keep_prob=True)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert accuracy(scored, "gold", "label").first()["accuracy"] > 0.8
    fit.model.save(tmp_dir + "/h")
    from topictone.operators.hashed import HashedModel
    back = HashedModel.load(tmp_dir + "/h")
    assert back.score(data, "text").count() == data.count()


def test_split_is_deterministic_and_keyed(spark):
    rows = [(i, f"text {i % 300}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    a = assign_split(df, ["text"], text_col="text")
    b = assign_split(df.repartition(13), ["text"], text_col="text")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    # exact copies of a text land in one split
    per_text = a.groupBy("text").agg(F.countDistinct("split").alias("k"))
    assert per_text.filter("k > 1").count() == 0
    sizes = {r["split"]: r["n"] for r in split_sizes(a).collect()}
    assert set(sizes) == {"train", "eval", "test"} and sum(sizes.values()) == 3000


def test_encoding(spark):
    df = spark.createDataFrame([(1, "a b c a"), (2, ""), (3, "a zz " * 100)], "id bigint, text string")
    vocab = build_vocabulary(df, "text", vocab_size=2, min_count=1)
    v = {r["token"]: r["id"] for r in vocab.collect()}
    assert v == {"a": 2, "zz": 3}
    enc = {r["id"]: r for r in encode_fixed(df, vocab, "text", "id", token_cfg=TokenConfig(8),
                                             vocab_size=2).collect()}
    assert enc[1]["input_ids"] == [2, 1, 1, 2, 0, 0, 0, 0]
    assert enc[1]["attention_mask"] == [1, 1, 1, 1, 0, 0, 0, 0]
    assert enc[2]["input_ids"] == [0] * 8 and enc[2]["n_real"] == 0
    assert enc[3]["input_ids"] == [2, 3] * 4


def test_nb_salted_weight_join_matches_broadcast(spark):
    """Past the broadcast limits the weights are joined by a shuffle salted on
    frequent tokens; scores must not change."""
    from topictone.config import JoinConfig
    train = spark.createDataFrame(TRAIN, "text string, label int")
    model = fit_nb(train, "text", "label")
    tiny = fit_nb(train, "text", "label", join_cfg=JoinConfig(0, 0))
    texts = [(i, t) for i, (t, _) in enumerate(TRAIN * 5)] + [(999, ""), (1000, None)]
    df = spark.createDataFrame(texts, "id bigint, text string")
    a = sorted(tuple(r) for r in model.score(df, "text", "id", keep_z=True).collect())
    scored = tiny.score(df, "text", "id", keep_z=True)
    assert "__tt_salt" in tiny.logits(df, "text", "id")._jdf.queryExecution().executedPlan().toString()
    b = sorted(tuple(r) for r in scored.collect())
    assert a == b


def test_nb_min_count_vocabulary(spark):
    """Tokens below min_count leave the model; the rest is NB over the kept
    vocabulary (checked against the brute-force version on pruned texts)."""
    train = spark.createDataFrame(TRAIN, "text string, label int")
    model = fit_nb(train, "text", "label", min_count=2)
    kept = {r["token"] for r in model.weights.collect()}
    counts = Counter(w for t, _ in TRAIN for w in tok(t))
    assert kept == {w for w, c in counts.items() if c >= 2}
    pruned = [(" ".join(w for w in tok(t) if w in kept), y) for t, y in TRAIN]
    texts = ["很好 good", "bad 差 dirty", "unknownword"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = {r["id"]: r["nb_z"] for r in model.score(df, "text", "id", keep_z=True).collect()}
    want = brute_nb(pruned, [" ".join(w for w in tok(t) if w in kept) for t in texts])
    assert [got[i] for i in range(3)] == [z for z, _ in want]


def test_nb_beyond_the_broadcast_limits_is_exact(spark):
    """Broadcast head + joined tail, and nothing broadcast at all, give the scores
    of the plain path, texts without known tokens included."""
    from topictone.config import JoinConfig
    train = spark.createDataFrame([(f"good w{i} nice", 1) for i in range(40)] + [(f"bad v{i} awful", 0) for i in range(40)],
                                  "text string, label int")
    model = fit_nb(train, "text", "label")
    df = spark.createDataFrame([(1, "good w1 w1 bad"), (2, "unknown words only"), (3, None), (4, ""), (5, "v3 nice " * 50)],
                               "id bigint, text string")
    want = sorted(map(tuple, model.score(df, "text", "id", keep_z=True).collect()), key=str)
    for rows in (0, 3, 50):
        small = NBModel(model.weights, model.prior, model.vocab, join_cfg=JoinConfig(rows, 1 << 20 if rows else 0))
        assert sorted(map(tuple, small.score(df, "text", "id", keep_z=True).collect()), key=str) == want


def test_a_broadcast_token_is_not_moved_by_token(spark):
    train = spark.createDataFrame(TRAIN, "text string, label int")
    model = fit_nb(train, "text", "label")
    df = spark.createDataFrame([(1, "good bad")], "id bigint, text string")
    plan = model.logits(df, "text", "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(token" not in plan


def test_models_are_not_overwritten_unasked(spark, tmp_dir):
    train = spark.createDataFrame(TRAIN, "text string, label int")
    model = fit_nb(train, "text", "label")
    model.save(tmp_dir + "/m")
    with pytest.raises(Exception, match="(?i)exist"):
        model.save(tmp_dir + "/m")
    model.save(tmp_dir + "/m", overwrite=True)


def test_fit_hashed_without_eval_rows(spark):
    train = spark.createDataFrame(TRAIN, "text string, label int")
    fit = fit_hashed(train, train.limit(0), "text", "label", num_features=64, reg_grid=(0.0, 0.1), max_iter=3)
    assert fit.grid.filter("chosen").first()["reg_param"] == 0.0


def test_vocabulary_ties_at_the_cut(spark):
    df = spark.createDataFrame([("a a a b b c c d d e",)], "text string")
    got = [(r.token, r.id) for r in build_vocabulary(df, "text", vocab_size=3).orderBy("id").collect()]
    assert got == [("a", 2), ("b", 3), ("c", 4)]


def test_encoding_raises_on_a_repeated_key(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "c d e")], "id bigint, text string")
    vocab = build_vocabulary(df, "text", vocab_size=5)
    with pytest.raises(Exception, match="not unique"):
        encode_fixed(df, vocab, "text", "id", token_cfg=TokenConfig(max_length=4), vocab_size=5).collect()
