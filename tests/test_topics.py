"""Topic baseline and adjustment: exact vectors, an independent row loop,
and properties."""

import random

import pytest
from pyspark.sql import functions as F

from topictone.config import LABELS_ZH, TopicConfig
from topictone.operators.report import topic_report, transition_matrix
from topictone.operators.scorers import ColumnScorer
from topictone.operators.topics import adjust, adjustment_columns, topic_baselines
from topictone.plans.topic_analysis import analyze_topics

# (b, p) -> (factor, q, class) worked out by hand from the rule.
VECTORS = [
    (.7, 0, .3, .3, "negative"), (.7, .1, .27, .37, "negative"),
    (.7, .15, .255, .405, "neutral"), (.7, .39, .183, .573, "neutral"),
    (.7, .4, 0, .4, "neutral"), (.7, .6, 0, .6, "neutral"), (.7, .61, 0, .61, "positive"),
    (.3, .6, 0, .6, "neutral"), (.3, .61, .183, .427, "neutral"), (.3, .8, .24, .56, "neutral"),
    (.3, .86, .258, .602, "positive"), (.3, 1, .3, .7, "positive"),
    (.6, .1, 0, .1, "negative"), (.4, .9, 0, .9, "positive"),
]


def _key(t):
    return tuple((x is None, str(x)) for x in t)


def reference_loop(b, p, cfg=TopicConfig()):
    """The rule written as a plain row loop (independent of the Spark code)."""
    if b > cfg.hi:
        factor = cfg.strength * (1 - p) if p < cfg.lo else 0.0
        q = p + factor
    elif b < cfg.lo:
        factor = cfg.strength * p if p > cfg.hi else 0.0
        q = p - factor
    else:
        factor, q = 0.0, p
    cls = "positive" if q > cfg.hi else "negative" if q < cfg.lo else "neutral"
    abs_cls = "positive" if p > 0.5 else "negative"
    conf = p if p > 0.5 else 1 - p
    return factor, q, cls, abs_cls, conf


def test_vectors(spark):
    df = spark.createDataFrame([(float(b), float(p)) for b, p, *_ in VECTORS],
                               "topic_baseline double, pos_prob double")
    cols = adjustment_columns()
    rows = df.select("topic_baseline", "pos_prob", cols["adj_factor"].alias("f"),
                     cols["adj_pos_prob"].alias("q"), cols["adj_sentiment"].alias("c")).collect()
    for r, (b, p, f, q, c) in zip(rows, VECTORS):
        assert r["f"] == pytest.approx(f, abs=1e-12), (b, p)
        assert r["q"] == pytest.approx(q, abs=1e-12), (b, p)
        assert r["c"] == c, (b, p)


def test_against_row_loop(spark):
    rnd = random.Random(7)
    rows = [(float(rnd.choice([.35, .39, .4, .5, .6, .61, .7, .2, .9])), round(rnd.random(), 4))
            for _ in range(3000)]
    rows += [(b, p) for b in (.4, .6, .5, .61, .39) for p in (0.0, .4, .5, .6, 1.0, 1 / 7, 6 / 7)]
    df = spark.createDataFrame(rows, "topic_baseline double, pos_prob double")
    cols = adjustment_columns()
    got = df.select("topic_baseline", "pos_prob", *[v.alias(k) for k, v in cols.items()]).collect()
    for r in got:
        f, q, c, a, conf = reference_loop(r["topic_baseline"], r["pos_prob"])
        assert r["adj_factor"] == f and r["adj_pos_prob"] == q
        assert r["adj_sentiment"] == c and r["abs_sentiment"] == a
        assert r["abs_confidence"] == conf


def _topics_fixture(spark):
    # one positive, one negative, one neutral topic, a single-row topic, a NULL
    # topic, and baselines of exactly 0.4 and 0.6.
    rows = []
    rows += [("pos", i, p) for i, p in enumerate([.9, .8, .95, .1, .3, .7])]
    rows += [("neg", 100 + i, p) for i, p in enumerate([.1, .2, .05, .9, .7, .3])]
    rows += [("mid", 200 + i, p) for i, p in enumerate([.5, .45, .55])]
    rows += [("one", 300, .2)]
    rows += [(None, 400 + i, p) for i, p in enumerate([.9, .9, .2])]
    rows += [("b04", 500 + i, p) for i, p in enumerate([.2, .6])]
    rows += [("b06", 600 + i, p) for i, p in enumerate([.8, .4])]
    return spark.createDataFrame(rows, "topic string, id bigint, p double")


def test_baselines_and_edges(spark):
    df = _topics_fixture(spark)
    an = analyze_topics(df, ColumnScorer("p"), None, ["topic"], "id")
    bl = {r["topic"]: r for r in an.baselines.collect()}
    assert bl["b04"]["baseline"] == 0.4 and bl["b04"]["polarity"] == "neutral"
    assert bl["b06"]["baseline"] == 0.6 and bl["b06"]["polarity"] == "neutral"
    assert bl["pos"]["polarity"] == "positive" and bl["neg"]["polarity"] == "negative"
    assert bl[None]["n"] == 3 and bl["one"]["n"] == 1 and bl["one"]["low_support"]
    res = an.result.collect()
    assert len(res) == df.count()
    for r in res:
        assert r["adj_factor"] >= 0
        if r["topic_baseline"] > .6:
            assert r["adj_sentiment"] != "positive" or r["pos_prob"] > .6
        if r["topic_baseline"] < .4:
            assert r["adj_sentiment"] != "negative" or r["pos_prob"] < .4
        if .4 <= r["topic_baseline"] <= .6:
            assert r["adj_factor"] == 0
    null_rows = [r for r in res if r["topic"] is None]
    assert len(null_rows) == 3 and all(r["topic_baseline"] == pytest.approx(2 / 3, abs=1e-9)
                                       for r in null_rows)


def test_empty_input_has_no_topics(spark):
    df = spark.createDataFrame([], "topic string, id bigint, p double")
    an = analyze_topics(df, ColumnScorer("p"), None, ["topic"], "id")
    assert an.baselines.count() == 0 and an.result.count() == 0
    an = analyze_topics(df, ColumnScorer("p"), None, [], "id")
    assert an.baselines.count() == 0 and an.result.count() == 0


def test_partition_count_does_not_matter(spark):
    rnd = random.Random(3)
    rows = [(f"t{rnd.randrange(40)}", i, round(rnd.random(), 4)) for i in range(4000)]
    base = spark.createDataFrame(rows, "topic string, id bigint, p double")
    outs = []
    for n in (1, 7, 64):
        an = analyze_topics(base.repartition(n), ColumnScorer("p"), None, ["topic"], "id")
        outs.append(sorted(tuple(r) for r in an.result.collect()))
    assert outs[0] == outs[1] == outs[2]


def test_topic_by_topic_equals_combined(spark):
    df = _topics_fixture(spark).filter(F.col("topic").isNotNull())
    combined = sorted(tuple(r) for r in
                      analyze_topics(df, ColumnScorer("p"), None, ["topic"], "id").result.collect())
    single = []
    for t in ("pos", "neg", "mid", "one", "b04", "b06"):
        part = df.filter(F.col("topic") == t)
        single += [tuple(r) for r in
                   analyze_topics(part, ColumnScorer("p"), None, [], "id").result.collect()]
    assert combined == sorted(single)


def test_salted_join_matches_broadcast(spark):
    """Forcing the size check to fail takes the salted shuffle path; the
    result must be identical, including for a topic with most of the rows."""
    from topictone.config import JoinConfig
    rnd = random.Random(11)
    rows = [("hot" if i % 3 else f"t{i % 17}", i, round(rnd.random(), 4)) for i in range(3000)]
    rows += [(None, 10_000 + i, .9) for i in range(5)]
    df = spark.createDataFrame(rows, "topic string, id bigint, p double")
    scored = ColumnScorer("p").score(df, None)
    bl = topic_baselines(scored, ["topic"])
    a = sorted((tuple(r) for r in adjust(scored, bl, ["topic"]).collect()), key=_key)
    tiny = JoinConfig(broadcast_max_rows=0, broadcast_max_bytes=0)
    b_df = adjust(scored, bl, ["topic"], join_cfg=tiny)
    plan = b_df._jdf.queryExecution().executedPlan().toString()
    assert "__tt_salt" in plan
    b = sorted((tuple(r) for r in b_df.collect()), key=_key)
    assert a == b


def test_report_and_transitions(spark):
    df = _topics_fixture(spark)
    an = analyze_topics(df, ColumnScorer("p"), None, ["topic"], "id")
    rep = {r["topic"]: r for r in topic_report(an.result, ["topic"]).collect()}
    for r in rep.values():
        assert r["adj_pos"] + r["adj_neg"] + r["adj_neutral"] == r["n"]
        assert r["orig_pos"] + r["orig_neg"] == r["n"]
    assert rep["mid"]["effect"] is None
    assert rep["pos"]["effect"] <= 0          # a shifted comment never becomes positive
    from topictone.operators.report import report_display
    shown = {r["topic"]: r for r in report_display(topic_report(an.result, ["topic"]), ["topic"]).collect()}
    assert shown["b04"]["baseline"] == "0.4000" and shown["one"]["orig_neg_share"] == "100.00%"
    tm = transition_matrix(an.result, ["topic"]).collect()
    assert sum(r["n"] for r in tm) == df.count()


def test_chinese_labels(spark):
    cfg = TopicConfig(labels=LABELS_ZH)
    df = _topics_fixture(spark)
    an = analyze_topics(df, ColumnScorer("p"), None, ["topic"], "id", cfg)
    assert {r["adj_sentiment"] for r in an.result.collect()} <= {"积极", "消极", "中性"}


def test_output_name_clash_raises(spark):
    df = spark.createDataFrame([("a", 1, .5, .1)], "topic string, id bigint, p double, adj_factor double")
    with pytest.raises(ValueError, match="adj_factor"):
        analyze_topics(df, ColumnScorer("p"), None, ["topic"], "id")


def test_blank_in_the_middle_does_not_shift_results(spark):
    """Each score stays on its own row; blanks are dropped, not misaligned."""
    from topictone.operators.nb import fit_nb
    train = spark.createDataFrame([("good nice", 1), ("great good", 1), ("bad awful", 0),
                                   ("awful terrible", 0)], "text string, label int")
    model = fit_nb(train, "text", "label")
    rows = [(1, "good nice", "a"), (2, "   ", "a"), (3, None, "a"), (4, "awful bad", "a"),
            (5, "great", "a")]
    df = spark.createDataFrame(rows, "id bigint, text string, topic string")
    res = {r["id"]: r for r in analyze_topics(df, model, "text", ["topic"], "id").result.collect()}
    assert set(res) == {1, 4, 5}
    assert res[1]["pos_prob"] > .5 and res[4]["pos_prob"] < .5 and res[5]["pos_prob"] > .5
    alone = model.score(df.filter("id = 4"), "text", "id").first()["pos_prob"]
    assert res[4]["pos_prob"] == alone
    kept = analyze_topics(df, model, "text", ["topic"], "id", keep_invalid=True).result
    k = {r["id"]: r for r in kept.collect()}
    assert set(k) == {1, 2, 3, 4, 5} and k[2]["adj_sentiment"] is None and k[3]["pos_prob"] is None


def test_salted_join_spreads_a_hot_topic(spark):
    """A topic with two thirds of the rows is split over several reduce
    partitions by the salted join (AQE off so partitions are not merged)."""
    from topictone.config import JoinConfig
    rows = [("hot" if i % 3 else f"t{i % 50}", i, (i % 100) / 100) for i in range(6000)]
    df = spark.createDataFrame(rows, "topic string, id bigint, p double").repartition(4)
    scored = ColumnScorer("p").score(df, None)
    bl = topic_baselines(scored, ["topic"])
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = adjust(scored, bl, ["topic"], join_cfg=JoinConfig(0, 0))
        parts = (out.filter(F.col("topic") == "hot")
                 .select(F.spark_partition_id().alias("pid")).distinct().count())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert parts >= 4        # ceil(2/3 * 8) = 6 salts over 8 shuffle partitions


def test_unkeyed_table_with_nb_scorer(spark):
    """Without a key column the result is the same as with one, and carries
    no generated column."""
    from topictone.operators.nb import fit_nb
    train = spark.createDataFrame([("good nice", 1), ("great good", 1), ("bad awful", 0),
                                   ("awful terrible", 0)], "text string, label int")
    model = fit_nb(train, "text", "label")
    rows = [(i, t, f"s{i % 2}") for i, t in enumerate(["good", "bad", "nice great", "awful",
                                                         "good bad", "  ", "terrible"])]
    df = spark.createDataFrame(rows, "id bigint, text string, topic string")
    keyed = analyze_topics(df, model, "text", ["topic"], "id").result
    unkeyed = analyze_topics(df, model, "text", ["topic"]).result
    assert unkeyed.columns == keyed.columns
    assert sorted(map(tuple, unkeyed.collect())) == sorted(map(tuple, keyed.collect()))


def _nb(spark):
    from topictone.operators.nb import fit_nb
    train = spark.createDataFrame([("good nice", 1), ("great good", 1), ("bad awful", 0), ("awful terrible", 0)], "text string, label int")
    return fit_nb(train, "text", "label")


@pytest.mark.parametrize("rows", [
    [(1, "good", "a"), (1, "bad", "b")],          # one key in two topics
    [(2, "good", "a"), (2, "bad", "a")],          # one key twice in a topic
    [(None, "good", "a"), (3, "bad", "a")],       # no key
])
def test_keys_that_cannot_be_told_apart_raise(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, text string, topic string")
    with pytest.raises(ValueError, match="not unique"):
        analyze_topics(df, _nb(spark), "text", ["topic"], "id")
    with pytest.raises(ValueError, match="not unique"):
        _nb(spark).score(df, "text", "id")


def test_composite_key(spark):
    df = spark.createDataFrame([(1, 1, "good", "a"), (1, 2, "bad", "b"), (2, 1, "awful", "a")], "c bigint, t bigint, text string, topic string")
    got = {(r.c, r.t): r.pos_prob for r in analyze_topics(df, _nb(spark), "text", ["topic"], ["c", "t"]).result.collect()}
    assert got[1, 1] > 0.5 > got[1, 2] and got[2, 1] < 0.5


def test_null_probability_has_no_class(spark):
    df = spark.createDataFrame([(1, "a", 0.9), (2, "a", None), (3, "b", None)], "id bigint, topic string, p double")
    an = analyze_topics(df, ColumnScorer("p"), None, ["topic"])
    rows = {r.id: r for r in an.result.collect()}
    assert rows[1].topic_baseline == 0.9 and len(rows) == 3
    assert rows[2].abs_sentiment is None and rows[2].adj_sentiment is None and rows[2].topic_baseline == 0.9
    assert rows[3].topic_baseline is None and rows[3].adj_sentiment is None
    report = {r.topic: r for r in an.report().collect()}
    assert report["a"].n == 1 and report["b"].n == 0 and report["b"].adj_pos_share is None


def test_absent_hot_and_null_keys_are_spread(spark):
    """Keys that the small table does not hold are split as well (AQE off)."""
    from topictone.config import JoinConfig
    from topictone.operators.joins import attach
    rows = [(None if i % 2 else "absent" if i % 5 else f"k{i % 50}", i) for i in range(8000)]
    big = spark.createDataFrame(rows, "key string, id bigint").repartition(4)
    small = spark.createDataFrame([(f"k{i}", i) for i in range(50)], "key string, v int")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = attach(big, small, ["key"], how="left", cfg=JoinConfig(0, 0))
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        again = attach(big.repartition(7), small, ["key"], how="left", cfg=JoinConfig(0, 0))
        assert sorted(map(str, out.collect())) == sorted(map(str, again.collect())) and out.count() == 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert max(sizes) < 3 * 8000 / 8


def test_accuracy_of_no_rows(spark):
    from topictone.operators.predict import accuracy
    row = accuracy(spark.createDataFrame([], "a int, b int"), "a", "b").first()
    assert row["n"] == 0 and row["accuracy"] is None
