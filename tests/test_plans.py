"""Physical plan checks: the shapes the design relies on at scale."""

from topictone.operators.scorers import ColumnScorer
from topictone.plans.queries import event_probability, events_input
from topictone.plans.topic_analysis import analyze_topics

from conftest import SF01


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_topic_analysis_plan(spark):
    an = analyze_topics(events_input(spark, SF01), ColumnScorer(event_probability()), None,
                        ["user_id"])
    plan = _plan(an.result)
    assert "SinglePartition" not in plan
    assert "Window" not in plan
    assert "BroadcastHashJoin" in plan
    # column pruning reaches the scan
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>" in plan


def test_baseline_aggregation_is_partial(spark):
    from topictone.operators.topics import topic_baselines
    scored = ColumnScorer(event_probability()).score(events_input(spark, SF01), None)
    plan = _plan(topic_baselines(scored, ["user_id"]))
    assert "partial_sum" in plan and "partial_count" in plan


def test_filter_pushdown(spark):
    from pyspark.sql import functions as F
    from topictone.sources.comments import read_table
    df = read_table(spark, SF01, "events").filter(F.col("user_id") == 7).select("event_id")
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,7)]" in plan


def test_nb_scoring_shuffles_only_keys_and_sums(spark):
    from pyspark.sql import functions as F
    from topictone.config import TokenConfig
    from topictone.operators.nb import fit_nb
    from topictone.sources.comments import read_table
    docs = read_table(spark, SF01, "documents").select("doc_id", "text")
    labs = read_table(spark, SF01, "labels").select("doc_id", F.col("quality").alias("label"))
    model = fit_nb(labs.join(docs, "doc_id"), "text", "label", token_cfg=TokenConfig())
    plan = _plan(model.logits(docs, "text", "doc_id"))
    assert "BroadcastHashJoin" in plan             # weights measured and small
    assert plan.count("partial_sum") == 1          # map-side per-text sum


def test_nb_topic_analysis_materialises_scores_without_text(spark):
    from pyspark.sql import functions as F
    from topictone.config import TokenConfig
    from topictone.operators.nb import fit_nb
    from topictone.sources.comments import read_table
    docs = read_table(spark, SF01, "documents").select("doc_id", "source", "text")
    labs = read_table(spark, SF01, "labels").select("doc_id", F.col("quality").alias("label"))
    model = fit_nb(labs.join(docs, "doc_id"), "text", "label", token_cfg=TokenConfig())
    an = analyze_topics(docs, model, "text", ["source"], key_col="doc_id")
    plan = _plan(an.result)
    # the comments are scanned once; the scores come from a small table
    assert "ReadSchema: struct<doc_id:bigint,pos_prob:double>" in plan
    assert "Window" not in plan and "SinglePartition" not in plan


def test_spread_moves_small_tables_only(spark, tmp_dir):
    from topictone.session import spread
    from topictone.sources.comments import read_table
    one_file = read_table(spark, SF01, "documents")
    assert "RoundRobinPartitioning" in _plan(spread(one_file.select("text")))
    many = spark.range(0, 4000).selectExpr("id", "cast(id as string) AS text").repartition(64)
    many.write.parquet(tmp_dir + "/many")
    df = spark.read.parquet(tmp_dir + "/many")
    assert "RoundRobinPartitioning" not in _plan(spread(df))
    stream = spark.readStream.schema(df.schema).parquet(tmp_dir + "/many")
    assert spread(stream) is stream
    # one splittable file that is enough scan splits for every slot is not moved
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        assert "RoundRobinPartitioning" not in _plan(spread(one_file.select("text")))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_training_scores_once(spark, tmp_dir, monkeypatch):
    """Both variants and all splits come from one pass of token sums."""
    from topictone.operators.nb import NBModel
    from topictone.plans.training import train
    calls = []
    plain = NBModel.logits
    monkeypatch.setattr(NBModel, "logits", lambda self, *a, **k: (calls.append(1), plain(self, *a, **k))[1])
    data = spark.createDataFrame([(f"good {i}", 1) for i in range(60)] + [(f"bad {i}", 0) for i in range(60)], "text string, label int")
    trained = train(data, kind="nb")
    assert len(calls) == 1 and sum(r["n"] for r in trained.metrics.collect()) == 120
