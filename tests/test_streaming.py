"""Streaming: file source with availableNow, rejects, restart without
duplicates, stream-static topic adjustment."""

import os

import pytest
from pyspark.sql import functions as F

from topictone.operators.hashed import fit_hashed
from topictone.operators.scorers import ColumnScorer
from topictone.operators.topics import topic_baselines
from topictone.streaming.scoring import adjust_stream, start_scoring_stream

TRAIN = [("good great nice", 1), ("very good", 1), ("nice and clean", 1),
         ("bad awful", 0), ("very bad", 0), ("dirty awful", 0)] * 4


def test_scoring_stream_restart_and_rejects(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    schema = "id bigint, text string"
    spark.createDataFrame([(1, "good"), (2, "bad stay")], schema).write.parquet(src + "/f1")
    data = spark.createDataFrame(TRAIN, "text string, label int")
    model = fit_hashed(data, data, "text", "label", num_features=256, reg_grid=(0.0,), max_iter=10).model
    sink, rej, ckpt = (os.path.join(tmp_dir, k) for k in ("sink", "rej", "ckpt"))

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(src)
        s = start_scoring_stream(stream, model, "text", sink=sink, rejects=rej, checkpoint=ckpt,
                                 source="test")
        s.awaitTermination()

    run()
    assert spark.read.parquet(sink).count() == 2
    # a second file, with invalid rows, arrives; the restart picks up only it
    spark.createDataFrame([(3, "nice"), (4, None), (5, "　 ")], schema).write.parquet(src + "/f2")
    run()
    out = spark.read.parquet(sink)
    assert sorted(r["id"] for r in out.collect()) == [1, 2, 3]
    assert {"scored_at", "reply", "sentiment", "confidence", "source_name"} <= set(out.columns)
    rej_rows = {r["id"]: r["reject_reason"] for r in spark.read.parquet(rej).collect()}
    assert rej_rows == {4: "null text", 5: "blank text"}
    run()   # nothing new: no duplicates
    assert spark.read.parquet(sink).count() == 3


def test_stream_rejects_aggregating_scorer(spark):
    from topictone.operators.nb import NBModel
    nb = NBModel(weights=spark.createDataFrame([], "token string, n0 bigint, n1 bigint, k bigint"),
                 prior=0, vocab=0)
    df = spark.readStream.format("rate").load()
    with pytest.raises(ValueError, match="narrow"):
        adjust_stream(df, None, [], nb)


def test_adjust_stream_equals_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "ev")
    rows = [(i, f"t{i % 4}", round((i * 37 % 100) / 100, 2)) for i in range(200)]
    spark.createDataFrame(rows, "id bigint, topic string, p double").write.parquet(src)
    static = spark.read.parquet(src)
    scorer = ColumnScorer("p")
    published = topic_baselines(scorer.score(static, None), ["topic"])
    published.write.parquet(os.path.join(tmp_dir, "pub"))
    published = spark.read.parquet(os.path.join(tmp_dir, "pub"))
    stream = spark.readStream.schema(static.schema).parquet(src)
    out = adjust_stream(stream, published, ["topic"], scorer)
    q = (out.writeStream.format("parquet").option("checkpointLocation", tmp_dir + "/c")
         .trigger(availableNow=True).start(tmp_dir + "/o"))
    q.awaitTermination()
    from topictone.plans.topic_analysis import analyze_topics
    batch = analyze_topics(static, scorer, None, ["topic"], "id").result
    a = sorted(tuple(r) for r in spark.read.parquet(tmp_dir + "/o").select(*batch.columns).collect())
    assert a == sorted(tuple(r) for r in batch.collect())


def test_event_time_utc_matches_cast_in_utc(spark):
    """Built from fields, the UTC reading of a wall-clock time equals the cast
    done in a UTC session."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    from topictone.streaming.scoring import event_time_utc
    df = spark.createDataFrame([(1,)], "id int").select(
        F.expr("TIMESTAMP_NTZ'2024-03-10 02:30:00.123456'").alias("ts"))
    built = df.select(F.unix_micros(event_time_utc("ts", T.TimestampNTZType(), "America/Los_Angeles")))
    cast = df.select(F.unix_micros(event_time_utc("ts", T.TimestampNTZType(), "UTC")))
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        assert built.first()[0] == cast.first()[0] == 1710037800123456
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


# -- layouts: one file, a folder of unsorted part files, files that arrive later

def _tables(spark, tmp_dir, sf):
    """The same tables as one file each, and as folders of six unsorted parts."""
    import shutil
    parts = os.path.join(tmp_dir, "parts")
    os.makedirs(parts)
    for t in ("events", "documents", "conversations", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").repartition(6).write.parquet(f"{parts}/{t}.parquet")
    one = os.path.join(tmp_dir, "one")
    os.makedirs(one)
    for t in ("events", "documents", "conversations", "labels", "benchmark"):
        shutil.copy(f"{sf}/{t}.parquet", f"{one}/{t}.parquet")
    return one, parts


def _bag(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_streams_do_not_depend_on_the_layout(spark, tmp_dir):
    from conftest import SF001
    from topictone.streaming.queries import STREAM_QUERIES
    one, parts = _tables(spark, tmp_dir, SF001)
    for name in ("stream_event_replies", "stream_topic_adjust", "stream_windowed_baseline", "stream_rejects", "stream_final_windows",
                 "stream_bounded_replies"):
        a, b = _bag(STREAM_QUERIES[name](spark, one)), _bag(STREAM_QUERIES[name](spark, parts))
        assert a == b and a, name
    assert sum(r["n"] for r in STREAM_QUERIES["stream_windowed_baseline"](spark, parts).collect()) == 1000


def test_new_files_continue_windows_and_adjustment(spark, tmp_dir):
    from conftest import SF001
    from topictone.plans.queries import event_probability
    from topictone.streaming.queries import STREAM_QUERIES
    from topictone.streaming.scoring import (latest_windows, start_adjust_stream, start_windowed_stream,
                                             windowed_baselines)
    events = spark.read.parquet(f"{SF001}/events.parquet")
    src, pub = tmp_dir + "/events", tmp_dir + "/pub"
    scorer = ColumnScorer(event_probability())

    def publish(cond):
        topic_baselines(scorer.score(events.filter(cond).select("user_id", "value")), ["user_id"]).write.mode("overwrite").parquet(pub)

    def run():
        stream = spark.readStream.schema(events.schema).parquet(src)
        scored = scorer.score(stream.select("ts", "event_type", "value"))
        # a watermark that covers the backlog: no row is late
        start_windowed_stream(windowed_baselines(scored, "ts", "1 hour", "3650 days", ["event_type"]), sink=tmp_dir + "/w",
                              checkpoint=tmp_dir + "/wc").awaitTermination()
        start_adjust_stream(stream.select("event_id", "user_id", "value"), lambda: spark.read.parquet(pub), ["user_id"], scorer,
                            sink=tmp_dir + "/a", checkpoint=tmp_dir + "/ac").awaitTermination()

    publish("user_id < 0")
    events.filter("event_id % 3 = 0").repartition(2).write.mode("append").parquet(src)
    run()
    publish("true")
    events.filter("event_id % 3 <> 0").repartition(3).write.mode("append").parquet(src)
    run()
    run()
    want = STREAM_QUERIES["stream_windowed_baseline"](spark, SF001)
    assert _bag(latest_windows(spark, tmp_dir + "/w", ["event_type"])) == _bag(want)
    out = spark.read.parquet(tmp_dir + "/a")
    assert out.count() == events.count()
    # the first files met no baseline, the later ones the newly published ones
    assert out.filter("event_id % 3 = 0 AND topic_baseline IS NOT NULL").count() == 0
    assert out.filter("event_id % 3 <> 0 AND topic_baseline IS NULL").count() == 0


def test_adjust_stream_past_the_limits(spark, tmp_dir):
    from topictone.config import JoinConfig
    from topictone.streaming.scoring import start_adjust_stream
    rows = [(i, "hot" if i % 3 else f"t{i % 7}", (i % 100) / 100) for i in range(900)]
    spark.createDataFrame(rows, "id bigint, topic string, p double").write.parquet(tmp_dir + "/in")
    static = spark.read.parquet(tmp_dir + "/in")
    scorer = ColumnScorer("p")
    published = topic_baselines(scorer.score(static), ["topic"]).filter("topic <> 't0'")
    published.write.parquet(tmp_dir + "/pub")
    bags = []
    for n, cfg in enumerate((JoinConfig(), JoinConfig(0, 0))):
        stream = spark.readStream.schema(static.schema).parquet(tmp_dir + "/in")
        start_adjust_stream(stream, lambda: spark.read.parquet(tmp_dir + "/pub"), ["topic"], scorer, join_cfg=cfg,
                            sink=f"{tmp_dir}/s{n}", checkpoint=f"{tmp_dir}/c{n}").awaitTermination()
        bags.append(_bag(spark.read.parquet(f"{tmp_dir}/s{n}")))
    plain = adjust_stream(spark.readStream.schema(static.schema).parquet(tmp_dir + "/in"), spark.read.parquet(tmp_dir + "/pub"),
                          ["topic"], scorer, join_cfg=JoinConfig(0, 0))
    (plain.writeStream.format("parquet").option("checkpointLocation", tmp_dir + "/c9").trigger(availableNow=True)
     .start(tmp_dir + "/s9").awaitTermination())
    assert bags[0] == bags[1] and len(bags[0]) == 900
    assert _bag(spark.read.parquet(tmp_dir + "/s9")) == _bag(spark.read.parquet(tmp_dir + "/s0").drop("batch_id"))


def _events_of(spark, rows):
    return spark.createDataFrame(rows, "id bigint, ts string, kind string, p double").withColumn("ts", F.col("ts").cast("timestamp"))


def _run_windows(spark, tmp_dir, schema, **more):
    from topictone.streaming.final_windows import start_final_windows
    from topictone.streaming.scoring import file_stream
    from topictone.streaming.versions import VersionedTable
    state = VersionedTable(spark, tmp_dir + "/state")
    start_final_windows(ColumnScorer("p").score(file_stream(spark, tmp_dir + "/in", schema, **more)), "ts", "1 hour", "30 minutes", ["kind"],
                        sink=tmp_dir + "/sink", late=tmp_dir + "/late", state=state, checkpoint=tmp_dir + "/ckpt").awaitTermination()
    return state


def test_final_windows_and_late_rows_are_all_events(spark, tmp_dir):
    from topictone.streaming.final_windows import close_windows
    rows = [(1, "2024-01-01 10:10", "a", 0.9), (2, "2024-01-01 10:50", "a", None), (3, "2024-01-01 11:10", "b", 0.2), (4, None, "a", 0.5)]
    df = _events_of(spark, rows)
    df.write.mode("append").parquet(tmp_dir + "/in")
    state = _run_windows(spark, tmp_dir, df.schema)
    assert spark.read.parquet(tmp_dir + "/sink").count() == 0                # watermark 10:40: nothing has ended
    more = [(5, "2024-01-01 10:20", None, 0.7), (6, "2024-01-01 12:40", "a", 0.1), (7, "2024-01-01 11:59", "b", 0.4)]
    _events_of(spark, more).write.mode("append").parquet(tmp_dir + "/in")
    _run_windows(spark, tmp_dir, df.schema)                                  # watermark 12:10 after it
    _events_of(spark, [(8, "2024-01-01 11:30", "b", 0.3), (9, "2024-01-01 12:30", "a", 0.3)]).write.mode("append").parquet(tmp_dir + "/in")
    _run_windows(spark, tmp_dir, df.schema)
    hour = 3600
    start = 1704103200                                                       # 10:00
    got = {(r.window_start, r.kind): (r.n_rows, r.n, r.sum_p4, r.baseline) for r in spark.read.parquet(tmp_dir + "/sink").collect()}
    assert got == {(start, "a"): (2, 1, 9000, 0.9), (start, None): (1, 1, 7000, 0.7), (start + hour, "b"): (2, 2, 6000, 0.3)}
    assert {(r.id, r.late_reason) for r in spark.read.parquet(tmp_dir + "/late").collect()} == {(4, "no event time"), (8, "after its window")}
    close_windows(state, ["kind"], sink=tmp_dir + "/sink")
    final = spark.read.parquet(tmp_dir + "/sink")
    assert final.agg(F.sum("n_rows")).first()[0] + 2 == 9 and final.count() == 4
    assert len(state.versions()) <= 2


def test_a_repeated_batch_writes_the_same_windows(spark, tmp_dir):
    """The stream ends between the state's commit and its own: the batch runs again."""
    import shutil
    from topictone.streaming.final_windows import close_windows
    df = _events_of(spark, [(i, f"2024-01-01 {i % 24:02d}:05", "a", 0.5) for i in range(48)])
    for part in (df.filter("id < 10"), df.filter("id >= 10 AND id < 30"), df.filter("id >= 30")):
        part.coalesce(1).write.mode("append").parquet(tmp_dir + "/in")
        state = _run_windows(spark, tmp_dir, df.schema)
    commits = tmp_dir + "/ckpt/commits"
    last = max(int(x) for x in os.listdir(commits) if x.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{commits}/{name}"):
            shutil.move(f"{commits}/{name}", tmp_dir)
    before = _bag(spark.read.parquet(tmp_dir + "/sink"))
    state = _run_windows(spark, tmp_dir, df.schema)
    assert _bag(spark.read.parquet(tmp_dir + "/sink")) == before
    close_windows(state, ["kind"], sink=tmp_dir + "/sink")
    assert spark.read.parquet(tmp_dir + "/sink").agg(F.sum("n_rows")).first()[0] + spark.read.parquet(tmp_dir + "/late").count() == 48


def test_publishing_merges_new_rows_only(spark, tmp_dir):
    from topictone.streaming.published import newest_baselines, start_publish_stream
    from topictone.streaming.scoring import file_stream, start_adjust_stream
    from topictone.streaming.versions import VersionedTable
    rows = [(i, f"u{i % 3}" if i % 7 else None, (i % 10) / 10) for i in range(90)]
    df = spark.createDataFrame(rows, "id bigint, topic string, p double")
    store, seen = VersionedTable(spark, tmp_dir + "/v"), []
    scorer = ColumnScorer("p")
    read = newest_baselines(store, df, ["topic"])
    assert read()[1] is None and read()[0].columns == ["topic", "baseline"]

    def adjust_new():
        start_adjust_stream(file_stream(spark, tmp_dir + "/in", df.schema), read, ["topic"], scorer, sink=tmp_dir + "/out",
                            checkpoint=tmp_dir + "/ac").awaitTermination()

    df.filter("id < 10").write.mode("append").parquet(tmp_dir + "/in")
    adjust_new()                                   # nothing is published yet
    for low, high in ((0, 10), (10, 50), (50, 90)):
        if low:
            df.filter(f"id >= {low} AND id < {high}").write.mode("append").parquet(tmp_dir + "/in")
        start_publish_stream(file_stream(spark, tmp_dir + "/in", df.schema), scorer, ["topic"], store, checkpoint=tmp_dir + "/pc").awaitTermination()
        adjust_new()
        want = {r.topic: r.baseline for r in topic_baselines(scorer.score(df.filter(f"id < {high}")), ["topic"]).collect()}
        assert {r.topic: r.baseline for r in read()[0].collect()} == want
        seen.append(store.latest())
    assert seen == [0, 1, 2] and store.versions() == [1, 2]
    versions = {r.id: r.baseline_version for r in spark.read.parquet(tmp_dir + "/out").collect()}
    assert versions == {i: None if i < 10 else 1 if i < 50 else 2 for i in range(90)}
    # A version without its mark doesn't count.
    store.write(df.limit(0).select("topic").withColumns({"n": F.lit(0), "sum_p4": F.lit(0)}), 9)
    assert store.latest() == 2


def test_a_backlog_comes_in_bounded_batches(spark, tmp_dir):
    """The same rows in one batch, by files and by bytes."""
    from topictone.streaming.scoring import file_stream
    df = spark.createDataFrame([(i, None if i % 9 == 0 else f"text {i}", i / 100) for i in range(100)], "id bigint, text string, p double")
    df.repartition(10).write.parquet(tmp_dir + "/in")
    size = max(os.path.getsize(os.path.join(tmp_dir, "in", f)) for f in os.listdir(tmp_dir + "/in"))
    bags = []
    for n, more in enumerate(({}, {"max_files": 3}, {"max_bytes": 2 * size + 1})):
        start_scoring_stream(file_stream(spark, tmp_dir + "/in", df.schema, **more), ColumnScorer("p"), "text", sink=f"{tmp_dir}/s{n}",
                             rejects=f"{tmp_dir}/r{n}", checkpoint=f"{tmp_dir}/k{n}").awaitTermination()
        batches = len([x for x in os.listdir(f"{tmp_dir}/s{n}") if x.startswith("batch_id=")])
        assert batches == 1 if not more else batches >= 4
        bags.append([_bag(spark.read.parquet(f"{tmp_dir}/{x}{n}").drop("batch_id", "scored_at")) for x in "sr"])
    assert bags[0] == bags[1] == bags[2] and len(bags[0][0]) == 88 and len(bags[0][1]) == 12
