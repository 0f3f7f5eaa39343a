"""The exported weights against the pipeline, and what a broken model looks like."""

import math

import pytest
from pyspark.sql import functions as F

from topictone.operators.hashed import fit_hashed
from topictone.operators.hashed_audit import bucket_weights, log_loss, recomputed_scores, token_buckets, token_features

ROWS = [(i, f"good fine w{i % 9} nice" if i % 2 else f"bad poor w{i % 9} awful {'bad ' * (i % 4)}", i % 2) for i in range(80)] + [(90, None, 1), (91, "", 0)]


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(ROWS, "id bigint, text string, label int")


@pytest.mark.parametrize("features", [1 << 12, 8])
def test_scores_from_exported_weights(spark, data, features):
    model = fit_hashed(data, data, "text", "label", num_features=features, reg_grid=(0.01,), max_iter=10).model
    z = {r["id"]: r["z"] for r in recomputed_scores(model, data, "text", "id").collect()}
    got = {r["id"]: r["pos_prob"] for r in model.score(data, "text").collect()}
    assert len(z) == 82 and all(abs(1 / (1 + math.exp(-z[i])) - got[i]) < 0.00005 + 1e-9 for i in got)
    rows = token_features(model, data, "text", "id").collect()
    assert all(r["bucket_ok"] for r in rows)
    assert {r["token"]: r["df"] for r in rows}["good"] == 40


def test_a_model_without_weights_is_seen(spark, data):
    fitted = fit_hashed(data, data, "text", "label", num_features=256, reg_grid=(0.01,), max_iter=10).model
    zeroed = fit_hashed(data, data, "text", "label", num_features=256, reg_grid=(1e9,), max_iter=10).model
    losses = [log_loss(recomputed_scores(m, data, "text", "id").join(data, "id"), "label") for m in (fitted, zeroed)]
    assert losses[0]["loss"] < 0.9 * losses[0]["constant"] and losses[1]["loss"] > 0.99 * losses[1]["constant"]
    assert losses[0]["n"] == 82 and abs(losses[0]["constant"] - math.log(2)) < 0.01


def test_other_texts_than_the_fitted_ones_are_seen(spark, data):
    """IDF of half the texts doesn't pass for that of all."""
    model = fit_hashed(data.filter("id < 40"), data, "text", "label", num_features=1 << 12, reg_grid=(0.1,), max_iter=3).model
    assert not all(r["bucket_ok"] for r in token_features(model, data, "text", "id").collect())
    assert bucket_weights(spark, model).count() == 1 << 12
    assert token_buckets(model, spark.createDataFrame([("good",), ("bad",)], "token string")).filter(F.col("bucket").between(0, 4095)).count() == 2


def test_recomputing_shuffles_one_sum_per_text(spark, data):
    """Tokens meet the weights where their text is read: no exchange moves a token."""
    model = fit_hashed(data, data, "text", "label", num_features=64, reg_grid=(0.1,), max_iter=3).model
    out = recomputed_scores(model, data, "text", "id")
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and plan.count("Generate") == 0
    assert "token" not in out._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_recomputed_scores_by_a_plain_loop(spark, data, batch):
    """Chunks of any size, texts without tokens, repeated and null keys."""
    model = fit_hashed(data, data, "text", "label", num_features=32, reg_grid=(0.1,), max_iter=3).model
    rows = ROWS + [(200, "", 0), (201, None, 0), (None, "good", 1), (3, "bad bad", 0), (202, "good new 漢字 " * 40, 1)]
    table = spark.createDataFrame(rows, "id bigint, text string, label int")
    words = spark.createDataFrame([(w,) for w in {w for _, t, _ in rows for w in (t or "").replace("漢字", "漢 字").split()}], "token string")
    weight = {r["bucket"]: r["idf"] * r["coefficient"] for r in bucket_weights(spark, model).collect()}
    at = {r["token"]: weight[r["bucket"]] for r in token_buckets(model, words).collect()}
    intercept = model.model.stages[-1].intercept
    want = {}
    for i, t, _ in rows:
        want[i] = want.get(i, 0.0) + (sum(at[w] for w in (t or "").replace("漢字", "漢 字").split()) if i is not None else 0.0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = recomputed_scores(model, table.repartition(3), "text", "id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(str(r["id"]) for r in got) == sorted(str(i) for i, _, _ in rows)
    assert all(r["z"] == pytest.approx(want[r["id"]] + intercept, abs=1e-9) for r in got)


def test_a_torn_chunk_is_seen():
    import pyarrow as pa
    from topictone.operators.hashed_audit import _summed
    row = lambda key, ids, n, w: pa.RecordBatch.from_arrays(
        [pa.array([key], pa.int64()), pa.array([ids], pa.binary()), pa.array([n], pa.int64()), pa.array([w], pa.float64())], ["key", "ids", "n_words", "w"])
    text, word = row(1, b"\0\0\0\0", None, None), row(None, None, None, 0.5)
    assert pa.Table.from_batches(_summed(iter([text, word, row(None, None, 1, None)]))).to_pylist() == [{"key": 1, "z": 0.5}]
    for torn in ([text, row(None, None, 1, None)], [text, word]):
        with pytest.raises(ValueError):
            list(_summed(iter(torn)))
