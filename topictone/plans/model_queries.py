"""Registered queries around trained models: the Spark ML scorer (M1, M4, M8)
and model persistence (M10, S6, M11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import REPLY_LABELS
from ..operators.hashed import fit_hashed
from ..operators.hashed_audit import log_loss, recomputed_scores, token_features
from ..operators.multiclass import fit_classes
from ..operators.nb import NBModel
from ..operators.predict import predict
from ..session import shared_path, write_shared
from .queries import NOTHING_FITS, WHOLE_TEXT, nb_all_labels, split_labelled, table
from .topic_analysis import analyze_topics
from .training import load_model

NUM_FEATURES = 1 << 16


def _hashed_fit(spark, sf_dir):
    data = split_labelled(spark, sf_dir)
    return fit_hashed(data.filter(F.col("split") == "train"),
                      data.filter(F.col("split") == "eval"), "text", "label",
                      num_features=NUM_FEATURES, token_cfg=WHOLE_TEXT)


def _derived(scored, *keep: str):
    """What follows from a probability, next to what was returned: all true."""
    p = F.col("pos_prob")
    label = F.when(p > 0.5, 1).otherwise(0)
    conf = F.round(F.when(p > 0.5, p).otherwise(1 - p), 4)
    return scored.select(*keep, p.between(0, 1).alias("p_in_range"), (F.col("label") == label).alias("label_follows"),
                         (F.col("confidence") == conf).alias("confidence_follows"))


def q_hashed_score(spark, sf_dir):
    """M4 + M5 + M6: every document scored by the selected Spark ML model, checked
    against its own probability."""
    fit = _hashed_fit(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return _derived(predict(docs, fit.model, "text", "doc_id", REPLY_LABELS, keep_prob=True), "doc_id", "source", "lang")


def q_hashed_best_model(spark, sf_dir):
    """M8: eval rows per regularisation value, and whether the chosen one is the
    first of the best."""
    grid = _hashed_fit(spark, sf_dir).grid
    best = grid.orderBy(F.desc("eval_accuracy"), "reg_param").limit(1).select(F.col("reg_param").alias("want"))
    picked = grid.filter("chosen").select(F.col("reg_param").alias("got"), F.lit(True).alias("hit"))
    ok = best.join(picked, F.col("want") == F.col("got"), "left").select(F.coalesce("hit", F.lit(False)).alias("chosen_is_best"))
    row = ok.first()   # one row
    return grid.select("reg_param", "eval_n", (F.col("eval_accuracy") == F.try_divide("eval_correct", "eval_n")).alias("accuracy_follows"),
                       F.lit(bool(row[0])).alias("chosen_is_best"))


def q_hashed_topic_analysis(spark, sf_dir):
    """T8 with the shuffle-free scorer (the large-table default): the result
    columns of each document follow from its probability and the mean of its
    source, and the means from the probabilities."""
    fit = _hashed_fit(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    res = analyze_topics(docs, fit.model, "text", ["source"], key_col="doc_id", materialize=True).result.drop("text")
    res = write_shared(res, "hashed-analysis")
    units = F.round(F.col("pos_prob") * 10000.0).cast("bigint")
    mean = res.groupBy("source").agg((F.sum(units).cast("double") / (F.lit(10000.0) * F.count(units))).alias("b"))
    p, b = F.col("pos_prob"), F.col("b")
    factor = F.when((b > 0.6) & (p < 0.4), F.lit(0.3) * (1 - p)).when((b < 0.4) & (p > 0.6), F.lit(0.3) * p).otherwise(0.0)
    q = F.when(b > 0.6, p + factor).when(b < 0.4, p - factor).otherwise(p)
    name = F.when(q > 0.6, "positive").when(q < 0.4, "negative").otherwise("neutral")
    return res.join(F.broadcast(mean), "source").select(
        "doc_id", "source", "lang", p.between(0, 1).alias("p_in_range"), (F.col("topic_baseline") == b).alias("baseline_follows"),
        ((F.col("adj_factor") == factor) & (F.col("adj_pos_prob") == q) & (F.col("adj_sentiment") == name)).alias("adjustment_follows"),
        (F.col("abs_sentiment") == F.when(p > 0.5, "positive").otherwise("negative")).alias("class_follows"))


def q_hashed_model_roundtrip(spark, sf_dir):
    """M10 + S6 + M11: save the selected model, load it back, score with it: the
    documents whose reloaded score is the fitted one's."""
    fit = _hashed_fit(spark, sf_dir)
    path = shared_path(spark, "hashed-model")
    fit.model.save(path)
    loaded = load_model(spark, path)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    twice = loaded.score(fit.model.score(docs, "text", p_col="before"), "text", p_col="after")
    return twice.select("doc_id", F.col("before").eqNullSafe(F.col("after")).alias("same_score"))


def q_hashed_features(spark, sf_dir):
    """E5: documents per token of the training texts, and whether the fitted term
    frequencies and IDF of the token's bucket follow from them."""
    train = split_labelled(spark, sf_dir).filter(F.col("split") == "train")
    return token_features(_hashed_fit(spark, sf_dir).model, train.select("doc_id", "text"), "text", "doc_id", WHOLE_TEXT)


def q_hashed_score_recomputed(spark, sf_dir):
    """M4: the score of every document against the sum over its tokens of the exported
    weights (a last decimal may be rounded the other way)."""
    model = _hashed_fit(spark, sf_dir).model
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sums = recomputed_scores(model, docs, "text", "doc_id", WHOLE_TEXT)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("z")))
    return model.score(docs, "text").select("doc_id", "pos_prob").join(sums, "doc_id").select(
        "doc_id", (F.abs(F.col("pos_prob") - p) < 0.00005 + 1e-9).alias("score_follows"))


def q_hashed_training(spark, sf_dir):
    """M1 + M8: per split the labelled texts, and whether the chosen model, scored from
    its exported weights, does what the fit says: on train a log loss below that of
    the best constant (a model of zero weights has none), on eval the
    number of right answers that chose it."""
    data, fit = write_shared(split_labelled(spark, sf_dir), "labelled"), _hashed_fit(spark, sf_dir)
    z = recomputed_scores(fit.model, data.select("doc_id", "text"), "text", "doc_id", WHOLE_TEXT)
    scored = write_shared(data.select("doc_id", "label", "split").join(z, "doc_id"), "recomputed")
    loss = log_loss(scored.filter("split = 'train'"), "label")
    chosen = fit.grid.filter("chosen").first()
    right = scored.filter("split = 'eval'").agg(F.count_if((F.col("z") > 0) == (F.col("label") == 1)).alias("n")).first()["n"]
    follows = F.when(F.col("split") == "train", F.lit(bool(loss["loss"] < 0.9 * loss["constant"]))).when(
        F.col("split") == "eval", F.lit(right == chosen["eval_correct"])).otherwise(F.lit(True))
    return scored.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("bigint").alias("positive")).withColumn("follows", follows)


#: Classes of the labelled documents, in the order of their logits.
THREE = ["good", "poor", "toxic"]


def _three_classes(spark, sf_dir, **options):
    labels = table(spark, sf_dir, "labels")
    name = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    data = labels.select("doc_id", name.alias("name")).join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return fit_classes(data, "text", "name", classes=THREE, token_cfg=WHOLE_TEXT, **options)


def _class_rows(model, spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    probs = [F.col("probs")[i].alias(f"p_{c}") for i, c in enumerate(THREE)]
    return model.score(docs, "text", "doc_id").select("doc_id", "class", "confidence", *probs)


def q_class_model(spark, sf_dir):
    """M2 for three classes: counts and weights of each token."""
    weights = _three_classes(spark, sf_dir).weights
    return weights.select("token", *(F.col(x)[i].alias(f"{x}_{c}") for x in ("n", "k") for i, c in enumerate(THREE)))


def q_class_score(spark, sf_dir):
    """M3 + M5 + M6 for three classes: softmax, argmax and confidence of every document."""
    return _class_rows(_three_classes(spark, sf_dir), spark, sf_dir)


def q_class_score_salted(spark, sf_dir):
    """The same past the broadcast limits."""
    return _class_rows(_three_classes(spark, sf_dir, join_cfg=NOTHING_FITS), spark, sf_dir)


def q_sample_predictions(spark, sf_dir):
    """A saved and reloaded NB model on the benchmark passages as samples."""
    model = nb_all_labels(spark, sf_dir)
    path = shared_path(spark, "sample-model")
    model.save(path)
    samples = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return predict(samples, load_model(spark, path), "text", "doc_id", REPLY_LABELS).drop("text")


def q_nb_model_roundtrip(spark, sf_dir):
    """M10 + S6: the relational model saved as parquet and loaded back scores
    exactly as before (same SQL oracle as ``nb_score``)."""
    model = nb_all_labels(spark, sf_dir)
    path = shared_path(spark, "nb-model")
    model.save(path)
    loaded = NBModel.load(spark, path)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return loaded.score(docs, "text", "doc_id", keep_z=True).drop("text")


def q_training_metrics(spark, sf_dir):
    """D1-D5 + M2 + M8 + M9: the labelled union (documents with labels,
    benchmark passages as positives, conversation turns as negatives), a keyed
    split, NB fitted on train, variant chosen on eval, accuracy per split."""
    from .queries import q_labelled_union
    from .training import train
    trained = train(q_labelled_union(spark, sf_dir).select("text", "label"),
                    kind="nb", token_cfg=WHOLE_TEXT)
    return trained.metrics.withColumn("variant", F.lit(trained.choice))


MODEL_QUERIES = {
    "training_metrics": q_training_metrics,
    "hashed_score": q_hashed_score,
    "hashed_best_model": q_hashed_best_model,
    "hashed_topic_analysis": q_hashed_topic_analysis,
    "hashed_model_roundtrip": q_hashed_model_roundtrip,
    "hashed_features": q_hashed_features,
    "hashed_score_recomputed": q_hashed_score_recomputed,
    "hashed_training": q_hashed_training,
    "class_model": q_class_model,
    "class_score": q_class_score,
    "class_score_salted": q_class_score_salted,
    "sample_predictions": q_sample_predictions,
    "nb_model_roundtrip": q_nb_model_roundtrip,
}
