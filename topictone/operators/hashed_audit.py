"""Recomputing what the Spark ML classifier does, from its exported weights.

The fitted stages are read into tables: the bucket of each token (from the fitted
``HashingTF``), document frequency and IDF of each bucket, and the coefficients.  Scores
are then joins and sums over tokens, without the vectors and the ``transform`` that
made them, so a stage that drops or zeroes something is seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import HashingTF, IDFModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_TOKENS, TokenConfig
from ..functions.text import tokens
from .hashed import HashedModel


def _stage(model: HashedModel, kind: type):
    return next(s for s in model.model.stages if isinstance(s, kind))


def bucket_weights(spark: SparkSession, model: HashedModel) -> DataFrame:
    """``bucket, doc_freq, idf, coefficient``: as many rows as the model has features."""
    idf, lr = _stage(model, IDFModel), _stage(model, LogisticRegressionModel)
    n = lr.numFeatures
    return spark.createDataFrame(pd.DataFrame({"bucket": range(n), "doc_freq": [int(x) for x in idf.docFreq], "idf": idf.idf.toArray(),
                                               "coefficient": lr.coefficients.toArray()}))


def token_buckets(model: HashedModel, distinct: DataFrame) -> DataFrame:
    """``token, bucket`` of a table of distinct tokens."""
    return _placed(model, distinct.select("token"))


def _placed(model: HashedModel, rows: DataFrame) -> DataFrame:
    """``rows``, whose last column is ``token``, and the token's ``bucket``."""
    tf = _stage(model, HashingTF)
    named = rows.withColumn(tf.getInputCol(), F.array("token"))
    return tf.transform(named).select(*rows.columns, F.unwrap_udt(tf.getOutputCol())["indices"][0].alias("bucket"))


def _counts(texts: DataFrame, text_col: str, key_col: str, token_cfg: TokenConfig) -> DataFrame:
    return (texts.select(key_col, F.explode(tokens(text_col, token_cfg)).alias("token"))
            .groupBy(key_col, "token").agg(F.count(F.lit(1)).alias("tf")))


def _coded(texts: DataFrame, text_col: str, key_col: str, token_cfg: TokenConfig) -> DataFrame:
    """``key, ids, n_words, token``, chunk by chunk (Arrow batches): a row per text, its
    tokens as places in the chunk's distinct tokens, a row per distinct token, and one
    with their number that ends the chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, lists = batch.columns
            coded = lists.flatten().dictionary_encode()
            ids, words = coded.indices.to_numpy(zero_copy_only=False).astype("<i4"), coded.dictionary
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
            of_text = pa.array([ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())
            n, m = len(batch), len(words)
            yield pa.RecordBatch.from_arrays([key, of_text, pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], names)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, key.type), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64()), words], names)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, key.type), pa.nulls(1, pa.binary()), pa.array([m], pa.int64()), pa.nulls(1, pa.string())], names)

    names = ["key", "ids", "n_words", "token"]
    rows = texts.select(F.col(f"`{key_col}`").alias("key"), tokens(text_col, token_cfg).alias("token"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids binary, n_words long, token string")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, z`` of the texts of each chunk of ``key, ids, n_words, w``.  Nothing between
    ``_coded`` and here moves a task's rows; a chunk that is not whole raises."""
    keys, ids, found = [], [], []
    for batch in batches:
        ends = batch.column(2).to_pylist()
        is_text = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(is_text) | np.array([x is not None for x in ends[1:]], bool)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
            if is_text[a:a + 1].any():
                keys.append(batch.column(0).slice(a, b - a))
                ids += batch.column(1).slice(a, b - a).to_pylist()
            elif b > a and ends[a] is None:
                found.append(batch.column(3).slice(a, b - a).to_numpy(zero_copy_only=False))
            elif b > a:
                weights = np.concatenate([np.zeros(0), *found])
                if len(weights) != ends[a]:
                    raise ValueError(f"a chunk has the weights of {len(weights)} tokens of {ends[a]}")
                text = np.repeat(np.arange(len(ids)), [len(x) // 4 for x in ids])
                z = np.bincount(text, weights[np.frombuffer(b"".join(ids), "<i4")], len(ids)).astype(np.float64)
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.chunked_array(keys).combine_chunks(), pa.array(z)], ["key", "z"])
                keys, ids, found = [], [], []
    if ids or found:
        raise ValueError("a chunk has no end")


def recomputed_scores(model: HashedModel, texts: DataFrame, text_col: str, key_col: str, token_cfg: TokenConfig = DEFAULT_TOKENS) -> DataFrame:
    """``key_col, z``: the logit of every text from the exported weights."""
    lr = _stage(model, LogisticRegressionModel)
    weights = bucket_weights(texts.sparkSession, model).select("bucket", (F.col("idf") * F.col("coefficient")).alias("w"))
    # A bucket is never null, and a left join does not ask: a test for null would hash twice.
    weighed = _placed(model, _coded(texts, text_col, key_col, token_cfg)).join(F.broadcast(weights), "bucket", "left")
    kind = texts.schema[key_col].dataType.simpleString()
    sums = (weighed.select("key", "ids", "n_words", F.when(F.col("token").isNotNull(), F.col("w")).alias("w"))
            .mapInArrow(_summed, f"key {kind}, z double").groupBy(F.col("key").alias(key_col)).agg(F.sum("z").alias("z")))
    return texts.select(key_col).join(sums, key_col, "left").select(key_col, (F.coalesce("z", F.lit(0.0)) + F.lit(float(lr.intercept))).alias("z"))


def token_features(model: HashedModel, texts: DataFrame, text_col: str, key_col: str, token_cfg: TokenConfig = DEFAULT_TOKENS) -> DataFrame:
    """``token, df, bucket_ok`` over the texts that the IDF was fitted on: the documents
    with each token, and whether its bucket's document frequency and IDF follow (a
    token alone in its bucket: exactly; else between the greatest and the sum of
    the bucket's tokens)."""
    idf = _stage(model, IDFModel)
    df = _counts(texts, text_col, key_col, token_cfg).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    placed = df.join(token_buckets(model, df.select("token")), "token")
    per = placed.groupBy("bucket").agg(F.max("df").alias("least"), F.sum("df").alias("most"))
    log = F.log((F.lit(float(idf.numDocs)) + 1) / (F.col("doc_freq") + 1))
    ok = F.col("doc_freq").between(F.col("least"), F.col("most")) & (F.abs(F.col("idf") - log) < 1e-9)
    checked = per.join(F.broadcast(bucket_weights(texts.sparkSession, model)), "bucket").select("bucket", ok.alias("bucket_ok"))
    return placed.join(checked, "bucket").select("token", "df", "bucket_ok")


def log_loss(scored: DataFrame, label_col: str) -> dict[str, float]:
    """Mean log loss of ``z`` against the labels, and that of the best constant."""
    y, z = F.col(label_col).cast("double"), F.col("z")
    loss = F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
    row = scored.agg(F.count(y).alias("n"), F.avg(loss).alias("loss"), F.avg(y).alias("rate")).first()
    p = row["rate"] or 0.0
    constant = -sum(x * math.log(x) for x in (p, 1 - p) if x > 0)
    return {"n": int(row["n"]), "loss": row["loss"], "constant": constant}
