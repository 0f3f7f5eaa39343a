"""Spark ML text classifier (M1, M4, M8, M10, E5): hashed term frequencies,
IDF weighting and logistic regression.

Scoring is a narrow ``PipelineModel.transform`` (no shuffle), so it is the
scorer of choice for very large tables and for streams.  Fitting is
distributed (IDF document frequencies and L-BFGS gradients are tree
aggregations over the partitions).
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_TOKENS, TokenConfig
from ..functions.text import TOKEN_PATTERN
from ..session import spread
from .predict import accuracy
from .saved import load_version, save_version
from .scorers import Scorer

TEXT = "__tt_text"
TOKENS = "__tt_tokens"
TF = "__tt_tf"
FEATURES = "__tt_features"
RAW = "__tt_raw"
PROB = "__tt_probability"
PRED = "__tt_prediction"
INTERNAL = [TEXT, TOKENS, TF, FEATURES, RAW, PROB, PRED]


def featurizer(num_features: int, token_cfg: TokenConfig = DEFAULT_TOKENS) -> list:
    """Stages from the text column ``__tt_text`` to the feature vector: the same
    tokens as everywhere else (lower-cased Han characters and letter/digit runs)."""
    text = f"coalesce({TEXT}, '')"
    if token_cfg.lowercase:
        text = f"lower({text})"
    toks = f"regexp_extract_all({text}, r'{TOKEN_PATTERN}', 0)"
    if token_cfg.max_length is not None:
        toks = f"slice({toks}, 1, {int(token_cfg.max_length)})"
    return [
        SQLTransformer(statement=f"SELECT *, {toks} AS {TOKENS} FROM __THIS__"),
        HashingTF(inputCol=TOKENS, outputCol=TF, numFeatures=num_features),
        IDF(inputCol=TF, outputCol=FEATURES),
    ]


@dataclass
class HashedModel(Scorer):
    model: PipelineModel
    expensive = False

    def score(self, df: DataFrame, text_col: str, key_col: str | None = None,
              p_col: str = "pos_prob") -> DataFrame:
        out = self.model.transform(spread(df).withColumn(TEXT, F.col(f"`{text_col}`")))
        p = F.round(vector_to_array(F.col(PROB)).getItem(1), 4)
        return out.withColumn(p_col, p).drop(*INTERNAL)

    def save(self, path: str, overwrite: bool = False) -> None:
        """Fails where something is saved already, unless ``overwrite``."""
        save_version(SparkSession.active(), path, self.model.save, {"kind": "hashed"}, overwrite)

    @staticmethod
    def load(path: str) -> "HashedModel":
        folder, _ = load_version(SparkSession.active(), path)
        return HashedModel(PipelineModel.load(folder))


@dataclass
class HashedFit:
    model: HashedModel
    grid: DataFrame   # reg_param, eval_n, eval_correct, eval_accuracy, chosen


def fit_hashed(train: DataFrame, eval_df: DataFrame, text_col: str, label_col: str, *,
               num_features: int = 1 << 18, reg_grid=(0.0, 0.01, 0.1), max_iter: int = 30,
               token_cfg: TokenConfig = DEFAULT_TOKENS, parallelism: int = 3,
               bytes_per_task: int = 64 << 20) -> HashedFit:
    """M1 + M8: fit one logistic regression per ``regParam`` on ``train`` and keep
    the one with the best accuracy on ``eval_df`` (ties: the smaller value)."""
    spark = train.sparkSession
    lab = F.col(f"`{label_col}`").cast("double")
    tr = spread(train).select(F.col(f"`{text_col}`").alias(TEXT), lab.alias("__tt_label")) \
        .filter(F.col("__tt_label").isin(0.0, 1.0))
    ev = spread(eval_df).select(F.col(f"`{text_col}`").alias(TEXT), lab.alias("__tt_label")) \
        .filter(F.col("__tt_label").isin(0.0, 1.0))
    feat = Pipeline(stages=featurizer(num_features, token_cfg)).fit(tr)
    # Features are read once per L-BFGS iteration: keep them on the executors
    # (recomputable from lineage if an executor is lost), in partitions sized
    # to the data's bytes, and one per task slot at least: each iteration is one
    # task per partition plus a tree aggregation, so tiny partitions only add
    # scheduling and merge levels.  The cache is filled in parallel (count).
    cached = feat.transform(tr).select(FEATURES, "__tt_label", F.octet_length(TEXT).cast("bigint").alias(TEXT)) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    size = cached.agg(F.sum(TEXT)).first()[0] or 0
    tr_f = cached.coalesce(max(spark.sparkContext.defaultParallelism, math.ceil(size / bytes_per_task))).select(FEATURES, "__tt_label")
    ev_f = feat.transform(ev).select(FEATURES, "__tt_label").persist(StorageLevel.MEMORY_AND_DISK)
    def fit_one(reg: float):
        lr = LogisticRegression(featuresCol=FEATURES, labelCol="__tt_label", regParam=reg,
                                maxIter=max_iter, rawPredictionCol=RAW,
                                probabilityCol=PROB, predictionCol=PRED)
        m = lr.fit(tr_f)
        acc = accuracy(m.transform(ev_f), "__tt_label", PRED).first()
        return (float(reg), int(acc["n"]), int(acc["correct"]),
                float(acc["accuracy"]) if acc["n"] else 0.0, m)

    try:
        # Each L-BFGS iteration is a small job; fitting the grid points
        # concurrently (as Spark ML's tuning classes do with ``parallelism``)
        # keeps the cluster's task slots busy.
        with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(reg_grid)))) as pool:
            results = list(pool.map(fit_one, reg_grid))
    finally:
        cached.unpersist()
        ev_f.unpersist()
    best = max(results, key=lambda r: (r[3], -r[0]))
    model = PipelineModel(stages=list(feat.stages) + [best[4]])
    grid = spark.createDataFrame(
        [(r[0], r[1], r[2], r[3], r is best) for r in results],
        "reg_param double, eval_n bigint, eval_correct bigint, eval_accuracy double, chosen boolean")
    return HashedFit(HashedModel(model), grid)
