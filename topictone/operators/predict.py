"""Label + confidence per text (M6, T6, P7, P12) and accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_TOPIC, REPLY_LABELS, Labels, TopicConfig
from ..functions.labels import absolute_confidence, absolute_id, binary_reply, label_of
from .scorers import Scorer


def predict(df: DataFrame, scorer: Scorer, text_col: str, key_col: str | None = None,
            labels: Labels = REPLY_LABELS, cfg: TopicConfig = DEFAULT_TOPIC,
            keep_prob: bool = False) -> DataFrame:
    """Each row's own label (0/1), its name and its confidence (4 decimals).

    Blank or NULL texts are scored too (the single-text path drops nothing);
    each row gets the confidence of its own probability.
    """
    scored = scorer.score(df, text_col, key_col, p_col="__tt_p")
    p = F.col("__tt_p")
    out = scored.withColumns({
        "label": absolute_id(p, cfg),
        "sentiment": label_of(absolute_id(p, cfg), labels),
        "confidence": F.round(absolute_confidence(p, cfg), 4),
    })
    if keep_prob:
        return out.withColumnRenamed("__tt_p", "pos_prob")
    return out.drop("__tt_p")


def reply(predicted: DataFrame, labels: Labels = REPLY_LABELS) -> DataFrame:
    """Collapse a prediction to the two-valued reply."""
    return predicted.withColumn("reply", binary_reply("sentiment", labels))


def accuracy(df: DataFrame, label_col: str, prediction_col: str) -> DataFrame:
    """One row: ``n``, ``correct``, ``accuracy`` (share of equal values, NULL
    without rows)."""
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(prediction_col) == F.col(label_col)).alias("correct"),
        F.try_divide(F.count_if(F.col(prediction_col) == F.col(label_col)), F.count(F.lit(1))).alias("accuracy"))
