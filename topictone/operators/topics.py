"""Topic baseline (T1, T2, A10) and per-comment adjustment.

The baseline of a topic is the mean positive probability of its comments.
It is computed as an integer sum of probabilities quantised to 1e-4, so the
value (and therefore every threshold decision) does not depend on the order
in which partitions are combined.  The aggregation is a plain ``groupBy``
with map-side partial aggregation: a topic holding a third of all rows costs
one partial row per task, not one task holding the third.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_JOIN, DEFAULT_TOPIC, JoinConfig, TopicConfig
from ..functions.labels import (absolute_confidence, absolute_id, label_of,
                                micro_units, three_way)
from .joins import attach, measure

P_COL = "pos_prob"

# Result columns added to every comment row, in output order.
RESULT_COLUMNS = ["abs_sentiment", "abs_confidence", "adj_sentiment", "pos_prob",
                  "adj_pos_prob", "adj_factor", "topic_baseline"]


def topic_baselines(scored: DataFrame, topic_cols: list[str],
                    cfg: TopicConfig = DEFAULT_TOPIC, p_col: str = P_COL) -> DataFrame:
    """One row per topic: ``n`` (rows with a probability), ``sum_p4``,
    ``baseline``, ``polarity``, ``low_support``.  An empty topic list gives one
    global topic; a topic without any probability has no baseline row (never a
    division by zero)."""
    agg = (scored.groupBy(*topic_cols)
           .agg(F.count(p_col).alias("n"),
                F.sum(micro_units(p_col)).alias("sum_p4"))
           .filter(F.col("n") > 0))
    baseline = F.col("sum_p4").cast("double") / (F.lit(10000.0) * F.col("n"))
    return agg.select(
        *topic_cols, "n", "sum_p4", baseline.alias("baseline"),
        three_way(baseline, cfg).alias("polarity"),
        (F.col("n") < F.lit(cfg.min_support)).alias("low_support"))


def adjustment_columns(p_col: str = P_COL, baseline_col: str = "topic_baseline",
                       cfg: TopicConfig = DEFAULT_TOPIC) -> dict:
    """Column expressions of T3-T6 for rows that carry ``p`` and the baseline."""
    p, b = F.col(p_col), F.col(baseline_col)
    hi, lo, k = F.lit(cfg.hi), F.lit(cfg.lo), F.lit(cfg.strength)
    pos_topic, neg_topic = b > hi, b < lo
    factor = (F.when(pos_topic & (p < lo), k * (F.lit(1.0) - p))
              .when(neg_topic & (p > hi), k * p)
              .when(p.isNotNull(), F.lit(0.0)))
    adjusted = (F.when(pos_topic, p + factor)
                .when(neg_topic, p - factor)
                .otherwise(p))
    return {
        "abs_sentiment": label_of(absolute_id(p, cfg), cfg.labels),
        "abs_confidence": absolute_confidence(p, cfg),
        "adj_factor": factor,
        "adj_pos_prob": adjusted,
        "adj_sentiment": three_way(adjusted, cfg),
    }


def check_no_clash(df: DataFrame, names: list[str]) -> None:
    clash = [c for c in names if c in df.columns]
    if clash:
        raise ValueError(f"input already has result column(s) {clash}; rename them first")


def attach_baselines(scored: DataFrame, baselines: DataFrame, topic_cols: list[str],
                     join_cfg: JoinConfig = DEFAULT_JOIN) -> DataFrame:
    """Put each topic's baseline on its rows.

    ``baselines`` should be materialised; its size is measured and it is
    broadcast only within the limits of ``join_cfg``.  A NULL topic is a topic
    (null-safe key equality).  Rows of a topic without a baseline keep a NULL
    baseline and are not adjusted.
    """
    side = baselines.select(*topic_cols, F.col("baseline").alias("topic_baseline"))
    size = measure(side) if topic_cols else None
    return attach(scored, side, topic_cols, how="left", null_safe=True, cfg=join_cfg, size=size)


def adjust(scored: DataFrame, baselines: DataFrame, topic_cols: list[str],
           cfg: TopicConfig = DEFAULT_TOPIC, join_cfg: JoinConfig = DEFAULT_JOIN,
           p_col: str = P_COL) -> DataFrame:
    """Every scored row with the seven result columns."""
    carried = [c for c in scored.columns if c != p_col]
    check_no_clash(scored.select(*carried), RESULT_COLUMNS)
    joined = attach_baselines(scored, baselines, topic_cols, join_cfg)
    cols = adjustment_columns(p_col, "topic_baseline", cfg)
    return joined.select(
        *[F.col(f"`{c}`") for c in carried],
        cols["abs_sentiment"].alias("abs_sentiment"),
        cols["abs_confidence"].alias("abs_confidence"),
        cols["adj_sentiment"].alias("adj_sentiment"),
        F.col(p_col).alias("pos_prob"),
        cols["adj_pos_prob"].alias("adj_pos_prob"),
        cols["adj_factor"].alias("adj_factor"),
        F.col("topic_baseline"))


def rows_of(result: DataFrame, sentiment: str) -> DataFrame:
    """The rows whose adjusted class is ``sentiment``."""
    return result.filter(F.col("adj_sentiment") == F.lit(sentiment))
