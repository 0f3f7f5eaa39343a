"""Per-topic report (A1-A6, A10) and class transition matrix.

Each report is one ``groupBy`` over the result with conditional counts, so a
single pass (with map-side partial aggregation) gives every figure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_TOPIC, TopicConfig
from ..functions.labels import three_way


def class_counts(result: DataFrame, topic_cols: list[str],
                 cfg: TopicConfig = DEFAULT_TOPIC) -> DataFrame:
    """A1-A3: rows, original and adjusted class counts per topic."""
    lab = cfg.labels
    abs_s, adj_s = F.col("abs_sentiment"), F.col("adj_sentiment")
    # Rows without a result (keep_invalid, NULL probability) are not counted.
    return result.groupBy(*topic_cols).agg(
        F.count("abs_sentiment").alias("n"),
        F.max("topic_baseline").alias("baseline"),
        F.count_if(abs_s == F.lit(lab.positive)).alias("orig_pos"),
        F.count_if(abs_s == F.lit(lab.negative)).alias("orig_neg"),
        F.count_if(adj_s == F.lit(lab.positive)).alias("adj_pos"),
        F.count_if(adj_s == F.lit(lab.negative)).alias("adj_neg"),
        F.count_if(adj_s == F.lit(lab.neutral)).alias("adj_neutral"),
    )


def topic_report(result: DataFrame, topic_cols: list[str],
                 cfg: TopicConfig = DEFAULT_TOPIC) -> DataFrame:
    """One row per topic with baseline, polarity, counts, shares, the
    adjustment effect (NULL in a neutral topic) and the support flag."""
    counts = class_counts(result, topic_cols, cfg)
    n, b = F.col("n"), F.col("baseline")
    # A count difference, NULL in a neutral topic; DOUBLE so that the NULL
    # survives conversions that have no integer NULL (e.g. pandas).
    effect = (F.when(b > F.lit(cfg.hi), F.col("adj_pos") - F.col("orig_pos"))
              .when(b < F.lit(cfg.lo), F.col("orig_pos") - F.col("adj_pos"))).cast("double")
    shares = {f"{c}_share": F.try_divide(F.col(c), n)
              for c in ("orig_pos", "orig_neg", "adj_pos", "adj_neg", "adj_neutral")}
    return counts.select(
        *topic_cols, "n", "baseline", three_way(b, cfg).alias("polarity"),
        "orig_pos", "orig_neg", "adj_pos", "adj_neg", "adj_neutral",
        *[e.alias(k) for k, e in shares.items()],
        effect.alias("effect"),
        (n < F.lit(cfg.min_support)).alias("low_support"))


def transition_matrix(result: DataFrame, topic_cols: list[str]) -> DataFrame:
    """Rows per (topic, original class, adjusted class)."""
    return (result.groupBy(*topic_cols, "abs_sentiment", "adj_sentiment")
            .agg(F.count(F.lit(1)).alias("n")))


def report_display(report: DataFrame, topic_cols: list[str]) -> DataFrame:
    """The report as display strings: baseline with 4 decimals, shares as
    percentages with 2 decimals (the numbers stay numeric in ``topic_report``)."""
    def pct(c: str):
        return F.format_string("%.2f%%", F.col(c) * F.lit(100.0)).alias(c)

    return report.select(
        *topic_cols, "n", F.format_string("%.4f", "baseline").alias("baseline"), "polarity",
        "orig_pos", pct("orig_pos_share"), "orig_neg", pct("orig_neg_share"),
        "adj_pos", pct("adj_pos_share"), "adj_neg", pct("adj_neg_share"),
        "adj_neutral", pct("adj_neutral_share"), "effect", "low_support")
