"""The scorer interface: ``score(df, text_col, key_col) -> df + pos_prob``.

``pos_prob`` is the positive-class probability, rounded to 4 decimals at the
scorer's boundary.  Every scorer keeps the probability on the row it belongs
to; nothing is paired by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import quantise
from ..session import cut_lineage

ROW_KEY = "__tt_row"


class Scorer:
    """Base class.  ``expensive`` scorers have their output materialised by
    plans that read it twice (baseline and adjustment)."""

    expensive = False

    def score(self, df: DataFrame, text_col: str, key_col: str | None = None,
              p_col: str = "pos_prob") -> DataFrame:
        raise NotImplementedError


class ColumnScorer(Scorer):
    """A probability the table already has, or an expression over its
    columns (a narrow projection: no shuffle)."""

    def __init__(self, expr: Column | str):
        self.expr = F.col(expr) if isinstance(expr, str) else expr

    def score(self, df, text_col=None, key_col=None, p_col="pos_prob"):
        return df.withColumn(p_col, quantise(self.expr))


def key_list(key_col: str | list[str] | tuple[str, ...]) -> list[str]:
    return [key_col] if isinstance(key_col, str) else list(key_col)


def check_unique(scored: DataFrame, keys: list[str], n_col: str = "__tt_texts") -> None:
    """Raise when a key of a materialised table of per-key scores is NULL, stands
    for several texts or is in several rows (e.g. in two topics)."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(f"`{k}`").isNull()
    bad = (scored.groupBy(*keys).agg(F.sum(n_col).alias("n"), F.count(F.lit(1)).alias("rows"))
           .filter(null | (F.col("n") > 1) | (F.col("rows") > 1)).limit(1).collect())
    if bad:
        raise ValueError(f"key {keys} is NULL or not unique, e.g. {bad[0].asDict()}; give a unique key or several key columns")


def with_row_key(df: DataFrame) -> tuple[DataFrame, str]:
    """Give an unkeyed table a unique key, materialised so that the key does not
    change if part of the plan is recomputed."""
    keyed = df.withColumn(ROW_KEY, F.monotonically_increasing_id())
    return cut_lineage(keyed), ROW_KEY
