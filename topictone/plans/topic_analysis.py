"""The topic analysis as one Spark plan.

    valid comments -> score -> [an expensive scorer: materialise only
         (key, topic, p), then join p back to the comments on the key]
      -> baselines (groupBy topic, partial + final aggregation; materialised,
         it is small: one row per topic)
      -> attach baselines to rows (broadcast after a size check, else a
         salted shuffle join) -> adjustment columns (one projection)

Many topics are handled in one job; an empty ``topic_cols`` means a single
global topic.  No comment reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_JOIN, DEFAULT_TOPIC, JoinConfig, TopicConfig
from ..functions.text import is_valid_text
from ..operators.report import topic_report
from ..operators.scorers import Scorer, check_unique, key_list, with_row_key
from ..operators.topics import RESULT_COLUMNS, adjust, check_no_clash, topic_baselines
from ..session import cut_lineage
from ..sources.comments import require_column


@dataclass
class TopicAnalysis:
    result: DataFrame      # input columns + RESULT_COLUMNS
    baselines: DataFrame   # topic cols, n, sum_p4, baseline, polarity, low_support
    topic_cols: list[str]
    cfg: TopicConfig

    def report(self) -> DataFrame:
        return topic_report(self.result, self.topic_cols, self.cfg)


def analyze_topics(df: DataFrame, scorer: Scorer, text_col: str | None,
                   topic_cols: list[str], key_col: str | list[str] | None = None,
                   cfg: TopicConfig = DEFAULT_TOPIC, *, keep_invalid: bool = False,
                   materialize: bool | None = None,
                   join_cfg: JoinConfig = DEFAULT_JOIN) -> TopicAnalysis:
    """Score, baseline and adjust every comment of ``df``.

    Rows whose text is NULL or blank are not scored (they get no result row),
    unless ``keep_invalid`` keeps them with NULL results.  ``text_col=None``
    is for tables that already carry a probability (``ColumnScorer``).
    ``key_col`` (one column or several) must be unique and not NULL among the
    scored rows: with a scorer that joins on it, anything else raises.  A row
    whose probability is NULL is outside the baseline and has NULL results.
    """
    keys = key_list(key_col) if key_col else []
    for c in topic_cols + ([text_col] if text_col else []) + keys:
        require_column(df, c)
    check_no_clash(df, RESULT_COLUMNS)
    if text_col is not None:
        valid = df.filter(is_valid_text(text_col))
    else:
        valid = df
    expensive = materialize if materialize is not None else scorer.expensive
    generated = None
    if expensive and key_col is None and hasattr(scorer, "score_keys"):
        # An unkeyed table gets a key once (materialised so it stays fixed).
        valid, generated = with_row_key(valid)
        keys = [generated]
    if expensive and keys and hasattr(scorer, "score_keys"):
        # Materialise only (key, topic, p) -- small, no text -- then put p back
        # on the comments with one join on the unique key.
        topics = [c for c in topic_cols if c not in keys]
        keyed = cut_lineage(scorer.score_keys(valid, text_col, keys, tuple(topics)), "scores")
        if generated is None:
            check_unique(keyed, keys)
        baselines = cut_lineage(topic_baselines(keyed, topic_cols, cfg), "baselines")
        scored = valid.join(keyed.select(*keys, "pos_prob"), keys, "inner") \
            .select(*[F.col(f"`{c}`") for c in valid.columns], "pos_prob")
    else:
        scored = scorer.score(valid, text_col, key_col)
        if expensive:
            scored = cut_lineage(scored, "scored")
        baselines = cut_lineage(topic_baselines(scored, topic_cols, cfg), "baselines")
    result = adjust(scored, baselines, topic_cols, cfg, join_cfg)
    if generated is not None:
        result = result.drop(generated)
    if keep_invalid and text_col is not None:
        invalid = df.filter(~is_valid_text(text_col) | F.col(text_col).isNull())
        empty = {c: F.lit(None).cast(result.schema[c].dataType) for c in RESULT_COLUMNS}
        result = result.unionByName(invalid.withColumns(empty))
    return TopicAnalysis(result, baselines, topic_cols, cfg)
