"""Configuration objects shared by every operator.

All thresholds are parameters; the defaults are the fixed values of the
topic-adjustment rule that results must agree with.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Labels:
    """Names of the three classes as they appear in result columns."""

    positive: str
    negative: str
    neutral: str

    def as_list(self) -> list[str]:
        return [self.positive, self.negative, self.neutral]


# Class names.  English is the default output vocabulary; the
# Chinese set is the one the original tool prints and writes; the reply set is
# what a single-text prediction (and the stream reply) answers with.
LABELS_EN = Labels(positive="positive", negative="negative", neutral="neutral")
LABELS_ZH = Labels(positive="积极", negative="消极", neutral="中性")
REPLY_LABELS = Labels(positive="好评 (Positive)", negative="差评 (Negative)", neutral="中性")

# Chinese headers of the result columns (used by the CSV sink
# when headers="zh"), keyed by our English column names.
ZH_HEADERS = {
    "abs_sentiment": "绝对情感分类",
    "abs_confidence": "绝对情感置信度",
    "adj_sentiment": "调整后情感分类",
    "pos_prob": "原始积极概率",
    "adj_pos_prob": "调整后积极概率",
    "adj_factor": "调整因子",
    "topic_baseline": "话题情感基准",
}

# Tokens that pandas' CSV reader turns into a missing value by
# default.  The original tool drops such comments, so the CSV source maps them
# to NULL.
PANDAS_NA = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)


@dataclass(frozen=True)
class TopicConfig:
    """Topic baseline and adjustment rule.

    * topic polarity: baseline > hi positive, baseline < lo negative, else neutral
    * in a positive topic a comment with p < lo moves up by strength * (1 - p)
    * in a negative topic a comment with p > hi moves down by strength * p
    * adjusted class: q > hi positive, q < lo negative, else neutral
    * absolute class: p > cut positive, else negative
    All comparisons are strict.
    """

    # Fixed values of the adjustment rule.
    hi: float = 0.6
    lo: float = 0.4
    strength: float = 0.3
    cut: float = 0.5
    # A topic with fewer comments than this is flagged as low-support
    # (50 is the smallest topic size the original documentation recommends).
    min_support: int = 50
    labels: Labels = LABELS_EN


@dataclass(frozen=True)
class TokenConfig:
    """Tokenisation: one token per Han character, otherwise runs of letters and
    digits, lower-cased.  ``max_length=None`` keeps the whole text; a number
    keeps the first ``max_length`` tokens (128 is the original model's input
    length, used where a fixed-length input is the point, e.g. encoding)."""

    max_length: int | None = None
    lowercase: bool = True


@dataclass(frozen=True)
class JoinConfig:
    """Size checks for joins against a derived table (baselines, model).

    ``broadcast_max_rows`` / ``broadcast_max_bytes`` bound what may be
    broadcast; beyond them the join is a shuffle join in which a key holding
    a share ``s`` of the rows is salted into ``ceil(s * P)`` splits (``P`` =
    ``spark.sql.shuffle.partitions``).  Set the byte limit well below the
    executors' memory.
    """

    broadcast_max_rows: int = 2_000_000
    broadcast_max_bytes: int = 256 * 1024 * 1024


DEFAULT_TOPIC = TopicConfig()
DEFAULT_TOKENS = TokenConfig()
DEFAULT_JOIN = JoinConfig()

# Seed of the deterministic hash split.
SPLIT_SEED = 42
SPLIT_FRACTIONS = (0.70, 0.15, 0.15)

