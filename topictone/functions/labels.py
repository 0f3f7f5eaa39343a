"""Class, polarity and probability expressions (all ``CASE WHEN`` chains)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT_TOPIC, REPLY_LABELS, Labels, TopicConfig
from .text import col_of


def three_way(value: str | Column, cfg: TopicConfig = DEFAULT_TOPIC,
              labels: Labels | None = None) -> Column:
    """value > hi positive, value < lo negative, else neutral (strict); NULL
    has no class."""
    v = col_of(value)
    lab = labels or cfg.labels
    return (F.when(v > F.lit(cfg.hi), F.lit(lab.positive))
            .when(v < F.lit(cfg.lo), F.lit(lab.negative))
            .when(v.isNotNull(), F.lit(lab.neutral)))


def absolute_id(p: str | Column, cfg: TopicConfig = DEFAULT_TOPIC) -> Column:
    """argmax of (1 - p, p); a tie picks class 0, hence the strict ``>``; NULL has
    no class."""
    p = col_of(p)
    return F.when(p > F.lit(cfg.cut), F.lit(1)).when(p.isNotNull(), F.lit(0))


def absolute_confidence(p: str | Column, cfg: TopicConfig = DEFAULT_TOPIC) -> Column:
    p = col_of(p)
    return F.when(p > F.lit(cfg.cut), p).otherwise(F.lit(1.0) - p)


def label_of(class_id: str | Column, labels: Labels) -> Column:
    """Class id 0/1 to its name."""
    c = col_of(class_id)
    return (F.when(c == 1, F.lit(labels.positive))
            .when(c == 0, F.lit(labels.negative)))


def binary_reply(sentiment: str | Column, labels: Labels = REPLY_LABELS) -> Column:
    """Anything that is not the positive label answers negative."""
    s = col_of(sentiment)
    return (F.when(s.eqNullSafe(F.lit(labels.positive)), F.lit(labels.positive))
            .otherwise(F.lit(labels.negative)))


def argmax_index(probs: str | Column) -> Column:
    """0-based index of the first maximum of an array (as numpy's argmax)."""
    a = col_of(probs)
    return F.array_position(a, F.array_max(a)) - 1


def log_sum_exp(logits: str | Column) -> Column:
    """ln(sum(exp(x))) of an array of finite logits, the largest taken out first so
    that nothing overflows; NULL for NULL and for no logits."""
    a = col_of(logits)
    top = F.array_max(a)
    return top + F.log(F.aggregate(F.transform(a, lambda x: F.exp(x - top)), F.lit(0.0), lambda acc, x: acc + x))


def softmax(logits: str | Column) -> Column:
    """exp(x) / sum(exp) of an array of finite logits, the largest taken out first;
    summed from first to last.  NULL for NULL, empty for no logits."""
    a = col_of(logits)
    top = F.array_max(a)
    shifted = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda acc, y: acc + y))


def positive_probability(probs: str | Column) -> Column:
    """Column 1 of a probability array, or column 0 for a one-column model."""
    a = col_of(probs)
    return F.when(F.size(a) > 1, F.element_at(a, 2)).otherwise(F.element_at(a, 1))


def quantise(p: str | Column, digits: int = 4) -> Column:
    """Round a probability to ``digits`` decimals (the scorer boundary)."""
    return F.round(col_of(p), digits)


def micro_units(p: str | Column, scale: int = 10_000) -> Column:
    """Integer units of a quantised probability, for order-independent sums."""
    return F.round(col_of(p) * F.lit(float(scale))).cast("bigint")
