"""Text classifier for any number of classes: multinomial naive Bayes as joins and
aggregations, probabilities by softmax.

Training, for classes c in their given order::

    n_c(w)  token counts in rows of class c; S_c their total; V distinct training tokens
    k_c(w)  = bigint(round(ln((n_c + 1) / (S_c + V)) * 1e6))
    prior_c = bigint(round(ln(N_c / N) * 1e6))      N_c rows of class c, N of all classes

Scoring: ``z_c = prior_c + sum of k_c`` over the text's known tokens (an unknown
token adds nothing to any class); the probabilities are the softmax of ``z / 1e6`` (4
decimals), the class is the first of the largest ``z``.  With two classes ``z_1 - z_0``
is the log odds of ``nb.py``, but for the rounding of its weights.

The integer sums don't depend on partitions.  The weights are one row per
token with an array of one weight per class, so a handful of classes is meant
(MAX_CLASSES at most).  They are broadcast after a check of their size; beyond it the
tokens of chunks of texts are joined, hot tokens salted (``packed.py``, ``joins.py``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_JOIN, DEFAULT_TOKENS, JoinConfig, TokenConfig
from ..functions.labels import argmax_index, softmax
from ..functions.text import tokens
from ..session import cut_lineage, spread
from .joins import attach, fits_broadcast, measure
from .nb import SCALE
from .packed import packed_sums
from .scorers import check_unique, key_list

MAX_CLASSES = 100


@dataclass
class ClassModel:
    weights: DataFrame      # token, n array<bigint>, k array<bigint>
    classes: list
    priors: list[int]
    token_cfg: TokenConfig = DEFAULT_TOKENS
    join_cfg: JoinConfig = DEFAULT_JOIN

    def logits(self, df: DataFrame, text_col: str, key_col: str | list[str]) -> DataFrame:
        """``key, z`` (array of integer micro-units), one row per key; raises when a key
        is NULL or stands for several texts."""
        keys = key_list(key_col)
        side = self.weights.select("token", "k")
        size = measure(side)
        texts = spread(df.select(*keys, text_col))
        if fits_broadcast(size, self.join_cfg):
            toks = texts.select(*keys, F.posexplode_outer(tokens(text_col, self.token_cfg)).alias("__tt_pos", "token"))
            first = F.col("__tt_pos").isNull() | (F.col("__tt_pos") == 0)
            toks = toks.select(*keys, "token", first.cast("bigint").alias("__tt_texts"))
            joined = attach(toks, side, ["token"], how="left", null_safe=False, cfg=self.join_cfg, size=size)
        else:   # one row per chunk of texts and token is moved
            joined = packed_sums(texts, tokens(text_col, self.token_cfg), len(self.classes), lambda pairs: attach(
                pairs, side, ["token"], null_safe=False, cfg=self.join_cfg, size=size))
            joined = joined.select(*keys, F.col("__tt_sums").alias("k"), F.lit(1).cast("bigint").alias("__tt_texts"))
        sums = [F.coalesce(F.sum(F.col("k")[i]), F.lit(0)) + F.lit(p) for i, p in enumerate(self.priors)]
        per_text = cut_lineage(joined.groupBy(*keys).agg(F.array(*sums).alias("z"), F.sum("__tt_texts").alias("__tt_texts")), "class-scores")
        check_unique(per_text, keys)
        return per_text.drop("__tt_texts")

    def score(self, df: DataFrame, text_col: str, key_col: str | list[str], *, class_col: str = "class",
              confidence_col: str = "confidence", probs_col: str = "probs") -> DataFrame:
        """``df`` and each row's class, its probability, and the probabilities of all
        classes in their order.  A text without known tokens has the priors."""
        keys = key_list(key_col)
        probs = F.transform(softmax(F.transform("__tt_z", lambda z: z.cast("double") / F.lit(float(SCALE)))), lambda p: F.round(p, 4))
        names = F.array(*map(F.lit, self.classes))
        at = (argmax_index("__tt_z") + 1).cast("int")
        out = df.join(self.logits(df, text_col, keys).withColumnRenamed("z", "__tt_z"), keys, "left")
        return out.select(*(F.col(f"`{c}`") for c in df.columns), F.element_at(names, at).alias(class_col),
                          F.element_at(probs, at).alias(confidence_col), probs.alias(probs_col))


def fit_classes(df: DataFrame, text_col: str, label_col: str, *, classes: list | None = None,
                token_cfg: TokenConfig = DEFAULT_TOKENS, join_cfg: JoinConfig = DEFAULT_JOIN) -> ClassModel:
    """Train on the rows of ``classes`` (default: all values of ``label_col``,
    ascending); other rows take no part.  Raises when a class has no row."""
    label = F.col(f"`{label_col}`")
    found = df.filter(label.isNotNull()).groupBy(label.alias("c")).agg(F.count(F.lit(1)).alias("n"))
    if classes is None:
        classes = sorted(r["c"] for r in found.select("c").limit(MAX_CLASSES + 1).collect())
    if not 2 <= len(classes) <= MAX_CLASSES:
        raise ValueError(f"between 2 and {MAX_CLASSES} classes are needed")
    rows = {r["c"]: r["n"] for r in found.filter(F.col("c").isin(*classes)).collect()}
    if missing := [c for c in classes if c not in rows]:
        raise ValueError(f"no training rows of class {missing}")
    t = spread(df.filter(label.isin(*classes)).select(label.alias("__tt_label"), text_col)).select(
        "__tt_label", F.explode(tokens(text_col, token_cfg)).alias("token"))
    counts = cut_lineage(t.groupBy("token").agg(
        F.array(*(F.count_if(F.col("__tt_label") == F.lit(c)) for c in classes)).alias("n")), "class-counts")
    sums = counts.agg(F.count(F.lit(1)).alias("V"), *(F.coalesce(F.sum(F.col("n")[i]), F.lit(0)).alias(f"s{i}") for i in range(len(classes)))).first()
    k = [F.round(F.log((F.col("n")[i] + 1) / F.lit(sums[f"s{i}"] + sums["V"])) * F.lit(float(SCALE))).cast("bigint") for i in range(len(classes))]
    total = sum(rows.values())
    priors = df.sparkSession.range(1).select(*(
        F.round(F.log(F.lit(rows[c]) / F.lit(total)) * F.lit(float(SCALE))).cast("bigint") for c in classes)).first()
    return ClassModel(counts.withColumn("k", F.array(*k)), list(classes), [int(p) for p in priors], token_cfg, join_cfg)
