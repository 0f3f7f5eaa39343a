"""Relational text classifier (M2, M3): multinomial naive Bayes as joins and
aggregations.

Training::

    n1(w), n0(w)  token counts in label-1 / label-0 rows; S1, S0 their totals
    V             number of distinct training tokens
    k(w)  = bigint(round((ln((n1+1)/(S1+V)) - ln((n0+1)/(S0+V))) * 1e6))
    prior = bigint(round(ln(N1/N0) * 1e6))          N1, N0 = rows per label

Scoring (``normalise="sum"``)::

    z = prior + sum of k over the text's tokens (unknown token: 0)
    p = round(1 / (1 + exp(-clamp(z / 1e6, -30, 30))), 4)

``normalise="mean"`` uses ``z = prior + T * sum(k) / max(n_tokens, 1)``
(``T = 4``) so long texts do not saturate.  Integer weights make the sums
independent of partitioning.

Plan: the token counts are one ``groupBy(token)`` with map-side partial
aggregation (a frequent token is combined in every task before the shuffle).
Scoring explodes the tokens, joins the weights (broadcast after a size check;
beyond it the most frequent tokens are broadcast and only the others are joined
by a shuffle, once per chunk of texts) and sums per text with map-side partial
aggregation; the per-text sums are joined back to the texts on their unique key.
A key that repeats or is NULL raises, as its texts could not be told apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT_JOIN, DEFAULT_TOKENS, JoinConfig, TokenConfig
from ..functions.text import tokens
from ..session import cut_lineage, spread
from .joins import TableSize, attach, fits_broadcast, measure
from .packed import packed_sums
from .saved import load_version, save_version
from .scorers import Scorer, check_unique, key_list, with_row_key

SCALE = 1_000_000


def sigmoid_p(z_units) -> "F.Column":
    """Probability (4 decimals) of a logit given in micro-units."""
    x = z_units.cast("double") / F.lit(float(SCALE))
    x = F.least(F.greatest(x, F.lit(-30.0)), F.lit(30.0))
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-x)), 4)


@dataclass
class NBModel(Scorer):
    weights: DataFrame          # token, n0, n1, k
    prior: int
    vocab: int
    normalise: str = "sum"
    temperature: float = 4.0
    token_cfg: TokenConfig = DEFAULT_TOKENS
    join_cfg: JoinConfig = DEFAULT_JOIN
    _size: TableSize | None = None
    _head: int | bool | None = None   # least count in the broadcast head; False: none fits

    expensive = True

    def weight_side(self) -> DataFrame:
        return self.weights.select("token", "k")

    def _head_and_tail(self) -> tuple[DataFrame, DataFrame | None]:
        """The weights to broadcast, and those beyond the limits (None if all
        fit).  The head holds the most frequent tokens: whole count classes, from
        the top, as long as they fit (a histogram of counts gives the cut)."""
        side = self.weight_side()
        if self._size is None:
            self._size = measure(side)
        if fits_broadcast(self._size, self.join_cfg):
            return side, None
        if self._head is None:
            per_row = max(1, self._size.bytes // max(1, self._size.rows))
            room = min(self.join_cfg.broadcast_max_rows, self.join_cfg.broadcast_max_bytes // (4 * per_row))
            n = (F.col("n0") + F.col("n1")).alias("n")
            hist = self.weights.groupBy(n).agg(F.count(F.lit(1)).alias("tokens"))
            above = F.sum("tokens").over(Window.orderBy(F.desc("n")))
            cut = hist.withColumn("above", above).filter(F.col("above") <= room).agg(F.min("n")).first()[0]
            top = self.weights.filter(F.lit(False) if cut is None else (F.col("n0") + F.col("n1")) >= cut).select("token", "k")
            size = measure(top)
            self._head = cut if fits_broadcast(size, self.join_cfg) else False
            self._head = False if cut is None else self._head
        n = F.col("n0") + F.col("n1")
        in_head = F.lit(False) if self._head is False else n >= F.lit(self._head)
        return (self.weights.filter(in_head).select("token", "k"), self.weights.filter(~in_head).select("token", "k"))

    def logits(self, df: DataFrame, text_col: str, key_col: str | list[str],
               carry: tuple[str, ...] = ()) -> DataFrame:
        """``key_col, *carry, __tt_ksum, __tt_ntok, __tt_texts`` for every key (a
        text without tokens has one row with sum 0 and no tokens; ``__tt_texts``
        counts the texts of the key).  ``carry`` columns must be functionally
        dependent on the key (e.g. its topic).

        Unknown tokens add 0, so past the broadcast limits only the distinct tokens of
        each chunk of texts are moved, those outside the broadcast head to an inner
        join (``packed.py``; each text is tokenised once)."""
        keys = key_list(key_col)
        texts = spread(df.select(*keys, *carry, text_col))
        head, tail = self._head_and_tail()
        if tail is None:
            toks = texts.select(*keys, *carry, F.posexplode_outer(tokens(text_col, self.token_cfg)).alias("__tt_pos", "token"))
            joined = toks.join(F.broadcast(head), "token", "left")
            first = F.col("__tt_pos").isNull() | (F.col("__tt_pos") == 0)
            return joined.groupBy(*keys, *carry).agg(F.sum(F.coalesce(F.col("k"), F.lit(0))).alias("__tt_ksum"),
                                                     F.count("token").alias("__tt_ntok"), F.count_if(first).alias("__tt_texts"))

        def weigh(pairs: DataFrame) -> DataFrame:
            top = F.broadcast(head)
            found = pairs.join(top, "token").select(*pairs.columns, "k")
            # Tokens outside the head meet the tail in a join, hot ones salted.
            rest = attach(pairs.join(top.select("token"), "token", "left_anti"), tail, ["token"], null_safe=False, cfg=self.join_cfg)
            return found.unionByName(rest.select(*pairs.columns, "k")).withColumn("k", F.array("k"))

        sums = packed_sums(texts, tokens(text_col, self.token_cfg), 1, weigh)
        return sums.groupBy(*keys, *carry).agg(F.sum(F.col("__tt_sums")[0]).alias("__tt_ksum"), F.sum("__tt_ntok").alias("__tt_ntok"),
                                               F.count(F.lit(1)).alias("__tt_texts"))

    def score_keys(self, df: DataFrame, text_col: str, key_col: str | list[str],
                   carry: tuple[str, ...] = (), p_col: str = "pos_prob") -> DataFrame:
        """``key_col, *carry, p_col, __tt_texts`` without joining back to the texts:
        a small table (no text), used to materialise scores cheaply."""
        per_text = self.logits(df, text_col, key_col, tuple(carry))
        return per_text.select(*key_list(key_col), *carry, sigmoid_p(self.z_expr()).alias(p_col), "__tt_texts")

    def z_expr(self):
        ksum = F.coalesce(F.col("__tt_ksum"), F.lit(0))
        if self.normalise == "sum":
            return F.lit(self.prior) + ksum
        ntok = F.greatest(F.coalesce(F.col("__tt_ntok"), F.lit(0)), F.lit(1))
        return F.lit(float(self.prior)) + F.lit(float(self.temperature)) * ksum / ntok

    def score(self, df, text_col, key_col=None, p_col="pos_prob", keep_z=False):
        generated = key_col is None
        if generated:
            df, key_col = with_row_key(df)
        # The explode, the (broadcast) weight join and the map-side partial sum
        # run in the scan's tasks, so only (key, sum, count) per text is
        # shuffled; the texts themselves are shuffled once, by the key join.
        keys = key_list(key_col)
        per_text = self.logits(df, text_col, keys)
        if not generated:
            per_text = cut_lineage(per_text, "nb-scores")
            check_unique(per_text, keys)
        out = df.join(per_text, keys, "left")
        z = self.z_expr()
        cols = [F.col(f"`{c}`") for c in df.columns if not (generated and c in keys)]
        extra = []
        if keep_z:
            extra = [z.alias("nb_z"),
                     F.coalesce(F.col("__tt_ntok"), F.lit(0)).alias("n_tokens")]
        return out.select(*cols, *extra, sigmoid_p(z).alias(p_col))

    # -- persistence (M10 / S6) -------------------------------------------
    def save(self, path: str, overwrite: bool = False) -> None:
        """Fails where something is saved already, unless ``overwrite``."""
        note = {"kind": "nb", "prior": self.prior, "vocab": self.vocab, "normalise": self.normalise,
                "temperature": self.temperature, "max_length": self.token_cfg.max_length,
                "lowercase": self.token_cfg.lowercase}
        save_version(self.weights.sparkSession, path, self.weights.write.parquet, note, overwrite)

    @staticmethod
    def load(spark: SparkSession, path: str, join_cfg: JoinConfig = DEFAULT_JOIN) -> "NBModel":
        folder, meta = load_version(spark, path)
        return NBModel(weights=spark.read.parquet(folder),
                       prior=int(meta["prior"]), vocab=int(meta["vocab"]),
                       normalise=meta["normalise"], temperature=float(meta["temperature"]),
                       token_cfg=TokenConfig(meta["max_length"], bool(meta["lowercase"])),
                       join_cfg=join_cfg)


def token_counts(df: DataFrame, text_col: str, label_col: str,
                 token_cfg: TokenConfig = DEFAULT_TOKENS) -> DataFrame:
    """``token, n0, n1``: occurrences of each token in label-0 / label-1 rows."""
    lab = F.col(label_col).cast("int")
    t = spread(df.filter(lab.isin(0, 1)).select(lab.alias("__tt_label"), text_col)).select(
        "__tt_label", F.explode(tokens(text_col, token_cfg)).alias("token"))
    return t.groupBy("token").agg(
        F.count_if(F.col("__tt_label") == 0).alias("n0"),
        F.count_if(F.col("__tt_label") == 1).alias("n1"))


def fit_nb(df: DataFrame, text_col: str, label_col: str, *, normalise: str = "sum",
           temperature: float = 4.0, token_cfg: TokenConfig = DEFAULT_TOKENS,
           min_count: int = 1, join_cfg: JoinConfig = DEFAULT_JOIN) -> NBModel:
    """Train on ``df`` (rows with label 0 or 1).  Raises when a class is
    missing, since no two-class model exists then.

    ``min_count`` is a rule of the model, not a means of scale: tokens seen fewer
    times in training are not part of it (S1, S0 and V count only the kept tokens)
    and score 0 like any unknown token."""
    if normalise not in ("sum", "mean"):
        raise ValueError("normalise must be 'sum' or 'mean'")
    lab = F.col(label_col).cast("int")
    rows = df.agg(F.count_if(lab == 1).alias("N1"), F.count_if(lab == 0).alias("N0")).first()
    n1_rows, n0_rows = int(rows["N1"]), int(rows["N0"])
    if n1_rows == 0 or n0_rows == 0:
        raise ValueError(f"training data needs both classes (label 1: {n1_rows}, label 0: {n0_rows})")
    counts = token_counts(df, text_col, label_col, token_cfg)
    if min_count > 1:
        counts = counts.filter(F.col("n0") + F.col("n1") >= F.lit(min_count))
    counts = cut_lineage(counts, "nb-counts")
    tot = counts.agg(F.coalesce(F.sum("n1"), F.lit(0)).alias("S1"),
                     F.coalesce(F.sum("n0"), F.lit(0)).alias("S0"),
                     F.count(F.lit(1)).alias("V")).first()
    s1, s0, v = int(tot["S1"]), int(tot["S0"]), int(tot["V"])
    log_odds = (F.log((F.col("n1") + 1) / F.lit(s1 + v))
                - F.log((F.col("n0") + 1) / F.lit(s0 + v)))
    weights = counts.select("token", "n0", "n1",
                            F.round(log_odds * F.lit(float(SCALE))).cast("bigint").alias("k"))
    prior_row = df.sparkSession.range(1).select(
        F.round(F.log(F.lit(n1_rows) / F.lit(n0_rows)) * F.lit(float(SCALE)))
        .cast("bigint").alias("prior")).first()
    return NBModel(weights=weights, prior=int(prior_row["prior"]), vocab=v,
                   normalise=normalise, temperature=temperature,
                   token_cfg=token_cfg, join_cfg=join_cfg)
