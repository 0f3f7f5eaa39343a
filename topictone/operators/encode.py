"""Vocabulary (E3) and fixed-length encoding.

Ids: 0 = padding, 1 = unknown token, 2.. = vocabulary by descending count
(ties by token).  The vocabulary is bounded by ``vocab_size``, which is what
makes broadcasting it safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT_JOIN, DEFAULT_TOKENS, JoinConfig, TokenConfig
from ..functions.text import tokens
from ..session import cut_lineage, spread
from .joins import attach

PAD_ID = 0
UNK_ID = 1


def build_vocabulary(df: DataFrame, text_col: str, *, vocab_size: int, min_count: int = 1,
                     token_cfg: TokenConfig = DEFAULT_TOKENS) -> DataFrame:
    """``token, n, id`` for the ``vocab_size`` most frequent tokens seen at
    least ``min_count`` times.

    Counting is a ``groupBy(token)`` with partial aggregation.  A histogram of
    the counts gives the count that the last kept token can have; only tokens at
    or above it are sorted, and only the bounded result is numbered.
    """
    counts = (spread(df.select(text_col)).select(F.explode(tokens(text_col, token_cfg)).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("n"))
              .filter(F.col("n") >= F.lit(min_count)))
    counts = cut_lineage(counts, "token-counts")
    hist = counts.groupBy("n").agg(F.count(F.lit(1)).alias("tokens"))
    above = F.sum("tokens").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1))
    cut = hist.withColumn("above", above).filter(F.coalesce("above", F.lit(0)) < vocab_size).agg(F.min("n")).first()[0]
    counts = counts.filter(F.col("n") >= F.lit(cut if cut is not None else 0))
    top = counts.orderBy(F.col("n").desc(), F.col("token").asc()).limit(vocab_size)
    order = Window.orderBy(F.col("n").desc(), F.col("token").asc())
    return top.select("token", "n", (F.row_number().over(order) + F.lit(UNK_ID)).alias("id"))


def encode_fixed(df: DataFrame, vocabulary: DataFrame, text_col: str, key_col: str, *,
                 token_cfg: TokenConfig = TokenConfig(max_length=128),
                 vocab_size: int, carry: tuple[str, ...] = (),
                 join_cfg: JoinConfig = DEFAULT_JOIN) -> DataFrame:
    """``key_col, *carry, input_ids, attention_mask, n_real``: token ids padded
    with 0 to ``max_length``, and a mask of 1 (token) / 0 (padding).

    The (key, token array) rows are partitioned by key; the explode, a broadcast
    vocabulary (after a size check) and the per-text collection keep that
    partitioning, a vocabulary past the limits is a shuffle join by token and
    one more by key.  Every group holds at most ``max_length`` ids; a key that
    repeats raises.
    """
    length = token_cfg.max_length
    if length is None:
        raise ValueError("fixed-length encoding needs token_cfg.max_length")
    toks = (spread(df.select(key_col, *carry, text_col))
            .select(key_col, *carry, tokens(text_col, token_cfg).alias("__tt_toks"))
            .repartition(key_col))
    exploded = toks.select(key_col, *carry,
                           F.posexplode_outer("__tt_toks").alias("__tt_pos", "token"))
    vocab = cut_lineage(vocabulary.select("token", F.col("id").cast("int").alias("__tt_id")), "vocabulary")
    looked = attach(exploded, vocab, ["token"], how="left", null_safe=False, cfg=join_cfg)
    entry = F.when(F.col("__tt_pos").isNotNull(),
                   F.struct(F.col("__tt_pos").alias("pos"),
                            F.coalesce(F.col("__tt_id"), F.lit(UNK_ID)).alias("id")))
    grouped = looked.groupBy(key_col, *carry).agg(
        F.sort_array(F.collect_list(entry)).alias("__tt_entries"),
        F.count_if(F.col("__tt_pos").isNull() | (F.col("__tt_pos") == 0)).alias("__tt_texts"))
    once = F.when(F.col("__tt_texts") > 1, F.raise_error(F.concat(F.lit("key is not unique: "), F.col(f"`{key_col}`").cast("string")))
                  .cast("array<int>"))
    ids = F.transform("__tt_entries", lambda e: e["id"])
    n_real = F.size("__tt_entries")
    pad = F.lit(length) - n_real
    return grouped.select(
        key_col, *carry,
        F.coalesce(once, F.concat(ids, F.array_repeat(F.lit(PAD_ID), pad))).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), n_real), F.array_repeat(F.lit(0), pad)).alias("attention_mask"),
        n_real.alias("n_real"))
