"""Dataset preparation (U1/D1-D5): union of labelled sources, a deterministic
train/eval/test split, and split reports.

The split hashes a key instead of drawing random numbers: the assignment does
not depend on partitioning or retries, and the SQL oracle can repeat it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SPLIT_FRACTIONS, SPLIT_SEED

SPLITS = ("train", "eval", "test")


def union_labelled(*dfs: DataFrame) -> DataFrame:
    """UNION ALL by column name (duplicates kept)."""
    if not dfs:
        raise ValueError("nothing to union")
    return reduce(lambda a, b: a.unionByName(b), dfs)


def split_digest(key_cols: list[str], seed: int = SPLIT_SEED) -> Column:
    """The md5 of ``seed:key`` as 32 hex digits."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols]
    key = parts[0] if len(parts) == 1 else F.concat_ws(":", *parts)
    return F.md5(F.concat(F.lit(f"{seed}:"), key))


def split_bucket(key_cols: list[str], seed: int = SPLIT_SEED) -> Column:
    """Bucket 0..9999 from the md5 of ``seed:key``."""
    return F.conv(F.substring(split_digest(key_cols, seed), 1, 8), 16, 10).cast("bigint") % 10000


def split_name(bucket: Column, fractions=SPLIT_FRACTIONS) -> Column:
    a = round(fractions[0] * 10000)
    b = round((fractions[0] + fractions[1]) * 10000)
    return (F.when(bucket < a, F.lit(SPLITS[0]))
            .when(bucket < b, F.lit(SPLITS[1]))
            .otherwise(F.lit(SPLITS[2])))


def assign_split(df: DataFrame, key_cols: list[str], *, seed: int = SPLIT_SEED,
                 fractions=SPLIT_FRACTIONS, text_col: str | None = None) -> DataFrame:
    """D2 + D3: add ``split``; with ``text_col`` rows whose text is NULL are
    dropped (a NULL is not a text).  Keying on the text keeps exact duplicates
    in one split."""
    out = df.withColumn("split", split_name(split_bucket(key_cols, seed), fractions))
    if text_col is not None:
        out = out.filter(F.col(text_col).isNotNull())
    return out


def split_sizes(df: DataFrame) -> DataFrame:
    """Rows per split."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def split_label_distribution(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Rows per split and label."""
    return df.groupBy("split", label_col).agg(F.count(F.lit(1)).alias("n"))


def split_report(df: DataFrame, label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """D4 + D5: (rows per split, rows per split and label)."""
    return split_sizes(df), split_label_distribution(df, label_col)
