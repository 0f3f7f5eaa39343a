"""D2 with exact sizes: the split of ``prep.assign_split`` gives each row its part by
itself, so parts have about their share; here they have exactly the sizes of two
successive draws (held-back rows: ``ceil((eval + test) * n)``, test rows: ``ceil`` of
their share of those).

Rows are ordered by the md5 of ``seed:key``, ties by a digest of their other
columns.  Only that order is written (one pass), and the rows at which a part
ends are found by refining a histogram: counts of 4,096 prefixes, then of
the prefixes inside the one that holds the wanted rank, until it has a single value
or FEW rows.  No sort, no window; the driver sees at most 4,096 counts or FEW
values at a time.  A key that many rows share costs no more rounds: the next round
begins after the prefix that all values left have in common.

Where a part ends inside rows of equal order, those rows are written and the first of
them in the files' order belong to the lower part: places in written
files don't change when a task runs again, and a hot key's rows stay spread.

``df`` is read three times at most and must give the same rows each time.  NULL keys
are ordered as empty ones.  An empty table gives an empty table.
"""

from __future__ import annotations

import math
import os
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SPLIT_FRACTIONS, SPLIT_SEED
from ..session import write_shared
from .prep import SPLITS, split_digest

ORDER = "__tt_order"
#: Hex digits of one histogram (4,096 counts), and rows whose values are listed.
STEP, FEW = 3, 4096


def exact_sizes(n: int, fractions=SPLIT_FRACTIONS) -> tuple[int, int, int]:
    """Rows of train, eval and test among ``n``."""
    _, ev, te = (Fraction(str(f)) for f in fractions)
    held = math.ceil((ev + te) * n)
    test = math.ceil(te / (ev + te) * held) if ev + te else 0
    return n - held, held - test, test


def split_order(key_cols: list[str], tie_cols: list[str], seed: int = SPLIT_SEED) -> Column:
    """64 hex digits: md5 of the seeded key; md5 of which keys are NULL and the other columns."""
    ties = [*(F.col(f"`{c}`").isNull().cast("string") for c in key_cols),
            *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in tie_cols)]
    return F.concat(split_digest(key_cols, seed), F.md5(F.concat_ws(":", *ties)))


def _at_rank(orders: DataFrame, rank: int) -> tuple[str, int, int]:
    """The value at ``rank`` (from 0), the rows below it and the rows that have it."""
    prefix, below = "", 0
    while True:
        bucket = F.substring(ORDER, 1, len(prefix) + STEP).alias("bucket")
        rows = (orders.filter(F.col(ORDER).startswith(prefix)).groupBy(bucket)
                .agg(F.count(F.lit(1)).alias("n"), F.min(ORDER).alias("lo"), F.max(ORDER).alias("hi")).collect())
        for r in sorted(rows, key=lambda r: r["bucket"]):
            if rank < below + r["n"]:
                break
            below += r["n"]
        if r["lo"] == r["hi"]:
            return r["lo"], below, r["n"]
        prefix = os.path.commonprefix([r["lo"], r["hi"]])
        if r["n"] <= FEW:
            few = orders.filter(F.col(ORDER).startswith(prefix)).groupBy(ORDER).agg(F.count(F.lit(1)).alias("n")).collect()
            for v in sorted(few, key=lambda v: v[ORDER]):
                if rank < below + v["n"]:
                    return v[ORDER], below, v["n"]
                below += v["n"]


def _ranked(df: DataFrame, below: int, rank: str) -> DataFrame:
    """Rows of one order with ranks from ``below`` on, in the order of their files."""
    stored = write_shared(df, "split-ties").select("*", F.col("_metadata.file_path").alias("__tt_file"), F.col("_metadata.row_index").alias(rank))
    sizes, offsets = stored.groupBy("__tt_file").agg(F.count(F.lit(1)).alias("n")).collect(), []   # one row per file
    for r in sorted(sizes, key=lambda r: r["__tt_file"]):
        offsets.append((r["__tt_file"], below))
        below += r["n"]
    side = F.broadcast(df.sparkSession.createDataFrame(offsets, "__tt_file string, __tt_offset long"))
    return stored.join(side, "__tt_file").withColumn(rank, F.col(rank) + F.col("__tt_offset")).drop("__tt_file", "__tt_offset")


def assign_exact_split(df: DataFrame, key_cols: list[str], *, seed: int = SPLIT_SEED, fractions=SPLIT_FRACTIONS,
                       tie_cols: list[str] | None = None, text_col: str | None = None) -> DataFrame:
    """D2 + D3: add ``split`` with exact sizes over all rows; with ``text_col`` rows
    whose text is NULL are dropped after it.  ``tie_cols``: the columns that order
    rows of equal key (all others if not given).  Exact copies of a key fall in
    one part, except where a part ends among them."""
    ties = [c for c in df.columns if c not in key_cols] if tie_cols is None else tie_cols
    ordered = df.withColumn(ORDER, split_order(key_cols, ties, seed))
    orders = write_shared(ordered.select(ORDER), "split-order")
    n = orders.count()
    train, ev, _ = exact_sizes(n, fractions)
    ends = (train, train + ev)
    last, torn = [], {}   # of each end: the last value of its part; values that it divides
    for end in ends:
        value, below, same = _at_rank(orders, end - 1) if end else ("", 0, 0)
        last.append(value)
        if end < below + same:
            torn[value] = below

    def part(value: Column, train_max, eval_max) -> Column:
        return F.when(value <= F.lit(train_max), SPLITS[0]).when(value <= F.lit(eval_max), SPLITS[1]).otherwise(SPLITS[2])

    whole = ordered if not torn else ordered.filter(~F.col(ORDER).isin(*torn))
    out = whole.withColumn("split", part(F.col(ORDER), *last)).drop(ORDER)
    for value, below in torn.items():
        rows = _ranked(ordered.filter(F.col(ORDER) == value).drop(ORDER), below, "__tt_rank")
        out = out.unionByName(rows.withColumn("split", part(F.col("__tt_rank"), ends[0] - 1, ends[1] - 1)).drop("__tt_rank"))
    return out if text_col is None else out.filter(F.col(text_col).isNotNull())
