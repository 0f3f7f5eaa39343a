"""Attaching a derived table (topic baselines, model weights) to every row.

The derived table is broadcast only after its size has been measured.  Beyond
the limits the join is a shuffle join in which hot keys are salted: a key
holding a share ``s`` of the rows is spread over ``ceil(s * P)`` splits, where
``P`` is the shuffle partition count, so no split holds much more than an
average partition.

The large side is evaluated once: it is written to the shared folder with a hash of
its keys, and a mergeable heavy-hitter sketch reads that one column, NULL and keys
that the derived table does not hold included.  (``observe`` would fill the sketch while
writing, but a session that has observed can't run Spark ML models any more: its
manager isn't serializable.)  The sketch names every
key with more than ``1 / P`` of the rows and at most ``2 * P`` keys, so the table of
hot keys is bounded and may be broadcast itself.  A row's salt is a hash of its place
(file and row number) in the written table, so a task that runs again gives each row
the same salt, and equal rows are spread too.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_JOIN, JoinConfig
from ..session import cut_lineage

_SALT = "__tt_salt"
_NSALT = "__tt_nsalt"
_HASH = "__tt_key_hash"
_PLACE = "__tt_place"


@dataclass(frozen=True)
class TableSize:
    rows: int
    bytes: int


def measure(df: DataFrame) -> TableSize:
    """Row count and an estimate of the in-memory size (one small job)."""
    widths = []
    for f in df.schema.fields:
        dt = f.dataType
        if isinstance(dt, (T.StringType, T.BinaryType)):
            widths.append(F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + F.lit(16))
        elif isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
            widths.append(F.coalesce(F.length(F.to_json(F.col(f"`{f.name}`"))), F.lit(0)) + F.lit(16))
        else:
            widths.append(F.lit(8))
    row_bytes = sum(widths[1:], widths[0]) if widths else F.lit(0)
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 F.coalesce(F.sum(row_bytes), F.lit(0)).alias("b")).first()
    return TableSize(int(row["n"]), int(row["b"]))


def fits_broadcast(size: TableSize, cfg: JoinConfig = DEFAULT_JOIN) -> bool:
    return size.rows <= cfg.broadcast_max_rows and size.bytes <= cfg.broadcast_max_bytes


def _key_condition(left: DataFrame, right_names: dict[str, str], null_safe: bool) -> Column:
    conds = []
    for k, rk in right_names.items():
        lc, rc = left[f"`{k}`"], F.col(f"`{rk}`")
        conds.append(lc.eqNullSafe(rc) if null_safe else lc == rc)
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str,
          null_safe: bool, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Equi-join on ``keys`` (+ ``extra_keys`` with plain equality), keeping the
    left key columns only."""
    renamed = {k: f"__tt_rk_{i}" for i, k in enumerate(keys)}
    r = right.withColumnsRenamed(renamed)
    cond = _key_condition(left, renamed, null_safe)
    for k in extra_keys:  # the right side carries them as __tt_r_<name>
        cond = cond & (left[k] == r[f"__tt_r_{k}"])
    out = left.join(r, cond, how)
    return out.drop(*renamed.values(), *[f"__tt_r_{k}" for k in extra_keys])


@dataclass(frozen=True)
class Stored:
    """A large side written once: its table (with the hash of its keys) and the hot
    keys, as hash and number of splits."""

    table: DataFrame
    hot: DataFrame
    keys: tuple[str, ...]
    types: tuple[T.DataType, ...]


def _hash_of(keys, types) -> Column:
    # NULL is a value here, and both sides are hashed in the type they are compared in.
    return F.xxhash64(*[F.col(f"`{k}`").cast(t) for k, t in zip(keys, types)])


def store_with_hot_keys(big: DataFrame, keys: list[str], small: DataFrame | None = None, where: Column | None = None,
                        name: str = "join-side") -> Stored:
    """Evaluate ``big`` once: write it, and find its hot keys.  ``small``:
    the table it will be joined to (for the common type of the keys); ``where``: the
    rows that the join will see (null: all)."""
    spark = big.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    side = big.select(*[F.col(f"`{k}`") for k in keys]).limit(0)
    types = side.schema if small is None else side.union(small.select(*[F.col(f"`{k}`") for k in keys]).limit(0)).schema
    types = tuple(f.dataType for f in types.fields)
    marked = big.withColumn(_HASH, _hash_of(keys, types))
    if where is not None:
        marked = marked.withColumn(_HASH, F.when(where, F.col(_HASH)))
    table = cut_lineage(marked, name)
    # At most 2 P keys are named; with 16 P of them tracked a key's error is below a
    # quarter of the share that makes it hot.  Only the hashes are read again.
    seen = table.agg(F.count(_HASH).alias("n"), F.expr(f"approx_top_k({_HASH}, {min(2 * partitions, 500_000)}, "
                                                       f"{min(max(256, 16 * partitions), 1_000_000)})").alias("top")).first()
    total, found = max(1, seen["n"]), seen["top"] or []
    splits = [(r["item"], math.ceil(r["count"] * partitions / total)) for r in found]
    hot = spark.createDataFrame([x for x in splits if x[0] is not None and x[1] > 1], f"{_HASH} long, {_NSALT} int")
    return Stored(table, hot, tuple(keys), types)


def attach(big: DataFrame, small: DataFrame, keys: list[str], *,
           how: str = "inner", null_safe: bool = True,
           cfg: JoinConfig = DEFAULT_JOIN, size: TableSize | None = None) -> DataFrame:
    """Join ``small`` (a materialised, derived table) to each row of ``big``."""
    if not keys:
        return _attach_constant(big, small, how)
    size = size or measure(small)
    if fits_broadcast(size, cfg):
        return _join(big, F.broadcast(small), keys, how, null_safe)
    if big.isStreaming:
        # A stream cannot be counted; its rows are joined unsalted.
        return _join(big, small, keys, how, null_safe)
    return join_stored(store_with_hot_keys(big, keys, small), small, how, null_safe)


def _attach_constant(big: DataFrame, small: DataFrame, how: str) -> DataFrame:
    """No key: ``small`` holds at most one row (one global topic).  Its values
    become literal columns -- no join at all.  With no row, an inner attach
    keeps no row (as a join would) and a left attach fills NULLs."""
    rows = small.limit(2).collect()
    if len(rows) > 1:
        raise ValueError("a table attached without keys must have at most one row")
    fields = small.schema.fields
    values = rows[0] if rows else [None] * len(fields)
    cols = {f.name: F.lit(v).cast(f.dataType) for f, v in zip(fields, values)}
    out = big.withColumns(cols)
    if not rows and how == "inner":
        out = out.filter(F.lit(False))
    return out


def join_stored(stored: Stored, small: DataFrame, how: str = "inner", null_safe: bool = True, where: Column | None = None) -> DataFrame:
    """The shuffle join of a stored side (its rows ``where``) to ``small``, hot keys salted."""
    keys, hot = list(stored.keys), F.broadcast(stored.hot)
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(_PLACE)
    big = stored.table.select("*", place)
    big = (big if where is None else big.filter(where)).join(hot, _HASH, "left")
    big = big.withColumn(_SALT, F.coalesce(F.pmod(F.col(_PLACE), F.col(_NSALT)), F.lit(0)).cast("int")).drop(_NSALT, _PLACE, _HASH)
    # A hot key's row of the small side is repeated once per salt value.
    copies = small.withColumn(_HASH, _hash_of(keys, stored.types)).join(hot, _HASH, "left")
    copies = copies.withColumn(f"__tt_r_{_SALT}", F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_NSALT), F.lit(1)) - 1))).drop(_NSALT, _HASH)
    return _join(big, copies, keys, how, null_safe, extra_keys=(_SALT,)).drop(_SALT)
