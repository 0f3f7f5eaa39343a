"""Balanced shards by Karmarkar-Karp differencing.

Documents with equal texts are one indivisible group.  Differencing starts with
every item as a partial partition of its own (its size in one of k places, zero
in the others) and repeatedly combines the two partial partitions with the
largest spread, the one's largest place with the other's smallest and so on.

The items of the heap are bounded in number whatever the corpus holds.  A group
of more than 1/ITEMS of all bytes is an item (at most ITEMS such groups exist);
all other groups are pooled by a hash of the text into at most ITEMS pools, and a
pool is an item.  With few documents a pool is mostly one group.  So the driver
sees at most 2 * ITEMS sizes, the item-to-shard tables that are broadcast have
at most that many rows, and a group stays in one shard.

Law: ``bytes`` (shards near equal in bytes).  One group with more than 1/k of all
bytes makes its shard that large; the others then share the rest evenly.

Null texts have size 1 and are one group with the empty texts.  Null and repeated
ids are rows like others.  An empty table gives an empty table.  Slots number
the rows of a shard from 0 without gaps: rows are dealt into cells by text and id,
numbered within the cell, and moved by the sizes of the cells before.  Rows that
are equal in all columns are numbered in any order.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts_of, write_shared

#: Groups above 1/ITEMS of all bytes and pools of the others, at most as many each.
ITEMS = 8192
#: Cells of a shard at least, and rows of a cell that call for more.
CELLS, CELL_ROWS = 64, 500_000


def karmarkar_karp(sizes: list[int], k: int) -> list[int]:
    """The part, 0 to k - 1, of each item."""
    if not sizes:
        return []
    heap = [(-s, i, (s, *[0] * (k - 1))) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    joins: list[tuple[int, int, list[int]]] = []
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        z = [p + q for p, q in zip(x, reversed(y))]
        order = sorted(range(k), key=z.__getitem__, reverse=True)
        total = tuple(z[j] for j in order)
        heapq.heappush(heap, (total[-1] - total[0], len(sizes) + len(joins), total))
        joins.append((a, b, order))
    # Down the tree: the part of each place of a partial partition.
    places = {heap[0][1]: list(range(k))}
    for node in range(len(sizes) + len(joins) - 1, len(sizes) - 1, -1):
        a, b, order = joins[node - len(sizes)]
        own, left, right = places.pop(node), [0] * k, [0] * k
        for at, j in enumerate(order):
            left[j] = right[k - 1 - j] = own[at]
        places[a], places[b] = left, right
    return [places[i][0] for i in range(len(sizes))]


def balanced_shards(docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    # The texts are read once; ids, sizes and text digests are kept.
    rows = write_shared(texts_of(docs, id_col, text_col).select(
        F.col(f"`{id_col}`").alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("crc"), F.unhex(F.md5(text)).alias("h")), "shard-rows")
    groups = write_shared(rows.groupBy("h").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "shard-groups")
    total = groups.agg(F.sum("bytes").alias("b"), F.sum("n").alias("n")).first()
    big = F.col("bytes") * F.lit(ITEMS) > F.lit(total["b"] or 0)
    pool = F.pmod(F.xxhash64("h"), F.lit(ITEMS)).cast("int")
    heavy = [tuple(r) for r in groups.filter(big).orderBy("h").select("h", "bytes").collect()]
    pools = [tuple(r) for r in groups.filter(~big).groupBy(pool.alias("pool")).agg(F.sum("bytes")).orderBy("pool").collect()]
    part = karmarkar_karp([int(b) for _, b in heavy] + [int(b) for _, b in pools], shards)
    of_heavy = spark.createDataFrame([(bytes(h), p) for (h, _), p in zip(heavy, part)], "h binary, heavy_shard int")
    of_pool = spark.createDataFrame([(c, p) for (c, _), p in zip(pools, part[len(heavy):])], "pool int, pool_shard int")
    cells = max(CELLS, -(-int(total["n"] or 0) // CELL_ROWS))
    placed = (rows.withColumn("pool", pool)
              .join(F.broadcast(of_heavy), "h", "left").join(F.broadcast(of_pool), "pool", "left")
              .withColumn("shard", F.coalesce("heavy_shard", "pool_shard"))
              .withColumn("cell", F.pmod(F.xxhash64("h", "id"), F.lit(cells)).cast("int")))
    # At most shards * cells rows: one per cell, with the rows of the cells before.
    before = (placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)))
              .select("shard", "cell", F.coalesce("before", F.lit(0)).alias("before")))
    own = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("h", "id")) - 1
    return (placed.withColumn("own", own).join(F.broadcast(before), ["shard", "cell"])
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
                    (F.col("before") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
