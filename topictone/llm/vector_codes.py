"""Vector code compression: product codes whose nearest entries come from Orchard
search.

A vector becomes integers ``floor(scale * x)`` and is cut into equal consecutive
parts; every part position has a codebook.  Orchard search keeps, for every entry,
the list of all entries by their distance to it.  A search holds the best entry so
far and walks that entry's list: an entry already visited is skipped, a better one
is jumped to (its list is walked from the start), and the walk stops at the first
entry beyond twice the current distance, since by the triangle inequality nothing
from there on can be nearer.  Distances are compared as integer squares, so
the result, ties to the lower index included, is that of a full comparison.

A codebook starts with the parts of the smallest ids.  A round assigns all parts and
replaces every entry by the floor of its parts' mean; tasks add up sums and counts per
entry, Spark sums those, and only the codebooks (parts x entries x width
integers, whatever the number of vectors) are on the driver and sent out.

Vectors that are null, or hold a null or a non-finite component, are dropped.  A
shorter vector counts as padded with zeros to the longest, and all to a multiple of
the number of parts.  Components are clamped at +-2^53; errors at the range of long.
Null ids come last in the order of ids and equal ids are ordered by vector; repeated
rows count each and give a row each.  Fewer vectors than entries give fewer
entries.  Null labels are one label.  An empty table gives an empty table.  Other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import attach
from .common import write_shared

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows that are searched together.
BATCH = 4096
WHOLE, LONG = 2.0**53, (1 << 63) - 1


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    gap = a - b
    return (gap * gap).sum(-1)


class Orchard:
    """Distance-sorted neighbour lists of the entries of one codebook."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gaps = _squares(entries[:, None], entries[None])
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, 1)
        self.start = int(gaps.sum(1).argmin())
        self.computed = 0

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of every point."""
        n, k = len(points), len(self.entries)
        best = np.full(n, self.start)
        near = _squares(points, self.entries[self.start])
        seen = np.zeros((n, k), bool)
        seen[:, self.start] = True
        place = np.zeros(n, np.int64)
        self.computed += n
        live = np.arange(n)
        while len(live):
            live = live[place[live] < k]
            held, at = best[live], place[live]
            reach = self.gaps[held, at] <= 4 * near[live]
            live, other = live[reach.astype(bool)], self.order[held, at][reach.astype(bool)]
            place[live] += 1
            fresh = ~seen[live, other]
            rows, other = live[fresh], other[fresh]
            seen[rows, other] = True
            self.computed += len(rows)
            gap = _squares(points[rows], self.entries[other])
            better = ((gap < near[rows]) | ((gap == near[rows]) & (other < best[rows]))).astype(bool)
            rows = rows[better]
            best[rows], near[rows], place[rows] = other[better], gap[better], 0
        return best, near


def _matrix(column: pa.Array, width: int, exact: bool) -> np.ndarray:
    """(rows, width) integers of a list column, shorter rows padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None] < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out.astype(object) if exact else out


def _pieces(batches: Iterator[pa.RecordBatch], parts: int, width: int, exact: bool):
    """Bounded slices of a task's rows with their (rows, parts, width / parts) integers."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            piece = batch.slice(at, BATCH)
            yield piece, _matrix(piece.column("v"), width, exact).reshape(piece.num_rows, parts, width // parts)


def _round_sums(rows: DataFrame, books: np.ndarray, exact: bool) -> dict[tuple[int, int, int], tuple[int, int]]:
    """(part, entry, place) -> count and component sum of the entry's parts."""
    parts, k, w = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Orchard(b) for b in books]
        sums = np.zeros(books.shape, books.dtype)
        counts = np.zeros((parts, k), np.int64)
        for _, vectors in _pieces(batches, parts, parts * w, exact):
            for p, tree in enumerate(trees):
                entry, _ = tree.nearest(vectors[:, p])
                np.add.at(sums[p], entry, vectors[:, p])
                counts[p] += np.bincount(entry, minlength=k)
        found = [(p, e, j) for p, e in zip(*np.nonzero(counts)) for j in range(w)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[c] for f in found], pa.int32()) for c in range(3)]
            + [pa.array([int(counts[p, e]) for p, e, _ in found], pa.int64()),
               pa.array([Decimal(int(sums[f])) for f in found], pa.decimal128(38, 0))], ["part", "entry", "place", "n", "total"])

    tasks = rows.select("v").mapInArrow(run, "part int, entry int, place int, n long, total decimal(38,0)")
    summed = tasks.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"))
    return {(r["part"], r["entry"], r["place"]): (r["n"], int(r["total"])) for r in summed.collect()}


def _coded(rows: DataFrame, books: np.ndarray, exact: bool) -> DataFrame:
    """id, label, code, error of every row by the final codebooks."""
    parts, _, w = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Orchard(b) for b in books]
        for piece, vectors in _pieces(batches, parts, parts * w, exact):
            found = [tree.nearest(vectors[:, p]) for p, tree in enumerate(trees)]
            digits = np.stack([e for e, _ in found], 1).astype(np.uint8).tobytes().hex()
            error = [min(LONG, int(x)) for x in sum(d for _, d in found)]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array([digits[i:i + 2 * parts] for i in range(0, len(digits), 2 * parts)], pa.string()),
                 pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def vector_codes(table: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
                 id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, code, error, label_error, codebooks_sha256 of every kept row."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    v = F.col(f"`{vector_col}`")
    valid = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.lit(-WHOLE), F.least(F.lit(WHOLE), F.lit(float(scale)) * x.cast("double")))))
    rows = write_shared(table.filter(valid).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"),
                                                   whole.alias("v")), "vector-rows")
    shape = rows.agg(F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()
    width = -(-int(shape["width"] or 0) // parts) * parts
    exact = 4 * (width // parts) * (2 * int(shape["top"] or 0) + 2) ** 2 >= 1 << 62   # beyond 64 bits: Python integers
    first = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()
    if first:
        books = _matrix(pa.array([r["v"] for r in first], pa.list_(pa.int64())), width, exact)
        books = np.ascontiguousarray(books.reshape(len(first), parts, width // parts).transpose(1, 0, 2))
        for _ in range(rounds):
            for place, (n, total) in _round_sums(rows, books, exact).items():
                books[place] = total // n
    else:
        books = np.zeros((parts, 1, 0), np.int64)
    sha = hashlib.sha256(",".join(str(x) for x in books.ravel()).encode()).hexdigest()
    coded = write_shared(_coded(rows, books, exact), "vector-codes")
    sums = write_shared(coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)"))
                                                   .cast("long").alias("label_error")), "vector-label-errors")
    return (attach(coded, sums, ["label"]).withColumn("codebooks_sha256", F.lit(sha))
            .select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error", "label_error", "codebooks_sha256"))
