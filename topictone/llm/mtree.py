"""Exact top-k inner products by best-first search in M-trees.

The vectors are dealt into trees of bounded size.  A tree is a table row of
pages: a node keeps, for each entry, the routing vector, the covering radius and
the distance to the parent's routing vector; a leaf keeps its vectors and their
distances to its routing vector.  For a query q and a node with routing vector p
and radius r the inner product with anything below is at most
``q.p + |q| * r`` (Cauchy-Schwarz), which orders the best-first search.  Before
``q.c`` of a child c is computed, the stored parent distance bounds it by the
triangle inequality: ``q.c + |q| r_c <= q.p + |q| * (d(c, p) + r_c)``; entries
whose bound is below the k-th best score are skipped uncomputed.  Equal bounds
are kept, so ties are whole.

Queries are taken in blocks of at most QUERY_BLOCK rows, each broadcast by
itself, against all trees; each tree gives its k best, which are merged.

Vectors that are null, or hold a null or a non-finite component, and rows with a
null id take no part.  A shorter vector counts as padded with zeros.  Repeated
rows are candidates each; a row never competes for a query with its own id; a
repeated query row is one query.  Scores are exact integers, clamped to the
range of long.  Empty tables give empty tables.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_path
from .common import collected, write_shared

TREE_ROWS, LEAF, FAN, QUERY_BLOCK = 20_000, 1024, 24, 4096
LONG = 1 << 63


def _slack(x):
    """Distances and bounds rounded up, so rounding never prunes a result."""
    return x * (1 + 1e-9) + 1e-6


class MTree:
    """pages: list of (is_leaf, entries); a leaf's entries are a range of rows
    (rows are stored leaf by leaf) and their parent distances, a node's are child
    pages, routing rows, radii and parent distances."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray):
        self.ids, self.copies, self.vectors = ids, copies, vectors
        size = float(np.abs(vectors).max(initial=0))
        self.safe = size * size * max(1, vectors.shape[1]) < 2.0**52
        self.top = size
        self.pages: list[tuple] = []
        everything = np.arange(len(ids))
        pivot = int(everything[0])
        self.root, self.pivot = self._build(everything, pivot, np.random.default_rng(0)), pivot
        self.radius = float(_slack(self._distances(everything, pivot).max()))
        order = np.concatenate([p[1] for p in self.pages if p[0]])
        place = np.empty(len(order), np.int64)
        place[order] = everything
        self.ids, self.copies, self.vectors, self.pivot = ids[order], copies[order], vectors[order], int(place[pivot])
        at = 0
        for n, page in enumerate(self.pages):
            if page[0]:
                self.pages[n] = (True, np.arange(at, at + len(page[1])), page[2])
                at += len(page[1])
            else:
                self.pages[n] = (*page[:2], place[page[2]], *page[3:])

    def _distances(self, rows: np.ndarray, pivot: int) -> np.ndarray:
        return np.linalg.norm(self.vectors[rows] - self.vectors[pivot], axis=1)

    def _leaf(self, rows: np.ndarray, pivot: int) -> int:
        self.pages.append((True, rows, _slack(self._distances(rows, pivot))))
        return len(self.pages) - 1

    def _build(self, rows: np.ndarray, pivot: int, rng) -> int:
        if len(rows) <= LEAF:
            return self._leaf(rows, pivot)
        chosen = rng.choice(rows, FAN, replace=False)
        gaps = np.stack([self._distances(rows, c) for c in chosen], 1)
        near = gaps.argmin(1)
        if (near == near[0]).all():  # all (nearly) equal: cut in pages
            near = np.arange(len(rows)) * FAN // len(rows)
        child, radius, route = [], [], []
        for f in range(FAN):
            own = near == f
            if own.any():
                c = int(chosen[f])
                child.append(self._build(rows[own], c, rng))
                route.append(c)
                radius.append(gaps[own, f].max())
        route = np.array(route)
        self.pages.append((False, np.array(child), route, _slack(np.array(radius)), _slack(self._distances(route, pivot))))
        return len(self.pages) - 1

    def products(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        return self.vectors[rows] @ q

    def best_rows(self, rows: np.ndarray, q: np.ndarray, query_id: int, k: int) -> list[tuple[int, int]]:
        """(exact score, row) of the k best of a page's rows with another id,
        best first, ties by id."""
        own = self.ids[rows] == query_id
        if own.any():
            rows = rows[~own]
        if not (self.safe and self.top * float(np.abs(q).max(initial=0)) * max(1, len(q)) < 2.0**52):
            whole = [int(x) for x in q]
            exact = sorted((-sum(int(a) * b for a, b in zip(self.vectors[r], whole)), int(self.ids[r]), int(r)) for r in rows)
            return [(-s, r) for s, _, r in exact[:k]]
        whole_page = len(rows) and int(rows[-1] - rows[0]) == len(rows) - 1  # rows of a page ascend
        scores = self.vectors[rows[0]:rows[-1] + 1] @ q if whole_page else self.products(rows, q)
        if len(rows) > k:
            some = scores >= np.partition(scores, len(rows) - k)[len(rows) - k]
            rows, scores = rows[some], scores[some]
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return [(int(s), r) for s, r in zip(scores[order], rows[order].tolist())]

    def search(self, query_id: int, q: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (score, id) of rows with another id; ties to smaller ids."""
        width = self.vectors.shape[1]
        q = np.pad(q, (0, max(0, width - len(q))))[:width]
        norm = float(_slack(np.linalg.norm(q)))
        best: list[tuple[int, int]] = []  # heap of (score, -id)
        start = float(self.vectors[self.pivot] @ q)
        heap = [(-(start + norm * self.radius), 0, self.root, start)]
        floor, pushed = -math.inf, 0
        while heap:
            bound, _, page, parent = heapq.heappop(heap)
            if -bound < floor:
                break
            entry = self.pages[page]
            if entry[0]:
                _, rows, gap = entry
                rows = rows[_up(parent + norm * gap) >= floor]
                for score, row in self.best_rows(rows, q, query_id, k):
                    for _ in range(min(int(self.copies[row]), k)):
                        pair = (score, -int(self.ids[row]))
                        if len(best) < k:
                            heapq.heappush(best, pair)
                        elif pair > best[0]:
                            heapq.heapreplace(best, pair)
                        else:
                            break
                if len(best) == k:
                    floor = float(best[0][0]) * (1 - 1e-12) - 1 if abs(best[0][0]) >= 2**52 else float(best[0][0])
            else:
                _, child, route, radius, gap = entry
                some = np.flatnonzero(_up(parent + norm * (gap + radius)) >= floor)
                near = self.products(route[some], q)
                limit = _up(near + norm * radius[some])
                for c, p, b in zip(child[some].tolist(), near.tolist(), limit.tolist()):
                    if b >= floor:
                        pushed += 1
                        heapq.heappush(heap, (-b, pushed, c, p))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def _up(x):
    return x + np.abs(x) * 1e-9 + 1e-6


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _trees(vectors: DataFrame) -> DataFrame:
    """One row per tree: its pickled pages."""
    buckets = max(1, -(-vectors.count() // TREE_ROWS))

    def build(frame):
        import pandas as pd

        width = int(frame["v"].map(len).max())
        tree = MTree(frame["id"].to_numpy(), frame["copies"].to_numpy(), _matrix(list(frame["v"]), width))
        return pd.DataFrame({"tree": [pickle.dumps(tree)]})

    return (vectors.withColumn("bucket", F.pmod(F.xxhash64("id", "v"), F.lit(buckets)))
            .groupBy("bucket").applyInPandas(build, "tree binary"))


def _search_block(trees: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    shared = trees.sparkSession.sparkContext.broadcast([(int(i), np.array(v, np.float64)) for i, v in queries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                tree = pickle.loads(cell.as_py())
                out = [(n, q_id, i, max(-LONG, min(LONG - 1, s))) for n, (q_id, q) in enumerate(shared.value)
                       for s, i in tree.search(q_id, q, k)]
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in range(4)],
                                                 ["n", "query_id", "vec_id", "score"])

    return trees.mapInArrow(run, "n long, query_id long, vec_id long, score long")


def exact_top_k(table: DataFrame, is_query, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of
    ``floor(256 * x)`` vectors for each row that satisfies ``is_query`` (a
    condition on the id column) among all rows with another id."""
    v, i = F.col(f"`{vector_col}`"), F.col(f"`{id_col}`")
    valid = i.isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # floor() of Spark gives a long; beyond its range a double is whole anyway.
    whole = F.transform(v, lambda x: F.when(F.abs(x.cast("double")) < F.lit(2.0**53 / 256), F.floor(F.lit(256.0) * x.cast("double")).cast("double"))
                        .otherwise(F.lit(256.0) * x.cast("double")))
    vectors = write_shared(table.filter(valid).select(i.cast("long").alias("id"), whole.alias("v"), is_query.alias("asks"))
                           .groupBy("id", "v", "asks").agg(F.count(F.lit(1)).alias("copies")), "vectors")
    trees = write_shared(_trees(vectors.select("id", "v", "copies")), "mtrees")
    path = shared_path(table.sparkSession, "top-k")
    table.sparkSession.createDataFrame([], "block int, n long, query_id long, vec_id long, score long").write.parquet(path)
    for block, rows in enumerate(collected(vectors.filter("asks").select("id", "v"), QUERY_BLOCK, lambda r: 1)):
        _search_block(trees, rows, k).withColumn("block", F.lit(block)).write.mode("append").parquet(path)
    found = table.sparkSession.read.parquet(path)
    order = Window.partitionBy("block", "n", "query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
