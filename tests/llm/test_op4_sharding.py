"""Differencing shards: the law, whole groups, gapless slots."""

import random
import zlib
from collections import defaultdict

import pytest

from topictone.llm import sharding
from topictone.llm.queries import op4_karmarkar_karp


def plain_differencing(sizes, k):
    """Vectors of item lists, combined as stated; returns the sums."""
    parts = [sorted([[s, [i]]] + [[0, []] for _ in range(k - 1)], key=lambda p: -p[0]) for i, s in enumerate(sizes)]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0][0] - p[-1][0])
        a, b = parts.pop(), parts.pop()
        parts.append(sorted([[x[0] + y[0], x[1] + y[1]] for x, y in zip(a, reversed(b))], key=lambda p: -p[0]))
    return [p[0] for p in parts[0]]


@pytest.mark.parametrize("k", [1, 2, 5, 16])
def test_differencing(k):
    rng = random.Random(k)
    for n in (1, 2, 7, 60):
        sizes = [rng.randint(1, 10**6) for _ in range(n)]  # distinct spreads
        part = sharding.karmarkar_karp(sizes, k)
        sums = [sum(s for s, p in zip(sizes, part) if p == j) for j in range(k)]
        assert sorted(sums) == sorted(plain_differencing(sizes, k))
    assert sharding.karmarkar_karp([], k) == []
    assert sharding.karmarkar_karp([8, 7, 6, 5, 4], 2).count(0) in (2, 3)


def check(rows, got, k=16):
    assert len(got) == len(rows)
    shard_of, slots, load = {}, defaultdict(list), defaultdict(int)
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append((t or "").encode())
    for r in got:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < k
        data = [t for t in texts[r.doc_id] if len(t) + 1 == r.size and zlib.crc32(t) == r.text_crc32]
        assert data
        assert shard_of.setdefault((r.size, r.text_crc32), r.shard) == r.shard
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return load


def test_edges(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(0, 300)) for i in range(3000)]
    rows += [(None, "null id"), (None, "null id"), (5, None), (6, ""), (7, "é" * 100), (7, "é" * 100)]
    rows += [(10_000 + i, "copies " * 20) for i in range(1500)]
    df = spark.createDataFrame([(*r, 3, 4) for r in rows], "doc_id long, text string, shard int, h int").repartition(5)
    load = check(rows, sharding.balanced_shards(df).collect())
    big = 1500 * (len("copies " * 20) + 1)
    others = sorted(load.values())[:-1]
    assert max(load.values()) == big and max(others) - min(others) <= 500
    assert sharding.balanced_shards(df.limit(0)).count() == 0


def test_query(spark, sf01):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()]
    load = check(rows, op4_karmarkar_karp(spark, sf01).collect())
    assert len(load) == 16 and max(load.values()) < 1.01 * min(load.values())
