"""Product codes by Orchard search against a full comparison in plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from topictone.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, code int, id string"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    ok = [(i, [math.floor(scale * float(x)) for x in v], lab) for i, v, lab in rows
          if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in ok), default=0) // parts) * parts
    ok = [(i, v + [0] * (width - len(v)), lab) for i, v, lab in ok]
    w = width // parts
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, v, _ in ok]
    order = sorted(range(len(ok)), key=lambda n: (ok[n][0] is None, ok[n][0] or 0, ok[n][1]))[:entries]
    books = [[list(cut[n][p]) for n in order] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for c in cut:
                own.setdefault(near(c[p], books[p])[1], []).append(c[p])
            for e, xs in own.items():
                books[p][e] = [sum(col) // len(xs) for col in zip(*xs)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    by_label = {}
    for (_, _, lab), f in zip(ok, found):
        by_label[lab] = by_label.get(lab, 0) + sum(d for d, _ in f)
    return sorted((repr(i), "".join("%02x" % e for _, e in f), sum(d for d, _ in f), by_label[lab], sha) for (i, _, lab), f in zip(ok, found))


def got(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, lab, 1, "x") for i, v, lab in rows], SCHEMA).repartition(5)
    out = vc.vector_codes(df, **kw).collect()
    return sorted((repr(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in out)


@pytest.mark.parametrize("seed", range(3))
def test_against_full_comparison(spark, seed):
    rng = random.Random(seed)
    dim = [16, 8, 21][seed]
    rows = [(i, [float(np.float32(rng.gauss(0, 0.3))) for _ in range(dim)], rng.choice([0, 1, None])) for i in range(240)]
    rows += [(500 + i, [0.25] * dim, 1) for i in range(100)]            # one very common vector
    rows += [(900, None, 1), (901, [None] * dim, 1), (902, [math.nan] * dim, 1), (903, [-math.inf] * dim, None),
             (None, [0.5] * dim, None), (7, rows[7][1], rows[7][2]), (7, [0.125] * dim, 0), (950, [], 0), (951, [0.1] * (dim // 2), 0)]
    rng.shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_few_rows_empty_tables_and_huge_components(spark):
    rows = [(3, [1.0] * 8, None), (1, [2.0] * 8, None)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == [] and got(spark, [(1, None, 1)]) == []
    assert [r[1] for r in got(spark, [(1, [], 1), (2, [], 1)])] == ["00" * 8] * 2
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) * 1e9 for _ in range(8)], i % 2) for i in range(60)]   # squares beyond 64 bits in sums
    assert got(spark, rows, entries=4, rounds=2) == [(a, b, min(c, vc.LONG), min(d, vc.LONG), e) for a, b, c, d, e in brute(rows, entries=4, rounds=2)]
    rows = [(1, [1e300] * 8, 1), (2, [-1e300] * 8, 1), (3, [0.0] * 8, 1)]
    assert len(got(spark, rows)) == 3 and {r[1] for r in got(spark, rows)} == {"00" * 8, "01" * 8, "02" * 8}


def test_the_search_leaves_entries_out_and_ties_go_to_the_lower_index():
    rng = np.random.default_rng(0)
    entries = rng.integers(-4000, 4000, (64, 4))
    entries[40] = entries[3]
    points = entries[rng.integers(0, 64, 5000)] + rng.integers(-60, 60, (5000, 4))
    points[:20] = (entries[10] + entries[20]) // 2
    tree = vc.Orchard(entries)
    index, gap = tree.nearest(points)
    every = ((points[:, None] - entries[None]) ** 2).sum(-1)
    assert (index == every.argmin(1)).all() and (gap == every.min(1)).all()
    assert not (index == 40).any() and tree.computed < 0.6 * every.size
