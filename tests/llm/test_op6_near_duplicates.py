"""Near duplicates against brute force over all pairs."""

import random
import re

import numpy as np
import pytest

from topictone.llm import near_duplicates as N
from topictone.llm import sketch as K
from topictone.llm.components import components


def shingle_set(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent):
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                c = len(sets[a] & sets[b])
                if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                    root[find(a)] = find(b)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, len(sets[i]), low.get(find(i)), d == low.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, families=6, size=25):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeÉf") for _ in range(4))
    rows = []
    for _ in range(families):
        base = [word() for _ in range(rng.randint(3, 120))]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                text[rng.randrange(len(text))] = word()
            rows.append(rng.choice([" ", "\n"]).join(text))
    rows += ["", "  \n", "one", "ONE", "one two"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (0, 1, 3, 50, 700, 5000)]
    s = K.sketches(sets, 160)
    assert (s[0] == 0).all() and (s[1] != 0).any()
    for i, one in enumerate(sets):  # a sketch does not depend on its neighbours
        assert (K.sketches([one], 160)[0] == s[i]).all()
    base = np.unique(rng.integers(0, 2**63, 2000, dtype=np.uint64))
    errors = []
    for share in (0.2, 0.5, 0.8):
        keep = base[: int(len(base) * share)]
        a, b = K.sketches([base, keep], 160)
        errors.append(abs((a == b).mean() - share))
    assert max(errors) < 0.15


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(330)]
    edges = [(a, b) for a, b in edges if a != b] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("seed, group", [(0, 2000), (1, 7), (2, 3)])
def test_against_brute_force(spark, monkeypatch, seed, group):
    monkeypatch.setattr(N, "GROUP", group)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, c string").repartition(3)
    got = sorted((tuple(r) for r in N.near_duplicates(df, k=4).collect()), key=str)
    assert got == brute(rows, 4, 80)


def test_edges(spark):
    rows = [(1, None), (1, None), (None, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, "A b C d e f g"),
            (4, "x " * 60_000 + "end"), (5, "x " * 60_000 + "end"), (None, "only null here"), (6, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in N.near_duplicates(df).collect()), key=str)
    want = brute(rows, 5, 80)
    want = sorted([(d, n, d if n == 0 else low, d == (d if n == 0 else low)) for d, n, low, _ in want], key=str)
    assert got == want
    kept = N.keep_one_of_each(df).collect()
    assert sorted((str(r.doc_id), (r.text or "")[:5]) for r in kept) == [("1", ""), ("2", "a b c"), ("4", "x x x"), ("6", "z"), ("None", "only ")]
    assert N.near_duplicates(df.limit(0)).count() == 0
    assert N.keep_one_of_each(df.limit(0)).columns == ["doc_id", "text"]
