"""FM-index decontamination against brute force."""

import hashlib
import random
import re
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pytest

from topictone.llm import decontaminate as D
from topictone.llm.queries import op1_fm_decontaminate


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, n=10):
    wins = [(str(i), tuple(w[p:p + n])) for i, t in items if i is not None for w in [words(t)] if w
            for p in range(max(1, len(w) - n + 1))]
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for i, win in wins:
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p:p + len(win)]) == win:
                    found.add(i)
                    hit.update(range(p, p + len(win)))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_suffix_order_and_ranks():
    rng = np.random.default_rng(1)
    for _ in range(30):
        seq = np.append(rng.integers(0, 4, 200), 0).astype(np.int32)
        order = D.suffix_order(seq)
        assert sorted(order.tolist()) == list(range(len(seq)))
        cut = lambda i: (seq[i:].tolist() + [0])[:seq[i:].tolist().index(0) if 0 in seq[i:] else None]
        keys = [cut(i) for i in order]
        assert keys == sorted(keys)
        wm = D.WaveletMatrix(seq.astype(np.int64), 3)
        at = rng.integers(0, len(seq) + 1, 50)
        for s in range(4):
            assert wm.rank(np.full(50, s), at).tolist() == [int((seq[:a] == s).sum()) for a in at]
        inside = rng.integers(0, len(seq), 50)
        assert wm.access(inside).tolist() == seq[inside].tolist()


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(D, "SHARD_BYTES", 2000)
    rng = random.Random(seed)
    vocab = ["a", "B", "Été", "日本", "x1", "z"][:rng.randint(2, 6)]
    say = lambda k: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(k))
    items = [(i, say(rng.choice([0, 1, 3, 9, 10, 14]))) for i in range(6)] + [(None, say(12)), (77, None), (3, say(11))]
    docs = [(i, say(rng.randint(0, 60))) for i in range(60)] + [(5, items[3][1]), (None, "a a a"), (7, None), (8, "")] * 2
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", D_lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "BLOCK_BYTES", 150)
    got = [tuple(r)[:4] + (r.items_sha256, r.contaminated) for r in D.contamination(d, b).drop("spans").select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(brute(docs, items), key=key)


def D_lit(x):
    from pyspark.sql import functions as F
    return F.lit(x)


def test_spans_cut_and_empty(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Été before. {item.upper()}! after", "s"), (2, "clean text", "s"), (3, None, None)],
                                 "doc_id long, text string, spans string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in D.contamination(docs, bench).collect()}
    (span,) = got[1].spans
    assert f"Été before. {item.upper()}! after"[span.start:span.end] == item.upper()
    assert got[1].items == ["1"] and not got[2].contaminated
    cut = {r.doc_id: r for r in D.remove_contamination(docs, bench).collect()}
    assert cut[1].text == "Été before. ! after" and cut[2].text == "clean text" and cut[3].text is None
    assert cut[1].spans == "s"
    assert D.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert D.contamination(docs.limit(0), bench).count() == 0


def test_query_against_brute_force(spark, sf001):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf001}/benchmark.parquet").collect()]
    wins = {}
    for i, t in items:
        w = words(t)
        for p in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[p:p + 10]), set()).add(str(i))
    got = {r.doc_id: r for r in op1_fm_decontaminate(spark, sf001).collect()}
    assert any(r.contaminated for r in got.values())
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in {len(x) for x in wins}:
            for p in range(len(w) - k + 1):
                if tuple(w[p:p + k]) in wins:
                    found |= wins[tuple(w[p:p + k])]
                    hit.update(range(p, p + k))
        r = got[d]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(found), bool(hit))


def test_shard_holds_numbers_for_words():
    """Memory for a shard: no object for every occurrence of a word."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rng.choices(vocabulary, k=3000)) for _ in range(100)]
    texts[7] += " a b c d e f g h i j k"
    block = SimpleNamespace(value=D.Phrases([("x", "a b c d e f g h i j k")], 10))
    tracemalloc.start()
    try:
        found = D._check_shard(texts, [block])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [(n, items, int(hit.sum())) for n, items, hit in found] == [(3011, {"x"}, 11) if i == 7 else (3000, set(), 0) for i in range(100)]
    assert peak < 9 * sum(map(len, texts))   # 14.5 with the words as objects
