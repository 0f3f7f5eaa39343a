"""Context mixing: the code, the online mixer and the counts against plain loops."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from topictone.llm import context_mixing as M
from topictone.llm.queries import op10_context_mixing


def plain_tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def brute(rows):
    c = Counter(t for d, text in rows if not held(d) for t in plain_tokens(text))
    n, v = sum(c.values()), len(c)
    return [(d, held(d), len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts))
            for d, text in rows for ts in [plain_tokens(text)]]


def fold7(name="doc_id"):
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def test_code_is_a_prefix_code():
    head = [(f"w{i}".encode(), 1000 // (i + 1)) for i in range(300)]
    code = M.Code.of(head, 50)
    paths = [tuple(code.bit[b:b + n].tolist()) for b, n in zip(code.begin, code.length)]
    assert len(set(paths)) == 301 and sum(2.0 ** -len(p) for p in paths) == pytest.approx(1)
    # order 0 alone gives about the unigram probabilities
    weights = np.array([51] + [n for _, n in head])
    for s in (0, 1, 40, 300):
        at = slice(code.begin[s], code.begin[s] + code.length[s])
        z = code.logit[code.node[at]].astype(float)
        logp = -np.logaddexp(0, np.where(code.bit[at] == 1, -z, z)).sum()
        assert logp == pytest.approx(math.log(weights[s] / weights.sum()), abs=0.3)


def test_online_mixing_by_a_plain_loop():
    rng = np.random.default_rng(0)
    mixer = M.Mixer([], [], rng.normal(0.3, 0.2, (M.GATES, M.INPUTS)))
    begin = np.array([0, 700, 700, 1900, 1950])
    x = rng.normal(size=(M.INPUTS, 1950)).astype(np.float32)
    gate, bit = rng.integers(0, M.GATES, 1950).astype(np.int8), rng.integers(0, 2, 1950).astype(np.int8)
    got = mixer.log_probability(x, gate, bit, begin)
    for t, (a, b) in enumerate(zip(begin, begin[1:])):
        w, total = mixer.weights.copy(), 0.0
        for at in range(a, b, M.BLOCK):
            change = np.zeros_like(w)
            for i in range(at, min(b, at + M.BLOCK)):
                z = w[gate[i]] @ x[:, i]
                total += -np.logaddexp(0, -z if bit[i] else z)
                change[gate[i]] += (bit[i] - 1 / (1 + math.exp(-z))) * x[:, i]
            w += M.RATE * change
        assert got[t] == pytest.approx(total, rel=1e-4, abs=1e-6)


@pytest.mark.parametrize("head", [8, 1 << 17])
def test_counts_against_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(M, "HEAD", head)
    rng = np.random.default_rng(3)
    rows = [(int(i), " ".join(f"W{int(x)}é" for x in rng.zipf(1.4, rng.integers(0, 80)) if x < 500)) for i in range(150)]
    rows += [(500, None), (500, None), (501, ""), (None, "w1é odd"), (502, "long" * 40_000 + " W1é\t\x0bw2é"), (503, "w1é " * 5000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, row string").repartition(3)
    got = M.mixing_scores(df, fold7()).collect()
    key = lambda r: (str(r[0]), r[2])
    for r, w in zip(sorted(got, key=key), sorted(brute(rows), key=key)):
        assert tuple(r)[:5] == w[:5] and r.base_score == pytest.approx(w[5], rel=1e-9)
        assert r.score < 0 and r.bits_per_byte > 0
    assert M.mixing_scores(df.limit(0), fold7()).count() == 0
    none = M.mixing_scores(df, F.lit(True)).collect()
    assert {r.train_tokens for r in none} == {0} and {r.score for r in none} == {0.0}


def test_a_score_does_not_depend_on_other_held_out_rows(spark):
    rows = [(i, f"the cat number {i % 7} sat on the mat " * 9) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held_ids = [i for i, _ in rows if held(i)]
    one = {r.doc_id: r.score for r in M.mixing_scores(df.repartition(5), fold7()).collect()}
    two = {r.doc_id: r.score for r in M.mixing_scores(df.filter(~F.col("doc_id").isin(held_ids[1:])).coalesce(1), fold7()).collect()}
    assert one[held_ids[0]] == pytest.approx(two[held_ids[0]], rel=1e-6)


def test_query_held_out(spark, sf01):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()]
    got = {r.doc_id: r for r in op10_context_mixing(spark, sf01).collect()}
    for w in brute(rows):
        r = got[w[0]]
        assert tuple(r)[:5] == w[:5] and r.base_score == pytest.approx(w[5], rel=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_first_weights_are_fitted_on_all_rows(spark):
    rng = np.random.default_rng(5)
    # every text is longer than 64 KB; "a" and "b" take turns, so order 1 tells the next word
    rows = [(i, ("a b " * 9000 if i % 2 else "b a " * 9000) + " ".join(f"c{x}" for x in rng.integers(0, 40, 9000))) for i in range(4)]
    docs = spark.createDataFrame([(i, t, False) for i, t in rows], "id long, text string, held_out boolean").repartition(3)
    counts = Counter(w for _, t in rows for w in M.tokens(t))
    code = M.Code.of(sorted(counts.items(), key=lambda x: (-x[1], x[0])), 0)
    shared = spark.sparkContext.broadcast(code)
    slots = M._count_slots(docs, shared)
    got = M._first_weights(docs, shared, slots)
    symbols, first, _ = M._flat(code, [M.tokens(t) for _, t in rows])
    node, bit, where, _ = code.decisions(symbols, first)
    x, level = [code.logit[node].astype(float)], []
    for order in range(2):
        n = slots[order][where[order]]
        n[np.arange(len(bit)), bit] -= 1
        x.append(M._odds(n[:, 0], n[:, 1]))
        level.append(M._level(n.sum(1)))
    x, gate = np.stack(x, 1), level[0] * 3 + level[1]
    assert {8} <= set(gate.tolist())
    for g in range(M.GATES):
        xs, y = x[gate == g], bit[gate == g]
        slope = xs.T @ (y - 1 / (1 + np.exp(-xs @ got[g]))) - M.RIDGE * (got[g] - np.array([1.0, 0, 0]))
        hess = (xs.T * np.exp(-np.logaddexp(0, xs @ got[g]) - np.logaddexp(0, -xs @ got[g]))) @ xs + M.RIDGE * np.eye(M.INPUTS)
        assert np.abs(np.linalg.solve(hess, slope)).max() < M.SETTLED
    assert np.abs(got[8] - [1, 0, 0]).max() > 0.3


def test_short_texts_are_refined(monkeypatch):
    rng = np.random.default_rng(6)
    mixer = M.Mixer([], [], np.full((M.GATES, M.INPUTS), 0.3))
    x, bit = rng.normal(size=(M.INPUTS, 100)).astype(np.float32), rng.integers(0, 2, 100).astype(np.int8)
    run = lambda: mixer.log_probability(x, np.zeros(100, np.int8), bit, np.array([0, 100]))[0]
    refined = run()
    monkeypatch.setattr(M, "RATE", 0.0)
    assert refined != run()


def test_token_ids_are_those_of_plain_tokens():
    for texts in ([None, "", " a  B\t\x0b\nc ", "É x" * 30, "long" * 40 + " A", "\x1c\x85 q r", "  ", "a a A"], [None], ["x" * 65]):
        distinct, ids, sizes = M.token_ids(pa.chunked_array([texts], pa.string()))
        assert sizes.tolist() == [len(M.tokens(t)) for t in texts]
        assert [distinct[i].as_py() for i in ids.tolist()] == [w for t in texts for w in M.tokens(t)]


@pytest.mark.parametrize("slots", [3, 400])
def test_scores_by_parts_are_those_of_whole_texts(monkeypatch, slots):
    rng = np.random.default_rng(7)
    code = M.Code.of([(f"w{i}".encode(), 2000 // (i + 1)) for i in range(200)], 50)
    sizes = np.array([1, 900, 1, 40, 333, 2500, 7])
    symbols = rng.integers(0, 201, sizes.sum()).astype(np.int32)
    first, begin = M._row_marks(sizes)
    level = [rng.integers(0, slots, M.SLOTS).clip(0, 2).astype(np.int8) for _ in range(2)]
    mixer = M.Mixer([rng.normal(size=M.SLOTS).astype(np.float32) for _ in range(2)], level, rng.normal(0.3, 0.2, (M.GATES, M.INPUTS)))
    node, bit, where, token = code.decisions(symbols, first)
    x, gate = mixer.inputs(code, node, where)
    want = mixer.log_probability(x, gate, bit, np.searchsorted(token, begin))
    monkeypatch.setattr(M, "LANES", 2)
    monkeypatch.setattr(M, "AT_HAND", 128)
    assert mixer.score(code, symbols, first, begin) == pytest.approx(want, rel=1e-6)


def test_texts_are_read_for_the_word_counts_and_once_more(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text_of(i):
        read.add(1)
        return f"the cat number {i % 7} sat on the mat " * 9

    docs = spark.range(80).select(F.col("id").alias("doc_id"), text_of("id").alias("text"))
    n_held = docs.filter(fold7()).count()
    read.value = 0
    assert len(M.mixing_scores(docs, fold7()).collect()) == 80 and 0 < n_held < 80
    assert read.value <= 2 * 80     # every pass of the fit and the scoring take the symbols that were stored
