"""Alignment of two tokenizers against overlaps counted in plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from tokenizers import Tokenizer

from topictone.llm import token_alignment as ta

A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


def brute(rows):
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    chars = ta._byte_chars()
    names = {i: t for t, i in a.get_vocab().items()}
    docs = []
    for i, text in rows:
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        xs = [bytes(chars[c] for c in names[t]) for t in ia]
        ys = []
        for t in ib:
            p = b.id_to_piece(t)
            ys.append(bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode())
        if text and (b"".join(xs) != (" " + text).encode() or b"".join(ys) != (" " + text).encode()):
            ia, ib, xs, ys = [], [], [], []
        spans = [[(sum(map(len, side[:n])), sum(map(len, side[:n + 1]))) for n in range(len(side))] for side in (xs, ys)]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(t) for t, (s, e) in zip(ia, spans[0]) if low <= s and e <= c) + "|"
                          + ",".join(str(t) for t, (s, e) in zip(ib, spans[1]) if low <= s and e <= c))
            low = c
        links = [(t, u) for t, (s, e) in zip(ia, spans[0]) for u, (x, y) in zip(ib, spans[1]) if s < y and x < e]
        docs.append((i, ia, ib, groups, links))
    count = Counter(link for d in docs for link in d[4])
    best = {}
    for (_, u), n in count.items():
        best[u] = max(best.get(u, 0), n)
    return sorted((repr(i), len(ia), len(ib), len(g), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
                   hashlib.sha256(";".join(g).encode()).hexdigest() if ia else "") for i, ia, ib, g, links in docs)


def got(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, a int, keys string, n_best int").repartition(parts)
    return sorted((repr(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
                  for r in ta.aligned_texts(df, A, B).collect())


def rows_of(seed, n=30):
    rng = random.Random(seed)
    words = ["the", "learning", "Straße", "naïve", "数据处理", "🙂🙂", "<|endoftext|>", "<s>", "</s>", "<0x41>", "don't", "1234567", "\n\n", "\t", "  x", "É",
             "a▁b", "é", " ", "\r\n", "zz" * 9, "\x00", "﻿"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(n)]
    return rows + [(100, None), (101, ""), (102, " "), (103, "the " * 50), (103, "the " * 50), (None, "null id"), (104, " lead"), (105, "trail "), (106, "▁")]


def test_against_overlaps(spark):
    rows = rows_of(1)
    assert got(spark, rows) == brute(rows)


def test_many_groups_of_pairs_and_small_blocks(spark, monkeypatch):
    rows = rows_of(2, 20) + [(900, "".join(random.Random(3).choice("ab é.\n") for _ in range(400)))]
    for name, value in {"BUCKET": 20, "GROUP_BUCKETS": 3, "BLOCK": 16, "SEGMENT": 8, "FAN": 2, "BATCH_BYTES": 300}.items():
        monkeypatch.setattr(ta, name, value)
    assert got(spark, rows, parts=6) == brute(rows)


def test_empty_tables(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None), (2, "")]) == brute([(1, None), (2, "")])


def test_units_of_a_text_encode_as_the_whole():
    with open(A, "rb") as a, open(B, "rb") as b:
        pair = ta.TokenizerPair(a.read(), b.read())
    rng = random.Random(4)
    for n in (1, 3, 4000):
        text = "".join(rng.choice(["ab", " ", "  ", "é", "don't ", "12 ", "\n", "_x ", ". ", "\x1c ", "　", "\r", "\t "]) for _ in range(n))
        cut = ta.units(text)
        assert "".join(" " + u for u in cut) == " " + text
        (a, n_a), (b, n_b), (same, _) = pair.encode(cut)
        whole = Tokenizer.from_file(A)
        assert same.all() and a.tolist() == whole.encode(" " + text, add_special_tokens=False).ids and b.tolist() == pair.b.encode(text)
        for n, u in enumerate(cut[:300]):
            (x, _), (y, _), _ = pair.encode([u])
            assert a[n_a[:n].sum():n_a[:n + 1].sum()].tolist() == x.tolist() and b[n_b[:n].sum():n_b[:n + 1].sum()].tolist() == y.tolist()


def test_a_memo_that_fills_up_changes_nothing(monkeypatch):
    with open(A, "rb") as a, open(B, "rb") as b:
        pair = ta.TokenizerPair(a.read(), b.read())
    texts = [t for _, t in rows_of(5)]
    def look(keys):
        return keys, keys % 7

    whole, parts = ta.Units(pair, look), []
    numbers, begin = whole.of(texts)
    for t in texts:
        one = ta.Units(pair, look)
        at = one.of([t])
        parts.append((one.per_text(*at)[:, 0].tolist(), one.digests(*at)[0], one.ids(*at, 0, np.uint16)[0] if len(one.number) else b""))
    assert parts == list(zip(whole.per_text(numbers, begin).T.tolist(), whole.digests(numbers, begin), whole.ids(numbers, begin, 0, np.uint16)))


@pytest.mark.parametrize("n", [1, 2, 63, 5000])
def test_hash_is_minimal_and_verified(n):
    rng = np.random.default_rng(n)
    keys = rng.choice(50_257 * 32_000, n, replace=False).astype(np.int64)
    buckets = max(1, n // 700)
    own = ta._bucket(keys, buckets)
    rows = [(b, [x.tobytes() for x in ta._levels(keys[own == b])], keys[own == b].tobytes()) for b in sorted(set(own.tolist()))]
    index = ta.PairIndex(buckets, 0, rows)
    assert sorted(index.numbers(keys).tolist()) == list(range(n))
    other = np.setdiff1d(rng.choice(50_257 * 32_000, 3 * n), keys)
    assert (index.numbers(other) == -1).all()
    some = ta.PairIndex(buckets, 0, rows[: (len(rows) + 1) // 2])
    assert ((some.numbers(keys) >= 0) == np.isin(own, [r[0] for r in rows[: (len(rows) + 1) // 2]])).all()
