"""Secret scans: base spans and the guess-cost programme against brute force."""

import hashlib
import math
import random
import re

import pytest
from hypothesis import given, settings, strategies as st

from topictone.llm import secrets as S
from topictone.llm.queries import op2_guess_cost_secrets


def slow_cost(value, words):
    """Every segmentation by every start and end."""
    low = value.lower() if len(value.lower()) == len(value) else value
    best = [0.0] + [math.inf] * len(value)
    for i in range(1, len(value) + 1):
        for j in range(i):
            seg, orig, opts = low[j:i], value[j:i], []
            size = S.class_size(seg[-1])
            if i - j == 1:
                opts.append(math.log10(size))
            if len(set(seg)) == 1:
                opts.append(math.log10(size * (i - j)))
            if all((a, b) in S.NEAR for a, b in zip(seg, seg[1:])):
                opts.append(math.log10(47 * 8 * (i - j)))
            opts += [n for p, n in S.DATES if (m := p.match(value, j)) and m.end() == i]
            if S.WORD_MIN <= i - j <= S.WORD_MAX and seg in words:
                opts.append(words[seg] + (orig != seg) * math.log10(2))
            best[i] = min([best[i], *(best[j] + o for o in opts)])
    return best[-1]


WORDS = {"the": 1.2, "pass": 2.0, "password": 2.4, "word": 2.2, "dog": 3.0, "aaa": 2.9}


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["pass", "Word", "dog", "aaa", "a", "1999", "12", "01", "-", "qwe", "rty", "é", "9", "ZZ", "ßİ"]),
                max_size=9).map("".join))
def test_cost_is_the_minimum(value):
    assert S.guess_cost(value, WORDS) == pytest.approx(slow_cost(value, WORDS))


def test_order_of_costs():
    cost = lambda v: S.guess_cost(v, WORDS)
    assert cost("passworddog") < S.THRESHOLD < cost("x9K#mQ2$vL7w")
    assert cost("a" * 200) < S.THRESHOLD and cost("qwertyuiop") < S.THRESHOLD and cost("1999-12-31") < S.THRESHOLD


def brute_base(text):
    out = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{e}" for a, _, k, e in sorted(out)), [sum(k == x for _, _, k, _ in out) for x in ("assign", "access", "hex")]


def check(rows, got):
    for (doc_id, text), r in zip(rows, got):
        base, n = brute_base(text or "")
        assert r.doc_id == doc_id and r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == n
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_edges(spark):
    rng = random.Random(5)
    parts = ["password", "TOKEN", "api_key", "apikey", "secret", "ſecret", "=", ": ", '"', " ", "AKIA", "ABCDEFGH12345678", "deadbeef",
             "0123456789abcdef", "é", "x", "is "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, 'the password is "x9K#mQ2$vL7w!" é'), (302, 'the password is "x9K#mQ2$vL7w!" é'),
             (303, "my password is aaaaaaaaaaaaaaaaaaa"), (304, "login: " + "kT7#" * 3000)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, spans string").coalesce(2)
    got = {r.doc_id: r for r in S.secret_spans(df).collect()}
    assert S.secret_spans(df).count() == len(rows)
    check(rows, [got[i] for i, _ in rows])
    assert got[302].spans == "guess:17:30" and got[302].n_guess == 1
    assert got[303].n_guess == 0 and got[304].n_guess == 1
    assert S.secret_spans(df.limit(0)).count() == 0
    null_ids = spark.createDataFrame([(None, "password is kT7#qq!2Zx9"), (None, "none")], "doc_id long, text string")
    assert sorted(r.spans for r in S.secret_spans(null_ids).collect()) == ["", "guess:12:23"]


def test_query_on_a_table(spark, sf01):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()]
    got = {r.doc_id: r for r in op2_guess_cost_secrets(spark, sf01).collect()}
    check(rows, [got[i] for i, _ in rows])
    assert sum(r.n_assign for r in got.values()) > 0


OLD = re.compile(
    r"""\b(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth|login|(?:api|access|private)[ _-]?key)\b["']?\s{0,4}"""
    r"""(?:[:=]>?|is\b)\s{0,4}["'`]?([^\s"'`,;<>(){}\[\]]{6,})""", re.IGNORECASE | re.ASCII)


def test_credential_words_in_identifiers(spark):
    value = "kT7#qq!2Zx9Lm"
    names = ["DB_PASSWORD=", "client_secret: ", "auth_token=", "secret_key: ", "dbPassword: ", "authKey=", "userAuth: ", "MY-API-KEY: ", "password2 = ",
             "x_api key: ", '"refreshToken": "', "login_pass=", "credentials: "]
    rows = [(i, f"set {n}{value}") for i, n in enumerate(names)]
    rows += [(100 + i, f"{n}: {value}") for i, n in enumerate(["author", "AUTHORS", "passenger", "passage", "monkey"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in S.secret_spans(df).collect()}
    for i, n in enumerate(names):
        assert got[i].spans.split(",")[-1] == f"guess:{4 + len(n)}:{4 + len(n) + len(value)}", n
    assert all(got[i].n_guess == 0 for i, _ in rows if i >= 100)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["pass", "word", "AUTH", "auth", "api", "key", "secret", "login", "_", "-", " ", ": ", "=", " is ", '"', "abcdef", "kT7#qq!2", "X", "5", "é"]),
                max_size=14).map("".join))
def test_free_standing_words_are_still_contexts(text):
    new = [m.span(1) for m in S.CONTEXT.finditer(text)]
    for m in OLD.finditer(text):  # the same value, or one that holds it or holds its context
        assert any(a <= m.end(1) and m.start() <= b for a, b in new), text


@pytest.mark.parametrize("text", ["a" * 300_000, "pass" * 75_000, "api" * 100_000, "secret_" * 40_000, "a-" * 150_000, "token " * 50_000])
def test_contexts_in_linear_time(text):
    import time

    start = time.process_time()
    assert not list(S.CONTEXT.finditer(text))
    assert time.process_time() - start < 5


def test_a_value_of_a_million_characters(spark, monkeypatch):
    """Whole, in rows that grow with its length: a digest stands for the value."""
    rng = random.Random(8)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    long = "".join(rng.choices(alphabet, k=1_000_000))
    rows = [(1, f"token: {long}"), (2, "x" * 200_000 + f" token: {long} end"), (3, "password is " + "letmein" * 20_000), (4, "password is monkey")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in S.secret_spans(df).collect()}
    check(rows, [got[i] for i, _ in rows])
    assert got[1].spans == f"assign:0:{len(long) + 7},guess:7:{len(long) + 7}"
    assert got[2].n_guess == 1 and got[3].n_guess == 1 and got[4].n_guess == 0
    size = [sum(map(len, S.segments_of(long[:n]))) for n in (4000, 8000, 16_000)]
    assert size[1] < 2.2 * size[0] and size[2] < 2.2 * size[1]


def test_segments_come_in_bounded_sets(monkeypatch):
    value = "passwordmonkey77Straßeabcdefgh" * 50
    whole = set().union(*S.segments_of(value))
    monkeypatch.setattr(S, "SEGMENTS", 60)
    parts = list(S.segments_of(value))
    assert len(parts) > 5 and max(map(len, parts)) < 60 + S.WORD_MAX and set().union(*parts) == whole
