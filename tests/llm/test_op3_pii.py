"""Personal data: base spans and disclosing terms against plain Python."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest

from topictone.llm import pii
from topictone.llm.queries import op3_information_pii

RULES = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_base(text):
    out = []
    for n, (kind, rule) in enumerate(RULES):
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 14 <= len(d) <= 19 and luhn(d or "0"), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), n, m.end(), m[0]))
    return sorted(out)


TERM = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|([^\W\d_](?:[^\W\d_]|['-]){2,})")
IN_RUN = re.compile(r"(?:[^\W_]|['@._%+-])")


def brute_units(t):
    """(first character, piece): cuts at each PASSAGE, moved to the end of a run that stands there."""
    cuts = [0]
    for at in range(pii.PASSAGE, len(t), pii.PASSAGE):
        if IN_RUN.match(t[at - 1]):
            while at < len(t) and IN_RUN.match(t[at]):
                at += 1
        cuts.append(at)
    return [t[a:b] for a, b in zip(cuts, cuts[1:] + [len(t)])]


def brute_terms(rows, generalise=pii.GENERALISE, remove=pii.REMOVE):
    """(id, text) -> set of (start, end) of disclosing terms."""
    df, n_e, both, texts, n = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(set), 0
    for _, t in rows:
        t = t or ""
        entities = defaultdict(set)
        for a, k, e, v in brute_base(t):
            entities[a // pii.PASSAGE].add((k, v.lower()))
        for u, piece in enumerate(brute_units(t)):
            n += 1
            words = {m[1] for m in TERM.finditer(piece.lower()) if m[1]}
            for w in words:
                df[w] += 1
            for e in entities[u]:
                n_e[e] += 1
                for w in words:
                    both[e, w] += 1
                    texts[e, w].add(piece)
    over = {w for (e, w), c in both.items() if len(texts[e, w]) >= pii.SUPPORT and n_e[e] < n
            and math.log(n * c / (df[w] * n_e[e])) / math.log(n / n_e[e]) >= generalise - 1e-12}
    out = defaultdict(set)
    for d, t in rows:
        spans = brute_base(t or "")
        for m in TERM.finditer(t or ""):
            if m[1] and m[1].lower() in over and not any(a < m.end() and m.start() < e for a, _, e, _ in spans):
                out[d, t or ""].add(m.span())
    return out


def corpus(seed):
    rng = random.Random(seed)
    parts = ["ann@x.org", "a.b+c@mail.example.com", "@", "a@b", "1.2.3.4", "256.1.1.1", "001.2.3.255", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111",
             "4111-1111-1111-1112", "5500000000000004", "+1 (212) 555-0100", "+12", "+1 2 3 4 5 6 7 8 9 0", "é😀", "_", ".", "-", "12345678901234567890123"]
    rows = []
    for i in range(150):
        words = [rng.choice(["alpha", "Beta", "gamma", "delta", "épsilon", "the", "of"]) for _ in range(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 4)):
            words.insert(rng.randint(0, len(words)), rng.choice(parts))
        rows.append((i, rng.choice([" ", "  ", ""]).join(words)))
    for i in range(6):  # a name that stands with one address only
        rows.append((200 + i, f"{'of ' * i} contact Zebulon at zeb@corp.example and {'the ' * i}"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed) + [(900, None), (900, None), (901, ""), (None, "x ann@x.org"), (None, "x ann@x.org"), (902, "9" * 30_000),
                           (903, "a" * 50_000 + "@" + "b.c" * 9000), (904, "a@b" + ".c" * 20_000), (905, "1." * 30_000)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, spans string, key int").repartition(3)
    got = defaultdict(list)
    for r in pii.personal_data(df).collect():
        got[r.doc_id].append(r)
    terms = brute_terms(rows)
    for d, t in rows:
        base = brute_base(t or "")
        want = [f"{RULES[k][0]}:{a}:{e}" for a, k, e, _ in base]
        spans = sorted([(a, k, e) for a, k, e, _ in base] + [(a, 4, e) for a, e in terms.get((d, t or ""), ())])
        for r in got[d]:
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in base) for k in range(4)], t
            assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
            assert r.spans == ",".join(f"{pii.KINDS[k]}:{a}:{e}" for a, k, e in spans)
    assert sum(map(len, got.values())) == len(rows)
    assert all("term" in got[200 + i][0].spans for i in range(6))


def test_sanitise(spark):
    rows = corpus(3) + [(900, None), (901, ""), (902, "clean"), (902, "clean")]
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string")
    out = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert pii.sanitise(df).count() == len(rows) and pii.sanitise(df).columns == df.columns
    terms = brute_terms(rows)
    for d, t in rows:
        base = brute_base(t or "")
        if not base:
            assert (out[d].text == t) == (not terms.get((d, t or ""))) and out[d].source == "s"
        else:
            assert not brute_base(out[d].text) or any(k != 0 for _, k, _, _ in base)
            for a, k, e, v in base:
                assert pii.MASKS[RULES[k][0]] in out[d].text or any(x <= a < y for x, n, y, _ in base if n != k)
    for i in range(6):
        assert terms[200 + i, dict(rows)[200 + i]] and "Zebulon" not in out[200 + i].text and "[EMAIL]" in out[200 + i].text
    assert pii.sanitise(df.limit(0)).count() == 0 and pii.personal_data(df.limit(0)).count() == 0


def test_terms_anywhere(spark):
    """A name far from the mention, in a text without one, of an address in two texts
    only, and beyond the first unit of a long text; a copied text proves nothing."""
    fill = "the quick words of ordinary talk go on here " * 40
    rows = [(i, f"{fill} number {i}") for i in range(1000, 1400)]
    rows += [(100, f"Quillon wrote. {fill} mail ann@x.org"), (101, f"mail ann@x.org {fill} signed Quillon"), (102, "Quillon was here, Épann@x.org")]
    rows += [(110 + i, "Copied Marwick at bob@y.org") for i in range(5)]
    long = "plain filler text " * 300
    rows += [(120, f"{long} Tarrow zed@z.org {long}"), (121, f"{long} {long} zed@z.org by Tarrow")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    terms = brute_terms(rows)
    for d, t in rows:
        assert {tuple(map(int, x.split(":")[1:])) for x in got[d].spans.split(",") if x.startswith("term")} == terms[d, t]
    text = dict(rows)
    for d, name in [(100, "Quillon"), (101, "Quillon"), (102, "Quillon"), (120, "Tarrow"), (121, "Tarrow")]:
        at = text[d].index(name)
        assert f"term:{at}:{at + len(name)}" in got[d].spans.split(",")
    assert all(got[110 + i].n_term == 0 for i in range(5))
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all(name not in clean[d] for d, name in [(100, "Quillon"), (102, "Quillon"), (121, "Tarrow")])
    assert all(clean[i] == text[i] for i in range(1000, 1400))


def test_many_mentions_in_one_text(spark):
    text = " ".join(f"10.{i // 250}.{i % 250}.7" for i in range(16_000))
    df = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    want = ",".join(f"ip:{a}:{e}" for a, _, e, _ in brute_base(text))
    assert got[1].n_ip == 16_000 and got[1].base_sha256 == hashlib.sha256(want.encode()).hexdigest()


def test_query(spark, sf01):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()]
    got = {r.doc_id: r for r in op3_information_pii(spark, sf01).collect()}
    assert sum(r.n_email + r.n_phone for r in got.values()) > 0
    for d, t in rows:
        want = ",".join(f"{RULES[k][0]}:{a}:{e}" for a, k, e, _ in brute_base(t or ""))
        assert got[d].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(got[d].spans.split(","))
