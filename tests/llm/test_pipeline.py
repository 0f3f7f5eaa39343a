"""The pipeline's stages, each on its own input, against plain Python."""

import re
from collections import Counter

import public_tokenizers as public
import pyarrow as pa
import pytest
import tiktoken

import corpus_pipeline as P
from topictone.llm.bpe import read_ranks
from topictone.llm.common import ARROW_BYTES, ARROW_SETTING
from topictone.llm.near_duplicates import keep_one_of_each
from topictone.llm.pii import sanitise
from topictone.llm.toxicity import fit_toxicity, score_toxicity


@pytest.fixture(scope="module")
def steps(spark, sf01):
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(P.write_shared(stage(spark, out[-1], sf01), "test-" + name))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(steps):
    assert [s[0] for s in P.STAGES] == ["toxicity", "near-duplicates", "decontamination", "personal-data", "encoding"]
    for s in steps[1:-1]:
        assert s.columns == steps[0].columns and s.dtypes == steps[0].dtypes


def test_toxicity(spark, steps, sf01):
    before, after = rows(steps[0]), rows(steps[1])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf01}/labels.parquet").collect()}
    assert all(before[i] == r for i, r in after.items())
    gone = set(before) - set(after)
    toxic = [i for i, y in labels.items() if y]
    assert sum(i in gone for i in toxic) > 0.7 * len(toxic)
    assert sum(i in gone for i, y in labels.items() if not y) < 0.03 * len(labels)
    model = fit_toxicity(steps[0], spark.read.parquet(f"{sf01}/labels.parquet"))
    assert gone == {r.doc_id for r in score_toxicity(steps[0], model).filter("toxic").collect()}


def test_near_duplicates(steps):
    before, after = rows(steps[1]), rows(steps[2])
    sets = {}
    for i, r in before.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    holders = {}
    for i, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, s in sets.items():
        for b, c in Counter(b for g in s for b in holders[g] if b < a).items():
            if 100 * c >= 80 * (len(s) + len(sets[b]) - c):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert set(after) == {i for i in sets if find(i) == i} and len(after) < len(before)
    assert all(before[i] == r for i, r in after.items())


def test_decontamination(spark, steps, sf01):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    wins = {tuple(w[k:k + 10]) for r in spark.read.parquet(f"{sf01}/benchmark.parquet").collect()
            for w in [word.findall(low(r.text))] for k in range(max(1, len(w) - 9))}
    before, after, cut = rows(steps[2]), rows(steps[3]), 0
    assert set(before) == set(after)
    for i, r in before.items():
        places = [m.span() for m in word.finditer(low(r.text))]
        w = [low(r.text)[a:b] for a, b in places]
        hit = set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in wins:
                    hit.update(range(k, k + n))
        want, at = "", 0
        for k in sorted(hit):
            if k - 1 not in hit:
                want += r.text[at:places[k][0]]
            if k + 1 not in hit:
                at = places[k][1]
        want += r.text[at:]
        assert after[i].text == want and after[i].n_chars == len(want) and after[i].source == r.source
        cut += bool(hit)
    assert cut > 0


def test_personal_data(steps):
    before, after, changed = rows(steps[3]), rows(steps[4]), 0
    assert set(before) == set(after)
    some = re.compile(r"@|\+[0-9]|[0-9]\.[0-9]+\.[0-9]+\.[0-9]|[0-9]([ -]?[0-9]){13}")
    for i, r in before.items():
        if not some.search(r.text):
            assert after[i] == r
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", after[i].text)
        assert after[i].n_chars == len(after[i].text)
        changed += after[i].text != r.text
    assert changed > 0


def test_encoding(steps):
    lib = tiktoken.Encoding("own", pat_str=public.PATTERN, special_tokens={},
                            mergeable_ranks=read_ranks(public.path("byte_bpe_multi_50k.tiktoken")))
    before, after = rows(steps[4]), rows(steps[5])
    assert set(before) == set(after)
    for i, r in before.items():
        assert after[i].ids == lib.encode_ordinary(r.text) and after[i].decoded == r.text and after[i].n_tokens == len(after[i].ids)


def test_edge_rows_pass_all_stages(spark, sf001, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf001}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    rows = [(1, None, "en", "s", None, "x"), (2, "", None, None, 0, "x"), (3, "ann@x.org " + "w " * 30_000, "en", "s", 1, "x"),
            (None, "no id here", "en", "s", 1, "x"), (5, "same words stand here", "en", "s", 1, "x"), (6, "same words stand here", "en", "s", 1, "x"),
            (6, "same words stand here", "en", "s", 1, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = P.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "5", "None"]
    assert next(r for r in got if r.doc_id == 3).decoded.startswith("[EMAIL] w w")
    empty = spark.createDataFrame([], schema)
    for name, stage in P.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0


def test_columns_that_have_the_names_of_helpers(spark):
    names = ["digest", "DIGEST2", "gone_id", "gone_digest", "row_key", "row_spans", "__key", "__spans", "__digest", "__id", "__h"]
    rows = [(i, f"text {i} of mail ann.lee{i}@example.org and more words in it", *[f"{n}{i}" for n in names]) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == rows
    clean = sanitise(df)
    assert clean.columns == df.columns
    assert all("@" not in r.text and r[2:] == rows[r.doc_id][2:] for r in clean.collect())


def test_python_workers_get_small_batches(spark, sf001):
    """Stages bound what the JVM hands to a Python worker at a time by bytes."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    wide = spark.range(0, 4000, 1, 1).selectExpr("id", "repeat('a', 3000) AS text").mapInArrow(sizes, "n long, size long")
    held = spark.conf.get(ARROW_SETTING)
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    try:
        for name, stage in P.STAGES:
            if name in ("decontamination", "encoding"):
                spark.conf.set(ARROW_SETTING, "64m")
                stage(spark, docs, sf001)
                found = wide.select("*").collect()
                assert sum(r.n for r in found) == 4000 and max(r.size for r in found) < 2 * ARROW_BYTES
                spark.conf.set(ARROW_SETTING, "100k")   # a lower bound stays
                stage(spark, docs, sf001)
                assert spark.conf.get(ARROW_SETTING) == "100k"
    finally:
        spark.conf.set(ARROW_SETTING, held)
