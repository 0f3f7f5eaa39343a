"""The convolutional classifier: gradients, held-out accuracy, edges."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from topictone.llm import toxicity as T
from topictone.llm.common import whole_runs
from topictone.llm.queries import op7_cnn_toxicity


def texts(n, rng):
    rows = []
    for i in range(n):
        words = [f"w{rng.integers(0, 300)}" for _ in range(rng.integers(0, 60))]
        label = int(rng.random() < 0.4)
        if label:
            words.insert(int(rng.integers(0, len(words) + 1)), rng.choice(["nasty", "vile thing"]))
        rows.append((i, " ".join(words), label))
    return rows


def test_learns_a_word_and_a_pair():
    rng = np.random.default_rng(0)
    rows = texts(900, rng)
    docs, y = [T.word_ids(r[1]) for r in rows], np.array([r[2] for r in rows], np.float32)
    model = T.train(docs[:600], y[:600])
    p = model.scores(docs[600:])
    assert ((p > 0.5) == y[600:]).mean() > 0.95
    # a score does not depend on the texts around it
    assert model.scores(docs[5:6])[0] == pytest.approx(model.scores(docs[:9])[5], abs=1e-6)


def test_convolution_and_pooling_by_hand():
    rng = np.random.default_rng(1)
    m = T.ToxicityModel(rng.normal(size=(T.BUCKETS, T.DIM)).astype(np.float32))
    m.table[0] = 0
    m.filters = [rng.normal(size=(w * T.DIM, T.FILTERS)) for w in T.WIDTHS]
    m.biases = [rng.normal(size=T.FILTERS) for _ in T.WIDTHS]
    m.weights, m.intercept = rng.normal(size=T.FILTERS * len(T.WIDTHS)), 0.3
    for ids in (np.array([], np.int32), np.array([4, 9, 4, 7], np.int32)):
        padded = np.concatenate((ids, np.zeros(2 * T.PAD, np.int32)))
        pooled = []
        for w, f, b in zip(T.WIDTHS, m.filters, m.biases):
            pooled.append(np.max([np.maximum(m.table[padded[i:i + w]].ravel() @ f + b, 0) for i in range(max(1, len(ids)))], 0))
        want = np.concatenate(pooled) @ m.weights + 0.3
        assert m.logits([ids, ids])[1] == pytest.approx(want, rel=1e-5)


def test_best_threshold():
    s, y = np.array([0.9, 0.8, 0.4, 0.3, 0.1]), np.array([1, 1, 0, 1, 0])
    f1 = lambda t: 2 * ((s >= t) & (y == 1)).sum() / ((s >= t).sum() + y.sum())
    assert f1(T.best_threshold(s, y)) == max(f1(t) for t in s)


def test_edges(spark):
    rng = np.random.default_rng(2)
    rows = texts(400, rng)
    df = spark.createDataFrame([(i, t, "en" if i % 2 else None, "clash") for i, t, _ in rows]
                               + [(900, None, "en", "x"), (901, "", "de", "x"), (None, "nasty", "en", "x"),
                                  (902, "w1 " * 40_000 + "nasty", "en", "x"), (902, "w1 " * 40_000 + "nasty", "en", "x")],
                               "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (None, 1), (5, rows[5][2])], "doc_id long, toxic int")
    model = T.fit_toxicity(df, labels)
    got = T.score_toxicity(df, model).collect()
    assert len(got) == 405 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[900].score == by[901].score < 0.5 < by[902].score and by[None].toxic and by[902].toxic
    kept = T.keep_clean(df, model)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if not r.toxic)
    assert T.score_toxicity(df.limit(0), model).count() == 0
    # no labels, or of one class
    none = T.fit_toxicity(df, labels.limit(0))
    assert {r.score for r in T.score_toxicity(df, none).collect()} == {0.5}
    one = T.fit_toxicity(df, labels.filter("toxic = 0"))
    assert len({r.score for r in T.score_toxicity(df, one).collect()}) == 1


def test_query_held_out(spark, sf01):
    got = {r.doc_id: r for r in op7_cnn_toxicity(spark, sf01).collect()}
    docs = spark.read.parquet(f"{sf01}/documents.parquet")
    assert len(got) == docs.count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf01}/labels.parquet").collect()}
    s = np.array([got[i].score for i in labels if got[i].held_out])
    y = np.array([labels[i] for i in labels if got[i].held_out])
    auc = np.mean([(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]])
    assert auc > 0.7


def test_word_bound_does_not_depend_on_file_order(spark, monkeypatch):
    from topictone.llm import toxicity as own

    rows = [(i, f"word{i} " * 20, int(i >= 40)) for i in range(80)]  # the classes stand one after the other
    seen, real = [], own.train
    monkeypatch.setattr(own, "train", lambda data, marks: seen.append(sorted((d.tobytes(), float(y)) for d, y in zip(data, marks))) or real(data, marks))

    def fit(order):
        df = spark.createDataFrame(order, "doc_id long, text string, toxic int")
        own.fit_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
        return seen[-1]

    whole = fit(rows)
    assert len(whole) == 80
    monkeypatch.setattr(own, "SAMPLE_WORDS", 400)
    one, two = fit(rows), fit(rows[::-1])
    assert one == two and [sum(y == k for _, y in one) for k in (0, 1)] == [10, 10]
    assert len(fit(rows[:45])) == 20  # label 1 has 100 words; the rest is label 0's


def test_long_texts_in_bounded_memory(monkeypatch):
    """A text of 200,000 words among others: trained and scored within 60 MB beside the
    model, and as without pieces."""
    import tracemalloc

    rng = np.random.default_rng(7)
    docs = [rng.integers(1, T.BUCKETS, n).astype(np.int32) for n in (200_000, 5, 0, 40_000, 1, *[30] * 60)]
    y = (np.arange(len(docs)) % 2).astype(np.float32)
    base = np.random.default_rng(1)
    tracemalloc.start()
    small = T.train(docs, y, epochs=2)
    scores = small.scores(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6 + small.table.nbytes, peak
    monkeypatch.setattr(T, "CHUNK", 10**9)
    whole = T.train(docs, y, epochs=2)
    assert np.allclose(scores, whole.scores(docs), atol=1e-4)
    model = T.ToxicityModel(base.normal(size=(T.BUCKETS, T.DIM)).astype(np.float32), small.filters, small.biases, small.weights)
    all_at_once = model.pooled(docs, winners=True)
    monkeypatch.setattr(T, "CHUNK", 7)
    some = [docs[i] for i in (1, 2, 4, 5, 6)]
    pieces = model.pooled(some, winners=True)
    assert np.allclose(pieces[0], all_at_once[0][[1, 2, 4, 5, 6]], rtol=1e-4)
    assert all((a == b[[1, 2, 4, 5, 6]]).all() for a, b in zip(pieces[1], all_at_once[1]))
    assert np.allclose(model.pooled(some)[0], pieces[0], rtol=1e-4)


def test_whole_fit_reads_every_labelled_row(spark, monkeypatch):
    """Beyond the bounds of one process a word that only a few rows hold, whatever their
    place in a hash's order, is still learnt, and partitions don't matter."""
    rng = np.random.default_rng(11)
    rows = [(i, t + (" onlyhere" if y and i >= 500 else ""), y, "en" if i % 2 else "de") for i, t, y in texts(1500, rng)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, lang string")
    parts = (df.select("doc_id", "text", "lang"), df.select("doc_id", "toxic"))
    monkeypatch.setattr(T, "SAMPLE", 20)
    monkeypatch.setattr(T, "SHARD_ROWS", 400)
    seen = []
    real = T._round
    monkeypatch.setattr(T, "_round", lambda d, t, r: seen.append((d.count(), d.select("shard").distinct().count())) or real(d, t, r))
    model = T.fit_toxicity(*parts, whole=True)
    n, shards = seen[0]
    assert len(seen) == T.EPOCHS and 1500 * 0.75 < n < 1500 * 0.92 and shards == 4
    ids = [T.word_ids(r[1]) for r in rows]
    y = np.array([r[2] for r in rows])
    assert ((model.scores(ids) >= 0.5) == y).mean() > 0.9
    assert model.table[T.word_ids("onlyhere")].any()
    assert set(model.thresholds) == {"en", "de"}
    again = T.fit_toxicity(*(p.repartition(5, p.columns[1]) for p in parts), whole=True)
    assert (T._unpacked(T._packed(ids[3])) == ids[3]).all()
    assert (again.table == model.table).all() and again.thresholds == model.thresholds and again.intercept == model.intercept


def test_whole_fit_threshold_has_the_best_f1(spark):
    rng = np.random.default_rng(12)
    rows = [(int(s), int(rng.random() < s / 50), "x") for s in rng.integers(0, 50, 300)]
    df = spark.createDataFrame(rows, "step int, label int, lang string").groupBy("lang", "step").agg({"label": "sum", "*": "count"})
    got = T._best_steps(df.toDF(*["hits" if "sum" in c else "n" if "count" in c else c for c in df.columns])).first()
    f1 = lambda t: 2 * sum(y for s, y, _ in rows if s >= t) / (sum(s >= t for s, _, _ in rows) + sum(y for _, y, _ in rows))
    assert f1(got["step"]) == max(f1(t) for t in range(50)) and got["positive"] == sum(y for _, y, _ in rows)


def test_runs_of_rows_do_not_depend_on_batches():
    rows = [f"text {i}" for i in range(300)]
    for size in (1, 7, 64, 100, 300):
        batches = [pa.RecordBatch.from_arrays([pa.array(rows[at:at + size])], ["t"]) for at in range(0, 300, size)]
        out = list(whole_runs(iter(batches), 64))
        assert [x for b in out for x in b.column(0).to_pylist()] == rows
        assert all(b.num_rows % 64 == 0 for b in out[:-1])
    assert [b.num_rows for b in whole_runs(iter(batches), 64, max_bytes=10)] == [300]
    assert list(whole_runs(iter([]), 64)) == []
