"""Toxicity: a convolutional text classifier trained in numpy.

Words are hashed into an embedding table.  Filters of several widths run over the
embeddings of the whole text, each filter's largest response is kept, and a
logistic layer turns them into a probability.  Only the winning windows carry a
gradient, so training costs little more than scoring.  The table starts at zero:
a word the training never moved has no influence on a score.

With ``whole`` (the queries) the fit reads every labelled row.  Up to SAMPLE rows of
each class and SAMPLE_WORDS words that is the fit of one process; beyond it, rows are
dealt by a hash of their id to shards of about SHARD_ROWS rows, and in each of
EPOCHS rounds every shard is trained once from the model of the round before.  The new
model is the mean of the shards' moves (for a word, of the shards that moved it), summed
as whole numbers, so neither files nor partitions nor the order of tasks matter.  One row
of HELD_BACK isn't trained on; over all of these, the threshold with the best F1 is set
for each language, in steps of 1 / STEPS_OF_SCORE (one for all languages where a language
has few positive rows).  Language is used by these thresholds only, never by a score.
Scoring is one narrow pass over whole texts.

Without ``whole`` a caller gets a quick fit on a bounded sample of labelled rows: at most
SAMPLE of each class and SAMPLE_WORDS words, in the order of a hash of their id within
each class.  Beyond the bound on words each class has half of them, and what one class
leaves is the other's.  The classes' sampling rates are undone in the intercept.

Null and empty texts have a score (no word, every filter at its bias).  Labels of
an id that repeats: 1 if any is 1; null labels are ignored.  Without labels of
both classes every score is the rate of label 1, (n1 + 1) / (n + 2).  Repeated rows
give equal rows; an empty table gives an empty table.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, released, texts_of, whole_runs, write_shared
from .decontaminate import WORD

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 16, 16, (1, 2, 3)
#: Labelled rows of each class, and words in all, that are fitted in one process at most.
SAMPLE, SAMPLE_WORDS = 6_000, 12_000_000
#: Rows of a shard, about; steps of a threshold; buckets in one row of summed moves.
SHARD_ROWS, STEPS_OF_SCORE, BLOCK = 8192, 10_000, 1 << 12
#: Moves are summed as whole multiples of 1 / FIXED.
FIXED = float(1 << 36)
EPOCHS, BATCH, HELD_BACK, FEW = 5, 64, 6, 25
#: A small sample is read more often, for about so many steps.
STEPS = 500
#: Words whose windows are held at a time, in training and scoring alike.
CHUNK = 16_384
#: Zero words after each text, so that windows that start in it end before the next.
PAD = max(WIDTHS) - 1
#: Buckets of words that were met, MEMO at most; a task empties it when it ends.
_BUCKET_OF: dict[bytes, int] = {}
MEMO = 200_000


def word_ids(text: str | None) -> np.ndarray:
    """Buckets of the words of a text (0 is the padding)."""
    known = _BUCKET_OF
    if len(known) > MEMO:
        known.clear()
    words = WORD.findall((text or "").encode().translate(LOWER))
    for w in set(words).difference(known):
        known[w] = 1 + xxhash.xxh32_intdigest(w) % (BUCKETS - 1)
    return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


@dataclass
class ToxicityModel:
    table: np.ndarray | None
    filters: list[np.ndarray] = field(default_factory=list)   # per width: (width * DIM, FILTERS)
    biases: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray | None = None
    intercept: float = 0.0
    threshold: float = 0.5
    thresholds: dict[str, float] = field(default_factory=dict)

    def pooled(self, docs: list[np.ndarray], winners: bool = False):
        """Each document's largest response of every filter (documents, filters) and,
        for training, the words of the windows that gave them, per width (documents,
        FILTERS, width).  The windows of at most CHUNK words are held at a time: a
        longer text is read in pieces, whose largest responses are the text's."""
        out = np.full((len(docs), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        words = [np.zeros((len(docs), FILTERS, w), np.int32) for w in WIDTHS]
        for pieces in _pieces(docs):
            sizes = np.array([len(ids) for _, ids in pieces])
            begin = np.concatenate(([0], np.cumsum(sizes)))
            ids = np.concatenate([*(ids for _, ids in pieces), np.zeros(PAD, np.int32)])
            x, n = self.table[ids], int(begin[-1])
            spans = np.stack((begin[:-1], begin[1:] - PAD), 1)
            of = np.array([d for d, _ in pieces])
            for k, w in enumerate(WIDTHS):
                r = (np.concatenate([x[j:n + j] for j in range(w)], 1) if w > 1 else x[:n]) @ self.filters[k] + self.biases[k]
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                if not winners:
                    np.maximum.at(out[:, own], of, np.maximum.reduceat(r, spans.ravel(), 0)[::2])
                    continue
                place = np.stack([r[a:b].argmax(0) + a for a, b in spans])
                for d, p, top in zip(of, place, np.take_along_axis(r, place, 0)):
                    more = top > out[d, own]
                    out[d, own][more] = top[more]
                    words[k][d][more] = ids[p[more, None] + np.arange(w)]
        return out, words

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        if self.table is None:
            return np.full(len(docs), self.intercept)
        return np.maximum(self.pooled(docs)[0], 0) @ self.weights + self.intercept

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(docs).astype(np.float64)))

    def rejects(self, score: float, lang: str | None) -> bool:
        return score >= self.thresholds.get(lang, self.threshold)


def _pieces(docs: list[np.ndarray]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(document, words with PAD more) in lists of at most CHUNK words.  The PAD
    words after a piece are the text's next ones, or zeros at its end."""
    held, size = [], 0
    for d, ids in enumerate(docs):
        whole = np.concatenate((ids if len(ids) else np.zeros(1, np.int32), np.zeros(PAD, np.int32)))
        n, at = len(whole) - PAD, 0
        while at < n:
            take = min(n - at, CHUNK - size)
            held.append((d, whole[at:at + take + PAD]))
            at, size = at + take, size + take
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


class Trainer:
    """A model with its Adagrad state; ``step`` is one step on the logistic loss."""

    def __init__(self, positive: float, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        m = self.model = ToxicityModel(np.zeros((BUCKETS, DIM), np.float32))
        m.filters = [rng.normal(0, 1 / np.sqrt(w * DIM), (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        m.biases = [np.full(FILTERS, 0.05, np.float32) for _ in WIDTHS]
        m.weights = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        m.intercept = float(np.log((positive + 1) / (rows - positive + 1)))
        self.rng = rng
        self.squares = [np.full(p.shape, 1e-6, np.float32) for p in self.dense()]
        self.table_sq = np.full(BUCKETS, 1e-6, np.float32)
        self.intercept_sq = 1e-6

    def dense(self) -> tuple[np.ndarray, ...]:
        return *self.model.filters, *self.model.biases, self.model.weights

    def step(self, docs: list[np.ndarray], labels: np.ndarray, rate: float) -> np.ndarray:
        """Returns the buckets that it moved."""
        m = self.model
        pooled, seen = m.pooled(docs, winners=True)
        active = np.maximum(pooled, 0)
        z = active @ m.weights + m.intercept
        err = (1 / (1 + np.exp(-z)) - labels).astype(np.float32) / len(docs)
        back = np.outer(err, m.weights) * (pooled > 0)          # (docs, all filters)
        rows, values, grads = [], [], []
        for k, w in enumerate(WIDTHS):
            g = back[:, k * FILTERS:(k + 1) * FILTERS]           # (docs, FILTERS)
            gf = np.zeros_like(m.filters[k])
            for j in range(w):
                word = seen[k][:, :, j]
                gf[j * DIM:(j + 1) * DIM] = np.einsum("df,dfe->ef", g, m.table[word])
                rows.append(word.ravel())
                values.append((g[:, :, None] * m.filters[k][j * DIM:(j + 1) * DIM].T[None]).reshape(-1, DIM))
            grads.append(gf)
        grads += [back[:, k * FILTERS:(k + 1) * FILTERS].sum(0) for k in range(len(WIDTHS))]
        grads.append(active.T @ err + 1e-5 * m.weights)
        for p, s, g in zip(self.dense(), self.squares, grads):
            s += g * g
            p -= (rate * 0.3) * g / np.sqrt(s)
        ge = float(err.sum())
        self.intercept_sq += ge * ge
        m.intercept -= rate * 0.3 * ge / np.sqrt(self.intercept_sq)
        rows, values = np.concatenate(rows), np.concatenate(values)
        own, inverse = np.unique(rows, return_inverse=True)
        total = np.stack([np.bincount(inverse, values[:, e], len(own)) for e in range(DIM)], 1).astype(np.float32)
        total[own == 0] = 0
        self.table_sq[own] += (total * total).mean(1)
        m.table[own] -= rate * total / np.sqrt(self.table_sq[own])[:, None]
        return own

    def flat(self) -> np.ndarray:
        """All parameters but the table, and their squares."""
        return np.concatenate([*(p.ravel() for p in self.dense()), [self.model.intercept],
                               *(s.ravel() for s in self.squares), [self.intercept_sq]]).astype(np.float64)

    def moved(self, flat: np.ndarray) -> None:
        """Adds to what ``flat`` returns."""
        half, at = len(flat) // 2, 0
        for p, s in zip(self.dense(), self.squares):
            p += flat[at:at + p.size].reshape(p.shape).astype(np.float32)
            s += flat[half + at:half + at + p.size].reshape(p.shape).astype(np.float32)
            at += p.size
        self.model.intercept += float(flat[at])
        self.intercept_sq += float(flat[-1])


def train(docs: list[np.ndarray], labels: np.ndarray, seed: int = 1, epochs: int | None = None) -> ToxicityModel:
    """Adagrad on the logistic loss; classes weigh as they are in the sample."""
    epochs = epochs or max(EPOCHS, -(-STEPS * BATCH // len(docs)))
    t = Trainer(labels.sum(), len(labels), seed)
    for epoch in range(epochs):
        rate = 0.1 / (1 + epoch * EPOCHS / epochs)
        order = t.rng.permutation(len(docs))
        for at in range(0, len(order), BATCH):
            chosen = order[at:at + BATCH]
            t.step([docs[i] for i in chosen], labels[chosen], rate)
    return t.model


def _round(rows: DataFrame, trainer: Trainer, rate: float) -> None:
    """One pass over all ``rows`` (shard, ids, label; a shard's rows in a row): every
    shard trains from ``trainer``, which then moves by the mean of their moves."""
    shared = rows.sparkSession.sparkContext.broadcast(trainer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sums over the task's shards; columns of the table: moves, squares, shards.
        start, now, shard = shared.value, None, None
        before, table = start.flat(), np.zeros((BUCKETS, DIM + 2), np.int64)
        flat = np.zeros(len(before) + 1, np.int64)
        touched, held, labels = np.zeros(BUCKETS, bool), [], []

        def step():
            touched[now.step(held, np.array(labels, np.float32), rate)] = True
            held.clear()
            labels.clear()

        def end():
            if held:
                step()
            own = np.flatnonzero(touched)
            for at in range(0, len(own), BLOCK):   # few copies of moved rows at once
                some = own[at:at + BLOCK]
                table[some, :DIM] += np.rint((now.model.table[some] - start.model.table[some]).astype(np.float64) * FIXED).astype(np.int64)
                table[some, DIM] += np.rint((now.table_sq[some] - start.table_sq[some]).astype(np.float64) * FIXED).astype(np.int64)
                table[some, DIM + 1] += 1
            flat[:-1] += np.rint((now.flat() - before) * FIXED).astype(np.int64)
            flat[-1] += 1
            touched[:] = False

        for batch in batches:
            for of, ids, label in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if of != shard:
                    if now is not None:
                        end()
                    now, shard = copy.deepcopy(start), of
                held.append(_unpacked(ids))
                labels.append(label)
                if len(held) == BATCH:
                    step()
        if now is None:
            return
        end()
        yield _sums_batch([(-1, np.zeros(1, np.int32), flat)])
        for at in range(0, BUCKETS, BLOCK):
            own = np.flatnonzero(table[at:at + BLOCK, DIM + 1]).astype(np.int32)
            if len(own):
                yield _sums_batch([(at // BLOCK, own, table[at + own])])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}   # at most BUCKETS / BLOCK + 1
        for batch in batches:
            for block, own, part in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own, part = np.frombuffer(own, np.int32), np.frombuffer(part, np.int64)
                part = part.reshape(len(own), -1)
                if block not in sums:
                    sums[block] = np.zeros((1 if block < 0 else BLOCK, part.shape[1]), np.int64)
                sums[block][own] += part
        for block, total in sums.items():
            own = np.flatnonzero(total[:, -1]).astype(np.int32)
            mean = total[own, :-1] / FIXED / total[own, -1:]
            yield _sums_batch([(block, own, mean if block < 0 else mean.astype(np.float32))])

    schema = "block int, own binary, part binary"
    parts = rows.select("shard", "ids", "label").mapInArrow(released(run), schema)
    means = parts.repartition(16, "block").mapInArrow(add, schema).collect()   # one table's size at most
    shared.unpersist()
    for r in means:
        if r["block"] < 0:
            trainer.moved(np.frombuffer(r["part"], np.float64))
            continue
        own = np.frombuffer(r["own"], np.int32) + r["block"] * BLOCK
        part = np.frombuffer(r["part"], np.float32).reshape(len(own), DIM + 1)
        trainer.model.table[own] += part[:, :DIM]
        trainer.table_sq[own] += part[:, DIM]


def _sums_batch(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in (1, 2))],
                                      ["block", "own", "part"])


def _packed(ids: np.ndarray) -> bytes:
    """Three bytes a bucket."""
    return ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel().astype(np.int32)


def _fit_all(texts: DataFrame, known: DataFrame, n: int, rate: float) -> ToxicityModel:
    """Fit on all ``n`` rows of ``known`` (id, label) by their ``texts`` (id, text, lang):
    shards in rounds.  Words, not texts, are moved, and once: labels meet them in their shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [_packed(word_ids(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), batch.column(2)], ["id", "ids", "lang"])
        _BUCKET_OF.clear()

    kind = texts.schema["id"].dataType.simpleString()
    shards = -(-n // SHARD_ROWS)
    words = texts.select("id", "text", "lang").mapInArrow(released(run), f"id {kind}, ids binary, lang string")
    back = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(HELD_BACK)) == 0
    shard, none = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(None)
    both = words.select(shard, "id", "ids", "lang", none.cast("int").alias("label")).unionByName(
        known.select(shard, "id", none.cast("binary").alias("ids"), none.cast("string").alias("lang"), "label"))
    both = both.repartition(shards, "shard").withColumn("label", F.max("label").over(Window.partitionBy("shard", "id")))
    words = both.filter("ids IS NOT NULL AND label IS NOT NULL").select(
        "shard", F.xxhash64("id", "ids").alias("h"), "ids", "lang", "label", back.alias("back"))
    words = write_shared(words.sortWithinPartitions("shard", "h"), "toxic-words")
    sizes = {(r["back"], r["label"]): r["n"] for r in words.groupBy("back", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get((False, 0), 0), sizes.get((False, 1), 0)
    if not n0 or not n1:
        return ToxicityModel(None, intercept=rate)
    dealt = words.filter("NOT back")
    trainer = Trainer(n1, n0 + n1)
    for epoch in range(EPOCHS):
        _round(dealt, trainer, 0.1 / (1 + epoch))
    model = trainer.model
    shared = words.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_runs(batches, BATCH):
            ids = [_unpacked(x) for x in batch.column(0).to_pylist()]
            scores = [shared.value.scores(ids[at:at + BATCH]) for at in range(0, len(ids), BATCH)] or [np.zeros(0)]
            steps = np.floor(np.concatenate(scores) * STEPS_OF_SCORE).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(steps)], ["lang", "label", "step"])

    held = words.filter("back").select("ids", "lang", "label").mapInArrow(released(scored), "lang string, label int, step int")
    counts = write_shared(held.groupBy("lang", "step").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits")), "toxic-steps")
    every = counts.groupBy("step").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    best = _best_steps(every.withColumn("lang", F.lit(None).cast("string"))).first()
    if best is not None:
        model.threshold = best["step"] / STEPS_OF_SCORE
    for r in _best_steps(counts.filter("lang IS NOT NULL")).filter(F.col("positive") >= FEW).collect():
        model.thresholds[r["lang"]] = r["step"] / STEPS_OF_SCORE
    return model


def _best_steps(counts: DataFrame) -> DataFrame:
    """lang, step, positive: for each language with a positive row, the step from which
    on label 1 has the best F1 (ties: the highest)."""
    own = Window.partitionBy("lang")
    above = own.orderBy(F.desc("step"))
    f1 = 2 * F.sum("hits").over(above) / (F.sum("n").over(above) + F.sum("hits").over(own))
    found = counts.select("lang", "step", F.sum("hits").over(own).alias("positive"), f1.alias("f1"))
    return found.filter("positive > 0").groupBy("lang").agg(F.max(F.struct("f1", "step"))["step"].alias("step"), F.first("positive").alias("positive"))


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The score from which on label 1 is decided with the best F1."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + labels.sum())
    last = np.append(scores[order][1:] != scores[order][:-1], True)
    at = int(np.argmax(np.where(last, f1, -1)))
    below = scores[order][at + 1] if at + 1 < len(order) else 0.0
    return float((scores[order][at] + below) / 2)


def fold(id_col: str, folds: int):
    """crc32 of the id as text, by folds; a null id is an empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def _within_words(texts: DataFrame, sample: DataFrame) -> DataFrame:
    """Of the sample (id, label), each class's first ids in the order of their hash,
    until its share of SAMPLE_WORDS is reached (one id at least)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(WORD.findall((t or "").encode().translate(LOWER))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["id", "label", "n"])

    kind = sample.schema["id"].dataType.simpleString()
    sizes = (texts.join(F.broadcast(sample), "id").select("id", "label", "text").mapInArrow(released(run), f"id {kind}, label int, n long")
             .groupBy("id", "label").agg(F.sum("n").alias("n")))
    own = Window.partitionBy("label")
    before = F.sum("n").over(own.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("*", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(own).alias("words"))
    other = sizes.groupBy((1 - F.col("label")).alias("label")).agg(F.max("words").alias("others"))
    share = F.greatest(F.lit(SAMPLE_WORDS // 2), F.lit(SAMPLE_WORDS) - F.coalesce("others", F.lit(0)))
    return sizes.join(F.broadcast(other), "label", "left").filter((F.col("before") < share) | (F.col("before") == 0)).select("id", "label")


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic", lang_col: str = "lang", train_rows=None, whole: bool = False) -> ToxicityModel:
    """Fit on the labelled rows that satisfy ``train_rows`` (a condition on the
    id; null: all): on all of them if ``whole``, else on a bounded sample."""
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).na.drop()
    known = known.filter(train_rows) if train_rows is not None else known
    known = known.groupBy("id").agg(F.max("label").alias("label")).filter("label in (0, 1)")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    rate = float(np.log((n1 + 1) / (n0 + 1)))
    if not n0 or not n1:
        return ToxicityModel(None, intercept=rate)
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), lang.alias("lang"))
    if whole:
        known_texts = texts.filter(train_rows) if train_rows is not None else texts
        # A word has a byte and one beside it, so this is no fewer than there are words.
        if max(n0, n1) > SAMPLE or (texts.join(known, "id").agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0) > 2 * SAMPLE_WORDS:
            return _fit_all(known_texts.filter("id IS NOT NULL"), known, n0 + n1, rate)
    # At most 2 * SAMPLE ids: a bounded broadcast.
    sample = None
    for label in (0, 1):
        part = known.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
        sample = part if sample is None else sample.unionByName(part)
    texts = texts.join(F.broadcast(_within_words(texts, sample)), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [word_ids(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), batch.column(2), batch.column(3), batch.column(0)],
                                             ["ids", "lang", "label", "id"])

    kind = texts.schema["id"].dataType.simpleString()
    rows = texts.mapInArrow(released(run), f"ids binary, lang string, label int, id {kind}")
    held = [(str(r["id"]), np.frombuffer(r["ids"], np.int32), r["lang"], r["label"]) for r in rows.toLocalIterator()]
    held.sort(key=lambda x: (xxhash.xxh64_intdigest(x[0]), x[1].tobytes()))
    data, langs, marks = ([x[i] for x in held] for i in (1, 2, 3))
    marks = np.array(marks, np.float32)
    if not 0 < marks.sum() < len(marks):
        return ToxicityModel(None, intercept=rate)
    back = np.arange(len(data)) % HELD_BACK == 0
    if len(data) < 200:
        back[:] = False
    keep = np.flatnonzero(~back)
    model = train([data[i] for i in keep], marks[keep])
    # From the sample's odds to those of all labelled rows.
    model.intercept += rate - float(np.log((marks.sum() + 1) / (len(marks) - marks.sum() + 1)))
    own = np.flatnonzero(back) if back.any() else keep
    scores = model.scores([data[i] for i in own])
    # Negative rows stand for more rows than positive ones; best F1 over the whole.
    weigh = lambda s, y: best_threshold(*_repeated(s, y, n0 / max(1, len(marks) - marks.sum()), n1 / max(1, marks.sum())))
    model.threshold = weigh(scores, marks[own])
    for name in sorted({x for x in langs if x is not None}):
        some = np.array([langs[i] == name for i in own])
        if marks[own][some].sum() >= FEW:
            model.thresholds[name] = weigh(scores[some], marks[own][some])
    return model


def _repeated(scores, labels, w0: float, w1: float):
    """Rows in the proportion of their weights (whole numbers)."""
    least = min(w0, w1)
    n = np.where(labels == 1, max(1, round(w1 / least)), max(1, round(w0 / least))).astype(int)
    return np.repeat(scores, n), np.repeat(labels, n)


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text",
                   lang_col: str = "lang") -> DataFrame:
    """Per document: id, score, and ``toxic`` by its language's threshold."""
    lang = F.col(f"`{lang_col}`").cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("string").alias("text"), lang.alias("lang"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_runs(batches, BATCH):
            scores = _score(shared.value, batch.column(1))
            toxic = [shared.value.rejects(s, g) for s, g in zip(scores.tolist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(toxic, pa.bool_())],
                                             [id_col, "score", "toxic"])
        _BUCKET_OF.clear()

    return texts.mapInArrow(released(run), f"`{id_col}` {texts.schema[0].dataType.simpleString()}, score double, toxic boolean")


def _score(model: ToxicityModel, texts: pa.Array) -> np.ndarray:
    """Scores of a batch's texts: the words of BATCH texts are held at a time."""
    return np.concatenate([model.scores([word_ids(t.as_py()) for t in texts[at:at + BATCH]]) for at in range(0, len(texts), BATCH)]
                          or [np.zeros(0)])


def keep_clean(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with all columns, without the rows that the model rejects."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)
    lang = docs.columns.index(lang_col) if lang_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_runs(batches, BATCH):
            langs = batch.column(lang).to_pylist() if lang is not None else [None] * batch.num_rows
            scores = _score(shared.value, batch.column(at)).tolist()
            yield batch.filter(pa.array([not shared.value.rejects(s, g) for s, g in zip(scores, langs)], pa.bool_()))
        _BUCKET_OF.clear()

    return docs.mapInArrow(released(run), docs.schema)
