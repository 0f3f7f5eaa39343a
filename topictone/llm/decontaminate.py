"""Benchmark decontamination with an FM-index per training shard.

A phrase is a window of ``n`` consecutive words of a test item (an item of fewer
words is one phrase).  Each task cuts its documents into shards of bounded size
and builds an FM-index of each shard's words: suffix order by prefix doubling,
the Burrows-Wheeler sequence in a wavelet tree (as a matrix of bit levels with
popcount ranks), and sampled suffix positions.  All phrases are searched
backward at once; the surviving row ranges are located by walking to sampled
positions, and their word spans are merged into removal spans.

Words that are in no phrase cannot be part of an occurrence.  They become
separators, and stretches between separators that are shorter than the shortest
phrase are left out of the index; this is exact.

Test items reach the executors in blocks of at most ``BLOCK_BYTES`` of text, so
each broadcast is bounded whatever the size of the test set; every shard is
searched with every block.  One narrow pass over the documents, no shuffle.

Null texts and items have no words.  Repeated items are items of their own;
repeated documents are repeated rows.  An empty test set hits nothing.  A null
item_id is left out.  Very long texts are shards of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER, collected, groups_of, released, texts_of

#: Bytes of item text in one broadcast, bytes of document text in one shard,
#: and every how many words of a stretch a suffix position is sampled.
BLOCK_BYTES, SHARD_BYTES, SAMPLE = 16 << 20, 4 << 20, 8

#: A word in lower-cased UTF-8: no ASCII besides digits and letters.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().translate(LOWER))


class Phrases:
    """The distinct windows of a block of items, and the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
            for at in range(max(1, len(ids) - n + 1) if ids else 0):
                windows.setdefault(tuple(ids[at:at + n]), set()).add(item)
        self.vocabulary = vocabulary
        #: length -> (ids as rows, list of the items of each row)
        self.by_length: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for length in {len(w) for w in windows}:
            own = [w for w in windows if len(w) == length]
            self.by_length[length] = np.array(own, np.int32), [sorted(windows[w]) for w in own]
        self.shortest = min(self.by_length, default=0)


class WaveletMatrix:
    """Ranks of symbols in a sequence: a bit level per bit of the symbols."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.n, self.bits = len(seq), max(1, int(sigma).bit_length())
        self.words, self.before, self.zeros = [], [], []
        for level in reversed(range(self.bits)):
            bit = (seq >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.pad(packed, (0, 8 - len(packed) % 8)).view("<u8")
            self.words.append(packed)
            self.before.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64))))
            self.zeros.append(int(self.n - bit.sum()))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & mask)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of each symbol stand before each place."""
        start = np.zeros_like(at)
        for level in range(self.bits):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            a, s = self.ones(level, at), self.ones(level, start)
            at = np.where(one, self.zeros[level] + a, at - a)
            start = np.where(one, self.zeros[level] + s, start - s)
        return at - start

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            one = (self.words[level][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            a = self.ones(level, at)
            symbol = symbol * 2 + one
            at = np.where(one, self.zeros[level] + a, at - a)
        return symbol


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling.  Each 0 is a separator of its
    own, so the rounds are bounded by the longest stretch without one."""
    n = len(seq)
    seps = seq == 0
    rank = np.where(seps, np.cumsum(seps) - 1, seq.astype(np.int64) + int(seps.sum()))
    width = 1
    while True:
        later = np.zeros(n, np.int64)
        later[:n - width] = rank[width:] + 1
        key = rank * (int(rank.max()) + 2) + later
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order
        width *= 2
        if width >= n:
            return order


class FMIndex:
    """Index of a sequence that ends in a separator (0)."""

    def __init__(self, seq: np.ndarray, sigma: int):
        order = suffix_order(seq)
        self.bwt = WaveletMatrix(seq[order - 1].astype(np.int64), sigma)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=sigma + 1))))
        # Positions sampled within each stretch: its start and every SAMPLE-th.
        at = np.arange(len(seq))
        starts = np.where(np.concatenate(([True], seq[:-1] == 0)), at, 0)
        kept = (at - np.maximum.accumulate(starts)) % SAMPLE == 0
        self.sampled = kept[order]
        self.place = np.where(self.sampled, order, -1)

    def step(self, symbol: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.bwt.rank(symbol, rows)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers of phrases that occur, and their row ranges."""
        alive = np.arange(len(phrases))
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.bwt.n, np.int64)
        for at in reversed(range(phrases.shape[1])):
            symbol = phrases[alive, at].astype(np.int64)
            lo, hi = self.step(symbol, lo), self.step(symbol, hi)
            some = lo < hi
            alive, lo, hi = alive[some], lo[some], hi[some]
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps = np.empty(len(rows), np.int64), 0
        left, rows = np.arange(len(rows)), rows.copy()
        while len(left):
            there = self.sampled[rows]
            out[left[there]] = self.place[rows[there]] + steps
            left, rows = left[~there], rows[~there]
            rows = self.step(self.bwt.access(rows), rows)
            steps += 1
        return out


def search_shard(ids: np.ndarray, phrases: Phrases) -> Iterator[tuple[np.ndarray, int, list[list[str]], np.ndarray]]:
    """Occurrences in a shard given as word ids (0: in no phrase, and after
    each document): for each phrase length the places, the length, the items
    of each phrase, and the phrase of each place."""
    ends = np.flatnonzero(ids == 0)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    long = ends - starts >= max(1, phrases.shortest)
    starts, sizes = starts[long], ends[long] - starts[long] + 1
    if not len(starts):
        return
    total = int(sizes.sum())
    own = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(total)
    index = FMIndex(ids[own], len(phrases.vocabulary))
    for length, (rows, items) in phrases.by_length.items():
        found, lo, hi = index.search(rows)
        if len(found):
            n = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
            yield own[index.locate(at)], length, items, np.repeat(found, n)


def _spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Merged spans of the hit words in code points."""
    data = text.encode()
    places = [m.span() for m in WORD.finditer(data.translate(LOWER))]
    edges = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    out = []
    for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)):
        start, end = places[a][0], places[b - 1][1]
        out.append((len(data[:start].decode()), len(data[:end].decode())))
    return out


def _cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    if not spans:
        return text
    parts, at = [], 0
    for start, end in spans:
        parts.append(text[at:start])
        at = end
    return "".join([*parts, text[at:]])


class Words:
    """The words of a shard's texts as numbers: four bytes a word, and each distinct
    word once, in place of an object for every occurrence."""

    def __init__(self, texts: list[str | None]):
        known: dict[bytes, int] = {}
        self.docs: list[np.ndarray] = []
        for text in texts:
            words = words_of(text)
            for w in set(words).difference(known):
                known[w] = len(known)
            self.docs.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
        self.distinct = list(known)

    def ids(self, vocabulary: dict[bytes, int], begins: np.ndarray) -> np.ndarray:
        """The vocabulary's ids of all words, a 0 after each text."""
        of = np.fromiter(map(vocabulary.get, self.distinct, repeat(0)), np.int32, len(self.distinct))
        out = np.zeros(int(begins[-1]), np.int32)
        for doc, at in zip(self.docs, begins):
            out[at:at + len(doc)] = of[doc]
        return out


def _check_shard(texts: list[str | None], blocks) -> list[tuple[int, set[str], np.ndarray]]:
    """Per document of a shard: number of words, items found, hit words."""
    words = Words(texts)
    sizes = np.array([len(w) + 1 for w in words.docs])
    begins = np.concatenate(([0], np.cumsum(sizes)))
    hit = np.zeros(int(begins[-1]) + 1, np.int32)
    items: list[set[str]] = [set() for _ in texts]
    for block in blocks:
        phrases = block.value
        if not phrases.by_length:
            continue
        for places, length, names, which in search_shard(words.ids(phrases.vocabulary, begins), phrases):
            np.add.at(hit, places, 1)
            np.add.at(hit, places + length, -1)
            docs = np.searchsorted(begins, places, "right") - 1
            for d, p in np.unique(np.stack((docs, which), 1), axis=0).tolist():
                items[d].update(names[p])
    hit = np.cumsum(hit) > 0
    return [(len(w), i, hit[a:a + len(w)]) for w, i, a in zip(words.docs, items, begins)]


def phrase_blocks(benchmark: DataFrame, n: int, item_col: str, text_col: str) -> list:
    rows = texts_of(benchmark, item_col, text_col).na.drop(subset=[item_col])
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast(Phrases([(str(r[0]), r[1]) for r in block], n))
            for block in collected(rows, BLOCK_BYTES, lambda r: len(r[1] or "") + 64)]


def contamination(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items (ids as strings, in
    string order), items_sha256, contaminated, and the removal spans (start
    and exclusive end in code points)."""
    docs = texts_of(docs, id_col, text_col)
    blocks = phrase_blocks(benchmark, n, item_col, item_text_col)
    names = [id_col, "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated", "spans"]
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in groups_of(batches, text_col, SHARD_BYTES):
            texts = shard.column(1).to_pylist()
            found = [(k, int(h.sum()), sorted(i), _spans(t, h) if h.any() else [])
                     for t, (k, i, h) in zip(texts, _check_shard(texts, blocks))]
            arrays = [shard.column(0).combine_chunks(), *(pa.array(x, t) for x, t in (
                ([f[0] for f in found], pa.int64()), ([f[1] for f in found], pa.int64()),
                ([len(f[2]) for f in found], pa.int64()), ([f[2] for f in found], pa.list_(pa.string())),
                ([hashlib.sha256(",".join(f[2]).encode()).hexdigest() for f in found], pa.string()),
                ([f[1] > 0 for f in found], pa.bool_()),
                ([[{"start": a, "end": b} for a, b in f[3]] for f in found], span)))]
            yield from pa.table(arrays, names).to_batches()

    return docs.mapInArrow(released(run), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_words long, n_hit long, "
                           "n_items long, items array<string>, items_sha256 string, contaminated boolean, "
                           "spans array<struct<start:int,end:int>>")


def remove_contamination(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, text_col: str = "text",
                         item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns and rows, the removal spans cut out of the
    text; texts without a hit are unchanged."""
    blocks = phrase_blocks(benchmark, n, item_col, item_text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in groups_of(batches, text_col, SHARD_BYTES):
            texts = shard.column(at).to_pylist()
            cut = [_cut(t, _spans(t, h)) if h.any() else t
                   for t, (_, _, h) in zip(texts, _check_shard(texts, blocks))]
            yield from shard.set_column(at, text_col, pa.array(cut, pa.string())).to_batches()

    return docs.mapInArrow(released(run), docs.schema)
