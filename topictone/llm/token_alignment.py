"""Cross-tokenizer alignment: which tokens of vocabulary A and of vocabulary B
cover the same bytes, and how often each id pair does so in the whole corpus.

Both tokenizers encode space+text (B adds the space itself).  Byte offsets at which
tokens of both end cut a text into groups; a link is a pair of token occurrences
whose byte ranges overlap.

No token of either goes on over a space that follows another character, so a text is cut
there into units, and a task encodes and aligns each different unit once (its memo
holds MEMO units or MEMO_BYTES bytes and is then emptied).  A's file is read as
ranks (its merges must be in the order of their ids) and encoded by PATTERN.

* First pass: every task aligns its texts and writes its own counts of id pairs.
* The distinct pairs get a minimal perfect hash: pairs are dealt into buckets, each
  bucket (one task's work) sets bits in a few levels (a pair that shares its bit
  goes on to the next level), and the rank of a pair's bit is its number.
* Counts are dense vectors indexed by that number: tasks add their blocks of counts to
  vectors, which are summed in a tree of two steps.
* Second pass: the texts are aligned again, and every link looks its count up; the pair
  stored at its number must be the link's own.

Bounds: pairs are handled in groups of GROUP_BUCKETS buckets of BUCKET pairs, and one
group's hash, pairs and counts (about 17 bytes a pair) are on the driver and sent out
at a time, so nothing grows with the corpus.  Where there is more than one group, the
second pass keeps the texts' ids (two bytes an id for vocabularies of up to 65,536),
and each further group is a further narrow pass over the ids, without a shuffle of
texts or links.  The highest count of each B id is a vector of B's vocabulary.  A
unit (a stretch without a space) stays whole, whatever its length.

Texts that are null, empty, or that a tokenizer doesn't give back byte for byte have no
tokens: zeros and an empty ``groups_sha256``.  Repeated rows count each and give
a row each, null ids included.  An empty table gives an empty table.  Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups_of, texts_of, write_shared
from .sketch import mix

#: The published pattern of A's byte-level vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text aligned together; units and their bytes that a task remembers;
#: pairs in one row of counts; units that are encoded side by side.
BATCH_BYTES, MEMO, MEMO_BYTES, BLOCK, JOINED = 1 << 22, 300_000, 1 << 23, 1 << 16, 1024
#: Pairs a bucket, buckets a group, bits a pair in a level, counters in one row of a
#: vector, and how many sums the first step of the tree gives for each.
BUCKET, GROUP_BUCKETS, LOAD, SEGMENT, FAN = 1 << 16, 32, 2, 1 << 16, 16

_SPACES, _CUT = re.compile(r"\s "), re.compile(r"(?<=\S)(?= )")


def _byte_chars() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable
    Latin-1 for itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


def _bytes_of_b(piece: str) -> bytes:
    code = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
    return bytes([int(code[1], 16)]) if code else piece.replace("▁", " ").encode()


def units(text: str) -> list[str]:
    """space+text, cut before each space that follows a character other than white
    space.  Every unit is given without the space it begins with."""
    if _SPACES.search(text) or text.startswith(" "):
        return [u[1:] for u in _CUT.split(" " + text)]
    return text.split(" ")


class TokenizerPair:
    """Both tokenizers and their tokens' bytes, made in a task from the files' contents."""

    def __init__(self, a_json: bytes, b_model: bytes):
        import sentencepiece
        import tiktoken

        model = json.loads(a_json)["model"]
        vocab, chars = model["vocab"], _byte_chars()
        merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
        if any(x >= y for x, y in zip(merged, merged[1:])):
            raise ValueError("the merges of A aren't in the order of their ids")
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.a_bytes[i] = bytes(chars[c] for c in entry)
        ranks = {self.a_bytes[i]: i for i in {*merged, *(vocab[c] for c in chars)}}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece goes on over a space: texts can't be cut into units")
        self.b_bytes = [_bytes_of_b(p) for p in pieces]
        self.a_size, self.b_size = np.array([len(x) for x in self.a_bytes]), np.array([len(x) for x in self.b_bytes])

    def encode(self, parts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A, and of B, of the units in a row, and how many each unit has; the third
        pair: whether both give the unit's bytes back, and its length."""
        whole = [(" " + p).encode() for p in parts]
        size = np.fromiter(map(len, whole), np.int64, len(whole))
        # Units that end in something else than white space are encoded side by side.
        joined, held = [], []
        for p in parts:
            if p and not p[-1].isspace():
                held.append(p)
                if len(held) < JOINED:
                    continue
            elif held:
                joined += [" ".join(held), p]
                held = []
                continue
            else:
                joined.append(p)
                continue
            joined.append(" ".join(held))
            held = []
        joined += [" ".join(held)] if held else []
        a = np.fromiter(chain.from_iterable(self.a.encode_ordinary(" " + t) for t in joined), np.int64)
        ends = np.concatenate(([0], np.searchsorted(np.cumsum(self.a_size[a]), np.cumsum(size), "right")))
        n_a = ends[1:] - ends[:-1]
        # B adds no space to an empty text.
        b = [y if p else [self.b.piece_to_id("▁")] for y, p in zip(self.b.encode(parts, num_threads=1) if parts else [], parts)]
        n_b = np.fromiter(map(len, b), np.int64, len(b))
        b = np.fromiter(chain.from_iterable(b), np.int64)
        same = self._same(a, n_a, self.a_bytes, self.a_size, whole, size) & self._same(b, n_b, self.b_bytes, self.b_size, whole, size)
        if not same.all():
            a, b, n_a, n_b = a[np.repeat(same, n_a)], b[np.repeat(same, n_b)], n_a * same, n_b * same
        return [(a, n_a), (b, n_b), (same, size)]

    @staticmethod
    def _same(ids, n, entries, sizes, whole, size) -> np.ndarray:
        ends = np.concatenate(([0], np.cumsum(sizes[ids])))[np.concatenate(([0], np.cumsum(n)))]
        given = b"".join(map(entries.__getitem__, ids.tolist()))
        same = np.diff(ends) == size
        if not (same.all() and given == b"".join(whole)):
            same = np.array([given[x:y] == w for x, y, w in zip(ends[:-1].tolist(), ends[1:].tolist(), whole)], bool)
        return same


@dataclass
class Alignment:
    """Texts in a row: tokens, where each text's begin, and the links."""

    a: np.ndarray
    b: np.ndarray
    begin_a: np.ndarray
    begin_b: np.ndarray
    link_a: np.ndarray      # token of A and of B of each link, in byte order
    link_b: np.ndarray
    last: np.ndarray        # the link is its group's last
    begin: np.ndarray       # first link of each text

    @staticmethod
    def of(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray) -> "Alignment":
        begin_a, begin_b = (np.concatenate(([0], np.cumsum(n))) for n in (n_a, n_b))
        end_a, end_b = np.cumsum(a_size[a]), np.cumsum(b_size[b])
        ends = np.sort(np.concatenate((end_a, end_b)), kind="stable")
        ends = ends[np.concatenate((ends[1:] != ends[:-1], [True]))] if len(ends) else ends
        link_a, link_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        last = (end_a[link_a] == ends) & (end_b[link_b] == ends)
        first_byte = np.concatenate(([0], end_a))[begin_a]
        return Alignment(a, b, begin_a, begin_b, link_a, link_b, last, np.searchsorted(ends, first_byte, "right"))

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """Sums over each text's links."""
        total = np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))[self.begin]
        return total[1:] - total[:-1]

    def keys(self, b_count: int) -> np.ndarray:
        return self.a[self.link_a] * b_count + self.b[self.link_b]

    def groups(self) -> list[bytes]:
        """Each text's ``a1,a2|b1;a3|b2,b3``."""
        n_a, n_b = len(self.a), len(self.b)
        stop_a, stop_b = self.link_a[self.last] + 1, self.link_b[self.last] + 1
        begin_a, begin_b = (np.concatenate(([0], s[:-1])) if len(s) else s for s in (stop_a, stop_b))
        at_a = np.arange(n_a) + np.repeat(begin_b, stop_a - begin_a)
        at_b = np.arange(n_b) + np.repeat(stop_a, stop_b - begin_b)
        ids, mark = np.empty(n_a + n_b, np.int64), np.full(n_a + n_b, ord(","), np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        mark[at_a[stop_a - 1]], mark[at_b[stop_b - 1]] = ord("|"), ord(";")
        width = len(str(int(ids.max(initial=0))))
        power = 10 ** np.arange(width - 1, -1, -1)
        cells = np.empty((len(ids), width + 1), np.uint8)
        cells[:, :width] = ids[:, None] // power % 10 + ord("0")
        cells[:, width] = mark
        shown = np.ones(cells.shape, bool)
        shown[:, :width - 1] = ids[:, None] >= power[:-1]
        flat = cells[shown].tobytes()
        ends = np.concatenate(([0], np.cumsum(shown.sum(1))))[self.begin_a + self.begin_b]
        return [flat[x:y - 1] if y > x else b"" for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]


class Units:
    """The different units that a task has met: a number, ids, links and sums each."""

    SUMS = ["n_a", "n_b", "n_groups", "n_links"]

    def __init__(self, pair: TokenizerPair, look=None):
        """``look``: of links' pairs, the columns that are added up by text; without it
        only pairs are wanted, no digests."""
        self.pair, self.look = pair, look
        self.number: dict[str, int] = {}
        self.shown: list[bytes] = []
        self.same, self.a, self.b, self.keys = np.zeros(0, bool), [], [], []
        self.sums = np.zeros((len(self.SUMS) + (2 if look else 0), 0), np.int64)
        self.bytes = 0

    def full(self) -> bool:
        return len(self.number) > MEMO or self.bytes > MEMO_BYTES

    def _learn(self, parts: list[str]) -> None:
        a, b, (same, size) = self.pair.encode(parts)
        al = Alignment.of(*a, *b, self.pair.a_size, self.pair.b_size)
        keys = al.keys(len(self.pair.b_bytes))
        sums = [np.diff(al.begin_a), np.diff(al.begin_b), al.per_text(al.last), np.diff(al.begin)]
        if self.look:
            sums += [al.per_text(x) for x in self.look(keys)]
        self.number.update(zip(parts, range(len(self.number), len(self.number) + len(parts))))
        if self.look:
            self.shown += al.groups()
        self.same = np.concatenate((self.same, same))
        self.sums = np.concatenate((self.sums, np.stack(sums)), 1)
        self.a.append(al.a)
        self.b.append(al.b)
        self.keys.append(keys)
        self.bytes += int(size.sum())

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The unit numbers of the texts in a row, and where each text begins.  A text
        with a unit that doesn't come back has none."""
        cut = [units(t) if t else [] for t in texts]
        flat = [u for c in cut for u in c]
        new = set(flat).difference(self.number)
        if new:
            self._learn(list(new))
        numbers = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        sizes = np.array([len(c) for c in cut], np.int64)
        owner = np.repeat(np.arange(len(cut)), sizes)
        lost = np.zeros(len(cut), bool)
        lost[owner[~self.same[numbers]]] = True
        sizes[lost] = 0
        return numbers[~lost[owner]], np.concatenate(([0], np.cumsum(sizes)))

    def per_text(self, numbers: np.ndarray, begin: np.ndarray) -> np.ndarray:
        total = np.concatenate((np.zeros((len(self.sums), 1), np.int64), np.cumsum(self.sums[:, numbers], 1)), 1)[:, begin]
        return total[:, 1:] - total[:, :-1]

    def digests(self, numbers: np.ndarray, begin: np.ndarray) -> list[str]:
        shown = list(map(self.shown.__getitem__, numbers.tolist()))
        return [hashlib.sha256(b";".join(shown[x:y])).hexdigest() if y > x else "" for x, y in zip(begin[:-1].tolist(), begin[1:].tolist())]

    def ids(self, numbers: np.ndarray, begin: np.ndarray, side: int, kind) -> list[bytes]:
        """The ids of A (0) or B (1) of each text, as bytes."""
        flat, size = np.concatenate((self.a, self.b)[side]).astype(kind), self.sums[side]
        first = np.concatenate(([0], np.cumsum(size)[:-1]))[numbers]
        size = size[numbers]
        ends = np.concatenate(([0], np.cumsum(size)))
        flat = flat[np.repeat(first - ends[:-1], size) + np.arange(int(ends[-1]))]
        return [flat[x:y].tobytes() for x, y in zip(ends[begin[:-1]].tolist(), ends[begin[1:]].tolist())]


def _first_pass(docs: DataFrame, files) -> DataFrame:
    """Blocks of pairs and their counts: of each task, as often as its memo is full."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = TokenizerPair(*files.value)
        known, seen = Units(pair), np.zeros(0, np.int64)

        def blocks():
            keys, links = np.concatenate(known.keys), known.sums[3]
            distinct, place = np.unique(keys, return_inverse=True)
            counts = np.zeros(len(distinct), np.int64)
            np.add.at(counts, place, np.repeat(seen, links))
            distinct, counts = distinct[counts > 0], counts[counts > 0]   # of lost texts only
            for at in range(0, len(distinct), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([x[at:at + BLOCK].tobytes()]) for x in (distinct, counts)], ["keys", "counts"])

        for table in groups_of(batches, "text", BATCH_BYTES):
            numbers, _ = known.of(table.column("text").to_pylist())
            seen = np.concatenate((seen, np.zeros(len(known.number) - len(seen), np.int64))) + np.bincount(numbers, minlength=len(known.number))
            if known.full():
                yield from blocks()
                known, seen = Units(pair), np.zeros(0, np.int64)
        if known.number:
            yield from blocks()

    return docs.select("text").mapInArrow(run, "keys binary, counts binary")


def _levels(keys: np.ndarray) -> list[np.ndarray]:
    """Bits (whole 64-bit words) of each level; every key has one bit of its own."""
    out, rest = [], keys
    while len(rest):
        size = -(-LOAD * len(rest) // 64) * 64
        at = _spot(rest, len(out), size)
        alone = np.bincount(at, minlength=size) == 1
        out.append(np.packbits(alone, bitorder="little"))
        rest = rest[~alone[at]]
    return out


def _spot(keys: np.ndarray, level: int, size) -> np.ndarray:
    h = mix(mix(keys.astype(np.uint64) + np.uint64(0x51ED270B * (level + 1))))
    return ((h >> np.uint64(32)) * np.asarray(size, np.uint64) >> np.uint64(32)).astype(np.int64)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(keys.astype(np.uint64)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class PairIndex:
    """The minimal perfect hash of a group of buckets, and the pair at each number."""

    def __init__(self, buckets: int, first: int, rows: list[tuple[int, list[bytes], bytes]]):
        """``rows``: number, levels and pairs of the buckets from ``first`` on."""
        self.buckets, self.first = buckets, first
        depth = max((len(r[1]) for r in rows), default=0)
        self.size = np.zeros((depth, max((r[0] - first + 1 for r in rows), default=0)), np.int64)
        self.offset = np.zeros_like(self.size)
        bits, total = [np.zeros(0, np.uint8)], 0
        for level in range(depth):
            for bucket, levels, _ in rows:
                if level < len(levels):
                    self.size[level, bucket - self.first], self.offset[level, bucket - self.first] = len(levels[level]) * 8, total
                    bits.append(np.frombuffer(levels[level], np.uint8))
                    total += len(levels[level]) * 8
        self.bits = np.concatenate(bits)
        ones = np.unpackbits(self.bits.view(np.uint64).view(np.uint8)).reshape(-1, 64).sum(1)
        self.rank = np.concatenate(([0], np.cumsum(ones)))
        keys = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r[2], np.int64) for r in rows)])
        self.pairs = np.full(len(keys), -1, np.int64)
        number = self.numbers(keys, verify=False)
        self.pairs[number] = keys
        assert (self.pairs[number] == keys).all() and int(self.rank[-1]) == len(keys)

    def __len__(self) -> int:
        return len(self.pairs)

    def numbers(self, keys: np.ndarray, verify: bool = True) -> np.ndarray:
        """The number of each key; -1 where the key stored there is another."""
        out = np.full(len(keys), -1, np.int64)
        bucket = _bucket(keys, self.buckets) - self.first
        open_ = np.flatnonzero((bucket >= 0) & (bucket < self.size.shape[1]))
        for level in range(len(self.size)):
            own = bucket[open_]
            some = self.size[level, own] > 0
            open_, own = open_[some], own[some]
            at = self.offset[level, own] + _spot(keys[open_], level, self.size[level, own])
            hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            spot = at[hit]
            out[open_[hit]] = self.rank[spot >> 6] + self._before(spot)
            open_ = open_[~hit]
            if not len(open_):
                break
        if verify and len(self):
            out[(out >= 0) & (self.pairs[np.maximum(out, 0)] != keys)] = -1
        return out

    def _before(self, spot: np.ndarray) -> np.ndarray:
        """Bits set in the spot's word before it."""
        words = self.bits.view("<u8")[spot >> 6] & ((np.uint64(1) << (spot & 63).astype(np.uint64)) - np.uint64(1))
        return np.bitwise_count(words).astype(np.int64)


def _built(distinct: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket: its levels and pairs."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_bucket(keys, buckets)), pa.array(keys)], ["bucket", "key"])

    def build(frame):
        import pandas as pd

        keys = np.sort(frame["key"].to_numpy())
        return pd.DataFrame({"bucket": [int(frame["bucket"].iloc[0])], "levels": [[x.tobytes() for x in _levels(keys)]], "pairs": [keys.tobytes()]})

    return distinct.mapInArrow(deal, "bucket long, key long").groupBy("bucket").applyInPandas(
        build, "bucket long, levels array<binary>, pairs binary")


def _distinct(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(cell.as_py(), np.int64))], ["key"])

    return blocks.select("keys").mapInArrow(run, "key long").distinct()


def _dense_counts(blocks: DataFrame, index, size: int) -> np.ndarray:
    """The count of every pair of the group, by its number."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for keys, counts in zip(batch.column(0), batch.column(1)):
                number = index.value.numbers(np.frombuffer(keys.as_py(), np.int64))
                total[number[number >= 0]] += np.frombuffer(counts.as_py(), np.int64)[number >= 0]   # a block's keys are distinct
        part = TaskContext.get().partitionId() % FAN
        for segment, at in enumerate(range(0, size, SEGMENT)):
            if total[at:at + SEGMENT].any():
                yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([part], pa.int32()),
                                                  pa.array([total[at:at + SEGMENT].tobytes()])], ["segment", "part", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None      # rows come sorted: one sum at a time
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(3))):
                at, counts = (row[0].as_py(), row[1].as_py()), np.frombuffer(row[2].as_py(), np.int64)
                if at == held:
                    total = total + counts
                    continue
                if held is not None:
                    yield out(held, total)
                held, total = at, counts
        if held is not None:
            yield out(held, total)

    def out(at, total):
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([total.tobytes()])],
                                          ["segment", "part", "counts"])

    schema = "segment int, part int, counts binary"
    summed = blocks.select("keys", "counts").mapInArrow(add, schema)
    for part in (F.col("part"), F.lit(0)):
        summed = (summed.withColumn("part", part).repartition("segment", "part").sortWithinPartitions("segment", "part")
                  .mapInArrow(merge, schema))
    counts = np.zeros(size, np.int64)
    for row in summed.collect():
        counts[row["segment"] * SEGMENT:(row["segment"] + 1) * SEGMENT] = np.frombuffer(row["counts"], np.int64)
    return counts


def _look(found, b_count: int):
    """Of links' pairs: whether their count is the highest of their B id, and the
    count; 0 of pairs of other groups."""
    index, counts, best = found

    def look(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number = index.numbers(keys)
        count = np.where(number >= 0, np.append(counts, 0)[number], 0)   # -1: the 0 at the end
        return (number >= 0) & (count == best[keys % b_count]), count

    return look


_SIZES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
_ROWS = "id {}, " + ", ".join(f"{n} long" for n in _SIZES) + ", groups_sha256 string"


def _second_pass(docs: DataFrame, files, found, b_count: int, keep_ids: bool) -> DataFrame:
    """Every text aligned again, its links looked up in the first group of pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, look = TokenizerPair(*files.value), _look(found.value, b_count)
        kinds = [np.uint16 if len(x) <= 1 << 16 else np.uint32 for x in (pair.a_bytes, pair.b_bytes)]
        known = Units(pair, look)
        for table in groups_of(batches, "text", BATCH_BYTES):
            at = known.of(table.column("text").to_pylist())
            columns = [table.column("id"), *map(pa.array, known.per_text(*at)), pa.array(known.digests(*at), pa.string())]
            if keep_ids:
                columns += [pa.array(known.ids(*at, side, kind), pa.binary()) for side, kind in enumerate(kinds)]
            yield from pa.table(columns, ["id", *_SIZES, "groups_sha256", "a", "b"][:len(columns)]).to_batches()
            if known.full():
                known = Units(pair, look)

    return docs.mapInArrow(run, _ROWS.format(docs.schema["id"].dataType.simpleString()) + (", a binary, b binary" if keep_ids else ""))


def _further_pass(texts: DataFrame, sizes, found, b_count: int) -> DataFrame:
    """The texts with what their links find in one more group of pairs added."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_size, b_size = sizes.value
        look = _look(found.value, b_count)
        kinds = [np.uint16 if len(s) <= 1 << 16 else np.uint32 for s in (a_size, b_size)]
        for table in groups_of(batches, "a", BATCH_BYTES):
            sides = []
            for name, kind in zip("ab", kinds):
                own = [np.frombuffer(x.as_py(), kind) for x in table.column(name)]
                sides += [np.concatenate(own).astype(np.int64), np.array([len(x) for x in own], np.int64)]
            al = Alignment.of(*sides, a_size, b_size)
            add = {name: al.per_text(x) for name, x in zip(("n_best", "count_sum"), look(al.keys(b_count)))}
            yield from pa.table([pa.array(table.column(n).to_numpy() + add[n]) if n in add else table.column(n) for n in table.column_names],
                                table.column_names).to_batches()

    return texts.mapInArrow(run, texts.schema)


def aligned_texts(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per row."""
    sc = docs.sparkSession.sparkContext
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        contents = (a.read(), b.read())
    pair = TokenizerPair(*contents)
    b_count, sizes, files = len(pair.b_bytes), sc.broadcast((pair.a_size, pair.b_size)), sc.broadcast(contents)
    docs = texts_of(docs, id_col, text_col).toDF("id", "text")
    blocks = write_shared(_first_pass(docs, files), "alignment-counts")
    distinct = write_shared(_distinct(blocks), "alignment-pairs")
    buckets = max(1, -(-distinct.count() // BUCKET))
    built = write_shared(_built(distinct, buckets), "alignment-hash")
    groups = range(0, buckets, GROUP_BUCKETS)

    def group(at: int):
        rows = built.filter(F.col("bucket").between(at, at + GROUP_BUCKETS - 1)).collect()
        index = PairIndex(buckets, at, [(r["bucket"], [bytes(x) for x in r["levels"]], bytes(r["pairs"])) for r in sorted(rows, key=lambda r: r["bucket"])])
        sent = sc.broadcast(index)
        counts = _dense_counts(blocks, sent, len(index))
        sent.unpersist()
        return index, counts

    best = np.zeros(b_count, np.int64)
    for at in groups:
        held = group(at)
        np.maximum.at(best, held[0].pairs % b_count, held[1])
    texts = None
    for at in groups:
        held = held if len(groups) == 1 else group(at)   # an only group isn't counted again
        sent = sc.broadcast((*held, best))
        texts = write_shared(_second_pass(docs, files, sent, b_count, len(groups) > 1) if texts is None
                             else _further_pass(texts, sizes, sent, b_count), "alignment-texts")
        sent.unpersist()
    files.unpersist()
    sizes.unpersist()
    return texts.select(F.col("id").alias(id_col), *_SIZES, "groups_sha256")
