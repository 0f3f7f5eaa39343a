"""Language-model scores by online logistic context mixing.

Tokens are words (split at ASCII white space, A-Z lower-cased) and one end per
text.  The HEAD most frequent training words, the end and an escape for all other
words have a Huffman code, so a token is a path of binary decisions, about as
many as its bits of information.  Three predictors give each decision a logit:

* order 0: the exact odds at the node of the code tree;
* order 1 and 2: odds from counts in tables of SLOTS slots, addressed by a hash
  of the node with the last one or two tokens.

A gate, how often the order-1 and order-2 slots were seen, chooses the weights
that add the logits up.  The weights start from a fit on all training texts
(each decision left out of its own counts; sums of gradients and Hessians per task)
and are refined online within each text, after every BLOCK decisions (two or three
words), so a text's score does not depend on other held-out texts or on partitions.  A word outside the head costs its escape
and then its add-one share among those words, whose exact counts are joined from
the corpus's word counts.  The sum is the text's log10 probability;
``bits_per_byte`` relates it to its UTF-8 bytes.

Texts are read twice: for the word counts, and to store their symbols (a number per
token), which every later pass takes; the decisions are made anew in each.

What the corpus gives, over all training rows: exact word counts (partial counts
per group of texts, summed by word) and the slot counts (one table per task, summed by
block).  Only bounded tables reach the driver and are broadcast: HEAD words (or
fewer, as words of equal count stay together) of at most LONG_WORD bytes (longer words count under a digest) and 2 * SLOTS slots.
Tail words are joined by word; none of them is frequent, so none is hot.

Null texts count as empty (one end token).  Without training rows every count is 0
and scores are 0.  Repeated rows give equal rows, also with null ids (a null id is
an empty text for the fold); an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, groups_of, write_shared
from .sketch import mix

HEAD, LONG_WORD, SLOTS, BLOCK = 1 << 17, 64, 1 << 18, 32
#: Slots in one row of a task's table; bytes of text, of symbols that are counted, and
#: of symbols that are scored together (many texts, as all take their steps side by side).
SLOT_ROWS, BATCH_BYTES, SYMBOL_BYTES, SCORE_BYTES = 1 << 12, 1 << 23, 1 << 19, 1 << 23
#: The fit of the first weights: passes at most, the move that ends them, one row
#: of so many for the first passes, ridge.
PASSES, SETTLED, WARM, RIDGE = 25, 0.01, 16, 20.0
#: Tokens whose decisions are worked on at once, texts that take a step together, and
#: decisions that are at hand for their steps: the arrays stay in a core's cache.
NEAR_TOKENS, LANES, AT_HAND = 1 << 11, 1 << 9, 1 << 17
GATES, INPUTS, RATE = 9, 3, 0.0005
END = b""


def _name(word: bytes) -> bytes:
    return word if len(word) <= LONG_WORD else b"\xff" + hashlib.md5(word).digest()


def tokens(text: str | None) -> list[bytes]:
    """The tokens of one text; ``token_ids`` gives those of many at once."""
    return [_name(w) for w in (text or "").encode().translate(LOWER).split()] + [END]


def token_ids(column: pa.ChunkedArray):
    """``tokens`` of texts in a row: the distinct ones, the place of each token among
    these, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.concat_arrays(column.fill_null("").chunks)))
    words, ends = lists.flatten(), lists.offsets.to_numpy()[1:]
    real = pc.greater(pc.binary_length(words), 0)    # white space at a text's ends gives empty words
    ends = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))[ends]
    coded = words.filter(real).dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary())
    if (pc.max(pc.binary_length(distinct)).as_py() or 0) > LONG_WORD:
        distinct = pa.array([_name(w) for w in distinct.to_pylist()], pa.binary())
    ids = np.insert(coded.indices.to_numpy(), ends, len(distinct))
    return pa.concat_arrays([distinct, pa.array([END], pa.binary())]), ids, np.diff(ends, prepend=0) + 1


@dataclass
class Code:
    """Huffman paths of the head's words (1..), and of the escape (0)."""

    index: dict[bytes, int]
    counts: np.ndarray      # of the head's words; [0] is unused
    begin: np.ndarray
    length: np.ndarray
    path: np.ndarray        # 2 * node + bit
    logit: np.ndarray       # per node: order 0

    @staticmethod
    def of(head: list[tuple[bytes, int]], escapes: int) -> "Code":
        weights = [escapes + 1] + [n for _, n in head]
        heap = [(w, i) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        parent: dict[int, tuple[int, int]] = {}
        logits, new = [], len(weights)
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            node = len(logits)
            parent[x], parent[y] = (new, 0), (new, 1)
            logits.append(math.log((b + 0.5) / (a + 0.5)))
            heapq.heappush(heap, (a + b, new))
            new += 1
            assert node + len(weights) == new - 1
        length, nodes, bits = [], [], []
        for i in range(len(weights)):
            path = []
            while i in parent:
                i, bit = parent[i]
                path.append((i - len(weights), bit))
            length.append(len(path))
            nodes += [p[0] for p in reversed(path)]
            bits += [p[1] for p in reversed(path)]
        length = np.array(length, np.int64)
        return Code({w: i + 1 for i, (w, _) in enumerate(head)}, np.array([0] + [n for _, n in head], np.int64),
                    np.concatenate(([0], np.cumsum(length)[:-1])), length, np.array(nodes, np.int32) * 2 + np.array(bits, np.int32),
                    np.array(logits or [0.0], np.float32))

    @property
    def node(self) -> np.ndarray:
        return self.path >> 1

    @property
    def bit(self) -> np.ndarray:
        return (self.path & 1).astype(np.int8)

    def symbols(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.index.get, words, repeat(0)), np.int32, len(words))

    def contexts(self, symbols: np.ndarray, first: np.ndarray):
        """Hashes of the last one and the last two tokens before each token of texts
        in a row (``first`` marks their first tokens)."""
        one = np.concatenate(([0], symbols[:-1])).astype(np.uint64) + np.uint64(1)
        one[first] = 0
        two = np.concatenate(([0], one[:-1])).astype(np.uint64)
        two[first] = 0
        h1 = mix(one)
        return h1, mix(h1 ^ (two + np.uint64(7)))

    def steps(self, symbols: np.ndarray, hashes, keys: bool = False):
        """Node and bit of each decision, its slots of order 1 and 2 (or the ``keys``,
        2 * slot + bit), and the number of decisions of each token."""
        size = self.length.take(symbols)
        at = np.repeat(self.begin.take(symbols) - (np.cumsum(size) - size), size)
        at += np.arange(len(at))
        path = self.path.take(at)
        bit = (path & 1).astype(np.int8)
        path >>= 1
        wide = path.astype(np.uint64)
        wide *= np.uint64(0x9E3779B97F4A7C15)
        slots, low = [], bit.astype(np.uint64) if keys else None
        for h in hashes:
            x = np.repeat(h, size)
            x ^= wide
            x *= np.uint64(0xBF58476D1CE4E5B9)
            if keys:
                x >>= np.uint64(39)
                x &= np.uint64(2 * SLOTS - 2)
                x |= low
            else:
                x >>= np.uint64(40)
                x &= np.uint64(SLOTS - 1)
            slots.append(x.view(np.int64))
        return path, bit, slots, size

    def pieces(self, symbols: np.ndarray, first: np.ndarray):
        """``steps`` of texts in a row, with keys, of NEAR_TOKENS tokens at a time."""
        hashes = self.contexts(symbols, first)
        for at in range(0, len(symbols), NEAR_TOKENS):
            piece = slice(at, at + NEAR_TOKENS)
            yield self.steps(symbols[piece], [h[piece] for h in hashes], keys=True)

    def decisions(self, symbols: np.ndarray, first: np.ndarray):
        """Of texts in a row: node and bit of each decision, its slots of order 1
        and 2, and its token."""
        node, bit, slots, size = self.steps(symbols, self.contexts(symbols, first))
        return node, bit, slots, np.repeat(np.arange(len(symbols)), size)


def _level(n: np.ndarray) -> np.ndarray:
    return (n > 1).astype(np.int8) + (n > 24)


def _odds(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + 0.4) / (n0 + 0.4)).astype(np.float32)


@dataclass
class Mixer:
    """Logits and gate levels of the slots, and the first weights."""

    odds: list[np.ndarray]
    level: list[np.ndarray]
    weights: np.ndarray     # (GATES, INPUTS)

    def inputs(self, code: Code, node, slots):
        x = np.empty((INPUTS, len(node)), np.float32)
        for table, at, out in zip((code.logit, *self.odds), (node, *slots), x):
            table.take(at, out=out, mode="clip")
        gate = self.level[0].take(slots[0])
        gate *= 3
        gate += self.level[1].take(slots[1])
        return x, gate

    def log_probability(self, x, gate, bit, begin: np.ndarray) -> np.ndarray:
        """Natural log probability of each text; ``begin`` has the first
        decision of each and the number of decisions."""
        count = np.diff(begin)
        order = np.argsort(-count, kind="stable")
        out = np.empty(len(order))
        out[order] = self.advance(self.first(len(order)), x, gate, bit, begin[:-1][order], count[order])
        return out

    def first(self, n: int) -> np.ndarray:
        """The first weights of each of n texts."""
        return np.tile(self.weights.astype(np.float32).ravel(), (n, 1))

    def advance(self, weights: np.ndarray, x, gate, bit, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Natural log probability of ``count`` decisions from ``begin`` on of each
        text, by descending count.  All texts take a step of BLOCK decisions
        together; each has ``weights`` of its own, which are refined in place."""
        def view(a):
            """Row i has the BLOCK values from place i on."""
            return np.lib.stride_tricks.sliding_window_view(np.concatenate((a, np.zeros(BLOCK, a.dtype))), BLOCK)

        xs, gates, bits, last = [view(a) for a in x], view(gate), view(bit), weights.shape[1] - INPUTS
        total, within, inputs = np.zeros(len(count)), np.arange(BLOCK), np.arange(INPUTS)[:, None]
        steps = np.arange(0, int(count.max(initial=0)), BLOCK)
        # Of each step: texts that take it, and those that don't end within it.
        active, whole = np.searchsorted(-count, -steps, "left").tolist(), np.searchsorted(-count, -steps - BLOCK, "right").tolist()
        for done, n, m in zip(steps.tolist(), active, whole):
            at = begin[:n] + done
            x, gate, own = [v[at] for v in xs], gates[at].reshape(-1), weights[:n]
            z = own[:, last, None] * x[0]
            for i in range(1, INPUTS):
                z += own[:, last + i, None] * x[i]
            # Nearly all decisions are in the last gate; the others get their own weights.
            other = np.flatnonzero(gate != GATES - 1)
            if len(other):
                place = (other // BLOCK * GATES + gate[other]) * INPUTS + inputs
                x_other = np.stack([v.reshape(-1)[other] for v in x])
                z_other, *more = own.reshape(-1).take(place) * x_other
                for part in more:
                    z_other += part
                z.reshape(-1)[other] = z_other
            one = bits[at].astype(np.float32)
            wrong = z * (1 - 2 * one)
            loss = np.abs(wrong)
            np.negative(loss, loss)
            np.exp(loss, loss)
            np.log1p(loss, loss)
            loss += np.maximum(wrong, 0, wrong)
            np.negative(z, z)
            np.exp(z, z)
            z += 1
            np.divide(1, z, z)
            err = np.subtract(one, z, one)
            if m < n:
                over = within[None] >= (count[m:n] - done)[:, None]
                loss[m:][over] = 0
                err[m:][over] = 0
            total[:n] -= loss.sum(1)
            if len(other):
                err_other = err.reshape(-1)[other]
                err.reshape(-1)[other] = 0
                own += RATE * np.bincount(place.ravel(), (x_other * err_other).ravel(), own.size).astype(np.float32).reshape(own.shape)
            for i in range(INPUTS):
                own[:, last + i] += RATE * np.einsum("nk,nk->n", x[i], err)
        return total

    def score(self, code: Code, symbols: np.ndarray, first: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """``log_probability`` of texts in a row, whose decisions are made as their
        steps need them: AT_HAND or so of at most LANES texts at a time."""
        hashes = code.contexts(symbols, first)
        ends = np.concatenate(([0], np.cumsum(code.length.take(symbols))))
        begin = ends[begin]
        count = np.diff(begin)
        order = np.argsort(-count, kind="stable")
        begin, count, weights, total = begin[:-1][order], count[order], self.first(len(order)), np.zeros(len(order))
        done, most = 0, int(count.max(initial=0))
        while done < most:
            n = int(np.searchsorted(-count, -done, "left"))
            width = max(1, AT_HAND // (min(n, LANES) * BLOCK)) * BLOCK
            for lane in range(0, n, LANES):
                own = slice(lane, min(lane + LANES, n))
                low, size = begin[own] + done, np.minimum(count[own] - done, width)
                token, after = np.searchsorted(ends, low, "right") - 1, np.searchsorted(ends, low + size, "left")
                n_tokens = after - token
                behind = np.cumsum(n_tokens)
                at = np.repeat(token - (behind - n_tokens), n_tokens) + np.arange(behind[-1])
                node, bit, slots, sizes = code.steps(symbols.take(at), [h.take(at) for h in hashes])
                x, gate = self.inputs(code, node, slots)
                made = np.concatenate(([0], np.cumsum(sizes)))[behind - n_tokens]
                total[own] += self.advance(weights[own], x, gate, bit, made + low - ends[token], size)
            done += width
        out = np.empty(len(order))
        out[order] = total
        return out


def _row_marks(sizes: np.ndarray):
    """Of texts in a row: marks of first tokens, and first places."""
    begin = np.concatenate(([0], np.cumsum(sizes)))
    first = np.zeros(begin[-1], bool)
    first[begin[:-1]] = True
    return first, begin


def _flat(code: Code, texts: list[list[bytes]]):
    """Symbols of texts in a row, marks of first tokens, and first places."""
    return code.symbols([w for t in texts for w in t]), *_row_marks(np.array([len(t) for t in texts]))


def _read_symbols(column: pa.ChunkedArray):
    """As ``_flat``, of symbols that were stored."""
    parts = [np.frombuffer(v.as_buffer(), np.int32) for v in column]
    return np.concatenate(parts), *_row_marks(np.array([len(p) for p in parts]))


def _count_words(docs: DataFrame) -> DataFrame:
    """word, n over all training rows: partial counts by groups of texts, then sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, "text", BATCH_BYTES):
            distinct, ids, _ = token_ids(table.column(0))
            yield pa.RecordBatch.from_arrays([distinct, pa.array(np.bincount(ids))], ["word", "n"])

    return docs.filter("NOT held_out").select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _coded(docs: DataFrame, code) -> DataFrame:
    """Per row: id, held_out, warm (it is in the share for the first passes of the
    fit), row (a number), n_bytes, symbols (int32 of each token), and the words
    outside the head with their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        head = pa.array(list(code.value.index), pa.binary())
        for table in groups_of(batches, "text", BATCH_BYTES):
            distinct, ids, sizes = token_ids(table.column("text"))
            known = pc.fill_null(pc.index_in(distinct, value_set=head), -1).to_numpy() + np.int32(1)
            symbols, n = known.take(ids), len(sizes)
            begin = np.concatenate(([0], np.cumsum(sizes)))
            escaped = np.flatnonzero(symbols == 0)
            rare, tf = np.unique((np.searchsorted(begin, escaped, "right") - 1) * len(distinct) + ids[escaped], return_counts=True)
            words = pa.StructArray.from_arrays([distinct.take(pa.array(rare % len(distinct))),
                                                pa.array(tf, pa.int32())], ["word", "tf"])
            offsets = pa.array(np.searchsorted(rare, np.arange(n + 1) * len(distinct)), pa.int32())
            yield from pa.table([
                table.column("id"), table.column("held_out"), table.column("warm"), pa.array(np.arange(at, at + n), pa.int64()),
                pc.fill_null(pc.binary_length(table.column("text")), 0).cast(pa.int64()),
                pa.array([symbols[a:b].tobytes() for a, b in zip(begin, begin[1:])], pa.binary()),
                pa.ListArray.from_arrays(offsets, words)], names).to_batches()
            at += n

    names = ["id", "held_out", "warm", "row", "n_bytes", "symbols", "rare"]
    kind = docs.schema["id"].dataType.simpleString()
    warm = F.pmod(F.xxhash64("id", "text"), F.lit(WARM)) == 0
    return docs.select("id", "text", "held_out", warm.alias("warm")).mapInArrow(
        run, f"id {kind}, held_out boolean, warm boolean, row long, n_bytes long, symbols binary, rare array<struct<word:binary,tf:int>>")


def _symbols_of(docs: DataFrame, code) -> DataFrame:
    """The training rows with their symbols, which are stored or made on the way."""
    return (docs if "symbols" in docs.columns else _coded(docs, code)).filter("NOT held_out")


def _count_slots(docs: DataFrame, code) -> list[np.ndarray]:
    """Per order, (SLOTS, 2) counts of bits 0 and 1 over all training rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SLOTS * 2), np.int64)
        for table in groups_of(batches, "symbols", SYMBOL_BYTES):
            symbols, first, _ = _read_symbols(table.column(0))
            held: list[list[np.ndarray]] = [[], []]
            for _, _, keys, _ in code.value.pieces(symbols, first):
                for order in range(2):
                    held[order].append(keys[order])
            for order in range(2):
                total[order] += np.bincount(np.concatenate(held[order]), minlength=SLOTS * 2)
        rows = [(order, b, part.astype(np.uint32).tobytes()) for order in range(2)
                for b, part in enumerate(total[order].reshape(-1, SLOT_ROWS * 2)) if part.any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                          pa.array([r[2] for r in rows], pa.binary())], ["ord", "block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}  # at most 2 * SLOTS / SLOT_ROWS rows
        for batch in batches:
            for o, b, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                part = np.frombuffer(c, np.uint32).astype(np.int64)
                sums[o, b] = sums[o, b] + part if (o, b) in sums else part
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int32()), pa.array([k[1] for k in sums], pa.int32()),
                                          pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["ord", "block", "counts"])

    schema = "ord int, block int, counts binary"
    parts = _symbols_of(docs, code).select("symbols").mapInArrow(run, schema)
    out = [np.zeros((SLOTS, 2), np.int64) for _ in range(2)]
    for r in parts.repartition(16, "ord", "block").mapInArrow(add, schema).collect():
        out[r["ord"]][r["block"] * SLOT_ROWS:(r["block"] + 1) * SLOT_ROWS] = np.frombuffer(r["counts"], np.int64).reshape(-1, 2)
    return out


def _left_out(counts: list[np.ndarray]) -> list[np.ndarray]:
    """Per order, by 2 * slot + bit: odds of the slots without one decision of that
    bit, as doubles.  Odds are rounded to single precision, so the last bits are
    free; they hold the order's part of the gate (the sum of both has the gate in its
    last four bits), and one look gives both."""
    out = []
    for c, part in zip(counts, (3, 1)):
        n = np.repeat(c[:, None], 2, 1)     # slot, bit that is left out, counts
        for bit in range(2):
            n[:, bit, bit] = np.maximum(n[:, bit, bit] - 1, 0)
        n = n.reshape(-1, 2)
        out.append(_odds(n[:, 0], n[:, 1]).astype(np.float64).view(np.int64) | _level(n.sum(1)) * part)
    return out


def _loss_terms(p: np.ndarray, x: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Of each decision, from its logit: bit less probability, and the inputs times
    the variance."""
    np.clip(p, -30, 30, p)
    np.negative(p, p)
    np.exp(p, p)
    p += 1
    np.divide(1, p, p)
    out = np.empty((1 + INPUTS, len(bit)))
    np.subtract(bit, p, out[0])
    p *= 1 - p
    np.multiply(x, p, out[1:])
    return out


def _fit_sums(docs: DataFrame, code, left_out, weights: np.ndarray) -> np.ndarray:
    """Per gate, the gradient (INPUTS) and Hessian (INPUTS * INPUTS) of the
    logistic loss at ``weights`` over the decisions of all ``docs`` (their
    ``symbols``), each left out of its own slots' counts: sums of each task, summed
    by gate."""
    size = INPUTS + INPUTS * INPUTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code_, tables, sums = code.value, left_out.value, np.zeros((GATES, size))
        for table in groups_of(batches, "symbols", SYMBOL_BYTES):
            symbols, first, _ = _read_symbols(table.column(0))
            for node, bit, keys, _ in code_.pieces(symbols, first):
                x = np.empty((INPUTS, len(bit)))
                x[0] = code_.logit.take(node)
                looks = [tables[i].take(keys[i], out=x[1 + i].view(np.int64), mode="clip") for i in range(2)]
                gate = looks[0] + looks[1]
                gate &= 15
                # Nearly all decisions are in the last gate; the others are put in order, so each gate's are one slice.
                other = np.flatnonzero(gate != GATES - 1)
                terms = _loss_terms(weights[-1] @ x, x, bit)
                terms[:, other] = 0
                sums[-1] += (terms @ x.T).ravel()
                if len(other):
                    other = other[np.argsort(gate[other].astype(np.int8), kind="stable")]
                    count = np.bincount(gate[other], minlength=GATES)
                    x = x[:, other]
                    terms, end = _loss_terms((np.repeat(weights.T, count, axis=1) * x).sum(0), x, bit[other]), np.cumsum(count)
                    for g in np.flatnonzero(count):
                        own = slice(end[g] - count[g], end[g])
                        sums[g] += (terms[:, own] @ x[:, own].T).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(GATES), pa.int32()), *(pa.array(c) for c in sums.T)], names)

    names = ["gate", *(f"s{i}" for i in range(size))]
    parts = docs.select("symbols").mapInArrow(run, ", ".join(["gate int", *(f"{n} double" for n in names[1:])]))
    out = np.zeros((GATES, size))
    for r in parts.groupBy("gate").agg(*(F.sum(n).alias(n) for n in names[1:])).collect():
        out[r["gate"]] = r[1:]
    return out


def _first_weights(docs: DataFrame, code, counts: list[np.ndarray]) -> np.ndarray:
    """Logistic regression per gate over all training rows: Newton steps, with a
    little ridge towards order 0 alone, until no weight moves by more than SETTLED.
    Steps over one row of WARM bring the start near; they don't decide the result."""
    start = np.tile(np.array([1.0, 0, 0]), (GATES, 1))
    shared, weights = docs.sparkSession.sparkContext.broadcast(_left_out(counts)), start.copy()
    train = _symbols_of(docs, code)
    for rows in (write_shared(train.filter("warm").select("symbols"), "cm-warm"), train):
        for _ in range(PASSES):
            sums = _fit_sums(rows, code, shared, weights)
            moved = 0.0
            for g in range(GATES):
                hess = sums[g, INPUTS:].reshape(INPUTS, INPUTS) + RIDGE * np.eye(INPUTS)
                step = np.linalg.solve(hess, sums[g, :INPUTS] - RIDGE * (weights[g] - start[g]))
                step /= max(1.0, float(np.abs(step).max()))
                weights[g] += step
                moved = max(moved, float(np.abs(step).max()))
            if moved < SETTLED:
                break
    shared.unpersist()
    return weights


def _head(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The most frequent words: all with at least the least count that HEAD words
    or fewer reach.  Only those are sent to the driver."""
    hist = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    reached = hist.withColumn("reached", F.sum("words").over(Window.orderBy(F.desc("n"))))
    least = reached.filter(F.col("reached") <= HEAD).agg(F.min("n")).first()[0]
    rows = [] if least is None else counts.filter(F.col("n") >= least).collect()
    return sorted(((bytes(r["word"]), int(r["n"])) for r in rows), key=lambda x: (-x[1], x[0]))


def mixing_scores(docs: DataFrame, held_out, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, bits_per_byte.  ``held_out``: a condition; its rows are not learnt from."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), held_out.alias("held_out"))
    counts = write_shared(_count_words(docs), "cm-words")
    row = counts.agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("V")).first()
    total, distinct = int(row["N"] or 0), int(row["V"])
    head = _head(counts)
    tail_n, tail_v = total - sum(n for _, n in head), distinct - len(head)
    code = Code.of(head, tail_n)
    shared_code = sc.broadcast(code)
    # Written once, so the row numbers are fixed from here on; no text is kept.
    coded = write_shared(_coded(docs, shared_code), "cm-coded")
    slots = _count_slots(coded, shared_code)
    mixer = Mixer([_odds(c[:, 0], c[:, 1]) for c in slots], [_level(c.sum(1)) for c in slots],
                  _first_weights(coded, shared_code, slots))
    shared_mixer = sc.broadcast(mixer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, mixer = shared_code.value, shared_mixer.value
        plus_one = np.log10(code.counts + 1.0)
        for table in groups_of(batches, "symbols", SCORE_BYTES):
            symbols, first, begin = _read_symbols(table.column("symbols"))
            mixed = mixer.score(code, symbols, first, begin) / math.log(10)
            known = np.add.reduceat(np.where(symbols > 0, plus_one[symbols], 0), begin[:-1])
            n_head = np.add.reduceat((symbols > 0).astype(np.int64), begin[:-1])
            yield from pa.table([*(table.column(c) for c in ("id", "held_out", "row", "n_bytes")), pa.array(np.diff(begin), pa.int64()),
                                 pa.array(n_head, pa.int64()), pa.array(known, pa.float64()), pa.array(mixed, pa.float64())], names).to_batches()

    names = ["id", "held_out", "row", "n_bytes", "n_tokens", "n_head", "known", "mixed"]
    kind = docs.schema["id"].dataType.simpleString()
    scored = write_shared(coded.select("id", "held_out", "row", "n_bytes", "symbols").mapInArrow(
        run, f"id {kind}, held_out boolean, row long, n_bytes long, n_tokens long, n_head long, known double, mixed double"), "cm-scored")
    tail = (coded.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.tf").join(counts, "word", "left")
            .groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("rare_known"),
                                F.sum("tf").alias("rare_n"), F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("rare_seen")))
    none = F.lit(0)
    rare_known, rare_n, rare_seen = (F.coalesce(c, none) for c in ("rare_known", "rare_n", "rare_seen"))
    score = F.col("mixed") + rare_known - rare_n * F.lit(math.log10(tail_n + tail_v + 1))
    return scored.join(tail, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_head") + rare_seen).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("known") + rare_known - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"),
        score.alias("score"), (-score * F.lit(math.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))
