"""Byte-level BPE encoding and decoding as a monoid tree reduction.

The encodings of byte strings form a monoid: ``join(enc(a), enc(b)) ==
enc(a + b)``.  A piece of text is cut in halves recursively down to leaves of at
most ``LEAF`` bytes, leaves are merged directly, and neighbours are joined up
the tree.  A join re-encodes a window around the boundary.  The window grows
until the tokens next to it are *stable*: a token sequence is the BPE encoding of
its bytes exactly when each two neighbouring tokens re-encode to themselves.
(The first merge that crosses a token boundary would also be made in the two
tokens alone, as all merges before it stay inside tokens.)  So two checked
pairs at the window's edges prove that no token outside can change.

Decoding maps ids to bytes and concatenates the halves up a tree.

Texts are split by the vocabulary's pattern first, as the public library does,
and each match is encoded by itself; a match that is itself a token is that
token.  Null texts count as empty (no ids); very long matches only make the tree
higher; equal rows give equal rows; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import released, texts_of

LEAF = 32
#: Longest match, in characters, whose ids are remembered, and how many are.
MEMO_CHARS, MEMO_SIZE = 32, 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file (base64 and rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MonoidBPE:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        # Two neighbouring ids a, b, as a * none + b, to the token they make.
        self.none = none = max(ranks.values()) + 1
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.pair = {ranks[t[:i]] * none + ranks[t[i:]]: r for t, r in ranks.items()
                     for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.token = {r: b for b, r in ranks.items()}
        # White space is Unicode's property, as in the pattern's own engine.
        exact = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.split = regex.compile(exact).findall
        ascii_form = pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")
        for cls in ("A-Za-z", "0-9"):  # a class of its own outside brackets
            ascii_form = re.sub(rf"(\[[^\]]*\])|{cls}", lambda m, c=cls: m[1] or f"[{c}]", ascii_form)
        self.split_ascii = re.compile(ascii_form, re.ASCII).findall
        self.memo: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    # -- the monoid ---------------------------------------------------------
    def merged(self, data: bytes) -> list[int]:
        """The ids of a short byte string: lowest rank first, leftmost first."""
        get, none = self.pair.get, self.none
        ids = list(map(self.single.__getitem__, data))
        order = [get(a * none + b, none) for a, b in zip(ids, ids[1:])]
        while order:
            best = min(order)
            if best == none:
                break
            i = order.index(best)
            ids[i] = best
            del ids[i + 1], order[i]
            if i:
                order[i - 1] = get(ids[i - 1] * none + best, none)
            if i < len(order):
                order[i] = get(best * none + ids[i + 1], none)
        return ids

    def stable(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens re-encode to themselves."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > MEMO_SIZE:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.token[a] + self.token[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right:
            return left + right
        if self.stable(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            window = self.merged(b"".join(self.token[t] for t in left[-i:] + right[:j]))
            ok_left = i >= len(left) or self.stable(left[-i - 1], window[0])
            ok_right = j >= len(right) or self.stable(window[-1], right[j])
            if ok_left and ok_right:
                return left[:-i] + window + right[j:]
            i = i if ok_left else min(2 * i, len(left))
            j = j if ok_right else min(2 * j, len(right))

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.merged(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    # -- texts --------------------------------------------------------------
    def piece(self, text: str) -> bytes:
        data = text.encode()
        whole = self.ranks.get(data)
        ids = self.tree(data) if whole is None else [whole]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(text) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_SIZE:
                self.memo.clear()
            self.memo[text] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.  Pieces of the
        pattern never merge with each other, so their join is concatenation."""
        pieces = (self.split_ascii if text.isascii() else self.split)(text)
        get, piece = self.memo.get, self.piece
        return b"".join([get(p) or piece(p) for p in pieces])

    def decode(self, ids: bytes) -> bytes:
        if len(ids) <= 1 << 16:
            return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        half = len(ids) // 8 * 4
        return self.decode(ids[:half]) + self.decode(ids[half:])


def bpe_documents(df: DataFrame, ranks: dict[bytes, int], pattern: str, *, id_col: str = "doc_id",
                  text_col: str = "text", digests: bool = False) -> DataFrame:
    """Per document: id, n_tokens, and ``ids`` (array of int) with ``decoded``
    (string), or with ``digests`` the SHA-256 of both.

    The rank table is broadcast; its size is the vocabulary's (under 1 MB for
    50,000 tokens), whatever the corpus holds.  One narrow pass, no shuffle."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Made for each task: a Python worker outlives it and serves other stages.
        bpe = MonoidBPE(*shared.value)
        for batch in batches:
            n, ids_out, text_out = [], [], []
            for value in batch.column(1):
                ids = bpe.encode(value.as_py() or "")
                back = bpe.decode(ids)
                n.append(len(ids) // 4)
                if digests:
                    ids_out.append(hashlib.sha256(ids).hexdigest())
                    text_out.append(hashlib.sha256(back).hexdigest())
                else:
                    ids_out.append(np.frombuffer(ids, "<u4").astype("i4"))
                    text_out.append(back.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()),
                 pa.array(ids_out, pa.string() if digests else pa.list_(pa.int32())),
                 pa.array(text_out, pa.string())], names)

    docs = texts_of(df, id_col, text_col)
    names = [id_col, "n_tokens"] + (["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])
    kinds = ["long"] + (["string", "string"] if digests else ["array<int>", "string"])
    schema = ", ".join([f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}",
                        *(f"{a} {b}" for a, b in zip(names[1:], kinds))])
    return docs.mapInArrow(released(run), schema)
