"""Sums of token weights per text when the weights are too many to broadcast.

Texts are read in chunks (Arrow batches).  A chunk's distinct tokens are numbered, and
each text is kept as numbers and counts.  What is joined to the weights is one row per
chunk and distinct token, not one per text and token; the weights go back to
their chunk, where the texts' sums are taken.  A token has one row per chunk at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

CHUNK, ID, TOKENS, IDS, COUNTS, NTOK = "__tt_chunk", "__tt_id", "__tt_tokens", "__tt_ids", "__tt_counts", "__tt_ntok"


def _planes(numbers: np.ndarray) -> bytes:
    """All low bytes, then the next ones: the high bytes are mostly 0 and compress."""
    return numbers.view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


def packed_sums(texts: DataFrame, tokens, width: int, weigh: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of ``texts`` but its last (the text), ``__tt_sums`` (array of
    ``width`` bigints) and ``__tt_ntok`` of each row.  ``tokens``: the token array;
    ``weigh``: joins ``__tt_chunk, __tt_id, token`` to weights, with the column
    ``k`` (array<bigint>) of the known tokens."""
    names = texts.columns[:-1]
    rows = texts.select(*(F.col(f"`{c}`") for c in names), tokens.alias(TOKENS))
    n = len(names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            lists = batch.column(n)
            coded = lists.flatten().dictionary_encode()
            size = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(len(size)), size)
            own = np.stack([doc, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)], 1)
            key, counts = np.unique(own[:, 0] << 32 | own[:, 1], return_counts=True)
            ids, counts = (key & 0xFFFFFFFF).astype("<i4"), counts.astype("<i4")
            ends = np.searchsorted(key, np.arange(len(size) + 1) << 32)
            cut = [slice(a, b) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array([chunk] * len(size), pa.int64()), pa.array([_planes(ids[c]) for c in cut], pa.binary()),
                 pa.array([_planes(counts[c]) for c in cut], pa.binary()), pa.array(size.astype(np.int64)),
                 pa.nulls(len(size), pa.list_(pa.string()))], out)
            words = pa.array([coded.dictionary.to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(1, c.type) for c in batch.columns[:n]), pa.array([chunk], pa.int64()), pa.nulls(1, pa.binary()),
                 pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), words], out)
            chunk += 1

    def add(docs: pa.Table, known: pa.Table) -> pa.Table:
        ids, counts = (np.concatenate([_numbers(x) for x in docs.column(c).to_pylist()]).astype(np.int64) for c in (IDS, COUNTS))
        k = np.zeros((int(ids.max(initial=-1)) + 1, width), np.int64)
        if known.num_rows:
            k[known.column(ID).to_numpy()] = known.column("k").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        upto = np.concatenate((np.zeros((1, width), np.int64), np.cumsum(k[ids] * counts[:, None], 0)))
        ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in docs.column(IDS).to_pylist()]))).astype(np.int64)
        sums = (upto[ends[1:]] - upto[ends[:-1]]).ravel()
        offsets = pa.array(np.arange(0, len(sums) + 1, width, dtype=np.int32))
        return pa.table([*(docs.column(c) for c in names), pa.ListArray.from_arrays(offsets, pa.array(sums)), docs.column(NTOK)],
                        [*names, "__tt_sums", NTOK])

    out = [*names, CHUNK, IDS, COUNTS, NTOK, TOKENS]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n])
    # Written once: the chunks are fixed from here on, and each text is tokenised once.
    table = cut_lineage(rows.mapInArrow(pack, f"{kinds}, {CHUNK} long, {IDS} binary, {COUNTS} binary, {NTOK} long, {TOKENS} array<string>"), "packed-texts")
    pairs = table.filter(F.col(TOKENS).isNotNull()).select(CHUNK, F.posexplode(TOKENS).alias(ID, "token"))
    known = weigh(pairs).select(CHUNK, ID, "k").toDF("__tt_of", ID, "k")
    docs = table.filter(F.col(TOKENS).isNull()).drop(TOKENS)
    return docs.groupBy(CHUNK).cogroup(known.groupBy("__tt_of")).applyInArrow(add, f"{kinds}, __tt_sums array<bigint>, {NTOK} long")
