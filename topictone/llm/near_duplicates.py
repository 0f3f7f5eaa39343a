"""Near-duplicate documents: fast similarity sketches, banding, exact links.

1. One narrow pass gives each document its shingle set's size, digest and sketch
   (``sketch.py``).  Documents with equal sets are one class; from here on only
   classes count, so copies never meet each other.
2. The classes' sketches are banded: BANDS keys of ROWS coordinates.  A pair at
   0.8 shares no key with probability (1 - 0.8 ** ROWS) ** BANDS, 3e-6.  Keys of a
   single class are dropped before anything else is moved.
3. Within a key, classes whose sketches agree in at least ``threshold - MARGIN``
   of the coordinates (5.7 standard deviations below 0.8) are joined into
   *families* by a search that compares each reached class with those not yet
   reached; it returns a spanning forest, never all pairs.
4. The classes of a family meet with their whole texts.  The same search, now
   with exact intersections and unions of the full sets, gives the links that
   connect each component, and components of those links are the result.

Groups of any size are whole: a key or a family of more than GROUP members (or
GROUP_SHINGLES) is cut in parts, and each pair of parts is a task of its own.  All
pairs are covered, in bounded memory, and the emitted forests grow with members
times parts.

Null and empty texts have no shingles, are linked with nothing and are their own
component.  A text of fewer words than a shingle is one shingle.  Repeated ids
are rows like others (component_id is the least id of the component; rows with a
null id have the least id that is not null, or null).  An empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names, groups_of, released, write_shared
from .components import components
from .sketch import band_keys, forget_words, shingles, sketches

BANDS, ROWS, MARGIN = 32, 5, 0.18
COORDS = BANDS * ROWS
#: Members and shingles of a key or family that one task holds twice at most.
GROUP, GROUP_SHINGLES, BATCH_BYTES = 2000, 2_000_000, 2 << 20
#: A class with more than 1/HOT of all documents is hot.
HOT = 1000


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges (first reached, other) that connect 0..n-1 as ``near`` does:
    near(i, others) marks the others that are linked to i."""
    edges, left = [], np.arange(n)
    while len(left):
        root, left, queue = int(left[0]), left[1:], [int(left[0])]
        while queue and len(left):
            linked = near(queue.pop(), left)
            found = left[linked].tolist()
            edges += [(root, x) for x in found]
            queue += found
            left = left[~linked]
    return edges


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("h"))


def _sketched(docs: DataFrame, k: int) -> DataFrame:
    """id, h (text digest), n (set size), c (class: digest of the set, null if
    empty), s (sketch as 16-bit coordinates)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, "text", BATCH_BYTES):
            sets = [shingles(t.as_py(), k) for t in table.column(1)]
            rows = sketches(sets, COORDS).astype(np.uint16)
            yield from pa.table([
                table.column(0), table.column(2), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([r.tobytes() if len(s) else None for r, s in zip(rows, sets)], pa.binary())],
                ["id", "h", "n", "c", "s"]).to_batches()
        forget_words()

    return docs.mapInArrow(released(run), f"id {docs.schema['id'].dataType.simpleString()}, h binary, n long, c binary, s binary")


def _banded(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                s = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, COORDS)
                keys = band_keys(s.astype(np.uint32), ROWS)
                c = part.column(0).take(pa.array(np.repeat(np.arange(len(s)), BANDS)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel(), pa.int64()), c], ["b", "c"])

    return classes.select("c", "s").mapInArrow(released(run), "b long, c binary")


def _in_parts(rows: DataFrame, key: str, parts) -> DataFrame:
    """Each row once for every pair of parts that its part is in."""
    part = F.pmod(F.xxhash64("c"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1))
    dealt = rows.withColumn("parts", parts).withColumn("part", part).withColumn("other", other)
    return (dealt.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
            .drop("part", "other", "parts"))


def _searched(rows: DataFrame, key: str, links: Callable[[list[dict]], list[tuple[int, int]]], columns: list[str]) -> DataFrame:
    """``links`` of each (key, i, j) as edges (u, v) of classes.  Groups are runs
    of sorted rows; one is held at a time."""
    own = rows.select(key, "i", "j", "c", *columns)
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = own.repartition(width, key, "i", "j").sortWithinPartitions(key, "i", "j", "c")

    def edges(held: list[dict]) -> list[tuple[bytes, bytes]]:
        members = [m for n, m in enumerate(held) if not n or held[n - 1]["c"] != m["c"]]
        return [(members[a]["c"], members[b]["c"]) for a, b in links(members)] if len(members) > 1 else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, out = [], None, []
        for batch in batches:
            for some in range(0, batch.num_rows, 200):  # few rows at once as Python objects
                for row in batch.slice(some, 200).to_pylist():
                    mark = (row[key], row["i"], row["j"])
                    if mark != at:
                        out += edges(held)
                        held, at = [], mark
                    held.append(row)
            if len(out) > 5000:
                yield _edge_batch(out)
                out = []
        out += edges(held)
        forget_words()
        if out:
            yield _edge_batch(out)

    return own.mapInArrow(released(run), "u binary, v binary")


def _edge_batch(edges) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.binary()) for i in (0, 1)], ["u", "v"])


def _sketch_matrix(members: list[dict]) -> np.ndarray:
    return np.frombuffer(b"".join(m["s"] for m in members), np.uint16).reshape(-1, COORDS)


def _alike(threshold: float):
    """Links of sketches that agree in at least ``threshold`` of coordinates."""
    def links(members: list[dict]) -> list[tuple[int, int]]:
        s = _sketch_matrix(members)
        return forest(len(s), lambda i, others: (s[others] == s[i]).sum(1) >= threshold * COORDS)
    return links


def _linked(k: int, percent: int, sketch_threshold: float):
    """Links of full sets: 100 * intersection >= percent * union."""
    def links(members: list[dict]) -> list[tuple[int, int]]:
        s, sets = _sketch_matrix(members), [shingles(m["text"], k) for m in members]
        sizes = np.array([len(x) for x in sets])

        def near(i: int, others: np.ndarray) -> np.ndarray:
            small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
            maybe = (100 * small >= percent * large) & ((s[others] == s[i]).sum(1) >= sketch_threshold * COORDS)
            some = others[maybe]
            if len(some):
                flat, owner = np.concatenate([sets[o] for o in some]), np.repeat(np.arange(len(some)), sizes[some])
                place = np.minimum(np.searchsorted(sets[i], flat), sizes[i] - 1)
                common = np.bincount(owner[sets[i][place] == flat], minlength=len(some))
                maybe[maybe] = 100 * common >= percent * (sizes[some] + sizes[i] - common)
            return maybe

        return forest(len(members), near)
    return links


def _components(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """id, h, n and component_id of each document; ``docs`` from _keyed."""
    rough = percent / 100 - MARGIN
    rows = write_shared(_sketched(docs, k), "nd-rows")
    classes = write_shared(rows.filter("c IS NOT NULL").groupBy("c").agg(
        F.min(F.struct("id", "h")).alias("rep"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"),
        F.max("n").alias("n"), F.max("s").alias("s")), "nd-classes")
    bands = write_shared(_banded(classes), "nd-bands")
    shared_keys = bands.groupBy("b").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    parts = F.ceil(F.col("members") / F.lit(GROUP))
    members = _in_parts(bands.join(shared_keys, "b").join(classes.select("c", "s"), "c"), "b", parts)
    family = write_shared(components(_searched(members, "b", _alike(rough), ["s"])), "nd-families")
    # Whole texts, of one document of each class in a family of two or more.
    sizes = (family.join(classes.select("c", "n"), F.col("node") == F.col("c")).groupBy("root")
             .agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles")))
    need = (family.join(sizes, "root").join(classes.select("c", "s", "rep"), F.col("node") == F.col("c"))
            .select("root", "c", "s", F.col("rep.id").alias("rid"), F.col("rep.h").alias("rh"), "members", "shingles"))
    parts = F.ceil(F.greatest(F.col("members") / F.lit(GROUP), F.col("shingles") / F.lit(GROUP_SHINGLES)))
    texts = docs.join(need, (F.col("h") == F.col("rh")) & F.col("id").eqNullSafe(F.col("rid"))).drop("id", "h", "rid", "rh")
    links = _searched(_in_parts(texts, "root", parts).drop("members", "shingles"), "root", _linked(k, percent, rough), ["s", "text"])
    linked = components(links)
    # The least id of each component, and of each class with copies.
    least = linked.join(classes.select("c", "least"), F.col("node") == F.col("c")).groupBy("root").agg(F.min("least").alias("low"))
    of_linked = linked.join(least, "root").select(F.col("node").alias("c"), "low")
    low = (classes.join(of_linked, "c", "left").filter(F.col("low").isNotNull() | (F.col("copies") > 1))
           .select("c", F.coalesce("low", "least").alias("low")))
    return _on_rows(rows.select("id", "h", "n", "c"), low, classes)


def _on_rows(rows: DataFrame, low: DataFrame, classes: DataFrame) -> DataFrame:
    """component_id of each document.  Classes with more than 1/HOT of all
    documents (HOT at most, so they are broadcast) and documents without
    shingles don't meet in the shuffle join of the others."""
    total = rows.count()
    hot = (low.join(classes.select("c", "copies"), "c").filter(F.col("copies") * HOT > total)
           .select("c", F.col("low").alias("hot")))
    marked = rows.join(F.broadcast(hot), "c", "left")
    apart = F.col("c").isNull() | F.col("hot").isNotNull()
    done = marked.filter(apart).select("id", "h", "n", F.coalesce("hot", "id").alias("component_id"))
    rest = marked.filter(~apart).drop("hot").join(low, "c", "left")
    return done.unionByName(rest.select("id", "h", "n", F.coalesce("low", "id").alias("component_id")))


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_shingles, component_id, kept (the id is the
    component's)."""
    out = _components(_keyed(docs, id_col, text_col), k, percent)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one_of_each(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all columns: the document with the least id of each
    component.  Rows equal in id and text are one."""
    found = _components(_keyed(docs, id_col, text_col), k, percent)
    own, other, h = free_names(docs, "digest", "gone_id", "gone_digest")
    gone = found.filter(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias(other), F.col("h").alias(h))
    digest = F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")))
    named = docs.withColumn(own, digest)
    left = named.join(gone, (F.col(own) == F.col(h)) & F.col(f"`{id_col}`").eqNullSafe(F.col(other)), "left_anti")
    return left.dropDuplicates([id_col, own]).drop(own)
