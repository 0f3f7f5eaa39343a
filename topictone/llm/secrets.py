"""Secret scans: known formats, and guess costs of values in credential contexts.

Base spans are three patterns (``assign``, ``access``, ``hex``).  The method adds
``guess`` spans: a value that follows a credential word ("password is ...",
"auth: ...") is a secret when guessing it is expensive.  Its cost is the minimum
over all segmentations, found by dynamic programming over prefixes, of the summed
log10 guesses of the segments:

* a word: ``log10(N / count)`` from the words of all documents;
* a date: the days of 200 years, with or without separators;
* a repeat of one character: its class size times its length;
* a keyboard walk: 47 keys times 8 directions times its length;
* brute force: the class size of each character.

Spark does the corpus work.  One pass over the texts finds spans and candidate
values and pre-counts the words of each task; counts are summed by word, joined
to the distinct letter segments of the distinct values (a value's digest stands for
it there), and the verdict of each value goes back to its places.  A value that stands in very many documents is
salted there, so its places are joined in many tasks.

Null texts count as empty (no spans); values of any length are segmented whole
(segments are limited by the longest word looked up, not the value); repeated
rows give equal rows; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of, write_shared

#: The order in which kinds that start at one place are listed.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: An identifier with a credential word in it (DB_PASSWORD, authToken), a joint, and
#: the value after it.  "pass" and "auth" don't begin a longer word there (author).
#: An identifier is read from its start and never given back: linear time.
_CREDENTIAL = (r"(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credential|login|(?:api|access|private)[_-]?key"
               r"|(?:pass|auth)(?-i:(?![a-z])(?!(?<=[A-Z])[A-Z])))")
CONTEXT = re.compile(
    rf"""(?<![A-Za-z0-9_-])(?:(?=[A-Za-z0-9_-]*?{_CREDENTIAL})[A-Za-z0-9_-]++"""
    r"""|[A-Za-z0-9_-]*+(?:(?<=api)|(?<=access)|(?<=private))\x20key[A-Za-z0-9_-]*+)["']?\s{0,4}"""
    r"""(?:[:=]>?|is\b)\s{0,4}["'`]?([^\s"'`,;<>(){}\[\]]{6,})""", re.IGNORECASE | re.ASCII)
LETTERS = re.compile(r"[^\W\d_]+")
_Y, _M, _D = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
#: Dates, each with the log10 of how many there are in 200 years.
DATES = tuple((re.compile(p, re.ASCII), math.log10(n)) for p, n in (
    (rf"{_Y}([-/.]?){_M}\1{_D}", 73_000), (rf"{_D}([-/.]?){_M}\1{_Y}", 73_000), (_Y, 200)))
#: Rows of a common keyboard, for walks (fixed values).
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
#: Word lengths looked up; values cost at least THRESHOLD log10 guesses.
WORD_MIN, WORD_MAX, THRESHOLD = 3, 24, 10.0
#: Distinct words that one task counts before it hands its counts on; segments in
#: one batch of rows.
FLUSH_WORDS, SALTS, SEGMENTS = 300_000, 32, 50_000


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end), leftmost non-overlapping per kind."""
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2])))


def _neighbours() -> set[tuple[str, str]]:
    place = {c: (x, y) for y, row in enumerate(KEY_ROWS) for x, c in enumerate(row)}
    return {(a, b) for a, (x, y) in place.items() for b, (u, v) in place.items()
            if a != b and abs(y - v) <= 1 and abs(x - u) <= 1}


NEAR = _neighbours()


def class_size(char: str) -> int:
    """How many characters a guesser tries for one of this class."""
    if char.isdigit():
        return 10
    if char.isalpha():
        return 26 if char.isascii() else 100
    return 33


def segments_of(value: str) -> Iterator[set[str]]:
    """Lower-cased parts of the letter runs of a value that may be words, in sets of
    bounded size (a part may be in more than one)."""
    held: set[str] = set()
    for run in (m.group().lower() for m in LETTERS.finditer(value)):
        for a in range(len(run)):
            held.update(run[a:b] for b in range(a + WORD_MIN, min(len(run), a + WORD_MAX) + 1))
            if len(held) >= SEGMENTS:
                yield held
                held = set()
    if held:
        yield held


class _Run:
    """Segments of one run (equal or neighbouring keys) that end at i: the
    least of best[j] + log10(guesses * (i - j)) over its starts j.  Starts that
    can never win again are dropped, so few are held: an earlier start with no
    lower best[j], and a later start that an earlier one beats now (the later
    one's term only grows faster)."""

    def __init__(self, at: int):
        self.starts = [at]

    def cost(self, i: int, best: list[float], guesses: int) -> float:
        if self.starts[-1] != i - 1:
            while self.starts and best[self.starts[-1]] >= best[i - 1]:
                self.starts.pop()
            self.starts.append(i - 1)
        kept, least = [], math.inf
        for j in self.starts:
            term = best[j] + math.log10(guesses * (i - j))
            if term < least:
                kept.append(j)
                least = term
        self.starts = kept
        return least


def guess_cost(value: str, words: dict[str, float]) -> float:
    """Minimum log10 guesses over all segmentations; ``words``: lower-cased
    word to log10 guesses.  ``best[i]`` is the least cost of the first i
    characters."""
    n, low = len(value), value.lower()
    if len(low) != n:  # a few letters change length; then case is kept
        low = value
    best = [0.0] + [math.inf] * n
    ends: dict[int, list[tuple[int, float]]] = {}
    for at in range(n):
        if value[at].isdigit():
            for pattern, guesses in DATES:
                if m := pattern.match(value, at):
                    ends.setdefault(m.end(), []).append((at, guesses))
    same = walk = None
    for i in range(1, n + 1):
        c, size = low[i - 1], class_size(low[i - 1])
        if i == 1 or low[i - 2] != c:
            same = _Run(i - 1)
        if i == 1 or (low[i - 2], c) not in NEAR:
            walk = _Run(i - 1)
        cost = min(best[i - 1] + math.log10(size), same.cost(i, best, size), walk.cost(i, best, 47 * 8))
        for at, guesses in ends.get(i, ()):
            cost = min(cost, best[at] + guesses)
        for at in range(max(0, i - WORD_MAX), i - WORD_MIN + 1):
            guesses = words.get(low[at:i])
            if guesses is not None:
                cost = min(cost, best[at] + guesses + (value[at:i] != low[at:i]) * math.log10(2))
        best[i] = cost
    return best[n]


def _scan(docs: DataFrame) -> DataFrame:
    """One pass: rows of kind 0 (a document: base spans and candidates) and of
    kind 1 (a word and its count in a part of a task)."""
    id_type = docs.schema[0].dataType.simpleString()
    names = ["part", "id", "row", "base", "counts", "candidates", "word", "n"]
    candidate = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))

    def words(counts: Counter, id_type: pa.DataType) -> pa.RecordBatch:
        n = len(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array([1] * n, pa.int32()), pa.nulls(n, id_type), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()),
             pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, candidate), pa.array(list(counts), pa.string()),
             pa.array(list(counts.values()), pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, at, task, kind = Counter(), 0, TaskContext.get().partitionId(), None
        for batch in batches:
            kind = batch.schema.field(0).type
            base, per_kind, found, rows = [], [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                spans = base_spans(text)
                base.append(joined(spans))
                per_kind.append([sum(k == x for _, k, _ in spans) for x in KINDS[:3]])
                found.append([{"start": m.start(1), "end": m.end(1), "value": m.group(1)} for m in CONTEXT.finditer(text)])
                counts.update(w for w in LETTERS.findall(text.lower()) if WORD_MIN <= len(w) <= WORD_MAX)
                rows.append(f"{task}:{at}")
                at += 1
                if len(counts) > FLUSH_WORDS:
                    yield words(counts, kind)
                    counts.clear()
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * n, pa.int32()), batch.column(0), pa.array(rows, pa.string()), pa.array(base, pa.string()),
                 pa.array(per_kind, pa.list_(pa.int64())), pa.array(found, candidate), pa.nulls(n, pa.string()),
                 pa.nulls(n, pa.int64())], names)
        if counts:
            yield words(counts, kind)

    return docs.mapInArrow(run, f"part int, id {id_type}, row string, base string, counts array<bigint>, "
                           "candidates array<struct<start:int,end:int,value:string>>, word string, n bigint")


def _costs(rows: DataFrame) -> DataFrame:
    """digest, value, words (struct array of word and cost) to digest, cost."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cost = [guess_cost(v.as_py(), {w["word"]: w["cost"] for w in ws.as_py() or ()})
                    for v, ws in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cost, pa.float64())], ["digest", "cost"])

    return rows.mapInArrow(run, "digest binary, cost double")


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                 threshold: float = THRESHOLD) -> DataFrame:
    """Per document: id, n_assign, n_access, n_hex, n_guess, base_sha256, spans
    (``kind:start:end``, code points, end exclusive, by start and then kind)."""
    # Written once: the row names are fixed from here on, and no text is kept.
    scan = write_shared(_scan(texts_of(docs, id_col, text_col)), "secret-scan")
    rows = scan.filter("part = 0").select("id", "row", "base", "counts", "candidates")
    places = (rows.filter(F.size("candidates") > 0)
              .select("row", F.explode("candidates").alias("c"))
              .select("row", "c.start", "c.end", "c.value", F.unhex(F.sha2("c.value", 256)).alias("digest")))
    values = places.select("digest", "value").dropDuplicates(["digest"])
    segments = values.mapInArrow(_segment_rows, "digest binary, word string")
    counts = scan.filter("part = 1").groupBy("word").agg(F.sum("n").alias("n"))
    total = scan.filter("part = 1").agg(F.sum("n").alias("total")).first()["total"] or 1
    known = (segments.join(counts, "word")
             .groupBy("digest").agg(F.collect_list(F.struct("word", F.log10(F.lit(float(total)) / F.col("n")).alias("cost"))).alias("words")))
    secrets = _costs(values.join(known, "digest", "left").select("digest", "value", "words")).filter(F.col("cost") >= F.lit(float(threshold)))
    # The places of one value are dealt over SALTS tasks.
    spread = places.drop("value").withColumn("salt", F.pmod(F.xxhash64("row", "start"), F.lit(SALTS)).cast("int"))
    dealt = secrets.select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    added = (spread.join(dealt, ["digest", "salt"], "left_semi")
             .groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("guess")))
    out = rows.select("id", "row", "base", "counts").join(added, "row", "left").select("id", "base", "counts", "guess")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, guess = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            spans = []
            for b, g in zip(base, guess):
                own = [(int(a), k, int(e)) for k, a, e in (s.split(":") for s in b.split(",") if s)]
                spans.append(joined(own + [(x["start"], "guess", x["end"]) for x in g or ()]))
            n = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([c[i] for c in n], pa.int64()) for i in range(3)),
                 pa.array([len(g or ()) for g in guess], pa.int64()),
                 pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()), pa.array(spans, pa.string())],
                [id_col, "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    id_type = rows.schema["id"].dataType.simpleString()
    return out.mapInArrow(finish, f"`{id_col}` {id_type}, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held: list[tuple[bytes, str]] = []
        for digest, value in zip(batch.column(0).to_pylist(), batch.column(1)):
            for part in segments_of(value.as_py()):
                held += [(digest, w) for w in part]
                if len(held) >= SEGMENTS:
                    yield _pairs(held)
                    held = []
        if held:
            yield _pairs(held)


def _pairs(held: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d for d, _ in held], pa.binary()), pa.array([w for _, w in held], pa.string())],
                                      ["digest", "word"])
