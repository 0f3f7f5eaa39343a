"""Multi-line CSV read in parallel: the records of files that are cut into byte ranges.

A file is read as lines in Spark's own splits.  Whether a split begins inside a quoted
field can't be seen from the split alone, so

1. every split gives its transition: the state (inside a quoted field or not) in which
   it ends if it begins outside, and if it begins inside (lines without a quote
   change nothing and aren't sent to Python);
2. the transitions of each file are applied in the order of the splits (one small row
   per split), which gives every split's true beginning;
3. with it, every split puts its own records together.  A record that crosses splits
   leaves a fragment in each of them; those, at most two a split, are put together
   by file, and the files' headers are compared.

Rules (as Spark's CSV reader with ``escape='"'``): a quote opens a field only at its
beginning, a doubled quote inside is one quote, what follows a closing quote up to
the separator belongs to the field, line ends inside quotes stay as they are, and empty
lines outside are no records.  Records end with LF or CRLF; a byte order mark is no part
of the first one.  An unclosed quote runs to
the end of its file.  Files are UTF-8; compressed ones are one split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_JOIN, JoinConfig
from ..operators.joins import fits_broadcast, measure
from ..session import cut_lineage

FILE, SPLIT, OPEN, LINE = "__tt_file", "__tt_split", "__tt_open", "__tt_line"
#: What a row of ``_assembled`` is: a record, the end of one that began in an earlier
#: split, a whole split inside one, the begin of one that goes on in the next.
RECORD, END, MIDDLE, BEGIN = range(4)
#: Records (and their bytes) in one Arrow batch.
ROWS, BYTES = 10_000, 8 << 20


class LineState:
    """Whether a line ends inside a quoted field, given how it begins."""

    def __init__(self, sep: str):
        s = re.escape(sep.encode())
        rest = rb'(?:"(?:[^"]|"")*+"[^%(s)s]*+|(?!")[^%(s)s]*+)' % {b"s": s}
        self.outside = re.compile(rest + rb"(?:" + s + rest + rb")*+\Z", re.DOTALL)
        self.inside = re.compile(rb'(?:[^"]|"")*+"[^' + s + rb"]*+(?:" + s + rest + rb")*+\Z", re.DOTALL)

    def ends_open(self, line: bytes, begins_open: bool) -> bool:
        if b'"' not in line:
            return begins_open
        return not (self.inside if begins_open else self.outside).match(line)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (binary, a CR at the end kept) with their file and split, and the columns of
    partition folders.  Lines of a split come in order."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("value").cast("binary").alias(LINE), F.col("_metadata.file_path").alias(FILE),
                       F.col("_metadata.file_block_start").alias(SPLIT), *[F.col(f"`{c}`") for c in text.columns if c != "value"])


def _without_bom(line: bytes | None, split: int) -> bytes | None:
    """The first line of a split; the first of a file may begin with a mark."""
    return line.removeprefix(b"\xef\xbb\xbf") if line and split == 0 else line


def _transitions(lines: DataFrame, sep: str) -> DataFrame:
    """file, split, and the state at the split's end from outside and from inside."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at, ends = LineState(sep), None, (False, True)
        for batch in batches:
            done = []
            for line, file, split in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (file, split) != at:
                    if at is not None:
                        done.append((*at, *ends))
                    at, ends = (file, split), (False, True)
                    line = _without_bom(line, split)
                if line is not None:
                    ends = tuple(state.ends_open(line, x) for x in ends)
            yield rows(done)
        if at is not None:
            yield rows([(*at, *ends)])

    def rows(done):
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.bool_()))],
                                          [FILE, SPLIT, "outside", "inside"])

    marked = lines.select(F.when(F.instr(F.col(LINE).cast("string"), '"') > 0, F.col(LINE)).alias(LINE), FILE, SPLIT)
    return marked.mapInArrow(run, f"{FILE} string, {SPLIT} long, outside boolean, inside boolean")


def _beginnings(transitions: DataFrame) -> DataFrame:
    """file, split, open: whether each split begins inside a quoted field."""
    def walk(frame):
        frame = frame.sort_values(SPLIT)
        begins, inside = [], False
        for a, b in zip(frame["outside"], frame["inside"]):
            begins.append(inside)
            inside = bool(b if inside else a)
        return frame.assign(**{OPEN: begins})[[FILE, SPLIT, OPEN]]

    return transitions.groupBy(FILE).applyInPandas(walk, f"{FILE} string, {SPLIT} long, {OPEN} boolean")


def _assembled(lines: DataFrame, sep: str, fragments: bool) -> DataFrame:
    """Records of each split (``fragments`` False), or the parts of records that cross
    splits and the files' headers (True)."""
    extra = [c for c in lines.columns if c not in (LINE, FILE, SPLIT, OPEN)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at, held, inside, kind, first = LineState(sep), None, [], False, RECORD, False
        last = None                                  # file, split and further columns of the split held
        out: list[tuple[int, bool, bytes]] = []

        def rows(of: pa.RecordBatch, place: list[int]):
            nonlocal out
            some = [(o, p) for o, p in zip(out, place)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o, _ in some], pa.int32()), pa.array([o[1] for o, _ in some], pa.bool_()),
                 pa.array([o[2] for o, _ in some], pa.binary()), *(of.column(i).take(pa.array([p for _, p in some], pa.int64())) for i in columns)], names)
            out = []

        def give(kind: int, record: bytes, begins_file: bool) -> bool:
            """Keep a record or fragment, if it is asked for."""
            wanted = (kind != RECORD or begins_file) if fragments else (kind == RECORD and not begins_file)
            if wanted and (kind != RECORD or record not in (b"", b"\r")):
                out.append((kind, begins_file, record))
                return True
            return False

        for batch in batches:
            columns, place, size = [i for i, n in enumerate(batch.schema.names) if n not in (LINE, OPEN)], [], 0
            for n, (line, file, split, opened) in enumerate(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (LINE, FILE, SPLIT, OPEN)))):
                if (file, split) != at:
                    if held and give(MIDDLE if kind == END else BEGIN, b"\n".join(held), first):
                        yield from rows_of_last(last, out, names, columns)
                        out = []
                    at, held, inside = (file, split), [], opened
                    kind, first = (END, False) if opened else (RECORD, split == 0)
                    line = _without_bom(line, split)
                held.append(line)
                inside = state.ends_open(line, inside)
                if not inside:
                    record = b"\n".join(held)
                    empty = record in (b"", b"\r")
                    if give(kind, record, first):
                        place.append(n)
                        size += len(record)
                    held, kind, first = [], RECORD, first and empty and kind == RECORD
                if len(out) >= ROWS or size >= BYTES:
                    yield from rows(batch, place)
                    place, size = [], 0
            if out:
                yield from rows(batch, place)
            if batch.num_rows:
                last = batch.slice(batch.num_rows - 1)
        if held and give(MIDDLE if kind == END else BEGIN, b"\n".join(held), first):
            yield from rows_of_last(last, out, names, [i for i, n in enumerate(last.schema.names) if n not in (LINE, OPEN)])

    names = ["kind", "first", "record", FILE, SPLIT, *extra]
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("first", T.BooleanType()), T.StructField("record", T.BinaryType()),
                           *[lines.schema[c] for c in (FILE, SPLIT, *extra)]])
    return lines.select(LINE, OPEN, FILE, SPLIT, *[F.col(f"`{c}`") for c in extra]).mapInArrow(run, schema)


def rows_of_last(last: pa.RecordBatch, out: list, names: list[str], columns: list[int]) -> Iterator[pa.RecordBatch]:
    """The fragment that a split left, with the columns of its last line."""
    yield pa.RecordBatch.from_arrays([pa.array([out[-1][0]], pa.int32()), pa.array([out[-1][1]], pa.bool_()), pa.array([out[-1][2]], pa.binary()),
                                      *(last.column(i) for i in columns)], names)


def _stitched(fragments: DataFrame, extra: list[str]) -> DataFrame:
    """Whole records from the fragments of each file, in the order of the splits."""
    order = Window.partitionBy(FILE).orderBy(SPLIT, "kind")      # a split's END before its BEGIN
    number = F.sum((F.col("kind") == BEGIN).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    parts = fragments.filter(F.col("kind") != RECORD).withColumn("number", number)
    joined = parts.groupBy(FILE, "number").agg(
        F.sort_array(F.collect_list(F.struct(SPLIT, "kind", F.col("record").cast("string").alias("record")))).alias("parts"),
        F.max("first").alias("first"), *[F.first(f"`{c}`").alias(c) for c in extra])
    return joined.select(F.col(FILE), "first", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"), *[F.col(f"`{c}`") for c in extra])


def csv_records(spark: SparkSession, path: str, sep: str = ",", join_cfg: JoinConfig = DEFAULT_JOIN) -> tuple[DataFrame, DataFrame]:
    """(records, headers): ``record`` (the text of one CSV record without its line end)
    and the columns of partition folders, and the first record of every file."""
    lines = _lines(spark, path)
    extra = lines.columns[3:]
    begins = cut_lineage(_beginnings(_transitions(lines, sep)), "csv-splits")
    if not fits_broadcast(measure(begins), join_cfg):
        raise ValueError("too many splits to send out: raise spark.sql.files.maxPartitionBytes")
    # Both reads must be cut alike; otherwise a split is unknown and the job fails.
    known = F.coalesce(F.col(OPEN), F.raise_error(F.lit("the files were cut in other splits: set spark.sql.files.minPartitionNum")).cast("boolean"))
    placed = lines.join(F.broadcast(begins), [FILE, SPLIT], "left").withColumn(OPEN, known)
    crossing = cut_lineage(_assembled(placed, sep, True), "csv-fragments")
    crossed = _stitched(crossing, extra)
    headers = crossing.filter(F.col("kind") == RECORD).select(FILE, F.col("record").cast("string").alias("record")).unionByName(
        crossed.filter("first").select(FILE, "record"))
    whole = _assembled(placed, sep, False).select(F.col("record").cast("string").alias("record"), *[F.col(f"`{c}`") for c in extra])
    both = whole.unionByName(crossed.filter("NOT first").drop(FILE, "first"))
    return both.withColumn("record", F.regexp_replace("record", "\r$", "")), headers
