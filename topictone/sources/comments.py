"""Comment sources (S1-S3, S7): CSV files, labelled CSV files, parquet tables.

CSV is read with an explicit all-string schema (no type inference: a comment
``666`` stays text), with quoted multi-line fields, and with pandas' default
missing-value tokens mapped to NULL.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import PANDAS_NA
from .csv_records import csv_records

DEFAULT_TEXT_COL = "评论"


def require_column(df: DataFrame, name: str) -> None:
    """Fail with the list of available columns (no Spark job)."""
    if name not in df.columns:
        raise ValueError(f"column {name!r} not found; available columns: {df.columns}")


def _csv_header(spark: SparkSession, path: str, sep: str, encoding: str) -> list[str]:
    # The header row alone (first line of the first file), to build a string schema.
    rows = (spark.read.option("header", False).option("sep", sep)
            .option("encoding", encoding).option("multiLine", False).csv(path))
    # Columns of the files are _c0, _c1, ...; a partition folder's column has a name.
    first = rows.select([c for c in rows.columns if c.startswith("_c")]).limit(1).collect()
    if not first:
        return []
    return [c if c is not None else f"_c{i}" for i, c in enumerate(first[0])]


def read_comments(spark: SparkSession, path: str, text_col: str = DEFAULT_TEXT_COL, *,
                  na_values: tuple[str, ...] | None = PANDAS_NA, multi_line: bool = True,
                  sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """S1 + S2: a comment CSV (header row) as a DataFrame of strings.  Every file of
    a folder must have the header of the first (Spark compares them as it reads;
    another order or name raises).

    ``multi_line=True`` reads quoted newlines as pandas does: UTF-8 files are read in
    splits of any size (``sources/csv_records.py``), files of another encoding by
    one task each.  ``False`` is for one-line CSV.
    """
    if multi_line and encoding.upper().replace("-", "") == "UTF8" and len(sep) == 1:
        df = _parallel_comments(spark, path, sep)
        require_column(df, text_col)
        return _na_to_null(df, na_values)
    names = _csv_header(spark, path, sep, encoding)
    schema = T.StructType([T.StructField(n, T.StringType(), True) for n in names])
    df = (spark.read.schema(schema)
          .option("header", True).option("sep", sep).option("encoding", encoding)
          .option("multiLine", multi_line).option("escape", '"').option("quote", '"')
          .option("mode", "PERMISSIVE").option("enforceSchema", False)
          .csv(path))
    if names and names[0].startswith("\ufeff"):
        df = df.withColumnRenamed(names[0], names[0][1:])
    require_column(df, text_col)
    return _na_to_null(df, na_values)


def _parallel_comments(spark: SparkSession, path: str, sep: str) -> DataFrame:
    records, headers = csv_records(spark, path, sep)
    options = {"sep": sep, "escape": '"', "quote": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    first = [r["record"].removesuffix("\r") for r in headers.select("record").distinct().limit(100).collect()]
    if not first:
        return spark.createDataFrame([], T.StructType([]))
    names = [next(csv.reader(io.StringIO(x, newline=""), delimiter=sep, strict=False)) for x in first]
    if any(n != names[0] for n in names):
        raise ValueError(f"the files have different headers: {names}")
    # A name of its own for an empty one, as Spark's reader gives it.
    ddl = ", ".join("`{}` string".format((n or f"_c{i}").replace("`", "``")) for i, n in enumerate(names[0]))
    row = F.from_csv("record", ddl, options)
    folders = [c for c in records.columns if c != "record"]
    return records.select(row.alias("__tt_row"), *[F.col(f"`{c}`") for c in folders]).select("__tt_row.*", *[F.col(f"`{c}`") for c in folders])


def _na_to_null(df: DataFrame, na_values: tuple[str, ...] | None) -> DataFrame:
    if na_values:
        na = [v for v in na_values if v != ""]
        df = df.withColumns({
            c: F.when(F.col(f"`{c}`").isin(na) | (F.col(f"`{c}`") == ""), F.lit(None))
                .otherwise(F.col(f"`{c}`"))
            for c in df.columns})
    return df


def read_labelled_csv(spark: SparkSession, path: str, text_col: str = "review",
                      label_col: str = "label", *, multi_line: bool = True) -> DataFrame:
    """S3 + P5: a labelled CSV, renamed to ``text, label``."""
    df = read_comments(spark, path, text_col, na_values=None, multi_line=multi_line)
    require_column(df, label_col)
    return df.select(F.col(f"`{text_col}`").alias("text"),
                     F.col(f"`{label_col}`").cast("int").alias("label"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
