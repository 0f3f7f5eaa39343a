"""Sinks (K1-K7): the full result, the per-class results, the topic report,
the prediction log.

Per-class outputs come from one ``partitionBy('adj_sentiment')`` write (one
pass over the data, not three filtered writes).  The class moves into the
directory name, so a copy of the column is kept in the files.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ZH_HEADERS

BOM = "﻿"
CLASS_DIR_COL = "adj_class"


def output_base(input_path: str) -> str:
    """K4: the input's file name without extension."""
    return os.path.splitext(os.path.basename(input_path.rstrip("/")))[0]


def _headers(df: DataFrame, headers: str) -> DataFrame:
    if headers == "en":
        return df
    if headers == "zh":
        return df.withColumnsRenamed({k: v for k, v in ZH_HEADERS.items() if k in df.columns})
    raise ValueError("headers must be 'en' or 'zh'")


def _with_bom(df: DataFrame) -> DataFrame:
    """K3: a UTF-8 BOM in front of the first header name (what spreadsheet
    programs expect); every part file carries the header, so every part
    starts with the BOM."""
    first = df.columns[0]
    return df.withColumnRenamed(first, BOM + first)


def _writer(df: DataFrame, fmt: str, mode: str, partition_by: list[str] | None = None):
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        # White space around a comment is part of it.
        w = (w.option("header", True).option("escape", '"').option("encoding", "UTF-8")
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    return w.format(fmt)


def write_all(result: DataFrame, path: str, *, fmt: str = "parquet", bom: bool = False,
              headers: str = "en", mode: str = "errorifexists") -> str:
    """K1: every row in one output."""
    out = _headers(result, headers)
    if bom and fmt == "csv":
        out = _with_bom(out)
    _writer(out, fmt, mode).save(path)
    return path


def write_by_class(result: DataFrame, path: str, *, fmt: str = "parquet", bom: bool = False,
                   headers: str = "en", mode: str = "errorifexists") -> str:
    """K2: ``<path>/adj_class=<class>/`` -- one ``partitionBy`` write for all
    classes (the class column is kept in the files too)."""
    by_class = _headers(result.withColumn(CLASS_DIR_COL, F.col("adj_sentiment")), headers)
    if bom and fmt == "csv":
        by_class = _with_bom(by_class)
    _writer(by_class, fmt, mode, [CLASS_DIR_COL]).save(path)
    return path


def write_result(result: DataFrame, out_dir: str, base: str = "comments", *, fmt: str = "parquet",
                 split: bool = True, bom: bool = False, headers: str = "en",
                 mode: str = "errorifexists") -> dict[str, str]:
    """K1 + K2: ``<out_dir>/<base>_all`` (every row) and, with ``split``,
    ``<out_dir>/<base>_by_class/adj_class=<class>/``.

    ``result`` is computed once per output; pass a materialised result (e.g.
    read back from files) when writing both, as the topic job does."""
    opts = {"fmt": fmt, "bom": bom, "headers": headers, "mode": mode}
    paths = {"all": write_all(result, os.path.join(out_dir, f"{base}_all"), **opts)}
    if split:
        paths["by_class"] = write_by_class(result, os.path.join(out_dir, f"{base}_by_class"), **opts)
    return paths


def write_report(report: DataFrame, path: str, *, fmt: str = "json", mode: str = "errorifexists") -> str:
    """K5: the topic report (one row per topic)."""
    _writer(report, fmt, mode).save(path)
    return path


def append_predictions(predictions: DataFrame, path: str, *, source: str | None = None) -> str:
    """K6: append predictions to a log table with the time they were written."""
    cols = {"scored_at": F.current_timestamp()}
    if source is not None:
        cols["source_name"] = F.lit(source)
    predictions.withColumns(cols).write.mode("append").parquet(path)
    return path
