"""Registered queries for the file sources and sinks.

The given tables are written to the shared folder in the file formats the
sources read (CSV with a header, plain text lines), then read back through
the sources; the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_TOPIC
from ..functions.text import is_valid_text
from ..operators.report import topic_report
from ..session import shared_path, write_shared
from ..sources.comments import DEFAULT_TEXT_COL, read_comments
from ..sources.lines import read_lines
from .queries import nb_all_labels, table
from .topic_job import run_topic_job


def write_comments_csv(df: DataFrame, path: str, *, bom: bool = False) -> str:
    """A comment table as CSV with a header (quoted fields keep newlines,
    quotes doubled, whitespace kept as is)."""
    out = df
    if bom:
        out = out.withColumnRenamed(out.columns[0], "﻿" + out.columns[0])
    (out.write.mode("errorifexists").option("header", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path))
    return path


def _documents_csv(spark, sf_dir, bom: bool = True) -> str:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", F.col("text").alias(DEFAULT_TEXT_COL))
    return write_comments_csv(docs, shared_path(spark, "documents-csv"), bom=bom)


def q_csv_comments(spark, sf_dir):
    """S1 + S2 + P1: documents as a comment CSV, read back; valid comments."""
    path = _documents_csv(spark, sf_dir)
    df = read_comments(spark, path, DEFAULT_TEXT_COL)
    return df.filter(is_valid_text(DEFAULT_TEXT_COL)).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source", DEFAULT_TEXT_COL)


def q_csv_comments_split(spark, sf_dir):
    """The documents' CSV read in splits of 256 KB, so that records cross splits;
    the number of characters and line ends of each comment is kept too."""
    path = _documents_csv(spark, sf_dir)
    confs = {"spark.sql.files.maxPartitionBytes": "256k", "spark.sql.files.openCostInBytes": "1"}
    held = {c: spark.conf.get(c) for c in confs}
    try:
        for c, v in confs.items():
            spark.conf.set(c, v)
        df = read_comments(spark, path, DEFAULT_TEXT_COL, na_values=None)
        text = F.coalesce(F.col(DEFAULT_TEXT_COL), F.lit(""))   # CSV has no NULL
        return write_shared(df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang", F.md5(text.cast("binary")).alias("text_md5"),
                                      F.length(text).cast("bigint").alias("n_chars"),
                                      (F.length(text) - F.length(F.replace(text, F.lit("\n")))).cast("bigint").alias("n_lines")), "csv-split")
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)


def q_csv_topic_job(spark, sf_dir):
    """The whole job from a CSV file: read, score (model trained on the
    labels), analyse by source, write all / per-class CSV with BOM and the
    report; returns the report as written."""
    path = _documents_csv(spark, sf_dir)
    out = shared_path(spark, "topic-job")
    model = nb_all_labels(spark, sf_dir, normalise="mean")
    paths = run_topic_job(spark, path, model, out, text_col=DEFAULT_TEXT_COL,
                          topic_cols=["source"], key_col="doc_id", fmt="csv", bom=True)
    written = spark.read.parquet(paths["parquet_all"])
    schema = topic_report(written, ["source"], DEFAULT_TOPIC).schema
    return spark.read.schema(schema).json(paths["report"])


def q_csv_class_split(spark, sf_dir):
    """K2: rows per adjusted class as found in the per-class CSV folders."""
    path = _documents_csv(spark, sf_dir)
    out = shared_path(spark, "topic-job")
    model = nb_all_labels(spark, sf_dir, normalise="mean")
    paths = run_topic_job(spark, path, model, out, text_col=DEFAULT_TEXT_COL,
                          topic_cols=["source"], key_col="doc_id", fmt="csv", bom=True)
    by_class = read_comments(spark, paths["by_class"], DEFAULT_TEXT_COL)
    return by_class.groupBy("adj_class").agg(F.count(F.lit(1)).alias("n"))


def _written_csv(spark, sf_dir) -> dict[str, str]:
    path = _documents_csv(spark, sf_dir)
    out = shared_path(spark, "topic-job")
    model = nb_all_labels(spark, sf_dir, normalise="mean")
    return run_topic_job(spark, path, model, out, text_col=DEFAULT_TEXT_COL, topic_cols=["source"],
                         key_col="doc_id", fmt="csv", bom=True)


def _typed(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*more, F.col("doc_id").cast("bigint").alias("doc_id"), DEFAULT_TEXT_COL, "abs_sentiment", "adj_sentiment",
                       F.col("pos_prob").cast("double").alias("pos_prob"), F.col("topic_baseline").cast("double").alias("topic_baseline"))


def q_csv_result_rows(spark, sf_dir):
    """K1 + K3: the rows of the full CSV result, read back."""
    return _typed(read_comments(spark, _written_csv(spark, sf_dir)["all"], DEFAULT_TEXT_COL))


def q_csv_class_rows(spark, sf_dir):
    """K2 + P11: the rows of the per-class CSV folders, read back."""
    return _typed(read_comments(spark, _written_csv(spark, sf_dir)["by_class"], DEFAULT_TEXT_COL), "adj_class")


def _text_lines(spark, sf_dir, name: str) -> str:
    """Lines of a table's texts, some padded or blank by the line's first letter."""
    path = shared_path(spark, f"{name}-lines")
    line = F.explode(F.split("text", r"\r\n|\r|\n"))
    rows = table(spark, sf_dir, name).filter(F.col("text").isNotNull()).select(line.alias("text"))
    first = F.lower(F.substring("text", 1, 1))
    rows = rows.select(F.when(first == "t", F.concat(F.lit("\u3000 "), "text", F.lit(" \u00a0")))
                       .when(first == "a", F.lit(" \u3000\t")).otherwise(F.col("text")).alias("text"))
    rows \
        .write.mode("errorifexists").text(path)
    return path


def q_text_lines(spark, sf_dir):
    """Document texts as a line file; stripped, blank lines dropped."""
    return read_lines(spark, _text_lines(spark, sf_dir, "documents"))


def q_labelled_lines(spark, sf_dir):
    """Benchmark passages as a positive line file; blank lines kept."""
    return read_lines(spark, _text_lines(spark, sf_dir, "benchmark"), drop_blank=False, label=1)


def q_labelled_csv(spark, sf_dir):
    """S3 + P5: the labelled documents as a ``label,review`` CSV, read back
    as ``text, label``."""
    from ..sources.comments import read_labelled_csv
    from .queries import labelled_docs
    path = shared_path(spark, "labelled-csv")
    write_comments_csv(labelled_docs(spark, sf_dir).select(
        F.col("label").cast("string").alias("label"), F.col("text").alias("review")), path)
    return read_labelled_csv(spark, path)


def q_prediction_log(spark, sf_dir):
    """K6: document predictions appended twice to a prediction log."""
    from ..config import REPLY_LABELS
    from ..operators.predict import predict
    from ..sinks.writers import append_predictions
    from .queries import nb_all_labels
    model = nb_all_labels(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pred = predict(docs, model, "text", "doc_id", REPLY_LABELS).drop("text")
    log = shared_path(spark, "prediction-log")
    append_predictions(pred, log, source="documents")
    append_predictions(pred, log, source="documents")
    return spark.read.parquet(log).drop("scored_at")


IO_QUERIES = {
    "labelled_csv": q_labelled_csv,
    "prediction_log": q_prediction_log,
    "csv_comments": q_csv_comments,
    "csv_comments_split": q_csv_comments_split,
    "csv_topic_job": q_csv_topic_job,
    "csv_class_split": q_csv_class_split,
    "csv_result_rows": q_csv_result_rows,
    "csv_class_rows": q_csv_class_rows,
    "text_lines": q_text_lines,
    "labelled_lines": q_labelled_lines,
}

__all__ = ["IO_QUERIES", "write_comments_csv"]
