"""The batch job end to end: read comments, analyse topics, write the full and
per-class results, write the topic report.

The result is computed once and written as parquet; every other output is
read from those files (so scoring and joins are not repeated, and the job's
lineage ends at the files).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..config import DEFAULT_TOPIC, TopicConfig
from ..operators.report import topic_report
from ..operators.scorers import Scorer
from ..session import owned_tables
from ..sinks.writers import (output_base, write_all, write_by_class, write_report,
                             write_result)
from ..sources.comments import DEFAULT_TEXT_COL, read_comments
from .topic_analysis import analyze_topics


def run_topic_job(spark: SparkSession, input_path: str, scorer: Scorer, out_dir: str, *,
                  text_col: str = DEFAULT_TEXT_COL, topic_cols: list[str] | None = None,
                  key_col: str | list[str] | None = None, fmt: str = "csv", bom: bool = True,
                  headers: str = "en", mode: str = "errorifexists", keep_invalid: bool = False,
                  cfg: TopicConfig = DEFAULT_TOPIC, multi_line: bool = True) -> dict[str, str]:
    """Returns the written paths (``all``, ``by_class``, ``report``)."""
    comments = read_comments(spark, input_path, text_col, multi_line=multi_line)
    return run_topic_job_df(comments, scorer, out_dir, base=output_base(input_path),
                            text_col=text_col, topic_cols=topic_cols or [], key_col=key_col,
                            fmt=fmt, bom=bom, headers=headers, mode=mode, keep_invalid=keep_invalid, cfg=cfg)


def run_topic_job_df(comments: DataFrame, scorer: Scorer, out_dir: str, *, base: str,
                     text_col: str, topic_cols: list[str], key_col: str | list[str] | None = None,
                     fmt: str = "parquet", bom: bool = False, headers: str = "en",
                     mode: str = "errorifexists", keep_invalid: bool = False,
                     cfg: TopicConfig = DEFAULT_TOPIC) -> dict[str, str]:
    """The analysis is computed once, into ``<base>_all`` as parquet; the
    per-class output, a CSV copy and the report are read from those files."""
    spark = comments.sparkSession
    name = f"{base}_all" if fmt == "parquet" else f"{base}_all_parquet"
    # The intermediate scores and baselines go when the result is written.
    with owned_tables(spark):
        analysis = analyze_topics(comments, scorer, text_col, topic_cols, key_col, cfg, keep_invalid=keep_invalid)
        parquet_all = write_all(analysis.result, os.path.join(out_dir, name), mode=mode)
    written = spark.read.parquet(parquet_all)
    paths = {"parquet_all": parquet_all}
    if fmt == "parquet":
        paths["all"] = parquet_all
        paths["by_class"] = write_by_class(written, os.path.join(out_dir, f"{base}_by_class"),
                                           headers=headers, mode=mode)
    else:
        paths.update(write_result(written, out_dir, base, fmt=fmt, split=True, bom=bom,
                                  headers=headers, mode=mode))
    paths["report"] = write_report(topic_report(written, topic_cols, cfg),
                                   os.path.join(out_dir, f"{base}_report"), mode=mode)
    return paths
