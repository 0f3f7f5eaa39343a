"""A training corpus from ``documents``: toxicity filter, near-duplicate removal,
benchmark decontamination, removal of personal data, BPE encoding.

Each stage is (spark, docs, sf_dir) -> DataFrame.  It works on all rows that the
stage before it kept; all but the last return the columns of ``documents`` (with
``n_chars``, where there is one, counted again).  ``run`` writes each stage's rows as
Parquet in the shared folder and gives the next stage that table, so a stage that
is lost is computed again from its input alone.

The stages with Python workers lower the session's ``spark.sql.execution.arrow.maxBytesPerBatch``
(``small_batches``): an executor's JVM and its workers share one memory limit.

Nulls, empty texts, repeated rows and extra columns are treated as the operators'
docstrings say; an empty table passes through as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topictone.llm.bpe import bpe_documents, read_ranks
from topictone.llm.common import ARROW_SETTING, read_table, small_batches, write_shared
from topictone.llm.decontaminate import remove_contamination
from topictone.llm.near_duplicates import keep_one_of_each
from topictone.llm.pii import sanitise
from topictone.llm.toxicity import fit_toxicity, keep_clean

#: The rank file of the last stage.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, by its language's threshold, doesn't reject."""
    small_batches(spark)
    return keep_clean(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels"), whole=True))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked at 80 % of five-word shingles."""
    small_batches(spark)
    return keep_one_of_each(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that repeat ten words of a test item."""
    small_batches(spark)
    return _counted(remove_contamination(docs, read_table(spark, sf_dir, "benchmark"), n=10))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked and disclosing terms generalised."""
    return _counted(sanitise(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the text decoded from the ids."""
    small_batches(spark)
    return bpe_documents(docs, read_ranks(RANKS), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("near-duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal-data", personal_data), ("encoding", encoding)]

#: No SQL expresses these stages; tests/llm/test_pipeline.py holds them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = read_table(spark, sf_dir, "documents"), spark.conf.get(ARROW_SETTING)
    try:
        for name, stage in STAGES:
            docs = write_shared(stage(spark, docs, sf_dir), f"pipeline-{name}")
    finally:
        spark.conf.set(ARROW_SETTING, held)   # all stages are written
    return docs
