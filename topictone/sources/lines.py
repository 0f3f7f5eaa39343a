"""Text-line sources (S4, S5): one comment per line.

``spark.read.text`` splits on ``\\n``, ``\\r\\n`` and ``\\r`` (not on U+2028),
as Python's text mode does.  Lines are stripped with Python's whitespace set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_valid_text, strip_col


def read_lines(spark: SparkSession, path: str, *, drop_blank: bool = True,
               label: int | None = None, text_col: str = "text") -> DataFrame:
    """S5 (``drop_blank=True``): unlabelled lines, blanks dropped.
    S4 (``drop_blank=False, label=k``): labelled lines, blanks kept as ''."""
    df = spark.read.option("wholetext", False).text(path)
    out = df.select(strip_col("value").alias(text_col))
    if drop_blank:
        out = out.filter(is_valid_text(text_col))
    if label is not None:
        out = out.withColumn("label", F.lit(int(label)))
    return out
