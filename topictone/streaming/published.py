"""Published baselines that grow with a stream.

The published table holds mergeable states (topic columns, ``n``, ``sum_p4``).  A
publishing stream merges only the new rows of each micro-batch into the last version
and commits the next one (``versions.py``): the work follows the new rows and
the number of topics, never the history, and the figures are those of one aggregation
over everything (integer sums).  An adjusting stream reads the newest committed
version for every micro-batch and writes its number to each row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.labels import micro_units
from ..functions.text import is_valid_text
from ..operators.scorers import Scorer
from .versions import VersionedTable


def merge_baselines(store: VersionedTable, scored: DataFrame, topic_cols: list[str], version: int, p_col: str = "pos_prob") -> None:
    """Commit ``version``: the last one before it, with the rows of ``scored`` added."""
    state = scored.groupBy(*topic_cols).agg(F.count(p_col).alias("n"), F.sum(micro_units(p_col)).alias("sum_p4")).filter("n > 0")
    last = store.latest(before=version)
    if last is not None:
        state = store.read(last).unionByName(state).groupBy(*topic_cols).agg(F.sum("n").alias("n"), F.sum("sum_p4").alias("sum_p4"))
    store.write(state, version)
    store.commit(version)


def start_publish_stream(stream: DataFrame, scorer: Scorer, topic_cols: list[str], store: VersionedTable, *, checkpoint: str,
                         text_col: str | None = None, keep: int = 2, trigger: dict | None = None) -> StreamingQuery:
    """Publish a version per micro-batch, its number that of the batch.  A batch that is
    repeated after its commit changes nothing.  The last ``keep`` versions stay for
    readers that hold one of them."""
    def publish(batch: DataFrame, batch_id: int) -> None:
        if batch_id in store.versions():
            return
        rows = batch.filter(is_valid_text(text_col)) if text_col else batch
        merge_baselines(store, scorer.score(rows, text_col, None), topic_cols, batch_id)
        store.forget(batch_id - keep + 1)

    return (stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def newest_baselines(store: VersionedTable, topics: DataFrame, topic_cols: list[str]) -> Callable[[], tuple[DataFrame, int | None]]:
    """What ``start_adjust_stream`` asks for each micro-batch: the newest baselines and
    their version.  ``topics``: any table with the topic columns (for their types
    while nothing is published)."""
    def read() -> tuple[DataFrame, int | None]:
        version = store.latest()
        if version is None:
            return store.spark.createDataFrame([], topics.select(*topic_cols).schema).withColumn("baseline", F.lit(None).cast("double")), None
        return store.read(version).withColumn("baseline", F.col("sum_p4").cast("double") / (F.lit(10000.0) * F.col("n"))), version

    return read
