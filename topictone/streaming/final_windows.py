"""Final event-time windows (X5 in append mode), with late rows kept.

Spark's own windows drop late rows uncounted and, in append mode, never write the last
windows.  Here the open windows are a keyed state of mergeable sums in a versioned
table, one row per open window and topic.  Each micro-batch

* sends rows whose window has ended before the watermark of the batches before to the
  late output, with the reason (rows without an event time too);
* merges the sums of the others into the state and moves the watermark to the
  greatest event time seen, less the delay;
* writes the windows that have ended to the final output, once and for all.

A window is evicted from the state when it is written, so the state is bounded by the
delay.  Every output has a folder per micro-batch, which a repeated batch overwrites
from the same state version: no window is lost or written twice.  Each row is counted
in exactly one final window or stands in the late output (``close_windows`` writes
the windows that are open when a stream has come to its end).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT_TOPIC, TopicConfig
from ..functions.labels import micro_units, three_way
from .scoring import batch_folder, event_time_utc
from .versions import VersionedTable

_SUMS = ("n_rows", "n", "sum_p4")


def _final(windows: DataFrame, topic_cols: list[str], cfg: TopicConfig) -> DataFrame:
    baseline = F.try_divide(F.col("sum_p4").cast("double"), F.lit(10000.0) * F.col("n"))
    return windows.select(F.unix_seconds("window_start").alias("window_start"), F.unix_seconds("window_end").alias("window_end"), *topic_cols,
                          "n_rows", "n", "sum_p4", baseline.alias("baseline"), three_way(baseline, cfg).alias("polarity"))


def start_final_windows(stream: DataFrame, ts_col: str, window: str, delay: str, topic_cols: list[str], *, sink: str, late: str,
                        state: VersionedTable, checkpoint: str, p_col: str = "pos_prob", cfg: TopicConfig = DEFAULT_TOPIC,
                        trigger: dict | None = None) -> StreamingQuery:
    """``sink``: ``window_start, window_end`` (epoch seconds), topics, ``n_rows``, ``n`` (rows
    with a probability), ``sum_p4, baseline, polarity``, one row per window and topic.
    ``late``: the late input rows with ``late_reason``."""
    keys = ["window_start", "window_end", *topic_cols]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = state.latest(before=batch_id)
        before = int(state.note(last)) if last is not None and state.note(last) else None     # micros
        tz = spark.conf.get("spark.sql.session.timeZone")
        span = F.window("__tt_ts", window)
        timed = batch.withColumn("__tt_ts", event_time_utc(ts_col, batch.schema[ts_col].dataType, tz))
        ended = F.unix_micros(F.window_time(F.col("__tt_w"))) < F.lit(before) if before is not None else F.lit(False)
        on_time = timed.filter(F.col("__tt_ts").isNotNull()).withColumn("__tt_w", span)
        none = timed.filter(F.col("__tt_ts").isNull()).select(*batch.columns, F.lit("no event time").alias("late_reason"))
        after = on_time.filter(ended).select(*batch.columns, F.lit("after its window").alias("late_reason"))
        after.unionByName(none).write.mode("overwrite").parquet(batch_folder(late, batch_id))
        new = (on_time.filter(~ended).groupBy(F.col("__tt_w.start").alias("window_start"), F.col("__tt_w.end").alias("window_end"), *topic_cols)
               .agg(F.count(F.lit(1)).alias("n_rows"), F.count(p_col).alias("n"), F.coalesce(F.sum(micro_units(p_col)), F.lit(0)).alias("sum_p4"),
                    F.max("__tt_ts").alias("newest")))
        if last is not None:
            held = state.read(last)
            held = held if before is None else held.filter(F.unix_micros("window_end") > before)   # the others are written
            new = held.unionByName(new).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in _SUMS), F.max("newest").alias("newest"))
        windows = state.write(new, batch_id)
        seen = windows.select(F.unix_micros(F.max("newest") - F.expr(f"INTERVAL {delay}")).alias("w")).first()["w"]
        mark = max((x for x in (before, seen) if x is not None), default=None)
        closed = windows.filter(F.unix_micros("window_end") <= mark) if mark is not None else windows.limit(0)
        _final(closed, topic_cols, cfg).write.mode("overwrite").parquet(batch_folder(sink, batch_id))
        state.commit(batch_id, "" if mark is None else str(mark))
        state.forget(batch_id - 1)     # the one before stays for a repeated batch

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def close_windows(state: VersionedTable, topic_cols: list[str], *, sink: str, cfg: TopicConfig = DEFAULT_TOPIC) -> None:
    """The windows that are still open, when no more rows will come."""
    last = state.latest()
    if last is None:
        return
    note, windows = state.note(last), state.read(last)
    still = windows.filter(F.unix_micros("window_end") > int(note)) if note else windows
    _final(still, topic_cols, cfg).write.mode("overwrite").parquet(batch_folder(sink, last + 1))
