"""Structured Streaming operators.

* X1/X2 ``start_scoring_stream``: score each arriving comment, keep an audit of the
  input, its prediction, its source and the time it was scored.
* X3 the same query routes invalid rows (NULL / blank text) to a rejects sink
  with a reason, so a bad message never stops the stream.
* X4 ``start_adjust_stream``: topic adjustment against the *published* baseline
  table (a stream cannot know the final baseline of a topic; the batch job
  publishes it), read again for each micro-batch.
* X5 ``windowed_baselines``: baselines per event-time window and topic, with a
  watermark; written in update mode, the newest figures of a window count.

Every sink has a folder per micro-batch, overwritten when a batch is repeated,
and a checkpoint, so a restart neither loses nor duplicates rows.  Only narrow
scorers are accepted: a scorer that aggregates would need state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT_JOIN, DEFAULT_TOPIC, REPLY_LABELS, JoinConfig, Labels, TopicConfig
from ..functions.labels import binary_reply, micro_units, three_way
from ..functions.text import is_valid_text
from ..operators.predict import predict
from ..operators.scorers import Scorer
from ..operators.topics import adjust


def _require_narrow(scorer: Scorer) -> None:
    if getattr(scorer, "expensive", False):
        raise ValueError("streams need a narrow scorer (HashedModel or ColumnScorer); "
                         "an aggregating scorer would need state")


def reject_reason(text_col: str):
    """NULL for a valid text, else why it is rejected."""
    t = F.col(f"`{text_col}`")
    return (F.when(t.isNull(), F.lit("null text"))
            .when(~is_valid_text(t), F.lit("blank text")))


def valid_and_rejects(stream: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Split a table or stream into valid rows and rejected rows with a reason."""
    reason = reject_reason(text_col)
    return stream.filter(reason.isNull()), stream.filter(reason.isNotNull()).withColumn("reject_reason", reason)


def scored_rows(valid: DataFrame, scorer: Scorer, text_col: str | None,
                labels: Labels = REPLY_LABELS, source: str | None = None,
                cfg: TopicConfig = DEFAULT_TOPIC) -> DataFrame:
    """X1 + X2: label, confidence, reply and the audit columns of valid rows."""
    _require_narrow(scorer)
    stamp = {"reply": binary_reply("sentiment", labels), "scored_at": F.current_timestamp()}
    if source is not None:
        stamp["source_name"] = F.lit(source)
    return predict(valid, scorer, text_col, None, labels, cfg).withColumns(stamp)


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def start_scoring_stream(stream: DataFrame, scorer: Scorer, text_col: str, *,
                         sink: str, rejects: str, checkpoint: str,
                         trigger: dict | None = None, labels: Labels = REPLY_LABELS,
                         source: str | None = None) -> StreamingQuery:
    """Start X1-X3 as one query: valid rows are scored into ``sink``, the others
    go to ``rejects``.  A row's result depends on that row alone, so the source may
    bound its micro-batches (``file_stream``) however it likes.  Each micro-batch
    has a folder of its own that a repeated batch overwrites, so a restart neither
    loses nor duplicates rows.  ``trigger`` defaults to ``availableNow``."""
    _require_narrow(scorer)

    def write(batch: DataFrame, batch_id: int) -> None:
        # Two narrow passes over the micro-batch's files; nothing of it is held.
        good, bad = valid_and_rejects(batch, text_col)
        scored_rows(good, scorer, text_col, labels, source).write.mode("overwrite").parquet(batch_folder(sink, batch_id))
        bad = bad.withColumn("scored_at", F.current_timestamp())
        if source is not None:
            bad = bad.withColumn("source_name", F.lit(source))
        bad.write.mode("overwrite").parquet(batch_folder(rejects, batch_id))

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def adjust_stream(stream: DataFrame, published: DataFrame, topic_cols: list[str],
                  scorer: Scorer, text_col: str | None = None,
                  cfg: TopicConfig = DEFAULT_TOPIC,
                  join_cfg: JoinConfig = DEFAULT_JOIN) -> DataFrame:
    """Score a stream and adjust it with published baselines (a static
    table: topic columns, ``n``, ``baseline``).  Rows of a topic without a
    published baseline are emitted with a NULL baseline, not adjusted."""
    _require_narrow(scorer)
    src = stream.filter(is_valid_text(text_col)) if text_col else stream
    scored = scorer.score(src, text_col, None)
    return adjust(scored, published, topic_cols, cfg, join_cfg)


def start_adjust_stream(stream: DataFrame, published: Callable[[], DataFrame | tuple[DataFrame, int | None]], topic_cols: list[str],
                        scorer: Scorer, *, sink: str, checkpoint: str, text_col: str | None = None,
                        trigger: dict | None = None, cfg: TopicConfig = DEFAULT_TOPIC,
                        join_cfg: JoinConfig = DEFAULT_JOIN) -> StreamingQuery:
    """X4 with refresh: every micro-batch is adjusted with the baselines that
    ``published()`` reads at that moment, i.e. the newest the batch job wrote.
    A micro-batch is a table, so past the broadcast limits hot topics are salted.
    With ``published.newest_baselines`` every row has the ``baseline_version`` it was
    adjusted with (NULL: nothing was published yet)."""
    _require_narrow(scorer)

    def write(batch: DataFrame, batch_id: int) -> None:
        found = published()
        baselines, *version = found if isinstance(found, tuple) else (found,)
        out = adjust_stream(batch, baselines, topic_cols, scorer, text_col, cfg, join_cfg)
        if version:
            out = out.withColumn("baseline_version", F.lit(version[0]).cast("bigint"))
        out.write.mode("overwrite").parquet(batch_folder(sink, batch_id))

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def file_stream(spark, path: str, schema: T.StructType, *, max_bytes: int | None = None, max_files: int | None = None) -> DataFrame:
    """A stream over the parquet files of a folder.  A backlog is admitted in
    micro-batches of at most ``max_bytes`` bytes (one file at least) or
    ``max_files`` files."""
    reader = spark.readStream.schema(schema)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


UTC_NAMES = ("UTC", "Etc/UTC", "GMT", "Etc/GMT", "Z", "+00:00")


def event_time_utc(ts_col: str, dtype, session_tz: str = "UTC") -> "F.Column":
    """An event-time TIMESTAMP for the watermark.  A TIMESTAMP column is used
    as it is; a TIMESTAMP_NTZ (wall clock) is read as UTC, so the windows do
    not depend on the session time zone (a plain cast when the session is in
    UTC, otherwise built from its fields)."""
    c = F.col(ts_col)
    if isinstance(dtype, T.TimestampNTZType) and session_tz not in UTC_NAMES:
        secs = F.expr(f"extract(SECOND FROM `{ts_col}`)")
        return F.make_timestamp(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c),
                                F.minute(c), secs, F.lit("UTC"))
    return c.cast("timestamp")


def windowed_baselines(stream: DataFrame, ts_col: str, window: str, watermark: str,
                       topic_cols: list[str], p_col: str = "pos_prob",
                       cfg: TopicConfig = DEFAULT_TOPIC) -> DataFrame:
    """``window_start, window_end`` (epoch seconds), topics, ``n, sum_p4,
    baseline, polarity`` per tumbling event-time window.  ``n`` counts rows with a
    probability; a window without any has no row."""
    tz = stream.sparkSession.conf.get("spark.sql.session.timeZone")
    agg = (stream.withColumn("__tt_ts", event_time_utc(ts_col, stream.schema[ts_col].dataType, tz))
           .withWatermark("__tt_ts", watermark)
           .groupBy(F.window("__tt_ts", window).alias("__tt_w"), *topic_cols)
           .agg(F.count(p_col).alias("n"), F.sum(micro_units(p_col)).alias("sum_p4")).filter("n > 0"))
    baseline = F.col("sum_p4").cast("double") / (F.lit(10000.0) * F.col("n"))
    return agg.select(
        F.unix_seconds(F.col("__tt_w.start")).alias("window_start"),
        F.unix_seconds(F.col("__tt_w.end")).alias("window_end"),
        *topic_cols, "n", "sum_p4", baseline.alias("baseline"),
        three_way(baseline, cfg).alias("polarity"))


def start_windowed_stream(windows: DataFrame, *, sink: str, checkpoint: str,
                          trigger: dict | None = None) -> StreamingQuery:
    """Write ``windowed_baselines`` in update mode: each micro-batch writes the
    current figures of the windows it changed, open ones included, so the last
    windows are there without waiting for a later event.  A row is late only
    against the watermark of earlier micro-batches."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(batch_folder(sink, batch_id))

    return (windows.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def latest_windows(spark, sink: str, topic_cols: list[str]) -> DataFrame:
    """The newest figures of each window and topic."""
    rows = spark.read.parquet(sink)
    keys = ["window_start", "window_end", *topic_cols]
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("v"))
    return newest.select(*keys, *(F.col(f"v.{c}").alias(c) for c in values))
