"""Registered streaming queries.

Each one streams a given table from its data directory (file source,
``availableNow``), writes to file sinks with checkpoints in the shared folder,
and returns the sink read back as a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import REPLY_LABELS
from ..functions.labels import binary_reply
from ..operators.predict import predict
from ..operators.scorers import ColumnScorer
from ..plans.model_queries import _hashed_fit
from ..plans.oracles import UNTIDY, _event_p, _events, _three_way, _valid
from ..plans.queries import event_probability, untidy
from ..session import path_kind, shared_path, write_shared
from .final_windows import close_windows, start_final_windows
from .published import newest_baselines, start_publish_stream
from .scoring import (event_time_utc, file_stream, latest_windows, start_adjust_stream, start_scoring_stream,
                      start_windowed_stream, windowed_baselines)
from .versions import VersionedTable

WINDOW = "1 hour"
WATERMARK = "1 hour"


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A file stream over one table of the directory, stored as a file or as a
    folder of part files.  All files that are there make one micro-batch, so the
    result does not depend on how the rows are dealt to files."""
    base = sf_dir.rstrip("/")
    path = f"{base}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if path_kind(spark, path) == "folder":
        return reader.parquet(path)
    # A file source watches folders: this one, and of it this file.
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(base)


def _paths(spark, name: str, *kinds: str) -> list[str]:
    return [shared_path(spark, f"{name}-{k}") for k in kinds]


def q_stream_score(spark, sf_dir):
    """X1 + X2: documents arriving as a stream, scored by the Spark ML model.  Per
    document: the streamed score equals the batch score."""
    fit = _hashed_fit(spark, sf_dir)
    sink, rejects, ckpt = _paths(spark, "stream-score", "sink", "rejects", "ckpt")
    start_scoring_stream(table_stream(spark, sf_dir, "documents"), fit.model, "text", sink=sink, rejects=rejects,
                         checkpoint=ckpt, source="documents").awaitTermination()
    streamed = spark.read.parquet(sink).select("doc_id", "source_name", "label", "confidence", "reply")
    batch = predict(spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", "source", "lang", "text"),
                    fit.model, "text", "doc_id", REPLY_LABELS).select(
        "doc_id", "source", "lang", F.col("label").alias("bl"), F.col("confidence").alias("bc"), F.col("sentiment").alias("bs"))
    same = F.col("label").eqNullSafe(F.col("bl")) & F.col("confidence").eqNullSafe(F.col("bc")) & F.col("reply").eqNullSafe(F.col("bs"))
    return batch.join(streamed, "doc_id", "full").select("doc_id", "source", "lang", "source_name", same.alias("same_as_batch"))


def q_stream_rejects(spark, sf_dir):
    """Conversation turns without text go to the rejects sink, the others are
    scored (by the length of the text, so no model is fitted)."""
    table = write_shared(untidy(spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")), "untidy")
    stream = spark.readStream.schema(table.schema).parquet(table.inputFiles()[0].rsplit("/", 1)[0])
    scorer = ColumnScorer(F.least(F.length("text") / F.lit(1000.0), F.lit(1.0)))
    sink, rejects, ckpt = _paths(spark, "stream-rejects", "sink", "rejects", "ckpt")
    start_scoring_stream(stream, scorer, "text", sink=sink, rejects=rejects, checkpoint=ckpt,
                         source="conversations").awaitTermination()
    good = spark.read.parquet(sink).select("conv_id", "turn", "role", "text", F.lit(None).cast("string").alias("reject_reason"))
    return good.unionByName(spark.read.parquet(rejects).select("conv_id", "turn", "role", "text", "reject_reason"))


def q_stream_event_replies(spark, sf_dir):
    """X1 + X2 with an exact check: each arriving event gets label,
    confidence and reply from its ready probability; the audit columns
    (``source_name``, ``scored_at``) are written too."""
    stream = table_stream(spark, sf_dir, "events").select("event_id", "user_id", "value")
    audit = predict(stream, ColumnScorer(event_probability()), None, keep_prob=True).withColumns(
        {"reply": binary_reply("sentiment", REPLY_LABELS), "source_name": F.lit("events"), "scored_at": F.current_timestamp()})
    sink, ckpt = _paths(spark, "stream-replies", "sink", "ckpt")
    (audit.writeStream.format("parquet").outputMode("append").option("checkpointLocation", ckpt)
     .trigger(availableNow=True).start(sink).awaitTermination())
    return spark.read.schema(audit.schema).parquet(sink).drop("scored_at")


def _arriving(spark, sf_dir, kind: str) -> tuple[DataFrame, str, list[DataFrame]]:
    """The events as two arrivals (the lower and the upper half of their ids, null ids
    in the first) and the folder they arrive in."""
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    ends = events.agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).first()
    middle = ((ends["a"] or 0) + (ends["b"] or 0)) // 2
    first = F.coalesce(F.col("event_id") <= middle, F.lit(True))
    return events, *_paths(spark, kind, "in"), [events.filter(first), events.filter(~first)]


def q_stream_topic_adjust(spark, sf_dir):
    """Events adjusted with the baselines published so far, which a second stream
    merges from new rows only: two arrivals, each published and then adjusted, so rows
    of the first show version 0 and rows of the second show version 1."""
    events, folder, arrivals = _arriving(spark, sf_dir, "stream-adjust")
    scorer, columns = ColumnScorer(event_probability()), ["event_id", "user_id", "event_type", "value"]
    sink, adjusted, publishing, versions = _paths(spark, "stream-adjust", "sink", "ckpt", "publish-ckpt", "versions")
    store = VersionedTable(spark, versions)
    for rows in arrivals:
        rows.write.mode("append").parquet(folder)
        start_publish_stream(file_stream(spark, folder, events.schema).select("user_id", "value"), scorer, ["user_id"], store,
                             checkpoint=publishing).awaitTermination()
        start_adjust_stream(file_stream(spark, folder, events.schema).select(*columns), newest_baselines(store, events, ["user_id"]), ["user_id"],
                            scorer, sink=sink, checkpoint=adjusted).awaitTermination()
    return spark.read.parquet(sink).drop("batch_id")


def q_stream_final_windows(spark, sf_dir):
    """X5 in append mode: hourly windows per event type written once, when the watermark
    has passed them, and the rows that came after that.  The events arrive by id, so
    many come late.  Per window and type the final figures, and how many rows (and
    the sum of their ids) came late; rows without a time are under -1."""
    events, folder, arrivals = _arriving(spark, sf_dir, "final-windows")
    scorer = ColumnScorer(event_probability())
    sink, late, ckpt, state = _paths(spark, "final-windows", "sink", "late", "ckpt", "state")
    store = VersionedTable(spark, state)
    for rows in arrivals:
        rows.write.mode("append").parquet(folder)
        stream = scorer.score(file_stream(spark, folder, events.schema).select("event_id", "ts", "event_type", "value"))
        start_final_windows(stream, "ts", WINDOW, WATERMARK, ["event_type"], sink=sink, late=late, state=store,
                            checkpoint=ckpt).awaitTermination()
    close_windows(store, ["event_type"], sink=sink)
    zero = F.lit(0).cast("bigint")
    final = spark.read.parquet(sink).select("window_start", "event_type", "n_rows", "n", "sum_p4", "baseline", zero.alias("n_late"), zero.alias("late_ids"))
    hour = F.unix_seconds(F.window(event_time_utc("ts", events.schema["ts"].dataType), WINDOW)["start"])
    rows = spark.read.parquet(late).select(F.coalesce(hour, F.lit(-1).cast("bigint")).alias("window_start"), "event_type", zero.alias("n_rows"), zero.alias("n"),
                                           zero.alias("sum_p4"), F.lit(None).cast("double").alias("baseline"), F.lit(1).cast("bigint").alias("n_late"),
                                           F.coalesce("event_id", zero).alias("late_ids"))
    return final.unionByName(rows).groupBy("window_start", "event_type").agg(
        *(F.sum(c).alias(c) for c in ("n_rows", "n", "sum_p4", "n_late", "late_ids")), F.max("baseline").alias("baseline"))


def q_stream_bounded_replies(spark, sf_dir):
    """X1 + X2 + S8: a backlog of many files admitted in micro-batches of bounded bytes:
    the replies of one micro-batch over everything."""
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").select("event_id", "user_id", "value")
    folder, sink, rejects, ckpt = _paths(spark, "stream-bounded", "in", "sink", "rejects", "ckpt")
    events.withColumn("text", F.concat(F.lit("event "), "event_id")).repartition(12).write.parquet(folder)
    given = spark.read.parquet(folder)
    size = sum(f["b"] for f in given.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).distinct().collect())
    start_scoring_stream(file_stream(spark, folder, given.schema, max_bytes=max(1, size // 4)), ColumnScorer(event_probability()), "text",
                         sink=sink, rejects=rejects, checkpoint=ckpt, source="events").awaitTermination()
    scored, bad = spark.read.parquet(sink), spark.read.parquet(rejects)
    return scored.select("event_id", "user_id", "value", "label", "sentiment", "confidence", "reply", "source_name").unionByName(
        bad.select("event_id", "user_id", "value", "source_name"), allowMissingColumns=True)


def q_stream_windowed_baseline(spark, sf_dir):
    """Hourly baselines per event type, all windows."""
    stream = table_stream(spark, sf_dir, "events")
    scored = ColumnScorer(event_probability()).score(stream.select("ts", "event_type", "value"))
    sink, ckpt = _paths(spark, "stream-window", "sink", "ckpt")
    start_windowed_stream(windowed_baselines(scored, "ts", WINDOW, WATERMARK, ["event_type"]), sink=sink,
                          checkpoint=ckpt).awaitTermination()
    return latest_windows(spark, sink, ["event_type"])


STREAM_QUERIES = {
    "stream_score": q_stream_score,
    "stream_rejects": q_stream_rejects,
    "stream_event_replies": q_stream_event_replies,
    "stream_topic_adjust": q_stream_topic_adjust,
    "stream_windowed_baseline": q_stream_windowed_baseline,
    "stream_final_windows": q_stream_final_windows,
    "stream_bounded_replies": q_stream_bounded_replies,
}

_WINDOWED = f"""WITH
sp AS (SELECT ts, event_type, {_event_p(False)} AS pos_prob FROM events),
w AS (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS ws, event_type, count(pos_prob) AS n,
         CAST(sum(CAST(round(pos_prob * 10000.0::DOUBLE) AS BIGINT)) AS BIGINT) AS sum_p4
  FROM sp GROUP BY ALL HAVING count(pos_prob) > 0)
SELECT CAST(epoch(ws) AS BIGINT) AS window_start,
       CAST(epoch(ws + INTERVAL 1 HOUR) AS BIGINT) AS window_end,
       event_type, n, sum_p4, CAST(sum_p4 AS DOUBLE) / (10000.0::DOUBLE * n) AS baseline,
       {_three_way('CAST(sum_p4 AS DOUBLE) / (10000.0::DOUBLE * n)')} AS polarity
FROM w"""

STREAM_ORACLES = {
    "stream_event_replies": f"""SELECT event_id, user_id, value, pos_prob,
        CASE WHEN pos_prob > 0.5::DOUBLE THEN 1 ELSE 0 END AS label,
        CASE WHEN pos_prob > 0.5::DOUBLE THEN '好评 (Positive)' ELSE '差评 (Negative)' END AS sentiment,
        round(CASE WHEN pos_prob > 0.5::DOUBLE THEN pos_prob ELSE 1.0::DOUBLE - pos_prob END, 4) AS confidence,
        CASE WHEN pos_prob > 0.5::DOUBLE THEN '好评 (Positive)' ELSE '差评 (Negative)' END AS reply,
        'events' AS source_name
        FROM (SELECT event_id, user_id, value, {_event_p(False)} AS pos_prob FROM events)""",
    "stream_score": f"""SELECT doc_id, source, lang, CASE WHEN {_valid('text')} THEN 'documents' END AS source_name,
        coalesce({_valid('text')}, false) AS same_as_batch FROM documents""",
    "stream_rejects": f"""SELECT conv_id, turn, role, text,
        CASE WHEN text IS NULL THEN 'null text' WHEN NOT {_valid('text')} THEN 'blank text' END AS reject_reason
        FROM {UNTIDY}""",
    # Two arrivals: the first adjusted with its own baselines, the second with those of all rows.
    "stream_topic_adjust": f"""WITH
ev AS (SELECT *, coalesce(event_id <= (SELECT (min(event_id) + max(event_id)) // 2 FROM events), true) AS early FROM events),
one AS (SELECT * FROM ({_events("SELECT * FROM res").replace("FROM events)", "FROM (SELECT * FROM ev WHERE early))")})),
two AS (SELECT * FROM ({_events("SELECT * FROM res").replace("FROM events)", "FROM ev)")}))
SELECT *, CAST(0 AS BIGINT) AS baseline_version FROM one
UNION ALL SELECT two.*, CAST(1 AS BIGINT) FROM two WHERE event_id IN (SELECT event_id FROM ev WHERE NOT early)""",
    # The watermark of the second arrival is that of the first one's newest event.
    "stream_final_windows": f"""WITH
ev AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS ws, {_event_p(False)} AS pos_prob,
       coalesce(event_id <= (SELECT (min(event_id) + max(event_id)) // 2 FROM events), true) AS early FROM events),
ma AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM ev WHERE early),
al AS (SELECT ev.*, CASE WHEN ts IS NULL THEN 'no event time'
       WHEN NOT early AND ws + INTERVAL 1 HOUR <= (SELECT mark FROM ma) THEN 'after its window' END AS late_reason FROM ev),
w AS (SELECT ws, event_type, count(*) AS n_rows, count(pos_prob) AS n,
             CAST(coalesce(sum(CAST(round(pos_prob * 10000.0::DOUBLE) AS BIGINT)), 0) AS BIGINT) AS sum_p4
      FROM al WHERE late_reason IS NULL GROUP BY ALL),
b AS (SELECT *, CASE WHEN n > 0 THEN CAST(sum_p4 AS DOUBLE) / (10000.0::DOUBLE * n) END AS baseline FROM w)
SELECT coalesce(CAST(epoch(ws) AS BIGINT), -1) AS window_start, event_type, CAST(sum(n_rows) AS BIGINT) AS n_rows, CAST(sum(n) AS BIGINT) AS n,
       CAST(sum(sum_p4) AS BIGINT) AS sum_p4, max(baseline) AS baseline, CAST(sum(n_late) AS BIGINT) AS n_late, CAST(sum(late_ids) AS BIGINT) AS late_ids
FROM (SELECT ws, event_type, n_rows, n, sum_p4, baseline, 0 AS n_late, 0 AS late_ids FROM b
      UNION ALL SELECT CASE WHEN ts IS NOT NULL THEN ws END, event_type, 0, 0, 0, NULL, 1, coalesce(event_id, 0) FROM al WHERE late_reason IS NOT NULL)
GROUP BY ALL""",
    "stream_windowed_baseline": _WINDOWED,
}
STREAM_ORACLES["stream_bounded_replies"] = STREAM_ORACLES["stream_event_replies"].replace("value, pos_prob,", "value,", 1)
