"""The registered queries: one per operator of the inventory.

Every query reads the given tables (``documents``, ``labels``, ``events``,
``conversations``, ``benchmark``) in full and returns a DataFrame.  Models
are trained inside the query from the ``labels`` table, so the work grows
with the data.  Column names match the SQL oracles in ``oracles.py``.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_TOPIC, LABELS_EN, REPLY_LABELS, JoinConfig, TokenConfig
from ..functions.labels import binary_reply
from ..functions.text import is_valid_text, null_to_empty, strip_col, tokens
from ..operators.encode import build_vocabulary, encode_fixed
from ..operators.exact_split import assign_exact_split
from ..operators.nb import fit_nb
from ..operators.prep import (assign_split, split_label_distribution, split_sizes,
                              union_labelled)
from ..operators.predict import accuracy, predict
from ..operators.report import class_counts, topic_report, transition_matrix
from ..operators.scorers import ColumnScorer
from ..operators.topics import RESULT_COLUMNS, rows_of
from ..sources.comments import read_table
from .topic_analysis import analyze_topics

WHOLE_TEXT = TokenConfig(max_length=None)
TRUNCATED = TokenConfig(max_length=128)
VOCAB_SIZE = 5000
VOCAB_MIN_COUNT = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


# ---------------------------------------------------------------- inputs --

def event_probability(positive_leaning: bool = False):
    """A ready probability for each event: p = v / (v + 50) in exact integer
    steps of 1e-4 (v = value in hundredths); ``1 - p`` for the other branch."""
    v = "CAST(round(value * 100) AS BIGINT)"
    p4 = f"({v} * 10000 div ({v} + 5000))"
    if positive_leaning:
        p4 = f"(10000 - {p4})"
    return F.expr(f"CAST({p4} AS DOUBLE) / 10000D")


def events_input(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")


def events_analysis(spark, sf_dir, positive_leaning=False, topic_cols=("user_id",)):
    return analyze_topics(events_input(spark, sf_dir),
                          ColumnScorer(event_probability(positive_leaning)),
                          text_col=None, topic_cols=list(topic_cols))


def labelled_docs(spark, sf_dir, label: str = "quality") -> DataFrame:
    """The labelled comment set: documents with a label (inner join on the
    key; ``labels`` is the smaller side, Spark picks the strategy)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labs = table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label"))
    return labs.join(docs, "doc_id", "inner")


def untidy(conversations: DataFrame) -> DataFrame:
    """Conversation turns with texts missing, blank or padded, by a rule on the key."""
    k = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(8))
    text = (F.when(k == 1, F.lit(None).cast("string")).when(k == 2, F.lit("")).when(k == 3, F.lit(" \u3000\t\u00a0"))
            .when(k == 4, F.concat(F.lit("\u3000 "), "text", F.lit("\u2003\n"))).otherwise(F.col("text")))
    return conversations.select("conv_id", "turn", "role", text.alias("text"))


def untidy_documents(docs: DataFrame) -> DataFrame:
    """Documents with texts missing, blank or padded, by a rule on the key."""
    k = F.pmod(F.col("doc_id"), F.lit(8))
    text = (F.when(k == 1, F.lit(None).cast("string")).when(k == 2, F.lit("")).when(k == 3, F.lit(" \u3000\t\u00a0"))
            .when(k == 4, F.concat(F.lit("\u3000 "), "text", F.lit("\u2003\n"))).otherwise(F.col("text")))
    return docs.withColumn("text", text)


def nb_all_labels(spark, sf_dir, label="quality", normalise="sum"):
    return fit_nb(labelled_docs(spark, sf_dir, label), "text", "label",
                  normalise=normalise, token_cfg=WHOLE_TEXT)


def documents_analysis(spark, sf_dir, label="quality", normalise="mean",
                       topic_cols=("source",)):
    model = nb_all_labels(spark, sf_dir, label, normalise)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text")
    analysis = analyze_topics(docs, model, "text", list(topic_cols), key_col="doc_id")
    return analysis


def split_labelled(spark, sf_dir):
    return assign_split(labelled_docs(spark, sf_dir), ["text"], text_col="text")


# --------------------------------------------------------------- queries --

def q_valid_comments(spark, sf_dir):
    """P1 over turns some of which are missing, blank or padded."""
    return untidy(table(spark, sf_dir, "conversations")).filter(is_valid_text("text"))


def q_stripped_text(spark, sf_dir):
    """P2 over documents some of which are missing, blank or padded."""
    docs = untidy_documents(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", strip_col("text").alias("text_stripped"))


def q_null_to_empty(spark, sf_dir):
    """P4 over labelled documents some of which have no text."""
    docs = untidy_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labs = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return labs.join(docs, "doc_id", "left").select(
        "doc_id", "quality", null_to_empty("text").alias("text"))


def q_labelled_union(spark, sf_dir):
    docs = labelled_docs(spark, sf_dir).select("text", "label", F.lit("labelled").alias("origin"))
    pos = table(spark, sf_dir, "benchmark").select(
        "text", F.lit(1).alias("label"), F.lit("positive_lines").alias("origin"))
    neg = table(spark, sf_dir, "conversations").select(
        "text", F.lit(0).alias("label"), F.lit("negative_lines").alias("origin"))
    return union_labelled(docs, pos, neg)


def _split_input(spark, sf_dir):
    docs = labelled_docs(spark, sf_dir).select("text", "label", F.lit("labelled").alias("origin"))
    turns = untidy(table(spark, sf_dir, "conversations")).select("text", F.lit(0).alias("label"), F.lit("negative_lines").alias("origin"))
    pos = table(spark, sf_dir, "benchmark").select("text", F.lit(1).alias("label"), F.lit("positive_lines").alias("origin"))
    return union_labelled(docs, pos, turns)


def q_split_assign(spark, sf_dir):
    """D2 + D3 (P3): some turns have no text and are dropped."""
    return assign_split(_split_input(spark, sf_dir), ["text"], text_col="text").select("origin", "label", "split", "text")


def q_split_exact(spark, sf_dir):
    """D2 + D3 with exact sizes: the rows in the order of their digests, cut by rank;
    then rows without a text are dropped."""
    return assign_exact_split(_split_input(spark, sf_dir), ["text"], text_col="text").select("origin", "label", "split", "text")


def q_split_exact_sizes(spark, sf_dir):
    """D2 + D4: rows per part before any are dropped."""
    return split_sizes(assign_exact_split(_split_input(spark, sf_dir), ["text"]))


def q_split_sizes(spark, sf_dir):
    return split_sizes(q_split_assign(spark, sf_dir))


def q_split_label_distribution(spark, sf_dir):
    return split_label_distribution(q_split_assign(spark, sf_dir), "label")


def q_tokens_truncated(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id",
        F.size(tokens("text", WHOLE_TEXT)).alias("n_tokens_all"),
        F.size(tokens("text", TRUNCATED)).alias("n_tokens"),
        F.array_join(tokens("text", TRUNCATED), " ").alias("tokens"))


def q_vocabulary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return build_vocabulary(docs, "text", vocab_size=VOCAB_SIZE,
                            min_count=VOCAB_MIN_COUNT, token_cfg=WHOLE_TEXT)


def q_encoded_fixed_length(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    vocab = build_vocabulary(docs, "text", vocab_size=VOCAB_SIZE,
                             min_count=VOCAB_MIN_COUNT, token_cfg=WHOLE_TEXT)
    enc = encode_fixed(docs, vocab, "text", "doc_id", token_cfg=TRUNCATED,
                       vocab_size=VOCAB_SIZE)
    return enc.select("doc_id", F.array_join("input_ids", " ").alias("input_ids"),
                      F.array_join("attention_mask", " ").alias("attention_mask"),
                      "n_real")


def q_encoded_training_set(spark, sf_dir):
    """E4 + P9: the labelled documents as fixed-length ids, mask and label."""
    docs = table(spark, sf_dir, "documents")
    vocab = build_vocabulary(docs, "text", vocab_size=VOCAB_SIZE,
                             min_count=VOCAB_MIN_COUNT, token_cfg=WHOLE_TEXT)
    enc = encode_fixed(labelled_docs(spark, sf_dir), vocab, "text", "doc_id",
                       token_cfg=TRUNCATED, vocab_size=VOCAB_SIZE, carry=("label",))
    return enc.select("doc_id", "label", F.array_join("input_ids", " ").alias("input_ids"),
                      F.array_join("attention_mask", " ").alias("attention_mask"))


def q_nb_model(spark, sf_dir):
    model = nb_all_labels(spark, sf_dir)
    return model.weights.withColumn("prior", F.lit(model.prior).cast("bigint"))


def q_nb_score(spark, sf_dir):
    model = nb_all_labels(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return model.score(docs, "text", "doc_id", keep_z=True).drop("text")


#: Limits that nothing fits: the shuffle joins with salted hot keys.
NOTHING_FITS = JoinConfig(broadcast_max_rows=0, broadcast_max_bytes=0)
#: Room for the most frequent tokens only; the others are joined.
HEAD_FITS = JoinConfig(broadcast_max_rows=500, broadcast_max_bytes=1 << 20)


def q_nb_score_salted(spark, sf_dir):
    """M3 + J3 past the broadcast limits: the frequent tokens broadcast, the others
    counted per text, written once and joined."""
    model = dataclasses.replace(nb_all_labels(spark, sf_dir), join_cfg=HEAD_FITS)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return model.score(docs, "text", "doc_id", keep_z=True).drop("text")


def q_topic_analysis_events_salted(spark, sf_dir):
    """T7 + J2 past the broadcast limits, topics = event types (a few hot keys)."""
    return analyze_topics(events_input(spark, sf_dir), ColumnScorer(event_probability()), text_col=None,
                          topic_cols=["event_type"], join_cfg=NOTHING_FITS).result


def q_nb_score_mean(spark, sf_dir):
    model = nb_all_labels(spark, sf_dir, normalise="mean")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return model.score(docs, "text", "doc_id", keep_z=True).drop("text")


def q_nb_score_min_count(spark, sf_dir):
    """M2/M3 with the vocabulary rule: tokens seen once in training are not
    part of the model."""
    model = fit_nb(labelled_docs(spark, sf_dir), "text", "label", token_cfg=WHOLE_TEXT,
                   min_count=2)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return model.score(docs, "text", "doc_id", keep_z=True).drop("text")


def q_predict_label_confidence(spark, sf_dir):
    model = nb_all_labels(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return predict(docs, model, "text", "doc_id", REPLY_LABELS).drop("text")


def q_binary_reply(spark, sf_dir):
    res = documents_analysis(spark, sf_dir, label="toxic").result
    return res.select("doc_id", "adj_sentiment",
                      binary_reply("adj_sentiment", LABELS_EN).alias("reply"))


def _split_accuracy(spark, sf_dir, split: str):
    """Train on the train split, measure on ``split``."""
    data = split_labelled(spark, sf_dir)
    model = fit_nb(data.filter(F.col("split") == "train"), "text", "label",
                   token_cfg=WHOLE_TEXT)
    part = data.filter(F.col("split") == split).select(
        "doc_id", "text", F.col("label").alias("gold"))
    pred = predict(part, model, "text", "doc_id", REPLY_LABELS)
    return accuracy(pred, "gold", "label")


def q_accuracy(spark, sf_dir):
    return _split_accuracy(spark, sf_dir, "train")


def q_test_accuracy(spark, sf_dir):
    return _split_accuracy(spark, sf_dir, "test")


def q_topic_baseline(spark, sf_dir):
    return events_analysis(spark, sf_dir).baselines.select("user_id", "n", "sum_p4", "baseline")


def q_topic_polarity(spark, sf_dir):
    return events_analysis(spark, sf_dir).baselines.select("user_id", "baseline", "polarity")


def q_topic_support_flag(spark, sf_dir):
    return events_analysis(spark, sf_dir).baselines.select("user_id", "n", "low_support")


def q_adjustment(spark, sf_dir):
    return events_analysis(spark, sf_dir).result.select(
        "event_id", "user_id", "pos_prob", "topic_baseline", "adj_factor", "adj_pos_prob")


def q_adjusted_class(spark, sf_dir):
    return events_analysis(spark, sf_dir).result.select("event_id", "adj_pos_prob", "adj_sentiment")


def q_absolute_class(spark, sf_dir):
    return events_analysis(spark, sf_dir).result.select(
        "event_id", "pos_prob", "abs_sentiment", "abs_confidence")


def q_topic_analysis_events_neg(spark, sf_dir):
    return events_analysis(spark, sf_dir).result


def q_topic_analysis_events_pos(spark, sf_dir):
    return events_analysis(spark, sf_dir, positive_leaning=True).result


def q_topic_analysis_documents(spark, sf_dir):
    return documents_analysis(spark, sf_dir, topic_cols=("source", "lang")).result.drop("text")


def q_topic_analysis_documents_toxic(spark, sf_dir):
    return documents_analysis(spark, sf_dir, label="toxic",
                              topic_cols=("source", "lang")).result.drop("text")


def q_topic_analysis_conversations(spark, sf_dir):
    model = nb_all_labels(spark, sf_dir, normalise="mean")
    conv = table(spark, sf_dir, "conversations")
    return analyze_topics(conv, model, "text", ["conv_id"], key_col=["conv_id", "turn"]).result.drop("text")


def q_topic_analysis_keep_invalid(spark, sf_dir):
    """T8 with ``keep_invalid``: turns without text stay, with NULL results."""
    model = nb_all_labels(spark, sf_dir, normalise="mean")
    conv = untidy(table(spark, sf_dir, "conversations"))
    return analyze_topics(conv, model, "text", ["role"], key_col=["conv_id", "turn"], keep_invalid=True).result.drop("text")


def q_topic_analysis_null_prob(spark, sf_dir):
    """T8 with missing probabilities: they are outside the baseline and have
    NULL results."""
    p = F.when(F.col("event_id") % 7 != 0, event_probability())
    return analyze_topics(events_input(spark, sf_dir), ColumnScorer(p), None, ["user_id"]).result


def q_positive_rows(spark, sf_dir):
    return rows_of(events_analysis(spark, sf_dir).result, DEFAULT_TOPIC.labels.positive)


def q_negative_rows(spark, sf_dir):
    return rows_of(events_analysis(spark, sf_dir, positive_leaning=True).result,
                   DEFAULT_TOPIC.labels.negative)


def q_neutral_rows(spark, sf_dir):
    return rows_of(events_analysis(spark, sf_dir).result, DEFAULT_TOPIC.labels.neutral)


def q_class_counts(spark, sf_dir):
    return class_counts(events_analysis(spark, sf_dir).result, ["user_id"])


def q_class_shares(spark, sf_dir):
    rep = topic_report(events_analysis(spark, sf_dir).result, ["user_id"])
    return rep.select("user_id", "n", "orig_pos_share", "orig_neg_share",
                      "adj_pos_share", "adj_neg_share", "adj_neutral_share")


def q_adjustment_effect(spark, sf_dir):
    rep = topic_report(events_analysis(spark, sf_dir, positive_leaning=True).result, ["user_id"])
    return rep.select("user_id", "polarity", "orig_pos", "adj_pos", "effect")


def q_transition_matrix(spark, sf_dir):
    return transition_matrix(events_analysis(spark, sf_dir).result, ["user_id"])


def q_topic_report(spark, sf_dir):
    return documents_analysis(spark, sf_dir, topic_cols=("source", "lang")).report()


def q_topic_report_events(spark, sf_dir):
    return events_analysis(spark, sf_dir).report()


def q_global_topic(spark, sf_dir):
    return events_analysis(spark, sf_dir, topic_cols=()).result


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "valid_comments": q_valid_comments,
    "stripped_text": q_stripped_text,
    "null_to_empty": q_null_to_empty,
    "labelled_union": q_labelled_union,
    "split_assign": q_split_assign,
    "split_exact": q_split_exact,
    "split_exact_sizes": q_split_exact_sizes,
    "split_sizes": q_split_sizes,
    "split_label_distribution": q_split_label_distribution,
    "tokens_truncated": q_tokens_truncated,
    "vocabulary": q_vocabulary,
    "encoded_fixed_length": q_encoded_fixed_length,
    "encoded_training_set": q_encoded_training_set,
    "nb_model": q_nb_model,
    "nb_score": q_nb_score,
    "nb_score_salted": q_nb_score_salted,
    "nb_score_mean": q_nb_score_mean,
    "nb_score_min_count": q_nb_score_min_count,
    "predict_label_confidence": q_predict_label_confidence,
    "binary_reply": q_binary_reply,
    "accuracy": q_accuracy,
    "test_accuracy": q_test_accuracy,
    "topic_baseline": q_topic_baseline,
    "topic_polarity": q_topic_polarity,
    "topic_support_flag": q_topic_support_flag,
    "adjustment": q_adjustment,
    "adjusted_class": q_adjusted_class,
    "absolute_class": q_absolute_class,
    "topic_analysis_events_neg": q_topic_analysis_events_neg,
    "topic_analysis_events_salted": q_topic_analysis_events_salted,
    "topic_analysis_events_pos": q_topic_analysis_events_pos,
    "topic_analysis_documents": q_topic_analysis_documents,
    "topic_analysis_documents_toxic": q_topic_analysis_documents_toxic,
    "topic_analysis_conversations": q_topic_analysis_conversations,
    "topic_analysis_keep_invalid": q_topic_analysis_keep_invalid,
    "topic_analysis_null_prob": q_topic_analysis_null_prob,
    "positive_rows": q_positive_rows,
    "negative_rows": q_negative_rows,
    "neutral_rows": q_neutral_rows,
    "class_counts": q_class_counts,
    "class_shares": q_class_shares,
    "adjustment_effect": q_adjustment_effect,
    "transition_matrix": q_transition_matrix,
    "topic_report": q_topic_report,
    "topic_report_events": q_topic_report_events,
    "global_topic": q_global_topic,
}

__all__ = ["QUERIES", "RESULT_COLUMNS"]
