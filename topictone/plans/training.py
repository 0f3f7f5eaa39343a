"""Training as one flow (D1-D5, M1/M2, M8, M9, M10):

    labelled sources -> union -> keyed split (train / eval / test, NULL texts
    dropped) -> fit on train -> pick the variant with the best eval accuracy
    -> accuracy per split (one pass) -> save.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT_TOKENS, SPLIT_SEED, TokenConfig
from ..operators.exact_split import assign_exact_split
from ..operators.hashed import HashedModel, fit_hashed
from ..functions.labels import absolute_id
from ..operators.nb import NBModel, fit_nb, sigmoid_p
from ..operators.predict import predict
from ..operators.prep import assign_split, union_labelled
from ..operators.saved import load_version
from ..operators.scorers import Scorer
from ..sources.comments import read_labelled_csv
from ..session import cut_lineage
from ..sources.lines import read_lines


def labelled_sources(spark: SparkSession, *, csv: str | None = None, pos_lines: str | None = None,
                     neg_lines: str | None = None, text_col: str = "review",
                     label_col: str = "label", multi_line: bool = True) -> DataFrame:
    """``text, label`` from a labelled CSV and/or positive and negative
    line files (blank lines kept, as in the original training data load)."""
    parts = []
    if csv:
        parts.append(read_labelled_csv(spark, csv, text_col, label_col, multi_line=multi_line))
    if pos_lines:
        parts.append(read_lines(spark, pos_lines, drop_blank=False, label=1))
    if neg_lines:
        parts.append(read_lines(spark, neg_lines, drop_blank=False, label=0))
    if not parts:
        raise ValueError("no labelled source given")
    return union_labelled(*parts)


@dataclass
class Trained:
    model: Scorer
    metrics: DataFrame      # split, n, correct, accuracy
    choice: str             # the selected variant


def split_accuracy(data: DataFrame, model: Scorer, text_col: str = "text",
                   label_col: str = "label") -> DataFrame:
    """Accuracy per split in one pass (A7 on every split, A8/M9 = 'test')."""
    gold = data.select("split", text_col, F.col(label_col).alias("__tt_gold"))
    pred = predict(gold, model, text_col)
    return _accuracies(pred, F.col("label") == F.col("__tt_gold"))


def _accuracies(rows: DataFrame, hit) -> DataFrame:
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("correct"),
        F.try_divide(F.count_if(hit), F.count(F.lit(1))).alias("accuracy"))


def _choose_nb(split: DataFrame, variants: dict[str, NBModel]) -> tuple[str, DataFrame]:
    """The variant with the best eval accuracy (ties: "sum") and its accuracy per
    split.  All rows are scored once: the variants share the token sums, so one
    table of (split, label, sum, tokens) gives every figure."""
    rows = split.select("split", "text", F.col("label").alias("__tt_gold")).withColumn("__tt_row", F.monotonically_increasing_id())
    base = variants["sum"]
    # Written once, so the row number is fixed; no text is kept.
    sums = cut_lineage(base.logits(rows, "text", "__tt_row", ("split", "__tt_gold")), "nb-eval")
    hits = {name: absolute_id(sigmoid_p(m.z_expr())) == F.col("__tt_gold") for name, m in variants.items()}
    row = sums.filter("split = 'eval'").agg(*(F.avg(h.cast("double")).alias(n) for n, h in hits.items())).first()
    choice = max(variants, key=lambda n: (row[n] or 0.0, n == "sum"))
    return choice, _accuracies(sums, hits[choice])


def train(data: DataFrame, *, kind: str = "hashed", key_cols: tuple[str, ...] = ("text",),
          seed: int = SPLIT_SEED, token_cfg: TokenConfig = DEFAULT_TOKENS,
          num_features: int = 1 << 18, reg_grid=(0.0, 0.01, 0.1), exact_split: bool = False) -> Trained:
    """Split ``data`` (``text, label``), fit, select on eval, measure.  With
    ``exact_split`` the parts have exact sizes (of all rows, before NULL texts go)."""
    assign = assign_exact_split if exact_split else assign_split
    split = assign(data, list(key_cols), seed=seed, text_col="text")
    tr = split.filter(F.col("split") == "train")
    ev = split.filter(F.col("split") == "eval")
    if kind == "nb":
        base = fit_nb(tr, "text", "label", token_cfg=token_cfg)
        variants = {n: NBModel(base.weights, base.prior, base.vocab, normalise=n,
                               token_cfg=token_cfg) for n in ("sum", "mean")}
        choice, metrics = _choose_nb(split, variants)
        return Trained(variants[choice], metrics, choice)
    elif kind == "hashed":
        fit = fit_hashed(tr, ev, "text", "label", num_features=num_features,
                         reg_grid=reg_grid, token_cfg=token_cfg)
        model = fit.model
        choice = str(fit.grid.filter("chosen").first()["reg_param"])
    else:
        raise ValueError("kind must be 'nb' or 'hashed'")
    return Trained(model, split_accuracy(split, model), choice)


def save_model(model: Scorer, path: str, overwrite: bool = False) -> None:
    """NB weights as parquet, the Spark ML scorer as a pipeline, each with a mark
    that makes it count; fails where something is saved already, unless ``overwrite``."""
    model.save(path, overwrite)


def load_model(spark: SparkSession, path: str) -> Scorer:
    """Whichever kind was saved at ``path``; raises when no whole model is there."""
    kind = load_version(spark, path)[1]["kind"]
    return NBModel.load(spark, path) if kind == "nb" else HashedModel.load(path)
