"""Command line: ``python -m topictone {train,analyze,predict} ...``.

* ``train``   labelled CSV and/or positive/negative line files -> model
* ``analyze`` comment CSV -> per-topic analysis, result files and report
* ``predict`` one text, or a line file -> label + confidence

The cluster is whatever ``spark-submit`` / the session builder provides.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .config import LABELS_EN, LABELS_ZH, TokenConfig, TopicConfig
from .operators.predict import predict
from .operators.report import report_display, topic_report
from .plans.topic_job import run_topic_job
from .plans.training import labelled_sources, load_model, save_model, train
from .sinks.writers import append_predictions
from .sources.lines import read_lines


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("topictone").getOrCreate()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return spark


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="topictone")
    sub = ap.add_subparsers(dest="cmd", required=True)

    t = sub.add_parser("train")
    t.add_argument("--csv")
    t.add_argument("--pos")
    t.add_argument("--neg")
    t.add_argument("--kind", choices=["nb", "hashed"], default="hashed",
                   help="hashed: narrow scoring, for large tables and streams (default)")
    t.add_argument("--max-length", type=int, default=None)
    t.add_argument("--one-line-csv", action="store_true", help="no quoted newlines: the file is split over tasks")
    t.add_argument("--out", required=True)
    t.add_argument("--overwrite", action="store_true")

    a = sub.add_parser("analyze")
    a.add_argument("--input", required=True)
    a.add_argument("--model", required=True, help="a model saved by `train`")
    a.add_argument("--text-column", default="评论")
    a.add_argument("--topic-columns", default="", help="comma separated; empty = one topic")
    a.add_argument("--key", default="", help="comma separated unique key columns")
    a.add_argument("--keep-invalid", action="store_true", help="keep rows without text, with empty results")
    a.add_argument("--one-line-csv", action="store_true", help="no quoted newlines: the file is split over tasks")
    a.add_argument("--output-dir", default="./result")
    a.add_argument("--format", choices=["csv", "parquet"], default="csv")
    a.add_argument("--labels", choices=["en", "zh"], default="en")
    a.add_argument("--show", type=int, default=20, help="report rows to print (the whole report is in the output)")
    a.add_argument("--overwrite", action="store_true")

    p = sub.add_parser("predict")
    p.add_argument("--model", required=True)
    p.add_argument("--text")
    p.add_argument("--file")
    p.add_argument("--out", help="parquet output; without it the first --show rows are printed")
    p.add_argument("--log", help="append the predictions of --file to this log table")
    p.add_argument("--show", type=int, default=20)

    args = ap.parse_args(argv)
    spark = _session()
    if args.cmd == "train":
        data = labelled_sources(spark, csv=args.csv, pos_lines=args.pos, neg_lines=args.neg, multi_line=not args.one_line_csv)
        trained = train(data, kind=args.kind, token_cfg=TokenConfig(max_length=args.max_length))
        save_model(trained.model, args.out, args.overwrite)
        for row in trained.metrics.orderBy("split").collect():   # three rows
            print(json.dumps(row.asDict()))
    elif args.cmd == "analyze":
        cfg = TopicConfig(labels=LABELS_ZH if args.labels == "zh" else LABELS_EN)
        topics = [c for c in args.topic_columns.split(",") if c]
        paths = run_topic_job(spark, args.input, load_model(spark, args.model), args.output_dir,
                              text_col=args.text_column, topic_cols=topics, fmt=args.format,
                              key_col=[c for c in args.key.split(",") if c] or None,
                              keep_invalid=args.keep_invalid, multi_line=not args.one_line_csv,
                              headers=args.labels, cfg=cfg,
                              mode="overwrite" if args.overwrite else "errorifexists")
        report = topic_report(spark.read.parquet(paths["parquet_all"]), topics, cfg)
        shown = report_display(report, topics)
        for row in (shown.orderBy(*topics) if topics else shown).limit(args.show).collect():
            print(json.dumps(row.asDict(), ensure_ascii=False))
        print(json.dumps(paths, ensure_ascii=False))
    else:
        model = load_model(spark, args.model)
        if args.text is not None:
            df = spark.createDataFrame([(args.text,)], "text string")
            print(json.dumps(predict(df, model, "text").first().asDict(), ensure_ascii=False))
        elif args.file:
            rows = predict(read_lines(spark, args.file), model, "text")
            if args.out:
                rows.write.parquet(args.out)
                rows = spark.read.parquet(args.out)
                print(args.out)
            if args.log:
                append_predictions(rows, args.log, source=args.file)
            if not args.out:
                for row in rows.limit(args.show).collect():
                    print(json.dumps(row.asDict(), ensure_ascii=False))
        else:
            ap.error("predict needs --text or --file")


if __name__ == "__main__":
    main()
