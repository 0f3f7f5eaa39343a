"""Training flow, model reload with sample sentences (M11), the prediction
log (K6) and the command line."""

import json
import os

from topictone.__main__ import main
from topictone.operators.predict import predict
from topictone.plans.training import labelled_sources, load_model, save_model, train
from topictone.sinks.writers import append_predictions

POS = ["房间干净，服务很好", "很好 下次还来", "good clean room", "great stay", "推荐 很好",
       "friendly staff", "nice view", "很好很好", "excellent breakfast", "quiet and clean"] * 3
NEG = ["太差了，再也不来", "dirty room", "bad service", "noisy at night", "差 差 差",
       "rude staff", "broken shower", "太吵了", "smelly carpet", "never again"] * 3


def _files(tmp_dir):
    pos, neg, csv = (os.path.join(tmp_dir, n) for n in ("pos.txt", "neg.txt", "l.csv"))
    with open(pos, "w", encoding="utf-8") as f:
        f.write("\n".join(POS) + "\n")
    with open(neg, "w", encoding="utf-8") as f:
        f.write("\n".join(NEG) + "\n\n")
    with open(csv, "w", encoding="utf-8") as f:
        f.write("label,review\n1,很好\n0,太差\n1,\"nice, clean\"\n")
    return pos, neg, csv


def test_train_reload_and_samples(spark, tmp_dir):
    pos, neg, csv = _files(tmp_dir)
    data = labelled_sources(spark, csv=csv, pos_lines=pos, neg_lines=neg)
    assert data.count() == 3 + len(POS) + len(NEG) + 1      # the blank line is kept
    for kind in ("nb", "hashed"):
        trained = train(data, kind=kind, num_features=1 << 10, reg_grid=(0.0,))
        m = {r["split"]: r for r in trained.metrics.collect()}
        assert sum(r["n"] for r in m.values()) == data.count()
        path = os.path.join(tmp_dir, f"model-{kind}")
        save_model(trained.model, path)
        back = load_model(spark, path)
        samples = spark.createDataFrame([(s,) for s in ["服务很好，房间干净", "太差了 dirty",
                                                        "good but noisy", "还行"]], "text string")
        rows = predict(samples, back, "text").collect()
        assert len(rows) == 4 and all(0 <= r["confidence"] <= 1 for r in rows)
        assert rows[0]["label"] == 1 and rows[1]["label"] == 0
        log = os.path.join(tmp_dir, f"log-{kind}")
        append_predictions(predict(samples, back, "text"), log, source="samples")
        append_predictions(predict(samples, back, "text"), log, source="samples")
        assert spark.read.parquet(log).count() == 8


def test_cli(spark, tmp_dir, capsys):
    pos, neg, _ = _files(tmp_dir)
    model = os.path.join(tmp_dir, "cli-model")
    main(["train", "--pos", pos, "--neg", neg, "--out", model])
    comments = os.path.join(tmp_dir, "hotel.csv")
    with open(comments, "w", encoding="utf-8") as f:
        f.write("评论,shop\n" + "\n".join(f"{t},a" for t in POS[:10] + NEG[:5]) + "\n")
    out = os.path.join(tmp_dir, "result")
    main(["analyze", "--input", comments, "--model", model, "--output-dir", out,
          "--topic-columns", "shop", "--labels", "zh"])
    lines = [ln for ln in capsys.readouterr().out.splitlines() if ln.startswith("{")]
    paths = json.loads(lines[-1])
    assert spark.read.json(paths["report"]).count() == 1
    assert os.path.isdir(os.path.join(paths["by_class"]))
    main(["predict", "--model", model, "--text", "很好"])
    pred = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert pred["sentiment"] in ("好评 (Positive)", "差评 (Negative)")


def test_cli_keys_invalid_rows_report_and_log(spark, tmp_dir, capsys):
    pos, neg, _ = _files(tmp_dir)
    model = os.path.join(tmp_dir, "nb")
    main(["train", "--pos", pos, "--neg", neg, "--kind", "nb", "--out", model])
    comments = os.path.join(tmp_dir, "c.csv")
    with open(comments, "w", encoding="utf-8") as f:
        f.write("id,评论,shop\n1,很好,a\n2,,a\n3,dirty room,b\n")
    main(["analyze", "--input", comments, "--model", model, "--output-dir", os.path.join(tmp_dir, "r"), "--key", "id",
          "--keep-invalid", "--one-line-csv", "--topic-columns", "shop"])
    lines = [json.loads(ln) for ln in capsys.readouterr().out.splitlines() if ln.startswith("{")]
    assert [r["n"] for r in lines if "shop" in r] == [1, 1] and lines[-2]["orig_pos_share"].endswith("%")
    rows = {r["id"]: r for r in spark.read.parquet(lines[-1]["parquet_all"]).collect()}
    assert set(rows) == {"1", "2", "3"} and rows["2"]["adj_sentiment"] is None
    texts = os.path.join(tmp_dir, "t.txt")
    with open(texts, "w", encoding="utf-8") as f:
        f.write("很好\nbad service\n")
    log = os.path.join(tmp_dir, "log")
    main(["predict", "--model", model, "--file", texts, "--log", log])
    printed = [json.loads(ln) for ln in capsys.readouterr().out.splitlines() if ln.startswith("{")]
    assert len(printed) == 2 and spark.read.parquet(log).count() == 2


def test_cli_parquet_output_and_split_report(spark, tmp_dir, capsys):
    from topictone.operators.prep import assign_split, split_report
    pos, neg, _ = _files(tmp_dir)
    model = os.path.join(tmp_dir, "m")
    main(["train", "--pos", pos, "--neg", neg, "--out", model])
    comments = os.path.join(tmp_dir, "c.csv")
    with open(comments, "w", encoding="utf-8") as f:
        f.write("评论\n" + "\n".join(POS[:6] + NEG[:6]) + "\n")
    out = os.path.join(tmp_dir, "r")
    main(["analyze", "--input", comments, "--model", model, "--output-dir", out,
          "--format", "parquet"])
    paths = json.loads([ln for ln in capsys.readouterr().out.splitlines() if ln.startswith("{")][-1])
    assert spark.read.parquet(paths["all"]).count() == 12
    assert spark.read.parquet(paths["by_class"]).count() == 12
    data = labelled_sources(spark, pos_lines=pos, neg_lines=neg)
    sizes, dist = split_report(assign_split(data, ["text"], text_col="text"))
    assert sum(r["n"] for r in sizes.collect()) == sum(r["n"] for r in dist.collect()) == data.count()
