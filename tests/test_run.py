import json

from pyspark.sql import functions as F

from tidemark import cli, report
from tidemark.catalog.cleaning import _RAW, demo_spec
from tidemark.plans import pipeline
from tidemark.sources import synthetic
from tidemark.streaming import counts_by_window


def test_whole_run(spark, tmp_path, caplog):
    caplog.set_level("INFO", "tidemark")
    made = synthetic.make(spark, 250)
    tables = {"entity": made["customers"], "usage": made["usage_events"], "billing": made["billing_events"]}
    done = pipeline.run(spark, demo_spec(str(tmp_path)), tables)
    assert 0.4 < done.summary["auc"] < 0.999 and done.summary["features_kept"] <= done.summary["features"]
    assert any(f.code == "SURVIVORSHIP_HANDLED" for f in done.report.findings)
    curve = [r["survival"] for r in done.curve.orderBy("t").collect()]
    assert curve == sorted(curve, reverse=True) and 0 <= curve[-1] <= 1
    assert all(f"── {title} ─" in caplog.text for title in ("Data", "Panel", "Features", "Leakage audit", "Model", "Drivers", "Survival"))
    written = report.write(done, tmp_path / "out")
    assert {"report.html", "summary.json", "feature_dictionary.csv", "survival_curve.csv"} <= set(written)
    assert json.loads((tmp_path / "out/summary.json").read_text())["rows"] == done.summary["rows"]
    assert any("Shapley" in n for n in done.notes) and done.strata and {r["column"] for r in done.logrank} <= set(done.strata)
    page = (tmp_path / "out/report.html").read_text()
    assert all(f"Survival by {c}" in page for c in done.strata)
    assert "<svg" in page and "http" not in page.replace("http-equiv", "")


def test_check_command(spark, tmp_path):
    import yaml

    synthetic.write(synthetic.make(spark, 30), str(tmp_path))
    (tmp_path / "config").mkdir()
    raw = json.loads(json.dumps(_RAW))
    for name, body in raw.items():
        (tmp_path / f"config/{name}.yaml").write_text(yaml.safe_dump(body))
    assert cli.main(["check", "--config", str(tmp_path / "config")]) == 0
    raw["feature"]["profile"]["columns"].append("nowhere")
    (tmp_path / "config/feature.yaml").write_text(yaml.safe_dump(raw["feature"]))
    assert cli.main(["check", "--config", str(tmp_path / "config")]) == 2
    (tmp_path / "config/data.yaml").write_text("entity: {}\n")
    assert cli.main(["run", "--config", str(tmp_path / "config")]) == 2


def test_stream_gives_the_same_windows(spark, tmp_path):
    rows = spark.range(200).select((F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), (F.col("id") / 10).cast("int"))).alias("ts"), (F.col("id") % 3).cast("string").alias("kind"), F.col("id").cast("double").alias("value"))
    rows.write.parquet(str(tmp_path / "in"))
    batch = counts_by_window(spark.read.parquet(str(tmp_path / "in")), "ts", ["kind"], "value", "6 hours")
    stream = counts_by_window(spark.readStream.schema("ts timestamp, kind string, value double").parquet(str(tmp_path / "in")), "ts", ["kind"], "value", "6 hours")
    query = stream.writeStream.format("memory").queryName("w").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(spark.table("w")) == key(batch)
