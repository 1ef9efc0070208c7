"""End-to-end jobs on a CSV fixture written from the student view."""

import glob
import tempfile

from pyspark.sql import functions as F

from tallyho import spec
from tallyho.plans import jobs
from tallyho.sources import files
from tallyho.sources.tables import students
from tests.conftest import SF001

RAW_NAMES = {v: k for k, v in spec.RAW_COLUMN_NAMES.items()}


def _write_raw(spark, root):
    s = students(spark, SF001).withColumnRenamed("age_raw", "age")
    for split in spec.SPLITS:
        part = s.where(F.col("split") == split).drop("split").orderBy("row_ix")
        part = part.select(*[F.col(c).alias(RAW_NAMES.get(c, c)) for c in part.columns])
        part.coalesce(1).write.option("header", True).csv(f"{root}/tmp_{split}")
        src = glob.glob(f"{root}/tmp_{split}/*.csv")[0]
        with open(src, encoding="utf-8") as fh, \
                open(f"{root}/{split}.csv", "w", encoding="utf-8") as out:
            out.write(fh.read())


def test_prepare_profile_train_compare(spark):
    root = tempfile.mkdtemp(prefix="jobs-")
    _write_raw(spark, root)
    reports = jobs.prepare(spark, root, f"{root}/out", head_limits={"train": 800, "validation": 100,
                                                                   "test": 200}, probe_rows=50)
    processed = files.scan_processed(spark, f"{root}/out/splits")
    counts = {r.split: r["count"] for r in processed.groupBy("split").count().collect()}
    assert counts["train"] <= 800 and counts["validation"] <= 100 and counts["test"] <= 200
    assert spark.read.parquet(f"{root}/out/probe").count() == 50
    assert reports["label_distribution"].count() == 3
    prof = jobs.profile_report(spark, f"{root}/out/splits", f"{root}/eda")
    assert prof["gpa_kde"].count() == 400
    report = spark.read.json(f"{root}/eda/summary_report").first()
    assert report.total_rows == counts["train"] and len(report.variables) == 3
    result, card = jobs.train(spark, f"{root}/out/splits", f"{root}/model", small=True)
    assert card["model_name"] in result.models and card["feature_count"] == 22
    assert files.read_model_card(spark, f"{root}/model/metadata").first().model_name == card["model_name"]
    model = files.load_model(f"{root}/model/model")
    assert model is not None


def test_run_report_and_compare(spark):
    root = tempfile.mkdtemp(prefix="runs-")
    log = spark.createDataFrame([
        (1, "2024-01-01 00:00:00", "ok", 10.0, 1, 1), (2, "2024-01-01 00:00:01", "ok", 20.0, 0, 1),
        (3, "2024-01-01 00:00:02", "error", 0.0, 1, 0)],
        "request_id long, ts string, status string, latency_ms double, y_true int, y_pred int"
    ).withColumn("ts", F.to_timestamp("ts"))
    jobs.run_report(log, "local", f"{root}/runs")
    jobs.run_report(log.withColumn("latency_ms", F.col("latency_ms") * 2), "aws", f"{root}/runs")
    latest = files.latest_run(spark, f"{root}/runs", "aws").first()
    assert latest.avg_latency_ms == 30.0
    cmp = {r.metric: r for r in jobs.compare(spark, f"{root}/runs").collect()}
    assert cmp["avg_latency_ms"].pct_diff == 100.0 and cmp["avg_latency_ms"].verdict == "worse"
    assert cmp["accuracy"].verdict == "equivalent"
