"""Metric operators: published confusion matrices, edge cases, comparisons."""

import pytest
from pyspark.sql import functions as F

from tallyho.functions import fmt_comparison, fmt_duration, pct_diff
from tallyho.operators import metrics


def _pairs(spark, tn, fp, fn, tp):
    rows = [(0, 0)] * tn + [(0, 1)] * fp + [(1, 0)] * fn + [(1, 1)] * tp
    return spark.createDataFrame(rows, "y_true int, y_pred int")


def _from_cells(spark, cells):
    # Expand counts without materialising rows on the driver: one row per cell, then explode.
    df = spark.createDataFrame([(t, p, n) for (t, p), n in cells.items()], "y_true int, y_pred int, n long")
    return df.select("y_true", "y_pred", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_"))


@pytest.mark.parametrize("cells,acc,prec,rec,f1", [
    ({(0, 0): 34423, (0, 1): 6558, (1, 0): 5927, (1, 1): 53092}, 0.87515, 0.8900587, 0.8995747, 0.8947914),
    ({(0, 0): 103705, (0, 1): 20230, (1, 0): 18038, (1, 1): 158027}, 0.87244, 0.8865122, 0.8975492, 0.8919965),
])
def test_published_matrices(spark, cells, acc, prec, rec, f1):
    m = metrics.binary_metrics(_from_cells(spark, cells)).first()
    assert m.accuracy == pytest.approx(acc, abs=1e-7)
    assert m.precision == pytest.approx(prec, abs=1e-7)
    assert m.recall == pytest.approx(rec, abs=1e-7)
    assert m.f1 == pytest.approx(f1, abs=1e-7)


def test_one_class_and_no_positive_predictions(spark):
    m = metrics.binary_metrics(_pairs(spark, 5, 0, 0, 0)).first()
    assert (m.tn, m.fp, m.fn, m.tp, m.precision, m.recall, m.f1, m.accuracy) == (5, 0, 0, 0, 0.0, 0.0, 0.0, 1.0)
    m = metrics.binary_metrics(_pairs(spark, 3, 0, 4, 0)).first()
    assert m.precision == 0.0 and m.f1 == 0.0 and m.predicted_positive_rate == 0.0


def test_class_weights(spark):
    w = metrics.class_weights(spark.createDataFrame([(1,), (1,), (1,), (0,)], "pass_fail int")).first()
    assert (w.imbalance_ratio, w.weight_pos, w.weight_neg) == (pytest.approx(1 / 3), pytest.approx(4 / 6), 2.0)
    w0 = metrics.class_weights(spark.createDataFrame([(0,), (0,)], "pass_fail int")).first()
    assert w0.imbalance_ratio == 1.0 and w0.weight_pos is None


def test_select_best_first_trained_wins_ties(spark):
    t = spark.createDataFrame([("a", 0, 0.5), ("b", 1, 0.7), ("c", 2, 0.7)], "model string, train_order int, f1 double")
    assert metrics.select_best(t).first().best_model == "b"


def test_latency_profile_positive_only_and_empty(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (3.0,), (2.0,), (-1.0,)], "latency_ms double")
    r = metrics.latency_profile(df).first()
    assert (r.n_valid, r.min_latency_ms, r.max_latency_ms, r.median_latency_ms) == (3, 1.0, 3.0, 2.0)
    assert r.p95_latency_ms == pytest.approx(2.9)
    e = metrics.latency_profile(spark.createDataFrame([(0.0,)], "latency_ms double")).first()
    assert (e.avg_latency_ms, e.p99_latency_ms) == (0.0, 0.0)


def test_run_metrics_record(spark):
    log = spark.createDataFrame([
        ("local", "2024-01-01 00:00:00", "ok", 10.0, 1, 1),
        ("local", "2024-01-01 00:00:02", "error", 0.0, 1, 0),
        ("local", "2024-01-01 00:00:04", "ok", 30.0, 0, 0)],
        "label string, ts string, status string, latency_ms double, y_true int, y_pred int"
    ).withColumn("ts", F.to_timestamp("ts"))
    r = metrics.run_metrics(log, y_true="y_true", y_pred="y_pred").first()
    assert (r.n_requests, r.n_errors, r.timestamp) == (3, 1, "20240101_000004")
    assert r.total_execution_time_sec == 4.0 and r.throughput_req_per_sec == 0.5
    assert r.accuracy == pytest.approx(0.6667) and r.success_rate == pytest.approx(0.6667)
    assert r.reliability_percent == pytest.approx(66.67)


def test_pct_diff_and_formats(spark):
    df = spark.createDataFrame([(0.0, 5.0), (2.0, 3.0)], "b double, o double")
    r = df.select(pct_diff("b", "o").alias("d"), pct_diff("b", "o", points=True).alias("p"),
                  fmt_comparison("o", F.col("o") - F.col("b"), F.lit(50.0)).alias("t")).collect()
    assert (r[0].d.abs_diff, r[0].d.pct_diff, r[0].d.base_zero) == (0.0, 0.0, True)
    assert (r[1].d.abs_diff, r[1].d.pct_diff) == (1.0, 50.0)
    assert (r[1].p.abs_diff, r[1].p.pct_diff) == (1.0, 1.0)
    assert r[1].t == "3.000 (+1.000, +50.00%)"
    s = spark.createDataFrame([(0.5,), (12.0,), (125.5,), (-3.0,)], "s double").select(fmt_duration("s").alias("f"))
    assert [x.f for x in s.collect()] == ["500.00 ms", "12.00 s", "2m 5.50s", "-3000.00 ms"]


def test_compare_runs_verdicts(spark):
    runs = spark.createDataFrame([
        ("local", "20240101_000000", 10.0, 5.0, 0.900, 1.0),
        ("local", "20240102_000000", 8.0, 4.0, 0.9000, 1.0),
        ("aws", "20240101_000000", 12.0, 6.0, 0.9005, 0.98)],
        "label string, timestamp string, total_execution_time_sec double, avg_latency_ms double, "
        "accuracy double, success_rate double")
    c = {r.metric: r for r in metrics.compare_runs(
        runs, "local", "aws", ["total_execution_time_sec", "avg_latency_ms", "accuracy", "success_rate"]).collect()}
    assert c["total_execution_time_sec"].base_value == 8.0 and c["total_execution_time_sec"].verdict == "worse"
    assert c["accuracy"].verdict == "equivalent"
    assert c["success_rate"].pct_diff == pytest.approx(-0.02)
    assert c["total_execution_time_sec"].display == "12.00 s"
