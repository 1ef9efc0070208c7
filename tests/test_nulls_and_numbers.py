"""NULL groups, exact rounding, NaN in quantiles, early stopping, replayed batches, run choice."""

from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from tallyho.functions.scalar import fixed, fmt_duration, round_half_even
from tallyho.operators import clean, metrics, ordered, profile, select
from tallyho.operators.quantiles import quantiles
from tests.conftest import SF001


@pytest.fixture(scope="module")
def grouped(spark):
    rows = [(i, None if i % 3 == 0 else "ab"[i % 2], float(i % 7) if i % 5 else None) for i in range(90)]
    return spark.createDataFrame(rows, "row_ix long, g string, x double")


def test_rows_of_a_null_group_are_kept(grouped):
    want = {g: sorted(r.row_ix for r in grouped.collect() if r.g == g) for g in (None, "a", "b")}
    head = ordered.head_rows(grouped, 4, by="g", order=["row_ix"]).collect()
    tail = ordered.tail_rows(grouped, 4, by="g", order=["row_ix"]).collect()
    for g, rows in want.items():
        assert sorted(r.row_ix for r in head if r.g == g) == rows[:4]
        assert sorted(r.row_ix for r in tail if r.g == g) == rows[-4:]
    assert ordered.head_rows(grouped, {"a": 2}, by="g", order=["row_ix"]).count() == 2
    ties = ordered.head_rows(grouped, 5, by="g", order=["x", "row_ix"]).collect()
    for g in want:
        mine = sorted((r for r in grouped.collect() if r.g == g), key=lambda r: (r.x is not None, r.x or 0, r.row_ix))
        assert sorted(r.row_ix for r in ties if r.g == g) == sorted(r.row_ix for r in mine[:5])
    assert select.sample_n(grouped, 7, by="g").groupBy("g").count().collect()[0]["count"] == 7
    assert ordered.fill_forward(grouped, ["x"], by="g").count() == 90
    assert clean.fill_mean(grouped, ["x"], by="g").where("x is null").count() == 0
    assert profile.histogram(grouped, "x", 5, by="g").where("g is null").agg(F.sum("count")).first()[0] == 24
    assert profile.kde(grouped, "x", by="g", gridsize=10).where("g is null and density > 0").count() > 0


def test_rounding_follows_the_binary_value(spark):
    values = [2.675, 1.005, 1.115, 0.125, 0.375, 0.25, 82.25, 0.0625, -0.125, -2.675, 0.0, 1e15 + 0.3, 123456.785, 5e-324]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", *[round_half_even("v", d).alias(f"d{d}") for d in (1, 2, 3)], fixed("v", 1).alias("t"))
    for r in df.collect():
        for d in (1, 2, 3):
            assert r[f"d{d}"] == float(Decimal(r.v).quantize(Decimal(1).scaleb(-d), ROUND_HALF_EVEN)), (r.v, d)
        if abs(r.v) < 1e6:
            assert r.t == f"{r.v:.1f}" or (r.t, f"{r.v:.1f}") == ("0.0", "-0.0")
    shown = spark.range(1).select(fmt_duration(F.lit(0.25)).alias("a"), fmt_duration(F.lit(61.125)).alias("b")).first()
    assert (shown.a, shown.b) == ("250.00 ms", "1m 1.12s")


def test_nan_is_the_greatest_value(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, float("inf"), float("nan"), float("-inf"))], "v double")
    r = quantiles(df, {"v": F.col("v")}, {"a": 0.0, "b": 0.5, "c": 0.75, "d": 1.0}).first()
    assert (r.v__a, r.v__b, r.v__c) == (float("-inf"), 2.0, float("inf")) and r.v__d != r.v__d


def test_compare_chosen_runs(spark):
    e = spark.read.parquet(f"{SF001}/events.parquet").withColumn("day", F.to_date("ts"))
    runs = metrics.run_metrics(e, label="event_type", latency="value", ts="ts", error=F.lit(False), keys=["day"]).drop("day")
    stamps = sorted(r.timestamp for r in runs.where("label = 'click'").collect())
    old = {r.metric: r.base_value for r in metrics.compare_runs(runs, "click", "view", base_run=stamps[0]).collect()}
    want = runs.where(F.col("timestamp") == stamps[0]).where("label = 'click'").first()
    assert old["p50_latency_ms"] == want.p50_latency_ms


def test_accuracy_is_equivalent_below_the_limit_only(spark):
    base = {m: 1.0 for m in metrics.COMPARED_METRICS}
    rows = [("a", "20240101_000000", *[0.5 if m == "accuracy" else v for m, v in base.items()]),
            ("b", "20240101_000000", *[0.501 if m == "accuracy" else v for m, v in base.items()])]
    runs = spark.createDataFrame(rows, ["label", "timestamp", *base])
    got = {r.metric: r.verdict for r in metrics.compare_runs(runs, "a", "b").collect()}
    assert got["accuracy"] == ("better" if abs(0.501 - 0.5) >= 0.001 else "equivalent") and got["error_rate"] == "equivalent"


def test_a_replayed_batch_is_written_once(spark, tmp_path):
    from tallyho.plans.catalog import fit_logistic_model
    from tallyho.streaming import scoring
    model, _, test = fit_logistic_model(spark, SF001)
    test.limit(20).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(test.schema).parquet(str(tmp_path / "in"))
    for checkpoint in ("one", "two"):  # a new checkpoint makes the source deliver batch 0 again
        q = scoring.stream_score(model, stream, str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / checkpoint))
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 20


def test_boosting_on_noise_stops_ten_rounds_after_its_best(spark):
    from tallyho.operators import models
    from tallyho.operators.features import fit_preprocessor
    from tallyho.plans.catalog import labelled
    rows = labelled(spark, SF001).where("split = 'train'")
    noise = rows.withColumn("pass_fail", (F.rand(3) < 0.5).cast("int"))
    encoded = fit_preprocessor(noise).transform(noise).select("features", "pass_fail")
    model = models.patient(60).fit(encoded)
    assert len(model.trees) < 40 and len(model.body["losses"]) == len(model.trees) + 11


def test_checkpoint_folder_is_required_off_local(spark, monkeypatch):
    from tallyho import session

    class Cluster:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext = Cluster()  # noqa: N815

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_scratch_tables_go(spark):
    from tallyho.session import Scratch
    with Scratch(spark) as scratch:
        t = scratch.table(spark.range(5))
        path = scratch.paths[0][1]
        assert t.count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(path)
