"""File order over several files, and run records that a repeated job replaces."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyho.operators.sketches import RANK_ERROR, latency_sketches, merged_percentiles
from tallyho.session import CLEANUP, materialize
from tallyho.sources import files


@pytest.mark.parametrize("split_bytes", ["128m", "2000"])
def test_rows_of_files_of_unequal_size_stand_in_name_order(spark, tmp_path, split_bytes):
    folder = tmp_path / "train.csv"
    folder.mkdir()
    at = 0
    for name, n in (("a", 200), ("b", 2000), ("c", 20), ("d", 0)):
        lines = [f"{at + i},word {i}" for i in range(n)]
        at += n
        (folder / f"{name}.csv").write_text("\n".join(["n,text", *lines]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        scan = spark.read.option("header", True).csv(str(folder))
        assert scan.rdd.getNumPartitions() > 4 or split_bytes == "128m"
        rows = files.with_file_order(scan).select("_row", F.col("n").cast("int").alias("n")).collect()
        assert sorted(r._row for r in rows) == list(range(2220))
        assert all(r._row == r.n for r in rows)
        raw = files.read_raw_splits(spark, str(tmp_path), ["train"])
        assert raw.where("_row <> cast(n as bigint)").isEmpty() and raw.schema["_row"].dataType.simpleString() == "bigint"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_an_empty_file_has_no_rows(spark, tmp_path):
    (tmp_path / "train.csv").write_text("n,text\n")
    assert files.read_raw_splits(spark, str(tmp_path), ["train"]).collect() == []


def test_a_run_that_is_written_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "runs")
    row = lambda label, ts, v: spark.createDataFrame([(label, ts, v)], "label string, timestamp string, p95 double")
    files.write_run_metrics(row("a", "20240101_000000", 1.0), path)
    files.write_run_metrics(row("a", "20240102_000000", 2.0), path)
    files.write_run_metrics(row("b", "20240101_000000", 3.0), path)
    files.write_run_metrics(row("a", "20240102_000000", 4.0), path)  # the job is run again
    got = sorted((r.label, r.timestamp, r.p95) for r in spark.read.parquet(path).collect())
    assert got == [("a", "20240101_000000", 1.0), ("a", "20240102_000000", 4.0), ("b", "20240101_000000", 3.0)]
    assert files.latest_run(spark, path, "a").first().p95 == 4.0
    with pytest.raises(FileNotFoundError):
        files.latest_run(spark, path, "c")


def test_percentiles_of_many_runs_from_their_sketches(spark):
    rng = np.random.default_rng(4)
    rows = [("a" if i % 3 else "b", i % 7, float(v)) for i, v in enumerate(rng.lognormal(3, 1, 30_000))]
    rows += [("c", 0, None), ("c", 0, -1.0), ("c", 1, 0.0), ("a", 99, None)]
    runs = latency_sketches(spark.createDataFrame(rows, "label string, run int, latency_ms double"), by=["label", "run"])
    assert runs.where("latency_sketch is null").count() == 3
    got = {r.label: r for r in merged_percentiles(runs, by="label").collect()}
    assert (got["a"].n_runs, got["b"].n_runs, got["c"].n_runs) == (8, 7, 2)
    assert (got["c"].n_valid, got["c"].p99_latency_ms) == (0, 0.0)
    for label in "ab":
        v = np.array([x for name, _, x in rows if name == label and x is not None and x > 0])
        assert got[label].n_valid == len(v)
        for p in (50, 95, 99):
            q = got[label][f"p{p}_latency_ms"]
            assert (v < q).mean() <= p / 100 + RANK_ERROR and (v <= q).mean() >= p / 100 - RANK_ERROR
    whole = merged_percentiles(runs).first()
    assert whole.n_runs == 17 and whole.n_valid == 30_000


def test_written_tables_leave_no_shuffle_files(spark):
    held = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = held()
    table = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before and table.agg(F.sum("count")).first()[0] == 1000
    assert spark.conf.get(CLEANUP, None) in (None, "false")
