"""Run records with sketches, written, read back and merged."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyho.operators.sketches import RANK_ERROR, latency_sketches, merged_percentiles
from tallyho.plans.catalog import register
from tallyho.session import scratch_path
from tallyho.sources.files import write_run_metrics
from tallyho.sources.tables import read_table


@register("merged_run_percentiles", """
SELECT event_type AS label, count(DISTINCT CAST(ts AS DATE)) AS n_runs, count(*) FILTER (value > 0) AS n_valid,
  true AS p50_in_bound, true AS p95_in_bound, true AS p99_in_bound FROM events GROUP BY event_type""")
def q_merged_runs(spark, sf_dir):
    """One record per event type and day; percentiles over all days hold the rank bound against the log itself."""
    events = read_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("label"), F.date_format("ts", "yyyyMMdd_000000").alias("timestamp"), F.col("value").alias("latency_ms"))
    path = scratch_path(spark, f"runs-{uuid.uuid4().hex}")
    write_run_metrics(latency_sketches(events, by=["label", "timestamp"]), path)
    merged = merged_percentiles(spark.read.parquet(path), by="label")
    valid = events.where("latency_ms > 0").join(F.broadcast(merged), "label")  # one row a label
    shares = valid.groupBy("label", "n_runs", "n_valid").agg(*[
        F.struct((F.count_if(F.col("latency_ms") < F.col(f"p{p}_latency_ms")) / F.col("n_valid")).alias("below"),
                 (F.count_if(F.col("latency_ms") <= F.col(f"p{p}_latency_ms")) / F.col("n_valid")).alias("upto")).alias(f"p{p}")
        for p in (50, 95, 99)])
    inside = lambda p: ((F.col(f"p{p}.below") <= p / 100 + RANK_ERROR)
                        & (F.col(f"p{p}.upto") >= p / 100 - RANK_ERROR)).alias(f"p{p}_in_bound")
    return shares.select("label", "n_runs", "n_valid", *[inside(p) for p in (50, 95, 99)])
