"""Mergeable quantile sketches of run records.

A run's latencies leave a KLL sketch of a few kilobytes, kept as a binary column beside its metrics.  Percentiles over any set
of runs come from merging their sketches; the logs are not read again.  Sketching, merging and reading are Spark's own
functions with partial aggregation.  The rank of a percentile is off by ``RANK_ERROR`` at most (twice the error that the
sketch states for ``SIZE`` at 99 % confidence); ``latency_profile`` stays the exact way from the logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyho.operators.stats import _by

#: Size parameter of a sketch, and the bound on the share of values by which a percentile's rank may be off.
SIZE, RANK_ERROR = 2000, 0.005
PERCENTILES = {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95, "p99_latency_ms": 0.99}


def latency_sketches(df: DataFrame, latency: str = "latency_ms", by=None, size: int = SIZE) -> DataFrame:
    """(keys, n_valid, latency_sketch) of the positive latencies of each run; the sketch is NULL when there are none."""
    v = F.when(F.col(latency) > 0, F.col(latency).cast("double"))
    out = df.groupBy(*_by(by)).agg(F.count(v).alias("n_valid"), F.kll_sketch_agg_double(v, F.lit(size)).alias("latency_sketch"))
    return out.withColumn("latency_sketch", F.when(F.col("n_valid") > 0, F.col("latency_sketch")))


def merged_percentiles(runs: DataFrame, by=None, percentiles: dict[str, float] = PERCENTILES, size: int = SIZE) -> DataFrame:
    """(keys, n_runs, n_valid, percentiles) over the runs of each group, from their sketches alone; 0.0 without any latency."""
    merged = runs.groupBy(*_by(by)).agg(F.count(F.lit(1)).alias("n_runs"), F.coalesce(F.sum("n_valid"), F.lit(0)).alias("n_valid"),
                                        F.kll_merge_agg_double("latency_sketch", F.lit(size)).alias("_sketch"))
    found = [F.when(F.col("n_valid") > 0, F.kll_sketch_get_quantile_double("_sketch", F.lit(float(p)))).otherwise(F.lit(0.0)).alias(name)
             for name, p in percentiles.items()]
    return merged.select(*_by(by), "n_runs", "n_valid", *found)
