"""Live count-based window over the last N observations per endpoint (K1).

``groupBy(endpoint).applyInPandasWithState``: the state per endpoint is the
last ``N - 1`` observations (latency, error flag) plus running counters, so it
is bounded by ``O(N)`` per key whatever the stream length.  Within a
micro-batch rows are ordered by ``(ts, id)``; across micro-batches arrival
order wins.  Window statistics are computed with numpy over sliding views
(vectorised per batch, never per row in Python loops).

With ``idle`` the state of an endpoint goes once the stream's event time is that far past its last row;
an endpoint that comes back begins anew.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from tallyho import spec
from tallyho.session import delete_path

STATE_SCHEMA = T.StructType([
    T.StructField("lat", T.ArrayType(T.DoubleType())),
    T.StructField("err", T.ArrayType(T.IntegerType())),
    T.StructField("count", T.LongType()),
    T.StructField("t0_us", T.LongType()),
    T.StructField("last_us", T.LongType()),
])

STATS_FIELDS = [
    T.StructField("request_count", T.LongType()),
    T.StructField("uptime_sec", T.DoubleType()),
    T.StructField("window_n", T.LongType()),
    T.StructField("success_count", T.LongType()),
    T.StructField("error_count", T.LongType()),
    T.StructField("success_rate", T.DoubleType()),
    T.StructField("avg_latency", T.DoubleType()),
    T.StructField("p95_latency", T.DoubleType()),
    T.StructField("p99_latency", T.DoubleType()),
]


def window_stats(lat: np.ndarray, err: np.ndarray, n_new: int, n: int) -> dict[str, np.ndarray]:
    """Stats of the trailing ``n``-row window ending at each of the last ``n_new`` rows.

    ``lat``/``err`` hold the carried history followed by the new rows.  A
    failed row counts latency 0; only positive latencies enter the latency
    statistics (0.0 when a window has none).
    """
    total = len(lat)
    eff = np.where(err > 0, 0.0, lat)
    valid = np.where(eff > 0, eff, np.nan)
    pad = n - 1
    valid_p = np.concatenate([np.full(pad, np.nan), valid])
    err_p = np.concatenate([np.zeros(pad, dtype=np.int64), err.astype(np.int64)])
    present = np.concatenate([np.zeros(pad, dtype=np.int64), np.ones(total, dtype=np.int64)])
    vw = np.lib.stride_tricks.sliding_window_view(valid_p, n)[-n_new:]
    ew = np.lib.stride_tricks.sliding_window_view(err_p, n)[-n_new:]
    pw = np.lib.stride_tricks.sliding_window_view(present, n)[-n_new:]
    window_n = pw.sum(axis=1)
    errors = ew.sum(axis=1)
    has = ~np.all(np.isnan(vw), axis=1)
    out_avg = np.zeros(n_new)
    out_p95 = np.zeros(n_new)
    out_p99 = np.zeros(n_new)
    if has.any():
        sub = vw[has]
        out_avg[has] = np.nanmean(sub, axis=1)
        out_p95[has] = np.nanpercentile(sub, 95, axis=1, method="linear")
        out_p99[has] = np.nanpercentile(sub, 99, axis=1, method="linear")
    return {"window_n": window_n, "error_count": errors, "success_count": window_n - errors,
            "success_rate": (window_n - errors) / window_n, "avg_latency": out_avg,
            "p95_latency": out_p95, "p99_latency": out_p99}


def make_state_fn(n: int, id_col: str, ts_col: str, latency: str, error_col: str, columns: list[str], expires: bool = False):
    def fn(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        batch = pd.concat(list(pdfs), ignore_index=True)
        if batch.empty:
            return
        batch = batch.sort_values([ts_col, id_col], kind="mergesort").reset_index(drop=True)
        lat0, err0, count0, t0, last = state.get if state.exists else ([], [], 0, None, None)
        if expires and last is not None and last // 1000 < state.getCurrentWatermarkMs():
            lat0, err0, count0, t0 = [], [], 0, None  # timed out in the batch that brings new rows
        lat0, err0 = list(lat0 or []), list(err0 or [])
        ts_us = batch[ts_col].astype("datetime64[us]").astype("int64").to_numpy()
        if t0 is None:
            t0 = int(ts_us[0])
        lat = np.concatenate([np.asarray(lat0, dtype=float), batch[latency].astype(float).to_numpy()])
        err = np.concatenate([np.asarray(err0, dtype=np.int64),
                              batch[error_col].astype(bool).astype(np.int64).to_numpy()])
        stats = window_stats(lat, err, len(batch), n)
        out = batch[columns].copy()
        out["request_count"] = np.arange(count0 + 1, count0 + len(batch) + 1, dtype=np.int64)
        out["uptime_sec"] = (ts_us - t0) / 1e6
        for k, v in stats.items():
            out[k] = v
        keep = n - 1
        state.update((lat[-keep:].tolist() if keep else [], err[-keep:].astype(int).tolist() if keep else [],
                      int(count0 + len(batch)), int(t0), int(max(ts_us.max(), last or 0))))
        if expires:  # the watermark runs behind by the idle time, so it passes the last row when that is over
            state.setTimeoutTimestamp(max(int(ts_us.max() // 1000), state.getCurrentWatermarkMs()) + 1)
        yield out
    return fn


def stream_rolling_latency(stream: DataFrame, n: int = spec.ROLLING_WINDOW, key: str | None = None,
                           id_col: str = "event_id", ts_col: str = "ts", latency: str = "value",
                           error=None, idle: str | None = None) -> DataFrame:
    """Streaming twin of ``metrics.rolling_latency`` (K1).

    ``key`` is the endpoint column (``None``: one endpoint for the whole
    stream).  ``error`` is a boolean column expression (default: no errors).  ``idle``, such as "1 hour", is the
    event time after which an endpoint's state is removed; rows that come later than that are not taken.
    """
    x = stream.withColumn("_err", F.coalesce(error, F.lit(False)) if error is not None else F.lit(False))
    k = key or "_endpoint"
    if key is None:
        x = x.withColumn(k, F.lit("all"))
    columns = [c for c in stream.columns]
    out_schema = T.StructType([*[f for f in stream.schema.fields], *STATS_FIELDS])
    fn = make_state_fn(n, id_col, ts_col, latency, "_err", columns, idle is not None)
    x = x.withWatermark(ts_col, idle) if idle else x
    return x.groupBy(k).applyInPandasWithState(fn, out_schema, STATE_SCHEMA, "append",
                                               GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def stream_rolling_latency_table(stream: DataFrame, path: str, checkpoint: str, n: int = spec.ROLLING_WINDOW,
                                 key: str | None = None, id_col: str = "event_id", ts_col: str = "ts",
                                 latency: str = "value", error=None, trigger: dict | None = None,
                                 idle: str | None = None):
    """K1 for endpoints of any size: start a stream that writes each batch's windows under ``path``.

    A keyed state function runs one Python group per endpoint, so a busy endpoint is
    one task.  Here a batch is windowed by the batch operator, which cuts a group into
    chunks of consecutive rows; the state is a small table with the last ``n - 1`` rows,
    the row count and the first time of each endpoint, written per batch.  Batch
    ``e`` reads the state of batch ``e - 1`` and overwrites its own folders, so a replayed
    batch writes the same rows again; older state folders are deleted.  With ``idle`` an endpoint whose last row
    is that far behind the latest event time leaves the state.  Rows of one batch are ordered by
    ``(ts, id)``; across batches arrival order wins.
    """
    from tallyho.operators.metrics import rolling_latency
    from tallyho.operators.ordered import tail_rows
    from tallyho.operators.stats import join_small, one_row_values

    spark = stream.sparkSession
    keys = [key] if key else ["_endpoint"]
    columns = list(stream.columns)
    failed = F.coalesce(error, F.lit(False)) if error is not None else F.lit(False)

    def write(batch: DataFrame, epoch_id: int) -> None:
        new = batch.withColumn("_failed", failed).withColumn("_batch", F.lit(int(epoch_id)))
        new = new if key else new.withColumn("_endpoint", F.lit("all"))
        facts = new.groupBy(*keys).agg(F.count(F.lit(1)).alias("_new"), F.min(ts_col).alias("_first"), F.max(ts_col).alias("_last"))
        if epoch_id:
            carried = spark.read.parquet(f"{path}/carry/epoch={epoch_id - 1}")
            seen = spark.read.parquet(f"{path}/seen/epoch={epoch_id - 1}")
        else:
            carried, seen = new.limit(0), facts.limit(0).withColumnsRenamed({"_new": "_count", "_first": "_t0"})
        rows = carried.unionByName(new)
        # the totals before this batch, and how many of those rows are carried
        held = carried.groupBy(*keys).agg(F.count(F.lit(1)).alias("_held"))
        r = rolling_latency(rows, n=n, by=keys, order=["_batch", ts_col, id_col], latency=latency,
                            error=F.col("_failed"), ts=ts_col).where(F.col("_batch") == int(epoch_id))
        r = join_small(join_small(r, seen, keys, "left"), held, keys, "left")
        r = join_small(r, facts.select(*keys, "_first"), keys, "left")
        t0 = F.coalesce("_t0", "_first")
        before = F.coalesce("_count", F.lit(0)) - F.coalesce("_held", F.lit(0))
        r = (r.withColumn("request_count", F.col("request_count") + before)
             .withColumn("uptime_sec", F.timestamp_diff("MICROSECOND", t0, F.col(ts_col)).cast("double") / F.lit(1e6)))
        r.select(*columns, *[f.name for f in STATS_FIELDS]).write.mode("overwrite").parquet(f"{path}/data/epoch={epoch_id}")
        last = tail_rows(rows, n - 1, by=keys, order=["_batch", ts_col, id_col])
        both = seen.unionByName(facts.withColumnsRenamed({"_new": "_count", "_first": "_t0"}).withColumn("_late", F.lit(1)),
                                allowMissingColumns=True)
        total = both.groupBy(*keys).agg(F.sum("_count").alias("_count"),
                                        F.min_by("_t0", F.coalesce("_late", F.lit(0))).alias("_t0"), F.max("_last").alias("_last"))
        if idle:
            latest = one_row_values(both.agg(F.max("_last").alias("latest")))["latest"]
            total = total.where(F.col("_last") >= latest - F.expr(f"INTERVAL {idle}"))
            last = join_small(last, total.select(*keys), keys)
        last.write.mode("overwrite").parquet(f"{path}/carry/epoch={epoch_id}")
        total.write.mode("overwrite").parquet(f"{path}/seen/epoch={epoch_id}")
        for name in ("carry", "seen") if epoch_id > 1 else ():  # a batch that is replayed reads the one before it
            delete_path(spark, f"{path}/{name}/epoch={epoch_id - 2}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()
