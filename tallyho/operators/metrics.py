"""Model and service metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyho import spec
from tallyho.functions.scalar import fmt_comparison, fmt_duration, pct_diff, round_half_even, run_stamp
from tallyho.operators.ordered import tail_rows
from tallyho.operators.quantiles import quantiles
from tallyho.operators.sliding import sliding_statistics
from tallyho.operators.stats import _by, attach_stats, column_aggs, join_groups


def _div0(num: Column, den: Column) -> Column:
    """num / den, 0.0 when the denominator is 0 (sklearn ``zero_division=0``)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def binary_metrics(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", by=None) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 when a denominator is 0), the 2x2 matrix
    ``[[tn, fp], [fn, tp]]`` and actual / predicted positive rates (A14).

    One aggregate of four conditional counts; works with one class only.
    """
    keys = _by(by)
    t, p = F.col(y_true), F.col(y_pred)
    c = df.groupBy(*keys).agg(F.count_if((t == 0) & (p == 0)).alias("tn"),
                              F.count_if((t == 0) & (p == 1)).alias("fp"),
                              F.count_if((t == 1) & (p == 0)).alias("fn"),
                              F.count_if((t == 1) & (p == 1)).alias("tp"))
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    return c.select(*keys, "tn", "fp", "fn", "tp", n.alias("n"),
                    _div0(tp + tn, n).alias("accuracy"),
                    _div0(tp, tp + fp).alias("precision"),
                    _div0(tp, tp + fn).alias("recall"),
                    _div0(F.lit(2) * tp, F.lit(2) * tp + fp + fn).alias("f1"),
                    _div0(tp + fn, n).alias("actual_positive_rate"),
                    _div0(tp + fp, n).alias("predicted_positive_rate"))


def class_weights(df: DataFrame, y: str = spec.TARGET, by=None) -> DataFrame:
    """Class counts, imbalance ``neg/pos`` (1.0 without positives) and balanced
    weights ``n / (2 * n_class)`` (A15, M9)."""
    keys = _by(by)
    c = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                              F.count_if(F.col(y) == 1).alias("n_pos"),
                              F.count_if(F.col(y) == 0).alias("n_neg"))
    n, pos, neg = F.col("n").cast("double"), F.col("n_pos"), F.col("n_neg")
    return c.select(*keys, "n", "n_pos", "n_neg",
                    F.when(pos == 0, F.lit(1.0)).otherwise(neg / pos).alias("imbalance_ratio"),
                    F.try_divide(n, F.lit(2.0) * pos).alias("weight_pos"),
                    F.try_divide(n, F.lit(2.0) * neg).alias("weight_neg"))


def add_class_weight(df: DataFrame, y: str = spec.TARGET, variant: str = "balanced",
                     name: str = "weight") -> DataFrame:
    """Per-row training weight from one broadcast row of class counts (M9).

    ``balanced``: ``n / (2 n_class)``; ``pos_weight``: positives get ``neg/pos``,
    negatives 1; ``none``: 1.
    """
    if variant == "none":
        return df.withColumn(name, F.lit(1.0))
    w = class_weights(df, y)
    x = attach_stats(df, w.select("imbalance_ratio", "weight_pos", "weight_neg"), None)
    if variant == "balanced":
        wcol = F.when(F.col(y) == 1, F.col("weight_pos")).otherwise(F.col("weight_neg"))
    elif variant == "pos_weight":
        wcol = F.when(F.col(y) == 1, F.col("imbalance_ratio")).otherwise(F.lit(1.0))
    else:
        raise ValueError(f"unknown weight variant {variant!r}")
    return x.withColumn(name, F.coalesce(wcol, F.lit(1.0))).drop(
        "imbalance_ratio", "weight_pos", "weight_neg")


def select_best(models: DataFrame, name: str = "model", score: str = "f1",
                order: str = "train_order", by=None) -> DataFrame:
    """Highest score wins; on ties the earliest trained wins."""
    keys = _by(by)
    key = F.struct(F.col(score).alias("s"), (-F.col(order)).alias("o"))
    return models.groupBy(*keys).agg(F.max_by(F.col(name), key).alias("best_model"),
                                     F.max(F.col(score)).alias(f"best_{score}"))


def latency_profile(df: DataFrame, latency: str = "latency_ms", by=None,
                    approx: bool = False) -> DataFrame:
    """Latency summary over positive latencies only; all 0.0 when none.

    Percentiles interpolate linearly at ``(n-1) p`` and come from
    ``quantiles`` (exact without a single-task merge) unless ``approx``.
    """
    keys = _by(by)
    v = F.when(F.col(latency) > 0, F.col(latency).cast("double"))
    z = F.lit(0.0)
    base = df.groupBy(*keys).agg(
        F.count(v).alias("n_valid"),
        F.coalesce(F.avg(v), z).alias("avg_latency_ms"),
        F.coalesce(F.min(v), z).alias("min_latency_ms"),
        F.coalesce(F.max(v), z).alias("max_latency_ms"))
    pct = quantiles(df, {"lat": v}, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, keys, approx)
    out = join_groups(base, pct, keys)
    return out.select(*keys, "n_valid", "avg_latency_ms",
                      F.coalesce(F.col("lat__p50"), z).alias("median_latency_ms"),
                      "min_latency_ms", "max_latency_ms",
                      F.coalesce(F.col("lat__p50"), z).alias("p50_latency_ms"),
                      F.coalesce(F.col("lat__p95"), z).alias("p95_latency_ms"),
                      F.coalesce(F.col("lat__p99"), z).alias("p99_latency_ms"))


def _seconds_between(a: Column, b: Column) -> Column:
    """Seconds from ``a`` to ``b``; works for TIMESTAMP and TIMESTAMP_NTZ alike."""
    return F.timestamp_diff("MICROSECOND", a, b).cast("double") / F.lit(1e6)


def run_metrics(df: DataFrame, label: str = "label", latency: str = "latency_ms",
                ts: str = "ts", error: Column | None = None, y_true: str | None = None,
                y_pred: str | None = None, rounded: bool = True, approx: bool = False,
                keys: Sequence[str] = ()) -> DataFrame:
    """One benchmark record per run label.

    Wall time = first to last request; throughput = valid latencies / wall
    seconds (0 when the wall time is 0); accuracy = correct / max(1, rows with a
    truth value); failed requests still count their latency (only latencies
    <= 0 are excluded).  ``keys`` are extra grouping columns (e.g. a run id)
    kept in the output.
    """
    group = [label, *keys]
    err = F.coalesce(error, F.lit(False)) if error is not None else F.col("status") != F.lit("ok")
    x = df.withColumn("_err", err)
    lat = latency_profile(x, latency, by=group, approx=approx)
    agg = [F.count(F.lit(1)).alias("n_requests"), F.count_if(F.col("_err")).alias("n_errors"),
           F.min(ts).alias("_t0"), F.max(ts).alias("_t1")]
    if y_true and y_pred:
        agg += [F.count_if(F.col(y_true) == F.col(y_pred)).alias("_correct"),
                F.count(F.col(y_true)).alias("_n_truth")]
    base = join_groups(x.groupBy(*group).agg(*agg), lat, group)
    wall = _seconds_between(F.col("_t0"), F.col("_t1"))
    n = F.col("n_requests")
    acc = (F.col("_correct") / F.greatest(F.lit(1), F.col("_n_truth"))) if y_true and y_pred \
        else F.lit(None).cast("double")
    cols = {
        "label": F.col(label).cast("string"),
        "timestamp": run_stamp(F.col("_t1")),
        "n_requests": n,
        "n_errors": F.col("n_errors"),
        "error_rate": _div0(F.col("n_errors"), n),
        "total_execution_time_sec": wall,
        "total_execution_time_ms": wall * F.lit(1000.0),
        "min_latency_ms": F.col("min_latency_ms"),
        "avg_latency_ms": F.col("avg_latency_ms"),
        "median_latency_ms": F.col("median_latency_ms"),
        "p50_latency_ms": F.col("p50_latency_ms"),
        "p95_latency_ms": F.col("p95_latency_ms"),
        "p99_latency_ms": F.col("p99_latency_ms"),
        "max_latency_ms": F.col("max_latency_ms"),
        "throughput_req_per_sec": F.when(wall > 0, F.col("n_valid") / wall).otherwise(F.lit(0.0)),
        "accuracy": acc,
        "success_rate": _div0(n - F.col("n_errors"), n),
        "reliability_percent": _div0(n - F.col("n_errors"), n) * F.lit(100.0),
    }
    out = []
    for name, c in cols.items():
        digits = spec.RUN_METRIC_COLUMNS.get(name)
        if rounded and digits is not None:
            c = round_half_even(c, digits)
        out.append(c.alias(name))
    return base.select(*out, *keys)


def rolling_latency(df: DataFrame, n: int = spec.ROLLING_WINDOW, by=None,
                    order: Sequence[str] = ("ts", "event_id"), latency: str = "value",
                    error: Column | None = None, ts: str = "ts", chunk_rows: int = 100_000,
                    rows_per_part: int | None = None) -> DataFrame:
    """Sliding window over the last ``n`` requests, emitted after every request.

    A failed request counts latency 0 (excluded from latency statistics).  Per
    row: window size, successes, errors, success rate, mean / p95 / p99 of
    positive latencies (0.0 when none), running request count and uptime
    seconds since the group's first request.
    """
    keys = _by(by)
    err = F.coalesce(error, F.lit(False)) if error is not None else F.lit(False)
    lat = F.when(err, F.lit(0.0)).otherwise(F.col(latency).cast("double"))
    x = df.withColumn("_err", err.cast("int")).withColumn("_valid", F.when(lat > 0, lat))
    r = sliding_statistics(x, n, keys, list(order), "_valid", "_err", {"_p95": 0.95, "_p99": 0.99}, chunk_rows=chunk_rows,
                           rows_per_part=rows_per_part)
    r = r.withColumnsRenamed({"n_flagged": "error_count", "mean": "_avg"})
    first = column_aggs(df, {"_t0": F.min(ts)}, keys)
    r = attach_stats(r, first, keys)
    return r.select(
        *[c for c in df.columns],
        (F.col("seq") + 1).alias("request_count"),
        _seconds_between(F.col("_t0"), F.col(ts)).alias("uptime_sec"),
        F.col("window_n"),
        (F.col("window_n") - F.col("error_count")).alias("success_count"),
        F.col("error_count").cast("bigint").alias("error_count"),
        ((F.col("window_n") - F.col("error_count")) / F.col("window_n")).alias("success_rate"),
        F.coalesce(F.col("_avg"), F.lit(0.0)).alias("avg_latency"),
        F.coalesce(F.col("_p95"), F.lit(0.0)).alias("p95_latency"),
        F.coalesce(F.col("_p99"), F.lit(0.0)).alias("p99_latency"))


def tail_summary(df: DataFrame, n: int = spec.ROLLING_WINDOW, by=None,
                 order: Sequence[str] = ("ts", "event_id"), latency: str = "value",
                 error: Column | None = None) -> DataFrame:
    """Summary of the last ``n`` requests only."""
    keys = _by(by)
    err = F.coalesce(error, F.lit(False)) if error is not None else F.lit(False)
    tail = tail_rows(df.withColumn("_err", err), n, keys, list(order))
    v = F.when(~F.col("_err") & (F.col(latency) > 0), F.col(latency).cast("double"))
    z = F.lit(0.0)
    out = tail.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_window"),
        F.count_if(~F.col("_err")).alias("n_success"),
        F.count_if(F.col("_err")).alias("n_errors"),
        F.coalesce(F.avg(v), z).alias("avg_latency"),
        F.coalesce(F.percentile(v, F.lit(0.5)), z).alias("p50_latency"),
        F.coalesce(F.percentile(v, F.lit(0.95)), z).alias("p95_latency"),
        F.coalesce(F.percentile(v, F.lit(0.99)), z).alias("p99_latency"),
        F.coalesce(F.min(v), z).alias("min_latency"),
        F.coalesce(F.max(v), z).alias("max_latency"))
    return out.withColumn("success_rate", F.col("n_success") / F.col("n_window"))


def latest_run(runs: DataFrame, label: str = "label", ts: str = "timestamp") -> DataFrame:
    """Latest run per label: the greatest timestamp (text ``yyyyMMdd_HHmmss``)."""
    others = [c for c in runs.columns if c != label]
    picked = runs.groupBy(label).agg(F.max_by(F.struct(*others), F.col(ts)).alias("_r"))
    return picked.select(label, *[F.col("_r." + c).alias(c) for c in others])


# Direction of improvement for each compared metric (lower latency / time is better).
LOWER_IS_BETTER = ["total_execution_time_sec", "total_execution_time_ms", "min_latency_ms",
                   "avg_latency_ms", "median_latency_ms", "p50_latency_ms", "p95_latency_ms",
                   "p99_latency_ms", "max_latency_ms", "error_rate"]
COMPARED_METRICS = ["total_execution_time_sec", "throughput_req_per_sec", "min_latency_ms",
                    "avg_latency_ms", "p50_latency_ms", "p95_latency_ms", "p99_latency_ms",
                    "max_latency_ms", "accuracy", "success_rate", "error_rate"]


def compare_runs(runs: DataFrame, base_label: str, other_label: str,
                 metrics: Sequence[str] = COMPARED_METRICS, label: str = "label",
                 base_run: str | None = None, other_run: str | None = None, ts: str = "timestamp") -> DataFrame:
    """Two runs side by side, metric by metric (J2, F6-F9): the runs of the given
    stamps, else the latest of each label.

    One row per metric: both values, absolute and % difference (percentage
    points for rate metrics; (0, 0) when the base is 0), a verdict
    (``equivalent`` / ``better`` / ``worse`` for the other run; accuracy is
    equivalent within 0.001) and display texts.
    """
    chosen = F.lit(False)
    for name, stamp in ((base_label, base_run), (other_label, other_run)):
        chosen = chosen | ((F.col(label) == name) & (F.lit(True) if stamp is None else F.col(ts) == stamp))
    latest = latest_run(runs.where(chosen), label, ts)
    ms = list(metrics)
    long = latest.select(label, *[F.col(m).cast("double").alias(m) for m in ms]).unpivot(
        [label], ms, "metric", "value")
    b = long.where(F.col(label) == base_label).select("metric", F.col("value").alias("base_value"))
    o = long.where(F.col(label) == other_label).select("metric", F.col("value").alias("other_value"))
    j = b.join(o, "metric", "full")
    points = F.col("metric").isin(spec.POINT_METRICS)
    d = F.when(points, pct_diff("base_value", "other_value", points=True)).otherwise(
        pct_diff("base_value", "other_value"))
    j = j.withColumn("_d", d)
    diff = F.col("_d.abs_diff")
    eps = F.when(F.col("metric") == "accuracy", F.lit(spec.ACCURACY_EQUIVALENCE)).otherwise(F.lit(0.0))
    lower = F.col("metric").isin(LOWER_IS_BETTER)
    verdict = (F.when(F.col("base_value").isNull() | F.col("other_value").isNull(), F.lit(None))
               .when((F.col("other_value") == F.col("base_value"))
                     | (F.abs(F.col("other_value") - F.col("base_value")) < eps), F.lit("equivalent"))
               .when(lower == (F.col("other_value") < F.col("base_value")), F.lit("better"))
               .otherwise(F.lit("worse")))
    is_time = F.col("metric") == "total_execution_time_sec"
    text = F.when(is_time, fmt_duration("other_value")).otherwise(
        fmt_comparison("other_value", F.col("_d.abs_diff"), F.col("_d.pct_diff")))
    return j.select("metric", "base_value", "other_value", diff.alias("abs_diff"),
                    F.col("_d.pct_diff").alias("pct_diff"), F.col("_d.base_zero").alias("base_zero"),
                    verdict.alias("verdict"), text.alias("display"))


def align_predictions(truth: DataFrame, pred: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Pair truth and prediction rows by key (J1); an inner equi-join (AQE handles skew)."""
    return truth.join(pred, [key] if isinstance(key, str) else list(key), "inner")
