"""Profiling aggregates (A1-A13): label shares, condition breakdowns, IQR outliers,
threshold profiles, class profiles, histograms and kernel density estimates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyho import spec
from tallyho.operators.clean import NUMERIC_TYPES, _q
from tallyho.operators.label import avg_score
from tallyho.operators.quantiles import median_of, quantiles
from tallyho.operators.stats import (_by, attach_fixed, attach_stats, column_aggs, fix_small, join_groups,
                                     null_safe_join, one_row_values)


def _rate(num, den):
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def label_distribution(df: DataFrame, by=None, label: str = spec.TARGET) -> DataFrame:
    """Counts of 1 and 0 and the pass rate (0 for an empty table)."""
    keys = _by(by)
    y = F.col(label)
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"),
                                F.count_if(y == 1).alias("n_pass"),
                                F.count_if(y == 0).alias("n_fail"))
    return out.withColumn("pass_rate", _rate(F.col("n_pass"), F.col("n_rows")))


def condition_breakdown(df: DataFrame, by=None, label: str = spec.TARGET) -> DataFrame:
    """Why rows passed / failed (A2, A3).

    Among passes: rows meeting each condition.  Among fails: rows failing each
    condition (``<``, so a missing value is not counted) and how many rows
    failed 0, 1 or 2 conditions.
    """
    keys = _by(by)
    x = avg_score(df)
    y, gpa, avg = F.col(label), F.col("gpa"), F.col(spec.AVG_SCORE)
    gpa_low = F.coalesce(gpa < F.lit(spec.GPA_THRESHOLD), F.lit(False)).cast("int")
    avg_low = F.coalesce(avg < F.lit(spec.AVG_SCORE_THRESHOLD), F.lit(False)).cast("int")
    n_failed = gpa_low + avg_low
    fail = y == 0
    return x.groupBy(*keys).agg(
        F.count_if((y == 1) & (gpa >= F.lit(spec.GPA_THRESHOLD))).alias("pass_gpa_ok"),
        F.count_if((y == 1) & (avg >= F.lit(spec.AVG_SCORE_THRESHOLD))).alias("pass_avg_ok"),
        F.count_if(fail & (gpa < F.lit(spec.GPA_THRESHOLD))).alias("fail_gpa_low"),
        F.count_if(fail & (avg < F.lit(spec.AVG_SCORE_THRESHOLD))).alias("fail_avg_low"),
        F.count_if(fail & (n_failed == 0)).alias("fail_0_conditions"),
        F.count_if(fail & (n_failed == 1)).alias("fail_1_condition"),
        F.count_if(fail & (n_failed == 2)).alias("fail_2_conditions"))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None, by=None,
                 exclude: Sequence[str] = (spec.TARGET, "row_ix"), approx: bool = False) -> DataFrame:
    """IQR outliers per numeric column (A5).

    Q1/Q3 by linear interpolation, fences ``Q -/+ 1.5 IQR``, strictly outside is
    an outlier; the percentage uses all rows (missing included); only columns
    with at least one outlier.  Two passes: one aggregate for every quartile,
    then one aggregate of every outlier count; rows are not changed.  The
    quartiles come from ``quantiles`` (exact, no single-task merge) unless
    ``approx``.
    """
    keys = _by(by)
    cols = list(columns) if columns else numeric_columns(df, list(exclude) + keys)
    qs = quantiles(df, {c: _q(c) for c in cols}, {"q1": 0.25, "q3": 0.75}, keys, approx)
    x = attach_stats(df, qs, keys)

    def fences(c):
        q1, q3 = _q(f"{c}__q1"), _q(f"{c}__q3")
        iqr = q3 - q1
        return q1, q3, q1 - F.lit(1.5) * iqr, q3 + F.lit(1.5) * iqr

    aggs = {"_n": F.count(F.lit(1))}
    for c in cols:
        q1, q3, lo, hi = fences(c)
        v = _q(c).cast("double")
        aggs[c] = F.struct(F.first(q1).alias("q1"), F.first(q3).alias("q3"),
                           F.first(lo).alias("lower_bound"), F.first(hi).alias("upper_bound"),
                           F.count_if((v < lo) | (v > hi)).alias("n_outliers"))
    wide = column_aggs(x, aggs, keys)
    long = wide.unpivot([*keys, "_n"], cols, "column", "_r")
    return long.select(*keys, "column", "_r.q1", "_r.q3", "_r.lower_bound", "_r.upper_bound",
                       "_r.n_outliers",
                       (F.col("_r.n_outliers") / F.col("_n") * F.lit(100.0)).alias("pct_outliers")
                       ).where(F.col("n_outliers") > 0)


def threshold_profile(df: DataFrame, thresholds: dict | None = None, by=None,
                      approx: bool = False) -> DataFrame:
    """Per variable: mean, median, sample std, min, max, rows >= / < threshold and
    their share of all rows in % (A6, A8).  One row per (group, variable)."""
    keys = _by(by)
    x = avg_score(df) if spec.AVG_SCORE not in df.columns and all(
        c in df.columns for c in spec.SCORE_COLUMNS) else df
    th = thresholds or spec.THRESHOLDS
    present = [v for v in th if v in x.columns]
    aggs = {"_n": F.count(F.lit(1))}
    for v in present:
        c = _q(v).cast("double")
        t = F.lit(float(th[v]))
        aggs[v] = F.struct(t.alias("threshold"), F.avg(c).alias("mean"),
                           F.stddev_samp(c).alias("std"), F.min(c).alias("min"),
                           F.max(c).alias("max"), F.count_if(c >= t).alias("n_above"),
                           F.count_if(c < t).alias("n_below"))
    wide = column_aggs(x, aggs, keys)
    meds = median_of(x, {v: _q(v) for v in present}, keys, approx, suffix="__median")
    wide = join_groups(wide, meds, keys)
    wide = wide.select(*keys, "_n", *[_q(v).withField("median", _q(v + "__median")).alias(v)
                                      for v in present])
    long = wide.unpivot([*keys, "_n"], present, "variable", "_r")
    n = F.col("_n").cast("double")
    fields = ["threshold", "mean", "median", "std", "min", "max", "n_above", "n_below"]
    return long.select(*keys, "variable", *[F.col("_r." + f).alias(f) for f in fields],
                       (F.try_divide(F.col("_r.n_above") * F.lit(100.0), n)).alias("pct_above"),
                       (F.try_divide(F.col("_r.n_below") * F.lit(100.0), n)).alias("pct_below"))


def class_profile(df: DataFrame, columns: Sequence[str] = ("gpa", spec.AVG_SCORE),
                  label: str = spec.TARGET, approx: bool = False) -> DataFrame:
    """Mean and median of each column per class."""
    x = avg_score(df) if spec.AVG_SCORE in columns and spec.AVG_SCORE not in df.columns else df
    means = x.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"),
                                 *[F.avg(_q(c).cast("double")).alias(f"{c}_mean") for c in columns])
    meds = median_of(x, {c: _q(c) for c in columns}, label, approx, suffix="_median")
    out = join_groups(means, meds, [label])
    return out.select(label, "n_rows", *[n for c in columns for n in (f"{c}_mean", f"{c}_median")])


def dataset_report(df: DataFrame, label: str = spec.TARGET, by=None) -> DataFrame:
    """Report header: rows, columns, pass/fail counts and percentages."""
    keys = _by(by)
    y = F.col(label)
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_rows"),
                                F.count_if(y == 1).alias("pass_count"),
                                F.count_if(y == 0).alias("fail_count"))
    return out.select(*keys, "total_rows", F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
                      "pass_count", "fail_count",
                      F.try_divide(F.col("pass_count") * F.lit(100.0), F.col("total_rows")).alias("pass_percentage"),
                      F.try_divide(F.col("fail_count") * F.lit(100.0), F.col("total_rows")).alias("fail_percentage"))


def region_rate(df: DataFrame, label: str = spec.TARGET, by=None) -> DataFrame:
    """Rows with avg >= 73 and attendance >= 0.85, their share, and the share of
    them labelled pass (NULL for an empty region) (A13)."""
    keys = _by(by)
    x = avg_score(df)
    region = (F.col(spec.AVG_SCORE) >= F.lit(spec.AVG_SCORE_THRESHOLD)) & (
        F.col("attendance_rate") >= F.lit(spec.ATTENDANCE_THRESHOLD))
    out = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"),
                               F.count_if(region).alias("n_region"),
                               F.count_if(region & (F.col(label) == 1)).alias("n_region_pass"))
    return out.select(*keys, "n_rows", "n_region", "n_region_pass",
                      F.try_divide(F.col("n_region") * F.lit(100.0), F.col("n_rows")).alias("pct_region"),
                      F.try_divide(F.col("n_region_pass") * F.lit(100.0), F.col("n_region")).alias("pct_region_pass"))


def histogram(df: DataFrame, column: str, bins: int = spec.HIST_BINS, by=None,
              density: bool = False) -> DataFrame:
    """Equal-width histogram over each group's own min..max, last bin closed.

    A constant column uses the range ``value -/+ 0.5``.  Empty bins are
    included.  One row per (group, bin) with edges, count and (optionally)
    density ``count / (n * width)``.  Plan: one min/max/count aggregate, a
    partial-aggregated count per (group, bin), and a left join from the small
    (groups x bins) table.
    """
    keys = _by(by)
    v = _q(column).cast("double")
    stats = df.where(v.isNotNull()).groupBy(*keys).agg(
        F.min(v).alias("_lo0"), F.max(v).alias("_hi0"), F.count(F.lit(1)).alias("_n"))
    same = F.col("_lo0") == F.col("_hi0")
    stats = stats.select(*keys, "_n",
                         F.when(same, F.col("_lo0") - 0.5).otherwise(F.col("_lo0")).alias("_lo"),
                         F.when(same, F.col("_hi0") + 0.5).otherwise(F.col("_hi0")).alias("_hi"))
    # Fixed once: both the rows and the (groups x bins) grid use the same small table.
    stats, local = fix_small(stats)
    x = attach_fixed(df.where(v.isNotNull()).select(*keys, v.alias("_v")), stats, local, keys, "left")
    raw = F.floor((F.col("_v") - F.col("_lo")) * F.lit(float(bins)) / (F.col("_hi") - F.col("_lo")))
    b = F.least(raw, F.lit(bins - 1)).cast("int")
    counts = x.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = stats.select(*keys, "_n", "_lo", "_hi",
                        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = null_safe_join(grid, counts, [*keys, "bin"], "left")
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    cols = [*keys, "bin",
            (F.col("_lo") + F.col("bin") * width).alias("bin_lo"),
            (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
            F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")]
    if density:
        cols.append((F.coalesce(F.col("count"), F.lit(0)) / (F.col("_n") * width)).alias("density"))
    return out.select(*cols)


# Beyond |z| = 39 the Gaussian kernel exp(-z^2/2) underflows to exactly 0.0 in
# double precision, so a value only needs the grid points within 39 bandwidths.
KDE_REACH = 39.0


def kde(df: DataFrame, column: str, by: str | None = spec.TARGET, gridsize: int = spec.KDE_GRIDSIZE,
        cut: float = spec.KDE_CUT, common_norm: bool = True) -> DataFrame:
    """Gaussian kernel density per group on a regular grid.

    Scott bandwidth ``std * n^(-1/5)`` (sample std), grid from ``min - cut*bw``
    to ``max + cut*bw`` with ``gridsize`` points; with ``common_norm`` densities
    are scaled by the group's share of all rows.  Exact: each row generates the
    grid indices it can reach (``explode`` of a bounded ``sequence``, at most
    ``gridsize``; beyond ``KDE_REACH`` bandwidths the kernel is exactly 0.0) and
    the kernel sums are partially aggregated per (group, grid index), so only
    groups x grid partial sums leave a task.  No shuffle of values, no join
    between values and the grid.
    """
    keys = _by(by)
    v = _q(column).cast("double")
    base = df.where(v.isNotNull()).select(*keys, v.alias("_v"))
    stats = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("_v").alias("_sd"),
                                    F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    # One row per group, computed once: the values and the grid both read it,
    # and the total over all groups is a one-row aggregate of it.
    stats, local = fix_small(stats)
    stats = stats.withColumns(one_row_values(stats.agg(F.sum("_n").alias("_total"))))
    bw = F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    stats = stats.withColumn("_bw", bw).where((F.col("_bw") > 0) & F.col("_bw").isNotNull())
    stats = stats.select(*keys, "_n", "_total", "_bw",
                         (F.col("_lo") - F.lit(cut) * F.col("_bw")).alias("_g0"),
                         ((F.col("_hi") - F.col("_lo") + F.lit(2 * cut) * F.col("_bw"))
                          / F.lit(float(gridsize - 1))).alias("_step"))
    values = attach_fixed(base, stats, local, keys)
    reach = F.lit(KDE_REACH) * F.col("_bw")
    first = F.greatest(F.ceil((F.col("_v") - reach - F.col("_g0")) / F.col("_step")), F.lit(0))
    last = F.least(F.floor((F.col("_v") + reach - F.col("_g0")) / F.col("_step")), F.lit(gridsize - 1))
    pts = values.select(*keys, "_v", "_bw", "_g0", "_step",
                        F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("grid_ix"))
    x = F.col("_g0") + F.col("grid_ix") * F.col("_step")
    z = (x - F.col("_v")) / F.col("_bw")
    sums = pts.groupBy(*keys, "grid_ix").agg(F.sum(F.exp(F.lit(-0.5) * z * z)).alias("_s"))
    grid = stats.select(*keys, "_n", "_total", "_bw", "_g0", "_step",
                        F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))).alias("grid_ix"))
    grid = grid.withColumn("x", F.col("_g0") + F.col("grid_ix") * F.col("_step"))
    out = join_groups(grid, sums, [*keys, "grid_ix"])
    norm = F.col("_total") if common_norm else F.col("_n")
    dens = F.coalesce(F.col("_s"), F.lit(0.0)) / (
        norm.cast("double") * F.col("_bw") * F.lit(math.sqrt(2 * math.pi)))
    return out.select(*keys, "grid_ix", "x", dens.alias("density"))
