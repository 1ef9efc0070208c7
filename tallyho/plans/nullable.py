"""Registered queries whose group key is NULL on some rows, chosen runs, accuracy, and user jobs.

A NULL key is a group like any other.  In the result (and in the SQL) the key is
shown as ``(none)`` where the two engines' joins on it would differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from tallyho.functions.scalar import fmt_comparison, fmt_duration, model_label, round_half_even
from tallyho.operators import clean, metrics, ordered, profile, select
from tallyho.plans.catalog import (ERROR_SQL, FILL_COLUMNS, NUM_FILL, _events, _hist_sql, _iqr_sql, _is_error, _labelled_ctes,
                                   _run_metrics_sql, _students_cte, _with, labelled, register, round_doubles)
from tallyho.session import scratch_path
from tallyho.sources.tables import read_table, students

KEY = "parental_education"


def _shown(df: DataFrame, key: str = KEY) -> DataFrame:
    return df.withColumn(key, F.coalesce(key, F.lit("(none)")))


def _fills(fn: str) -> str:
    stats = ", ".join(f"{fn}({c}) AS {c}_fill" for c in NUM_FILL)
    sel = ", ".join(f"COALESCE(CAST(s.{c} AS DOUBLE), round(f.{c}_fill, 6)) AS {c}" for c in NUM_FILL)
    return _with(f"{_students_cte()}, f AS (SELECT {KEY}, {stats} FROM students GROUP BY {KEY})",
                 f"SELECT s.row_ix, {sel} FROM students s JOIN f ON s.{KEY} IS NOT DISTINCT FROM f.{KEY}")


def _filled(spark, sf_dir, op):
    s = students(spark, sf_dir).select("row_ix", KEY, *NUM_FILL, *[F.col(c).alias("_o_" + c) for c in NUM_FILL])
    x = op(s, NUM_FILL, by=KEY)
    return x.select("row_ix", *[
        F.when(F.col("_o_" + c).isNull(), F.round(c, 6)).otherwise(F.col(c)).alias(c) for c in NUM_FILL])


@register("fill_mean_null_group", _fills("avg"))
def q_fill_mean(spark, sf_dir):
    return _filled(spark, sf_dir, clean.fill_mean)


@register("fill_median_null_group", _fills("median"))
def q_fill_median(spark, sf_dir):
    return _filled(spark, sf_dir, clean.fill_median)


@register("fill_forward_null_group", _with(_students_cte(), "SELECT row_ix, " + ", ".join(
    f"last_value({c} IGNORE NULLS) OVER (PARTITION BY {KEY} ORDER BY row_ix "
    f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in FILL_COLUMNS if c != KEY) + " FROM students"))
def q_fill_forward(spark, sf_dir):
    cols = [c for c in FILL_COLUMNS if c != KEY]
    s = students(spark, sf_dir).select("row_ix", KEY, *cols)
    return ordered.fill_forward(s, cols, by=KEY, order=["row_ix"], chunk_rows=997).select("row_ix", *cols)


def _ranked(order: str, n: int) -> str:
    return _with(_students_cte(), f"SELECT row_ix, {KEY} FROM (SELECT row_ix, {KEY}, row_number() OVER "
                                  f"(PARTITION BY {KEY} ORDER BY {order}) AS rn FROM students) WHERE rn <= {n}")


@register("head_rows_null_group", _ranked("gpa NULLS FIRST, row_ix", 250))
def q_head_rows(spark, sf_dir):
    """First rows by a column with ties and NULLs, then by the row number."""
    return ordered.head_rows(students(spark, sf_dir).select("row_ix", KEY, "gpa"), 250, by=KEY,
                             order=["gpa", "row_ix"]).select("row_ix", KEY)


@register("tail_rows_null_group", _ranked("test_reading DESC NULLS LAST, row_ix DESC", 120))
def q_tail_rows(spark, sf_dir):
    return ordered.tail_rows(students(spark, sf_dir).select("row_ix", KEY, "test_reading"), 120, by=KEY,
                             order=["test_reading", "row_ix"]).select("row_ix", KEY)


@register("sample_n_null_group", _ranked("md5('42:' || CAST(row_ix AS VARCHAR)), row_ix", 90))
def q_sample_n(spark, sf_dir):
    return select.sample_n(students(spark, sf_dir).select("row_ix", KEY), 90, key="row_ix", by=KEY)



_RAW = f"{_students_cte()},\nshown AS (SELECT * REPLACE (COALESCE({KEY}, '(none)') AS {KEY}) FROM students)"


# Sixth powers have a long upper tail, so every group has outliers.
_GPA6 = "gpa * gpa * gpa * gpa * gpa * gpa"


@register("iqr_outliers_null_group", _iqr_sql(_RAW + f",\ntails AS (SELECT {KEY}, {_GPA6} AS gpa6 FROM shown)", "tails",
                                              ["gpa6"], KEY))
def q_iqr(spark, sf_dir):
    s = students(spark, sf_dir).select(KEY, F.expr(_GPA6).alias("gpa6"))
    return round_doubles(_shown(profile.iqr_outliers(s, ["gpa6"], by=KEY)))


_PRICE4 = "(o_totalprice / 120000.0) * (o_totalprice / 120000.0) * (o_totalprice / 120000.0) * (o_totalprice / 120000.0)"


@register("iqr_outliers_orders", _iqr_sql(f"tails AS (SELECT o_orderpriority, {_PRICE4} AS p4 FROM orders)", "tails",
                                          ["p4"], "o_orderpriority"))
def q_iqr_orders(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderpriority", F.expr(_PRICE4).cast("double").alias("p4"))
    return round_doubles(profile.iqr_outliers(o, ["p4"], by="o_orderpriority"))


@register("histogram_null_group", _hist_sql(_RAW, "shown", "gpa", KEY, True))
def q_histogram(spark, sf_dir):
    s = students(spark, sf_dir).select(KEY, "gpa")
    return round_doubles(_shown(profile.histogram(s, "gpa", 50, by=KEY, density=True)))


@register("kde_null_group", _with(_RAW + f""",
base AS (SELECT {KEY} AS g, gpa AS v FROM shown WHERE gpa IS NOT NULL),
st AS (SELECT g, count(*) AS n, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi FROM base GROUP BY g),
tot AS (SELECT count(*) AS total FROM base),
st2 AS (SELECT st.*, total, sd * pow(CAST(n AS DOUBLE), -0.2) AS bw FROM st, tot),
grid AS (SELECT g, n, total, bw, CAST(i AS INTEGER) AS grid_ix,
         (lo - 3.0 * bw) + i * ((hi - lo + 6.0 * bw) / 49.0) AS x FROM st2, range(0, 50) r(i) WHERE bw > 0),
s AS (SELECT grid.g, grid_ix, sum(exp(-0.5 * ((x - v) / bw) * ((x - v) / bw))) AS s
      FROM grid JOIN base ON grid.g = base.g GROUP BY grid.g, grid_ix)""", f"""
SELECT grid.g AS {KEY}, grid.grid_ix, round(x, 6) AS x,
  round(s.s / (CAST(total AS DOUBLE) * bw * sqrt(2 * pi())), 6) AS density
FROM grid JOIN s ON grid.g = s.g AND grid.grid_ix = s.grid_ix"""))
def q_kde(spark, sf_dir):
    s = students(spark, sf_dir).select(KEY, "gpa")
    return round_doubles(_shown(profile.kde(s, "gpa", by=KEY, gridsize=50)))


_VIEWLESS = "events_n AS (SELECT * REPLACE (nullif(event_type, 'view') AS event_type) FROM events)"


def _viewless(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).withColumn("event_type", F.nullif("event_type", F.lit("view")))


def _accuracy_metrics_sql() -> str:
    truth = f"""SELECT *, COALESCE(event_type, '(none)') AS k,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 2 END AS y_true,
  CASE WHEN event_id % 7 < 5 THEN event_id % 2 ELSE 1 - event_id % 2 END AS y_pred FROM events_n"""
    base = _run_metrics_sql().replace("FROM events GROUP BY event_type", "FROM t GROUP BY event_type")
    return (f"WITH {_VIEWLESS},\nt AS ({truth})\n" + base.replace(
        "CAST(NULL AS DOUBLE) AS accuracy",
        "round_even(count(*) FILTER (WHERE y_true = y_pred) / greatest(1, count(y_true)), 4) AS accuracy"))


@register("run_metrics_accuracy", _accuracy_metrics_sql())
def q_run_metrics(spark, sf_dir):
    """Run records with truth values, one label of which is NULL."""
    e = _viewless(spark, sf_dir)
    odd = F.col("event_id") % 2
    e = (e.withColumn("y_true", F.when(F.col("event_id") % 11 != 0, odd))
         .withColumn("y_pred", F.when(F.col("event_id") % 7 < 5, odd).otherwise(1 - odd)))
    return metrics.run_metrics(e, label="event_type", latency="value", ts="ts", error=_is_error(),
                               y_true="y_true", y_pred="y_pred")


@register("rolling_latency_null_group", f"""
WITH {_VIEWLESS}, e AS (SELECT *, CASE WHEN {ERROR_SQL} THEN 0.0 ELSE value END AS lat FROM events_n),
w AS (SELECT *, count(*) OVER win AS window_n, avg(CASE WHEN lat > 0 THEN lat END) OVER win AS a,
        quantile_cont(CASE WHEN lat > 0 THEN lat END, 0.95) OVER win AS p95,
        row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS request_count
      FROM e WINDOW win AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT event_id, request_count, window_n, round(COALESCE(a, 0.0), 6) AS avg_latency,
  round(COALESCE(p95, 0.0), 6) AS p95_latency FROM w""")
def q_rolling(spark, sf_dir):
    r = metrics.rolling_latency(_viewless(spark, sf_dir), n=20, by="event_type", order=["ts", "event_id"],
                                latency="value", error=F.coalesce(_is_error(), F.lit(False)), chunk_rows=500)
    return r.select("event_id", "request_count", "window_n", F.round("avg_latency", 6).alias("avg_latency"),
                    F.round("p95_latency", 6).alias("p95_latency"))


@register("half_even_ties", """
WITH t AS (SELECT o_orderkey AS k, (o_orderkey % 4001 - 2000) / 16.0 AS x FROM orders)
SELECT k, x, CAST(round_even(CAST(x AS DECIMAL(18, 6)), 1) AS DOUBLE) AS one,
  CAST(round_even(CAST(x AS DECIMAL(18, 6)), 3) AS DOUBLE) AS three FROM t""")
def q_half_even(spark, sf_dir):
    """Sixteenths, a quarter of which are exact ties at one decimal and half at three."""
    o = read_table(spark, sf_dir, "orders")
    x = (F.col("o_orderkey") % 4001 - 2000) / F.lit(16.0)
    return o.select(F.col("o_orderkey").alias("k"), x.alias("x"), round_half_even(x, 1).alias("one"),
                    round_half_even(x, 3).alias("three"))


@register("run_texts", """
SELECT event_id, upper(event_type) AS label,
  CASE WHEN s < 1 THEN format('{:.2f} ms', s * 1000.0) WHEN s < 60 THEN format('{:.2f} s', s)
       ELSE format('{}m {:.2f}s', CAST(floor(s / 60.0) AS BIGINT), s - floor(s / 60.0) * 60.0) END AS duration,
  format('{:.3f} ({}{:.3f}, {}{:.2f}%)', s, CASE WHEN d >= 0 THEN '+' ELSE '' END, d,
         CASE WHEN d >= 0 THEN '+' ELSE '' END, d / 8.0) AS comparison
FROM (SELECT event_id, event_type, event_id % 3000 / 16.0 AS s, (event_id % 41 - 20) / 16.0 AS d FROM events)""")
def q_run_texts(spark, sf_dir):
    """Upper-case labels, durations and comparisons as text."""
    e = read_table(spark, sf_dir, "events").select(
        "event_id", "event_type", (F.col("event_id") % 3000 / F.lit(16.0)).alias("s"),
        ((F.col("event_id") % 41 - 20) / F.lit(16.0)).alias("d"))
    return e.select("event_id", model_label("event_type").alias("label"), fmt_duration("s").alias("duration"),
                    fmt_comparison("s", "d", F.col("d") / 8.0).alias("comparison"))


@register("region_rate_job", _with(_labelled_ctes() + """,
a AS (SELECT *, (test_math + test_reading + test_science) / 3.0 >= 73 AND attendance_rate >= 0.85 AS region
      FROM labelled WHERE split = 'train')""", """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE region) AS n_region,
  count(*) FILTER (WHERE region AND pass_fail = 1) AS n_region_pass FROM a"""))
def q_region_job(spark, sf_dir):
    """The region rate that the profile job reports, over every row of its split."""
    import uuid

    from tallyho.plans import jobs
    from tallyho.sources import files
    base = scratch_path(spark, f"job-{uuid.uuid4().hex[:8]}")
    files.write_splits(labelled(spark, sf_dir), f"{base}/splits")
    out = jobs.profile_report(spark, f"{base}/splits", f"{base}/report")
    return out["region_rate"].select("n_rows", "n_region", "n_region_pass")


