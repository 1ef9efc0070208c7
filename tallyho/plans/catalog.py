"""Driver catalogue: one Spark query per operator and its DuckDB oracle SQL.

Each query takes ``(spark, sf_dir)`` and reads the driver tables (or the
``students`` view over ``orders``) in full.  Every computed double is rounded to
6 decimals in both engines so that summation-order noise does not matter.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyho import spec
from tallyho.operators import clean, explain, label, metrics, ordered, profile, select
from tallyho.sources.tables import read_table, students, students_oracle_cte

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


# ----------------------------------------------------------------------------- shared chains

def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1 chain on the student view, per split: types -> ranges -> categories -> drop."""
    return clean.clean_split(students(spark, sf_dir), by="split")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.label_rule(cleaned(spark, sf_dir))


# ----------------------------------------------------------------------------- oracle fragments

STUDENT_COLUMNS = ["row_ix", "student_id", "split", "age_raw", "grade", "ses_quartile",
                   "internet_access", "extracurricular", "part_time_job", "parent_support",
                   "romantic", "free_time", "go_out", "parental_education", "school_type",
                   "locale", "gender", "race", "attendance_rate", "study_hours", "gpa",
                   "test_math", "test_reading", "test_science"]
CLEAN_COLUMNS = [("age" if c == "age_raw" else c) for c in STUDENT_COLUMNS]


def _students_cte() -> str:
    return f"students AS ({students_oracle_cte()})"


def _mode_sql(src: str, cols: list[str], out: str) -> str:
    """CTE ``out`` with (split, col, v): the per-split mode (count desc, value asc)."""
    on = ", ".join(cols)
    return f"""{out}_long AS (UNPIVOT {src} ON {on} INTO NAME col VALUE v),
{out}_cnt AS (SELECT split, col, v, count(*) AS n FROM {out}_long WHERE v IS NOT NULL GROUP BY split, col, v),
{out} AS (SELECT split, col, v FROM (SELECT *, row_number() OVER (PARTITION BY split, col ORDER BY n DESC, v ASC) AS rk
          FROM {out}_cnt) WHERE rk = 1)"""


def _coerced_ctes() -> str:
    parsed = []
    for c in spec.INT_COLUMNS:
        src = "age_raw" if c == "age" else c
        expr = f"TRY_CAST(trim({src}) AS DOUBLE)" if c == "age" else f"CAST({src} AS DOUBLE)"
        parsed.append(f"{expr} AS {c}")
    parsed_sql = ", ".join(parsed)
    sel = []
    for c in CLEAN_COLUMNS:
        if c in spec.INT_COLUMNS:
            sel.append(f"CAST(trunc(COALESCE(p.{c}, (SELECT v FROM int_mode m WHERE m.split = s.split "
                       f"AND m.col = '{c}'), 0.0)) AS BIGINT) AS {c}")
        else:
            sel.append(f"s.{c}")
    return f"""{_students_cte()},
p AS (SELECT row_ix, split, {parsed_sql} FROM students),
p_vals AS (SELECT split, {", ".join(spec.INT_COLUMNS)} FROM p),
{_mode_sql("p_vals", spec.INT_COLUMNS, "int_mode")},
coerced AS (SELECT {", ".join(sel)} FROM students s JOIN p ON s.row_ix = p.row_ix)"""


def _clip_expr(c: str, src: str = "") -> str:
    lo, hi = spec.RANGES[c]
    return f"CASE WHEN {src}{c} < {lo} THEN {lo} WHEN {src}{c} > {hi} THEN {hi} ELSE {src}{c} END"


def _clipped_ctes() -> str:
    sel = []
    for c in CLEAN_COLUMNS:
        if c in spec.RANGES:
            cast = "BIGINT" if c in spec.INT_COLUMNS else "DOUBLE"
            sel.append(f"CAST({_clip_expr(c)} AS {cast}) AS {c}")
        else:
            sel.append(c)
    return f"""{_coerced_ctes()},
clipped AS (SELECT {", ".join(sel)} FROM coerced)"""


def _repaired_ctes(src_ctes: str | None = None, src: str = "clipped", out: str = "repaired",
                   cols: list[str] | None = None) -> str:
    cats = list(spec.DOMAINS)
    cols = cols or CLEAN_COLUMNS
    sel = []
    for c in cols:
        if c in spec.DOMAINS:
            dom = ", ".join(f"'{v}'" for v in spec.DOMAINS[c])
            sel.append(f"CASE WHEN {c} IN ({dom}) THEN {c} ELSE COALESCE((SELECT v FROM cat_mode m "
                       f"WHERE m.split = x.split AND m.col = '{c}'), '{spec.DOMAINS[c][0]}') END AS {c}")
        else:
            sel.append(c)
    return f"""{src_ctes or _clipped_ctes()},
cat_vals AS (SELECT split, {", ".join(cats)} FROM {src}),
{_mode_sql("cat_vals", cats, "cat_mode")},
{out} AS (SELECT {", ".join(sel)} FROM {src} x)"""


def _cleaned_ctes() -> str:
    crit = [c for c in spec.CRITICAL_COLUMNS if c in CLEAN_COLUMNS]
    cond = " AND ".join(f"{c} IS NOT NULL" for c in dict.fromkeys(crit))
    return f"""{_repaired_ctes()},
cleaned AS (SELECT * FROM repaired WHERE {cond})"""


LABEL_SQL = ("CAST(COALESCE(gpa >= 2.0 AND (test_math + test_reading + test_science) / 3.0 >= 73, false) "
             "AS INTEGER)")


def _labelled_ctes() -> str:
    return f"""{_cleaned_ctes()},
labelled AS (SELECT *, {LABEL_SQL} AS pass_fail FROM cleaned)"""


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"


# ============================================================================= queries
# --- minimum slice -------------------------------------------------------------------

@register("clip_label_distribution", _with(
    f"""{_students_cte()},
l AS (SELECT split, CAST(COALESCE({_clip_expr('gpa')} >= 2.0
        AND (test_math + test_reading + test_science) / 3.0 >= 73, false) AS INTEGER) AS pass_fail FROM students)""",
    """SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE pass_fail = 1) AS n_pass,
       count(*) FILTER (WHERE pass_fail = 0) AS n_fail,
       round(COALESCE(count(*) FILTER (WHERE pass_fail = 1) / count(*), 0.0), 6) AS pass_rate
FROM l GROUP BY split"""))
def q_clip_label_distribution(spark, sf_dir):
    s = clean.clip_ranges(students(spark, sf_dir))
    return round_doubles(profile.label_distribution(label.label_rule(s), by="split"))


# --- cleaning ---------------------------------------------------------------------

@register("coerce_types", _with(_coerced_ctes(),
          f"SELECT row_ix, split, {', '.join(spec.INT_COLUMNS)} FROM coerced"))
def q_coerce_types(spark, sf_dir):
    s = clean.coerce_types(students(spark, sf_dir), by="split")
    return s.select("row_ix", "split", *spec.INT_COLUMNS)


def _clip_report_sql() -> str:
    parts = []
    for c, (lo, hi) in spec.RANGES.items():
        parts.append(f"SELECT split, '{c}' AS column, count(*) FILTER (WHERE {c} < {lo}) AS n_below, "
                     f"count(*) FILTER (WHERE {c} > {hi}) AS n_above FROM coerced GROUP BY split")
    return _with(_coerced_ctes(), "\nUNION ALL\n".join(parts))


@register("clip_report", _clip_report_sql())
def q_clip_report(spark, sf_dir):
    s = clean.coerce_types(students(spark, sf_dir), by="split")
    return clean.clip_report(s, by="split")


@register("clip_ranges", _with(_clipped_ctes(),
          f"SELECT row_ix, split, {', '.join(spec.RANGES)} FROM clipped"))
def q_clip_ranges(spark, sf_dir):
    s = clean.clip_ranges(clean.coerce_types(students(spark, sf_dir), by="split"))
    return s.select("row_ix", "split", *spec.RANGES)


@register("repair_domain", _with(
    _repaired_ctes(f"{_students_cte()}", "students", "repaired", STUDENT_COLUMNS),
    f"SELECT row_ix, split, {', '.join(spec.DOMAINS)} FROM repaired"))
def q_repair_domain(spark, sf_dir):
    s = clean.repair_domain(students(spark, sf_dir), by="split")
    return s.select("row_ix", "split", *spec.DOMAINS)


@register("clean_chain", _with(_cleaned_ctes(), "SELECT * FROM cleaned"))
def q_clean_chain(spark, sf_dir):
    return cleaned(spark, sf_dir)


def _null_census_sql() -> str:
    cols = [c for c in STUDENT_COLUMNS if c != "split"]
    parts = [f"SELECT split, '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS n_null "
             f"FROM students GROUP BY split" for c in cols]
    return _with(_students_cte(), "SELECT * FROM (" + "\nUNION ALL\n".join(parts) + ") WHERE n_null > 0")


@register("null_census", _null_census_sql())
def q_null_census(spark, sf_dir):
    return clean.null_census(students(spark, sf_dir), by="split")


FILL_COLUMNS = ["age_raw", "ses_quartile", "parental_education", "attendance_rate", "gpa", "test_science"]


@register("fill_forward", _with(_students_cte(), "SELECT row_ix, split, " + ", ".join(
    f"last_value({c} IGNORE NULLS) OVER (PARTITION BY split ORDER BY row_ix "
    f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in FILL_COLUMNS) + " FROM students"))
def q_fill_forward(spark, sf_dir):
    s = students(spark, sf_dir).select("row_ix", "split", *FILL_COLUMNS)
    # Small chunks so that the cross-chunk carry is exercised at this scale.
    return clean_fill_forward(s)


def clean_fill_forward(s: DataFrame) -> DataFrame:
    return ordered.fill_forward(s, FILL_COLUMNS, by="split", order=["row_ix"], chunk_rows=997,
                                rows_per_part=5_000)


NUM_FILL = ["ses_quartile", "attendance_rate", "gpa", "test_science"]


def _fill_sql(fn: str) -> str:
    stats = ", ".join(f"{fn}({c}) AS {c}_fill" for c in NUM_FILL)
    sel = ", ".join(f"COALESCE(CAST(s.{c} AS DOUBLE), round(f.{c}_fill, 6)) AS {c}" for c in NUM_FILL)
    return _with(f"{_students_cte()}, f AS (SELECT split, {stats} FROM students GROUP BY split)",
                 f"SELECT s.row_ix, s.split, {sel} FROM students s JOIN f ON s.split = f.split")


def _round_filled(spark, sf_dir, op):
    s = students(spark, sf_dir).select("row_ix", "split", *NUM_FILL,
                                       *[F.col(c).alias("_o_" + c) for c in NUM_FILL])
    x = op(s, NUM_FILL, by="split")
    return x.select("row_ix", "split", *[
        F.when(F.col("_o_" + c).isNull(), F.round(c, 6)).otherwise(F.col(c)).alias(c) for c in NUM_FILL])


@register("fill_mean", _fill_sql("avg"))
def q_fill_mean(spark, sf_dir):
    return _round_filled(spark, sf_dir, clean.fill_mean)


@register("fill_median", _fill_sql("median"))
def q_fill_median(spark, sf_dir):
    return _round_filled(spark, sf_dir, clean.fill_median)


# --- labelling ---------------------------------------------------------------------

@register("label_rule", _with(_labelled_ctes(),
          "SELECT row_ix, split, round((test_math + test_reading + test_science) / 3.0, 6) AS avg_test_score, "
          "pass_fail FROM labelled"))
def q_label_rule(spark, sf_dir):
    x = label.label_rule(cleaned(spark, sf_dir), keep_avg=True)
    return round_doubles(x.select("row_ix", "split", spec.AVG_SCORE, spec.TARGET))


@register("label_distribution", _with(_labelled_ctes(), """
SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE pass_fail = 1) AS n_pass,
       count(*) FILTER (WHERE pass_fail = 0) AS n_fail,
       round(COALESCE(count(*) FILTER (WHERE pass_fail = 1) / count(*), 0.0), 6) AS pass_rate
FROM labelled GROUP BY split"""))
def q_label_distribution(spark, sf_dir):
    return round_doubles(profile.label_distribution(labelled(spark, sf_dir), by="split"))


@register("condition_breakdown", _with(_labelled_ctes() + """,
a AS (SELECT *, (test_math + test_reading + test_science) / 3.0 AS avg,
      CAST(COALESCE(gpa < 2.0, false) AS INTEGER)
      + CAST(COALESCE((test_math + test_reading + test_science) / 3.0 < 73, false) AS INTEGER) AS nf FROM labelled)""",
    """SELECT split,
  count(*) FILTER (WHERE pass_fail = 1 AND gpa >= 2.0) AS pass_gpa_ok,
  count(*) FILTER (WHERE pass_fail = 1 AND avg >= 73) AS pass_avg_ok,
  count(*) FILTER (WHERE pass_fail = 0 AND gpa < 2.0) AS fail_gpa_low,
  count(*) FILTER (WHERE pass_fail = 0 AND avg < 73) AS fail_avg_low,
  count(*) FILTER (WHERE pass_fail = 0 AND nf = 0) AS fail_0_conditions,
  count(*) FILTER (WHERE pass_fail = 0 AND nf = 1) AS fail_1_condition,
  count(*) FILTER (WHERE pass_fail = 0 AND nf = 2) AS fail_2_conditions
FROM a GROUP BY split"""))
def q_condition_breakdown(spark, sf_dir):
    return profile.condition_breakdown(labelled(spark, sf_dir), by="split")


# --- duplicates, limits, projections ----------------------------------------------------

_NON_IX = [c for c in STUDENT_COLUMNS if c != "row_ix"]


@register("duplicate_report", _with(f"""{_students_cte()},
g AS (SELECT split, count(*) AS n FROM students GROUP BY {", ".join(_NON_IX)})""",
    "SELECT split, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, "
    "CAST(sum(n) - count(*) AS BIGINT) AS n_duplicates FROM g GROUP BY split"))
def q_duplicate_report(spark, sf_dir):
    return clean.duplicate_report(students(spark, sf_dir), by="split")


@register("dedup_first", _with(_students_cte(),
    f"SELECT min(row_ix) AS row_ix, {', '.join(_NON_IX)} FROM students GROUP BY ALL"))
def q_dedup_first(spark, sf_dir):
    return clean.dedup_first(students(spark, sf_dir))


SMALL_HEAD_LIMITS = {"train": 10_000, "validation": 1_000, "test": 3_000}


@register("head_rows", _with(_cleaned_ctes(), """
SELECT row_ix, split FROM (SELECT row_ix, split, row_number() OVER (PARTITION BY split ORDER BY row_ix) AS rn
FROM cleaned) WHERE rn <= CASE split WHEN 'train' THEN 10000 WHEN 'validation' THEN 1000 ELSE 3000 END"""))
def q_head_rows(spark, sf_dir):
    x = ordered.head_rows(cleaned(spark, sf_dir), SMALL_HEAD_LIMITS, by="split", order=["row_ix"])
    return x.select("row_ix", "split")


_MODEL_COLS = [c for c in CLEAN_COLUMNS if c not in spec.LEAKAGE_COLUMNS + spec.PROTECTED_COLUMNS]


@register("select_features", _with(_labelled_ctes(), f"SELECT {', '.join(_MODEL_COLS)} FROM labelled"))
def q_select_features(spark, sf_dir):
    return select.select_features(labelled(spark, sf_dir), mode="model")


@register("union_splits", _with(_students_cte(), "SELECT row_ix, split, gpa FROM students"))
def q_union_splits(spark, sf_dir):
    s = students(spark, sf_dir)
    frames = {name: s.where(F.col("split") == name).select("row_ix", "gpa")
              for name in ("train", "validation", "test")}
    return select.union_splits(frames)


@register("sample_n", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 500""")
def q_sample_n(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return select.sample_n(o, 500, key="o_orderkey", seed=spec.SEED)


# --- profiling --------------------------------------------------------------------------

LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]
STUDENT_NUMERIC = [c for c in CLEAN_COLUMNS if c not in ("row_ix", "split", "age_raw")
                   and c not in spec.DOMAINS and c not in ("gender", "race")]


def _iqr_sql(ctes: str | None, table: str, cols: list[str], by: str | None) -> str:
    g = f"{by}, " if by else ""
    gb = f"GROUP BY {by}" if by else ""
    join_on = f"USING ({by})" if by else "ON true"
    parts = []
    for c in cols:
        parts.append(f"""SELECT {g}'{c}' AS column, round(q1, 6) AS q1, round(q3, 6) AS q3,
  round(q1 - 1.5 * (q3 - q1), 6) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 6) AS upper_bound,
  count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers,
  round(count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count(*) * 100.0, 6)
    AS pct_outliers
FROM {table} JOIN (SELECT {g}quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {table} {gb}) qs
  {join_on} GROUP BY {g}q1, q3""")
    body = "SELECT * FROM (" + "\nUNION ALL\n".join(parts) + ") WHERE n_outliers > 0"
    return _with(ctes, body) if ctes else body


@register("iqr_outliers", _iqr_sql(None, "lineitem", LINEITEM_NUMERIC, None))
def q_iqr_outliers(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return round_doubles(profile.iqr_outliers(li, LINEITEM_NUMERIC))


@register("iqr_outliers_students", _iqr_sql(_labelled_ctes(), "labelled", STUDENT_NUMERIC, "split"))
def q_iqr_outliers_students(spark, sf_dir):
    return round_doubles(profile.iqr_outliers(labelled(spark, sf_dir), by="split"))


EVENT_NUMERIC = ["value", "user_id"]


@register("iqr_outliers_events", _iqr_sql(None, "events", EVENT_NUMERIC, "event_type"))
def q_iqr_outliers_events(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return round_doubles(profile.iqr_outliers(ev, EVENT_NUMERIC, by="event_type"))


def _threshold_sql() -> str:
    parts = []
    for v, t in spec.THRESHOLDS.items():
        parts.append(f"""SELECT '{v}' AS variable, CAST({float(t)} AS DOUBLE) AS threshold, round(avg({v}), 6) AS mean,
  round(median({v}), 6) AS median, round(stddev_samp({v}), 6) AS std, round(min({v}), 6) AS min,
  round(max({v}), 6) AS max, count(*) FILTER (WHERE {v} >= {t}) AS n_above,
  count(*) FILTER (WHERE {v} < {t}) AS n_below,
  round(count(*) FILTER (WHERE {v} >= {t}) * 100.0 / count(*), 6) AS pct_above,
  round(count(*) FILTER (WHERE {v} < {t}) * 100.0 / count(*), 6) AS pct_below FROM a""")
    return _with(_labelled_ctes() + ",\na AS (SELECT *, (test_math + test_reading + test_science) / 3.0 "
                 "AS avg_test_score FROM labelled)", "\nUNION ALL\n".join(parts))


@register("threshold_profile", _threshold_sql())
def q_threshold_profile(spark, sf_dir):
    return round_doubles(profile.threshold_profile(labelled(spark, sf_dir)))


@register("class_profile", _with(_labelled_ctes() + ",\na AS (SELECT *, (test_math + test_reading + "
                                 "test_science) / 3.0 AS avg_test_score FROM labelled)", """
SELECT pass_fail, count(*) AS n_rows, round(avg(gpa), 6) AS gpa_mean, round(median(gpa), 6) AS gpa_median,
  round(avg(avg_test_score), 6) AS avg_test_score_mean, round(median(avg_test_score), 6) AS avg_test_score_median
FROM a GROUP BY pass_fail"""))
def q_class_profile(spark, sf_dir):
    return round_doubles(profile.class_profile(labelled(spark, sf_dir)))


@register("dataset_report", _with(_labelled_ctes(), f"""
SELECT count(*) AS total_rows, CAST({len(CLEAN_COLUMNS) + 1} AS BIGINT) AS total_columns,
  count(*) FILTER (WHERE pass_fail = 1) AS pass_count, count(*) FILTER (WHERE pass_fail = 0) AS fail_count,
  round(count(*) FILTER (WHERE pass_fail = 1) * 100.0 / count(*), 6) AS pass_percentage,
  round(count(*) FILTER (WHERE pass_fail = 0) * 100.0 / count(*), 6) AS fail_percentage FROM labelled"""))
def q_dataset_report(spark, sf_dir):
    return round_doubles(profile.dataset_report(labelled(spark, sf_dir)))


@register("region_rate", _with(_labelled_ctes() + """,
a AS (SELECT *, (test_math + test_reading + test_science) / 3.0 >= 73 AND attendance_rate >= 0.85 AS region
      FROM labelled)""", """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE region) AS n_region,
  count(*) FILTER (WHERE region AND pass_fail = 1) AS n_region_pass,
  round(count(*) FILTER (WHERE region) * 100.0 / count(*), 6) AS pct_region,
  round(count(*) FILTER (WHERE region AND pass_fail = 1) * 100.0 / NULLIF(count(*) FILTER (WHERE region), 0), 6)
    AS pct_region_pass FROM a"""))
def q_region_rate(spark, sf_dir):
    return round_doubles(profile.region_rate(labelled(spark, sf_dir)))


def _hist_sql(ctes: str | None, table: str, col: str, by: str | None, density: bool) -> str:
    g = f"{by}, " if by else ""
    gb = f"GROUP BY {by}" if by else ""
    on = f"b.{by} = st.{by} AND " if by else ""
    dens = (", round(COALESCE(c, 0) / (n * ((hi - lo) / 50.0)), 6) AS density" if density else "")
    frag = f"""s0 AS (SELECT {g}min({col}) AS lo0, max({col}) AS hi0, count(*) AS n FROM {table}
       WHERE {col} IS NOT NULL {gb}),
st AS (SELECT {g}n, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
       CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM s0),
b AS (SELECT {"t." + by + ", " if by else ""}CAST(least(floor((CAST({col} AS DOUBLE) - lo) * 50.0 / (hi - lo)), 49) AS INTEGER) AS bin,
       count(*) AS c FROM {table} t JOIN st ON {"t." + by + " = st." + by if by else "true"}
       WHERE {col} IS NOT NULL GROUP BY ALL),
gr AS (SELECT st.*, CAST(i AS INTEGER) AS bin FROM st, range(0, 50) r(i))"""
    body = f"""SELECT {"gr." + by + ", " if by else ""}gr.bin, round(lo + gr.bin * ((hi - lo) / 50.0), 6) AS bin_lo,
  round(lo + (gr.bin + 1) * ((hi - lo) / 50.0), 6) AS bin_hi, CAST(COALESCE(c, 0) AS BIGINT) AS count{dens}
FROM gr LEFT JOIN b ON {on.replace("st.", "gr.")}b.bin = gr.bin"""
    return _with((ctes + ",\n" if ctes else "") + frag, body)


@register("histogram", _hist_sql(None, "orders", "o_totalprice", None, False))
def q_histogram(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    return round_doubles(profile.histogram(o, "o_totalprice", 50))


@register("histogram_density", _hist_sql(_labelled_ctes(), "labelled", "gpa", "pass_fail", True))
def q_histogram_density(spark, sf_dir):
    return round_doubles(profile.histogram(labelled(spark, sf_dir), "gpa", 50, by="pass_fail", density=True))


@register("kde", _with(_labelled_ctes() + """,
base AS (SELECT pass_fail AS g, gpa AS v FROM labelled WHERE gpa IS NOT NULL),
st AS (SELECT g, count(*) AS n, stddev_samp(v) AS sd, min(v) AS lo, max(v) AS hi FROM base GROUP BY g),
tot AS (SELECT count(*) AS total FROM base),
st2 AS (SELECT st.*, total, sd * pow(CAST(n AS DOUBLE), -0.2) AS bw FROM st, tot),
grid AS (SELECT g, n, total, bw, CAST(i AS INTEGER) AS grid_ix,
         (lo - 3.0 * bw) + i * ((hi - lo + 6.0 * bw) / 199.0) AS x FROM st2, range(0, 200) r(i) WHERE bw > 0),
vals AS (SELECT g, v, count(*) AS w FROM base GROUP BY g, v),
s AS (SELECT grid.g, grid_ix, sum(w * exp(-0.5 * ((x - v) / bw) * ((x - v) / bw))) AS s
      FROM grid JOIN vals ON grid.g = vals.g GROUP BY grid.g, grid_ix)""", """
SELECT grid.g AS pass_fail, grid.grid_ix, round(x, 6) AS x,
  round(COALESCE(s.s, 0.0) / (CAST(total AS DOUBLE) * bw * sqrt(2 * pi())), 6) AS density
FROM grid LEFT JOIN s ON grid.g = s.g AND grid.grid_ix = s.grid_ix"""))
def q_kde(spark, sf_dir):
    return round_doubles(profile.kde(labelled(spark, sf_dir), "gpa", by=spec.TARGET))


# --- model metrics on labels ----------------------------------------------------------------

def _labels_pred(spark, sf_dir):
    lab = read_table(spark, sf_dir, "labels")
    return lab.select("doc_id", F.col("quality").alias("y_true"), (1 - F.col("toxic")).alias("y_pred"))


_METRIC_SELECT = """tn, fp, fn, tp, tn + fp + fn + tp AS n,
  round(COALESCE((tp + tn) / NULLIF(tn + fp + fn + tp, 0), 0.0), 6) AS accuracy,
  round(COALESCE(tp / NULLIF(tp + fp, 0), 0.0), 6) AS precision,
  round(COALESCE(tp / NULLIF(tp + fn, 0), 0.0), 6) AS recall,
  round(COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0.0), 6) AS f1,
  round(COALESCE((tp + fn) / NULLIF(tn + fp + fn + tp, 0), 0.0), 6) AS actual_positive_rate,
  round(COALESCE((tp + fp) / NULLIF(tn + fp + fn + tp, 0), 0.0), 6) AS predicted_positive_rate"""
_CELLS = """count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp,
  count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp"""


@register("binary_metrics", f"""
WITH p AS (SELECT quality AS y_true, 1 - toxic AS y_pred FROM labels),
c AS (SELECT {_CELLS} FROM p)
SELECT {_METRIC_SELECT} FROM c""")
def q_binary_metrics(spark, sf_dir):
    return round_doubles(metrics.binary_metrics(_labels_pred(spark, sf_dir)))


@register("class_weights", """
SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1) AS n_pos, count(*) FILTER (WHERE quality = 0) AS n_neg,
  round(CASE WHEN count(*) FILTER (WHERE quality = 1) = 0 THEN 1.0
        ELSE count(*) FILTER (WHERE quality = 0) / count(*) FILTER (WHERE quality = 1) END, 6) AS imbalance_ratio,
  round(count(*) / NULLIF(2.0 * count(*) FILTER (WHERE quality = 1), 0), 6) AS weight_pos,
  round(count(*) / NULLIF(2.0 * count(*) FILTER (WHERE quality = 0), 0), 6) AS weight_neg FROM labels""")
def q_class_weights(spark, sf_dir):
    return round_doubles(metrics.class_weights(read_table(spark, sf_dir, "labels"), y="quality"))


# Candidate "models" derived from the labels table, in training order.
CANDIDATES = [("not_toxic", "1 - toxic"), ("always_pass", "1"), ("always_fail", "0"), ("toxic", "toxic")]


@register("select_best", "WITH p AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, {i} AS train_order, quality AS y_true, CAST({e} AS INTEGER) AS y_pred FROM labels"
    for i, (m, e) in enumerate(CANDIDATES)) + f"""),
c AS (SELECT model, train_order, {_CELLS} FROM p GROUP BY model, train_order),
f AS (SELECT model, train_order, COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0.0) AS f1 FROM c)
SELECT model AS best_model, round(f1, 6) AS best_f1 FROM f ORDER BY f1 DESC, train_order LIMIT 1""")
def q_select_best(spark, sf_dir):
    lab = read_table(spark, sf_dir, "labels")
    preds = lab.select(F.col("quality").alias("y_true"), *[
        F.expr(e).cast("int").alias(m) for m, e in CANDIDATES])
    long = preds.unpivot(["y_true"], [m for m, _ in CANDIDATES], "model", "y_pred")
    order = F.create_map(*[x for i, (m, _) in enumerate(CANDIDATES) for x in (F.lit(m), F.lit(i))])
    long = long.withColumn("train_order", order[F.col("model")])
    scored = metrics.binary_metrics(long, by=["model", "train_order"])
    return round_doubles(metrics.select_best(scored))


@register("align_predictions", f"""
WITH p AS (SELECT d.lang, l.quality AS y_true, 1 - l.toxic AS y_pred FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
c AS (SELECT lang, {_CELLS} FROM p GROUP BY lang)
SELECT lang, {_METRIC_SELECT} FROM c""")
def q_align_predictions(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang")
    pairs = metrics.align_predictions(docs, _labels_pred(spark, sf_dir), "doc_id")
    return round_doubles(metrics.binary_metrics(pairs, by="lang"))


# --- service metrics on events -------------------------------------------------------------

ERROR_SQL = "event_type = 'error'"


def _events(spark, sf_dir):
    return read_table(spark, sf_dir, "events")


def _is_error():
    return F.col("event_type") == F.lit("error")


_LAT = "CASE WHEN value > 0 THEN value END"


@register("latency_profile", f"""
SELECT event_type, count({_LAT}) AS n_valid, round(COALESCE(avg({_LAT}), 0.0), 6) AS avg_latency_ms,
  round(COALESCE(quantile_cont({_LAT}, 0.5), 0.0), 6) AS median_latency_ms,
  round(COALESCE(min({_LAT}), 0.0), 6) AS min_latency_ms, round(COALESCE(max({_LAT}), 0.0), 6) AS max_latency_ms,
  round(COALESCE(quantile_cont({_LAT}, 0.5), 0.0), 6) AS p50_latency_ms,
  round(COALESCE(quantile_cont({_LAT}, 0.95), 0.0), 6) AS p95_latency_ms,
  round(COALESCE(quantile_cont({_LAT}, 0.99), 0.0), 6) AS p99_latency_ms
FROM events GROUP BY event_type""")
def q_latency_profile(spark, sf_dir):
    return round_doubles(metrics.latency_profile(_events(spark, sf_dir), "value", by="event_type"))


def _exact_half_even(sql: str) -> str:
    """Let ``round_even`` see all decimals of the double: on a DOUBLE it rounds the scaled product, which may be off."""
    exact = r"CAST(round_even(CAST(format('{:.24f}', CAST(\1 AS DOUBLE)) AS DECIMAL(38, 24)), \2) AS DOUBLE) AS"
    return re.sub(r"round_even\((.*), (\d)\) AS", exact, sql)


def _run_metrics_sql(extra: str = "") -> str:
    g = f", {extra}" if extra else ""
    wall = "(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6"
    return _exact_half_even(f"""SELECT event_type AS label, strftime(max(ts), '%Y%m%d_%H%M%S') AS timestamp,
  count(*) AS n_requests, count(*) FILTER (WHERE {ERROR_SQL}) AS n_errors,
  round_even(count(*) FILTER (WHERE {ERROR_SQL}) / count(*), 4) AS error_rate,
  round_even({wall}, 3) AS total_execution_time_sec,
  round_even({wall} * 1000.0, 2) AS total_execution_time_ms,
  round_even(COALESCE(min({_LAT}), 0.0), 3) AS min_latency_ms,
  round_even(COALESCE(avg({_LAT}), 0.0), 3) AS avg_latency_ms,
  round_even(COALESCE(quantile_cont({_LAT}, 0.5), 0.0), 3) AS median_latency_ms,
  round_even(COALESCE(quantile_cont({_LAT}, 0.5), 0.0), 3) AS p50_latency_ms,
  round_even(COALESCE(quantile_cont({_LAT}, 0.95), 0.0), 3) AS p95_latency_ms,
  round_even(COALESCE(quantile_cont({_LAT}, 0.99), 0.0), 3) AS p99_latency_ms,
  round_even(COALESCE(max({_LAT}), 0.0), 3) AS max_latency_ms,
  round_even(CASE WHEN {wall} > 0 THEN count({_LAT}) / ({wall}) ELSE 0.0 END, 2) AS throughput_req_per_sec,
  CAST(NULL AS DOUBLE) AS accuracy,
  round_even((count(*) - count(*) FILTER (WHERE {ERROR_SQL})) / count(*), 4) AS success_rate,
  round_even((count(*) - count(*) FILTER (WHERE {ERROR_SQL})) / count(*) * 100.0, 2) AS reliability_percent{g}
FROM events GROUP BY event_type{g}""")


@register("run_metrics", _run_metrics_sql())
def q_run_metrics(spark, sf_dir):
    return metrics.run_metrics(_events(spark, sf_dir), label="event_type", latency="value", ts="ts",
                               error=_is_error())


def runs_table(spark, sf_dir) -> DataFrame:
    """Benchmark records per (event_type, day) run, derived from the events log."""
    e = _events(spark, sf_dir).withColumn("run_day", F.to_date("ts"))
    r = metrics.run_metrics(e, label="event_type", latency="value", ts="ts", error=_is_error(),
                            keys=["run_day"])
    return r.drop("run_day")


_RUNS_SQL = ("runs AS (" + _run_metrics_sql("CAST(ts AS DATE)").replace(
    ", CAST(ts AS DATE)\nFROM", "\nFROM") + ")")


@register("latest_run", f"""WITH {_RUNS_SQL}
SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY label ORDER BY timestamp DESC) = 1""")
def q_latest_run(spark, sf_dir):
    return metrics.latest_run(runs_table(spark, sf_dir))


def _compare_sql(base: str, other: str) -> str:
    ms = metrics.COMPARED_METRICS
    unp = ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in ms)
    points = ", ".join(f"'{m}'" for m in spec.POINT_METRICS)
    lower = ", ".join(f"'{m}'" for m in metrics.LOWER_IS_BETTER)
    return f"""WITH {_RUNS_SQL},
latest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY label ORDER BY timestamp DESC) = 1),
w AS (SELECT label, {unp} FROM latest WHERE label IN ('{base}', '{other}')),
l AS (SELECT * FROM w UNPIVOT INCLUDE NULLS (value FOR metric IN ({", ".join(ms)}))),
j AS (SELECT b.metric, b.value AS base_value, o.value AS other_value FROM
      (SELECT * FROM l WHERE label = '{base}') b FULL JOIN (SELECT * FROM l WHERE label = '{other}') o
      ON b.metric = o.metric),
d AS (SELECT *, CASE WHEN base_value = 0 THEN 0.0 ELSE other_value - base_value END AS abs_diff,
      CASE WHEN base_value = 0 THEN 0.0 WHEN metric IN ({points}) THEN other_value - base_value
           ELSE (other_value - base_value) / base_value * 100.0 END AS pct_diff FROM j)
SELECT metric, base_value, other_value, round(abs_diff, 6) AS abs_diff, round(pct_diff, 6) AS pct_diff,
  base_value = 0 AS base_zero,
  CASE WHEN base_value IS NULL OR other_value IS NULL THEN NULL
       WHEN abs(other_value - base_value) < CASE WHEN metric = 'accuracy' THEN 0.001 ELSE 0.0 END OR other_value = base_value THEN 'equivalent'
       WHEN (metric IN ({lower})) = (other_value < base_value) THEN 'better' ELSE 'worse' END AS verdict
FROM d"""


@register("compare_runs", _compare_sql("click", "view"))
def q_compare_runs(spark, sf_dir):
    c = metrics.compare_runs(runs_table(spark, sf_dir), "click", "view")
    return round_doubles(c.drop("display").withColumn("abs_diff", F.round("abs_diff", 6))
                         .withColumn("pct_diff", F.round("pct_diff", 6)), 12)


@register("rolling_latency", """
WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS lat FROM events),
w AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS request_count,
        count(*) OVER win AS window_n,
        CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER win AS BIGINT) AS error_count,
        avg(CASE WHEN lat > 0 THEN lat END) OVER win AS a,
        quantile_cont(CASE WHEN lat > 0 THEN lat END, 0.95) OVER win AS p95,
        quantile_cont(CASE WHEN lat > 0 THEN lat END, 0.99) OVER win AS p99,
        min(ts) OVER () AS t0
      FROM e WINDOW win AS (ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
SELECT event_id, ts, user_id, event_type, value, props, request_count,
  round((epoch_us(ts) - epoch_us(t0)) / 1e6, 6) AS uptime_sec, window_n,
  window_n - error_count AS success_count, error_count,
  round((window_n - error_count) / window_n, 6) AS success_rate,
  round(COALESCE(a, 0.0), 6) AS avg_latency, round(COALESCE(p95, 0.0), 6) AS p95_latency,
  round(COALESCE(p99, 0.0), 6) AS p99_latency FROM w""")
def q_rolling_latency(spark, sf_dir):
    r = metrics.rolling_latency(_events(spark, sf_dir), n=100, by=None, order=["ts", "event_id"],
                                latency="value", error=_is_error())
    computed = ["uptime_sec", "success_rate", "avg_latency", "p95_latency", "p99_latency"]
    return r.select(*[F.round(c, 6).alias(c) if c in computed else F.col(c) for c in r.columns])


@register("tail_summary", """
WITH t AS (SELECT *, event_type = 'error' AS err FROM events ORDER BY ts DESC, event_id DESC LIMIT 100),
v AS (SELECT *, CASE WHEN NOT err AND value > 0 THEN value END AS lat FROM t)
SELECT count(*) AS n_window, count(*) FILTER (WHERE NOT err) AS n_success, count(*) FILTER (WHERE err) AS n_errors,
  round(COALESCE(avg(lat), 0.0), 6) AS avg_latency, round(COALESCE(quantile_cont(lat, 0.5), 0.0), 6) AS p50_latency,
  round(COALESCE(quantile_cont(lat, 0.95), 0.0), 6) AS p95_latency,
  round(COALESCE(quantile_cont(lat, 0.99), 0.0), 6) AS p99_latency,
  round(COALESCE(min(lat), 0.0), 6) AS min_latency, round(COALESCE(max(lat), 0.0), 6) AS max_latency,
  round(count(*) FILTER (WHERE NOT err) / count(*), 6) AS success_rate FROM v""")
def q_tail_summary(spark, sf_dir):
    return round_doubles(metrics.tail_summary(_events(spark, sf_dir), n=100, order=["ts", "event_id"],
                                              latency="value", error=_is_error()))


# --- attributions on embeddings ---------------------------------------------------------------

EMB_SLOTS = 64
EMB_PER_BASE = 8
EMB_BASES = [f"e{b}" for b in range(EMB_SLOTS // EMB_PER_BASE)]


@register("top_factors", """
WITH u AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings),
m AS (SELECT vec_id, (i - 1) // 8 AS b, avg(CAST(v AS DOUBLE)) AS impact FROM u GROUP BY vec_id, b),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(impact) DESC, b) AS rk FROM m)
SELECT vec_id, CAST(rk AS INTEGER) AS rank, 'e' || CAST(b AS VARCHAR) AS feature, round(impact, 6) AS impact,
  CASE WHEN impact >= 0 THEN 'positive' ELSE 'negative' END AS direction,
  CASE WHEN impact >= 0 THEN 'Increases pass probability' ELSE 'Decreases pass probability' END AS description
FROM r WHERE rk <= 3""")
def q_top_factors(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    slot_base = [i // EMB_PER_BASE for i in range(EMB_SLOTS)]
    x = explain.rollup_attributions(emb, "embedding", slot_base, EMB_BASES)
    x = explain.top_factors(x, k=spec.TOP_FACTORS)
    return round_doubles(explain.explode_factors(x, ["vec_id"]))


@register("rollup_attributions", """
WITH u AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings)
SELECT vec_id, 'e' || CAST((i - 1) // 8 AS VARCHAR) AS feature, round(avg(CAST(v AS DOUBLE)), 6) AS impact
FROM u GROUP BY vec_id, (i - 1) // 8""")
def q_rollup_attributions(spark, sf_dir):
    emb = read_table(spark, sf_dir, "embeddings")
    slot_base = [i // EMB_PER_BASE for i in range(EMB_SLOTS)]
    x = explain.rollup_attributions(emb, "embedding", slot_base, EMB_BASES)
    x = x.select("vec_id", F.explode("attributions").alias("a"))
    return x.select("vec_id", "a.feature", F.round("a.impact", 6).alias("impact"))


# --- contract, conditions, payloads, prompts, completions --------------------------------------

def _requests(spark, sf_dir) -> DataFrame:
    """Request rows from the raw student view: age as sent (text), GPA as ``actual_gpa``."""
    s = students(spark, sf_dir)
    return s.select("row_ix", F.col("age_raw").alias("age"), *[c for c in spec.CONTRACT_FIELDS if c != "age"],
                    F.col("gpa").alias("actual_gpa"))


def _contract_sql(optional: bool = True) -> str:
    checks = []
    for f, (typ, lo, hi) in {**spec.CONTRACT_FIELDS, **(spec.OPTIONAL_CONTRACT_FIELDS if optional else {})}.items():
        src = {"age": "age_raw", "actual_gpa": "gpa"}.get(f, f)
        required = f in spec.CONTRACT_FIELDS
        if required:
            checks.append(f"CASE WHEN {src} IS NULL THEN '{f}:missing' END")
        if typ in ("int", "float"):
            num = f"TRY_CAST(trim({src}) AS DOUBLE)" if f == "age" else f"CAST({src} AS DOUBLE)"
            if f == "age":
                checks.append(f"CASE WHEN {src} IS NOT NULL AND {num} IS NULL THEN '{f}:type' END")
                checks.append(f"CASE WHEN {num} IS NOT NULL AND {num} <> floor({num}) THEN '{f}:type' END")
            if lo is not None:
                checks.append(f"CASE WHEN {num} < {lo} THEN '{f}:below' END")
            if hi is not None:
                checks.append(f"CASE WHEN {num} > {hi} THEN '{f}:above' END")
    lst = f"list_filter([{', '.join(checks)}], lambda x: x IS NOT NULL)"
    return _with(_students_cte() + f",\nv AS (SELECT row_ix, {lst} AS vs FROM students)",
                 "SELECT row_ix, array_to_string(vs, ',') AS violations, CAST(len(vs) AS INTEGER) AS n_violations, "
                 "len(vs) = 0 AS is_valid FROM v")


@register("validate_contract", _contract_sql())
def q_validate_contract(spark, sf_dir):
    from tallyho.operators.contract import validate_contract
    v = validate_contract(_requests(spark, sf_dir))
    return v.select("row_ix", F.array_join("violations", ",").alias("violations"),
                    F.size("violations").alias("n_violations"), "is_valid")


@register("failed_conditions", _with(_labelled_ctes() + """,
c AS (SELECT row_ix, pass_fail, COALESCE(attendance_rate < 0.85, false) AS a, COALESCE(study_hours < 2.0, false) AS t,
      COALESCE(attendance_rate < 0.80 OR study_hours < 1.5, false) AS g FROM labelled)""", """
SELECT row_ix, CASE WHEN pass_fail = 0 THEN g END AS fc_gpa,
  CASE WHEN pass_fail = 0 THEN t OR NOT (a OR t OR g) END AS fc_test_score,
  CASE WHEN pass_fail = 0 THEN a OR NOT (a OR t OR g) END AS fc_attendance FROM c"""))
def q_failed_conditions(spark, sf_dir):
    x = label.failed_conditions(labelled(spark, sf_dir), label_col=spec.TARGET)
    m = F.col("failed_conditions")
    return x.select("row_ix", m["gpa"].alias("fc_gpa"), m["test_score"].alias("fc_test_score"),
                    m["attendance"].alias("fc_attendance"))


_PAYLOAD_COLS = [c for c in CLEAN_COLUMNS if c not in
                 ["row_ix", *spec.LEAKAGE_COLUMNS, *spec.PROTECTED_COLUMNS, spec.TARGET]]


@register("to_payload_json", _with(_cleaned_ctes(), "SELECT row_ix, CAST(to_json({" + ", ".join(
    f"'{c}': {c}" for c in _PAYLOAD_COLS) + "}) AS VARCHAR) AS payload FROM cleaned"))
def q_to_payload_json(spark, sf_dir):
    return select.to_payload_json(cleaned(spark, sf_dir))


def _prompt_sql() -> str:
    from tallyho.operators.prompts import java_format

    def sq(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def prof(note: str) -> str:
        fmt, names = java_format(spec.PROFILE_BLOCK)
        vals = {
            "age": "COALESCE(CAST(age AS VARCHAR), 'N/A')", "grade": "COALESCE(CAST(grade AS VARCHAR), 'N/A')",
            "attendance_pct": "printf('%.1f', COALESCE(attendance_rate, 0.0) * 100.0)",
            "attendance_note": sq(note), "study_hours": "printf('%.1f', COALESCE(study_hours, 0.0))",
            "free_time": "COALESCE(CAST(free_time AS VARCHAR), 'N/A')",
            "go_out": "COALESCE(CAST(go_out AS VARCHAR), 'N/A')",
            "ses_quartile": "COALESCE(CAST(ses_quartile AS VARCHAR), 'N/A')",
        }
        for c in ("extracurricular", "part_time_job", "parent_support", "internet_access"):
            vals[c] = f"CASE WHEN {c} = 1 THEN 'Yes' ELSE 'No' END"
        for c in ("parental_education", "school_type", "locale"):
            vals[c] = f"COALESCE({c}, 'N/A')"
        return f"printf({sq(fmt)}, {', '.join(vals[n] for n in names)})"

    ct = spec.CONDITION_TEXTS
    items = (f"list_filter([CASE WHEN g THEN {sq(ct['gpa'])} END, CASE WHEN t OR NOT (a OR t OR g) THEN "
             f"{sq(ct['test_score'])} END, CASE WHEN a OR NOT (a OR t OR g) THEN {sq(ct['attendance'])} END], "
             "lambda x: x IS NOT NULL)")
    cond = (f"CASE WHEN len({items}) = 0 THEN {sq(spec.NO_CONDITION_TEXT)} ELSE "
            f"{sq(spec.CONDITION_HEADER)} || array_to_string({items}, chr(10) || '- ') END")
    fmt_r, names_r = java_format(spec.AT_RISK_TEMPLATE)
    fmt_g, names_g = java_format(spec.GOOD_STANDING_TEMPLATE)
    risk_vals = {"profile": prof(spec.AT_RISK_ATTENDANCE_NOTE), "conditions": cond, "factors": "''"}
    good_vals = {"profile": prof(spec.GOOD_STANDING_ATTENDANCE_NOTE), "factors": "''"}
    risk = f"printf({sq(fmt_r)}, {', '.join(risk_vals[n] for n in names_r)})"
    good = f"printf({sq(fmt_g)}, {', '.join(good_vals[n] for n in names_g)})"
    return _with(_labelled_ctes() + """,
c AS (SELECT *, COALESCE(attendance_rate < 0.85, false) AS a, COALESCE(study_hours < 2.0, false) AS t,
      COALESCE(attendance_rate < 0.80 OR study_hours < 1.5, false) AS g FROM labelled)""", f"""
SELECT row_ix, CASE WHEN pass_fail = 0 THEN 'at_risk' ELSE 'good_standing' END AS route,
  CASE WHEN pass_fail = 0 THEN {sq(spec.AT_RISK_SYSTEM)} ELSE {sq(spec.GOOD_STANDING_SYSTEM)} END AS system_prompt,
  CASE WHEN pass_fail = 0 THEN {risk} ELSE {good} END AS prompt,
  CASE WHEN pass_fail = 0 THEN {spec.AT_RISK_MAX_TOKENS} ELSE {spec.GOOD_STANDING_MAX_TOKENS} END AS max_tokens,
  CAST({spec.TEMPERATURE} AS DOUBLE) AS temperature FROM c""")


@register("build_prompts", _prompt_sql())
def q_build_prompts(spark, sf_dir):
    from tallyho.operators.prompts import build_prompts
    return build_prompts(labelled(spark, sf_dir), label_col=spec.TARGET)


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


@register("parse_completions", f"""
WITH t AS (SELECT conv_id, turn, {_strip_sql('text')} AS content FROM conversations WHERE role = 'assistant'),
i AS (SELECT *, CASE WHEN content LIKE '%```json%' THEN {_strip_sql("split_part(split_part(content, '```json', 2), '```', 1)")}
                     WHEN content LIKE '%```%' THEN {_strip_sql("split_part(content, '```', 2)")}
                     ELSE content END AS inner_text FROM t),
s AS (SELECT *, CASE WHEN length(content) = 0 THEN 'fallback_error'
                     WHEN NOT json_valid(inner_text) THEN 'fallback_invalid_json'
                     WHEN json_type(inner_text, '$.recommendations') IS DISTINCT FROM 'ARRAY' THEN 'fallback_error'
                     ELSE 'ok' END AS status FROM i)
SELECT conv_id, turn, status,
  CASE status WHEN 'fallback_invalid_json' THEN 'Focus on consistent attendance and dedicated study time.'
              WHEN 'fallback_error' THEN 'Seek support from academic advisors and teachers.'
              ELSE COALESCE(json_extract_string(inner_text, '$.summary'), 'Focus on improving the areas identified above.')
  END AS summary,
  CASE WHEN status = 'ok' THEN CAST(json_array_length(inner_text, '$.recommendations') AS INTEGER) ELSE 1 END
    AS n_recommendations
FROM s""")
def q_parse_completions(spark, sf_dir):
    from tallyho.operators.prompts import parse_completions
    conv = read_table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    p = parse_completions(conv.select("conv_id", "turn", F.col("text").alias("completion")))
    return p.select("conv_id", "turn", "status", "summary", F.size("recommendations").alias("n_recommendations"))


def _sql_text(v) -> str:
    return "'" + str(v).replace("'", "''") + "'"


def _explode_recs_sql() -> str:
    parse = ORACLE["parse_completions"]
    ctes = parse[:parse.index("SELECT conv_id, turn, status,")].rstrip()
    has_keys = " AND ".join(f"json_exists(x, '$.{k}')" for k in spec.RECOMMENDATION_KEYS)
    fallback = []
    for status, fb in (("fallback_invalid_json", spec.FALLBACK_INVALID_JSON),
                       ("fallback_error", spec.FALLBACK_OTHER)):
        fallback.append(f"""SELECT conv_id, turn, status, 1 AS position, CAST({fb['priority']} AS BIGINT) AS priority,
  {_sql_text(fb['category'])} AS category, {_sql_text(fb['action'])} AS action, {_sql_text(fb['reason'])} AS reason,
  {_sql_text(fb['timeline'])} AS timeline FROM s WHERE status = '{status}'""")
    return f"""{ctes},
ok AS (SELECT conv_id, turn, status,
  list_filter(CAST(json_extract(inner_text, '$.recommendations') AS JSON[]), lambda x: {has_keys}) AS recs
  FROM s WHERE status = 'ok'),
okx AS (SELECT conv_id, turn, status, generate_subscripts(recs, 1) AS position, unnest(recs) AS r FROM ok),
recs AS (
SELECT conv_id, turn, status, CAST(position AS INTEGER) AS position,
  TRY_CAST(json_extract(r, '$.priority') AS BIGINT) AS priority, json_extract_string(r, '$.category') AS category,
  json_extract_string(r, '$.action') AS action, json_extract_string(r, '$.reason') AS reason,
  json_extract_string(r, '$.timeline') AS timeline FROM okx
UNION ALL
{chr(10).join(["UNION ALL" + chr(10) + f if i else f for i, f in enumerate(fallback)])})
SELECT *, CAST((CASE WHEN priority IS NULL OR priority < 1 OR priority > 5 THEN 1 ELSE 0 END)
  + (category IS NULL)::INT + (action IS NULL)::INT + (reason IS NULL)::INT + (timeline IS NULL)::INT AS INTEGER)
  AS n_violations FROM recs"""


@register("explode_recommendations", _explode_recs_sql())
def q_explode_recommendations(spark, sf_dir):
    from tallyho.operators.prompts import explode_recommendations, parse_completions
    conv = read_table(spark, sf_dir, "conversations").where(F.col("role") == "assistant")
    p = parse_completions(conv.select("conv_id", "turn", F.col("text").alias("completion")))
    x = explode_recommendations(p, ["conv_id", "turn"])
    return x.select("conv_id", "turn", "status", F.col("position").cast("int").alias("position"),
                    *spec.RECOMMENDATION_KEYS, F.size("violations").cast("int").alias("n_violations"))


# --- supervised learning (no SQL twin: row-count checks only) -------------------------------------

def _splits(spark, sf_dir):
    """Labelled train / validation / test, written once: iterative fits then
    read the cut lineage instead of re-running the cleaning chain per pass."""
    from tallyho.session import materialize
    lab = materialize(labelled(spark, sf_dir))
    return [lab.where(F.col("split") == s) for s in ("train", "validation", "test")]


def _together(splits: list[DataFrame]) -> DataFrame:
    """The rows of all splits, read as they are written: the cleaning chain runs once."""
    return reduce(DataFrame.unionByName, splits)


def fit_logistic_model(spark, sf_dir):
    """(model, train, test): the balanced logistic model on the train split."""
    from pyspark.ml import Pipeline

    from tallyho.operators.features import build_preprocessor
    from tallyho.operators.metrics import add_class_weight
    from tallyho.operators.models import logistic
    train, _, test = _splits(spark, sf_dir)
    train = add_class_weight(train, spec.TARGET, "balanced")
    n = train.count()
    model = Pipeline(stages=[*build_preprocessor(train), logistic(n)]).fit(train)
    return model, train, test


@register("score_logistic")
def q_score_logistic(spark, sf_dir):
    """Every row of every split scored by the model of the train split."""
    from tallyho.operators.models import score
    model, _, _ = fit_logistic_model(spark, sf_dir)
    return score(model, labelled(spark, sf_dir)).select("row_ix", spec.TARGET, "pass_prob", "prediction")


@register("train_suite")
def q_train_suite(spark, sf_dir):
    from tallyho.operators.models import train_suite
    train, val, test = _splits(spark, sf_dir)
    return train_suite(train, val, test).table


@register("score_explain")
def q_score_explain(spark, sf_dir):
    """Q4 as a batch: contract -> score -> failed conditions -> attributions -> prompts."""
    from tallyho.operators.contract import validate_contract
    from tallyho.operators.models import explain, score
    from tallyho.operators.prompts import build_prompts
    model, train, _ = fit_logistic_model(spark, sf_dir)
    checked = validate_contract(labelled(spark, sf_dir)).where(F.col("is_valid"))
    scored = score(model, checked).drop("features")
    scored = label.failed_conditions(scored, label_col="prediction")
    explained = explain(model, scored.drop(*[c for c in scored.columns if c.endswith(("__idx", "__ohe"))
                                             or c.startswith("_num_")]), train)
    prompts = build_prompts(explained, label_col="prediction", factors_col="top_factors",
                            conditions_col="failed_conditions",
                            keep=("row_ix", "pass_prob", "prediction", "failed_conditions"))
    factors = explained.select("row_ix", F.to_json("top_factors").alias("top_factors"))
    return prompts.join(factors, "row_ix").withColumn("failed_conditions", F.to_json("failed_conditions"))


# --- streaming ----------------------------------------------------------------------------------

def run_stream_to_table(spark, stream_df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drive a streaming plan to completion (``availableNow``) into a parquet
    table under the shared checkpoint folder and read it back."""
    import uuid

    from tallyho.session import scratch_path
    base = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:8]}")
    q = (stream_df.writeStream.format("parquet").outputMode(mode)
         .option("checkpointLocation", base + "/_checkpoint").option("path", base + "/data")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(base + "/data")


def time_slices(events: DataFrame, base: str, batches: int = 4) -> None:
    """Write the events as ``batches`` files in time order, one after the other, for a file stream to read one by one."""
    cuts = events.agg(F.percentile_approx("ts", [i / batches for i in range(1, batches)], 10_000).alias("c")).first()["c"]
    edges = [None, *sorted(set(cuts or [])), None]
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        part = events if lo is None else events.where(F.col("ts") >= F.lit(lo))
        part = part if hi is None else part.where(F.col("ts") < F.lit(hi))
        part.coalesce(1).write.mode("overwrite").parquet(f"{base}/slice{i}")


@register("stream_rolling_latency", ORACLE["rolling_latency"].replace(
    "ORDER BY ts, event_id", "PARTITION BY event_type ORDER BY ts, event_id").replace(
    "min(ts) OVER ()", "min(ts) OVER (PARTITION BY event_type)"))
def q_stream_rolling_latency(spark, sf_dir):
    """K1 per event type over several micro-batches, the windows reaching across them."""
    import uuid

    from tallyho.session import scratch_path
    from tallyho.streaming.rolling import stream_rolling_latency_table
    base = scratch_path(spark, f"k1-{uuid.uuid4().hex[:8]}")
    events = read_table(spark, sf_dir, "events")
    time_slices(events, f"{base}/events")
    stream = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(f"{base}/events"))
    q = stream_rolling_latency_table(stream, f"{base}/out", f"{base}/_checkpoint", n=100, key="event_type",
                                     error=F.col("event_type") == F.lit("error"))
    q.awaitTermination()
    r = spark.read.parquet(f"{base}/out/data").drop("epoch")
    computed = ["uptime_sec", "success_rate", "avg_latency", "p95_latency", "p99_latency"]
    return r.select(*[F.round(c, 6).alias(c) if c in computed else F.col(c) for c in r.columns])


@register("stream_score")
def q_stream_score(spark, sf_dir):
    """K2: requests streamed from ``orders`` through the student view, contract
    check, scoring by a batch-trained model, accepted and rejected sinks."""
    import uuid

    from tallyho.session import scratch_path
    from tallyho.sources.tables import STUDENTS_SQL, table_path
    from tallyho.streaming.scoring import stream_score
    model, _, _ = fit_logistic_model(spark, sf_dir)
    schema = spark.read.parquet(table_path(sf_dir, "orders")).schema
    view = f"orders_stream_{uuid.uuid4().hex[:8]}"
    (spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
     .createOrReplaceTempView(view))
    req = spark.sql(STUDENTS_SQL.format(orders=view)).select(
        "row_ix", F.col("age_raw").alias("age"), *[c for c in spec.CONTRACT_FIELDS if c != "age"])
    base = scratch_path(spark, f"k2-{uuid.uuid4().hex[:8]}")
    q = stream_score(model, req, base + "/accepted", base + "/rejected", base + "/_checkpoint")
    q.awaitTermination()
    ok = spark.read.parquet(base + "/accepted").select(
        "row_ix", F.lit("accepted").alias("status"), "prediction", "pass_prob",
        F.lit(0).alias("n_violations"))
    bad = spark.read.parquet(base + "/rejected").select(
        "row_ix", F.lit("rejected").alias("status"), F.lit(None).cast("int").alias("prediction"),
        F.lit(None).cast("double").alias("pass_prob"), F.size("violations").alias("n_violations"))
    return ok.unionByName(bad)


@register("stream_score_counts", f"""
SELECT CASE WHEN is_valid THEN 'accepted' ELSE 'rejected' END AS status, count(*) AS n,
  CAST(sum(n_violations) AS BIGINT) AS n_violations, count(*) FILTER (is_valid) AS scored
FROM ({_contract_sql(optional=False)}) GROUP BY 1""")
def q_stream_score_counts(spark, sf_dir):
    """K2: what the two sinks hold after the stream: rows, violations, and rows with a probability and its label."""
    scored = F.col("prediction") == (F.col("pass_prob") >= spec.PROB_THRESHOLD).cast("int")
    return q_stream_score(spark, sf_dir).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_violations").cast("bigint").alias("n_violations"), F.count_if(scored).alias("scored"))


@register("explain_trees")
def q_explain_trees(spark, sf_dir):
    """M12 for a boosted model of 200 trees: top-3 Shapley attributions of every row."""
    from pyspark.ml import Pipeline

    from tallyho.operators.features import build_preprocessor
    from tallyho.operators.models import second_order
    from tallyho.operators.tree_explain import explain_trees
    parts = _splits(spark, sf_dir)
    train = parts[0].withColumn("weight", F.lit(1.0))
    model = Pipeline(stages=[*build_preprocessor(train), second_order()]).fit(train)
    x = explain_trees(model, _together(parts), ["row_ix"])
    from tallyho.operators.explain import explode_factors
    return explode_factors(x, ["row_ix"])
