"""Type, range and domain repair, imputation, missing-value handling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyho import spec
from tallyho.operators.quantiles import median_of
from tallyho.operators.stats import _by, attach_stats, column_aggs, column_modes, mixed_modes

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def parse_number(c: Column, dtype: T.DataType) -> Column:
    """Text or number -> DOUBLE; anything unparsable becomes NULL (F1)."""
    if isinstance(dtype, NUMERIC_TYPES):
        return c.cast("double")
    return F.trim(c.cast("string")).try_cast("double")


def coerce_types(df: DataFrame, columns: Sequence[str] = spec.INT_COLUMNS, by=None,
                 raw_suffix: str = "_raw") -> DataFrame:
    """Parse integer columns, fill missing by the column mode, truncate to BIGINT.

    A target column ``c`` is read from ``c`` or, if absent, ``c + raw_suffix``
    (which it then replaces in place).  The mode is the most frequent parsed
    value (ties -> smallest) per ``by`` group; a column with no value at all is
    filled with 0.  Truncation is toward zero.
    """
    keys = _by(by)
    sources = {}
    for c in columns:
        if c in df.columns:
            sources[c] = c
        elif c + raw_suffix in df.columns:
            sources[c] = c + raw_suffix
    if not sources:
        return df
    parsed = {c: parse_number(_q(s), df.schema[s].dataType) for c, s in sources.items()}
    modes = column_modes(df, parsed, by=keys, suffix="_mode")
    tmp = df.select("*", *[e.alias("_num_" + c) for c, e in parsed.items()])
    joined = attach_stats(tmp, modes, keys)
    out_cols = []
    src_to_target = {s: c for c, s in sources.items()}
    for name in df.columns:
        if name in src_to_target:
            c = src_to_target[name]
            filled = F.coalesce(F.col("_num_" + c), F.col(c + "_mode"), F.lit(0.0))
            out_cols.append(filled.try_cast("bigint").alias(c))
        else:
            out_cols.append(_q(name))
    return joined.select(*out_cols)


def fill_mode(df: DataFrame, columns: Sequence[str], by=None) -> DataFrame:
    """Fill NULLs of each column by its mode (ties -> smallest; none -> 0)."""
    return coerce_types(df, columns, by=by)


def clip_ranges(df: DataFrame, ranges: dict = spec.RANGES) -> DataFrame:
    """Clip each present column to its inclusive range; NULL stays NULL."""
    out = []
    for f in df.schema.fields:
        if f.name in ranges:
            lo, hi = ranges[f.name]
            c = _q(f.name)
            clipped = (F.when(c < F.lit(lo), F.lit(lo)).when(c > F.lit(hi), F.lit(hi))
                       .otherwise(c)).cast(f.dataType)
            out.append(clipped.alias(f.name))
        else:
            out.append(_q(f.name))
    return df.select(*out)


def clip_report(df: DataFrame, ranges: dict = spec.RANGES, by=None) -> DataFrame:
    """Count values below / above each range *before* clipping.

    One row per (group, column) with ``n_below``, ``n_above``.
    """
    keys = _by(by)
    present = [c for c in ranges if c in df.columns]
    aggs = {}
    for c in present:
        lo, hi = ranges[c]
        aggs[c] = F.struct(F.count_if(_q(c) < F.lit(lo)).alias("n_below"),
                           F.count_if(_q(c) > F.lit(hi)).alias("n_above"))
    wide = column_aggs(df, aggs, keys)
    long = wide.unpivot(keys, present, "column", "_r")
    return long.select(*keys, "column", F.col("_r.n_below").alias("n_below"),
                       F.col("_r.n_above").alias("n_above"))


def repair_domain(df: DataFrame, domains: dict = spec.DOMAINS, by=None,
                  valid_only: bool = False) -> DataFrame:
    """Replace values outside the domain (NULL included) by the column mode.

    The mode is taken over all non-null values, invalid ones included, so an
    invalid value that is the mode replaces itself; ``valid_only=True`` takes
    the mode over valid values only.  With no mode, the first domain value.
    """
    keys = _by(by)
    present = [c for c in domains if c in df.columns]
    if not present:
        return df
    exprs = {}
    for c in present:
        col = _q(c).cast("string")
        exprs[c] = F.when(col.isin(domains[c]), col) if valid_only else col
    modes = column_modes(df, exprs, by=keys, suffix="_mode")
    joined = attach_stats(df, modes, keys)
    out = []
    for name in df.columns:
        if name in present:
            c = _q(name)
            fixed = F.when(c.isin(domains[name]), c).otherwise(
                F.coalesce(F.col(name + "_mode"), F.lit(domains[name][0])))
            out.append(fixed.alias(name))
        else:
            out.append(_q(name))
    return joined.select(*out)


def drop_missing(df: DataFrame, columns: Sequence[str] = spec.CRITICAL_COLUMNS) -> DataFrame:
    """Drop rows with a NULL in any present critical column (P5)."""
    present = [c for c in columns if c in df.columns]
    return df.na.drop(subset=present) if present else df


def null_census(df: DataFrame, by=None, columns: Sequence[str] | None = None) -> DataFrame:
    """Per-column count of NULLs, non-zero columns only.

    One row per (group, column) with ``n_null``.
    """
    keys = _by(by)
    cols = [c for c in (columns or df.columns) if c not in keys]
    wide = column_aggs(df, {c: F.count_if(_q(c).isNull()) for c in cols}, keys)
    long = wide.unpivot(keys, cols, "column", "n_null")
    return long.where(F.col("n_null") > 0)


def _numeric_columns(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def _fill_with(df: DataFrame, agg, columns, by, exclude) -> DataFrame:
    keys = _by(by)
    cols = list(columns) if columns else _numeric_columns(df, list(exclude) + keys)
    stats = column_aggs(df, {c + "_fill": agg(_q(c).cast("double")) for c in cols}, keys)
    joined = attach_stats(df, stats, keys)
    out = [F.coalesce(_q(n).cast("double"), F.col(n + "_fill")).alias(n) if n in cols else _q(n)
           for n in df.columns]
    return joined.select(*out)


def fill_mean(df: DataFrame, columns=None, by=None, exclude=("row_ix",)) -> DataFrame:
    """Fill NULLs of numeric columns by the column mean; filled columns become DOUBLE."""
    return _fill_with(df, F.avg, columns, by, exclude)


def fill_median(df: DataFrame, columns=None, by=None, exclude=("row_ix",),
                approx: bool = False) -> DataFrame:
    """Fill NULLs of numeric columns by the exact median (mid-point of two).

    Medians come from ``quantiles.median_of`` (exact without a single-task
    merge); ``approx=True`` uses ``percentile_approx``.
    """
    keys = _by(by)
    cols = list(columns) if columns else _numeric_columns(df, list(exclude) + keys)
    stats = median_of(df, {c: _q(c) for c in cols}, keys, approx, suffix="_fill")
    joined = attach_stats(df, stats, keys)
    out = [F.coalesce(_q(n).cast("double"), _q(n + "_fill")).alias(n) if n in cols else _q(n)
           for n in df.columns]
    return joined.select(*out)


def with_stats(df: DataFrame, stats: DataFrame, by=None) -> DataFrame:
    """Apply a per-group (or one-row) statistic table to every row."""
    return attach_stats(df, stats, by)


def dedup_first(df: DataFrame, subset: Sequence[str] | None = None, order: str = "row_ix") -> DataFrame:
    """Keep the first occurrence (smallest ``order``) of each duplicate group.

    NULL equals NULL.  Expressed as an aggregation (partial + final), so a group
    of millions of copies collapses map-side instead of being sorted in one task.
    """
    keys = list(subset) if subset else [c for c in df.columns if c != order]
    others = [c for c in df.columns if c not in keys and c != order]
    if others:
        agg = F.min_by(F.struct(*[_q(c) for c in others]), _q(order)).alias("_first")
        out = df.groupBy(*[_q(k) for k in keys]).agg(F.min(_q(order)).alias(order), agg)
        out = out.select("*", "_first.*").drop("_first")
    else:
        out = df.groupBy(*[_q(k) for k in keys]).agg(F.min(_q(order)).alias(order))
    return out.select(*[_q(c) for c in df.columns])


def duplicate_report(df: DataFrame, by=None, exclude: Sequence[str] = ("row_ix",)) -> DataFrame:
    """Rows, distinct rows and duplicates (first occurrence not counted) per group (A4)."""
    keys = _by(by)
    cols = [c for c in df.columns if c not in exclude and c not in keys]
    per_row = df.groupBy(*keys, *[_q(c) for c in cols]).agg(F.count(F.lit(1)).alias("_n"))
    return per_row.groupBy(*keys).agg(
        F.sum("_n").cast("bigint").alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
        (F.sum("_n") - F.count(F.lit(1))).cast("bigint").alias("n_duplicates"))


def clean_split(df: DataFrame, by=None, int_columns: Sequence[str] = spec.INT_COLUMNS,
                ranges: dict = spec.RANGES, domains: dict = spec.DOMAINS,
                critical: Sequence[str] = spec.CRITICAL_COLUMNS, raw_suffix: str = "_raw",
                valid_only: bool = False) -> DataFrame:
    """The S1 cleaning chain, types -> ranges -> categories -> drop missing, with
    all of its statistics computed in one aggregation pass.

    Equal to ``drop_missing(repair_domain(clip_ranges(coerce_types(df))))``:
    the category modes only depend on the raw category values, which the
    type and range steps do not touch, so both kinds of mode can be taken
    from the input in a single job; the rest is one projection and a filter.
    """
    keys = _by(by)
    sources = {}
    for c in int_columns:
        if c in df.columns:
            sources[c] = c
        elif c + raw_suffix in df.columns:
            sources[c] = c + raw_suffix
    cats = [c for c in domains if c in df.columns]
    parsed = {c: parse_number(_q(s), df.schema[s].dataType) for c, s in sources.items()}
    text = {}
    for c in cats:
        col = _q(c).cast("string")
        text[c] = F.when(col.isin(domains[c]), col) if valid_only else col
    out = df
    if parsed or text:
        modes = mixed_modes(df, parsed, text, by=keys)
        tmp = df.select("*", *[e.alias("_num_" + c) for c, e in parsed.items()])
        joined = attach_stats(tmp, modes, keys)
        src_to_target = {s: c for c, s in sources.items()}
        cols = []
        for f in df.schema.fields:
            name = f.name
            if name in src_to_target:
                c = src_to_target[name]
                v = F.coalesce(F.col("_num_" + c), F.col(c + "_mode"), F.lit(0.0)).try_cast("bigint")
                cols.append(v.alias(c))
            elif name in text:
                c = _q(name)
                cols.append(F.when(c.isin(domains[name]), c).otherwise(
                    F.coalesce(F.col(name + "_mode"), F.lit(domains[name][0]))).alias(name))
            else:
                cols.append(_q(name))
        out = joined.select(*cols)
    return drop_missing(clip_ranges(out, ranges), critical)
