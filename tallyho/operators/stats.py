"""Column statistics as small DataFrames, and attaching them to rows.

Statistics are always computed by distributed aggregation (partial + final).  A
statistic table has one row per group of ``by`` (or exactly one row when ``by``
is empty); tables within a checked bound of rows are fetched to the driver and
broadcast, larger ones stay distributed.  Joins on group keys match NULL to
NULL, so the rows of a NULL group are a group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyho.session import materialize


def _by(by: str | Sequence[str] | None) -> list[str]:
    if by is None:
        return []
    return [by] if isinstance(by, str) else list(by)


def _value_counts(df: DataFrame, exprs: dict[str, Column], keys: list[str]) -> DataFrame:
    """Count per (group, column, value) for same-typed expressions, NULLs skipped.

    Unpivot is an Expand (no shuffle); the count has a map-side partial
    aggregation, so a value held by a third of all rows collapses to one row
    per task before the shuffle.
    """
    names = list(exprs)
    long = df.select(*keys, *[e.alias(n) for n, e in exprs.items()]).unpivot(
        keys, names, "_column", "_value")
    return (long.where(F.col("_value").isNotNull())
            .groupBy(*keys, "_column", "_value").agg(F.count(F.lit(1)).alias("_n")))


def _pick_modes(counts: DataFrame, names: list[str], keys: list[str], suffix: str,
                value_type) -> DataFrame:
    """One aggregate over the (small) count table: for every column the value
    with the highest count, ties to the smallest value (``min_by`` skips rows
    whose ordering is NULL, i.e. rows of other columns)."""
    aggs = []
    for n in names:
        mine = F.col("_column") == F.lit(n)
        order = F.when(mine, F.struct((-F.col("_n")).alias("n"), F.col("_value").alias("v")))
        aggs.append(F.min_by(F.when(mine, F.col("_value")), order).cast(value_type).alias(n + suffix))
    if keys:
        return counts.groupBy(*keys).agg(*aggs)
    # A global aggregate always yields one row (NULL modes for an empty input).
    return counts.groupBy().agg(*aggs)


def column_modes(df: DataFrame, exprs: dict[str, Column], by=None,
                 suffix: str = "") -> DataFrame:
    """Most frequent non-null value of each expression; ties go to the smallest value.

    ``exprs`` maps output name -> expression; all expressions must share one
    type.  Two aggregations: counts per (group, column, value), then one
    ``min_by`` per column over the small count table.
    """
    keys = _by(by)
    names = list(exprs)
    counts = _value_counts(df, exprs, keys)
    return _pick_modes(counts, names, keys, suffix, counts.schema["_value"].dataType)


def mixed_modes(df: DataFrame, numeric: dict[str, Column], text: dict[str, Column], by=None) -> DataFrame:
    """Modes of numeric (as DOUBLE) and text expressions in one job.

    Each kind is counted on its native type (cheaper to hash than a packed
    value); the two small count tables are combined with a join on the group
    keys (one row per group each).  Output: one row per group with
    ``<name>_mode`` columns.
    """
    keys = _by(by)
    parts = []
    if numeric:
        c = _value_counts(df, {n: e.cast("double") for n, e in numeric.items()}, keys)
        parts.append(_pick_modes(c, list(numeric), keys, "_mode", "double"))
    if text:
        c = _value_counts(df, {n: e.cast("string") for n, e in text.items()}, keys)
        parts.append(_pick_modes(c, list(text), keys, "_mode", "string"))
    out = parts[0]
    for p in parts[1:]:
        out = join_groups(out, p, keys, "full")
    return out


def column_aggs(df: DataFrame, aggs: dict[str, Column], by=None) -> DataFrame:
    """One aggregate row per group: ``{name: agg_expr}`` in a single pass."""
    keys = _by(by)
    return df.groupBy(*keys).agg(*[e.alias(n) for n, e in aggs.items()])


# Statistic tables up to this many rows are fetched once and broadcast from the
# driver (exactly what a broadcast exchange does); larger ones stay distributed.
MAX_LOCAL_STAT_ROWS = 10_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
                   broadcast: bool = False) -> DataFrame:
    """Equi-join on group keys in which NULL matches NULL; the keys of ``left`` are kept
    (for ``full`` either side's).  ``<=>`` stays a hash or sort-merge join in Spark."""
    keys = list(keys)
    r = right.select(*[F.col(k).alias("_rk_" + k) for k in keys],
                     *[F.col(c) for c in right.columns if c not in keys])
    cond = [F.col(k).eqNullSafe(F.col("_rk_" + k)) for k in keys]
    out = left.join(F.broadcast(r) if broadcast else r, cond, how)
    if how == "full":
        # A key is NULL either because the group is NULL or because the side has no row.
        out = out.withColumns({k: F.coalesce(F.col(k), F.col("_rk_" + k)) for k in keys})
    return out if how in ("left_semi", "left_anti") else out.drop(*["_rk_" + k for k in keys])


def join_small(df: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner",
               max_rows: int = MAX_LOCAL_STAT_ROWS) -> DataFrame:
    """Join a table expected to be small; broadcast it only after proving its size.

    One job fetches at most ``max_rows + 1`` rows.  Within the cap
    the rows become a driver-held relation that is broadcast (it also survives
    executor loss without recomputation).  Beyond the cap the table is
    checkpointed to the shared folder and joined by a regular shuffle join.
    """
    fixed, local = fix_small(small, max_rows)
    return null_safe_join(df, fixed, on, how, broadcast=local)


def fix_small(small: DataFrame, max_rows: int = MAX_LOCAL_STAT_ROWS) -> tuple[DataFrame, bool]:
    """Compute a table expected to be small exactly once.

    Returns ``(table, local)``: a driver-held relation when it has at most
    ``max_rows`` rows (one job fetches at most ``max_rows + 1``), else the table
    written to the shared folder.  Either way later uses (both sides of a
    plan, retries) read fixed values instead of re-running the upstream plan.
    """
    rows = small.limit(max_rows + 1).collect()
    if len(rows) <= max_rows:
        return small.sparkSession.createDataFrame(rows, small.schema), True
    return materialize(small), False


def attach_fixed(df: DataFrame, fixed: DataFrame, local: bool, keys: Sequence[str],
                 how: str = "inner") -> DataFrame:
    """Join a table fixed by ``fix_small``; with no keys it has at most one row
    and is attached as literals (no row at all: ``how='inner'`` keeps nothing)."""
    keys = list(keys)
    if keys:
        return null_safe_join(df, fixed, keys, how, broadcast=local)
    if fixed.limit(1).count() == 0:
        empty = df.where(F.lit(False))
        return empty.withColumns({f.name: F.lit(None).cast(f.dataType) for f in fixed.schema.fields}) \
            if how == "inner" else df.withColumns({f.name: F.lit(None).cast(f.dataType)
                                                   for f in fixed.schema.fields})
    return df.withColumns(one_row_values(fixed))


def _literal(value, data_type: T.DataType) -> Column:
    """A literal column of ``data_type`` holding a fetched Python value."""
    if value is None:
        return F.lit(None).cast(data_type)
    if isinstance(data_type, T.StructType):
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in data_type.fields])
    if isinstance(data_type, T.ArrayType):
        return F.array(*[_literal(v, data_type.elementType) for v in value]).cast(data_type)
    if isinstance(data_type, T.MapType):
        return F.create_map(*[c for k, v in value.items() for c in (
            _literal(k, data_type.keyType), _literal(v, data_type.valueType))]).cast(data_type)
    return F.lit(value).cast(data_type)


def one_row_values(stats: DataFrame) -> dict[str, Column]:
    """Fetch a one-row statistic table (a global aggregate) as literal columns.

    At most two rows are fetched to prove the bound; the values then enter
    the plan as constants (folded by Catalyst, no join at all).
    """
    rows = stats.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected a one-row statistic table, got {len(rows)} rows")
    return {f.name: _literal(rows[0][f.name], f.dataType) for f in stats.schema.fields}


def attach_stats(df: DataFrame, stats: DataFrame, by=None) -> DataFrame:
    """Join per-group statistics back onto the rows.

    With no ``by`` the statistics are one row and are attached as literal
    columns.  With ``by`` the size-checked ``join_small`` is used.
    """
    keys = _by(by)
    if not keys:
        return df.withColumns(one_row_values(stats))
    return join_small(df, stats, keys, "left")


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Combine two per-group statistic tables (one row per group each).

    Group keys match NULL to NULL.  With no keys both tables are one row and
    the right one is attached as literals.
    """
    keys = list(keys)
    if not keys:
        return left.withColumns(one_row_values(right))
    return null_safe_join(left, right, keys, how)
