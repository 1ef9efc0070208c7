"""Row-order operators without single-task windows.

First and last N rows per group come from the N-th order value (radix selection) and a
filter.  Forward fill and sliding windows need a dense ordinal per group.
A plain ``row_number().over(Window.partitionBy(g).orderBy(o))`` puts a whole
group into one task; here a group may hold a third of all rows, so ordinals are
built from a range partitioning instead (see ``with_sequence``): one range
shuffle, a sort inside partitions, stored (partition, position) pairs and a
tiny per-partition offset table.  Operators that need neighbours (forward
fill, sliding windows) then work in bounded chunks of consecutive ordinals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyho.operators.quantiles import nth_smallest
from tallyho.operators.stats import _by, join_small
from tallyho.session import materialize


ROWS_PER_PART = None          # None: use spark.sql.shuffle.partitions parts
MAX_OFFSET_ROWS = 10_000      # (group, part) offset rows broadcast after a size check; beyond: shuffle join


def _parts_for(df: DataFrame, rows_per_part: int | None, num_parts: int | None) -> int:
    if num_parts:
        return int(num_parts)
    if rows_per_part:
        return max(1, -(-df.count() // int(rows_per_part)))
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def with_sequence(df: DataFrame, by, order: Sequence[str | Column], seq_col: str = "_seq",
                  count_col: str | None = None, rows_per_part: int | None = ROWS_PER_PART,
                  num_parts: int | None = None) -> DataFrame:
    """Add a 0-based dense ordinal ``seq_col`` per ``by`` group ordered by ``order``.

    ``order`` must be a total order (end with a unique key).  One range
    shuffle on (group, order) -- Spark's range partitioner samples a bounded
    number of keys, so even one huge group is cut across many partitions -- and
    a sort inside each partition; each row records its partition id and
    position (``monotonically_increasing_id``) and this table is written once
    to the shared folder, so retries and later passes read fixed values.  A
    small table of per-(group, partition) counts gives every partition's start
    offset (running sum), joined back by a size-checked broadcast.  No window
    ever runs over the rows themselves.  With ``count_col`` the group size is
    added as well.  The number of partitions is ``spark.sql.shuffle.partitions``
    unless ``num_parts`` or ``rows_per_part`` says otherwise.
    """
    keys = _by(by)
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    n_parts = _parts_for(df, rows_per_part, num_parts)
    x = (df.repartitionByRange(n_parts, *[F.col(k) for k in keys], *order_cols)
         .sortWithinPartitions(*[F.col(k) for k in keys], *order_cols)
         .withColumn("_part", F.spark_partition_id())
         .withColumn("_pos", F.monotonically_increasing_id()))
    x = materialize(x)
    parts = x.groupBy(*keys, "_part").agg(F.min("_pos").alias("_first"),
                                          F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*keys).orderBy("_part")
    offsets = parts.select(
        *keys, "_part", "_first",
        F.coalesce(F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
        *([F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding,
                                            Window.unboundedFollowing)).alias(count_col)]
          if count_col else []))
    out = join_small(x, offsets, [*keys, "_part"], max_rows=MAX_OFFSET_ROWS)
    out = out.withColumn(seq_col, (F.col("_pos") - F.col("_first") + F.col("_off")).cast("bigint"))
    return out.drop("_part", "_pos", "_first", "_off")


def _sort_value(df: DataFrame, name: str) -> Column | None:
    """A double that grows with the column (NULL first, NaN with +infinity), None where there is none."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        c = F.unix_date(c)
    elif not isinstance(kind, (T.NumericType, T.BooleanType)):
        return None
    v = c.cast("double")
    return F.coalesce(F.when(F.isnan(v), F.lit(float("inf"))).otherwise(v), F.lit(float("-inf")))


def _first_rows(df: DataFrame, limit: Column, keys: list[str], order: Sequence[str], descending: bool) -> DataFrame:
    """The first ``limit`` rows of each group without sorting or moving the table.

    The value of the first order column at the limit is found per group by radix selection
    on that column alone; rows before it are kept by a filter, and only rows that tie
    with it are ranked by the whole order.  Without a numeric first column the rows are
    ranked by a window, which Spark limits inside each task before the shuffle.
    """
    by_order = [F.desc(o) if descending else F.asc(o) for o in order]
    window = Window.partitionBy(*keys).orderBy(*by_order)
    v = _sort_value(df, order[0])
    if v is None:
        ranked = df.withColumn("_rank", F.row_number().over(window))
        return ranked.where(F.col("_rank") <= limit).drop("_rank")
    v = -v if descending else v
    cut = nth_smallest(df, v, limit, keys)
    x = join_small(df.withColumn("_sort", v), cut, keys, "left").where(limit > 0)
    before = x.where(F.col("_cut").isNull() | (F.col("_sort") < F.col("_cut")))
    held = before.where(F.col("_cut").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_held"))
    ties = join_small(x.where(F.col("_sort") == F.col("_cut")), held, keys, "left")
    ties = ties.withColumn("_rank", F.row_number().over(window)).where(
        F.col("_rank") <= limit - F.coalesce("_held", F.lit(0)))
    return before.select(*df.columns).unionByName(ties.select(*df.columns))


def head_rows(df: DataFrame, limits: int | dict[str, int], by="split",
              order: Sequence[str] = ("row_ix",)) -> DataFrame:
    """First N rows of each group in ``order`` (L1/L5); N may differ per group value.

    With a dict, groups that it does not name are left out.
    """
    keys = _by(by)
    if isinstance(limits, dict):
        if len(keys) != 1:
            raise ValueError("per-group limits need exactly one group column")
        lim = F.lit(0).cast("bigint")
        for value, n in limits.items():
            lim = F.when(F.col(keys[0]).eqNullSafe(F.lit(value)), F.lit(int(n)).cast("bigint")).otherwise(lim)
    else:
        lim = F.lit(int(limits)).cast("bigint")
    if not keys:
        return df.orderBy(*order).limit(int(limits))
    return _first_rows(df, lim, keys, list(order), descending=False)


def tail_rows(df: DataFrame, n: int, by=None, order: Sequence[str] = ("row_ix",)) -> DataFrame:
    """Last ``n`` rows of each group in ``order``."""
    keys = _by(by)
    if not keys:
        return df.orderBy(*[F.desc(o) for o in order]).limit(int(n))
    return _first_rows(df, F.lit(int(n)).cast("bigint"), keys, list(order), descending=True)


def fill_forward(df: DataFrame, columns: Sequence[str] | None = None, by=None,
                 order: Sequence[str] = ("row_ix",), chunk_rows: int = 1_000_000,
                 rows_per_part: int | None = ROWS_PER_PART) -> DataFrame:
    """Replace each NULL by the last earlier non-NULL value in row order.

    Two phases: rows are cut into chunks of ``chunk_rows`` consecutive ordinals;
    a window fills inside each chunk (bounded size), and a per-chunk table of
    "last non-null value" (one row per chunk) carries values across chunk
    boundaries.  Leading NULLs stay NULL.
    """
    keys = _by(by)
    skip = set(keys) | set(order)
    cols = [c for c in (columns or df.columns) if c not in skip]
    seq = with_sequence(df, keys, list(order), "_seq", rows_per_part=rows_per_part)
    seq = seq.withColumn("_chunk", F.floor(F.col("_seq") / F.lit(int(chunk_rows))))
    inner = (Window.partitionBy(*keys, "_chunk").orderBy("_seq")
             .rowsBetween(Window.unboundedPreceding, 0))
    local = seq.select(*[F.col(c) for c in seq.columns if c not in cols],
                       *[F.last(F.col(c), ignorenulls=True).over(inner).alias(c) for c in cols])
    lasts = seq.groupBy(*keys, "_chunk").agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_seq"))).alias(c) for c in cols])
    before = (Window.partitionBy(*keys).orderBy("_chunk")
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = lasts.select(*keys, "_chunk",
                         *[F.last(F.col(c), ignorenulls=True).over(before).alias("_carry_" + c)
                           for c in cols])
    out = join_small(local, carry, [*keys, "_chunk"], "left")
    out = out.select(*[F.coalesce(F.col(c), F.col("_carry_" + c)).alias(c) if c in cols
                       else F.col(c) for c in df.columns])
    return out


def rolling_window(df: DataFrame, n: int, by, order: Sequence[str], aggs: dict[str, Column],
                   chunk_rows: int = 100_000, rows_per_part: int | None = ROWS_PER_PART,
                   extra_running: bool = False) -> DataFrame:
    """Evaluate window aggregates over the last ``n`` rows (inclusive) per group.

    ``aggs`` maps output name -> aggregate expression (evaluated over the frame
    ``ROWS BETWEEN n-1 PRECEDING AND CURRENT ROW``).  Groups are cut into chunks
    of ``chunk_rows`` ordinals; the last ``n-1`` rows of each chunk are copied
    into the next chunk as a halo so every frame is complete inside one chunk.
    Adds ``seq`` (0-based ordinal in the group).
    """
    keys = _by(by)
    if chunk_rows < n:
        chunk_rows = n
    seq = with_sequence(df, keys, list(order), "seq", rows_per_part=rows_per_part)
    seq = seq.withColumn("_chunk", F.floor(F.col("seq") / F.lit(int(chunk_rows))))
    halo = (seq.where(F.col("seq") % F.lit(int(chunk_rows)) >= F.lit(int(chunk_rows - (n - 1))))
            .withColumn("_chunk", F.col("_chunk") + 1).withColumn("_halo", F.lit(True)))
    both = seq.withColumn("_halo", F.lit(False)).unionByName(halo)
    w = (Window.partitionBy(*keys, "_chunk").orderBy("seq").rowsBetween(-(n - 1), 0))
    out = both.select(*[F.col(c) for c in both.columns],
                      *[e.over(w).alias(name) for name, e in aggs.items()])
    return out.where(~F.col("_halo")).drop("_halo", "_chunk")
