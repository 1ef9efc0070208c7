"""Exact quantiles without a single-task merge (radix selection).

Spark's exact ``percentile`` keeps a map of every distinct value per group and
merges all partial maps of a group in one task: for a table-wide quantile of a
continuous column that task holds every distinct value of the table.  Here the
same exact values are found by narrowing value ranges instead:

1. One pass buckets every value by a monotone key (sign, binary exponent and
   the top four mantissa bits), a bounded number of buckets, and counts them
   with partial aggregation (count, min, max per bucket).
2. A running count over the buckets of each (group, column) -- a window over
   the small bucket table, never over rows -- finds the bucket holding each
   wanted rank.  A bucket whose min equals its max gives the value at once.
3. Unresolved buckets are split again into ``SUB_BUCKETS`` equal-width
   buckets over their own [min, max]: one more scan that keeps only rows in
   those buckets (a broadcast range join against a size-checked target table)
   and counts them the same way.  Each pass divides the range by
   ``SUB_BUCKETS``, so a few passes end at single values.

Every pass is a scan plus an aggregate whose output is bounded by the number
of buckets; a value held by a third of all rows collapses map-side.  The value
at fractional position ``(n-1)p`` is interpolated exactly as Spark's
``percentile`` does, so results are bit-identical to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyho.operators.stats import _by
from tallyho.session import Scratch, materialize

SUB_BUCKETS = 1 << 16       # buckets per refinement pass
MAX_PASSES = 12             # far above what doubles need (range / 2^16 per pass)
MAX_LOCAL_TARGETS = 10_000  # unresolved-bucket tables up to this size are broadcast


def _with_octave_key(df: DataFrame, v: str, out: str) -> DataFrame:
    """Add a monotone bucket key of the double column ``v``: 0 for zero, and
    +/-(1 + 16*(e+1100) + m) for |v| in [2^e, 2^(e+1)) with m the top four
    mantissa bits.  ``log2`` may be off by one near powers of two, so the
    exponent is corrected by exact comparisons with 2^e.  Built in stages
    (one ``log2`` and one ``pow`` per value; Catalyst keeps the stages apart
    rather than repeat non-cheap expressions)."""
    a = F.abs(F.col(v))
    e0 = F.least(F.greatest(F.floor(F.log2(a)), F.lit(-1074)), F.lit(1023))
    x = df.withColumns({"_e0": e0, "_p0": F.pow(F.lit(2.0), e0.cast("double"))})
    low, high = F.col("_p0") > a, F.col("_p0") * 2.0 <= a
    x = x.withColumns({
        "_e": F.when(low, F.col("_e0") - 1).when(high, F.col("_e0") + 1).otherwise(F.col("_e0")),
        "_p": F.when(low, F.col("_p0") * 0.5).when(high, F.col("_p0") * 2.0).otherwise(F.col("_p0"))})
    m = F.least(F.greatest(F.floor((a / F.col("_p") - 1.0) * 16.0), F.lit(0)), F.lit(15))
    # NaN is the greatest value and has a bucket of its own above +infinity.
    mag = F.when(F.isnan(a), F.lit(2 + 2200 * 16)).when(a == F.lit(float("inf")), F.lit(1 + 2200 * 16)) \
        .otherwise(F.lit(1) + (F.col("_e") + 1100) * 16 + m)
    key = F.when(F.col(v) == 0, F.lit(0)).when(F.isnan(v) | (F.col(v) > 0), mag).otherwise(-mag).cast("long")
    return x.withColumn(out, key).drop("_e0", "_p0", "_e", "_p")


def _ranks(n: Column, probs: Sequence[float]) -> Column:
    """Array of the 0-based ranks needed for all probabilities (floor and ceil of (n-1)p)."""
    rs = []
    for p in probs:
        pos = (n - 1).cast("double") * F.lit(float(p))
        rs += [F.floor(pos).cast("long"), F.ceil(pos).cast("long")]
    return F.array_distinct(F.array(*rs))


def _locate(hist: DataFrame, part: list[str], order: str, ranks: Column | str,
            below: Column) -> DataFrame:
    """For each wanted rank, the bucket that holds it.

    ``hist`` has one row per bucket with ``_c``, ``_lo``, ``_hi``; ``part`` names
    the (group, column) or target the buckets belong to.  A running count over
    the bucket table (bounded per partition by the bucket count) gives each
    bucket's rank interval; ranks inside it are emitted with the bucket.
    """
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    h = hist.withColumn("_start", below + F.coalesce(F.sum("_c").over(w), F.lit(0)))
    r = F.col(ranks) if isinstance(ranks, str) else ranks
    inside = F.filter(r, lambda x: (x >= F.col("_start")) & (x < F.col("_start") + F.col("_c")))
    return (h.withColumn("_in", inside).where(F.size("_in") > 0)
            .select("*", F.explode("_in").alias("_rank")).drop("_in"))


def quantiles(df: DataFrame, exprs: dict[str, Column], probs: dict[str, float], by=None,
              approx: bool = False) -> DataFrame:
    """Exact (linear-interpolated) quantiles of several expressions, per group.

    Output: one row per group that has a non-NULL value in some expression,
    with a DOUBLE column ``<name>__<label>`` per expression and probability
    label; NULL where the expression is NULL in the whole group.  With no
    ``by`` the result is exactly one row.  ``approx=True`` uses
    ``percentile_approx`` in one aggregate instead.
    """
    keys = _by(by)
    labels = list(probs)
    if approx:
        aggs = [F.percentile_approx(e.cast("double"), float(probs[lb]), 10000).cast("double")
                .alias(f"{n}__{lb}") for n, e in exprs.items() for lb in labels]
        return df.groupBy(*keys).agg(*aggs)

    # The projected input is written once and read by every pass.  The result
    # never refers to it -- every state table is fetched or written -- so it is
    # deleted at the end.
    wide = df.select(*[F.col(k) for k in keys], *[e.cast("double").alias(n) for n, e in exprs.items()])
    part = [*keys, "_column"]
    ps = [float(probs[lb]) for lb in labels]
    with Scratch(df.sparkSession) as scratch:
        long = scratch.table(wide).unpivot(keys, list(exprs), "_column", "_v").where(F.col("_v").isNotNull())
        vals = _select_ranks(long, part, _ranks(F.col("_n"), ps))

    # At most 2 ranks per probability per (group, column): a small map.
    per = vals.groupBy(*part, "_n").agg(
        F.map_from_entries(F.collect_list(F.struct("_rank", F.col("_lo").alias("_val")))).alias("_m"))
    qcols = []
    for lb, p in zip(labels, ps):
        # Exactly Spark's percentile: (hi - pos) * v_lo + (pos - lo) * v_hi.
        pos = (F.col("_n") - 1).cast("double") * F.lit(p)
        lo_r, hi_r = F.floor(pos).cast("long"), F.ceil(pos).cast("long")
        vlo, vhi = F.element_at("_m", lo_r), F.element_at("_m", hi_r)
        q = (F.when((lo_r == hi_r) | (vlo == vhi), vlo)
             .otherwise((hi_r.cast("double") - pos) * vlo + (pos - lo_r.cast("double")) * vhi))
        qcols.append(q.alias("_q_" + lb))
    per = per.select(*part, *qcols)
    pivot = [F.max(F.when(F.col("_column") == F.lit(nm), F.col("_q_" + lb))).alias(f"{nm}__{lb}")
             for nm in exprs for lb in labels]
    return per.groupBy(*keys).agg(*pivot)


def nth_smallest(df: DataFrame, value: Column, n: Column, by=None) -> DataFrame:
    """(keys, ``_cut``): the ``n``-th smallest value (1-based) of each group that has more than ``n`` rows.

    ``n`` may depend on the group keys; groups where it is below 1 or NULL have no row.
    """
    keys = _by(by)
    base = df.select(*[F.col(k) for k in keys], F.lit("v").alias("_column"), value.cast("double").alias("_v"))
    want = F.when((F.col("_n") > n) & (n >= 1), F.array((n - 1).cast("long")))
    with Scratch(df.sparkSession) as scratch:
        vals = _select_ranks(scratch.table(base), [*keys, "_column"], want)
    return vals.select(*keys, F.col("_lo").alias("_cut"))


def _select_ranks(long: DataFrame, part: list[str], want: Column) -> DataFrame:
    """(part, _n, _rank, _lo): the value at each wanted rank of the ``_v`` of each part.

    ``want`` is an array of 0-based ranks over the part's columns and its row count ``_n``.
    """
    # Pass 1: octave buckets per (group, column).
    hist = _with_octave_key(long, "_v", "_b").groupBy(*part, "_b").agg(
        F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    hist = hist.withColumn("_n", F.sum("_c").over(Window.partitionBy(*part))).withColumn("_want", want)
    found = _locate(hist, part, "_b", "_want", F.lit(0).cast("long"))
    state = _fix(found.select(*part, "_n", "_rank", "_lo", "_hi", F.col("_start").alias("_below")))
    done = [state.table.where(F.col("_lo") == F.col("_hi"))]

    # Refinement passes over the still-open buckets only.
    passes = 0
    while state.unresolved > 0:
        passes += 1
        if passes > MAX_PASSES:
            raise RuntimeError("quantile refinement did not converge")
        tgt = _targets(state, part)
        t = F.broadcast(tgt.table) if tgt.local else tgt.table
        cond = [F.col(f"l.{k}").eqNullSafe(F.col(f"t.{k}")) for k in part] + [
            F.col("l._v") >= F.col("t._lo"), F.col("l._v") <= F.col("t._hi")]
        rows = long.alias("l").join(t.alias("t"), cond, "inner")
        width = F.col("t._hi") - F.col("t._lo")
        sb = F.least(F.floor((F.col("l._v") - F.col("t._lo")) / width * F.lit(float(SUB_BUCKETS))),
                     F.lit(SUB_BUCKETS - 1)).cast("long")
        sub = rows.groupBy(F.col("t._tid").alias("_tid"), sb.alias("_sb")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("l._v").alias("_lo"), F.max("l._v").alias("_hi"))
        info = tgt.table.select("_tid", *part, "_n", "_ranks", F.col("_below").alias("_base"))
        sub = sub.join(F.broadcast(info) if tgt.local else info, "_tid")
        found = _locate(sub, ["_tid"], "_sb", "_ranks", F.col("_base"))
        state = _fix(found.select(*part, "_n", "_rank", "_lo", "_hi", F.col("_start").alias("_below")))
        done.append(state.table.where(F.col("_lo") == F.col("_hi")))
    vals = done[0]
    for d in done[1:]:
        vals = vals.unionByName(d)
    return vals


class _State:
    def __init__(self, table: DataFrame, local: bool, unresolved: int, rows=None):
        self.table, self.local, self.unresolved, self.rows = table, local, unresolved, rows


def _targets(state: _State, part: list[str]) -> _State:
    """One target per still-open bucket (several ranks may share a bucket),
    numbered by ``_tid``.  When the state is already a fetched (bounded)
    relation the targets are formed from its rows without another job."""
    schema = state.table.schema
    if state.local:
        buckets: dict[tuple, set] = {}
        for r in state.rows:
            if r["_lo"] < r["_hi"]:
                key = (*[r[c] for c in part], r["_n"], r["_lo"], r["_hi"], r["_below"])
                buckets.setdefault(key, set()).add(r["_rank"])
        fields = [schema[c] for c in [*part, "_n", "_lo", "_hi", "_below"]] + [
            T.StructField("_ranks", T.ArrayType(T.LongType())), T.StructField("_tid", T.LongType())]
        data = [(*k, sorted(v), i) for i, (k, v) in enumerate(buckets.items())]
        return _State(state.table.sparkSession.createDataFrame(data, T.StructType(fields)), True, 0)
    open_ = state.table.where(F.col("_lo") < F.col("_hi"))
    return _fix(open_.groupBy(*part, "_n", "_lo", "_hi", "_below")
                .agg(F.collect_set("_rank").alias("_ranks"))
                .withColumn("_tid", F.monotonically_increasing_id()), count_open=False)


def _fix(df: DataFrame, count_open: bool = True) -> _State:
    """Fix a small intermediate table: fetched and re-created as a driver-held
    relation when at most ``MAX_LOCAL_TARGETS`` rows (one job), else written to
    the shared folder.  Also returns how many buckets are still open."""
    rows = df.limit(MAX_LOCAL_TARGETS + 1).collect()
    if len(rows) <= MAX_LOCAL_TARGETS:
        table = df.sparkSession.createDataFrame(rows, df.schema)
        unresolved = sum(1 for r in rows if r["_lo"] < r["_hi"]) if count_open else 0
        return _State(table, True, unresolved, rows)
    table = materialize(df)
    unresolved = table.where(F.col("_lo") < F.col("_hi")).limit(1).count() if count_open else 0
    return _State(table, False, unresolved)


def median_of(df: DataFrame, exprs: dict[str, Column], by=None, approx: bool = False,
              suffix: str = "") -> DataFrame:
    """Exact medians (mid-point of two) per group: columns ``<name><suffix>``."""
    q = quantiles(df, exprs, {"m": 0.5}, by, approx)
    keys = _by(by)
    return q.select(*keys, *[F.col(f"{n}__m").alias(n + suffix) for n in exprs])
