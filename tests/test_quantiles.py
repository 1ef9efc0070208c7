"""Distributed exact quantiles, literal statistics and the grid-reach KDE."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyho.operators import profile
from tallyho.operators.quantiles import median_of, quantiles
from tallyho.operators.stats import attach_stats, join_groups, one_row_values
from tests.conftest import SF01

PROBS = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "p100": 1.0}


def _reference(df, exprs, by):
    keys = [by] if by else []
    aggs = [F.percentile(e.cast("double"), F.lit(p)).alias(f"{n}__{lb}")
            for n, e in exprs.items() for lb, p in PROBS.items()]
    return {tuple(r[k] for k in keys): r.asDict() for r in df.groupBy(*keys).agg(*aggs).collect()}


def _assert_same(df, exprs, by=None):
    keys = [by] if by else []
    got = {tuple(r[k] for k in keys): r.asDict() for r in quantiles(df, exprs, PROBS, by).collect()}
    for key, ref in _reference(df, exprs, by).items():
        row = got.get(key)
        if row is None:  # groups with only NULL values have no row
            assert all(v is None for c, v in ref.items() if c not in keys)
            continue
        assert row == ref, key


def test_small_cases(spark):
    rows = [("a", 1.0), ("a", 1.0), ("a", 2.0), ("a", None), ("b", -5.5), ("b", 0.0),
            ("b", 1e-310), ("b", 3e300), (None, 7.0), (None, 7.0), ("c", None),
            ("d", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    _assert_same(df, {"v": F.col("v")}, "g")
    _assert_same(df, {"v": F.col("v"), "w": F.col("v") * -3}, None)


def test_empty_input_gives_one_null_row(spark):
    df = spark.createDataFrame([], "v double")
    out = quantiles(df, {"v": F.col("v")}, {"m": 0.5}).collect()
    assert len(out) == 1 and out[0]["v__m"] is None


def test_continuous_columns_match_percentile(spark):
    li = spark.read.parquet(f"{SF01}/lineitem.parquet")
    cols = {c: F.col(c) for c in ("l_extendedprice", "l_discount", "l_orderkey")}
    _assert_same(li, cols, None)
    _assert_same(li, {"p": F.col("l_extendedprice") - 40000}, "l_returnflag")


def test_median_of_suffix(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (11.0,)], "v double")
    assert median_of(df, {"v": F.col("v")}, suffix="_med").first()["v_med"] == 6.0


def test_one_row_values_keep_types(spark):
    stats = spark.sql("SELECT 1.5D AS d, CAST(NULL AS BIGINT) AS n, array(0.25D, 0.75D) AS a, "
                      "named_struct('x', 1, 'y', 'z') AS s, map('k', 2) AS m")
    vals = one_row_values(stats)
    out = spark.range(2).withColumns(vals)
    assert out.schema["a"].dataType == stats.schema["a"].dataType
    r = out.first()
    assert (r.d, r.n, r.a, r.s.y, r.m) == (1.5, None, [0.25, 0.75], "z", {"k": 2})
    with pytest.raises(ValueError):
        one_row_values(spark.range(3))
    assert attach_stats(spark.range(3), stats.select("d")).where("d = 1.5").count() == 3


def test_join_groups_null_keys(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "g string, a int")
    b = spark.createDataFrame([("x", 10), (None, 20)], "g string, b int")
    out = {r.g: (r.a, r.b) for r in join_groups(a, b, ["g"]).collect()}
    assert out == {"x": (1, 10), None: (2, 20)}


def test_kde_matches_brute_force(spark):
    rows = [(i % 2, float(v)) for i, v in enumerate([0.1, 0.5, 0.5, 0.9, 1.7, 2.0, 2.2, 3.9, 3.1, 2.8, 40.0])]
    df = spark.createDataFrame(rows, "pass_fail int, gpa double")
    got = {(r.pass_fail, r.grid_ix): (r.x, r.density) for r in profile.kde(df, "gpa").collect()}
    total = len(rows)
    for cls in (0, 1):
        v = np.array([x for c, x in rows if c == cls])
        bw = v.std(ddof=1) * len(v) ** -0.2
        grid = np.linspace(v.min() - 3 * bw, v.max() + 3 * bw, 200)
        dens = np.exp(-0.5 * ((grid[:, None] - v[None, :]) / bw) ** 2).sum(1) / (
            total * bw * math.sqrt(2 * math.pi))
        for j in range(200):
            x, d = got[(cls, j)]
            assert x == pytest.approx(grid[j], rel=1e-9, abs=1e-9)
            assert d == pytest.approx(dens[j], rel=1e-9, abs=1e-15)


def test_written_state_path_matches_percentile(spark, monkeypatch):
    """Beyond the local cap the bucket states are written to the shared folder
    and joined without a broadcast; results must not change."""
    import tallyho.operators.quantiles as Q
    monkeypatch.setattr(Q, "MAX_LOCAL_TARGETS", 3)
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    _assert_same(ev, {"value": F.col("value"), "uid": F.col("user_id")}, "event_type")


def test_approx_path_is_close_to_exact(spark):
    li = spark.read.parquet(f"{SF01}/lineitem.parquet")
    exprs = {"p": F.col("l_extendedprice")}
    exact = quantiles(li, exprs, {"q1": 0.25, "q3": 0.75}).first()
    approx = quantiles(li, exprs, {"q1": 0.25, "q3": 0.75}, approx=True).first()
    # percentile_approx(accuracy=10000): rank error at most n / 10000.
    ranks = li.select(F.count_if(F.col("l_extendedprice") <= approx["p__q1"]).alias("r1"),
                      F.count_if(F.col("l_extendedprice") <= approx["p__q3"]).alias("r3"),
                      F.count("*").alias("n")).first()
    assert abs(ranks.r1 - 0.25 * ranks.n) <= ranks.n / 10000 + 1
    assert abs(ranks.r3 - 0.75 * ranks.n) <= ranks.n / 10000 + 1
    assert exact["p__q1"] < exact["p__q3"]
