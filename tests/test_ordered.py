"""Row-order operators against pandas brute force, across part counts."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyho.operators import ordered
from tallyho.operators.metrics import rolling_latency
from tests.conftest import SF001


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    n = 3000
    pdf = pd.DataFrame({
        "row_ix": rng.permutation(n * 3)[:n].astype("int64"),
        # one hot group holds most rows
        "g": np.where(rng.random(n) < 0.7, "hot", np.where(rng.random(n) < 0.5, "a", "b")),
        "x": np.where(rng.random(n) < 0.3, np.nan, rng.random(n)),
    })
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("rows_per_part", [200, 10_000_000])
def test_with_sequence_dense(spark, frame, rows_per_part):
    pdf, df = frame
    seq = ordered.with_sequence(df, "g", ["row_ix"], "seq", count_col="n", rows_per_part=rows_per_part)
    got = seq.toPandas().sort_values(["g", "row_ix"]).reset_index(drop=True)
    want = pdf.sort_values(["g", "row_ix"]).reset_index(drop=True)
    want["seq"] = want.groupby("g").cumcount()
    assert (got["seq"].to_numpy() == want["seq"].to_numpy()).all()
    assert (got["n"].to_numpy() == want.groupby("g")["g"].transform("size").to_numpy()).all()


def test_head_and_tail(spark, frame):
    pdf, df = frame
    head = ordered.head_rows(df, {"hot": 100, "a": 5, "b": 0}, by="g")
    want = pdf.sort_values("row_ix").groupby("g").head(1000)
    want = pd.concat([want[want.g == "hot"].head(100), want[want.g == "a"].head(5)])
    assert sorted(r.row_ix for r in head.collect()) == sorted(want.row_ix.tolist())
    tail = ordered.tail_rows(df, 7, by="g")
    want_t = pdf.sort_values("row_ix").groupby("g").tail(7)
    assert sorted(r.row_ix for r in tail.collect()) == sorted(want_t.row_ix.tolist())


def test_fill_forward_across_chunks(spark, frame):
    pdf, df = frame
    got = ordered.fill_forward(df, ["x"], by="g", chunk_rows=37, rows_per_part=250).toPandas()
    want = pdf.sort_values("row_ix").copy()
    want["x"] = want.groupby("g")["x"].ffill()
    m = got.merge(want, on="row_ix", suffixes=("", "_w"))
    assert len(m) == len(pdf)
    assert np.allclose(m.x.fillna(-1), m.x_w.fillna(-1))


def test_rolling_halo_matches_brute_force(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    r = rolling_latency(ev, n=10, by="event_type", order=["ts", "event_id"], latency="value",
                        error=F.col("event_type") == "view", chunk_rows=25, rows_per_part=120).toPandas()
    pdf = ev.toPandas().sort_values(["ts", "event_id"])
    pdf["lat"] = np.where(pdf.event_type == "view", 0.0, pdf.value)
    exp = {}
    for _, grp in pdf.groupby("event_type"):
        lat = grp.lat.to_numpy()
        ids = grp.event_id.to_numpy()
        for i in range(len(grp)):
            w = lat[max(0, i - 9): i + 1]
            v = w[w > 0]
            exp[ids[i]] = (len(w), float(np.mean(v)) if len(v) else 0.0,
                           float(np.percentile(v, 95)) if len(v) else 0.0, i + 1)
    for row in r.itertuples():
        n, avg, p95, cnt = exp[row.event_id]
        assert row.window_n == n and row.request_count == cnt
        assert row.avg_latency == pytest.approx(avg) and row.p95_latency == pytest.approx(p95)


@pytest.mark.parametrize("n", [100, 10_000])
def test_long_windows_equal_brute_force(spark, n):
    """Windows longer and shorter than the groups, with ties, NULL values and failed rows, over several chunks."""
    rng = np.random.default_rng(n)
    m = 3 * n if n > 1000 else 1500
    rows = [(i, "hot" if i % 10 else "cold", float(rng.integers(0, 50)) if i % 13 else None, bool(rng.random() < 0.1)) for i in range(m)]
    df = spark.createDataFrame(rows, "event_id long, g string, value double, failed boolean").withColumn("ts", F.timestamp_seconds("event_id"))
    got = {r.event_id: r for r in rolling_latency(df, n=n, by="g", error=F.col("failed"), chunk_rows=n + 7, rows_per_part=n).collect()}
    assert len(got) == m
    for name in ("hot", "cold"):
        own = [r for r in rows if r[1] == name]
        for i in [*range(0, len(own), max(1, len(own) // 97)), len(own) - 1]:
            part = own[max(0, i - n + 1):i + 1]
            v = np.array([r[2] for r in part if r[2] is not None and r[2] > 0 and not r[3]])
            r = got[own[i][0]]
            assert (r.window_n, r.error_count, r.request_count) == (len(part), sum(p[3] for p in part), i + 1)
            want = [v.mean(), np.percentile(v, 95), np.percentile(v, 99)] if len(v) else [0.0] * 3
            assert [r.avg_latency, r.p95_latency, r.p99_latency] == pytest.approx(want, abs=1e-9)
