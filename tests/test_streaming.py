"""Streaming twins equal their batch versions."""

import tempfile

import pytest
from pyspark.sql import functions as F

from tallyho.operators.metrics import rolling_latency
from tallyho.streaming.rolling import stream_rolling_latency
from tests.conftest import SF001


def test_k1_multi_batch_equals_batch(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    src = tempfile.mkdtemp(prefix="k1-src-")
    # Three files in time order -> three micro-batches (arrival order = time order).
    ordered_ev = ev.orderBy("ts", "event_id").withColumn("_b", F.ntile(3).over(
        __import__("pyspark.sql.window", fromlist=["Window"]).Window.orderBy("ts", "event_id")))
    for b in (1, 2, 3):
        ordered_ev.where(F.col("_b") == b).drop("_b").coalesce(1).write.parquet(f"{src}/part{b}")
    stream = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    out = stream_rolling_latency(stream, n=20, key="event_type", error=F.col("event_type") == "error")
    sink = tempfile.mkdtemp(prefix="k1-out-")
    q = (out.writeStream.format("parquet").option("path", sink + "/d")
         .option("checkpointLocation", sink + "/c").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.event_id: r for r in spark.read.parquet(sink + "/d").collect()}
    want = rolling_latency(ev, n=20, by="event_type", order=["ts", "event_id"], latency="value",
                           error=F.col("event_type") == "error").collect()
    assert len(got) == len(want) == ev.count()
    for w in want:
        g = got[w.event_id]
        assert (g.window_n, g.error_count, g.request_count) == (w.window_n, w.error_count, w.request_count)
        assert g.p95_latency == pytest.approx(w.p95_latency) and g.avg_latency == pytest.approx(w.avg_latency)


def _three_batches(spark, folder):
    """Endpoint a at hours 0 and 9, c at hour 0 alone, b at hours 0, 3, 6 and 9."""
    schema = "event_id long, endpoint string, ts timestamp, value double"
    for i, (hour, names) in enumerate([(0, "abc"), (3, "b"), (6, "b"), (9, "ba")]):
        part = [(100 * i + 10 * j + k, name, f"2024-01-01 {hour:02d}:{k:02d}:00", 1.0 + k + j)
                for j, name in enumerate(names) for k in range(4)]
        df = spark.createDataFrame(part, "event_id long, endpoint string, ts string, value double")
        df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{folder}/in/part{i}")
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
            .parquet(f"{folder}/in"))


def test_state_of_an_idle_endpoint_goes(spark, tmp_path):
    out = stream_rolling_latency(_three_batches(spark, str(tmp_path)), n=3, key="endpoint", idle="1 hour")
    q = (out.writeStream.format("parquet").option("path", str(tmp_path / "d"))
         .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    q.awaitTermination()
    counts = {(r.endpoint, r.event_id): (r.request_count, r.window_n) for r in spark.read.parquet(str(tmp_path / "d")).collect()}
    assert [counts["b", i] for i in (10, 100, 103, 303)] == [(1, 1), (5, 3), (8, 3), (16, 3)]
    assert [counts["a", i] for i in (0, 3, 310, 313)] == [(1, 1), (4, 3), (1, 1), (4, 3)]  # a begins anew
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) == 3 and 1 in held  # a and c went


def test_state_table_drops_idle_endpoints_and_old_epochs(spark, tmp_path):
    from tallyho.streaming.rolling import stream_rolling_latency_table
    stream, found = _three_batches(spark, str(tmp_path)), []
    for run in ("one", "two"):  # a new checkpoint delivers every batch again: the same folders, the same rows
        q = stream_rolling_latency_table(stream, str(tmp_path / "out"), str(tmp_path / run), n=3, key="endpoint", idle="1 HOUR")
        q.awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out/data")).collect()
        found.append(sorted((r.epoch, r.endpoint, r.event_id, r.request_count, r.window_n) for r in rows))
        for name in ("carry", "seen"):
            assert sorted(p.name for p in (tmp_path / "out" / name).glob("epoch=*")) == ["epoch=2", "epoch=3"]
            held = {r.endpoint for r in spark.read.parquet(str(tmp_path / f"out/{name}/epoch=2")).collect()}
            assert held == {"b"}
    assert found[0] == found[1] and len(found[0]) == 28
    counts = {(e, i): (c, w) for _, e, i, c, w in found[0]}
    assert (counts["a", 310], counts["a", 313], counts["b", 303]) == ((1, 1), (4, 3), (16, 3))


def test_k2_scoring_batch_function(spark):
    from tallyho.plans.catalog import fit_logistic_model
    from tallyho.streaming.scoring import score_batch
    model, _, test = fit_logistic_model(spark, SF001)
    bad = test.limit(3).withColumn("age", F.lit(30))
    ok, rejected = score_batch(model, test.unionByName(bad))
    assert rejected.count() == 3
    assert ok.count() == test.count()
    assert set(ok.select("prediction").distinct().toPandas().prediction) <= {0, 1}
