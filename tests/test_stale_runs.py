"""Stale runs over several micro-batches with late beats."""

import os

from pyspark.sql import functions as F

from trialspark import plans
from trialspark import views as v
from trialspark.streaming import live


def beats(spark, folder, batches):
    """One file per batch, read in this order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "run_id string, s long").selectExpr("run_id", "timestamp_seconds(s) AS ts").coalesce(1).write.parquet(f"{folder}/raw{k}")
        part = next(x for x in sorted(os.listdir(f"{folder}/raw{k}")) if x.endswith(".parquet"))
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.link(f"{folder}/raw{k}/{part}", f"{folder}/in/{k}.parquet")
        os.utime(f"{folder}/in/{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return live.event_stream(spark, f"{folder}/in", "run_id string, ts timestamp", files_per_batch=1)


def test_each_stale_run_once_and_late_beats(spark, tmp_path):
    batches = [
        [("a", 0), ("a", 100), ("b", 0)],
        [("a", 700), ("b", 250), ("a", 200)],  # b and a: late, within ten minutes, so they join their sessions
        [("c", 3000)],
        [("c", 3010)],
        [("a", 50), ("d", 3100), ("c", 2900)],  # a: behind the watermark, its session has been reported
    ]
    stream = beats(spark, str(tmp_path), batches)
    path = str(tmp_path / "out")
    got = live.to_table(live.stale_runs(stream, 300, "10 minutes"), path)
    rows = sorted((r.run_id, r.heartbeat_us // 10**6, r.beats, r.stale_us // 10**6) for r in got.collect())
    assert rows == [("a", 200, 3, 500), ("a", 700, 1, 1000), ("b", 250, 2, 550)]
    written = [n for n in os.listdir(path) if n.startswith("batch=") and any(r for r in spark.read.parquet(f"{path}/{n}").collect())]
    assert len(written) == 1 and written != ["batch=0"]  # given when the watermark passed, not again later


def test_state_does_not_grow(spark, tmp_path):
    """Twenty batches of runs that come and go: the number of rows in the state stays small."""
    stream = beats(spark, str(tmp_path), [[(f"run{k}", 1000 * k), (f"run{k}", 1000 * k + 60)] for k in range(20)])
    query = live.stale_runs(stream, 300, "10 minutes").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    assert len(held) >= 20 and max(held) <= 3


def test_query_gives_the_last_session_of_every_run(spark):
    plans.load()
    sf = "/root/testdata/sf0.001"
    got = plans.QUERIES["str07_stream_stale_runs"](spark, sf).groupBy("run_id").agg(F.max("heartbeat_us"), F.sum("beats"))
    want = v.trials(spark, sf).groupBy("run_id").agg(F.max("ts_us"), F.count("trial_id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
