"""Streams that keep stored tables instead of state: twenty micro-batches with replays and late rows."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

from pyspark.sql import functions as F

from trialspark.session import scratch_path
from trialspark.streaming import live

SCHEMA = "trial_id long, model string, cost double, ts timestamp, extra string"
START = dt.datetime(2024, 3, 1)


def batches(n=20, size=30, seed=5):
    """Rows of ``n`` batches: new events, replays of events of any earlier batch, rows days late, null keys and null times."""
    rng, known, out = random.Random(seed), [], []
    for b in range(n):
        rows = []
        for k in range(size):
            late = dt.timedelta(days=rng.choice([0, 0, 0, 3, 40]))
            row = (b * size + k, rng.choice(["m_0", "m_1", None]), rng.choice([None, 0.1, 0.25]), START + dt.timedelta(minutes=7 * b + k) - late, f"b{b}")
            rows.append(row)
            known.append(row)
        rows += [(*rng.choice(known)[:4], f"again{b}") for _ in range(size // 2)]
        rows += [(None, "m_0", 0.5, START, "no key"), (7, "m_1", 0.5, None, "no time")]
        out.append(rows)
    return out


def arriving(spark, tmp_path, data):
    for i, rows in enumerate(data):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return live.event_stream(spark, f"{tmp_path}/in", SCHEMA, files_per_batch=1)


def slot(ts):
    return None if ts is None else ts.replace(hour=0, minute=0, second=0, microsecond=0)


def test_each_event_once_over_twenty_batches(spark, tmp_path):
    data = batches()
    stream = arriving(spark, tmp_path, data)
    path = scratch_path(spark, "once")
    got = live.first_arrivals(stream, path).collect()
    want = {(r[0], slot(r[3])) for rows in data for r in rows}
    assert sorted(((r.trial_id, slot(r.ts)) for r in got), key=str) == sorted(want, key=str)
    assert list(got[0].asDict()) == ["trial_id", "model", "cost", "ts", "extra"]
    # a later batch reads the slots it needs only: the stored keys are cut by the time of their events
    keys = spark.read.parquet(f"{path}/keys")
    assert keys.where("_slot = 0").count() == 0
    assert keys.select("_slot").distinct().count() == len({slot(r[3]) for rows in data for r in rows})


def test_sums_over_twenty_batches_with_folds(spark, tmp_path):
    data = batches()
    stream = arriving(spark, tmp_path, data)
    flat = [r for rows in data for r in rows]
    for fold in (3,):
        got = live.added_up(
            stream, scratch_path(spark, "sums"), {"model": F.col("model")}, {"n": F.count(F.lit(1)), "c": F.sum(F.col("cost").cast("decimal(20,4)"))}, fold
        ).collect()
        n, c = Counter(), Counter()
        for _, model, cost, _, _ in flat:
            n[model] += 1
            c[model] += Decimal(str(cost or 0))
        assert {r.model: (r.n, r.c) for r in got} == {m: (n[m], c[m]) for m in n}
    rate = live.trial_rate(stream, scratch_path(spark, "rate"), 86_400).collect()
    per = Counter(int(slot(r[3]).replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000 for r in flat if r[3])
    assert {r.start_us: r.trials for r in rate} == per


def test_streams_hold_no_state(spark, tmp_path):
    stream = arriving(spark, tmp_path, batches(2, 5))
    seen = []
    plain = live.run
    try:
        live.run = lambda df, sink, mode="append": seen.append(df) or plain(df, sink, mode)
        live.first_arrivals(stream, scratch_path(spark, "a"))
        live.trial_rate(stream, scratch_path(spark, "b"))
    finally:
        live.run = plain
    for df in seen:
        q = df.writeStream.format("noop").option("checkpointLocation", scratch_path(spark, "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert all(not p["stateOperators"] for p in q.recentProgress)
