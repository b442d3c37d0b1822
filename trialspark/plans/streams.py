"""Streaming queries: run to the end of what is available, read back, equal to their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark import views as v
from trialspark.functions import scorers as sc
from trialspark.operators import trials as t
from trialspark.plans.registry import query
from trialspark.plans.windows import _BUDGETS, _MONEY, BUDGETS, _burn_sql
from trialspark.session import scratch_path
from trialspark.streaming import live


def events(spark, sf):
    schema = v.table(spark, sf, "events").schema
    return live.event_stream(spark, sf, schema, "events.parquet")


def trials(spark, sf):
    """The trial stream with its event time as a timestamp column."""
    e = events(spark, sf)
    out = v.trials_from(e)
    return out.withColumn("ts", F.timestamp_micros("ts_us"))


def in_batches(spark, rows, batches=4):
    """``rows`` as a stream of ``batches`` micro-batches, each a share of all rows in no order of time."""
    path = scratch_path(spark, "arriving")
    rows.repartition(batches).write.parquet(path)
    return live.event_stream(spark, path, rows.schema, files_per_batch=1)


def batch_trials(spark, sf):
    return v.trials(spark, sf).withColumn("ts", F.timestamp_micros("ts_us"))


@query(
    "str01_stream_model_stats",
    f"SELECT model, count(*) AS trials, R(CAST(sum({_MONEY}) AS DOUBLE)) AS total_cost, R(CAST(sum({_MONEY}) AS DOUBLE) / count(*)) AS mean_cost FROM trials GROUP BY 1",
)
def _(spark, sf):
    arriving = in_batches(spark, v.trials(spark, sf).select("model", "cost"))
    return live.model_stats(arriving, scratch_path(spark, "stats"))


@query(
    "str02_stream_anomaly",
    f"""WITH s AS (SELECT trial_id, model, cost, CAST(sum({_MONEY}) OVER w AS DOUBLE) / count(*) OVER w AS em FROM trials WHERE cost IS NOT NULL
WINDOW w AS (PARTITION BY model ORDER BY ts_us, trial_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT trial_id, model, R(cost) AS cost, R(em) AS earlier_mean, R(cost / em) AS multiplier FROM s WHERE em > 0 AND cost > 3 * em""",
)
def _(spark, sf):
    return live.anomalies(trials(spark, sf), scratch_path(spark, "anomalies"), 3.0)


@query(
    "str03_stream_budget",
    f"""WITH s AS (SELECT trial_id, model, CAST(sum({_MONEY}) OVER (PARTITION BY model ORDER BY ts_us, trial_id) AS DOUBLE) AS spent, {_BUDGETS}::DOUBLE AS budget FROM trials)
SELECT trial_id, model, R(spent) AS spent, R(budget) AS budget FROM s WHERE spent > budget""",
)
def _(spark, sf):
    return live.budget_alerts(trials(spark, sf), scratch_path(spark, "budgets"), BUDGETS)


@query("str04_stream_burn_rate", _burn_sql(60, 0.05))
def _(spark, sf):
    return live.burn_alerts(trials(spark, sf), scratch_path(spark, "burn"), 0.05)


@query("str05_stream_dedupe", "SELECT run_id, count(*) AS trials FROM trials GROUP BY 1")
def _(spark, sf):
    """Every third event arrives a second time, mostly in another micro-batch, and is counted once."""
    e = batch_trials(spark, sf).select("run_id", "trial_id", "ts")
    copies = F.explode(F.when(F.col("trial_id") % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    arriving = in_batches(spark, e.withColumn("_copy", copies).drop("_copy"))
    got = live.first_arrivals(arriving, scratch_path(spark, "dedupe"))
    return got.groupBy("run_id").agg(t.n_rows().alias("trials"))


@query(
    "str07_stream_stale_runs",
    """WITH e AS (SELECT run_id, ts_us, lag(ts_us) OVER (PARTITION BY run_id ORDER BY ts_us) AS p FROM trials), g AS (SELECT *, sum(coalesce((ts_us - p >= 300000000)::INT, 1)) OVER (PARTITION BY run_id ORDER BY ts_us) AS s FROM e)
SELECT run_id, max(ts_us) AS heartbeat_us, count(*) AS beats, max(ts_us) + 300000000 AS stale_us FROM g GROUP BY run_id, s""",
)
def _(spark, sf):
    """Every session of a run, those that end with the stream too."""
    return live.to_table(live.stale_runs(trials(spark, sf)), scratch_path(spark, "stale"), "complete")


@query("str08_run_feed", "SELECT trial_id, model, R(score) AS score, ts_us FROM trials WHERE run_id = 'run_2'")
def _(spark, sf):
    feed = live.run_feed(trials(spark, sf), "run_2").select("trial_id", "model", "score", "ts_us")
    return live.to_table(feed, scratch_path(spark, "feed"))


@query(
    "str09_stream_trial_rate",
    "SELECT ts_us // 60000000 * 60000000 AS start_us, count(*) AS trials FROM trials GROUP BY 1",
)
def _(spark, sf):
    arriving = in_batches(spark, batch_trials(spark, sf).select("ts"))
    return live.trial_rate(arriving, scratch_path(spark, "rate"))


@query("str10_stream_score")
def _(spark, sf):
    """Responses scored as they arrive against their stored task definitions."""
    schema = v.table(spark, sf, "conversations").schema
    stream = live.event_stream(spark, sf, schema, "conversations.parquet").where("role = 'assistant'").select("conv_id", "turn", "text")
    known = v.cases(spark, sf).drop("response")
    joined = stream.join(known, ["conv_id", "turn"]).withColumnRenamed("text", "response")
    scored = joined.select("case_id", "task_type", sc.score_all(F.col("task_type")).alias("score"))
    return live.to_table(scored, scratch_path(spark, "scores"))


@query("udf08_alert_listener", "SELECT trial_id, model FROM trials WHERE error IS NOT NULL")
def _(spark, sf):
    """Two listeners; the first fails on every batch and is only logged."""
    path = scratch_path(spark, "listener")
    hub = live.Listeners()

    def broken(_batch, _i):
        raise RuntimeError("listener is down")

    hub.add(broken)
    hub.add(lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/batch={i}"))
    failures = trials(spark, sf).where("error IS NOT NULL").select("trial_id", "model")
    live.run(failures, hub)
    return spark.read.schema(failures.schema).option("recursiveFileLookup", True).parquet(path)
