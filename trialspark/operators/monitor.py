"""Batch twins of the live monitors: anomalies, burn rate, budgets, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.constants import ANOMALY_MULTIPLIER, BURN_WINDOW_SECONDS, STALE_SECONDS
from trialspark.operators.ordered import running, running_totals
from trialspark.operators.trials import cost0

MONEY = "decimal(24,9)"


def exact_cost() -> Column:
    """Cost as a decimal: running sums then do not depend on addition order."""
    return cost0().cast(MONEY)


def totals_by_model(trials: DataFrame) -> DataFrame:
    """What later trials need to know of earlier ones: count and cost per model."""
    known = trials.where(F.col("cost").isNotNull())
    return known.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum(exact_cost()).cast(MONEY).alias("spent"))


def _with_carry(rows: DataFrame, carry: DataFrame | None) -> DataFrame:
    """Put one row per model with the totals of everything before ahead of ``rows``."""
    rows = rows.withColumns({"_k": F.lit(1).cast("long"), "_c": exact_cost()})
    if carry is None:
        return rows
    none = lambda f: F.lit(None).cast(f.dataType)
    have = {"model": F.col("model"), "_k": F.col("n"), "_c": F.col("spent").cast(MONEY), "ts_us": F.lit(-1), "trial_id": F.lit(-1)}
    return rows.unionByName(carry.select(*[have.get(f.name, none(f)).cast(f.dataType).alias(f.name) for f in rows.schema.fields]))


def cost_anomalies(trials: DataFrame, multiplier: float = ANOMALY_MULTIPLIER, carry: DataFrame | None = None) -> DataFrame:
    """Trials costing more than ``multiplier`` times the mean of the model's earlier trials."""
    known = _with_carry(trials.where(F.col("cost").isNotNull()), carry)
    seen = running_totals(known, ["model"], ["ts_us", "trial_id"], {"_n": F.col("_k"), "_sum": F.col("_c")})
    before = (F.col("_sum") - F.col("_c")).cast("double") / (F.col("_n") - F.col("_k"))
    return (
        seen.where((F.col("_n") > F.col("_k")) & (F.col("trial_id") >= 0))
        .withColumn("earlier_mean", before)
        .where((F.col("earlier_mean") > 0) & (F.col("cost") > multiplier * F.col("earlier_mean")))
        .select("trial_id", "model", "cost", "earlier_mean", (F.col("cost") / F.col("earlier_mean")).alias("multiplier"))
    )


def burn_rate(trials: DataFrame, threshold_per_minute: float, window_s: int = BURN_WINDOW_SECONDS) -> DataFrame:
    """Trials at which the model's spend over the last ``window_s`` seconds passes the threshold.

    A trial enters the sum at its time and leaves it one microsecond after the
    window has passed, so the sliding sum is a running sum over entries and
    exits and a busy model is cut into slices like any other running sum. All
    moves of one time are one step: trials of the same time see each other.
    """
    base = trials.select("trial_id", "model", "ts_us", exact_cost().alias("_c"))
    span = window_s * 1_000_000 + 1
    steps = F.array(
        F.struct(F.col("ts_us").alias("at"), F.col("_c").alias("d"), F.lit(1).alias("k")),
        F.struct((F.col("ts_us") + span).alias("at"), (-F.col("_c")).alias("d"), F.lit(-1).alias("k")),
    )
    moves = base.select("model", F.inline(steps)).groupBy("model", "at").agg(F.sum("d").cast(MONEY).alias("d"), F.sum("k").alias("k"))
    seen = running_totals(moves, ["model"], ["at"], {"_spent": F.col("d"), "_live": F.col("k")})
    per_minute = F.col("_spent").cast("double") * (60.0 / window_s)
    high = (
        seen.where(F.col("_live") > 1)
        .select("model", F.col("at").alias("ts_us"), per_minute.alias("burn_per_minute"), F.col("_live").alias("events"))
        .where(F.col("burn_per_minute") > threshold_per_minute)
    )
    return base.join(high, ["model", "ts_us"]).select("trial_id", "model", "ts_us", "burn_per_minute", "events")


def budget_exceeded(trials: DataFrame, budgets: dict[str, float], keys: list[str], carry: DataFrame | None = None) -> DataFrame:
    """Every trial at which the cumulative cost of its key is above the key's budget."""
    key = F.col(keys[0]) if keys else F.lit("*")
    budget = F.element_at(F.create_map(*[F.lit(x) for kv in budgets.items() for x in kv]), key)
    seen = running_totals(_with_carry(trials, carry), keys, ["ts_us", "trial_id"], {"_spent": F.col("_c")})
    return (
        seen.where(F.col("trial_id") >= 0)
        .withColumn("spent", F.col("_spent").cast("double"))
        .withColumn("budget", budget)
        .where(F.col("spent") > F.col("budget"))
        .select("trial_id", *keys, "spent", "budget")
    )


def budget_state(trials: DataFrame, budgets: dict[str, float]) -> DataFrame:
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in budgets.items() for x in kv]), F.col("model"))
    return (
        trials.groupBy("model")
        .agg(F.sum(exact_cost()).cast("double").alias("spent"))
        .withColumn("budget", limit)
        .withColumn("remaining", F.col("budget") - F.col("spent"))
        .withColumn("exhausted", F.col("spent") > F.col("budget"))
    )


def burn_chart(trials: DataFrame, budget: float) -> DataFrame:
    seen = running_totals(
        trials, ["run_id"], ["trial_id"], {"_spent": exact_cost(), "step": F.lit(1).cast("long")}
    )
    return seen.select("run_id", "trial_id", "step", F.col("_spent").cast("double").alias("spent"), F.lit(budget).alias("budget"))


def retained(log: DataFrame, size: str, order: list[str], cap: int) -> DataFrame:
    """Newest entries whose cumulative size stays within ``cap``: the oldest go first."""
    seen = running(log, [], order, {"_kept": F.col(size)}, reverse=True)
    return seen.where(F.col("_kept") <= cap).drop("_kept")


def trial_rate(trials: DataFrame, planned: int, last: int = 1000) -> DataFrame:
    """Trials per minute over each run's last ``last`` trials and minutes left."""
    w = Window.partitionBy("run_id").orderBy(F.desc("ts_us"), F.desc("trial_id"))
    recent = trials.select("run_id", "ts_us", "trial_id").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= last)
    agg = recent.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("recent"), F.min("ts_us").alias("_a"), F.max("ts_us").alias("_b")
    )
    done = trials.groupBy("run_id").agg(F.count(F.lit(1)).alias("done"))
    rate = F.when(F.col("_b") > F.col("_a"), (F.col("recent") - 1) / ((F.col("_b") - F.col("_a")) / 60e6))
    out = agg.join(done, "run_id").withColumn("per_minute", rate)
    left = F.greatest(F.lit(planned) - F.col("done"), F.lit(0)) / F.col("per_minute")
    return out.select("run_id", "recent", "done", "per_minute", left.alias("minutes_left"))


def top_per_group(df: DataFrame, group: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group; Spark trims each input partition before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def stale_runs(runs: DataFrame, now_us: int | Column, limit_s: int = STALE_SECONDS) -> DataFrame:
    now = F.lit(now_us) if isinstance(now_us, int) else now_us
    late = (F.col("status") == "active") & F.col("heartbeat_us").isNotNull() & (now - F.col("heartbeat_us") > limit_s * 1_000_000)
    late = F.coalesce(late, F.lit(False))
    return runs.withColumns(
        {"status": F.when(late, F.lit("failed")).otherwise(F.col("status")), "was_stale": late}
    )
