"""Filters, joins and aggregates over trials and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.constants import REGRESSION_DELTA, TYPE_WEIGHTS, WEIGHT_SCHEMES


def cost0() -> Column:
    """Cost with an unknown value counted as nothing."""
    return F.coalesce(F.col("cost"), F.lit(0.0))


def n_rows() -> Column:
    return F.count(F.lit(1))


# ---- filters -------------------------------------------------------------
def trials_of_run(trials, run_id, model=None, source=None) -> DataFrame:
    cond = F.col("run_id") == run_id
    if model is not None:
        cond &= F.col("model") == model
    if source is not None:
        cond &= F.col("source") == source
    return trials.where(cond)


def cross_run_trials(trials, run_ids, variant=None, model=None) -> DataFrame:
    """Trials of several runs in one scan; ``run_pos`` keeps the given run order."""
    pos = F.coalesce(*[F.when(F.col("run_id") == r, F.lit(i)) for i, r in enumerate(run_ids)])
    cond = F.col("run_id").isin(list(run_ids))
    if variant is not None:
        cond &= F.col("variant_name") == variant
    if model is not None:
        cond &= F.col("model") == model
    return trials.where(cond).withColumn("run_pos", pos.cast("long"))


def task_filter(tasks, types=None, task_id=None, limit=None, limit_per_type=None) -> DataFrame:
    """By type, by id, then the first ``limit`` by task_id, overall or per type."""
    if types:
        tasks = tasks.where(F.col("task_type").isin(list(types)))
    if task_id is not None:
        tasks = tasks.where(F.col("task_id") == task_id)
    if limit_per_type is not None:
        w = Window.partitionBy("task_type").orderBy("task_id")
        tasks = tasks.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit_per_type).drop("_n")
    if limit is not None:
        tasks = tasks.orderBy("task_id").limit(limit)
    return tasks


def variant_filter(variants, axis=None, name=None) -> DataFrame:
    if axis is not None:
        variants = variants.where(F.col("axis") == axis)
    if name is not None:
        variants = variants.where(F.col("variant_name") == name)
    return variants


def runs_page(summary, limit: int, offset: int = 0) -> DataFrame:
    return summary.orderBy(F.desc("created_us"), "run_id").offset(offset).limit(limit)


# ---- run level -----------------------------------------------------------
def run_summary(trials) -> DataFrame:
    return trials.groupBy("run_id").agg(
        n_rows().alias("total_trials"), F.sum(cost0()).alias("total_cost"), F.avg("latency_seconds").alias("avg_latency")
    )


def run_summary_join(runs, trials) -> DataFrame:
    """Every run with its totals; trials are reduced before they meet the runs."""
    zero = {"total_trials": 0, "total_cost": 0.0, "avg_latency": 0.0}
    return runs.join(run_summary(trials), "run_id", "left").na.fill(zero)


def run_aggregates(trials) -> DataFrame:
    """Per run, overall (variant NULL) and per variant in one grouping-sets pass."""
    sets = [[F.col("run_id")], [F.col("run_id"), F.col("variant_name")]]
    return trials.groupingSets(sets, "run_id", "variant_name").agg(
        n_rows().alias("total_trials"),
        F.avg("score").alias("avg_score"),
        F.sum("total_tokens").alias("total_tokens"),
        F.avg("latency_seconds").alias("avg_latency"),
    )


def run_enriched(trials) -> DataFrame:
    """Run totals and a per-model breakdown."""
    sets = [[F.col("run_id")], [F.col("run_id"), F.col("model")]]
    return trials.groupingSets(sets, "run_id", "model").agg(
        n_rows().alias("total_trials"),
        F.count_if(F.col("error").isNull()).alias("completed"),
        F.countDistinct("task_id").alias("tasks"),
        F.avg("score").alias("avg_score"),
        F.sum(cost0()).alias("total_cost"),
    )


def report_breakdown(trials) -> DataFrame:
    """by_variant, by_task_type, by_source and grand total as one long table."""
    dims = ["variant_name", "task_type", "source"]
    sets = [[F.col(d)] for d in dims] + [[]]
    out = trials.groupingSets(sets, *dims).agg(
        F.grouping_id(*dims).alias("_g"),
        n_rows().alias("count"),
        F.avg("score").alias("mean_score"),
        F.sum(cost0()).alias("total_cost"),
    )
    name = F.when(F.col("_g") == 3, "variant").when(F.col("_g") == 5, "task_type").when(F.col("_g") == 6, "source")
    return out.select(
        F.coalesce(name, F.lit("all")).alias("dimension"),
        F.coalesce(*dims, F.lit("all")).alias("key"),
        "count",
        "mean_score",
        "total_cost",
    )


# ---- composite -----------------------------------------------------------
def type_means(trials, *group: str) -> DataFrame:
    return trials.groupBy(*(group or ("variant_name",)), "task_type").agg(
        F.avg("score").alias("mean_score"), n_rows().alias("n")
    )


def composite_expr(weights: dict[str, float] | None = None, mean: str = "mean_score") -> Column:
    """Weighted sum of type means on a 0-100 scale; a missing type adds nothing."""
    weights = weights or TYPE_WEIGHTS
    weight = F.element_at(
        F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("task_type")
    )
    return F.sum(F.coalesce(weight, F.lit(0.0)) * F.col(mean)) * 100.0


def composite_score(trials, *group: str, weights=None) -> DataFrame:
    group = group or ("variant_name",)
    means = type_means(trials, *group)
    return means.groupBy(*group).agg(composite_expr(weights).alias("composite"), F.sum("n").alias("trials"))


def weight_sensitivity(trials) -> DataFrame:
    """Composite and rank of each variant under each weighting, with the winner per scheme."""
    means = type_means(trials)
    scored = means.groupBy("variant_name").agg(
        F.array(
            *[
                F.struct(F.lit(name).alias("scheme"), composite_expr(ws).alias("composite"))
                for name, ws in WEIGHT_SCHEMES.items()
            ]
        ).alias("s")
    )
    long = scored.select("variant_name", F.inline("s"))
    w = Window.partitionBy("scheme").orderBy(F.desc("composite"), "variant_name")
    ranked = long.withColumn("rank", F.row_number().over(w))
    top = F.max(F.when(F.col("rank") == 1, F.col("variant_name"))).over(Window.partitionBy("scheme"))
    return ranked.withColumn("winner", top)


def weight_stability(sensitivity) -> DataFrame:
    """One row: is the winner the same under every scheme, and where does it change."""
    winners = sensitivity.where("rank = 1")
    base = F.max(F.when(F.col("scheme") == "default", F.col("variant_name")))
    agg = winners.agg(base.alias("default_winner"), F.collect_list(F.struct("scheme", "variant_name")).alias("w"))
    changed = F.array_sort(
        F.transform(
            F.filter("w", lambda x: x["variant_name"] != F.col("default_winner")), lambda x: x["scheme"]
        )
    )
    return agg.select(
        "default_winner",
        (F.size(changed) == 0).alias("winner_stable"),
        F.array_join(changed, ",").alias("changed_schemes"),
    )


# ---- cross-run history ---------------------------------------------------
def variant_trend(trials, variant: str) -> DataFrame:
    return (
        trials.where(F.col("variant_name") == variant)
        .groupBy("run_id")
        .agg(F.avg("score").alias("avg_score"), F.avg(cost0()).alias("avg_cost"), n_rows().alias("trial_count"))
    )


def cost_trend(trials) -> DataFrame:
    return trials.groupBy("run_id").agg(
        F.sum(cost0()).alias("total_cost"), (F.sum(cost0()) / n_rows()).alias("avg_cost_per_trial")
    )


def model_ranking(trials) -> DataFrame:
    return trials.groupBy("model").agg(
        F.avg("score").alias("avg_score"), n_rows().alias("total_trials"), F.avg(cost0()).alias("avg_cost")
    )


def regressions(trials, baseline: str, comparison: str, threshold: float = REGRESSION_DELTA) -> DataFrame:
    """Variants in both runs whose mean fell by more than ``threshold``: one conditional aggregate."""
    side = lambda run: F.avg(F.when(F.col("run_id") == run, F.col("score")))
    both = (
        trials.where(F.col("run_id").isin(baseline, comparison))
        .groupBy("variant_name")
        .agg(side(baseline).alias("baseline_score"), side(comparison).alias("comparison_score"))
    )
    return both.withColumn("delta", F.col("comparison_score") - F.col("baseline_score")).where(
        F.col("delta") < -threshold
    )


def compare_runs(trials, run_ids) -> DataFrame:
    """Totals per listed run in the listed order with the change of mean to the run before."""
    listed = trials.sparkSession.createDataFrame(
        [(i, r) for i, r in enumerate(run_ids)], "pos long, run_id string"
    )
    agg = trials.where(F.col("run_id").isin(list(run_ids))).groupBy("run_id").agg(
        n_rows().alias("total_trials"),
        F.avg("score").alias("avg_score"),
        F.sum(cost0()).alias("total_cost"),
        F.avg("latency_seconds").alias("avg_latency"),
    )
    zero = {"total_trials": 0, "avg_score": 0.0, "total_cost": 0.0, "avg_latency": 0.0}
    full = listed.join(agg, "run_id", "left").na.fill(zero)
    # one row per listed run: the list is given by the caller, so this window is small
    delta = F.col("avg_score") - F.lag("avg_score").over(Window.orderBy("pos"))
    return full.withColumn("score_delta", F.coalesce(delta, F.lit(0.0)))


def linked_runs(runs) -> DataFrame:
    return (
        runs.where(F.col("chain_id").isNotNull())
        .groupBy("chain_id")
        .agg(n_rows().alias("run_count"), F.max("created_us").alias("last_run_us"))
    )


# ---- cost ----------------------------------------------------------------
def axis_cost_report(trials) -> DataFrame:
    return trials.rollup("variant_name").agg(
        F.countDistinct("task_id").alias("tasks"),
        F.sum(cost0()).alias("total_cost"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
    )


def cost_summary(trials) -> DataFrame:
    return trials.rollup("variant_name").agg(
        n_rows().alias("trials"),
        F.sum(cost0()).alias("total_cost"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
    )


def projected_cost(trials, planned: int, budget: float, pause_factor: float) -> DataFrame:
    agg = trials.groupBy("run_id").agg(n_rows().alias("done"), F.sum(cost0()).alias("spent"))
    projected = F.col("spent") / F.col("done") * planned
    return agg.select(
        "run_id",
        "done",
        "spent",
        projected.alias("projected"),
        (projected > budget).alias("over_budget"),
        (projected > pause_factor * budget).alias("pause"),
    )


# ---- distributions -------------------------------------------------------
def score_buckets(trials) -> DataFrame:
    bucket = F.when(F.col("score") == 0, "zero").when(F.col("score") >= 1, "perfect").otherwise("partial")
    agg = trials.groupBy(bucket.alias("bucket")).agg(
        n_rows().alias("trials"), F.avg("total_tokens").alias("mean_tokens"), F.avg("latency_seconds").alias("mean_latency")
    )
    share = F.col("trials") / F.sum("trials").over(Window.partitionBy())  # three rows
    return agg.withColumn("share", share)


def zeros_ones_by_type(trials) -> DataFrame:
    return trials.groupBy("task_type").agg(
        n_rows().alias("trials"),
        F.count_if(F.col("score") == 0).alias("zeros"),
        F.count_if(F.col("score") >= 1).alias("ones"),
        F.avg("score").alias("mean_score"),
    )


def robustness_range(trials) -> DataFrame:
    means = trials.groupBy("variant_name").agg(F.avg("score").alias("mean_score"))
    spread = F.max("mean_score") - F.min("mean_score")
    return means.agg(
        spread.alias("score_range"),
        F.when(spread > 0.1, "high").otherwise("low").alias("sensitivity"),
        F.max_by("variant_name", F.struct("mean_score", "variant_name")).alias("best_variant"),
    )


def radar_data(trials, types) -> DataFrame:
    return trials.groupBy("model").pivot("task_type", list(types)).avg("score")


def interaction_data(trials, a: str, b: str) -> DataFrame:
    return trials.groupBy(a, b).agg(F.avg("score").alias("mean_score"), n_rows().alias("n"))


def trial_plan(tasks, variants: list[str], repetitions: int) -> DataFrame:
    """Every task under every named variant, 1..N times; names are a short caller-given list."""
    return tasks.select(
        "*",
        F.explode(F.array(*[F.lit(v) for v in variants])).alias("variant_name"),
    ).withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))


def run_progress(tasks, trials, variants: list[str], repetitions: int) -> DataFrame:
    """Planned against distinct finished cells per variant, counted without expanding the plan."""
    planned = tasks.agg((F.countDistinct("task_id") * repetitions).alias("planned"))
    done = (
        trials.where(F.col("variant_name").isin(variants) & (F.col("repetition") <= repetitions))
        .groupBy("variant_name")
        .agg(F.countDistinct("task_id", "repetition").alias("done"))
    )
    names = trials.sparkSession.createDataFrame([(v,) for v in variants], "variant_name string")
    out = names.join(done, "variant_name", "left").select(
        "variant_name", F.coalesce("done", F.lit(0)).alias("done"), planned.scalar().alias("planned")
    )
    return out.withColumn("percent", F.col("done") * 100.0 / F.col("planned"))
