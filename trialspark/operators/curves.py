"""Learning curves, ranking stability and multiple-test corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialspark.constants import (
    SATURATION_MIN_TASKS,
    SATURATION_RANGE,
    SATURATION_STEP,
    TYPE_WEIGHTS,
)
from trialspark.operators.ordered import ordinals, previous, running


def learning_curve(
    trials: DataFrame,
    step: int = SATURATION_STEP,
    min_tasks: int = SATURATION_MIN_TASKS,
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Composite over the first n tasks of each variant, n = min_tasks, +step, ..., all.

    Tasks count in order of their first trial.  Trials are reduced to one row
    per (variant, task), then to one row per checkpoint, so the running sums
    touch neither raw trials nor a whole variant in one task.
    """
    weight = F.element_at(
        F.create_map(*[F.lit(x) for kv in (weights or TYPE_WEIGHTS).items() for x in kv]), F.col("task_type")
    )
    cells = trials.groupBy("variant_name", "task_id", "task_type").agg(
        F.min("trial_id").alias("first"), F.sum("score").alias("s"), F.count("score").alias("n")
    )
    tasks = cells.groupBy("variant_name", "task_id").agg(
        F.min("first").alias("first"), F.collect_list(F.struct("task_type", "s", "n")).alias("types")
    )
    placed = ordinals(tasks, ["variant_name"], ["first"], "pos")
    totals = placed.groupBy("variant_name").agg(F.max("pos").alias("tasks"))
    over = F.greatest(F.ceil((F.col("pos") - min_tasks) / step) * step, F.lit(0)) + min_tasks
    steps = (
        placed.join(totals, "variant_name")
        .select("variant_name", F.least(over, "tasks").alias("task_count"), F.inline("types"))
        .groupBy("variant_name", "task_type", "task_count")
        .agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    )
    # a type's share of the composite moves only where the type gains tasks, so the
    # composite is the running sum of those moves and no type has to be carried forward
    cum = running(
        steps, ["variant_name", "task_type"], ["task_count"], {"cs": F.col("s"), "cn": F.col("n")}
    )
    before = F.when(F.col("cn") > F.col("n"), (F.col("cs") - F.col("s")) / (F.col("cn") - F.col("n")))
    move = F.coalesce(weight, F.lit(0.0)) * (F.col("cs") / F.col("cn") - F.coalesce(before, F.lit(0.0)))
    moves = cum.groupBy("variant_name", "task_count").agg(F.sum(move).alias("move"), F.sum("n").alias("n"))
    out = running(moves, ["variant_name"], ["task_count"], {"c": F.col("move"), "trials": F.col("n")})
    return out.select("variant_name", "task_count", (F.col("c") * 100.0).alias("composite"), "trials")


def saturation_point(curve: DataFrame, threshold: float = SATURATION_RANGE, tail: float = 0.2) -> DataFrame:
    """Per variant: tail range, whether it is flat, and the first point whose whole rest is flat."""
    placed = ordinals(curve, ["variant_name"], ["task_count"], "_i")
    rest = running(placed, ["variant_name"], ["task_count"], {"_hi": F.col("composite")}, "max", reverse=True)
    rest = running(rest, ["variant_name"], ["task_count"], {"_lo": F.col("composite")}, "min", reverse=True)
    sizes = curve.groupBy("variant_name").agg(F.count(F.lit(1)).alias("points"))
    spread = F.col("_hi") - F.col("_lo")
    start = F.greatest(F.lit(1), F.floor(F.col("points") * (1 - tail)))
    at_tail = F.max(F.when(F.col("_i") == start + 1, spread))
    out = (
        rest.join(sizes, "variant_name")
        .groupBy("variant_name")
        .agg(
            F.max("points").alias("points"),
            at_tail.alias("tail_range"),
            F.min(F.when(spread <= threshold, F.col("task_count"))).alias("_first"),
        )
    )
    enough = F.col("points") >= 3
    flat = enough & (F.col("tail_range") <= threshold)
    return out.select(
        "variant_name",
        "points",
        F.when(enough, F.col("tail_range")).otherwise(F.lit(float("inf"))).alias("tail_range"),
        flat.alias("saturated"),
        F.when(flat, F.col("_first")).alias("saturation_point"),
    )


def carry_forward(curve: DataFrame, value: str = "composite") -> DataFrame:
    """Each variant's latest value at every checkpoint seen by any variant.

    The grid is checkpoints x variants; variants form one short array because
    they are a registered list, and the carry runs in slices per variant.
    """
    names = curve.agg(F.array_sort(F.collect_set("variant_name")).alias("v")).scalar()
    grid = curve.select("task_count").distinct().select("task_count", F.explode(names).alias("variant_name"))
    full = grid.join(curve.select("variant_name", "task_count", value), ["variant_name", "task_count"], "left")
    seen = F.when(F.col(value).isNotNull(), F.struct("task_count", value))
    out = running(full, ["variant_name"], ["task_count"], {"_seen": seen}, "max")
    return out.where(F.col("_seen").isNotNull()).select(
        "variant_name", "task_count", F.col("_seen")[value].alias(value)
    )


def ranking_stability(curve: DataFrame) -> DataFrame:
    """Ranking per checkpoint and whether it differs from the checkpoint before."""
    w = Window.partitionBy("task_count").orderBy(F.desc("composite"), "variant_name")
    ranked = carry_forward(curve).withColumn("rank", F.row_number().over(w))
    maps = ranked.groupBy("task_count").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "variant_name"))), lambda x: x["variant_name"]),
            ">",
        ).alias("ranking")
    )
    out = previous(maps, [], ["task_count"], F.col("ranking"), "_was")
    changed = F.coalesce(F.col("_was") != F.col("ranking"), F.lit(False))
    return out.select("task_count", "ranking", changed.alias("ranking_changed"))


def saturation_report(curve: DataFrame, tail: float = 0.2) -> DataFrame:
    """One row: all variants flat, the latest saturation point, and a quiet ranking tail."""
    points = saturation_point(curve)
    stable = ordinals(ranking_stability(curve), [], ["task_count"], "_i")
    size = stable.agg(F.count(F.lit(1))).scalar()
    start = F.greatest(F.lit(1), F.floor(size * (1 - tail)))
    changes = stable.where(F.col("_i") > start).agg(F.count_if("ranking_changed")).scalar()
    return points.agg(
        F.min("saturated").alias("all_saturated"),
        F.max("saturation_point").alias("latest_point"),
        F.count(F.lit(1)).alias("variants"),
    ).select(
        F.col("all_saturated"),
        F.when(F.col("all_saturated"), F.col("latest_point")).alias("recommended_tasks"),
        "variants",
        (changes == 0).alias("ranking_stable"),
        (F.col("all_saturated") & (changes == 0)).alias("overall_saturated"),
    )


# ---- corrections ---------------------------------------------------------
def holm(tests: DataFrame, family: list[str], order: list[str], p: str = "p_value", alpha: float = 0.05):
    """Step-down corrected p per family; ties in p keep ``order``."""
    m = tests.groupBy(*family).agg(F.count(F.lit(1)).alias("_m"))
    placed = ordinals(tests, family, [p, *order], "_rank").join(m, family)
    raw = F.least(F.col(p) * (F.col("_m") - F.col("_rank") + 1), F.lit(1.0))
    out = running(placed.withColumn("_raw", raw), family, ["_rank"], {"corrected_p": F.col("_raw")}, "max")
    return out.withColumn("significant", F.col("corrected_p") < alpha).drop("_m", "_rank", "_raw")


def benjamini_hochberg(tests: DataFrame, family: list[str], order: list[str], p: str = "p_value", alpha: float = 0.05):
    """Step-up corrected p per family, monotone from the largest p down."""
    m = tests.groupBy(*family).agg(F.count(F.lit(1)).alias("_m"))
    placed = ordinals(tests, family, [p, *order], "_rank").join(m, family)
    raw = F.least(F.col(p) * F.col("_m") / F.col("_rank"), F.lit(1.0))
    out = running(
        placed.withColumn("_raw", raw), family, ["_rank"], {"corrected_p": F.col("_raw")}, "min", reverse=True
    )
    return out.withColumn("significant", F.col("corrected_p") <= alpha).drop("_m", "_rank", "_raw")
