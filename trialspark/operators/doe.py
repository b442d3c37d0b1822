"""Designed-experiment analysis: S/N ratios, effects, ANOVA, prediction, factorial effects."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.design import literal_rows
from trialspark.functions import special as sp
from trialspark.functions.special import t_ppf
from trialspark.operators.stats import cell_means, wilcoxon
from trialspark.operators.trials import composite_score

EPS = 1e-10
TINY = 1e-30


def sn_expr(kind: str, y: Column) -> Column:
    """Aggregate expression of the signal-to-noise ratio in dB."""
    if kind == "larger_is_better":
        return -10.0 * F.log10(F.avg(1.0 / (y * y + EPS)))
    if kind == "smaller_is_better":
        return -10.0 * F.log10(F.greatest(F.avg(y * y), F.lit(EPS)))
    if kind == "nominal_is_best":
        return F.when(F.var_pop(y) < TINY, 100.0).otherwise(10.0 * F.log10(F.avg(y) * F.avg(y) / F.var_pop(y)))
    raise ValueError(f"unknown quality type {kind}")


def sn_ratios(trials: DataFrame, family: Sequence[str] = (), kind: str = "larger_is_better") -> DataFrame:
    """One row per design row (and family): at most 81 per family whatever the number of trials."""
    return trials.groupBy(*family, F.col("oa_row_id").alias("run_id")).agg(sn_expr(kind, F.col("score")).alias("sn"))


def scores_to_design(trials: DataFrame, design: DataFrame) -> DataFrame:
    """Factor levels attached to every trial; Spark broadcasts the design if it is small."""
    return trials.join(design, trials["oa_row_id"] == design["run_id"]).drop(design["run_id"])


def main_effects(sn: DataFrame, design: DataFrame, levels: DataFrame, family: Sequence[str] = ()) -> DataFrame:
    """Mean S/N per factor level; a level no run uses gets 0. ``levels``: factor, level, level_pos."""
    fam = list(family)
    used = (
        sn.join(design, "run_id")
        .groupBy(*fam, "factor", "level")
        .agg(F.avg("sn").alias("mean_sn"), F.count(F.lit(1)).alias("runs"))
    )
    if fam:
        families = sn.select(*fam).distinct()
        every = families.select(*fam, F.explode(levels.agg(F.collect_list(F.struct("factor", "level", "level_pos"))).scalar()).alias("l")).select(*fam, "l.*")
    else:
        every = levels
    return every.join(used, [*fam, "factor", "level"], "left").na.fill(0.0, ["mean_sn"]).na.fill(0, ["runs"])


def response_table(effects: DataFrame, family: Sequence[str] = ()) -> DataFrame:
    fam = list(family)
    delta = effects.groupBy(*fam, "factor").agg((F.max("mean_sn") - F.min("mean_sn")).alias("delta"))
    w = Window.partitionBy(*fam).orderBy(F.desc("delta"), "factor")  # one row per factor
    return delta.withColumn("rank", F.row_number().over(w))


def anova(sn: DataFrame, effects: DataFrame, family: Sequence[str] = (), p_values: bool = True) -> DataFrame:
    """One-way decomposition per factor with a clamped error term."""
    fam = list(family)
    totals = sn.groupBy(*fam).agg(
        F.count("sn").alias("n"), F.avg("sn").alias("grand"), (F.var_pop("sn") * F.count("sn")).alias("ss_total")
    )
    if not fam:
        effects, totals, fam = effects.withColumn("_f", F.lit(1)), totals.withColumn("_f", F.lit(1)), ["_f"]
    per = (
        effects.join(totals, fam)
        .groupBy(*fam, "factor")
        .agg(
            F.sum(F.col("runs") * F.pow(F.col("mean_sn") - F.col("grand"), F.lit(2))).alias("ss"),
            (F.count(F.lit(1)) - 1).alias("df"),
        )
    )
    error = (
        per.groupBy(*fam)
        .agg(F.sum("ss").alias("_ss"), F.sum("df").alias("_df"))
        .join(totals, fam)
        .select(
            *fam,
            "ss_total",
            F.greatest(F.col("ss_total") - F.col("_ss"), F.lit(0.0)).alias("ss_error"),
            F.greatest(F.col("n") - 1 - F.col("_df"), F.lit(1)).alias("df_error"),
        )
        .withColumn("ms_error", F.col("ss_error") / F.col("df_error"))
    )
    ms = F.when(F.col("df") > 0, F.col("ss") / F.col("df")).otherwise(0.0)
    noise, total = F.col("ms_error") > TINY, F.col("ss_total") > TINY
    base = F.col("ss_total") + F.col("ms_error")
    out = per.join(error, fam).withColumn("ms", ms).withColumns(
        {
            "f_ratio": F.when(noise, F.col("ms") / F.col("ms_error")).otherwise(
                F.when(F.col("ms") > TINY, F.lit(float("inf"))).otherwise(0.0)
            ),
            "eta_squared": F.when(total, F.col("ss") / F.col("ss_total")).otherwise(0.0),
            "omega_squared": F.when(
                base > TINY, F.greatest(F.lit(0.0), (F.col("ss") - F.col("df") * F.col("ms_error")) / base)
            ).otherwise(0.0),
            "error_eta_squared": F.when(total, F.col("ss_error") / F.col("ss_total")).otherwise(0.0),
        }
    )
    if p_values:
        p = sp.F_SF(F.col("f_ratio"), F.col("df"), F.col("df_error"))
        out = out.withColumn("p_value", F.when(~noise & (F.col("ms") <= TINY), 1.0).otherwise(p))
    return out.drop("_f")


def predict_optimal(effects: DataFrame, family: Sequence[str] = ()) -> DataFrame:
    """Best level per factor and the additive prediction around the unweighted mean of level means."""
    fam = list(family)
    best = F.max_by("level", F.struct("mean_sn", -F.col("level_pos")))
    per = effects.groupBy(*fam, "factor").agg(
        best.alias("level"), F.max("mean_sn").alias("best"), F.avg("mean_sn").alias("mid"),
        F.sum("mean_sn").alias("total"), F.count(F.lit(1)).alias("levels"),
    )
    chosen = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("factor", "level"))), lambda x: F.concat_ws("=", x["factor"], x["level"])), "+"
    )
    return per.groupBy(*fam).agg(
        chosen.alias("optimal"),
        (F.sum("total") / F.sum("levels") + F.sum(F.col("best") - F.col("mid"))).alias("predicted_sn"),
    )


def prediction_interval(sn: DataFrame, optimal: DataFrame, family: Sequence[str] = ()) -> DataFrame:
    """Adds se and a t interval when more than two rows vary."""
    fam = list(family)
    spread = sn.groupBy(*fam).agg(F.count("sn").alias("_n"), (F.stddev_samp("sn") / F.sqrt(F.count("sn"))).alias("se"))
    if not fam:
        one = spread.select(F.struct("*").alias("s")).scalar()
        both = optimal.withColumn("_s", one).select("*", "_s.*").drop("_s")
    else:
        both = optimal.join(spread, fam)
    usable = (F.col("_n") > 2) & (F.col("se") > 0)
    margin = sp.T_PPF(F.lit(0.975), F.when(usable, F.col("_n") - 1)) * F.col("se")
    return both.withColumns(
        {"ci_low": F.col("predicted_sn") - margin, "ci_high": F.col("predicted_sn") + margin}
    ).drop("_n")


def validate_confirmation(observed: DataFrame, prediction: DataFrame, family: Sequence[str] = (), interval: bool = True) -> DataFrame:
    """Observed against predicted S/N; without an interval the check is +-1 dB and se is 1."""
    fam = list(family)
    both = observed.join(prediction, fam)
    low = F.col("ci_low") if interval else F.lit(None).cast("double")
    high = F.col("ci_high") if interval else F.lit(None).cast("double")
    se = F.coalesce(F.col("se") if interval else F.lit(None).cast("double"), F.lit(1.0))
    low, high = F.coalesce(low, F.col("predicted_sn") - 1.0), F.coalesce(high, F.col("predicted_sn") + 1.0)
    return both.select(
        *fam,
        "observed_sn",
        "predicted_sn",
        F.col("observed_sn").between(low, high).alias("within_interval"),
        ((F.col("observed_sn") - F.col("predicted_sn")) / se).alias("sigma_deviation"),
    )


def significant_factors(table: DataFrame, family: Sequence[str] = (), alpha: float = 0.05, k: int = 3) -> DataFrame:
    w = Window.partitionBy(*family).orderBy(F.desc("omega_squared"), "factor")
    hits = table.where(F.col("p_value") < alpha)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def refinement_plan(tasks: DataFrame, top: dict[str, list[str]], optimum: dict[str, str], reps: int) -> DataFrame:
    """Every level combination of the top factors, the rest at their optimum, for every task and repetition."""
    out = tasks.withColumns({f: F.lit(level) for f, level in optimum.items() if f not in top})
    for factor, levels in top.items():
        out = out.withColumn(factor, F.explode(F.array(*[F.lit(x) for x in levels])))
    return out.withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(reps))))


# ---- two-level factorials ------------------------------------------------
def effect_signs(spark, design: list[tuple]) -> DataFrame:
    """Signs of main and two-way effects per run, after checking that columns are independent."""
    runs = sorted({r for r, *_ in design})
    factors = list(dict.fromkeys(f for _, f, *_ in design))
    if len(factors) < 2:
        raise ValueError("at least two factors are needed")
    code = {(r, f): c for r, f, _, c in design}
    matrix = np.array([[code[r, f] for f in factors] for r in runs], dtype=float)
    if np.linalg.matrix_rank(matrix) < len(factors):
        raise ValueError("design columns are linearly dependent")
    rows = []
    for i, f in enumerate(factors):
        rows += [(r, f, 1, int(code[r, f])) for r in runs]
        for g in factors[i + 1 :]:
            rows += [(r, f"{f}:{g}", 0, int(code[r, f] * code[r, g])) for r in runs]
    return literal_rows(spark, rows, "run_id, effect, is_main, sign").withColumn("is_main", F.col("is_main") == 1)


def factorial_effects(responses: DataFrame, signs: DataFrame, family: Sequence[str] = ()) -> DataFrame:
    """Effect = 2/n * sum(sign * y); ``responses`` holds one y per run (and family)."""
    return (
        responses.join(signs, "run_id")
        .groupBy(*family, "effect", "is_main")
        .agg((F.sum(F.col("sign") * F.col("y")) * 2.0 / F.count(F.lit(1))).alias("estimate"))
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _lenth_udf(effects: pd.Series, alpha: pd.Series) -> pd.Series:
    rows = []
    for values, a in zip(effects, alpha):
        size = np.abs(np.asarray(values, dtype=float))
        k, rest, pse = len(size), size, 0.0
        for _ in range(50):
            pse = 1.5 * float(np.median(rest))
            kept = rest[rest <= 2.5 * pse]
            if pse == 0.0 or len(kept) in (0, len(rest)):
                break
            rest = kept
        df = max(k / 3.0, 1.0)
        joint = (1.0 + 0.95 ** (1.0 / k)) / 2.0
        rows.append([pse, t_ppf(1.0 - a / 2.0, df) * pse, t_ppf(joint, df) * pse])
    return pd.Series(rows)


def lenth(effects: DataFrame, family: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Pseudo standard error and margins per family; a family has one row per effect of its design."""
    fam = list(family)
    per = effects.groupBy(*fam).agg(F.collect_list("estimate").alias("_e"))
    margins = per.withColumn("_m", _lenth_udf("_e", F.lit(alpha))).select(
        *fam, F.col("_m")[0].alias("pse"), F.col("_m")[1].alias("me"), F.col("_m")[2].alias("sme")
    )
    out = effects.join(margins, fam)
    return out.withColumn("significant", (F.abs("estimate") > F.col("me")) & (F.col("pse") > 0))


def half_normal(effects: DataFrame, family: Sequence[str]) -> DataFrame:
    fam = list(family)
    size = F.abs("estimate")
    w = Window.partitionBy(*fam)
    i = F.row_number().over(w.orderBy(size, "effect"))
    n = F.count(F.lit(1)).over(w)
    return effects.select(
        *fam, "effect", size.alias("absolute_effect"), sp.norm_ppf((i - 0.5 + n) / (2.0 * n)).alias("expected_quantile")
    )


def parse_combination(name: Column) -> Column:
    """'a=x+b=y' as a map, any other name as {combination: name}."""
    trimmed = F.transform(F.split(name, r"\+"), lambda p: F.split(p, "=", 2))
    entries = F.transform(trimmed, lambda p: F.struct(F.trim(p[0]).alias("k"), F.trim(p[1]).alias("v")))
    later = lambda e, i: F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["k"] == e["k"])
    last = F.filter(entries, lambda e, i: ~later(e, i))  # a factor named twice keeps its last level
    return F.when(name.rlike(r"^[^+=]*=[^+]*(\+[^+=]*=[^+]*)*$"), F.map_from_entries(last)).otherwise(
        F.create_map(F.lit("combination"), name)
    )


# ---- selection -----------------------------------------------------------
def versus(trials: DataFrame, family: Sequence[str], opponents: DataFrame) -> DataFrame:
    """Pairs of every variant with its family's opponent over common (task, repetition) cells.

    ``opponents``: family columns and ``opponent`` (one row per family).
    """
    fam = list(family)
    cells = cell_means(trials, *fam, "variant_name")
    theirs = cells.join(opponents, fam).where(F.col("variant_name") == F.col("opponent")).select(
        *fam, "task_id", "repetition", F.col("score").alias("score_b"), "opponent"
    )
    return (
        cells.withColumnRenamed("score", "score_a")
        .join(theirs, [*fam, "task_id", "repetition"])
        .where(F.col("variant_name") != F.col("opponent"))
    )


def select_beam(trials: DataFrame, family: Sequence[str], width: int = 3, alpha: float = 0.10, min_pairs: int = 5) -> DataFrame:
    """Per axis: the best ``width`` stay; the next ``width`` stay unless significantly below the best."""
    fam = list(family)
    w = Window.partitionBy(*fam).orderBy(F.desc("composite"), "variant_name")
    ranked = composite_score(trials, *fam, "variant_name").withColumn("rank", F.row_number().over(w))
    best = ranked.where("rank = 1").select(*fam, F.col("variant_name").alias("opponent"))
    tests = wilcoxon(versus(trials, fam, best), [*fam, "variant_name"], alpha).select(
        *fam, "variant_name", "pairs", "p_value", F.col("significant").alias("_sig")
    )
    out = ranked.where(F.col("rank") <= 2 * width).join(tests, [*fam, "variant_name"], "left")
    tested = F.coalesce(F.col("pairs") >= min_pairs, F.lit(False))
    parity = F.when(tested & (F.col("rank") > 1), ~F.col("_sig"))
    kept = (F.col("rank") <= width) | ~tested | F.coalesce(parity, F.lit(False))
    return out.withColumns({"within_parity": parity, "retained": kept}).drop("_sig")


def detect_override(trials: DataFrame, family: Sequence[str], winner: str, alpha: float = 0.05, min_reps: int = 5) -> DataFrame:
    """Best combination above the sequential winner; enough replicates on both sides require significance."""
    fam = list(family)
    scored = composite_score(trials, *fam, "variant_name")
    mine = scored.where(F.col("variant_name") == winner).select(
        *fam, F.col("composite").alias("winner_score"), F.col("trials").alias("_wn")
    )
    opponents = mine.select(*fam).withColumn("opponent", F.lit(winner))
    tests = wilcoxon(versus(trials, fam, opponents), [*fam, "variant_name"], alpha).select(
        *fam, "variant_name", "p_value", "significant"
    )
    both = scored.join(mine, fam).join(tests, [*fam, "variant_name"], "left")
    enough = (F.col("trials") >= min_reps) & (F.col("_wn") >= min_reps)
    beats = (F.col("composite") > F.col("winner_score")) & (~enough | F.coalesce("significant", F.lit(False)))
    best = F.max_by(
        F.struct("variant_name", "composite", F.when(enough, F.col("p_value")).alias("p")),
        F.when(beats, F.struct(F.col("composite"), F.col("variant_name"))),
    )
    return both.groupBy(*fam).agg(F.max("winner_score").alias("winner_score"), best.alias("_b")).select(
        *fam,
        "winner_score",
        F.col("_b").isNotNull().alias("override_detected"),
        F.col("_b.variant_name").alias("best_combination"),
        F.coalesce(F.col("_b.composite"), F.col("winner_score")).alias("best_score"),
        F.col("_b.p").alias("p_value"),
    )


def framing_join(trials: DataFrame, constant: Column, adapted: Column) -> DataFrame:
    """Composite per variant under both framings, variants common to both."""
    framed = trials.withColumn("framing", F.when(constant, "constant").when(adapted, "adapted")).where("framing IS NOT NULL")
    c = composite_score(framed, "framing", "variant_name")
    side = lambda f: c.where(F.col("framing") == f).select("variant_name", F.col("composite").alias(f), F.col("trials").alias(f"{f}_trials"))
    return side("constant").join(side("adapted"), "variant_name").withColumn(
        "score_difference", F.col("adapted") - F.col("constant")
    )


def compare_framings(trials: DataFrame, constant: Column, adapted: Column, alpha: float = 0.05, min_effect: float = 0.1) -> DataFrame:
    framed = trials.withColumn("framing", F.when(constant, "constant").when(adapted, "adapted")).where("framing IS NOT NULL")
    cells = cell_means(framed, "framing", "variant_name")
    pairs = cells.groupBy("variant_name", "task_id", "repetition").agg(
        F.max(F.when(F.col("framing") == "constant", F.col("score"))).alias("score_a"),
        F.max(F.when(F.col("framing") == "adapted", F.col("score"))).alias("score_b"),
    ).where("score_a IS NOT NULL AND score_b IS NOT NULL")
    tests = wilcoxon(pairs, ["variant_name"], alpha).select("variant_name", "pairs", "p_value", "significant")
    both = framing_join(trials, constant, adapted).join(tests, "variant_name", "left")
    clear = F.coalesce((F.col("pairs") >= 5) & F.col("significant"), F.lit(False)) & (F.abs("score_difference") >= min_effect)
    better = F.when(clear & (F.col("score_difference") > 0), "adapted").when(clear, "constant").otherwise("no_difference")
    return both.withColumn("better_framing", better)


def framing_report(comparisons: DataFrame) -> DataFrame:
    won = lambda f: F.count_if(F.col("better_framing") == f)
    agg = comparisons.agg(
        won("constant").alias("favoring_constant"), won("adapted").alias("favoring_adapted"),
        won("no_difference").alias("no_difference"), F.avg("score_difference").alias("mean_difference"),
    )
    a, c = F.col("favoring_adapted"), F.col("favoring_constant")
    return agg.withColumn("overall", F.when(a > c, "adapted").when(c > a, "constant").otherwise("mixed"))


def token_efficiency(trials: DataFrame, baseline: str) -> DataFrame:
    """Composite per 1,000 index tokens, ratio to the baseline's tokens, tokens per composite point gained."""
    scored = composite_score(trials).drop("trials")
    size = trials.groupBy("variant_name").agg(F.avg("prompt_tokens").alias("index_tokens"))
    both = scored.join(size, "variant_name")
    base = both.where(F.col("variant_name") == baseline).select(F.struct("composite", "index_tokens").alias("b")).scalar()
    x = both.withColumn("_b", base)
    gain = F.col("composite") - F.col("_b.composite")
    return x.select(
        "variant_name",
        "composite",
        "index_tokens",
        (F.col("composite") / (F.col("index_tokens") / 1000.0)).alias("density"),
        (F.col("composite") / (F.col("index_tokens") / F.col("_b.index_tokens"))).alias("efficiency_ratio"),
        F.when(gain != 0, (F.col("index_tokens") - F.col("_b.index_tokens")) / gain).alias("marginal_cost"),
    )


def sentinel_drift(sentinels: DataFrame, per_side: int = 10, limit: float = 0.05) -> DataFrame:
    """Mean of the first and last ``per_side`` sentinel trials per run and model, and their gap."""
    keys = ["run_id", "model"]
    edge = lambda order: Window.partitionBy(*keys).orderBy(*order)
    first = sentinels.withColumn("_i", F.row_number().over(edge(["ts_us", "trial_id"]))).where(F.col("_i") <= per_side)
    last = sentinels.withColumn("_i", F.row_number().over(edge([F.desc("ts_us"), F.desc("trial_id")]))).where(F.col("_i") <= per_side)
    mean = lambda d, n: d.groupBy(*keys).agg(F.avg("score").alias(n))
    both = mean(first, "start_score").join(mean(last, "end_score"), keys)
    gap = F.abs(F.col("end_score") - F.col("start_score"))
    return both.withColumn("drift", gap).withColumn("flagged", gap > limit)
