"""Agreement of judges with people and of panels with routine scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.constants import KAPPA_PASS, PANEL_SPREAD, RHO_PASS
from trialspark.operators.ordered import exact_quantiles, frozen, running


def gold_judge_join(gold: DataFrame, judge: DataFrame, seq: str = "seq") -> DataFrame:
    """Inner join on example_id; the last judge row of an example wins."""
    cols = [c for c in judge.columns if c not in ("example_id", seq)]
    last = judge.groupBy("example_id").agg(F.max_by(F.struct(*cols), seq).alias("_j")).select("example_id", "_j.*")
    return gold.join(last, "example_id")


def panel_routine_join(panel: DataFrame, routine: DataFrame) -> DataFrame:
    return panel.join(routine, "example_id")


def panel_aggregate(scores: DataFrame, how: str = "mean") -> DataFrame:
    """Mean or exact median, spread and members per example; members are one row per judge model."""
    members = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("judge_model", "score"))),
            lambda m: F.concat_ws("=", m["judge_model"], F.round(m["score"], 4).cast("string")),
        ),
        ",",
    )
    agg = scores.groupBy("example_id").agg(
        (F.median("score") if how == "median" else F.avg("score")).alias("aggregate"),
        (F.max("score") - F.min("score")).alias("spread"),
        F.count(F.lit(1)).alias("members"),
        members.alias("member_scores"),
    )
    return agg


def panel_disagreements(panel: DataFrame, spread: float = PANEL_SPREAD) -> DataFrame:
    return panel.where(F.col("spread") > spread)


def judge_stats(scores: DataFrame) -> DataFrame:
    return scores.groupBy("judge_model").agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n"))


def _bin(score: Column, bins: int) -> Column:
    return F.least((score * bins).cast("int"), F.lit(bins - 1))


def kappa(df: DataFrame, keys: Sequence[str], a: str, b: str, bins: int = 5) -> DataFrame:
    """Quadratic-weighted kappa from first and second moments of the binned scores."""
    x, y = _bin(F.col(a), bins).cast("double"), _bin(F.col(b), bins).cast("double")
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.pow(x - y, F.lit(2))).alias("_obs"),
        (F.var_pop(x) + F.var_pop(y) + F.pow(F.avg(x) - F.avg(y), F.lit(2))).alias("_exp"),
        ((F.min(x) == F.max(x)) & (F.min(y) == F.max(y))).alias("_flat"),
        (F.avg(x) == F.avg(y)).alias("_same"),
    )
    value = (
        F.when(F.col("n") <= 1, 0.0)
        .when(F.col("_flat"), F.when(F.col("_same"), 1.0).otherwise(0.0))
        .when(F.col("_exp") == 0, 1.0)
        .otherwise(1.0 - F.col("_obs") / F.col("_exp"))
    )
    return agg.select(*keys, "n", value.alias("kappa"))


def _avg_ranks(cells: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Average rank of each distinct value of one coordinate of a collapsed grid."""
    margin = cells.groupBy(*keys, value).agg(F.sum("n").alias("_n"))
    cum = running(margin, keys, [value], {"_cum": F.col("_n")})
    return cum.select(*keys, value, (F.col("_cum") - (F.col("_n") - 1) / 2.0).alias(out))


def collapse(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Distinct (x, y) pairs per key with their multiplicity."""
    return df.groupBy(*keys, F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("n"))


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Pearson correlation of average ranks, weighted over the collapsed grid; degenerate input gives 0."""
    if not keys:
        return spearman(df.withColumn("_all", F.lit(1)), ["_all"], a, b).drop("_all")
    keys = list(keys)
    cells = collapse(df, keys, a, b)
    rx, ry = _avg_ranks(cells, keys, "x", "rx"), _avg_ranks(cells, keys, "y", "ry")
    full = cells.join(rx, [*keys, "x"]).join(ry, [*keys, "y"])
    n, x, y = F.col("n"), F.col("rx"), F.col("ry")
    s = full.groupBy(*keys).agg(
        F.sum(n).alias("n"),
        F.sum(n * x).alias("sx"),
        F.sum(n * y).alias("sy"),
        F.sum(n * x * x).alias("sxx"),
        F.sum(n * y * y).alias("syy"),
        F.sum(n * x * y).alias("sxy"),
    )
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    ok = (F.col("n") > 1) & (vx > 1e-9) & (vy > 1e-9)
    return s.select(*keys, "n", F.when(ok, cov / F.sqrt(vx * vy)).otherwise(0.0).alias("rho"))


def kendall(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Tie-corrected tau without forming pairs.

    Two points are ordered by the first binary digit in which the dense ranks
    of their y differ.  So for every digit, points are grouped by the digits
    above it and walked in x order with running counts of zeros and ones seen
    so far: each point meets counts, never other points.
    """
    if not keys:
        return kendall(df.withColumn("_all", F.lit(1)), ["_all"], a, b).drop("_all")
    keys = list(keys)
    cells = collapse(df, keys, a, b)
    margin_x = cells.groupBy(*keys, "x").agg(F.sum("n").alias("n"))
    margin_y = cells.groupBy(*keys, "y").agg(F.sum("n").alias("n"))
    dense = running(margin_y, keys, ["y"], {"code": F.lit(1).cast("long")})
    top = dense.groupBy(*keys).agg(F.max("code").alias("_top"))
    coded = cells.join(dense.select(*keys, "y", "code").join(top, keys), [*keys, "y"])
    digits = F.greatest(F.lit(1), F.ceil(F.log2(F.col("_top") + 1)).cast("int"))
    spread = coded.select(*keys, "x", "code", "n", F.explode(F.sequence(F.lit(0), digits - 1)).alias("digit"))
    walk = (
        spread.select(
            *keys,
            "x",
            "n",
            "digit",
            F.expr("shiftright(code, digit + 1)").alias("above"),
            F.expr("shiftright(code, digit) & 1").alias("bit"),
        )
        .groupBy(*keys, "digit", "above", "x")
        .agg(
            F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("ones"),
            F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("zeros"),
        )
    )
    seen = running(
        walk, [*keys, "digit", "above"], ["x"], {"_ones": F.col("ones"), "_zeros": F.col("zeros")}
    )
    up = F.col("ones") * (F.col("_zeros") - F.col("zeros"))
    down = F.col("zeros") * (F.col("_ones") - F.col("ones"))
    score = seen.groupBy(*keys).agg(F.sum(up - down).alias("_s"))
    n2 = F.col("n") * (F.col("n") - 1) / 2.0
    tx = margin_x.groupBy(*keys).agg(F.sum(n2).alias("_tx"), F.sum("n").alias("n"))
    ty = margin_y.groupBy(*keys).agg(F.sum(n2).alias("_ty"))
    full = score.join(tx, keys).join(ty, keys)
    total = F.col("n") * (F.col("n") - 1) / 2.0
    base = F.sqrt((total - F.col("_tx")) * (total - F.col("_ty")))
    return full.select(*keys, "n", F.when(base > 0, F.col("_s") / base).otherwise(0.0).alias("tau"))


def mae(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.coalesce(F.avg(F.abs(F.col(a) - F.col(b))), F.lit(0.0)).alias("mae"))


def calibrate(joined: DataFrame, human: str, judge: str, kappa_min=KAPPA_PASS, rho_min=RHO_PASS) -> DataFrame:
    """Overall and per task type: kappa, rho, tau, mae, and whether the type is flagged.

    The joined scores are stored once, as three columns, and read by each of the four statistics.
    """
    scores = frozen(joined.select("task_type", F.col(human).alias("h"), F.col(judge).alias("j")))
    both = scores.select(F.explode(F.array(F.lit("(all)"), F.col("task_type"))).alias("scope"), "h", "j")
    out = kappa(both, ["scope"], "h", "j")
    for part in (spearman(both, ["scope"], "h", "j").drop("n"), kendall(both, ["scope"], "h", "j").drop("n"), mae(both, ["scope"], "h", "j")):
        out = out.join(part, "scope")
    return out.withColumn("flagged", (F.col("kappa") < kappa_min) | (F.col("rho") < rho_min))


def panel_validate(panel: DataFrame, routine: DataFrame, threshold: float = RHO_PASS) -> DataFrame:
    both = panel_routine_join(panel, routine)
    return spearman(both, [], "aggregate", "score").withColumn("passed", F.col("rho") >= threshold)


