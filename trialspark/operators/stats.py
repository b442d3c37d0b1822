"""Tests, intervals and effect sizes over grouped trials.

Every test first reduces its input to value counts, ranks or sums; pairs of
groups are formed on those reduced rows, and tail probabilities are computed
once per resulting row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.functions import special as sp
from trialspark.functions.special import norm_cdf, norm_ppf_scalar, norm_sf
from trialspark.operators.ordered import (
    exact_quantiles,
    ordinals,
    ranked_values,
    running_totals,
    value_counts,
)
from trialspark.session import frozen


def group_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.coalesce(F.var_samp(value), F.lit(0.0)).alias("var"),
    )


def group_pairs(stats: DataFrame, family: Sequence[str], name: str) -> DataFrame:
    """Unordered pairs of reduced group rows inside a family, columns suffixed _a and _b.

    ``stats`` has one row per registered group, so a family is a short array
    and its pairs are unfolded from it without any join.
    """
    family = list(family)
    rest = [name, *[c for c in stats.columns if c not in (*family, name)]]
    arrays = stats.groupBy(*family).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("_g"))
    later = lambda i: F.slice("_g", i + 2, F.size("_g"))
    pairs = F.flatten(
        F.transform("_g", lambda x, i: F.transform(later(i), lambda y: F.struct(x.alias("x"), y.alias("y"))))
    )
    return arrays.select(*family, F.explode(pairs).alias("_p")).select(
        *family, *[F.col(f"_p.{side}.{c}").alias(f"{c}_{tag}") for side, tag in (("x", "a"), ("y", "b")) for c in rest]
    )


# ---- paired tests --------------------------------------------------------
def cell_means(trials: DataFrame, *group: str) -> DataFrame:
    """Mean score per (group, task, repetition), rounded so that equal means tie."""
    return trials.groupBy(*group, "task_id", "repetition").agg(F.round(F.avg("score"), 9).alias("score"))


def paired_trials(trials: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """One row per (task, repetition) run under both groups."""
    cells = cell_means(trials.where(F.col(group).isin(a, b)), group)
    wide = cells.groupBy("task_id", "repetition").agg(
        F.max(F.when(F.col(group) == a, F.col("score"))).alias("score_a"),
        F.max(F.when(F.col(group) == b, F.col("score"))).alias("score_b"),
    )
    return wide.where(F.col("score_a").isNotNull() & F.col("score_b").isNotNull())


def all_pairs(trials: DataFrame, group: str, family: Sequence[str] = ()) -> DataFrame:
    """Paired scores of every pair of groups; a cell holds at most one row per registered group."""
    family = list(family)
    pairs = group_pairs(cell_means(trials, *family, group), [*family, "task_id", "repetition"], group)
    return pairs.withColumnsRenamed({f"{group}_a": "a", f"{group}_b": "b"})


def wilcoxon(pairs: DataFrame, keys: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Signed-rank test per key over ``score_a``/``score_b``.

    Differences collapse once to (key, d) with their counts; ranks come from
    running counts over the distinct magnitudes.
    """
    keys = list(keys)
    d = F.round(F.col("score_a") - F.col("score_b"), 9)
    diffs = frozen(pairs.groupBy(*keys, d.alias("d")).agg(F.count(F.lit(1)).alias("n")))
    count_where = lambda hit: F.sum(F.when(hit, F.col("n")).otherwise(0))
    totals = diffs.groupBy(*keys).agg(
        F.sum("n").alias("pairs"), count_where(F.col("d") == 0).alias("zeros"), (F.sum(F.col("d") * F.col("n")) / F.sum("n")).alias("mean_difference")
    )
    mags = (
        diffs.where(F.col("d") != 0)
        .groupBy(*keys, F.abs("d").alias("mag"))
        .agg(count_where(F.col("d") > 0).alias("pos"), F.sum("n").alias("n"))
    )
    ranked = ranked_values(None, keys, "mag", extra=mags)
    sums = ranked.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("rank") * F.col("pos")).alias("w_plus"),
        F.sum(F.col("rank") * (F.col("n") - F.col("pos"))).alias("w_minus"),
        F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("ties"),
    )
    full = totals.join(sums, keys, "left").na.fill(0, ["n", "ties"]).na.fill(0.0, ["w_plus", "w_minus"])
    stat = F.least("w_plus", "w_minus")
    denom = F.col("n") * (F.col("n") + 1) / 2.0
    return full.select(
        *keys,
        "pairs",
        "n",
        "mean_difference",
        stat.alias("statistic"),
        F.when(F.col("n") > 0, 1.0 - 2.0 * stat / denom).otherwise(0.0).alias("effect_size"),
        F.when(F.col("n") == 0, 1.0)
        .otherwise(sp.SIGNED_RANK_P(F.col("w_plus"), F.col("n"), F.col("zeros"), F.col("ties")))
        .alias("p_value"),
    ).withColumn("significant", F.col("p_value") < alpha)


# ---- bootstrap -----------------------------------------------------------
SLICE_VALUES = 4096


def _seed(*parts) -> np.random.Generator:
    digest = hashlib.sha256(repr(parts).encode()).digest()
    return np.random.default_rng(int.from_bytes(digest[:16], "big"))


def bootstrap_ci(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    n_resamples: int = 10_000,
    confidence: float = 0.95,
    features: Sequence[Callable] = (lambda x: x,),
    finish: Callable = lambda n, sums: sums[0] / n,
    seed: int = 42,
) -> DataFrame:
    """BCa interval per key of a statistic ``finish(n, [sum f1(x), sum f2(x), ...])``.

    Rows collapse to value counts.  A resample is a multinomial draw over the
    distinct values, hashed into slices of a few thousand.  The slices are the
    leaves of a binary tree; at each node a binomial draw, seeded by the node,
    splits the rows between both sides.  A slice walks only the nodes above
    it, then draws its own share.  Together that is exactly one multinomial
    resample, and what a task holds grows with the depth of the tree only.
    """
    if n_resamples < 100:
        raise ValueError("at least 100 resamples are needed")
    keys, feats = list(keys), list(features)
    counts = frozen(value_counts(df, keys, value).withColumnRenamed(value, "_x"))
    key_type = ", ".join(f"`{k}` {counts.schema[k].dataType.simpleString()}" for k in keys)
    sizes = counts.groupBy(*keys).agg(
        F.sum("n").alias("_total"),
        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / SLICE_VALUES)).alias("_slices"),
        F.min("_x").alias("_lo"),
        F.max("_x").alias("_hi"),
    )
    cut = counts.join(sizes.select(*keys, "_slices"), keys).select(
        *keys, "_x", "n", F.pmod(F.xxhash64("_x"), F.col("_slices")).alias("_slice")
    )
    per_slice = cut.groupBy(*keys, "_slice").agg(F.sum("n").alias("_c"))
    # a slice's node at level l is its number without the last l bits
    depth = F.length(F.bin(F.col("_slices") - 1))
    levels = per_slice.join(sizes.select(*keys, "_slices"), keys).select(*keys, "_slice", "_c", F.explode(F.sequence(F.lit(1), depth)).alias("_level"))
    above = levels.withColumns({"_node": F.expr("shiftright(_slice, _level)"), "_left": F.expr("shiftright(_slice, _level - 1) % 2 = 0")})
    nodes = above.groupBy(*keys, "_level", "_node").agg(F.sum("_c").alias("_all"), F.sum(F.when(F.col("_left"), F.col("_c")).otherwise(0)).alias("_first"))
    way = F.sort_array(F.collect_list(F.struct("_level", "_node", "_all", "_first", "_left")), asc=False)
    mine = {k: f"_p_{k}" for k in [*keys, "_slice"]}
    plan = above.join(nodes, [*keys, "_level", "_node"]).groupBy(*keys, "_slice").agg(way.alias("_way")).select(
        *[F.col(k).alias(p) for k, p in mine.items()], *[F.col(f"_way.{c}").alias(c) for c in ("_level", "_node", "_all", "_first", "_left")]
    )
    k = len(feats)
    sums_type = ", ".join(f"s{i} double" for i in range(k))

    def draw(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        group, slice_id = key[:-1], key[-1]
        mine = np.full(n_resamples, int(left["_all"].iloc[0][0]))
        for level, node, every, first, on_left in zip(*[left[c].iloc[0] for c in ("_level", "_node", "_all", "_first", "_left")]):
            drawn_left = _seed(seed, group, int(level), int(node)).binomial(mine, first / every)
            mine = drawn_left if on_left else mine - drawn_left
        right = right.sort_values("_x")
        x, n = right["_x"].to_numpy(), right["n"].to_numpy(dtype=float)
        table = np.column_stack([np.broadcast_to(f(x), x.shape) for f in feats])
        rng, out = _seed(seed, group, 0, int(slice_id)), []
        for at in range(0, n_resamples, 500):
            out.append(rng.multinomial(mine[at : at + 500], n / n.sum()) @ table)
        sums = np.vstack(out)
        res = pd.DataFrame({"_b": np.arange(n_resamples), **{f"s{i}": sums[:, i] for i in range(k)}})
        for name, v in zip(keys, group):
            res[name] = v
        return res[[*keys, "_b", *[f"s{i}" for i in range(k)]]]

    head = f"{key_type}, " if keys else ""
    drawn = (
        plan.groupBy(*mine.values())
        .cogroup(cut.groupBy(*keys, "_slice"))
        .applyInPandas(draw, f"{head}_b long, {sums_type}")
    )
    statistic = _statistic_udf(finish, k)
    sums = [F.sum(f"s{i}").alias(f"s{i}") for i in range(k)]
    resampled = (
        drawn.groupBy(*keys, "_b")
        .agg(*sums)
        .join(sizes.select(*keys, "_total"), keys)
        .withColumn("_t", statistic(F.col("_total"), *[F.col(f"s{i}") for i in range(k)]))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("_t")).alias("_thetas"))
    )

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def feature_values(x: pd.Series) -> pd.Series:
        return pd.Series(np.column_stack([np.broadcast_to(f(x.to_numpy()), len(x)) for f in feats]).tolist())

    fx = cut.withColumn("_f", feature_values("_x"))
    observed = fx.groupBy(*keys).agg(
        *[F.sum(F.col("_f")[i] * F.col("n")).alias(f"t{i}") for i in range(k)]
    ).join(sizes, keys)
    observed = observed.withColumn("_theta", statistic(F.col("_total"), *[F.col(f"t{i}") for i in range(k)]))
    # leave-one-out values, one per distinct value, as offsets from the full statistic
    loo = fx.join(observed, keys).withColumn(
        "_u",
        statistic(F.col("_total") - 1, *[F.col(f"t{i}") - F.col("_f")[i] for i in range(k)]) - F.col("_theta"),
    )
    moments = loo.groupBy(*keys).agg(
        *[F.sum(F.col("n") * F.pow("_u", F.lit(p))).alias(f"_m{p}") for p in (1, 2, 3)]
    )
    full = observed.join(resampled, keys).join(moments, keys)
    ends = _bca_udf(confidence)(
        "_thetas", "_theta", "_total", "_m1", "_m2", "_m3"
    )
    flat = F.col("_lo") == F.col("_hi")
    few = F.col("_total") < 2
    nan = F.lit(float("nan"))
    pick = lambda i: F.when(few, nan).when(flat, F.col("_theta")).otherwise(F.col("_ends")[i])
    return full.withColumn("_ends", ends).select(
        *keys,
        F.col("_total").alias("n"),
        F.when(few, nan).otherwise(F.col("_theta")).alias("point_estimate"),
        pick(0).alias("ci_lower"),
        pick(1).alias("ci_upper"),
        F.when(few, F.lit(0)).otherwise(F.lit(n_resamples)).alias("n_resamples"),
    )


def _statistic_udf(finish, k):
    @F.pandas_udf(T.DoubleType())
    def run(n: pd.Series, *sums: pd.Series) -> pd.Series:
        with np.errstate(all="ignore"):
            out = finish(n.to_numpy(dtype=float), [s.to_numpy(dtype=float) for s in sums])
        return pd.Series(np.broadcast_to(out, len(n)))

    return run


def _bca_udf(confidence: float):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(thetas: pd.Series, theta: pd.Series, n: pd.Series, m1: pd.Series, m2: pd.Series, m3: pd.Series) -> pd.Series:
        rows = []
        for t, point, size, a1, a2, a3 in zip(thetas, theta, n, m1, m2, m3):
            t = np.asarray(t, dtype=float)
            below = ((t < point).sum() + (t <= point).sum()) / (2.0 * len(t))
            z0 = norm_ppf_scalar(min(max(below, 0.5 / len(t)), 1 - 0.5 / len(t)))
            mu = a1 / size
            second = a2 - size * mu * mu
            third = a3 - 3 * mu * a2 + 3 * mu * mu * a1 - size * mu**3
            accel = -third / (6.0 * second**1.5) if second > 0 else 0.0
            ends = []
            for p in ((1 - confidence) / 2, (1 + confidence) / 2):
                z = z0 + norm_ppf_scalar(p)
                ends.append(float(np.quantile(t, norm_cdf(z0 + z / (1 - accel * z)))))
            rows.append(ends)
        return pd.Series(rows)

    return run


# ---- effect sizes --------------------------------------------------------
def cohens_d_expr() -> Column:
    """Pooled-sd d of a pair row (n, mean, var with _a and _b)."""
    na, nb = F.col("n_a"), F.col("n_b")
    diff = F.col("mean_a") - F.col("mean_b")
    sd = F.sqrt(((na - 1) * F.col("var_a") + (nb - 1) * F.col("var_b")) / (na + nb - 2))
    return F.when(na + nb <= 2, 0.0).when(sd == 0, diff).otherwise(diff / sd)


def cohens_d(df: DataFrame, family: Sequence[str], group: str, value: str) -> DataFrame:
    pairs = group_pairs(group_stats(df, [*family, group], value), family, group)
    return pairs.select(
        *family, F.col(f"{group}_a").alias("a"), F.col(f"{group}_b").alias("b"), "n_a", "n_b", cohens_d_expr().alias("d")
    )


def mann_whitney(df: DataFrame, group: str, value: str) -> DataFrame:
    """U of the first group and r = 1 - 2U/(n_a n_b) for every pair of groups.

    A distinct value of a group goes to the pairs of that group and to no
    other; each pair then runs over the values of its own two groups.
    """
    counts = value_counts(df, [group], value)
    names = counts.agg(F.array_sort(F.collect_set(group)).alias("g")).scalar()
    own, other = F.col(group), F.col("_o")
    dealt = counts.withColumn("_all", names).select(
        group, value, "n", F.explode(F.filter("_all", lambda g: g != own)).alias("_o")
    )
    first = own < other
    per = dealt.groupBy(F.least(own, other).alias("a"), F.greatest(own, other).alias("b"), value).agg(
        F.sum(F.when(first, F.col("n")).otherwise(0)).alias("_na"), F.sum(F.when(~first, F.col("n")).otherwise(0)).alias("_nb")
    )
    cum = running_totals(per, ["a", "b"], [value], {"cum": F.col("_nb")})
    u = cum.groupBy("a", "b").agg(
        F.sum("_na").alias("n_a"), F.sum("_nb").alias("n_b"), F.sum(F.col("_na") * (F.col("cum") - F.col("_nb") / 2.0)).alias("u")
    )
    return u.withColumn("r", 1.0 - 2.0 * F.col("u") / (F.col("n_a") * F.col("n_b")))


def effect_label(d: Column) -> Column:
    size = F.abs(d)
    return F.when(size < 0.1, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")


def effect_sizes(df: DataFrame, group: str, value: str) -> DataFrame:
    """|d|, r and a label for every pair of groups; r is NULL when a group has one value."""
    d = cohens_d(df, [], group, value)
    r = mann_whitney(df, group, value).select("a", "b", "r")
    small = (F.col("n_a") < 2) | (F.col("n_b") < 2)
    return d.join(r, ["a", "b"]).select(
        "a", "b", F.abs("d").alias("cohens_d"), F.when(~small, F.col("r")).alias("rank_biserial"), effect_label(F.col("d")).alias("label")
    )


def omega_squared(ss: Column, df: Column, mse: Column, ss_total: Column) -> Column:
    base = ss_total + mse
    return F.when(base == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (ss - df * mse) / base))


def oneway(df: DataFrame, family: Sequence[str], group: str, value: str) -> DataFrame:
    """Between and within sums of squares per family from per-group moments."""
    g = df.groupBy(*family, group).agg(
        F.count(value).alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count(value)).alias("w")
    )
    return g.groupBy(*family).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n_total"),
        F.sum("w").alias("ss_within"),
        (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), F.lit(2)) / F.sum("n")).alias(
            "ss_between"
        ),
        F.min("n").alias("n_min"),
    )


def tukey_hsd(df: DataFrame, family: Sequence[str], group: str, value: str, alpha: float = 0.05) -> DataFrame:
    """All pairs: mean difference, studentized range q and its p."""
    fam = list(family)
    within = oneway(df, fam, group, value).select(
        *fam, "k", (F.col("n_total") - F.col("k")).alias("df"), (F.col("ss_within") / (F.col("n_total") - F.col("k"))).alias("mse")
    )
    pairs = group_pairs(group_stats(df, [*fam, group], value), fam, group)
    if fam:
        joined = pairs.join(within, fam)
    else:
        one = within.select(F.struct("k", "df", "mse").alias("w")).scalar()
        joined = pairs.withColumn("_w", one).select("*", "_w.*").drop("_w")
    diff = F.col("mean_a") - F.col("mean_b")
    q = F.abs(diff) / F.sqrt(F.col("mse") / 2.0 * (1.0 / F.col("n_a") + 1.0 / F.col("n_b")))
    out = joined.select(
        *fam, F.col(f"{group}_a").alias("a"), F.col(f"{group}_b").alias("b"), diff.alias("mean_difference"), q.alias("q"),
        sp.SRANGE_SF(q, F.col("k"), F.col("df")).alias("p_value"),
    )
    return out.withColumn("significant", F.col("p_value") < alpha)


def levene(df: DataFrame, family: Sequence[str], group: str, value: str) -> DataFrame:
    """Median-centred homogeneity test per family; a single group gives (0, 1)."""
    keys = [*family, group]
    med = exact_quantiles(df, keys, value, {"_med": 0.5}).drop("n")
    dev = df.select(*keys, value).join(med, keys).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    o = oneway(dev, family, group, "_dev")
    d1, d2 = F.col("k") - 1, F.col("n_total") - F.col("k")
    w = F.when(F.col("k") < 2, 0.0).otherwise((F.col("ss_between") / d1) / (F.col("ss_within") / d2))
    out = o.withColumn("statistic", w)
    p = F.when(F.col("k") < 2, 1.0).otherwise(sp.F_SF(F.col("statistic"), d1, d2))
    return out.select(*family, "k", "statistic", p.alias("p_value"))


def shapiro_wilk(df: DataFrame, keys: Sequence[str], value: str, tie: str) -> DataFrame:
    """W and p per key over every row (Royston's approximation).

    W needs only sums over rows of expected order scores, so ranks come from
    sliced ordinals and nothing is gathered or sampled.
    """
    keys = list(keys)
    base = df.where(F.col(value).isNotNull()).select(*keys, value, tie)
    sizes = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    placed = ordinals(base, keys, [value, tie], "_i").join(sizes, keys)
    score = sp.norm_ppf((F.col("_i") - 0.375) / (F.col("_n") + 0.25))
    at = lambda c, pos: F.max(F.when(F.col("_i") == pos, c))
    x, m, n = F.col(value), F.col("_m"), F.col("_n")
    agg = placed.withColumn("_m", score).groupBy(*keys).agg(
        F.max("_n").alias("n"),
        F.sum(m * m).alias("mm"),
        F.sum(m * x).alias("mx"),
        (F.var_pop(x) * F.count(x)).alias("ss"),
        at(m, n).alias("m1"),
        at(m, n - 1).alias("m2"),
        at(x, F.lit(1)).alias("x1"),
        at(x, F.lit(2)).alias("x2"),
        at(x, n - 1).alias("y2"),
        at(x, n).alias("y1"),
    )
    wp = _royston_udf(*[F.col(c).cast("double") for c in ("n", "mm", "mx", "ss", "m1", "m2", "x1", "x2", "y2", "y1")])
    return agg.withColumn("_wp", wp).select(
        *keys, "n", F.col("_wp")[0].alias("statistic"), F.col("_wp")[1].alias("p_value")
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _royston_udf(n: pd.Series, mm: pd.Series, mx: pd.Series, ss: pd.Series, m1: pd.Series, m2: pd.Series, x1: pd.Series, x2: pd.Series, y2: pd.Series, y1: pd.Series) -> pd.Series:
    # Published polynomial coefficients of algorithm AS R94, highest power first.
    c_last = [-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0.0]
    c_next = [-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0]
    small_mean = [-0.0006714, 0.025054, -0.39978, 0.544]
    small_sd = [-0.0020322, 0.062767, -0.77857, 1.3822]
    large_mean = [0.0038915, -0.083751, -0.31082, -1.5861]
    large_sd = [0.0030302, -0.082676, -0.4803]
    rows = []
    for k, q, qx, s, last, nxt, lo1, lo2, hi2, hi1 in zip(n, mm, mx, ss, m1, m2, x1, x2, y2, y1):
        if k < 3:
            rows.append([None, None])
            continue
        if s <= 0:
            rows.append([1.0, 1.0])
            continue
        u = 1.0 / np.sqrt(k)
        if k == 3:
            top = np.sqrt(0.5) * (hi1 - lo1)
        else:
            a1 = np.polyval(c_last, u) + last / np.sqrt(q)
            if k > 5:
                a2 = np.polyval(c_next, u) + nxt / np.sqrt(q)
                phi = (q - 2 * last**2 - 2 * nxt**2) / (1 - 2 * a1**2 - 2 * a2**2)
                inner = qx - last * (hi1 - lo1) - nxt * (hi2 - lo2)
                top = a1 * (hi1 - lo1) + a2 * (hi2 - lo2) + inner / np.sqrt(phi)
            else:
                phi = (q - 2 * last**2) / (1 - 2 * a1**2)
                top = a1 * (hi1 - lo1) + (qx - last * (hi1 - lo1)) / np.sqrt(phi)
        w = min(1.0, top * top / s)
        if k == 3:
            p = max(0.0, 6.0 / np.pi * (np.arcsin(np.sqrt(w)) - np.arcsin(np.sqrt(0.75))))
        elif w >= 1.0:
            p = 1.0
        elif k <= 11:
            z = (-np.log(-2.273 + 0.459 * k - np.log(1 - w)) - np.polyval(small_mean, k)) / np.exp(np.polyval(small_sd, k))
            p = norm_sf(z)
        else:
            ln = np.log(k)
            p = norm_sf((np.log(1 - w) - np.polyval(large_mean, ln)) / np.exp(np.polyval(large_sd, ln)))
        rows.append([float(w), float(p)])
    return pd.Series(rows)


def achieved_power(df: DataFrame, family: Sequence[str], group: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Power at the observed Cohen's f per family, and the group size needed for .80.

    ``n_required`` stops at its bound; ``goal_reached`` says whether that size has the power.
    """
    o = oneway(df, family, group, value).withColumn("effect", F.sqrt(F.col("ss_between") / F.col("ss_within")))
    out = o.select(
        *family,
        "k",
        F.col("n_min").alias("n_per_group"),
        F.col("effect").alias("effect_f"),
        sp.ANOVA_POWER(F.col("k"), F.col("n_min"), F.col("effect"), F.lit(alpha)).alias("power"),
        sp.NEEDED_N(F.col("k"), F.col("effect"), F.lit(alpha), F.lit(0.80)).alias("n_required"),
    )
    size = F.coalesce(F.nanvl("n_required", F.lit(2.0)), F.lit(2.0))
    reached = sp.ANOVA_POWER(F.col("k"), size, F.col("effect_f"), F.lit(alpha)) >= 0.80
    return out.withColumn("goal_reached", ~F.isnan("n_required") & reached)


def significance_stars(p: Column) -> Column:
    return F.when(p <= 0.001, "***").when(p <= 0.01, "**").when(p <= 0.05, "*").otherwise("")
