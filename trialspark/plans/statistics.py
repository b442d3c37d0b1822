"""Queries for tests, intervals, effect sizes and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark import views as v
from trialspark.operators import agreement as ag
from trialspark.operators import curves as c
from trialspark.operators import stats as st
from trialspark.plans import tails
from trialspark.plans.registry import query

# ---- paired tests --------------------------------------------------------
_CELLS = "cells AS (SELECT variant_name, task_id, repetition, round(avg(score), 9) AS score FROM trials GROUP BY ALL)"
_ALLP = f"""{_CELLS}, pairs AS (SELECT x.variant_name AS a, y.variant_name AS b, x.task_id, x.repetition, x.score AS score_a, y.score AS score_b
FROM cells x JOIN cells y ON x.task_id = y.task_id AND x.repetition = y.repetition AND x.variant_name < y.variant_name)"""
_SIGNED = """d AS (SELECT *, round(score_a - score_b, 9) AS d FROM pairs),
r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2 AS rk FROM d WHERE d <> 0 WINDOW w AS (PARTITION BY a, b ORDER BY abs(d))),
t AS (SELECT a, b, count(*) AS pairs, avg(d) AS md FROM d GROUP BY ALL),
s AS (SELECT a, b, count(*) AS n, least(coalesce(sum(rk) FILTER (d > 0), 0), coalesce(sum(rk) FILTER (d < 0), 0)) AS w FROM r GROUP BY ALL)"""
_WILCOXON = """SELECT a, b, pairs, coalesce(n, 0) AS n, R(md) AS mean_difference, R(coalesce(w, 0)) AS statistic,
R(CASE WHEN n > 0 THEN 1 - 2 * w / (n * (n + 1) / 2) ELSE 0 END) AS effect_size FROM t LEFT JOIN s USING (a, b)"""


@query(
    "join05_paired_trials",
    f"""WITH {_CELLS} SELECT x.task_id, x.repetition, R(x.score) AS score_a, R(y.score) AS score_b FROM cells x JOIN cells y
ON x.task_id = y.task_id AND x.repetition = y.repetition AND x.variant_name = 'v_0' AND y.variant_name = 'v_1'""",
)
def _(spark, sf):
    return st.paired_trials(v.trials(spark, sf), "variant_name", "v_0", "v_1")


@query(
    "join06_variant_pairs",
    """WITH g AS (SELECT variant_name, count(*) AS n, avg(score) AS mean FROM trials GROUP BY 1)
SELECT x.variant_name AS a, y.variant_name AS b, x.n AS n_a, y.n AS n_b, R(x.mean) AS mean_a, R(y.mean) AS mean_b FROM g x JOIN g y ON x.variant_name < y.variant_name""",
)
def _(spark, sf):
    p = st.group_pairs(st.group_stats(v.trials(spark, sf), ["variant_name"], "score"), [], "variant_name")
    return p.select(F.col("variant_name_a").alias("a"), F.col("variant_name_b").alias("b"), "n_a", "n_b", "mean_a", "mean_b")


def _all_tests(spark, sf):
    return st.wilcoxon(st.all_pairs(v.trials(spark, sf), "variant_name"), ["a", "b"])


@query("stat01_wilcoxon_pairs", f"WITH {_ALLP}, {_SIGNED} {_WILCOXON}")
def _(spark, sf):
    return _all_tests(spark, sf).drop("p_value", "significant")


_TESTS = f"{_ALLP}, d AS (SELECT a, b, round(score_a - score_b, 9) AS d FROM pairs), {tails.signed_rank('a, b')}"
_TEST_COLUMNS = "a, b, pairs, n, R(md) AS mean_difference, R(w) AS statistic, R(CASE WHEN n > 0 THEN 1 - 2 * w / (n * (n + 1) / 2) ELSE 0 END) AS effect_size, R(p_value) AS p_value"


@query("stat01_wilcoxon_p", f"WITH RECURSIVE {_TESTS} SELECT {_TEST_COLUMNS}, p_value < 0.05 AS significant FROM tests")
def _(spark, sf):
    return _all_tests(spark, sf)


@query(
    "stat32_pairwise_all",
    f"""WITH RECURSIVE {_TESTS}, k AS (SELECT *, row_number() OVER (ORDER BY p_value, a, b) AS k, count(*) OVER () AS m FROM tests WHERE pairs >= 5),
h AS (SELECT *, max(least(p_value * (m - k + 1), 1.0)) OVER (ORDER BY k) AS c FROM k)
SELECT {_TEST_COLUMNS}, 'all' AS family, R(c) AS corrected_p, c < 0.05 AS significant FROM h""",
)
def _(spark, sf):
    tests = _all_tests(spark, sf).where(F.col("pairs") >= 5).drop("significant").withColumn("family", F.lit("all"))
    return c.holm(tests, ["family"], ["a", "b"])


# ---- bootstrap -----------------------------------------------------------
@query("stat02_bootstrap_ci")
def _(spark, sf):
    return st.bootstrap_ci(v.trials(spark, sf), ["variant_name"], "score", n_resamples=10_000)


@query("udf05_custom_statistic")
def _(spark, sf):
    """A user statistic: the standard deviation, from sums of x and x squared."""
    return st.bootstrap_ci(
        v.trials(spark, sf),
        ["model"],
        "score",
        n_resamples=1_000,
        features=(lambda x: x, lambda x: x * x),
        finish=lambda n, s: (s[1] / n - (s[0] / n) ** 2) ** 0.5,
    )


# ---- effect sizes --------------------------------------------------------
_G = "g AS (SELECT variant_name, count(*) AS n, avg(score) AS m, var_samp(score) AS v FROM trials GROUP BY 1)"
_D = f"""{_G}, d AS (SELECT x.variant_name AS a, y.variant_name AS b, x.n AS n_a, y.n AS n_b, (x.m - y.m) / sqrt(((x.n - 1) * x.v + (y.n - 1) * y.v) / (x.n + y.n - 2)) AS d
FROM g x JOIN g y ON x.variant_name < y.variant_name)"""
_U = """p AS (SELECT x.variant_name AS a, y.variant_name AS b FROM (SELECT DISTINCT variant_name FROM trials) x JOIN (SELECT DISTINCT variant_name FROM trials) y ON x.variant_name < y.variant_name),
k AS (SELECT variant_name, score, count(*) AS n FROM trials GROUP BY ALL),
u AS (SELECT a, b, sum(x.n * y.n * CASE WHEN y.score < x.score THEN 1.0 WHEN y.score = x.score THEN 0.5 ELSE 0 END) AS u, sum(x.n * y.n) AS nn
FROM p JOIN k x ON x.variant_name = a JOIN k y ON y.variant_name = b GROUP BY ALL)"""


@query("stat03_cohens_d", f"WITH {_D} SELECT a, b, n_a, n_b, R(d) AS d FROM d")
def _(spark, sf):
    return st.cohens_d(v.trials(spark, sf), [], "variant_name", "score")


@query("stat04_mann_whitney_r", f"WITH {_U} SELECT a, b, R(u) AS u, R(1 - 2 * u / nn) AS r FROM u")
def _(spark, sf):
    return st.mann_whitney(v.trials(spark, sf), "variant_name", "score").select("a", "b", "u", "r")


@query(
    "stat05_effect_sizes",
    f"""WITH {_D}, {_U} SELECT a, b, R(abs(d)) AS cohens_d, R(1 - 2 * u / nn) AS rank_biserial,
CASE WHEN abs(d) < 0.1 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS label FROM d JOIN u USING (a, b)""",
)
def _(spark, sf):
    return st.effect_sizes(v.trials(spark, sf), "variant_name", "score")


_ONEWAY = """o AS (SELECT model, variant_name, count(*) AS n, avg({x}) AS m, var_pop({x}) * count(*) AS w FROM {t} GROUP BY ALL),
gm AS (SELECT model, sum(n * m) / sum(n) AS gm FROM o GROUP BY 1),
ow AS (SELECT o.model, count(*) AS k, sum(n) AS nt, sum(w) AS sw, sum(n * (m - gm) * (m - gm)) AS sb FROM o JOIN gm ON o.model = gm.model GROUP BY 1)"""


@query(
    "stat06_omega_squared",
    f"""WITH {_ONEWAY.format(x='score', t='trials')} SELECT model, R(sb) AS ss_between, R(sw) AS ss_within,
R(greatest(0, (sb - (k - 1) * sw / (nt - k)) / (sb + sw + sw / (nt - k)))) AS omega_squared FROM ow""",
)
def _(spark, sf):
    o = st.oneway(v.trials(spark, sf), ["model"], "variant_name", "score")
    mse = F.col("ss_within") / (F.col("n_total") - F.col("k"))
    w = st.omega_squared(F.col("ss_between"), F.col("k") - 1, mse, F.col("ss_between") + F.col("ss_within"))
    return o.select("model", "ss_between", "ss_within", w.alias("omega_squared"))


@query(
    "stat07_tukey_q",
    f"""WITH {_G}, e AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS mse FROM g)
SELECT x.variant_name AS a, y.variant_name AS b, R(x.m - y.m) AS mean_difference, R(abs(x.m - y.m) / sqrt(mse / 2 * (1 / x.n + 1 / y.n))) AS q FROM g x JOIN g y ON x.variant_name < y.variant_name, e""",
)
def _(spark, sf):
    return st.tukey_hsd(v.trials(spark, sf), [], "variant_name", "score").drop("p_value", "significant")


@query(
    "stat07_tukey_hsd",
    f"""WITH {_ONEWAY.format(x='score', t='trials')},
e AS (SELECT x.model, x.variant_name AS a, y.variant_name AS b, x.m - y.m AS md, abs(x.m - y.m) / sqrt(sw / (nt - k) / 2 * (1 / x.n + 1 / y.n)) AS q, k, nt - k AS df
FROM o x JOIN o y ON x.model = y.model AND x.variant_name < y.variant_name JOIN ow ON ow.model = x.model),
{tails.srange_sf('e', 'model, a, b')}
SELECT e.model, e.a, e.b, R(md) AS mean_difference, R(q) AS q, R(p) AS p_value, p < 0.05 AS significant FROM e JOIN sr ON e.model = sr.model AND e.a = sr.a AND e.b = sr.b""",
)
def _(spark, sf):
    return st.tukey_hsd(v.trials(spark, sf), ["model"], "variant_name", "score")


_LEVENE = f"""med AS (SELECT model, variant_name, median(score) AS md FROM trials GROUP BY ALL),
dv AS (SELECT t.model, t.variant_name, abs(score - md) AS z FROM trials t JOIN med ON t.model = med.model AND t.variant_name = med.variant_name),
{_ONEWAY.format(x='z', t='dv')}"""


@query(
    "stat08_levene_w",
    f"""WITH {_LEVENE} SELECT model, k, R((sb / (k - 1)) / (sw / (nt - k))) AS statistic FROM ow""",
)
def _(spark, sf):
    return st.levene(v.trials(spark, sf), ["model"], "variant_name", "score").drop("p_value")


@query(
    "stat08_levene",
    f"""WITH {_LEVENE}, f AS (SELECT model, k, (sb / (k - 1)) / (sw / (nt - k)) AS f, k - 1 AS d1, nt - k AS d2 FROM ow)
SELECT model, k, R(f) AS statistic, R({tails.f_sf('f', 'd1', 'd2')}) AS p_value FROM f""",
)
def _(spark, sf):
    return st.levene(v.trials(spark, sf), ["model"], "variant_name", "score")


@query(
    "stat09_shapiro_wilk",
    f"""WITH rs AS (SELECT model, trial_id, score - avg(score) OVER (PARTITION BY model, variant_name) AS residual FROM trials),
{tails.shapiro('rs', 'model', 'residual', 'trial_id')}
SELECT model, n, R(w) AS statistic, R(p) AS p_value FROM sw""",
)
def _(spark, sf):
    t = v.trials(spark, sf)
    means = t.groupBy("model", "variant_name").agg(F.avg("score").alias("m"))
    resid = t.join(means, ["model", "variant_name"]).withColumn("residual", F.col("score") - F.col("m"))
    return st.shapiro_wilk(resid, ["model"], "residual", "trial_id")


def _power(n: str) -> str:
    """Power with ``n`` rows per group as SQL over k and effect."""
    d1, d2 = "(k - 1)", f"(k * ({n} - 1))"
    return tails.ncf_sf("crit", d1, d2, f"(effect * effect * k * {n})")


_AT = f"{tails.f_ppf('0.05', '(k - 1)', '(k * (size - 1))')} AS crit"


@query(
    "stat10_achieved_power",
    f"""WITH RECURSIVE o AS (SELECT task_type, variant_name, count(*) AS n, avg(score) AS m, var_pop(score) * count(*) AS w FROM trials GROUP BY ALL),
gm AS (SELECT task_type, sum(n * m) / sum(n) AS gm FROM o GROUP BY 1),
ef AS (SELECT o.task_type, count(*) AS k, min(n) AS n, sqrt(sum(n * (m - gm) * (m - gm)) / sum(w)) AS effect FROM o JOIN gm ON o.task_type = gm.task_type GROUP BY 1),
search AS (SELECT task_type, k, effect, 2::BIGINT AS lo, 10000::BIGINT AS hi FROM ef UNION ALL
  SELECT task_type, k, effect, CASE WHEN pw >= 0.8 THEN lo ELSE size + 1 END, CASE WHEN pw >= 0.8 THEN size ELSE hi END
  FROM (SELECT *, {_power('size')} AS pw FROM (SELECT *, {_AT} FROM (SELECT *, (lo + hi) // 2 AS size FROM search WHERE lo < hi)))),
found AS (SELECT task_type, lo AS need FROM search WHERE lo >= hi),
asked AS (SELECT ef.*, need, size FROM ef JOIN found ON ef.task_type = found.task_type, LATERAL (SELECT unnest([n, need]) AS size)),
pw AS (SELECT *, {_power('size')} AS pw FROM (SELECT *, {_AT} FROM asked))
SELECT task_type, k, any_value(n) AS n_per_group, R(any_value(effect)) AS effect_f, R(max(pw) FILTER (size = n)) AS power, R(any_value(need)) AS n_required,
  max(pw) FILTER (size = need) >= 0.8 AS goal_reached FROM pw GROUP BY task_type, k""",
)
def _(spark, sf):
    return st.achieved_power(v.trials(spark, sf), ["task_type"], "variant_name", "score")


@query(
    "stat34_significance_stars",
    """WITH p AS (SELECT variant_name, task_type, floor(avg(score) * avg(score) * 1000) / 10000 AS p FROM trials GROUP BY ALL)
SELECT variant_name, task_type, R(p) AS p_value, CASE WHEN p <= 0.001 THEN '***' WHEN p <= 0.01 THEN '**' WHEN p <= 0.05 THEN '*' ELSE '' END AS stars FROM p""",
)
def _(spark, sf):
    a = F.avg("score")
    p = v.trials(spark, sf).groupBy("variant_name", "task_type").agg((F.floor(a * a * 1000) / 10000).alias("p_value"))
    return p.withColumn("stars", st.significance_stars(F.col("p_value")))


# ---- agreement -----------------------------------------------------------
_JOINED = "j AS (SELECT g.example_id, task_type, human_score, arg_max(score, seq) AS score FROM gold g JOIN judge_scores s ON g.example_id = s.example_id GROUP BY ALL)"


def _joined(spark, sf):
    return ag.gold_judge_join(v.gold(spark, sf), v.judge_scores(spark, sf))


@query("join02_gold_judge_join", f"WITH {_JOINED} SELECT example_id, task_type, R(human_score) AS human_score, R(score) AS score FROM j")
def _(spark, sf):
    return _joined(spark, sf).select("example_id", "task_type", "human_score", "score")


_PANEL = "p AS (SELECT example_id, {agg}(score) AS aggregate, max(score) - min(score) AS spread, count(*) AS members FROM judge_scores GROUP BY 1)"


@query(
    "agg15_panel_mean",
    """SELECT example_id, R(avg(score)) AS aggregate, R(max(score) - min(score)) AS spread, count(*) AS members,
string_agg(judge_model || '=' || CASE WHEN score = 0 OR score = 1 THEN CAST(CAST(score AS DOUBLE) AS VARCHAR) ELSE CAST(round(score, 4) AS VARCHAR) END, ',' ORDER BY judge_model) AS member_scores FROM judge_scores GROUP BY 1""",
)
def _(spark, sf):
    return ag.panel_aggregate(v.judge_scores(spark, sf))


@query("agg15_panel_median", f"WITH {_PANEL.format(agg='median')} SELECT example_id, R(aggregate) AS aggregate, R(spread) AS spread, members FROM p")
def _(spark, sf):
    return ag.panel_aggregate(v.judge_scores(spark, sf), "median").drop("member_scores")


@query("fil11_panel_disagreements", f"WITH {_PANEL.format(agg='avg')} SELECT example_id, R(spread) AS spread FROM p WHERE spread > 0.16")
def _(spark, sf):
    return ag.panel_disagreements(ag.panel_aggregate(v.judge_scores(spark, sf)), 0.16).select("example_id", "spread")


@query("agg16_judge_stats", "SELECT judge_model, R(avg(score)) AS mean_score, count(*) AS n FROM judge_scores GROUP BY 1")
def _(spark, sf):
    return ag.judge_stats(v.judge_scores(spark, sf))


@query(
    "join03_panel_routine_join",
    f"WITH {_PANEL.format(agg='avg')} SELECT p.example_id, R(aggregate) AS aggregate, R(human_score) AS score FROM p JOIN gold g ON p.example_id = g.example_id",
)
def _(spark, sf):
    routine = v.gold(spark, sf).select("example_id", F.col("human_score").alias("score"))
    return ag.panel_routine_join(ag.panel_aggregate(v.judge_scores(spark, sf)), routine).select("example_id", "aggregate", "score")


_BINS = "least(CAST(floor({} * 5) AS INT), 4)"
_KAPPA = f"""m AS (SELECT task_type, {_BINS.format('human_score')} AS i, {_BINS.format('score')} AS k FROM j),
ka AS (SELECT task_type, count(*) AS n, 1 - avg((i - k) * (i - k)) / (var_pop(i) + var_pop(k) + (avg(i) - avg(k)) * (avg(i) - avg(k))) AS kappa FROM {{src}} GROUP BY 1)"""


@query("stat11_quadratic_kappa", f"WITH {_JOINED}, {_KAPPA.format(src='m')} SELECT task_type, n, R(kappa) AS kappa FROM ka")
def _(spark, sf):
    return ag.kappa(_joined(spark, sf), ["task_type"], "human_score", "score")


_RHO = """rk AS (SELECT task_type, rank() OVER (PARTITION BY task_type ORDER BY human_score) + (count(*) OVER (PARTITION BY task_type, human_score) - 1) / 2 AS a,
rank() OVER (PARTITION BY task_type ORDER BY score) + (count(*) OVER (PARTITION BY task_type, score) - 1) / 2 AS b FROM j),
rh AS (SELECT task_type, count(*) AS n, corr(a, b) AS rho FROM rk GROUP BY 1)"""


@query("stat12_spearman", f"WITH {_JOINED}, {_RHO} SELECT task_type, n, R(rho) AS rho FROM rh")
def _(spark, sf):
    return ag.spearman(_joined(spark, sf), ["task_type"], "human_score", "score")


_TAU = """tp AS (SELECT x.task_type, sign(x.human_score - y.human_score) AS a, sign(x.score - y.score) AS b FROM j x JOIN j y ON x.task_type = y.task_type AND x.example_id < y.example_id),
ta AS (SELECT task_type, sum(a * b) / sqrt(sum(a * a)::DOUBLE * sum(b * b)) AS tau FROM tp GROUP BY 1)"""


@query("stat13_kendall_tau_b", f"WITH {_JOINED}, {_TAU} SELECT task_type, R(tau) AS tau FROM ta")
def _(spark, sf):
    return ag.kendall(_joined(spark, sf), ["task_type"], "human_score", "score").drop("n")


@query("stat14_mae", f"WITH {_JOINED} SELECT task_type, R(avg(abs(human_score - score))) AS mae FROM j GROUP BY 1")
def _(spark, sf):
    return ag.mae(_joined(spark, sf), ["task_type"], "human_score", "score")


_SCOPED = _JOINED.replace("j AS (", "j0 AS (") + ", j AS (SELECT example_id, unnest(['(all)', task_type]) AS task_type, human_score, score FROM j0)"


@query(
    "stat15_calibrate",
    f"""WITH {_SCOPED}, {_KAPPA.format(src='m')}, {_RHO}, {_TAU}, e AS (SELECT task_type, avg(abs(human_score - score)) AS mae FROM j GROUP BY 1)
SELECT ka.task_type AS scope, ka.n, R(kappa) AS kappa, R(rho) AS rho, R(tau) AS tau, R(mae) AS mae, kappa < 0.7 OR rho < 0.8 AS flagged
FROM ka JOIN rh ON ka.task_type = rh.task_type JOIN ta ON ka.task_type = ta.task_type JOIN e ON ka.task_type = e.task_type""",
)
def _(spark, sf):
    return ag.calibrate(_joined(spark, sf), "human_score", "score")


@query(
    "stat16_panel_validate",
    f"""WITH {_PANEL.format(agg='avg')}, q AS (SELECT round(aggregate, 9) AS aggregate, human_score FROM p JOIN gold g ON p.example_id = g.example_id),
rk AS (SELECT rank() OVER (ORDER BY aggregate) + (count(*) OVER (PARTITION BY aggregate) - 1) / 2 AS a, rank() OVER (ORDER BY human_score) + (count(*) OVER (PARTITION BY human_score) - 1) / 2 AS b FROM q)
SELECT count(*) AS n, R(corr(a, b)) AS rho, corr(a, b) >= 0.8 AS passed FROM rk""",
)
def _(spark, sf):
    routine = v.gold(spark, sf).select("example_id", F.col("human_score").alias("score"))
    panel = ag.panel_aggregate(v.judge_scores(spark, sf)).withColumn("aggregate", F.round("aggregate", 9))
    return ag.panel_validate(panel, routine)
