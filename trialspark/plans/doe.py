"""Queries for designs, designed-experiment analysis and variant selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark import design as ds
from trialspark import views as v
from trialspark.functions.special import norm_ppf  # noqa: F401
from trialspark.operators import doe
from trialspark.operators import monitor as m
from trialspark.operators import stats as st
from trialspark.operators import trials as t
from trialspark.plans import tails
from trialspark.plans.registry import query

FACTORS = {"layout": ["flat", "two", "three"], "detail": ["path", "summary", "tokens"], "order": ["natural", "bluf", "edges"]}
L9 = ds.array_design(FACTORS, "L9")
PAIRS = {f: (f"{f}_lo", f"{f}_hi") for f in ("A", "B", "C", "D", "E")}
HALF = ds.fractional_factorial(PAIRS)


def _rows_sql(rows, names):
    body = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}" for x in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({names}))"


_DESIGN = f"design AS {_rows_sql(L9, 'run_id, factor, level, code')}"
_LEVEL_ROWS = [(f, lv, i) for f, ls in FACTORS.items() for i, lv in enumerate(ls)]
_LEVELS = f"levels AS {_rows_sql(_LEVEL_ROWS, 'factor, level, level_pos')}"
_SN = "sn AS (SELECT run_id AS run, oa_row_id AS run_id, -10 * log10(avg(1 / (score * score + 1e-10::DOUBLE))) AS sn FROM trials GROUP BY ALL)"
_FX = "fx AS (SELECT run, d.factor, d.level, level_pos, avg(sn) AS mean_sn, count(*) AS runs FROM sn JOIN design d ON sn.run_id = d.run_id JOIN levels l ON l.factor = d.factor AND l.level = d.level GROUP BY ALL)"
_DOE = f"{_DESIGN}, {_LEVELS}, {_SN}, {_FX}"


def _design(spark):
    return ds.design_frame(spark, L9)


def _levels(spark):
    return ds.literal_rows(spark, _LEVEL_ROWS, "factor, level, level_pos")


def _sn(spark, sf):
    tr = v.trials(spark, sf).withColumn("run", F.col("run_id")).drop("run_id")
    return doe.sn_ratios(tr, ["run"])


def _effects(spark, sf):
    return doe.main_effects(_sn(spark, sf), _design(spark), _levels(spark), ["run"])


# ---- designs -------------------------------------------------------------
@query(
    "des01_factors_from_axes",
    """WITH x AS (SELECT DISTINCT variant_name, CAST(substr(variant_name, 3) AS BIGINT) % 3 AS axis FROM trials),
f AS (SELECT 'axis_' || axis AS factor, axis, list_sort(list(variant_name)) AS l FROM x GROUP BY axis
UNION ALL SELECT 'model', NULL, list_sort(list(DISTINCT model)) FROM trials)
SELECT factor, axis, len(l) AS n_levels, array_to_string(l, ',') AS levels FROM f""",
)
def _(spark, sf):
    tr = v.trials(spark, sf)
    axis = (F.substring("variant_name", 3, 5).cast("long") % 3).alias("axis")
    return ds.factors_from_axes(tr.select("variant_name", axis).distinct(), tr.select("model").distinct())


_AXES = {"axis_1": [f"v_{i}" for i in range(5)], "axis_2": ["a", "b", "c", "d"], "axis_3": ["x", "y", "z"], "model": ["m_0", "m_1"]}
_AUTO = ds.array_design(_AXES)


@query(
    "des02_array_design",
    f"""WITH d AS {_rows_sql(_AUTO, 'run_id, factor, level, code')}, s AS (SELECT trial_id % 50 + 1 AS run_id, score FROM trials)
SELECT factor, level, count(DISTINCT d.run_id) AS runs, count(*) AS trials, R(avg(score)) AS mean_score FROM d JOIN s ON d.run_id = s.run_id GROUP BY ALL""",
)
def _(spark, sf):
    tr = v.trials(spark, sf).select((F.col("trial_id") % 50 + 1).alias("oa_row_id"), "score")
    joined = tr.join(ds.design_frame(spark, _AUTO), F.col("oa_row_id") == F.col("run_id"))
    return joined.groupBy("factor", "level").agg(
        F.countDistinct("run_id").alias("runs"), t.n_rows().alias("trials"), F.avg("score").alias("mean_score")
    )


_PLAN_VARIANTS = "SELECT DISTINCT task_id FROM trials"
_FULL = ds.full_factorial({"fmt": ("yaml", "table"), "layout": ("flat", "tiered"), "xref": ("none", "dense")})


@query(
    "des03_full_factorial",
    f"WITH d AS {_rows_sql(_FULL, 'run_id, factor, level, code')} SELECT task_id, CAST(run_id AS BIGINT) AS run_id, factor, level, CAST(code AS BIGINT) AS code FROM d, ({_PLAN_VARIANTS})",
)
def _(spark, sf):
    return _planned(spark, sf, _FULL)


def _planned(spark, sf, rows):
    """Every task under every design row: the design is a short literal array exploded per task."""
    cells = F.array(*[F.struct(F.lit(r).cast("long").alias("run_id"), F.lit(f).alias("factor"), F.lit(lv).alias("level"), F.lit(c).cast("long").alias("code")) for r, f, lv, c in rows])
    return v.trials(spark, sf).select("task_id").distinct().select("task_id", F.inline(cells))


@query(
    "des04_fractional_factorial",
    f"WITH d AS {_rows_sql(HALF, 'run_id, factor, level, code')} SELECT task_id, CAST(run_id AS BIGINT) AS run_id, factor, level, CAST(code AS BIGINT) AS code FROM d, ({_PLAN_VARIANTS})",
)
def _(spark, sf):
    return _planned(spark, sf, HALF)


_PRUNED = f"""p AS (SELECT task_id, run_id, max(level) FILTER (factor = 'fmt') AS fmt, max(level) FILTER (factor = 'layout') AS layout FROM {_rows_sql(_FULL, 'run_id, factor, level, code')}, ({_PLAN_VARIANTS}) GROUP BY ALL),
q AS (SELECT *, CASE WHEN fmt = 'yaml' AND layout = 'flat' THEN 'yaml needs structure' WHEN layout = 'flat' AND task_id LIKE '%7' THEN 'too long' END AS reason FROM p)"""


def _pruned(spark, sf):
    planned = _planned(spark, sf, _FULL)
    by = lambda f: F.max(F.when(F.col("factor") == f, F.col("level"))).alias(f)
    w = planned.groupBy("task_id", "run_id").agg(by("fmt"), by("layout"))
    rules = [
        ((F.col("fmt") == "yaml") & (F.col("layout") == "flat"), "yaml needs structure"),
        ((F.col("layout") == "flat") & F.col("task_id").endswith("7"), "too long"),
    ]
    return ds.prune(w, rules)


@query("des05_prune_design", f"WITH {_PRUNED} SELECT task_id, CAST(run_id AS BIGINT) AS run_id, fmt, layout, reason AS exclusion_reason, reason IS NOT NULL AS excluded FROM q")
def _(spark, sf):
    return _pruned(spark, sf)


@query("udf06_custom_pruning_rule", f"WITH {_PRUNED} SELECT coalesce(reason, 'kept') AS outcome, count(*) AS cells FROM q GROUP BY 1")
def _(spark, sf):
    return _pruned(spark, sf).groupBy(F.coalesce("exclusion_reason", F.lit("kept")).alias("outcome")).agg(t.n_rows().alias("cells"))


@query("fil09_active_design_rows", f"WITH {_PRUNED} SELECT task_id, CAST(run_id AS BIGINT) AS run_id, fmt, layout FROM q WHERE reason IS NULL")
def _(spark, sf):
    return ds.active_rows(_pruned(spark, sf)).select("task_id", "run_id", "fmt", "layout")


@query(
    "des06_planned_trial_counts",
    """WITH n AS (SELECT count(DISTINCT task_id) AS tasks FROM trials)
SELECT phase, tasks, CAST(configs AS BIGINT) AS configs, CAST(tasks * configs * reps AS BIGINT) AS planned FROM n, (VALUES ('screening', 50, 3), ('confirmation', 2, 5), ('refinement', 125, 3)) AS p(phase, configs, reps)""",
)
def _(spark, sf):
    n = v.trials(spark, sf).agg(F.countDistinct("task_id").alias("tasks")).scalar()
    phases = ds.literal_rows(spark, [("screening", 50, 3), ("confirmation", 2, 5), ("refinement", 125, 3)], "phase, configs, reps")
    return phases.select("phase", n.alias("tasks"), "configs", (n * F.col("configs") * F.col("reps")).alias("planned"))


@query(
    "des02_balance",
    f"""WITH {_DESIGN} SELECT a.factor, b.factor AS factor_b, a.level, b.level AS level_b, count(*) AS trials FROM design a JOIN design b ON a.run_id = b.run_id AND a.factor < b.factor
JOIN trials t ON t.oa_row_id = a.run_id GROUP BY ALL""",
)
def _(spark, sf):
    """Crosstab of factor levels over the trials actually run: equal counts mean a balanced experiment."""
    per_run = v.trials(spark, sf).groupBy("oa_row_id").agg(t.n_rows().alias("n"))
    d = _design(spark)
    right = d.select("run_id", F.col("factor").alias("factor_b"), F.col("level").alias("level_b"))
    pairs = d.join(right, "run_id").where(F.col("factor") < F.col("factor_b"))
    return (
        per_run.join(pairs, F.col("oa_row_id") == F.col("run_id"))
        .groupBy("factor", "factor_b", "level", "level_b")
        .agg(F.sum("n").alias("trials"))
    )


# ---- analysis ------------------------------------------------------------
@query(
    "join16_scores_to_design",
    f"WITH {_DESIGN} SELECT trial_id, factor, level, R(score) AS score FROM trials JOIN design ON oa_row_id = design.run_id",
)
def _(spark, sf):
    tr = v.trials(spark, sf).select("trial_id", "oa_row_id", "score")
    return doe.scores_to_design(tr, _design(spark)).select("trial_id", "factor", "level", "score")


_SN_ALL = """SELECT run_id, oa_row_id, R(-10 * log10(avg(1 / (score * score + 1e-10::DOUBLE)))) AS larger, R(-10 * log10(greatest(avg(score * score), 1e-10::DOUBLE))) AS smaller,
R(CASE WHEN var_pop(score) < 1e-30::DOUBLE THEN 100 ELSE 10 * log10(avg(score) * avg(score) / var_pop(score)) END) AS nominal FROM trials GROUP BY ALL"""


@query("stat17_sn_ratio", _SN_ALL)
def _(spark, sf):
    y = F.col("score")
    kinds = {"larger": "larger_is_better", "smaller": "smaller_is_better", "nominal": "nominal_is_best"}
    return v.trials(spark, sf).groupBy("run_id", "oa_row_id").agg(*[doe.sn_expr(k, y).alias(n) for n, k in kinds.items()])


@query("stat18_main_effects", f"WITH {_DOE} SELECT run, factor, level, CAST(level_pos AS BIGINT) AS level_pos, R(mean_sn) AS mean_sn, runs FROM fx")
def _(spark, sf):
    return _effects(spark, sf)


@query(
    "stat19_sn_response_table",
    f"""WITH {_DOE}, r AS (SELECT run, factor, max(mean_sn) - min(mean_sn) AS delta FROM fx GROUP BY ALL)
SELECT run, factor, R(delta) AS delta, row_number() OVER (PARTITION BY run ORDER BY delta DESC, factor) AS rank FROM r""",
)
def _(spark, sf):
    return doe.response_table(_effects(spark, sf), ["run"])


_ANOVA = """tot AS (SELECT run, count(*) AS n, avg(sn) AS g, var_pop(sn) * count(*) AS sst FROM sn GROUP BY 1),
per AS (SELECT fx.run, factor, sum(runs * (mean_sn - g) * (mean_sn - g)) AS ss, count(*) - 1 AS df FROM fx JOIN tot ON fx.run = tot.run GROUP BY ALL),
err AS (SELECT tot.run, any_value(sst) AS sst, greatest(any_value(sst) - sum(ss), 0) AS sse, greatest(any_value(n) - 1 - sum(df), 1) AS dfe FROM tot JOIN per ON tot.run = per.run GROUP BY 1)"""


@query(
    "stat20_anova",
    f"""WITH {_DOE}, {_ANOVA} SELECT per.run, factor, R(ss) AS ss, df, R(ss / df) AS ms, R((ss / df) / (sse / dfe)) AS f_ratio, R(ss / sst) AS eta_squared,
R(greatest(0, (ss - df * sse / dfe) / (sst + sse / dfe))) AS omega_squared, R(sse / sst) AS error_eta_squared FROM per JOIN err ON per.run = err.run""",
)
def _(spark, sf):
    a = doe.anova(_sn(spark, sf), _effects(spark, sf), ["run"], p_values=False)
    return a.select("run", "factor", "ss", "df", "ms", "f_ratio", "eta_squared", "omega_squared", "error_eta_squared")


def _anova_p(spark, sf):
    return doe.anova(_sn(spark, sf), _effects(spark, sf), ["run"])


_ANOVA_P = f"""{_DOE}, {_ANOVA}, ap AS (SELECT per.run, factor, ss, df, dfe, (ss / df) / (sse / dfe) AS f, greatest(0, (ss - df * sse / dfe) / (sst + sse / dfe)) AS om FROM per JOIN err ON per.run = err.run),
an AS (SELECT *, {tails.f_sf('f', 'df', 'dfe')} AS p FROM ap)"""


@query("stat20_anova_p", f"WITH {_ANOVA_P} SELECT run, factor, R(f) AS f_ratio, df, CAST(dfe AS BIGINT) AS df_error, R(p) AS p_value FROM an")
def _(spark, sf):
    return _anova_p(spark, sf).select("run", "factor", "f_ratio", "df", "df_error", "p_value")


@query(
    "top04_top_factors",
    f"""WITH {_ANOVA_P}, k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY om DESC, factor) AS k FROM an WHERE p < 0.9)
SELECT run, factor, R(om) AS omega_squared, R(p) AS p_value, k AS rank FROM k WHERE k <= 2""",
)
def _(spark, sf):
    # the trial table carries no real factor effects, so the level is loose
    return doe.significant_factors(_anova_p(spark, sf), ["run"], alpha=0.9, k=2).select("run", "factor", "omega_squared", "p_value", "rank")


_OPT = """b AS (SELECT run, factor, arg_max(level, mean_sn) AS level, max(mean_sn) AS best, avg(mean_sn) AS mid, sum(mean_sn) AS tot, count(*) AS n FROM fx GROUP BY ALL),
opt AS (SELECT run, string_agg(factor || '=' || level, '+' ORDER BY factor) AS optimal, sum(tot) / sum(n) + sum(best - mid) AS predicted_sn FROM b GROUP BY 1)"""


@query("stat21_predict_optimal", f"WITH {_DOE}, {_OPT} SELECT run, optimal, R(predicted_sn) AS predicted_sn FROM opt")
def _(spark, sf):
    return doe.predict_optimal(_effects(spark, sf), ["run"])


_MARGIN = f"""sp AS (SELECT run, count(*) - 1 AS dft, stddev_samp(sn) / sqrt(count(*)) AS se FROM sn GROUP BY 1),
{tails.bisect('sp', 'run, dft', f"({tails.f_sf('x * x', '1', 'dft')}) > 0.05", 1000)},
iv AS (SELECT opt.run, optimal, predicted_sn, se, predicted_sn - quantile.lo * se AS ci_low, predicted_sn + quantile.lo * se AS ci_high FROM opt JOIN sp ON opt.run = sp.run JOIN quantile ON quantile.run = opt.run)"""
_INTERVAL = "optimal, R(predicted_sn) AS predicted_sn, R(se) AS se, R(ci_low) AS ci_low, R(ci_high) AS ci_high"


@query("stat21_prediction_interval", f"WITH RECURSIVE {_DOE}, {_OPT}, {_MARGIN} SELECT run, {_INTERVAL} FROM iv")
def _(spark, sf):
    return doe.prediction_interval(_sn(spark, sf), doe.predict_optimal(_effects(spark, sf), ["run"]), ["run"])


_OBS = "obs AS (SELECT run_id AS run, -10 * log10(avg(1 / (score * score + 1e-10::DOUBLE))) AS o FROM trials WHERE repetition = 1 GROUP BY 1)"


@query(
    "stat22_validate_confirmation",
    f"""WITH {_DOE}, {_OPT}, {_OBS} SELECT opt.run, R(o) AS observed_sn, R(predicted_sn) AS predicted_sn,
o BETWEEN predicted_sn - 1 AND predicted_sn + 1 AS within_interval, R(o - predicted_sn) AS sigma_deviation FROM opt JOIN obs ON opt.run = obs.run""",
)
def _(spark, sf):
    seen = v.trials(spark, sf).where("repetition = 1").groupBy(F.col("run_id").alias("run")).agg(
        doe.sn_expr("larger_is_better", F.col("score")).alias("observed_sn")
    )
    return doe.validate_confirmation(seen, doe.predict_optimal(_effects(spark, sf), ["run"]), ["run"], interval=False)


@query(
    "stat23_screening",
    f"""WITH RECURSIVE {_ANOVA_P}, {_OPT}, {_MARGIN} SELECT an.run, factor, R(ss) AS ss, R(f) AS f_ratio, R(p) AS p_value, R(om) AS omega_squared, {_INTERVAL}, p < 0.05 AS significant
FROM an JOIN iv ON an.run = iv.run""",
)
def _(spark, sf):
    """Trials to S/N, effects, ANOVA and optimum in one result, a row per run and factor."""
    sn, fx = _sn(spark, sf), _effects(spark, sf)
    best = doe.prediction_interval(sn, doe.predict_optimal(fx, ["run"]), ["run"])
    table = doe.anova(sn, fx, ["run"]).select("run", "factor", "ss", "f_ratio", "p_value", "omega_squared")
    return table.join(best, "run").withColumn("significant", F.col("p_value") < 0.05)


@query(
    "stat24_confirmation",
    f"""WITH {_DOE}, {_OPT}, pick AS (SELECT run, oa_row_id FROM (SELECT opt.run, d.run_id AS oa_row_id, count(*) FILTER (contains('+' || optimal || '+', '+' || factor || '=' || level || '+')) AS hit
  FROM opt, design d GROUP BY ALL) WHERE hit >= 2),
obs AS (SELECT t.run_id AS run, -10 * log10(avg(1 / (score * score + 1e-10::DOUBLE))) AS o FROM trials t JOIN pick p ON t.run_id = p.run AND t.oa_row_id = p.oa_row_id GROUP BY 1)
SELECT opt.run, R(o) AS observed_sn, R(predicted_sn) AS predicted_sn, o BETWEEN predicted_sn - 1 AND predicted_sn + 1 AS within_interval, R(o - predicted_sn) AS sigma_deviation FROM opt JOIN obs ON opt.run = obs.run""",
)
def _(spark, sf):
    """Trials of the rows nearest the predicted optimum against the real prediction.

    A screening array rarely contains the optimum itself, so rows sharing at
    least two of its three levels stand in for the confirmation run.
    """
    best = doe.predict_optimal(_effects(spark, sf), ["run"])
    d = _design(spark).groupBy("run_id").agg(F.collect_list(F.concat_ws("=", "factor", "level")).alias("levels"))
    rows = d.agg(F.collect_list(F.struct("run_id", "levels")).alias("r")).scalar()
    near = best.select("run", "optimal", F.inline(rows)).where(
        F.size(F.array_intersect("levels", F.split("optimal", r"\+"))) >= 2
    )
    seen = (
        v.trials(spark, sf)
        .join(near.select(F.col("run").alias("_r"), F.col("run_id").alias("_row")), (F.col("run_id") == F.col("_r")) & (F.col("oa_row_id") == F.col("_row")))
        .groupBy(F.col("_r").alias("run"))
        .agg(doe.sn_expr("larger_is_better", F.col("score")).alias("observed_sn"))
    )
    return doe.validate_confirmation(seen, best, ["run"], interval=False)


@query(
    "stat25_refinement_plan",
    f"""SELECT task_id, l.x AS layout, d.x AS detail, 'bluf' AS "order", CAST(r.r AS BIGINT) AS repetition FROM ({_PLAN_VARIANTS}), (SELECT unnest(['flat', 'two', 'three']) AS x) l,
(SELECT unnest(['path', 'summary', 'tokens']) AS x) d, (SELECT unnest([1, 2, 3]) AS r) r""",
)
def _(spark, sf):
    tasks = v.trials(spark, sf).select("task_id").distinct()
    top = {f: FACTORS[f] for f in ("layout", "detail")}
    return doe.refinement_plan(tasks, top, {"layout": "flat", "detail": "path", "order": "bluf"}, 3)


# ---- factorial effects ---------------------------------------------------
_SIGN_ROWS = [(r, f, c) for r, f, _, c in HALF] + [
    (r, f"{f}:{g}", c * dict((x, y) for q, x, _, y in HALF if q == r)[g])
    for r, f, _, c in HALF
    for g in PAIRS
    if f < g
]
_EFFECTS = f"""signs AS {_rows_sql(_SIGN_ROWS, 'run_id, effect, sign')},
y AS (SELECT model, trial_id % 16 + 1 AS run_id, avg(score) AS y FROM trials GROUP BY ALL),
ef AS (SELECT model, effect, NOT contains(effect, ':') AS is_main, sum(sign * y) * 2 / count(*) AS estimate FROM y JOIN signs ON y.run_id = signs.run_id GROUP BY ALL)"""


def _factorial(spark, sf):
    y = v.trials(spark, sf).groupBy("model", (F.col("trial_id") % 16 + 1).alias("run_id")).agg(F.avg("score").alias("y"))
    return doe.factorial_effects(y, doe.effect_signs(spark, HALF), ["model"])


@query("stat26_factorial_effects", f"WITH {_EFFECTS} SELECT model, effect, is_main, R(estimate) AS estimate FROM ef")
def _(spark, sf):
    return _factorial(spark, sf)


@query(
    "stat27_lenth",
    f"""WITH RECURSIVE {_EFFECTS}, lz AS (SELECT model, count(*) AS k, list(abs(estimate)) AS rest, 0 AS round FROM ef GROUP BY 1
UNION ALL SELECT model, k, kept, round + 1 FROM (SELECT *, list_filter(rest, lambda x: x <= 3.75 * list_aggregate(rest, 'median')) AS kept FROM lz) WHERE len(kept) NOT IN (0, len(rest)) AND round < 50),
ps AS (SELECT model, any_value(k) AS k, arg_max(1.5 * list_aggregate(rest, 'median'), round) AS pse FROM lz GROUP BY 1),
tl AS (SELECT model, pse, 'me' AS margin, greatest(k / 3, 1) AS dft, 0.05::DOUBLE AS tail FROM ps UNION ALL SELECT model, pse, 'sme', greatest(k / 3, 1), 1 - 0.95 ** (1 / k) FROM ps),
{tails.bisect('tl', 'model, pse, margin, dft, tail', f"({tails.f_sf('x * x', '1', 'dft')}) > tail", 1000)},
mg AS (SELECT model, any_value(pse) AS pse, max(lo * pse) FILTER (margin = 'me') AS me, max(lo * pse) FILTER (margin = 'sme') AS sme FROM quantile GROUP BY 1)
SELECT ef.model, effect, is_main, R(estimate) AS estimate, R(pse) AS pse, R(me) AS me, R(sme) AS sme, abs(estimate) > me AND pse > 0 AS significant FROM ef JOIN mg ON ef.model = mg.model""",
)
def _(spark, sf):
    return doe.lenth(_factorial(spark, sf), ["model"])


@query(
    "win14_half_normal",
    f"""WITH RECURSIVE {_EFFECTS}, hn AS (SELECT model, effect, abs(estimate) AS size, (row_number() OVER (PARTITION BY model ORDER BY abs(estimate), effect) - 0.5 + count(*) OVER (PARTITION BY model)) / (2.0 * count(*) OVER (PARTITION BY model)) AS p FROM ef),
{tails.bisect('hn', 'model, effect, size, p', f"{tails.norm_sf('x')} > 1 - p", 10)} SELECT model, effect, R(size) AS absolute_effect, R(lo) AS expected_quantile FROM quantile""",
)
def _(spark, sf):
    return doe.half_normal(_factorial(spark, sf), ["model"])


_VERSUS = """cells AS (SELECT {g}, variant_name, task_id, repetition, round(avg(score), 9) AS score FROM {t} GROUP BY ALL),
d AS (SELECT x.{g}, x.variant_name, round(x.score - y.score, 9) AS d FROM cells x JOIN best ON best.{g} = x.{g} AND best.variant_name <> x.variant_name
  JOIN cells y ON y.{g} = best.{g} AND y.variant_name = best.variant_name AND y.task_id = x.task_id AND y.repetition = x.repetition)"""
_COMP = """c AS (SELECT {g}, sum(weight * m) * 100 AS composite, CAST(sum(n) AS BIGINT) AS trials FROM
(SELECT {g}, task_type, avg(score) AS m, count(*) AS n FROM {t} GROUP BY ALL) JOIN type_weights USING (task_type) GROUP BY ALL)"""


@query(
    "stat28_override_detect",
    f"""WITH RECURSIVE {_COMP.format(g='run_id, variant_name', t='trials')}, best AS (SELECT * FROM c WHERE variant_name = 'v_0'), {_VERSUS.format(g='run_id', t='trials')}, {tails.signed_rank('run_id, variant_name')},
j AS (SELECT c.run_id, c.variant_name, c.composite, best.composite AS won, c.trials >= 5 AND best.trials >= 5 AS enough, p_value AS p FROM c JOIN best ON c.run_id = best.run_id LEFT JOIN tests ON tests.run_id = c.run_id AND tests.variant_name = c.variant_name),
o AS (SELECT run_id, any_value(won) AS won, max(CASE WHEN composite > won AND (NOT enough OR coalesce(p < 0.4, false)) THEN {{'c': composite, 'v': variant_name, 'p': CASE WHEN enough THEN p END}} END) AS b FROM j GROUP BY 1)
SELECT run_id, R(won) AS winner_score, b IS NOT NULL AS override_detected, b.v AS best_combination, R(coalesce(b.c, won)) AS best_score, R(b.p) AS p_value FROM o""",
)
def _(spark, sf):
    return doe.detect_override(v.trials(spark, sf), ["run_id"], "v_0", alpha=0.4)


@query(
    "txt42_parse_combination",
    """WITH c AS (SELECT trial_id, CASE WHEN trial_id % 3 = 0 THEN variant_name ELSE 'layout=' || variant_name || '+ model = ' || model END AS name, variant_name, model FROM trials)
SELECT trial_id, name, CASE WHEN trial_id % 3 = 0 THEN 'combination:' || variant_name ELSE 'layout:' || variant_name || ',model:' || model END AS parsed FROM c""",
)
def _(spark, sf):
    full = F.concat(F.lit("layout="), "variant_name", F.lit("+ model = "), "model")
    name = F.when(F.col("trial_id") % 3 == 0, F.col("variant_name")).otherwise(full)
    df = v.trials(spark, sf).select("trial_id", name.alias("name"))
    entries = F.transform(F.map_entries(doe.parse_combination(F.col("name"))), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return df.withColumn("parsed", F.array_join(F.array_sort(entries), ","))


# ---- selection -----------------------------------------------------------
@query("stat29_score_variants")
def _(spark, sf):
    tr = v.trials(spark, sf)
    ci = st.bootstrap_ci(tr, ["variant_name"], "score", n_resamples=1_000)
    enough = F.col("trials") >= 3
    return t.composite_score(tr).join(ci, "variant_name").select(
        "variant_name", "composite", "trials",
        F.when(enough, F.col("ci_lower")).alias("ci_lower"), F.when(enough, F.col("ci_upper")).alias("ci_upper"),
    )


@query(
    "stat30_beam_candidates",
    f"""WITH {_COMP.format(g='model, variant_name', t='trials')}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY composite DESC, variant_name) AS rank FROM c)
SELECT model, variant_name, R(composite) AS composite, trials, rank FROM r WHERE rank <= 4""",
)
def _(spark, sf):
    return doe.select_beam(v.trials(spark, sf), ["model"], width=2).select("model", "variant_name", "composite", "trials", "rank")


def _beam_sql(g, t, columns):
    return f"""{_COMP.format(g=f'{g}, variant_name', t=t)}, rk AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY composite DESC, variant_name) AS rank FROM c), best AS (SELECT * FROM rk WHERE rank = 1),
{_VERSUS.format(g=g, t=t)}, {tails.signed_rank(f'{g}, variant_name')},
bm AS (SELECT rk.{g}, rk.variant_name, composite, trials, rank, pairs, p_value, CASE WHEN pairs >= 5 AND rank > 1 THEN p_value >= 0.1 END AS parity FROM rk LEFT JOIN tests ON tests.{g} = rk.{g} AND tests.variant_name = rk.variant_name WHERE rank <= 4),
kept AS (SELECT *, rank <= 2 OR NOT coalesce(pairs >= 5, false) OR coalesce(parity, false) AS retained FROM bm)
SELECT {g}, variant_name, R(composite) AS composite, trials, rank, pairs, R(p_value) AS p_value, parity AS within_parity, retained{columns} FROM kept"""


@query("stat30_select_beam", f"WITH RECURSIVE {_beam_sql('model', 'trials', '')}")
def _(spark, sf):
    return doe.select_beam(v.trials(spark, sf), ["model"], width=2)


@query(
    "stat31_beam_cascade",
    f"""WITH RECURSIVE ax AS (SELECT *, CAST(substr(variant_name, 3) AS BIGINT) % 2 AS axis FROM trials), {_beam_sql('axis', 'ax', ', retained AND axis = (SELECT max(axis) FROM kept) AS final')}""",
)
def _(spark, sf):
    """All axes in one job; the last axis with trials gives the final beam."""
    axis = (F.substring("variant_name", 3, 5).cast("long") % 2).alias("axis")
    beams = doe.select_beam(v.trials(spark, sf).select("*", axis), ["axis"], width=2)
    last = beams.agg(F.max("axis")).scalar()
    return beams.withColumn("final", F.col("retained") & (F.col("axis") == last))


_SIDES = "SELECT *, CASE source WHEN 'src_0' THEN 'constant' WHEN 'src_1' THEN 'adapted' END AS framing FROM trials WHERE source <> 'src_2'"


@query(
    "join18_framing_join",
    f"""WITH fr AS ({_SIDES}), {_COMP.format(g='framing, variant_name', t='fr')}
SELECT a.variant_name, R(a.composite) AS constant, a.trials AS constant_trials, R(b.composite) AS adapted, b.trials AS adapted_trials, R(b.composite - a.composite) AS score_difference
FROM c a JOIN c b ON a.variant_name = b.variant_name AND a.framing = 'constant' AND b.framing = 'adapted'""",
)
def _(spark, sf):
    return doe.framing_join(v.trials(spark, sf), F.col("source") == "src_0", F.col("source") == "src_1")


_FRAMINGS = f"""fr AS ({_SIDES}), {_COMP.format(g='framing, variant_name', t='fr')}, cl AS (SELECT framing, variant_name, task_id, repetition, round(avg(score), 9) AS score FROM fr GROUP BY ALL),
d AS (SELECT x.variant_name, round(x.score - y.score, 9) AS d FROM cl x JOIN cl y ON x.framing = 'constant' AND y.framing = 'adapted' AND x.variant_name = y.variant_name AND x.task_id = y.task_id AND x.repetition = y.repetition),
{tails.signed_rank('variant_name')},
cf AS (SELECT a.variant_name, a.composite AS constant, a.trials AS constant_trials, b.composite AS adapted, b.trials AS adapted_trials, b.composite - a.composite AS diff, pairs, p_value, p_value < 0.05 AS significant
FROM c a JOIN c b ON a.variant_name = b.variant_name AND a.framing = 'constant' AND b.framing = 'adapted' LEFT JOIN tests ON tests.variant_name = a.variant_name),
bf AS (SELECT *, CASE WHEN NOT coalesce(pairs >= 5 AND significant, false) OR abs(diff) < 0.1 THEN 'no_difference' WHEN diff > 0 THEN 'adapted' ELSE 'constant' END AS better FROM cf)"""


@query(
    "stat33_compare_framings",
    f"""WITH RECURSIVE {_FRAMINGS} SELECT variant_name, R(constant) AS constant, constant_trials, R(adapted) AS adapted, adapted_trials, R(diff) AS score_difference, pairs, R(p_value) AS p_value, significant, better AS better_framing FROM bf""",
)
def _(spark, sf):
    return doe.compare_framings(v.trials(spark, sf), F.col("source") == "src_0", F.col("source") == "src_1")


@query(
    "stat33_framing_report",
    f"""WITH RECURSIVE {_FRAMINGS}, a AS (SELECT count(*) FILTER (better = 'constant') AS fc, count(*) FILTER (better = 'adapted') AS fa, count(*) FILTER (better = 'no_difference') AS nd, avg(diff) AS md FROM bf)
SELECT fc AS favoring_constant, fa AS favoring_adapted, nd AS no_difference, R(md) AS mean_difference, CASE WHEN fa > fc THEN 'adapted' WHEN fc > fa THEN 'constant' ELSE 'mixed' END AS overall FROM a""",
)
def _(spark, sf):
    return doe.framing_report(doe.compare_framings(v.trials(spark, sf), F.col("source") == "src_0", F.col("source") == "src_1"))


@query(
    "set02_ordering_compare",
    f"""WITH {_COMP.format(g='phase, source, variant_name', t='trials')}, r AS (SELECT *, row_number() OVER (PARTITION BY phase, source ORDER BY composite DESC, variant_name) AS k FROM c),
s AS (SELECT phase, source, string_agg(variant_name, ',' ORDER BY variant_name) AS beam FROM r WHERE k <= 2 GROUP BY ALL)
SELECT a.source AS axis, a.beam AS beam_a, b.beam AS beam_b, a.beam <> b.beam AS differs FROM s a JOIN s b ON a.source = b.source AND a.phase = 'screening' AND b.phase = 'refinement'""",
)
def _(spark, sf):
    """Which axes keep different beams under two orderings (here: two phases)."""
    scored = t.composite_score(v.trials(spark, sf), "phase", "source", "variant_name")
    top = m.top_per_group(scored, ["phase", "source"], [F.desc("composite"), "variant_name"], 2)
    beam = lambda p: F.array_join(F.array_sort(F.collect_set(F.when(F.col("phase") == p, F.col("variant_name")))), ",")
    both = top.groupBy(F.col("source").alias("axis")).agg(beam("screening").alias("beam_a"), beam("refinement").alias("beam_b"))
    return both.withColumn("differs", F.col("beam_a") != F.col("beam_b"))


@query(
    "stat35_token_efficiency",
    f"""WITH {_COMP.format(g='variant_name', t='trials')}, k AS (SELECT variant_name, avg(prompt_tokens) AS tok FROM trials GROUP BY 1), x AS (SELECT * FROM c JOIN k USING (variant_name)), b AS (SELECT composite AS bc, tok AS bt FROM x WHERE variant_name = 'v_0')
SELECT variant_name, R(composite) AS composite, R(tok) AS index_tokens, R(composite / (tok / 1000)) AS density, R(composite / (tok / bt)) AS efficiency_ratio,
R(CASE WHEN variant_name <> 'v_0' THEN (tok - bt) / (composite - bc) END) AS marginal_cost FROM x, b""",
)
def _(spark, sf):
    return doe.token_efficiency(v.trials(spark, sf), "v_0")


@query(
    "stat36_sentinel_drift",
    """WITH s AS (SELECT * FROM trials WHERE trial_id % 11 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY run_id, model ORDER BY ts_us, trial_id) AS i, row_number() OVER (PARTITION BY run_id, model ORDER BY ts_us DESC, trial_id DESC) AS j FROM s),
a AS (SELECT run_id, model, avg(score) FILTER (i <= 10) AS s0, avg(score) FILTER (j <= 10) AS s1 FROM r GROUP BY ALL)
SELECT run_id, model, R(s0) AS start_score, R(s1) AS end_score, R(abs(s1 - s0)) AS drift, abs(s1 - s0) > 0.05 AS flagged FROM a""",
)
def _(spark, sf):
    return doe.sentinel_drift(v.trials(spark, sf).where(F.col("task_type") == "retrieval"))
