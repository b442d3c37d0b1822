"""Queries over trials and runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trialspark import views as v
from trialspark.constants import TASK_TYPES
from trialspark.operators import ordered as o
from trialspark.operators import trials as t
from trialspark.plans.registry import query

VARIANTS = [f"v_{i}" for i in range(7)]
RUNS = [f"run_{i}" for i in range(6)]
BIG_RUNS = "'run_1996', 'run_1997'"


def tasks_of(spark, sf):
    return v.trials(spark, sf).select("task_id", "task_type").distinct()


# ---- filters -------------------------------------------------------------
@query(
    "src08_source_routing",
    "SELECT source, count(*) AS docs, CAST(sum(token_count) AS BIGINT) AS tokens FROM docs WHERE source = 'src3' GROUP BY source",
)
def _(spark, sf):
    one = v.docs(spark, sf).where(F.col("source") == "src3")
    return one.groupBy("source").agg(t.n_rows().alias("docs"), F.sum("token_count").alias("tokens"))


@query(
    "fil01_trials_of_run",
    "SELECT trial_id, variant_name, R(score) AS score FROM trials WHERE run_id = 'run_1' AND model = 'm_1' AND source = 'src_0'",
)
def _(spark, sf):
    return t.trials_of_run(v.trials(spark, sf), "run_1", "m_1", "src_0").select("trial_id", "variant_name", "score")


@query(
    "fil02_cross_run_trials",
    "SELECT CASE run_id WHEN 'run_4' THEN 0 ELSE 1 END::BIGINT AS run_pos, trial_id, model, R(score) AS score FROM trials "
    "WHERE run_id IN ('run_4', 'run_2') AND variant_name = 'v_3'",
)
def _(spark, sf):
    df = t.cross_run_trials(v.trials(spark, sf), ["run_4", "run_2"], variant="v_3")
    return df.select("run_pos", "trial_id", "model", "score")


@query(
    "fil03_task_filter",
    "SELECT DISTINCT task_id, task_type FROM trials WHERE task_type IN ('retrieval', 'negative') ORDER BY task_id LIMIT 25",
)
def _(spark, sf):
    return t.task_filter(tasks_of(spark, sf), types=["retrieval", "negative"], limit=25)


@query(
    "fil03_task_filter_per_type",
    "SELECT task_id, task_type FROM (SELECT *, row_number() OVER (PARTITION BY task_type ORDER BY task_id) AS n "
    "FROM (SELECT DISTINCT task_id, task_type FROM trials)) WHERE n <= 4",
)
def _(spark, sf):
    return t.task_filter(tasks_of(spark, sf), limit_per_type=4)


@query(
    "fil04_variant_filter",
    "SELECT variant_name, CAST(substr(variant_name, 3) AS BIGINT) % 3 AS axis, count(*) AS trials FROM trials "
    "WHERE CAST(substr(variant_name, 3) AS BIGINT) % 3 = 1 GROUP BY ALL",
)
def _(spark, sf):
    axis = (F.substring("variant_name", 3, 5).cast("long") % 3).alias("axis")
    variants = v.trials(spark, sf).groupBy("variant_name", axis).agg(t.n_rows().alias("trials"))
    return t.variant_filter(variants, axis=1)


@query(
    "fil05_runs_page",
    "SELECT run_id, status, created_us FROM runs ORDER BY created_us DESC, run_id LIMIT 3 OFFSET 1",
)
def _(spark, sf):
    return t.runs_page(v.runs(spark, sf), 3, 1).select("run_id", "status", "created_us")


@query(
    "fil08_completed_cost_trend",
    "SELECT run_id, count(*) AS total_trials, R(sum(coalesce(cost, 0))) AS total_cost FROM trials "
    "WHERE run_id IN (SELECT run_id FROM runs WHERE status = 'completed') GROUP BY run_id",
)
def _(spark, sf):
    done = v.runs(spark, sf).where("status = 'completed'").select("run_id")
    return done.join(t.run_summary(v.trials(spark, sf)), "run_id").select("run_id", "total_trials", "total_cost")


@query(
    "fil10_judge_sample",
    "SELECT trial_id, R(round(abs(score - latency_seconds / 5), 4)) AS delta FROM trials WHERE trial_id % 50 = 0",
)
def _(spark, sf):
    judge = F.col("latency_seconds") / 5
    return (
        v.trials(spark, sf)
        .where(F.col("trial_id") % 50 == 0)
        .select("trial_id", F.round(F.abs(F.col("score") - judge), 4).alias("delta"))
    )


# ---- run level -----------------------------------------------------------
_SUMMARY = "count(*) AS total_trials, R(sum(coalesce(cost, 0))) AS total_cost, R(avg(latency_seconds)) AS avg_latency"


@query("agg01_run_summary", f"SELECT run_id, {_SUMMARY} FROM trials GROUP BY run_id")
def _(spark, sf):
    return t.run_summary(v.trials(spark, sf))


@query(
    "join01_run_summary_join",
    f"""WITH s AS (SELECT run_id, {_SUMMARY} FROM trials WHERE run_id <> 'run_5' GROUP BY run_id)
SELECT r.run_id, r.status, coalesce(total_trials, 0) AS total_trials, coalesce(total_cost, 0) AS total_cost,
coalesce(avg_latency, 0) AS avg_latency FROM runs r LEFT JOIN s ON r.run_id = s.run_id""",
)
def _(spark, sf):
    some = v.trials(spark, sf).where("run_id <> 'run_5'")
    return t.run_summary_join(v.runs(spark, sf).select("run_id", "status"), some)


_AGGREGATES = """count(*) AS total_trials, R(avg(score)) AS avg_score, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
R(avg(latency_seconds)) AS avg_latency"""


@query(
    "agg02_run_aggregates",
    f"SELECT run_id, variant_name, {_AGGREGATES} FROM trials GROUP BY GROUPING SETS ((run_id), (run_id, variant_name))",
)
def _(spark, sf):
    return t.run_aggregates(v.trials(spark, sf))


@query(
    "agg03_run_enriched",
    """SELECT run_id, model, count(*) AS total_trials, count(*) FILTER (error IS NULL) AS completed,
count(DISTINCT task_id) AS tasks, R(avg(score)) AS avg_score, R(sum(coalesce(cost, 0))) AS total_cost
FROM trials GROUP BY GROUPING SETS ((run_id), (run_id, model))""",
)
def _(spark, sf):
    return t.run_enriched(v.trials(spark, sf))


def _breakdown_sql():
    part = "SELECT '{d}' AS dimension, {k} AS key, count(*) AS count, R(avg(score)) AS mean_score, R(sum(coalesce(cost, 0))) AS total_cost FROM trials{g}"
    dims = [("variant", "variant_name"), ("task_type", "task_type"), ("source", "source")]
    parts = [part.format(d=d, k=k, g=f" GROUP BY {k}") for d, k in dims]
    return " UNION ALL ".join([*parts, part.format(d="all", k="'all'", g="")])


@query("agg04_report_breakdown", _breakdown_sql())
def _(spark, sf):
    return t.report_breakdown(v.trials(spark, sf))


@query(
    "agg05_type_means",
    "SELECT variant_name, task_type, R(avg(score)) AS mean_score, count(*) AS n FROM trials GROUP BY ALL",
)
def _(spark, sf):
    return t.type_means(v.trials(spark, sf))


_COMPOSITE = """SELECT variant_name, sum(weight * m) * 100 AS composite, CAST(sum(n) AS BIGINT) AS trials
FROM (SELECT variant_name, task_type, avg(score) AS m, count(*) AS n FROM trials GROUP BY ALL) JOIN type_weights USING (task_type)
GROUP BY variant_name"""


@query(
    "agg06_composite_score",
    f"""WITH c AS ({_COMPOSITE}) SELECT variant_name, R(composite) AS composite, trials,
row_number() OVER (ORDER BY composite DESC, variant_name) AS rank FROM c""",
)
def _(spark, sf):
    scored = t.composite_score(v.trials(spark, sf))
    # one row per variant: ranking them is a window over the registered variants only
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("composite"), "variant_name")))


_SENS = """m AS (SELECT variant_name, task_type, avg(score) AS m FROM trials GROUP BY ALL),
c AS (SELECT scheme, variant_name, sum(weight * m) * 100 AS composite FROM m JOIN weight_schemes USING (task_type) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY scheme ORDER BY composite DESC, variant_name) AS rank FROM c)"""


@query(
    "agg07_weight_sensitivity",
    f"WITH {_SENS} SELECT scheme, variant_name, R(composite) AS composite, rank, "
    "max(CASE WHEN rank = 1 THEN variant_name END) OVER (PARTITION BY scheme) AS winner FROM r",
)
def _(spark, sf):
    return t.weight_sensitivity(v.trials(spark, sf))


@query(
    "agg07_weight_stability",
    f"""WITH {_SENS}, d AS (SELECT variant_name AS dw FROM r WHERE scheme = 'default' AND rank = 1)
SELECT max(dw) AS default_winner, count(*) FILTER (variant_name <> dw) = 0 AS winner_stable,
coalesce(string_agg(scheme, ',' ORDER BY scheme) FILTER (variant_name <> dw), '') AS changed_schemes FROM r, d WHERE rank = 1""",
)
def _(spark, sf):
    return t.weight_stability(t.weight_sensitivity(v.trials(spark, sf)))


# ---- history -------------------------------------------------------------
@query(
    "agg08_variant_trend",
    "SELECT run_id, R(avg(score)) AS avg_score, R(avg(coalesce(cost, 0))) AS avg_cost, count(*) AS trial_count FROM trials "
    "WHERE variant_name = 'v_2' GROUP BY run_id",
)
def _(spark, sf):
    return t.variant_trend(v.trials(spark, sf), "v_2")


@query(
    "agg09_cost_trend",
    "SELECT run_id, R(sum(coalesce(cost, 0))) AS total_cost, R(sum(coalesce(cost, 0)) / count(*)) AS avg_cost_per_trial FROM trials_big GROUP BY run_id",
)
def _(spark, sf):
    return t.cost_trend(v.trials_big(spark, sf))


@query(
    "agg10_model_ranking",
    "SELECT model, R(avg(score)) AS avg_score, count(*) AS total_trials, R(avg(coalesce(cost, 0))) AS avg_cost FROM trials_big GROUP BY model",
)
def _(spark, sf):
    return t.model_ranking(v.trials_big(spark, sf))


@query(
    "agg11_linked_run_counts",
    "SELECT chain_id, count(*) AS run_count, max(created_us) AS last_run_us FROM runs GROUP BY chain_id",
)
def _(spark, sf):
    return t.linked_runs(v.runs(spark, sf))


@query(
    "join04_regressions",
    f"""WITH a AS (SELECT run_id, variant_name, avg(score) AS m FROM trials_big WHERE run_id IN ({BIG_RUNS}) GROUP BY ALL)
SELECT b.variant_name, R(b.m) AS baseline_score, R(c.m) AS comparison_score, R(c.m - b.m) AS delta
FROM a b JOIN a c ON b.variant_name = c.variant_name AND b.run_id = 'run_1996' AND c.run_id = 'run_1997' WHERE c.m - b.m < -0.001""",
)
def _(spark, sf):
    return t.regressions(v.trials_big(spark, sf), "run_1996", "run_1997", 0.001)


@query(
    "win01_compare_runs",
    """WITH l AS (SELECT * FROM (VALUES (0, 'run_3'), (1, 'run_none'), (2, 'run_0'), (3, 'run_5')) AS t(pos, run_id)),
a AS (SELECT run_id, count(*) AS n, avg(score) AS s, sum(coalesce(cost, 0)) AS c, avg(latency_seconds) AS lat FROM trials GROUP BY run_id),
f AS (SELECT pos, l.run_id, coalesce(n, 0) AS n, coalesce(s, 0) AS s, coalesce(c, 0) AS c, coalesce(lat, 0) AS lat FROM l LEFT JOIN a ON l.run_id = a.run_id)
SELECT CAST(pos AS BIGINT) AS pos, run_id, n AS total_trials, R(s) AS avg_score, R(c) AS total_cost, R(lat) AS avg_latency,
R(coalesce(s - lag(s) OVER (ORDER BY pos), 0)) AS score_delta FROM f""",
)
def _(spark, sf):
    return t.compare_runs(v.trials(spark, sf), ["run_3", "run_none", "run_0", "run_5"])


@query(
    "join17_trial_plan",
    "SELECT task_id, task_type, v.name AS variant_name, CAST(r.r AS BIGINT) AS repetition FROM "
    "(SELECT DISTINCT task_id, task_type FROM trials), (SELECT unnest(['v_0', 'v_1', 'v_2']) AS name) v, (SELECT unnest(range(1, 4)) AS r) r",
)
def _(spark, sf):
    return t.trial_plan(tasks_of(spark, sf), ["v_0", "v_1", "v_2"], 3)


# ---- cost ----------------------------------------------------------------
@query(
    "agg12_axis_cost_report",
    """SELECT variant_name, count(DISTINCT task_id) AS tasks, R(sum(coalesce(cost, 0))) AS total_cost,
CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM trials GROUP BY ROLLUP (variant_name)""",
)
def _(spark, sf):
    return t.axis_cost_report(v.trials(spark, sf))


@query(
    "agg13_cost_summary",
    """SELECT variant_name, count(*) AS trials, R(sum(coalesce(cost, 0))) AS total_cost,
CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens FROM trials GROUP BY ROLLUP (variant_name)""",
)
def _(spark, sf):
    return t.cost_summary(v.trials(spark, sf))


@query(
    "agg14_projected_cost",
    """WITH a AS (SELECT run_id, count(*) AS done, sum(coalesce(cost, 0)) AS spent, sum(coalesce(cost, 0)) / count(*) * 5000 AS p FROM trials GROUP BY run_id)
SELECT run_id, done, R(spent) AS spent, R(p) AS projected, p > 200 AS over_budget, p > 400 AS pause FROM a""",
)
def _(spark, sf):
    return t.projected_cost(v.trials(spark, sf), 5000, 200.0, 2.0)


# ---- distributions -------------------------------------------------------
@query(
    "agg19_score_buckets",
    """SELECT CASE WHEN score = 0 THEN 'zero' WHEN score >= 1 THEN 'perfect' ELSE 'partial' END AS bucket, count(*) AS trials,
R(avg(total_tokens)) AS mean_tokens, R(avg(latency_seconds)) AS mean_latency, R(count(*) / (SELECT count(*) FROM trials)) AS share FROM trials GROUP BY 1""",
)
def _(spark, sf):
    return t.score_buckets(v.trials(spark, sf))


@query(
    "agg19_zeros_ones_by_type",
    """SELECT task_type, count(*) AS trials, count(*) FILTER (score = 0) AS zeros, count(*) FILTER (score >= 1) AS ones,
R(avg(score)) AS mean_score FROM trials GROUP BY task_type""",
)
def _(spark, sf):
    return t.zeros_ones_by_type(v.trials(spark, sf))


@query(
    "agg20_run_progress",
    """WITH d AS (SELECT variant_name, count(DISTINCT task_id || '/' || repetition) AS done FROM trials WHERE repetition <= 3 GROUP BY 1),
p AS (SELECT count(DISTINCT task_id) * 3 AS planned FROM trials)
SELECT variant_name, done, planned, R(done * 100.0 / planned) AS percent FROM d, p""",
)
def _(spark, sf):
    tr = v.trials(spark, sf)
    return t.run_progress(tr, tr, VARIANTS, 3)


@query(
    "agg21_robustness_range",
    """WITH m AS (SELECT variant_name, avg(score) AS s FROM trials GROUP BY 1)
SELECT R(max(s) - min(s)) AS score_range, CASE WHEN max(s) - min(s) > 0.1 THEN 'high' ELSE 'low' END AS sensitivity,
arg_max(variant_name, s) AS best_variant FROM m""",
)
def _(spark, sf):
    return t.robustness_range(v.trials(spark, sf))


@query(
    "agg22_box_data",
    """SELECT variant_name, count(*) AS n, R(min(score)) AS low, R(quantile_cont(score, 0.25)) AS q1, R(quantile_cont(score, 0.5)) AS median,
R(quantile_cont(score, 0.75)) AS q3, R(max(score)) AS high FROM trials GROUP BY 1""",
)
def _(spark, sf):
    probs = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    return o.exact_quantiles(v.trials(spark, sf), ["variant_name"], "score", probs)


@query(
    "agg23_radar_data",
    "SELECT model, "
    + ", ".join(f"R(avg(score) FILTER (task_type = '{x}')) AS {x}" for x in TASK_TYPES)
    + " FROM trials GROUP BY model",
)
def _(spark, sf):
    return t.radar_data(v.trials(spark, sf), TASK_TYPES)


@query(
    "agg24_interaction_data",
    "SELECT variant_name, model, R(avg(score)) AS mean_score, count(*) AS n FROM trials GROUP BY ALL",
)
def _(spark, sf):
    return t.interaction_data(v.trials(spark, sf), "variant_name", "model")
