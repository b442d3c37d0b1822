"""Queries over ordered trials: curves, corrections, monitors, top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trialspark import views as v
from trialspark.operators import curves as c
from trialspark.operators import monitor as m
from trialspark.operators import trials as t
from trialspark.plans.registry import query

_CURVE = """first_seen AS (SELECT variant_name, task_id, min(trial_id) AS f FROM trials GROUP BY ALL),
pos AS (SELECT *, row_number() OVER (PARTITION BY variant_name ORDER BY f) AS pos, count(*) OVER (PARTITION BY variant_name) AS n FROM first_seen),
cps AS (SELECT variant_name, unnest(list_append(range(20, n, 10), n)) AS task_count FROM (SELECT DISTINCT variant_name, n FROM pos)),
curve_types AS (SELECT k.variant_name, task_count, task_type, avg(score) AS m, count(*) AS n FROM cps k JOIN pos p ON p.variant_name = k.variant_name AND p.pos <= k.task_count
  JOIN trials t ON t.variant_name = p.variant_name AND t.task_id = p.task_id GROUP BY ALL),
curve AS (SELECT variant_name, CAST(task_count AS BIGINT) AS task_count, sum(weight * m) * 100 AS composite, CAST(sum(n) AS BIGINT) AS trials
  FROM curve_types JOIN type_weights USING (task_type) GROUP BY ALL)"""
_POINTS = """numbered AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY variant_name) AS points,
  max(composite) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - min(composite) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS spread
  FROM curve WINDOW w AS (PARTITION BY variant_name ORDER BY task_count)),
points AS (SELECT variant_name, max(points) AS points, max(spread) FILTER (i = greatest(1, floor(points * 0.8)) + 1) AS tail_range,
  min(task_count) FILTER (spread <= {th}) AS first_flat FROM numbered GROUP BY 1)"""
_GRID = """grid AS (SELECT * FROM (SELECT DISTINCT task_count FROM curve), (SELECT DISTINCT variant_name FROM curve)),
carried AS (SELECT g.variant_name, g.task_count, last_value(composite IGNORE NULLS) OVER (PARTITION BY g.variant_name ORDER BY g.task_count) AS composite
  FROM grid g LEFT JOIN curve c ON g.variant_name = c.variant_name AND g.task_count = c.task_count)"""
_STABLE = """ranked AS (SELECT *, row_number() OVER (PARTITION BY task_count ORDER BY composite DESC, variant_name) AS rank FROM carried),
maps AS (SELECT task_count, string_agg(variant_name, '>' ORDER BY rank) AS ranking FROM ranked GROUP BY 1),
stable AS (SELECT task_count, ranking, coalesce(lag(ranking) OVER (ORDER BY task_count) <> ranking, false) AS ranking_changed FROM maps)"""
# the curves of the test tables never flatten to one point, so the flat cases use a wider band
_BAND = 3.0


def _curve(spark, sf):
    return c.learning_curve(v.trials(spark, sf))


@query("win03_learning_curve", f"WITH {_CURVE} SELECT variant_name, task_count, R(composite) AS composite, trials FROM curve")
def _(spark, sf):
    return _curve(spark, sf)


@query(
    "win04_saturation_point",
    f"""WITH {_CURVE}, {_POINTS.format(th=_BAND)} SELECT variant_name, points, R(tail_range) AS tail_range, tail_range <= {_BAND} AS saturated,
CASE WHEN tail_range <= {_BAND} THEN first_flat END AS saturation_point FROM points""",
)
def _(spark, sf):
    return c.saturation_point(_curve(spark, sf), threshold=_BAND)


@query("join13_carry_forward", f"WITH {_CURVE}, {_GRID} SELECT variant_name, task_count, R(composite) AS composite FROM carried")
def _(spark, sf):
    return c.carry_forward(_curve(spark, sf))


@query("win05_ranking_stability", f"WITH {_CURVE}, {_GRID}, {_STABLE} SELECT * FROM stable")
def _(spark, sf):
    return c.ranking_stability(_curve(spark, sf))


@query(
    "win06_saturation_report",
    f"""WITH {_CURVE}, {_POINTS.format(th=1.0)}, {_GRID}, {_STABLE},
tailing AS (SELECT *, row_number() OVER (ORDER BY task_count) AS i, count(*) OVER () AS n FROM stable),
quiet AS (SELECT count(*) FILTER (ranking_changed AND i > greatest(1, floor(n * 0.8))) = 0 AS q FROM tailing),
flags AS (SELECT bool_and(tail_range <= 1) AS a, max(CASE WHEN tail_range <= 1 THEN first_flat END) AS p, count(*) AS n FROM points)
SELECT a AS all_saturated, CASE WHEN a THEN p END AS recommended_tasks, n AS variants, q AS ranking_stable, a AND q AS overall_saturated FROM flags, quiet""",
)
def _(spark, sf):
    return c.saturation_report(_curve(spark, sf))


@query(
    "win02_rank_variants",
    """WITH s AS (SELECT run_id, variant_name, sum(weight * m) * 100 AS composite FROM
(SELECT run_id, variant_name, task_type, avg(score) AS m FROM trials GROUP BY ALL) JOIN type_weights USING (task_type) GROUP BY ALL)
SELECT run_id, variant_name, R(composite) AS composite, row_number() OVER (PARTITION BY run_id ORDER BY composite DESC, variant_name) AS rank FROM s""",
)
def _(spark, sf):
    w = Window.partitionBy("run_id").orderBy(F.desc("composite"), "variant_name")
    scored = t.composite_score(v.trials(spark, sf), "run_id", "variant_name").drop("trials")
    return scored.withColumn("rank", F.row_number().over(w))


# p-like numbers in (0, 1) per cell of the trial table, one family per run
_TESTS = """tests AS (SELECT run_id, variant_name || '/' || task_type AS test, floor(avg(score) * avg(score) * 1000) / 20000 AS p_value FROM trials GROUP BY run_id, variant_name, task_type)"""


def _tests(spark, sf):
    cells = v.trials(spark, sf).groupBy("run_id", "variant_name", "task_type").agg(F.avg("score").alias("a"))
    return cells.select(
        "run_id",
        F.concat_ws("/", "variant_name", "task_type").alias("test"),
        (F.floor(F.col("a") * F.col("a") * 1000) / 20000).alias("p_value"),
    )


@query(
    "win07_holm",
    f"""WITH {_TESTS}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY p_value, test) AS k, count(*) OVER (PARTITION BY run_id) AS m FROM tests),
c AS (SELECT *, max(least(p_value * (m - k + 1), 1.0)) OVER (PARTITION BY run_id ORDER BY k) AS c FROM r)
SELECT run_id, test, R(p_value) AS p_value, R(c) AS corrected_p, c < 0.05 AS significant FROM c""",
)
def _(spark, sf):
    return c.holm(_tests(spark, sf), ["run_id"], ["test"])


@query(
    "win08_benjamini_hochberg",
    f"""WITH {_TESTS}, r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY p_value, test) AS k, count(*) OVER (PARTITION BY run_id) AS m FROM tests),
c AS (SELECT *, min(least(p_value * m / k, 1.0)) OVER (PARTITION BY run_id ORDER BY k DESC) AS c FROM r)
SELECT run_id, test, R(p_value) AS p_value, R(c) AS corrected_p, c <= 0.05 AS significant FROM c""",
)
def _(spark, sf):
    return c.benjamini_hochberg(_tests(spark, sf), ["run_id"], ["test"])


# ---- monitors ------------------------------------------------------------
_MONEY = "CAST(coalesce(cost, 0) AS DECIMAL(24, 9))"


@query(
    "win09_cost_anomaly",
    f"""WITH s AS (SELECT trial_id, model, cost, CAST(sum({_MONEY}) OVER w AS DOUBLE) / count(*) OVER w AS em FROM trials WHERE cost IS NOT NULL
WINDOW w AS (PARTITION BY model ORDER BY ts_us, trial_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT trial_id, model, R(cost) AS cost, R(em) AS earlier_mean, R(cost / em) AS multiplier FROM s WHERE em > 0 AND cost > 3 * em""",
)
def _(spark, sf):
    return m.cost_anomalies(v.trials(spark, sf))


def _burn_sql(window, threshold):
    return f"""WITH s AS (SELECT trial_id, model, ts_us, CAST(sum({_MONEY}) OVER w AS DOUBLE) * {60 / window!r} AS b, count(*) OVER w AS n FROM trials
WINDOW w AS (PARTITION BY model ORDER BY ts_us RANGE BETWEEN {window * 1_000_000} PRECEDING AND CURRENT ROW))
SELECT trial_id, model, ts_us, R(b) AS burn_per_minute, n AS events FROM s WHERE n > 1 AND b > {threshold}"""


@query("win10_burn_rate", _burn_sql(60, 0.05))
def _(spark, sf):
    return m.burn_rate(v.trials(spark, sf), 0.05)


@query("win10_burn_rate_half_hour", _burn_sql(1800, 0.004))
def _(spark, sf):
    return m.burn_rate(v.trials(spark, sf), 0.004, 1800)


BUDGETS = {"m_0": 40.0, "m_1": 60.0, "m_2": 90.0}
_BUDGETS = "CASE model WHEN 'm_0' THEN 40.0 WHEN 'm_1' THEN 60.0 WHEN 'm_2' THEN 90.0 END"


@query(
    "win11_budget_exceeded",
    f"""WITH s AS (SELECT trial_id, model, CAST(sum({_MONEY}) OVER (PARTITION BY model ORDER BY ts_us, trial_id) AS DOUBLE) AS spent, {_BUDGETS}::DOUBLE AS budget FROM trials)
SELECT trial_id, model, R(spent) AS spent, R(budget) AS budget FROM s WHERE spent > budget""",
)
def _(spark, sf):
    return m.budget_exceeded(v.trials(spark, sf), BUDGETS, ["model"])


@query(
    "win11_global_cap",
    f"""WITH s AS (SELECT trial_id, CAST(sum({_MONEY}) OVER (ORDER BY ts_us, trial_id) AS DOUBLE) AS spent FROM trials)
SELECT trial_id, R(spent) AS spent, R(150) AS budget FROM s WHERE spent > 150""",
)
def _(spark, sf):
    return m.budget_exceeded(v.trials(spark, sf), {"*": 150.0}, [])


@query(
    "win11_budget_state",
    f"""WITH s AS (SELECT model, CAST(sum({_MONEY}) AS DOUBLE) AS spent, {_BUDGETS}::DOUBLE AS budget FROM trials GROUP BY model)
SELECT model, R(spent) AS spent, R(budget) AS budget, R(budget - spent) AS remaining, spent > budget AS exhausted FROM s""",
)
def _(spark, sf):
    return m.budget_state(v.trials(spark, sf), BUDGETS)


@query(
    "win12_burn_chart",
    f"""SELECT run_id, trial_id, row_number() OVER w AS step, R(CAST(sum({_MONEY}) OVER w AS DOUBLE)) AS spent, R(25) AS budget FROM trials
WINDOW w AS (PARTITION BY run_id ORDER BY trial_id)""",
)
def _(spark, sf):
    return m.burn_chart(v.trials(spark, sf), 25.0)


@query(
    "win13_response_retention",
    """WITH s AS (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id DESC) AS kept FROM docs)
SELECT doc_id, n_chars FROM s WHERE kept <= 400000""",
)
def _(spark, sf):
    return m.retained(v.docs(spark, sf).select("doc_id", "n_chars"), "n_chars", ["doc_id"], 400000)


@query(
    "win15_trial_rate_eta",
    """WITH r AS (SELECT run_id, ts_us, row_number() OVER (PARTITION BY run_id ORDER BY ts_us DESC, trial_id DESC) AS n, count(*) OVER (PARTITION BY run_id) AS done FROM trials),
a AS (SELECT run_id, count(*) AS recent, max(done) AS done, (count(*) - 1) / ((max(ts_us) - min(ts_us)) / 60e6) AS rate FROM r WHERE n <= 1000 GROUP BY 1)
SELECT run_id, recent, done, R(rate) AS per_minute, R(greatest(200000 - done, 0) / rate) AS minutes_left FROM a""",
)
def _(spark, sf):
    return m.trial_rate(v.trials(spark, sf), 200000)


# ---- top-k ---------------------------------------------------------------
@query(
    "top01_beam_top_k",
    """WITH s AS (SELECT phase, variant_name, sum(weight * m) * 100 AS composite FROM
(SELECT phase, variant_name, task_type, avg(score) AS m FROM trials GROUP BY ALL) JOIN type_weights USING (task_type) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY composite DESC, variant_name) AS rank FROM s)
SELECT phase, variant_name, R(composite) AS composite, rank FROM r WHERE rank <= 3""",
)
def _(spark, sf):
    scored = t.composite_score(v.trials(spark, sf), "phase", "variant_name").drop("trials")
    return m.top_per_group(scored, ["phase"], [F.desc("composite"), "variant_name"], 3)


@query(
    "top02_first_n_files",
    "SELECT source, rel_path, rank FROM (SELECT source, rel_path, row_number() OVER (PARTITION BY source ORDER BY rel_path) AS rank FROM docs) WHERE rank <= 15",
)
def _(spark, sf):
    return m.top_per_group(v.docs(spark, sf).select("source", "rel_path"), ["source"], ["rel_path"], 15)


@query(
    "top03_recent_trials",
    "SELECT trial_id, run_id, ts_us, R(score) AS score FROM trials ORDER BY ts_us DESC, trial_id DESC LIMIT 50",
)
def _(spark, sf):
    df = v.trials(spark, sf).select("trial_id", "run_id", "ts_us", "score")
    return df.orderBy(F.desc("ts_us"), F.desc("trial_id")).limit(50)


@query(
    "str07_stale_runs_batch",
    """WITH n AS (SELECT max(heartbeat_us) + 5 AS now_us FROM runs), l AS (SELECT run_id, status, coalesce(status = 'active' AND now_us - heartbeat_us > 300000000, false) AS was_stale FROM runs, n)
SELECT run_id, CASE WHEN was_stale THEN 'failed' ELSE status END AS status, was_stale FROM l""",
)
def _(spark, sf):
    runs = v.runs(spark, sf)
    now = runs.agg(F.max("heartbeat_us") + 5).scalar()
    return m.stale_runs(runs, now).select("run_id", "status", "was_stale")
