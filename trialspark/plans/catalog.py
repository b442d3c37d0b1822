"""Queries for the catalog, costs, response reuse, run state and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark import views as v
from trialspark.functions import fixed_text as fx
from trialspark.operators import catalog as cat
from trialspark.operators import metrics as mt
from trialspark.operators import trials as t
from trialspark.plans.registry import query
from trialspark.session import scratch_path
from trialspark.sources import sinks

_ACTIVE = "removed_at IS NULL"
_N = "coalesce({}, 0)"


def _remote(spark, sf):
    return cat.catalog_normalize(v.remote_models_raw(spark, sf))


def _active(spark, sf):
    return v.local_models(spark, sf).where(_ACTIVE)


# ---- filters -------------------------------------------------------------
@query(
    "fil06_model_filter",
    f"""SELECT id, R(prompt_price) AS prompt_price, context_length FROM local_models WHERE {_ACTIVE} AND prompt_price <= 1.5 AND context_length >= 10000
AND modality = 'ECONOMY' AND list_has_all(supported_params, ['tools', 'json'])""",
)
def _(spark, sf):
    out = cat.model_filter(v.local_models(spark, sf), max_price=1.5, min_context=10000, modality="ECONOMY", capabilities=["tools", "json"])
    return out.select("id", "prompt_price", "context_length")


@query(
    "fil06_model_filter_substring",
    f"SELECT id, modality, tokenizer FROM local_models WHERE {_ACTIVE} AND contains(modality, 'A') AND tokenizer = 'Brand#4'",
)
def _(spark, sf):
    out = cat.model_filter(v.local_models(spark, sf), modality="A", modality_contains=True, tokenizer="Brand#4")
    return out.select("id", "modality", "tokenizer")


@query("fil07_model_search", "SELECT id, name FROM local_models WHERE contains(lower(id), 'ring') OR contains(lower(name), 'ring')")
def _(spark, sf):
    return cat.model_search(v.local_models(spark, sf), "RING").select("id", "name")


@query("sort04_model_sort", "SELECT id, R(prompt_price) AS prompt_price FROM local_models")
def _(spark, sf):
    return cat.model_sort(v.local_models(spark, sf), "-price").select("id", "prompt_price")


# ---- sync ----------------------------------------------------------------
_REMOTE = f"""rm AS (SELECT id, name, context_length, prompt_price, {_N.format('completion_price')} AS completion_price, modality, tokenizer FROM remote_models),
lo AS (SELECT * FROM local_models WHERE {_ACTIVE})"""


@query("set06_catalog_normalize", f"WITH {_REMOTE} SELECT id, name, context_length, R(prompt_price) AS prompt_price, R(completion_price) AS completion_price, modality, tokenizer FROM rm")
def _(spark, sf):
    return _remote(spark, sf)


@query(
    "join07_catalog_diff",
    f"""WITH {_REMOTE}, b AS (SELECT coalesce(lo.id, rm.id) AS id, lo.id AS l, rm.id AS r, lo.prompt_price AS lp, rm.prompt_price AS rp, lo.completion_price AS lc, rm.completion_price AS rc FROM lo FULL JOIN rm ON lo.id = rm.id)
SELECT id, 'added' AS change, NULL::VARCHAR AS field, NULL::DOUBLE AS old, NULL::DOUBLE AS new FROM b WHERE l IS NULL
UNION ALL SELECT id, 'removed', NULL, NULL, NULL FROM b WHERE r IS NULL
UNION ALL SELECT id, 'price', 'prompt_price', R(lp), R(rp) FROM b WHERE lp <> rp UNION ALL SELECT id, 'price', 'completion_price', R(lc), R(rc) FROM b WHERE lc <> rc""",
)
def _(spark, sf):
    return cat.catalog_diff(_active(spark, sf), _remote(spark, sf))


def _upsert_sql(back):
    return f"""WITH {_REMOTE} SELECT coalesce(l.id, rm.id) AS id, CASE WHEN rm.id IS NULL THEN l.name ELSE rm.name END AS name,
R(CASE WHEN rm.id IS NULL THEN l.prompt_price ELSE rm.prompt_price END) AS prompt_price, coalesce(first_seen, 200) AS first_seen,
CASE WHEN rm.id IS NULL THEN last_seen ELSE 200 END::BIGINT AS last_seen, CASE WHEN rm.id IS NULL THEN coalesce(removed_at, 200) ELSE {back} END::BIGINT AS removed_at
FROM local_models l FULL JOIN rm ON l.id = rm.id"""


def _upsert(spark, sf, revive):
    local = v.local_models(spark, sf).drop("supported_params")
    out = cat.catalog_upsert(local, _remote(spark, sf), F.lit(200).cast("long"), revive)
    return out.select("id", "name", "prompt_price", "first_seen", "last_seen", "removed_at")


@query("set05_catalog_upsert", _upsert_sql("NULL"))
def _(spark, sf):
    return _upsert(spark, sf, True)


@query("set05_catalog_upsert_keep_removed", _upsert_sql("removed_at"))
def _(spark, sf):
    return _upsert(spark, sf, False)


@query(
    "set05_sync_log",
    f"""WITH {_REMOTE} SELECT count(*) FILTER (lo.id IS NULL) AS models_added, count(*) FILTER (rm.id IS NULL) AS models_removed,
count(*) FILTER (lo.id IS NOT NULL AND rm.id IS NOT NULL) AS models_updated, count(rm.id) AS total_count FROM lo FULL JOIN rm ON lo.id = rm.id""",
)
def _(spark, sf):
    return cat.sync_log(v.local_models(spark, sf), _remote(spark, sf))


@query(
    "set03_id_algebra",
    f"""WITH {_REMOTE} SELECT id, 'added' AS part FROM (SELECT id FROM rm EXCEPT SELECT id FROM lo) UNION ALL
SELECT id, 'removed' FROM (SELECT id FROM lo EXCEPT SELECT id FROM rm) UNION ALL SELECT id, 'common' FROM (SELECT id FROM lo INTERSECT SELECT id FROM rm)""",
)
def _(spark, sf):
    return cat.id_algebra(_active(spark, sf), _remote(spark, sf))


# ---- groups: parts by brand number, explicit ids from suppliers ----------
_MEMBERS = """mem AS (SELECT CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT) % 4 AS group_id, 'model_' || p_partkey AS id, p_partkey AS seq FROM part),
ex AS (SELECT 'model_' || (s_suppkey * 7 % 2500) AS id, s_suppkey AS seq FROM supplier)"""


def _members(spark, sf):
    return v.table(spark, sf, "part").select(
        (F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long") % 4).alias("group_id"),
        F.concat(F.lit("model_"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_partkey").alias("seq"),
    )


def _explicit(spark, sf):
    n = F.col("s_suppkey") * 7 % 2500
    return v.table(spark, sf, "supplier").select(F.concat(F.lit("model_"), n.cast("string")).alias("id"), F.col("s_suppkey").alias("seq"))


@query("join15_validate_ids", f"WITH {_MEMBERS} SELECT id, seq, id IN (SELECT id FROM local_models) AS valid FROM ex")
def _(spark, sf):
    return cat.validate_ids(_explicit(spark, sf), v.local_models(spark, sf))


@query(
    "set01_resolve_models",
    f"""WITH {_MEMBERS}, u AS (SELECT id, 0 AS part, seq FROM mem WHERE group_id = 2 UNION ALL SELECT id, 1, seq FROM ex),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY part, seq) AS k FROM u)
SELECT id, row_number() OVER (ORDER BY part, seq, id) AS position FROM f WHERE k = 1""",
)
def _(spark, sf):
    return cat.resolve_models(_members(spark, sf), _explicit(spark, sf), 2)


@query(
    "set04_group_members_edit",
    f"""WITH {_MEMBERS}, n AS (SELECT group_id, id FROM mem UNION SELECT 1, id FROM ex WHERE id IN (SELECT id FROM local_models))
SELECT group_id, id FROM n WHERE NOT (group_id = 3 AND id LIKE '%5')""",
)
def _(spark, sf):
    members = _members(spark, sf)
    add = _explicit(spark, sf).join(v.local_models(spark, sf).select("id"), "id", "left_semi").withColumn("group_id", F.lit(1).cast("long"))
    drop = members.where((F.col("group_id") == 3) & F.col("id").endswith("5")).select("group_id", "id")
    return cat.edit_members(members, add, drop)


# ---- cost checks ---------------------------------------------------------
_REC = """b AS (SELECT t.trial_id, model, coalesce(cost, 0) AS rec, provider_cost AS pc FROM trials t LEFT JOIN provider_costs p ON t.trial_id = p.trial_id),
x AS (SELECT *, abs(rec - pc) AS d, CASE WHEN greatest(rec, pc) > 0 THEN abs(rec - pc) / greatest(rec, pc) ELSE 0 END AS pct FROM b),
disc AS (SELECT * FROM x WHERE pc IS NULL OR (d >= 0.01 AND (greatest(rec, pc) <= 0 OR pct >= 0.01)))"""


@query(
    "join09_cost_reconcile",
    f"""WITH {_REC} SELECT trial_id, model, R(rec) AS recorded_cost, R(pc) AS provider_cost, R(CASE WHEN pc IS NULL THEN rec ELSE d END) AS absolute_diff,
R(CASE WHEN pc IS NOT NULL THEN pct END) AS percent_diff FROM disc""",
)
def _(spark, sf):
    return cat.cost_reconcile(v.trials(spark, sf), v.provider_costs(spark, sf))


@query(
    "join09_reconcile_report",
    f"WITH {_REC} SELECT (SELECT R(sum(coalesce(cost, 0))) FROM trials) AS total_recorded, (SELECT R(sum(provider_cost)) FROM provider_costs) AS total_provider, count(*) AS discrepancies FROM disc",
)
def _(spark, sf):
    tr, p = v.trials(spark, sf), v.provider_costs(spark, sf)
    return cat.reconcile_report(tr, p, cat.cost_reconcile(tr, p))


@query(
    "join19_token_accuracy",
    """WITH x AS (SELECT t.trial_id, greatest(coalesce(abs(t.prompt_tokens - p.prompt_tokens) / nullif(greatest(t.prompt_tokens, p.prompt_tokens), 0), 0),
coalesce(abs(t.completion_tokens - p.completion_tokens) / nullif(greatest(t.completion_tokens, p.completion_tokens), 0), 0)) AS gap FROM trials t JOIN provider_costs p ON t.trial_id = p.trial_id)
SELECT trial_id, R(gap) AS gap, gap <= 0.05 AS accurate FROM x""",
)
def _(spark, sf):
    return cat.token_accuracy(v.trials(spark, sf), v.provider_costs(spark, sf))


def _lead_sql():
    return "CASE task_type " + " ".join(f"WHEN '{k}' THEN {len(x) + 2}" for k, x in fx.SYSTEM_PROMPTS.items()) + " END"


@query(
    "join20_cost_estimate",
    f"""WITH ts AS (SELECT case_id AS task_id, length(question) + {_lead_sql()} AS pc FROM cases), ix AS (SELECT source AS variant_name, sum(length(rel_path) + 3) AS ic FROM docs GROUP BY 1),
ms AS (SELECT * FROM (VALUES ('model_5', 1), ('model_12', 2), ('model_none', 3)) AS t(model, k)), e AS (SELECT task_id, variant_name, ms.model, CAST(floor((pc + ic) / 4) AS BIGINT) AS tok, coalesce(prompt_price, 0) AS pp, coalesce(completion_price, 0) AS cp
FROM ts, ix, ms LEFT JOIN local_models l ON l.id = ms.model)
SELECT task_id, variant_name, model, tok * 10 AS prompt_tokens, CAST(5000 AS BIGINT) AS completion_tokens, R((tok * pp + 500 * cp) * 10) AS cost FROM e""",
)
def _(spark, sf):
    lead = F.element_at(F.create_map(*[F.lit(x) for k, p in fx.SYSTEM_PROMPTS.items() for x in (k, len(p) + 2)]), F.col("task_type"))
    tasks = v.cases(spark, sf).select(F.col("case_id").alias("task_id"), (F.length("question") + lead).alias("prompt_chars"))
    sizes = v.docs(spark, sf).groupBy(F.col("source").alias("variant_name")).agg(F.sum(F.length("rel_path") + 3).alias("index_chars"))
    prices = v.local_models(spark, sf).select(F.col("id").alias("model"), "prompt_price", "completion_price")
    return cat.cost_estimate(tasks, sizes, prices, ["model_5", "model_12", "model_none"], 10)


# ---- response reuse ------------------------------------------------------
@query(
    "join14_response_lookup",
    """WITH rq AS (SELECT case_id, question, r.r AS repetition FROM cases, (SELECT unnest([1, 2]) AS r) r),
lg AS (SELECT question, 1 AS repetition, response, 10000000 - case_id * 40 AS created_at, case_id % 5 > 0 AS same_version FROM cases WHERE case_id % 2 = 0),
fr AS (SELECT question, repetition, arg_max(response, created_at) AS response FROM lg WHERE same_version AND 10000000 - created_at <= 2592000 GROUP BY ALL)
SELECT case_id, CAST(rq.repetition AS BIGINT) AS repetition, response, response IS NOT NULL AS hit FROM rq LEFT JOIN fr ON rq.question = fr.question AND rq.repetition = fr.repetition""",
)
def _(spark, sf):
    cases = v.cases(spark, sf)
    messages = mt.task_prompt(F.lit("generic"), F.col("question"), F.lit("index"))
    key = lambda rep, version: cat.response_key(F.lit("m"), F.lit(0.3), F.lit(2048), messages, rep, version)
    requests = cases.select("case_id", "question", F.explode(F.array(F.lit(1), F.lit(2))).alias("repetition"))
    requests = requests.select("case_id", "repetition", key(F.col("repetition"), F.lit(1)).alias("key"))
    version = F.when(F.col("case_id") % 5 > 0, 1).otherwise(0)
    log = cases.where(F.col("case_id") % 2 == 0).select(
        key(F.lit(1), version).alias("key"),
        "response",
        (F.lit(10000000) - F.col("case_id") * 40).cast("double").alias("created_at"),
        version.alias("cache_version"),
    )
    return cat.response_lookup(requests, log, 10000000.0, 1).select("case_id", "repetition", "response", "hit")


# ---- run lifecycle -------------------------------------------------------
@query(
    "str06_run_state",
    """WITH a AS (SELECT run_id, CAST(substr(run_id, 5) AS INT) AS n, min(ts_us) AS t0, max(ts_us) AS t1, max(ts_us) FILTER (trial_id % 10 = 0) AS hb FROM trials GROUP BY ALL)
SELECT run_id, CASE n % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'active' END AS status,
'{"model":"m_' || n || '"' || CASE WHEN n % 3 = 1 THEN ',"error":"boom ' || n || '"' ELSE '' END || '}' AS config,
hb AS heartbeat_us, CASE WHEN n % 3 < 2 THEN t1 + 1 END AS finished_us, n = 4 AS duplicate_create FROM a""",
)
def _(spark, sf):
    tr = v.trials(spark, sf)
    n = F.substring("run_id", 5, 10).cast("int")
    config = F.create_map(F.lit("model"), F.concat(F.lit("m_"), n.cast("string")))
    none_map, none = F.lit(None).cast("map<string,string>"), F.lit(None).cast("string")
    ends = tr.groupBy("run_id").agg(F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1"))
    row = lambda ts, seq, kind, cfg, err: F.struct(
        ts.alias("ts"), F.lit(seq).cast("long").alias("seq"), kind.alias("event"), cfg.alias("config"), err.alias("error")
    )
    kind = F.when(n % 3 == 0, "completed").when(n % 3 == 1, "failed")
    error = F.when(n % 3 == 1, F.concat(F.lit("boom "), n.cast("string")))
    made = row(F.col("t0"), 0, F.lit("create"), config, none)
    events = F.array_compact(
        F.array(
            made,
            F.when(n == 4, made),
            F.when(kind.isNotNull(), row(F.col("t1") + 1, 1, kind, none_map, error)),
        )
    )
    beats = tr.where(F.col("trial_id") % 10 == 0).select(
        "run_id", F.col("ts_us").alias("ts"), F.col("trial_id").alias("seq"), F.lit("heartbeat").alias("event"), none_map.alias("config"), none.alias("error")
    )
    return cat.run_state(ends.select("run_id", F.inline(events)).unionByName(beats))


@query(
    "str11_phase_results_upsert",
    """WITH a AS (SELECT run_id, phase, variant_name, avg(score) AS m FROM trials GROUP BY ALL), old AS (SELECT run_id, max(m) AS best, 1 AS seq FROM a GROUP BY 1),
new AS (SELECT run_id, min(m) AS best, 2 AS seq FROM a WHERE run_id IN ('run_1', 'run_4') GROUP BY 1), u AS (SELECT * FROM old UNION ALL SELECT * FROM new)
SELECT run_id, R(arg_max(best, seq)) AS best, max(seq)::BIGINT AS seq FROM u GROUP BY 1""",
)
def _(spark, sf):
    """Written, replaced by key, written again and read back."""
    means = v.trials(spark, sf).groupBy("run_id", "variant_name").agg(F.avg("score").alias("m"))
    old = means.groupBy("run_id").agg(F.max("m").alias("best")).withColumn("seq", F.lit(1).cast("long"))
    new = means.where(F.col("run_id").isin("run_1", "run_4")).groupBy("run_id").agg(F.min("m").alias("best")).withColumn("seq", F.lit(2).cast("long"))
    path = scratch_path(spark, "phase_results")
    old.write.parquet(f"{path}/v1")
    kept = spark.read.schema(old.schema).parquet(f"{path}/v1")
    cat.upsert_latest(kept, new, "run_id", "seq").write.parquet(f"{path}/v2")
    return spark.read.schema(kept.schema).parquet(f"{path}/v2")


# ---- sinks ---------------------------------------------------------------
@query(
    "src09_trial_append",
    "SELECT run_id, count(*) AS trials, R(sum(score)) AS score FROM trials GROUP BY 1",
)
def _(spark, sf):
    path = scratch_path(spark, "trials")
    tr = v.trials(spark, sf)
    for half in (0, 1):
        sinks.append_trials(tr.where(F.col("trial_id") % 2 == half), path)
    back = spark.read.schema(tr.schema).parquet(path)
    return back.groupBy("run_id").agg(t.n_rows().alias("trials"), F.sum("score").alias("score"))


@query(
    "src10_report_sink",
    """SELECT variant_name, R(avg(score)) AS mean_score, count(*) AS count, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, count(*) AS csv_rows, R(avg(score)) AS csv_mean FROM trials GROUP BY 1""",
)
def _(spark, sf):
    path = scratch_path(spark, "report")
    tr = v.trials(spark, sf).withColumn("cached", F.lit(False))
    sinks.write_report(tr, path)
    by = spark.read.schema("variant_name string, mean_score double, count long, total_tokens long").json(f"{path}/by_variant")
    kinds = {f.name: f.dataType for f in tr.schema.fields}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in sinks.REPORT_COLUMNS])
    csv = spark.read.option("header", True).schema(schema).csv(f"{path}/trials_csv")
    csv = csv.groupBy("variant_name").agg(t.n_rows().alias("csv_rows"), F.avg("score").alias("csv_mean"))
    return by.join(csv, "variant_name")


@query(
    "src11_catalog_export",
    "SELECT id, name, R(prompt_price) AS prompt_price, R(completion_price) AS completion_price, context_length, modality, tokenizer FROM local_models",
)
def _(spark, sf):
    path = scratch_path(spark, "catalog")
    models = v.local_models(spark, sf)
    sinks.export_catalog(models, path)
    return spark.read.option("header", True).schema(models.select(*sinks.CATALOG_COLUMNS).schema).csv(path)


