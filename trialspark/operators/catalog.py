"""Model catalog, groups, cost reconciliation, response reuse and run state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.operators.ordered import ordinals
from trialspark.operators.trials import cost0


# ---- filters and order ---------------------------------------------------
def model_filter(
    models: DataFrame,
    free: bool = False,
    max_price: float | None = None,
    min_context: int | None = None,
    modality: str | None = None,
    tokenizer: str | None = None,
    capabilities: Sequence[str] = (),
    modality_contains: bool = False,
) -> DataFrame:
    """AND of the given conditions over active models; modality by equality or by substring."""
    out = models.where(F.col("removed_at").isNull())
    if free:
        out = out.where((F.col("prompt_price") == 0) & (F.col("completion_price") == 0))
    if max_price is not None:
        out = out.where(F.col("prompt_price") <= max_price)
    if min_context is not None:
        out = out.where(F.col("context_length") >= min_context)
    if modality is not None:
        c = F.col("modality")
        out = out.where(F.contains(c, F.lit(modality)) if modality_contains else c == modality)
    if tokenizer is not None:
        out = out.where(F.col("tokenizer") == tokenizer)
    if capabilities:
        wanted = F.array(*[F.lit(x) for x in capabilities])
        out = out.where(F.size(F.array_except(wanted, "supported_params")) == 0)
    return out


def model_search(models: DataFrame, query: str) -> DataFrame:
    q = F.lit(query.lower())
    return models.where(F.contains(F.lower("id"), q) | F.contains(F.lower("name"), q))


SORT_KEYS = {"price": "prompt_price", "name": "name", "context": "context_length", "created": "created"}


def model_sort(models: DataFrame, key: str) -> DataFrame:
    c = SORT_KEYS.get(key.lstrip("-"), key.lstrip("-"))
    return models.orderBy(F.desc(c) if key.startswith("-") else F.asc(c), "id")


# ---- sync ----------------------------------------------------------------
def catalog_normalize(raw: DataFrame) -> DataFrame:
    """Flat rows from the provider's listing; a missing or empty price is 0."""
    price = lambda f: F.coalesce(F.expr(f"try_cast(nullif(pricing.{f}, '') AS double)"), F.lit(0.0))
    return raw.where(F.coalesce("id", F.lit("")) != "").select(
        "id",
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("context_length", F.lit(0)).alias("context_length"),
        price("prompt").alias("prompt_price"),
        price("completion").alias("completion_price"),
        F.coalesce("modality", F.lit("text")).alias("modality"),
        F.coalesce("tokenizer", F.lit("")).alias("tokenizer"),
    )


PRICES = ("prompt_price", "completion_price")


def catalog_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Long rows (id, change, field, old, new): added, removed and changed prices."""
    side = lambda d, tag: d.select("id", F.lit(True).alias(tag), *[F.col(p).alias(f"{tag}_{p}") for p in PRICES])
    both = side(local, "l").join(side(remote, "r"), "id", "full_outer")
    change = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed")
    none = F.lit(None)
    row = lambda kind, field, old, new: F.struct(
        kind.alias("change"), field.cast("string").alias("field"), old.cast("double").alias("old"), new.cast("double").alias("new")
    )
    moved = [
        F.when(
            F.col(f"l_{p}").isNotNull() & F.col(f"r_{p}").isNotNull() & (F.col(f"l_{p}") != F.col(f"r_{p}")),
            row(F.lit("price"), F.lit(p), F.col(f"l_{p}"), F.col(f"r_{p}")),
        )
        for p in PRICES
    ]
    rows = F.array_compact(F.array(F.when(change.isNotNull(), row(change, none, none, none)), *moved))
    return both.select("id", F.inline(rows))


def catalog_upsert(local: DataFrame, remote: DataFrame, now: Column, revive: bool = True) -> DataFrame:
    """New snapshot: attributes replaced, first_seen kept, active models missing remotely get removed_at.

    ``revive`` clears removed_at of a model that is listed again; without it
    such a model stays marked as removed.
    """
    attrs = [c for c in remote.columns if c != "id"]
    new = remote.select("id", F.lit(True).alias("_in"), *[F.col(c).alias(f"_n_{c}") for c in attrs])
    both = local.join(new, "id", "full_outer")
    listed = F.col("_in").isNotNull()
    gone = F.col("removed_at")
    removed = F.when(listed, F.lit(None).cast("long") if revive else gone).otherwise(F.coalesce(gone, now))
    return both.select(
        "id",
        *[F.when(listed, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in attrs],
        F.coalesce("first_seen", now).alias("first_seen"),
        F.when(listed, now).otherwise(F.col("last_seen")).alias("last_seen"),
        removed.alias("removed_at"),
    )


def sync_log(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Counts of one sync: added, removed, updated, total."""
    active = local.where("removed_at IS NULL").select("id", F.lit(1).alias("l"))
    both = active.join(remote.select("id", F.lit(1).alias("r")), "id", "full_outer")
    return both.agg(
        F.count_if(F.col("l").isNull()).alias("models_added"),
        F.count_if(F.col("r").isNull()).alias("models_removed"),
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("models_updated"),
        F.count("r").alias("total_count"),
    )


def id_algebra(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Each id once, as added, removed or common: one shuffle for all three sets."""
    side = lambda d, here: d.select("id", F.lit(here).alias("here"), F.lit(not here).alias("there"))
    seen = side(local, True).union(side(remote, False)).groupBy("id").agg(F.max("here").alias("here"), F.max("there").alias("there"))
    return seen.select("id", F.when(~F.col("here"), "added").when(~F.col("there"), "removed").otherwise("common").alias("part"))


# ---- groups --------------------------------------------------------------
def validate_ids(ids: DataFrame, catalog: DataFrame) -> DataFrame:
    known = catalog.select("id")
    good = ids.join(known, "id", "left_semi").withColumn("valid", F.lit(True))
    return good.unionByName(ids.join(known, "id", "left_anti").withColumn("valid", F.lit(False)))


def resolve_models(members: DataFrame, explicit: DataFrame, group_id: int) -> DataFrame:
    """Members of the group first, then explicit ids, each id at its first place.

    Inputs carry ``seq``; output ``position`` is the order to use.
    """
    both = members.where(F.col("group_id") == group_id).select("id", F.lit(0).alias("part"), "seq").unionByName(
        explicit.select("id", F.lit(1).alias("part"), "seq")
    )
    firsts = both.groupBy("id").agg(F.min(F.struct("part", "seq")).alias("_at"))
    flat = firsts.select("id", F.col("_at.part").alias("_part"), F.col("_at.seq").alias("_seq"))
    return ordinals(flat, [], ["_part", "_seq", "id"], "position").drop("_part", "_seq")


def edit_members(members: DataFrame, add: DataFrame, drop: DataFrame) -> DataFrame:
    """Insert-or-ignore then delete, on (group_id, id)."""
    return members.select("group_id", "id").union(add.select("group_id", "id")).distinct().join(drop, ["group_id", "id"], "left_anti")


# ---- cost and token checks ----------------------------------------------
def cost_reconcile(trials: DataFrame, provider: DataFrame, percent: float = 0.01, absolute: float = 0.01) -> DataFrame:
    """Discrepancies only: no provider row, or both thresholds passed."""
    both = trials.select("trial_id", "model", cost0().alias("recorded_cost")).join(
        provider.select("trial_id", "provider_cost"), "trial_id", "left"
    )
    diff = F.abs(F.col("recorded_cost") - F.col("provider_cost"))
    base = F.greatest("recorded_cost", "provider_cost")
    share = F.when(base > 0, diff / base).otherwise(0.0)
    missing = F.col("provider_cost").isNull()
    flagged = missing | ((diff >= absolute) & ((base <= 0) | (share >= percent)))
    return both.where(flagged).select(
        "trial_id",
        "model",
        "recorded_cost",
        "provider_cost",
        F.when(missing, F.col("recorded_cost")).otherwise(diff).alias("absolute_diff"),
        F.when(~missing, share).alias("percent_diff"),
    )


def reconcile_report(trials: DataFrame, provider: DataFrame, discrepancies: DataFrame) -> DataFrame:
    return discrepancies.agg(F.count(F.lit(1)).alias("discrepancies")).select(
        trials.agg(F.sum(cost0())).scalar().alias("total_recorded"),
        provider.agg(F.sum("provider_cost")).scalar().alias("total_provider"),
        "discrepancies",
    )


def token_accuracy(trials: DataFrame, provider: DataFrame, limit: float = 0.05) -> DataFrame:
    p = provider.select("trial_id", F.col("prompt_tokens").alias("_p"), F.col("completion_tokens").alias("_c"))
    gap = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) / F.nullif(F.greatest(a, b), F.lit(0)), F.lit(0.0))
    worst = F.greatest(gap("prompt_tokens", "_p"), gap("completion_tokens", "_c"))
    return trials.join(p, "trial_id").select("trial_id", worst.alias("gap"), (worst <= limit).alias("accurate"))


def cost_estimate(
    tasks: DataFrame, index_sizes: DataFrame, prices: DataFrame, models: Sequence[str], repetitions: int, completion_tokens: int = 500
) -> DataFrame:
    """Tokens and cost of every planned (task, variant, model).

    Sizes add up, so no index text is built per task: ``tasks`` has
    prompt_chars, ``index_sizes`` one row per rendered variant, ``prices`` one
    row per model.
    """
    sizes = index_sizes.agg(F.collect_list(F.struct("variant_name", "index_chars"))).scalar()
    plan = tasks.select("task_id", "prompt_chars", F.inline(sizes)).withColumn(
        "model", F.explode(F.array(*[F.lit(x) for x in models]))
    )
    priced = plan.join(prices.select("model", "prompt_price", "completion_price"), "model", "left")
    tokens = F.floor((F.col("prompt_chars") + F.col("index_chars")) / 4)
    price = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    single = tokens * price("prompt_price") + completion_tokens * price("completion_price")
    return priced.select(
        "task_id",
        "variant_name",
        "model",
        (tokens * repetitions).alias("prompt_tokens"),
        F.lit(completion_tokens * repetitions).cast("long").alias("completion_tokens"),
        (single * repetitions).alias("cost"),
    )


# ---- response reuse ------------------------------------------------------
def response_key(model: Column, temperature: Column, max_tokens: Column, messages: Column, repetition: Column, version: Column) -> Column:
    """SHA-256 over everything that shapes a response, the repetition included."""
    rep = F.struct(F.lit("system").alias("role"), F.concat(F.lit("__rep:"), repetition.cast("string")).alias("content"))
    return F.sha2(
        F.to_json(
            F.struct(
                version.alias("cache_version"),
                max_tokens.alias("max_tokens"),
                F.concat(messages, F.array(rep)).alias("messages"),
                model.alias("model"),
                temperature.alias("temperature"),
            )
        ),
        256,
    )


def response_lookup(requests: DataFrame, log: DataFrame, now: float, version: int, ttl_days: int = 30) -> DataFrame:
    """Requests with the logged response of the same key, unless too old or of another version."""
    fresh = log.where((F.col("cache_version") == version) & (F.lit(now) - F.col("created_at") <= ttl_days * 86400))
    newest = fresh.groupBy("key").agg(F.max_by("response", "created_at").alias("response"))
    return requests.join(newest, "key", "left").withColumn("hit", F.col("response").isNotNull())


# ---- run lifecycle -------------------------------------------------------
def run_state(log: DataFrame) -> DataFrame:
    """Current state per run from an event log (run_id, ts, seq, event, config map, error).

    Aggregates combine before the shuffle, so a chatty run costs one row per
    input partition.
    """
    order = F.struct("ts", "seq")
    of = lambda *kinds: F.col("event").isin(*kinds)
    final = F.max_by(F.struct("event", "error"), F.when(of("completed", "failed"), order))
    config = F.max_by("config", F.when(of("create"), order))
    agg = log.groupBy("run_id").agg(
        final.alias("_final"),
        config.alias("_config"),
        F.max(F.when(of("create", "heartbeat"), F.col("ts"))).alias("heartbeat_us"),
        F.max(F.when(of("completed", "failed"), F.col("ts"))).alias("finished_us"),
        F.count_if(of("create")).alias("creates"),
    )
    error = F.col("_final.error")
    merged = F.when(error.isNull(), F.col("_config")).otherwise(F.map_concat(F.map_filter("_config", lambda k, _: k != "error"), F.create_map(F.lit("error"), error)))
    return agg.select(
        "run_id",
        F.coalesce("_final.event", F.lit("active")).alias("status"),
        F.to_json(merged).alias("config"),
        "heartbeat_us",
        "finished_us",
        (F.col("creates") > 1).alias("duplicate_create"),
    )


def upsert_latest(existing: DataFrame, updates: DataFrame, key: str, seq: str) -> DataFrame:
    """Insert-or-replace by key: the row with the highest ``seq`` stays."""
    cols = [c for c in existing.columns if c != key]
    both = existing.unionByName(updates)
    return both.groupBy(key).agg(F.max_by(F.struct(*cols), seq).alias("_r")).select(key, "_r.*")
