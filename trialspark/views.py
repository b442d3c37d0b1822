"""Trial-analytics views over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.constants import TASK_TYPES, TYPE_WEIGHTS, WEIGHT_SCHEMES
from trialspark.functions.text import words as text_words


TEXT_TABLES = ("documents", "conversations")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the driver tables; texts that come in too few splits are spread over the cores.

    Work on texts is heavy per row, so a table read as one split would keep one
    core busy.  A table with at least as many splits as cores is left alone.
    """
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXT_TABLES and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def pick(values: list[str], index: Column) -> Column:
    """The ``index``-th (0-based) of a fixed list of strings."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def trials(spark: SparkSession, sf: str) -> DataFrame:
    return trials_from(table(spark, sf, "events"))


def trials_from(e: DataFrame) -> DataFrame:
    """Trial rows from an events table or stream."""
    user, event, value = F.col("user_id"), F.col("event_id"), F.col("value")
    prompt = F.floor(value * 10).cast("long")
    completion = F.floor(value).cast("long")
    tag = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    return e.select(
        event.alias("trial_id"),
        tag("run_", user % 6).alias("run_id"),
        tag("t_", event % 440).alias("task_id"),
        pick(TASK_TYPES, event % 11).alias("task_type"),
        tag("v_", user % 7).alias("variant_name"),
        (F.floor(event / 440) % 5 + 1).cast("long").alias("repetition"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("double") / 100).alias("score"),
        prompt.alias("prompt_tokens"),
        completion.alias("completion_tokens"),
        (prompt + completion).alias("total_tokens"),
        F.when(F.col("event_type") != "signup", value / 1000).alias("cost"),
        (value / 100).alias("latency_seconds"),
        tag("m_", user % 3).alias("model"),
        tag("src_", event % 3).alias("source"),
        F.when(F.col("event_type") == "error", F.lit("failed")).alias("error"),
        micros(F.col("ts")).alias("ts_us"),
        (event % 9 + 1).alias("oa_row_id"),
        pick(["screening", "confirmation", "refinement"], user % 6 % 3).alias("phase"),
    )


def trials_big(spark: SparkSession, sf: str) -> DataFrame:
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.concat(F.lit("run_"), F.year("o_orderdate").cast("string")).alias("run_id"),
        F.concat("l_returnflag", "l_linestatus").alias("variant_name"),
        (F.col("l_discount") * 10).alias("score"),
        F.when(F.col("l_tax") != 0, F.col("l_extendedprice") / 1000000).alias("cost"),
        F.concat(F.lit("m_"), (F.col("l_suppkey") % 5).cast("string")).alias("model"),
        F.col("l_quantity").alias("tokens"),
        F.col("l_partkey").alias("task_key"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    number = F.substring("run_id", 5, 10).cast("int")
    return (
        trials(spark, sf)
        .groupBy("run_id")
        .agg(
            F.min("ts_us").alias("created_us"),
            F.max("ts_us").alias("heartbeat_us"),
            F.min("phase").alias("phase"),
        )
        .select(
            "run_id",
            pick(["completed", "active", "failed"], number % 3).alias("status"),
            "created_us",
            "heartbeat_us",
            "phase",
            F.concat(F.lit("chain_"), (number % 2).cast("string")).alias("chain_id"),
        )
    )


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as Markdown files of one corpus per source, with headings, code and comments mixed in."""
    i, n, text = F.col("doc_id"), F.col("n_chars"), F.col("text")
    word = F.lower(F.regexp_extract(text, "([A-Za-z]{4,})", 1))
    number = i.cast("string")
    body = (
        F.when(i % 4 == 0, F.replace(text, F.lit("\n"), F.lit("\n\n## Part ")))
        .when(i % 4 == 1, F.replace(text, F.lit("\n"), F.lit("\ndef fn_x(a):\n")))
        .when(i % 4 == 2, F.concat(F.replace(text, F.lit(". "), F.lit(".  \n\n\n\n#Note ")), F.lit("<!-- hidden\nnote -->")))
        .otherwise(text)
    )
    tail = (
        F.when(i % 5 == 0, "\n```python\nx = 1\n```")
        .when(i % 5 == 1, F.concat(F.lit(" since version 2."), (i % 7).cast("string"), F.lit(" legacy")))
        .when(i % 5 == 2, " see v1.4.2 | end")
        .otherwise("")
    )
    title = F.when(i % 3 == 0, F.concat(F.lit("# Title "), number, F.lit("\n\n"))).otherwise("")
    stem = F.when(i % 2 == 0, F.coalesce(F.nullif(word, F.lit("")), F.lit("word"))).otherwise(F.concat(F.lit("doc_"), number))
    base = table(spark, sf, "documents").select(
        "doc_id",
        "source",
        F.col("lang").alias("section"),
        "n_chars",
        (i % 5).alias("priority"),
        F.when(n < 800, "required").when(n < 2500, "recommended").otherwise("reference").alias("tier"),
        F.when(i % 10 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (i % 365).cast("int"))).alias("last_modified"),
        stem.alias("stem"),
        F.concat(title, body, tail).alias("content"),
    )
    folder = F.when(i % 2 == 0, F.concat(number, F.lit("/"))).otherwise("")
    return base.withColumns(
        {
            "token_count": F.floor(F.length("content") / 4).cast("long"),
            "content_hash": F.sha2("content", 256),
            "rel_path": F.concat("section", F.lit("/"), "source", F.lit("/"), folder, "stem", F.lit(".md")),
            "summary": F.when(i % 7 == 0, F.concat(F.lit("Summary of "), "stem")),
        }
    )


def type_weights(spark: SparkSession) -> DataFrame:
    """Eleven fixed rows; small by construction, so safe to broadcast."""
    return spark.createDataFrame(list(TYPE_WEIGHTS.items()), "task_type string, weight double")


def weight_schemes(spark: SparkSession) -> DataFrame:
    rows = [(s, t, w) for s, ws in WEIGHT_SCHEMES.items() for t, w in ws.items()]
    return spark.createDataFrame(rows, "scheme string, task_type string, weight double")


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns as responses, with expectations cut from the turn and the question before it."""
    conv = table(spark, sf, "conversations")
    reply = conv.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer_text"))
    asked = conv.where("role = 'user'").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question")
    )
    cut = lambda words_, start, n: F.array_join(F.slice(words_, start, n), " ")
    base = reply.join(asked, ["conv_id", "turn"]).withColumns(
        {
            "case_id": F.col("conv_id") * 1000 + F.col("turn"),
            "qw": text_words(F.col("question")),
            "aw": text_words(F.col("answer_text")),
        }
    )
    i, qw, aw = F.col("case_id"), F.col("qw"), F.col("aw")
    number = lambda c: c.cast("string")
    see = F.concat(F.lit(" See ./docs/Guide_"), number(i % 3), F.lit(".md, lib/auth.py."))
    endings = [
        " The answer cannot be determined.",
        " It's unclear.",
        " This may not be accurate.",
        " It could mean first reading.",
        " First run_tests then read_file and deploy_app.",
        "",
        "",
    ]
    some = lambda *values: F.array(*[F.lit(x) for x in values])
    return base.select(
        "case_id",
        "conv_id",
        "turn",
        pick(TASK_TYPES, i % 11).alias("task_type"),
        "question",
        F.concat("answer_text", F.when(i % 2 == 0, see).otherwise(""), pick(endings, i % 7)).alias("response"),
        cut(qw, 1, 6).alias("expected_answer"),
        F.array(F.when(i % 5 == 0, cut(aw, 3, 2)).otherwise(cut(qw, 7, 2))).alias("answer_aliases"),
        F.array(F.concat(F.lit("docs/guide_"), number(i % 4), F.lit(".md")), F.lit("src/auth.py")).alias("expected_files"),
        F.array(cut(qw, 1, 5), cut(qw, 6, 5), cut(aw, 1, 4)).alias("reasoning_chain"),
        F.when(i % 3 == 0, F.array(cut(qw, 1, 3), cut(qw, 4, 3), cut(aw, 2, 3), cut(aw, 9, 5)))
        .otherwise(F.array().cast("array<string>"))
        .alias("question_decomposition"),
        F.create_map(
            F.lit("src/auth.py"), cut(aw, 1, 3), F.concat(F.lit("docs/x_"), number(i % 3), F.lit(".md")), cut(qw, 1, 4)
        ).alias("files"),
        F.array(cut(aw, 2, 1), F.lit("test_login")).alias("fail_to_pass"),
        F.when(i % 2 == 0, some("read_file", "run_tests")).otherwise(some("run_tests", "search")).alias("expected_tools"),
        F.array(cut(qw, 1, 2), cut(aw, 2, 3), F.lit(""), cut(qw, 3, 4)).alias("sub_answers"),
        F.array(
            F.struct(F.lit("first_reading").alias("label"), cut(qw, 1, 5).alias("answer")),
            F.struct(F.lit("other_reading").alias("label"), cut(aw, 5, 5).alias("answer")),
        ).alias("interpretations"),
        F.when(i % 3 == 0, "other_reading").otherwise("first_reading").alias("expected_interpretation"),
        F.when(i % 4 == 0, cut(aw, 4, 3)).otherwise(cut(qw, 2, 6)).alias("expected_resolution"),
        (20 + i % 50).alias("token_budget"),
        F.concat_ws("\n", cut(aw, 1, 1), cut(qw, 1, 1), F.lit("[")).alias("test"),
        F.array(cut(qw, 2, 1)).alias("forbidden_patterns"),
    )


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    chars = table(spark, sf, "documents").select("doc_id", "n_chars")
    return table(spark, sf, "labels").join(chars, "doc_id")


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as human-scored examples."""
    return _labelled(spark, sf).select(
        F.col("doc_id").alias("example_id"),
        pick(TASK_TYPES, F.col("doc_id") % 11).alias("task_type"),
        ((F.col("quality") * 6 + F.col("n_chars") % 5) / 10).alias("human_score"),
    )


def judge_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Three judges' scores per labelled document."""
    rows = _labelled(spark, sf).select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j"))
    j, d = F.col("j"), F.col("doc_id")
    raw = F.col("quality") * 5 + (F.col("n_chars") + j * F.col("toxic")) % 5 + (d * j) % 3
    return rows.select(
        d.alias("example_id"),
        F.concat(F.lit("judge_"), j.cast("string")).alias("judge_model"),
        (raw / 12).alias("score"),
        j.cast("long").alias("seq"),
    )


def local_models(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog snapshot before a sync."""
    k, size, price = F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice")
    lists = [["tools"], ["tools", "json"], ["json", "vision", "tools"]]
    params = F.element_at(F.array(*[F.array(*[F.lit(x) for x in p]) for p in lists]), (size % 3 + 1).cast("int"))
    return table(spark, sf, "part").where(k % 11 != 0).select(
        F.concat(F.lit("model_"), k.cast("string")).alias("id"),
        F.col("p_name").alias("name"),
        (size * 1000).alias("context_length"),
        (price / 1000).alias("prompt_price"),
        (price / 500).alias("completion_price"),
        F.col("p_type").alias("modality"),
        F.col("p_brand").alias("tokenizer"),
        params.alias("supported_params"),
        (k % 90).alias("first_seen"),
        F.lit(100).cast("long").alias("last_seen"),
        F.when(k % 23 == 0, F.lit(150).cast("long")).alias("removed_at"),
    )


def remote_models_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Provider listing with nested text prices, as it arrives."""
    k, price = F.col("p_partkey"), F.col("p_retailprice")
    prompt = F.when(k % 7 == 0, price / 900).otherwise(price / 1000)
    completion = F.when(k % 9 == 0, F.lit(None)).when(k % 8 == 0, F.lit("")).otherwise((price / 500).cast("string"))
    return table(spark, sf, "part").where(k % 10 != 0).select(
        F.concat(F.lit("model_"), k.cast("string")).alias("id"),
        F.concat("p_name", F.when(k % 6 == 0, " v2").otherwise("")).alias("name"),
        (F.col("p_size") * 1000).alias("context_length"),
        F.struct(prompt.cast("string").alias("prompt"), completion.alias("completion")).alias("pricing"),
        F.col("p_type").alias("modality"),
        F.col("p_brand").alias("tokenizer"),
    )


def provider_costs(spark: SparkSession, sf: str) -> DataFrame:
    i, cost = F.col("trial_id"), F.coalesce(F.col("cost"), F.lit(0.0))
    billed = (
        F.when(i % 4 == 0, cost).when(i % 4 == 1, cost + 0.005).when(i % 4 == 2, cost * 1.2 + 0.02).otherwise(cost * 1.005)
    )
    return trials(spark, sf).where(i % 5 != 0).select(
        "trial_id",
        billed.alias("provider_cost"),
        F.floor(F.col("prompt_tokens") * (1 + i % 3) / 2).cast("long").alias("prompt_tokens"),
        "completion_tokens",
    )
