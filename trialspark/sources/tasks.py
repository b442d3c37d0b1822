"""Task files: parsing, validation, duplicates, derived tasks."""

from __future__ import annotations

import json

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.constants import TASK_TYPES
from trialspark.functions.text import hash_number, let, words
from trialspark.operators.ordered import ordinals

# Allowed domains and difficulties, and the shape of a task id.
DOMAINS = [
    "framework_api",
    "project_repo",
    "skills_workflows",
    "library_docs",
    "technical_qa",
    "code_repository",
    "news_articles",
    "synthetic_docs",
    "general_knowledge",
]
DIFFICULTIES = ["easy", "medium", "hard", "edge"]
TASK_ID = r"^[a-z][a-z0-9]*(?:_[a-z][a-z0-9]*)*_\d+$"

TASK_TYPE = """struct<task_id:string, type:string, question:string, domain:string, difficulty:string, tags:array<string>,
metadata:struct<expected_files:array<string>, expected_answer:string, answer_aliases:array<string>, test:string,
forbidden_patterns:array<string>, files:map<string,string>, FAIL_TO_PASS:string, expected_tools:array<struct<name:string>>,
reasoning_chain:array<string>, question_decomposition:array<string>, nearest_doc:string,
sub_tasks:array<struct<question:string,expected_answer:string>>, interpretations:array<struct<label:string,answer:string>>,
expected_interpretation:string, sources:array<struct<name:string,claim:string,authority:int>>, expected_resolution:string,
token_budget:int, perturbation_type:string, base_task_id:string, original_question:string, answerable:boolean>>""".replace("\n", " ")


@F.pandas_udf(T.StringType())
def yaml_to_json(text: pd.Series) -> pd.Series:
    """YAML has no built-in reader, so each file's text is parsed once, in Arrow batches."""

    def parse(t):
        try:
            data = yaml.safe_load(t)
        except (yaml.YAMLError, AttributeError, TypeError):
            return None
        return json.dumps(data, default=str) if isinstance(data, dict) else None

    return text.map(parse)


def read_task_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per task file under ``path`` (path, text); the schema description is skipped."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.y*ml").text(path)
    named = files.select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return named.where(~F.endswith("path", F.lit("/schema.yaml")))


def task_ingest(files: DataFrame, strict: bool = False) -> DataFrame:
    """Tasks parsed from (path, text); bad files are dropped, or fail the job when ``strict``."""
    parsed = files.withColumn("task", F.from_json(yaml_to_json("text"), TASK_TYPE))
    good = F.col("task").isNotNull() & F.col("task.task_id").isNotNull()
    if strict:
        message = F.concat(F.lit("invalid task file "), "path")
        parsed = parsed.withColumn("task", F.when(good, F.col("task")).otherwise(F.raise_error(message).cast(TASK_TYPE)))
    return parsed.where(good).select("path", "task.*")


def task_validate(tasks: DataFrame) -> DataFrame:
    """Adds ``reasons``: why a task is not valid, empty when it is."""
    checks: list[tuple[str, Column]] = [
        ("task_id", F.col("task_id").rlike(TASK_ID)),
        ("type", F.col("type").isin(TASK_TYPES)),
        ("domain", F.col("domain").isin(DOMAINS)),
        ("difficulty", F.col("difficulty").isin(DIFFICULTIES)),
    ]
    bad = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks]
    return tasks.withColumn("reasons", F.array_compact(F.array(*bad)))


def split_valid(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = task_validate(tasks)
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


def task_duplicates(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def numbered(df: DataFrame, order: list[str], prefix: str, limit: int | None = None) -> DataFrame:
    """Adds ``n`` (0-based place in ``order``) and ``new_id`` = prefix plus the padded place.

    Only the order columns are numbered; the rows themselves move once, to meet their number.
    """
    placed = ordinals(df.select(*order), [], order, "n").withColumn("n", F.col("n") - 1)
    out = df.join(placed, order)
    if limit is not None:
        out = out.where(F.col("n") < limit)
    text = F.col("n").cast("string")
    return out.withColumn("new_id", F.concat(F.lit(prefix), F.lpad("n", F.greatest(F.length(text), F.lit(3)), F.lit("0"))))


# ---- derived tasks -------------------------------------------------------
# Kinds of perturbation and budget tiers, both dealt out in turn.
PERTURBATIONS = ["typo", "char_swap", "char_delete", "word_swap", "case_change"]
BUDGET_TIERS = [("tight", 0.5), ("moderate", 1.0), ("generous", 2.0)]


def _pick(i: Column, values) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), (i + 1).cast("int"))


def perturb(question: Column, kind: Column, seed: Column) -> Column:
    """One hash-placed edit: swapped letters, a dropped letter, swapped words or changed case."""
    draws = [hash_number(F.concat(seed, F.lit(f"/{salt}"))).alias(salt) for salt in ("word", "swap", "drop", "other")]
    return let(F.struct(words(question).alias("w"), *draws), lambda s: _edited(question, kind, s))


def _edited(question: Column, kind: Column, drawn: Column) -> Column:
    w = drawn["w"]
    n = F.size(w)
    at = lambda salt, size: drawn[salt] % F.greatest(size, F.lit(1))
    i = at("word", n).cast("int")
    word = F.get(w, i)
    size = F.length(word)
    put = lambda x: F.array_join(F.transform(w, lambda y, k: F.when(k == i, x).otherwise(y)), " ")
    p = at("swap", size - 1).cast("int") + 1
    swapped = F.concat(F.substr(word, F.lit(1), p - 1), F.substr(word, p + 1, F.lit(1)), F.substr(word, p, F.lit(1)), F.substr(word, p + 2))
    d = at("drop", size - 1).cast("int") + 2
    dropped = F.concat(F.substr(word, F.lit(1), d - 1), F.substr(word, d + 1))
    j = ((i + 1 + at("other", n - 1)) % n).cast("int")
    words_swapped = F.array_join(
        F.transform(w, lambda y, k: F.when(k == i, F.get(w, j)).when(k == j, F.get(w, i)).otherwise(y)), " "
    )
    cased = F.when((F.lower(word) == word) & (F.upper(word) != word), F.upper(word)).otherwise(F.lower(word))
    return (
        F.when(kind.isin("typo", "char_swap"), F.when(n < 2, question).otherwise(put(F.when(size > 2, swapped).otherwise(word))))
        .when(kind == "char_delete", F.when(n == 0, question).otherwise(put(F.when(size > 2, dropped).otherwise(word))))
        .when(kind == "word_swap", F.when(n > 2, words_swapped).otherwise(F.array_join(w, " ")))
        .when(kind == "case_change", F.when(n == 0, question).otherwise(put(cased)))
        .otherwise(question)
    )


def gen_perturbation(tasks: DataFrame, limit: int | None = None, seed: int = 42) -> DataFrame:
    """Robustness tasks from (task_id, question, expected_answer, answer_aliases)."""
    out = numbered(tasks.where(F.col("question").isNotNull()), ["task_id"], "perturbation_robustness_", limit)
    kind = _pick(F.col("n") % 5, PERTURBATIONS)
    return out.select(
        F.col("new_id").alias("task_id"),
        perturb(F.col("question"), kind, F.concat(F.lit(f"{seed}/"), "task_id")).alias("question"),
        kind.alias("perturbation_type"),
        F.col("task_id").alias("base_task_id"),
        F.col("question").alias("original_question"),
        "expected_answer",
        "answer_aliases",
    )


def gen_efficiency(tasks: DataFrame, limit: int | None = None) -> DataFrame:
    """Efficiency tasks: a budget from twice the answer's words, tight, moderate and generous in turn."""
    out = numbered(tasks.where(F.col("question").isNotNull()), ["task_id"], "syntheticefficiency_efficiency_", limit)
    ideal = F.greatest(F.size(words(F.col("expected_answer"))) * 2, F.lit(10))
    tier = F.col("n") % 3
    budget = F.greatest((ideal * _pick(tier, [m for _, m in BUDGET_TIERS])).cast("int"), F.lit(5))
    return out.select(
        F.col("new_id").alias("task_id"),
        "question",
        "expected_answer",
        _pick(tier, [t for t, _ in BUDGET_TIERS]).alias("budget_tier"),
        ideal.cast("long").alias("ideal_token_usage"),
        budget.cast("long").alias("token_budget"),
    )
