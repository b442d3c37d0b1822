"""Writers for trials, reports and the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.session import frozen

# Columns of the report and catalog files.
REPORT_COLUMNS = [
    "task_id",
    "task_type",
    "variant_name",
    "repetition",
    "score",
    "prompt_tokens",
    "completion_tokens",
    "total_tokens",
    "cost",
    "latency_seconds",
    "cached",
    "error",
    "source",
]
CATALOG_COLUMNS = ["id", "name", "prompt_price", "completion_price", "context_length", "modality", "tokenizer"]


def append_trials(trials: DataFrame, path: str) -> None:
    """Append to the trial table, one directory per run.

    Rows are gathered by run first, so a run gets few files; a hot run is split again by its size.
    """
    trials.hint("rebalance", "run_id").write.mode("append").partitionBy("run_id").parquet(path)


def write_report(trials: DataFrame, path: str, formats: tuple[str, ...] = ("json", "csv")) -> None:
    """Trials plus the summaries by variant and by task type, both from one pass over the trials."""
    if "json" in formats:
        cells = frozen(
            trials.groupBy("variant_name", "task_type").agg(
                F.sum("score").alias("score"),
                F.count("score").alias("scored"),
                F.count(F.lit(1)).alias("n"),
                F.sum("total_tokens").alias("tokens"),
            )
        )
        mean, n = (F.sum("score") / F.sum("scored")).alias("mean_score"), F.sum("n").alias("count")
        by_variant = cells.groupBy("variant_name").agg(mean, n, F.sum("tokens").alias("total_tokens"))
        by_type = cells.groupBy("task_type").agg(mean, n)
        trials.select(*REPORT_COLUMNS).write.mode("overwrite").json(f"{path}/trials_json")
        by_variant.write.mode("overwrite").json(f"{path}/by_variant")
        by_type.write.mode("overwrite").json(f"{path}/by_task_type")
    if "csv" in formats:
        trials.select(*REPORT_COLUMNS).write.mode("overwrite").option("header", True).csv(f"{path}/trials_csv")


def export_catalog(models: DataFrame, path: str, fmt: str = "csv") -> None:
    if fmt == "csv":
        models.select(*CATALOG_COLUMNS).write.mode("overwrite").option("header", True).csv(path)
    else:
        models.write.mode("overwrite").json(path)
