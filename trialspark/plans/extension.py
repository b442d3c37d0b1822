"""User-supplied metrics, scorers and variants, run like the built-in ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark import views as v
from trialspark.functions import scorers as sc
from trialspark.functions import text as tx
from trialspark.operators import render as rd
from trialspark.operators.custom import compute_metrics, register_metric
from trialspark.plans.base_sql import words_sql
from trialspark.plans.registry import query


@query(
    "udf01_custom_metric",
    f"SELECT case_id, R(least(len({words_sql('response')}) / 100, 1)) AS verbosity, R((contains(lower(response), 'auth'))::INT) AS names_auth FROM cases",
)
def _(spark, sf):
    register_metric("verbosity", lambda c: F.least(F.size(tx.words(c("response"))) / 100.0, F.lit(1.0)))
    register_metric("names_auth", lambda c: F.contains(F.lower(c("response")), F.lit("auth")).cast("double"))
    return compute_metrics(v.cases(spark, sf), ["verbosity", "names_auth"]).select("case_id", "verbosity", "names_auth")


@query("udf02_custom_scorer", "SELECT case_id, R(CASE WHEN case_id % 2 = 0 THEN (contains(response, 'auth'))::INT ELSE 0.0 END) AS score FROM cases")
def _(spark, sf):
    """A new task type scored through the common dispatch; rows of unknown types score 0."""
    sc.register_scorer("house_style", lambda c: F.contains(c("response"), F.lit("auth")).cast("double"))
    try:
        kind = F.when(F.col("case_id") % 2 == 0, "house_style").otherwise("unheard_of")
        cases = v.cases(spark, sf).withColumn("task_type", kind)
        return cases.select("case_id", sc.score_all(F.col("task_type"), only=["house_style"]).alias("score"))
    finally:
        sc.SCORERS.pop("house_style")


@query(
    "udf03_custom_variant",
    "SELECT source, 'custom-tier-paths' AS variant, CAST(0 AS BIGINT) AS page, string_agg('* ' || tier || ' ' || rel_path, chr(10) ORDER BY rel_path) AS content FROM docs GROUP BY 1",
)
def _(spark, sf):
    rd.register_variant("custom-tier-paths", 2, lambda: F.array(rd.piece(rd.join("\n* ", "$tier", " ", "$p"), path=F.col("p"))))
    try:
        return rd.render_variants(v.docs(spark, sf), ["custom-tier-paths"], 10_000_000).drop("pieces")
    finally:
        rd.VARIANTS.pop("custom-tier-paths")
