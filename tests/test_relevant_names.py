"""Names of tasks against a plain search of path suffixes."""

from pyspark.sql import functions as F

from trialspark.operators import corpus as co

TASKS = "task_id string, source string, expected_files array<string>, files map<string,string>, source_names array<string>, nearest_doc string"


def test_names_by_path_suffix(spark):
    paths = [("s", p) for p in ("a/x.md", "b/x.md", "b/xx.md", "c/b/x.md", "x.md", "d/only.md")] + [("t", "z/x.md")]
    names = ["x.md", "b/x.md", "/x.md", "xx.md", "md", "none.md", "c/b/x.md", "x/", "only.md", "/only.md"]
    docs = spark.createDataFrame(paths, "source string, rel_path string")
    tasks = spark.createDataFrame([(f"{s}{i}", s, [], {}, ["", n, "only.md"], None) for s in "st" for i, n in enumerate(names)], TASKS)
    got = {}
    for r in co.relevant_docs(tasks, docs).orderBy("task_id", "pos").collect():
        got.setdefault(r.task_id, []).extend([r.rel_path] if r.rel_path else [])
    first = lambda s, n: min([p for q, p in paths if q == s and p.endswith(n)], default=None)
    assert got == {f"{s}{i}": [p for p in (first(s, n), first(s, "only.md")) if p] for s in "st" for i, n in enumerate(names)}


def test_a_common_name_is_not_paired_with_every_task(spark, capsys):
    docs = spark.range(300).select(F.lit("s").alias("source"), F.concat("id", F.lit("/x.md")).alias("rel_path"))
    tasks = docs.select(
        F.col("rel_path").alias("task_id"), "source", F.array().cast("array<string>").alias("expected_files"),
        F.create_map().cast("map<string,string>").alias("files"), F.array(F.lit("x.md")).alias("source_names"), F.lit(None).cast("string").alias("nearest_doc"),
    )
    found = co.relevant_docs(tasks, docs)
    assert found.count() == 300 and found.select("rel_path").distinct().count() == 1
    found.explain("cost")
    names = [x for x in capsys.readouterr().out.splitlines() if "Join Inner" in x and "_tail" in x]
    assert not names  # suffixes meet names by their least path, not document by document
