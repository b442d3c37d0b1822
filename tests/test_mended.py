"""Cases that once failed."""

import datetime as dt

from pyspark.sql import functions as F

from trialspark.functions import special as sp
from trialspark.operators import catalog as cat
from trialspark.operators import doe
from trialspark.operators import metrics as mt
from trialspark.operators import render as rd
from trialspark.operators import stats as st


def test_factor_named_twice_keeps_its_last_level(spark):
    df = spark.createDataFrame([("a=x+a=y",), ("a=x+b=y",), ("plain",)], "name string")
    got = [r.m for r in df.select(doe.parse_combination(F.col("name")).alias("m")).collect()]
    assert got == [{"a": "y"}, {"a": "x", "b": "y"}, {"combination": "plain"}]


def test_error_in_config_is_overwritten(spark):
    rows = [("r", "create", 1, 1, {"error": "old", "k": "v"}, None), ("r", "failed", 2, 2, None, "new")]
    log = spark.createDataFrame(rows, "run_id string, event string, ts long, seq long, config map<string,string>, error string")
    row = cat.run_state(log).first()
    assert row.status == "failed" and '"error":"new"' in row.config and '"k":"v"' in row.config


def test_power_of_degenerate_designs_is_zero():
    assert sp.anova_power(1, 10, 0.5, 0.05) == 0.0 and sp.anova_power(3, 10, 0.0, 0.05) == 0.0


def test_studentized_range_is_smooth_in_its_degrees_of_freedom():
    assert abs(sp.srange_sf(3.5, 3, 19_999.0) - sp.srange_sf(3.5, 3, 20_001.0)) < 1e-8
    assert abs(sp.srange_sf(3.314, 3, 1e7) - 0.05) < 1e-3


def test_faithfulness_uses_the_sources_of_the_response(spark):
    responses = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, "alpha"), (4, None)], "case_id long, response string")
    sources = spark.createDataFrame([(1, "Alpha, gamma"), (2, "beta"), (2, "alpha"), (4, "x")], "case_id long, text string")
    got = {r.case_id: r.faithfulness for r in mt.faithfulness(responses, sources, "case_id").collect()}
    assert got == {1: 0.5, 2: 1.0, 3: 0.0, 4: 0.0}


def test_tasks_without_references_share_the_text_of_their_corpus(spark):
    docs = spark.createDataFrame([("s", "b.md", "B"), ("s", "a.md", "A"), ("other", "c.md", "C")], "source string, rel_path string, content string")
    relevant = spark.createDataFrame(
        [("t1", "s", None, None, True), ("t2", "s", None, None, True), ("t3", "s", 0, "b.md", False)],
        "task_id string, source string, pos long, rel_path string, whole_corpus boolean",
    )
    texts = {r.text_id: r.content for r in rd.pages(rd.oracle_texts(relevant, docs), ["text_id"], 1000).collect()}
    assert texts == {"corpus/s": "## a.md\nA\n\n## b.md\nB", "t3": "## b.md\nB"}
    ids = {r.task_id: r.text_id for r in rd.oracle_text_ids(relevant).collect()}
    assert ids == {"t1": "corpus/s", "t2": "corpus/s", "t3": "t3"}


def test_power_says_when_the_goal_is_out_of_reach(spark):
    clear = [("clear", g, float(i % 5 + (g == "b"))) for g in "ab" for i in range(20)]
    tiny = [("tiny", g, float(i % 5) + (0.0001 if g == "b" else 0.0)) for g in "ab" for i in range(20)]
    df = spark.createDataFrame(clear + tiny, "family string, g string, x double")
    got = {r.family: (r.goal_reached, r.n_required) for r in st.achieved_power(df, ["family"], "g", "x").collect()}
    assert got["clear"][0] and not got["tiny"][0] and got["tiny"][1] == 10_000


def test_id_sets(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = {(r.id, r.part) for r in cat.id_algebra(ids("a", "b", "b"), ids("b", "c")).collect()}
    assert got == {("a", "removed"), ("b", "common"), ("c", "added")}
