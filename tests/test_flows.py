"""Streams against their batch twins, paged rendering, history and greedy selection."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from trialspark import views as v
from trialspark.functions import scorers as sc
from trialspark.operators import monitor
from trialspark.operators import render as rd
from trialspark.operators import trials as t
from trialspark.session import scratch_path
from trialspark.sources import tasks as tk
from trialspark.streaming import live

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def parts(spark):
    """The trials as four files in event-time order, so a stream takes four micro-batches."""
    base = v.trials(spark, SF)
    pdf = base.toPandas().sort_values("ts_us")
    path = scratch_path(spark, "parts")
    os.makedirs(path)
    step = len(pdf) // 4 + 1
    for i in range(4):
        part = spark.createDataFrame(pdf.iloc[i * step : (i + 1) * step], base.schema).coalesce(1)
        part.write.parquet(f"{path}/tmp{i}")
        name = next(f for f in os.listdir(f"{path}/tmp{i}") if f.endswith(".parquet"))
        os.rename(f"{path}/tmp{i}/{name}", f"{path}/{i}.parquet")
        os.utime(f"{path}/{i}.parquet", (1_000_000 + i * 60, 1_000_000 + i * 60))
    return path, base


def stream(spark, parts):
    return live.event_stream(spark, parts[0], parts[1].schema, "[0-9].parquet", 1)


def test_anomalies_over_micro_batches(spark, parts):
    got = live.anomalies(stream(spark, parts), scratch_path(spark, "t"), 3.0)
    assert rows(got) == rows(monitor.cost_anomalies(parts[1]))
    assert got.count() > 0


def test_budgets_over_micro_batches(spark, parts):
    budgets = {"m_0": 2.0, "m_1": 4.0, "m_2": 6.0}
    got = live.budget_alerts(stream(spark, parts), scratch_path(spark, "t"), budgets)
    assert rows(got) == rows(monitor.budget_exceeded(parts[1], budgets, ["model"]))


def test_burn_over_micro_batches(spark, parts):
    got = live.burn_alerts(stream(spark, parts), scratch_path(spark, "t"), 0.0001, 3600)
    assert rows(got) == rows(monitor.burn_rate(parts[1], 0.0001, 3600))
    assert got.count() > 0


def timed(spark, parts, latest_first=False):
    """The four files one by one; ``latest_first`` brings the newest file before the older ones."""
    names = sorted(n for n in os.listdir(parts[0]) if n.endswith(".parquet"))
    for k, name in enumerate(reversed(names) if latest_first else names):
        os.utime(f"{parts[0]}/{name}", (1_000_000 + k * 60, 1_000_000 + k * 60))
    return stream(spark, parts).withColumn("ts", F.timestamp_micros("ts_us"))


@pytest.mark.parametrize("latest_first", [False, True])
def test_every_row_counts_however_late(spark, parts, latest_first):
    base = parts[1].withColumn("ts", F.timestamp_micros("ts_us"))
    rate = live.trial_rate(timed(spark, parts, latest_first), scratch_path(spark, "t"))
    assert rows(rate) == rows(base.groupBy(live.window_start("ts", 60).alias("start_us")).agg(t.n_rows().alias("trials")))
    stale = live.to_table(live.stale_runs(timed(spark, parts, latest_first)), scratch_path(spark, "t"), "complete")
    assert rows(stale) == rows(live.stale_runs(base))
    twice = timed(spark, parts, latest_first).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    once = live.first_arrivals(twice, scratch_path(spark, "t")).select("trial_id")
    assert rows(once) == rows(base.select("trial_id"))
    timed(spark, parts)


def test_stream_without_a_file(spark, parts):
    folder = scratch_path(spark, "none")
    os.makedirs(folder)
    empty = live.event_stream(spark, folder, parts[1].schema)
    assert live.anomalies(empty, scratch_path(spark, "t"), 3.0).count() == 0
    assert live.burn_alerts(empty, scratch_path(spark, "t"), 0.1).count() == 0
    assert live.to_table(empty.select("trial_id"), scratch_path(spark, "t")).count() == 0
    assert live.model_stats(empty, scratch_path(spark, "t")).count() == 0
    assert live.first_arrivals(empty.withColumn("ts", F.timestamp_micros("ts_us")), scratch_path(spark, "t")).count() == 0


def test_anomaly_case(spark):
    data = [(i, "m", 0.02 if i < 5 else 0.08, i) for i in range(6)]
    df = spark.createDataFrame(data, "trial_id long, model string, cost double, ts_us long")
    alerts = monitor.cost_anomalies(df).collect()
    assert [(a.trial_id, round(a.multiplier, 9)) for a in alerts] == [(5, 4.0)]
    spent = spark.createDataFrame([(0, "m", 0.04, 0), (1, "m", 0.02, 1)], df.schema)
    assert [r.trial_id for r in monitor.budget_exceeded(spent, {"m": 0.05}, ["model"]).collect()] == [1]


def test_history_case(spark):
    data = [("run-1", "v-A", 0.80), ("run-1", "v-A", 0.85), ("run-1", "v-B", 0.70), ("run-1", "v-B", 0.65)]
    data += [("run-2", "v-A", 0.90), ("run-2", "v-A", 0.88), ("run-2", "v-B", 0.60), ("run-2", "v-B", 0.55)]
    df = spark.createDataFrame(data, "run_id string, variant_name string, score double").withColumns({"cost": F.lit(0.1), "latency_seconds": F.lit(1.0)})
    runs = {r.run_id: r for r in t.compare_runs(df, ["run-1", "run-2"]).collect()}
    assert runs["run-1"].avg_score == pytest.approx(0.75)
    assert runs["run-2"].score_delta == pytest.approx(-0.0175)
    worse = t.regressions(df, "run-1", "run-2").collect()
    assert [(r.variant_name, round(r.delta, 6)) for r in worse] == [("v-B", -0.1)]


DOCS = [
    ("s", "api/auth.md", "API", "required", 2, "# Auth\nUse caching for tokens"),
    ("s", "api/caching.md", "API", "recommended", 1, "Cache it | now"),
    ("s", "guides/setup.md", "Guides", "required", 5, "Setup first"),
    ("s", "guides/advanced.md", "Guides", "reference", 0, "Read auth before this"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    df = spark.createDataFrame(DOCS, "source string, rel_path string, section string, tier string, priority long, content string")
    return df.withColumns(
        {
            "token_count": F.lit(10).cast("long"),
            "summary": F.lit(None).cast("string"),
            "last_modified": F.lit("2024-05-01").cast("date"),
            "stem": F.regexp_extract("rel_path", r"([^/]+)\.md$", 1),
        }
    )


def text(df):
    return "".join(r.content for r in df.orderBy("page").collect())


@pytest.mark.parametrize(
    ("variant", "want"),
    [
        ("structure-2tier", "## API\n- api/auth.md: Auth\n- api/caching.md: Cache it | now\n\n## Guides\n- guides/advanced.md: Read auth before this\n- guides/setup.md: Setup first"),
        ("format-pipe-delimited", "path|section|tier|tokens|summary\napi/auth.md|API|required|10|# Auth\napi/caching.md|API|recommended|10|Cache it \\| now\nguides/advanced.md|Guides|reference|10|Read auth before this\nguides/setup.md|Guides|required|10|Setup first"),
        ("format-plain-markdown", "The documentation contains API references and guides.\n\nThe API section includes auth.md (required) covering # Auth, and caching.md (recommended) covering Cache it | now.\n\nThe Guides section includes advanced.md (reference) covering Read auth before this, and setup.md (required) covering Setup first."),
        ("position-bluf", "# Documentation Index\n\n## Guides\n- guides/setup.md (required, ~10 tokens) -- Setup first\n- guides/advanced.md (reference, ~10 tokens) -- Read auth before this\n\n## API\n- api/auth.md (required, ~10 tokens) -- # Auth\n- api/caching.md (recommended, ~10 tokens) -- Cache it | now"),
        ("xref-dense", "- api/auth.md: Auth\n  See also: api/caching.md, guides/advanced.md\n  Referenced by: api/caching.md\n- api/caching.md: Cache it | now\n  See also: api/auth.md\n- guides/advanced.md: Read auth before this\n  See also: guides/setup.md\n  Referenced by: api/auth.md\n- guides/setup.md: Setup first\n  See also: guides/advanced.md"),
        ("no-index", ""),
    ],
)
def test_render(spark, corpus, variant, want):
    assert text(rd.render_variants(corpus, [variant])) == want
    assert text(rd.render_variants(corpus, [variant], page_chars=25)) == want


def test_length_matched_is_greedy_with_skips(spark):
    sizes = pd.DataFrame({"source": "s", "rel_path": [f"f{i}" for i in range(40)], "token_count": [(i * 37) % 90 + 1 for i in range(40)]})
    df = spark.createDataFrame(sizes)
    targets = spark.createDataFrame([("s", 300)], "source string, target_tokens long")
    got = {r.rel_path for r in rd.length_matched(df, targets).collect()}
    order = df.select("rel_path", "token_count", rd.shuffle_key().alias("o")).orderBy("o", "rel_path").collect()
    left, want = 300, set()
    for r in order:
        if r.token_count <= left:
            want.add(r.rel_path)
            left -= r.token_count
    assert got == want


def test_strict_ingest_fails_and_lenient_skips(spark):
    good = "task_id: retrieval_001\ntype: retrieval\nquestion: q\ndomain: library_docs\ndifficulty: easy\n"
    files = spark.createDataFrame([("a.yaml", good), ("b.yaml", "{broken: [")], "path string, text string")
    assert [r.task_id for r in tk.task_ingest(files).collect()] == ["retrieval_001"]
    with pytest.raises(Exception, match="b.yaml"):
        tk.task_ingest(files, strict=True).collect()


def test_perturbation_changes_one_place(spark):
    data = [(f"t_{i:03d}", "the quick brown fox jumps over lazy dogs", "a", ["b"]) for i in range(10)]
    df = spark.createDataFrame(data, "task_id string, question string, expected_answer string, answer_aliases array<string>")
    out = tk.gen_perturbation(df).orderBy("task_id").collect()
    assert [r.perturbation_type for r in out[:5]] == tk.PERTURBATIONS
    for r in out:
        assert r.question != r.original_question
        assert abs(len(r.question) - len(r.original_question)) <= 1


def test_dispatch_equals_single_scorers(spark):
    cases = v.cases(spark, SF)
    every = {r.case_id: (r.task_type, r.x) for r in cases.select("case_id", "task_type", sc.score_all(F.col("task_type")).alias("x")).collect()}
    for kind, fn in sc.SCORERS.items():
        for r in cases.where(F.col("task_type") == kind).select("case_id", fn(F.col).alias("x")).collect():
            assert every[r.case_id] == (kind, pytest.approx(r.x)), kind


def test_every_query_is_registered_with_a_callable():
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert len(queries) > 240
    assert set(oracles) <= set(queries)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
