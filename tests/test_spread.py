"""Operators that spread one large group over many slices, runs or pairs."""

import random

import pytest
from pyspark.sql import functions as F

from trialspark.operators import corpus as co
from trialspark.operators import stats as st


def test_bootstrap_of_many_slices_is_one_multinomial(spark, monkeypatch):
    monkeypatch.setattr(st, "SLICE_VALUES", 8)
    rows = spark.range(400).select(F.lit("g").alias("k"), (F.col("id") % 150 / 10).alias("x"))
    ones = lambda x: 0 * x + 1
    drawn = st.bootstrap_ci(rows, ["k"], "x", 300, features=(lambda x: x, ones), finish=lambda n, s: s[1] / n).first()
    assert drawn["ci_lower"] == drawn["ci_upper"] == drawn["point_estimate"] == 1.0  # every resample has all its rows
    mean = st.bootstrap_ci(rows, ["k"], "x", 2000).first()
    values = [i % 150 / 10 for i in range(400)]
    mu = sum(values) / 400
    half = 1.96 * (sum((v - mu) ** 2 for v in values) / 400) ** 0.5 / 20
    assert mean["ci_lower"] == pytest.approx(mu - half, abs=0.1) and mean["ci_upper"] == pytest.approx(mu + half, abs=0.1)


def test_mann_whitney_equals_all_pairs(spark):
    draw = random.Random(3)
    rows = [(g, float(draw.randrange(6)) if g != "c" else draw.random()) for g in "abc" for _ in range(40)]
    got = {(r["a"], r["b"]): (r["n_a"], r["n_b"], r["u"]) for r in st.mann_whitney(spark.createDataFrame(rows, "g string, x double"), "g", "x").collect()}
    of = {g: [x for k, x in rows if k == g] for g in "abc"}
    for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
        u = sum(1.0 if y < x else 0.5 if y == x else 0.0 for x in of[a] for y in of[b])
        assert got[a, b] == (40, 40, u)


def test_wilcoxon_without_pairs_or_differences(spark):
    pairs = spark.createDataFrame([("k", 0.5, 0.5), ("k", 0.25, 0.25)], "k string, score_a double, score_b double")
    r = st.wilcoxon(pairs, ["k"]).first()
    assert (r["pairs"], r["n"], r["p_value"], r["effect_size"]) == (2, 0, 1.0, 0.0)
    assert st.wilcoxon(pairs.limit(0), ["k"]).count() == 0


def test_mentions_of_stems_with_one_beginning(spark):
    """2,000 stems begin alike; each text names two others, some of them only inside a longer word."""
    n = 2000
    rows = [("s", f"p/{i}.md", f"documentation_{i:05d}", f"See Documentation_{(i + 1) % n:05d} and xdocumentation_{(i + 7) % n:05d}y. ab") for i in range(n)]
    rows += [("s", "p/short.md", "ab", "nothing here"), ("t", "p/0.md", "documentation_00000", "documentation_00001"), ("s", "p/null.md", "nul", None), ("s", "p/none.md", "", "")]
    docs = spark.createDataFrame(rows, "source string, rel_path string, stem string, content string")
    got = {(r["source"], r["stem"], r["rel_path"]) for r in co.mentions(docs, whole_word=False).collect()}
    want = {("s", f"documentation_{(i + k) % n:05d}", f"p/{i}.md") for i in range(n) for k in (1, 7)} | {("s", "ab", f"p/{i}.md") for i in range(n)}
    assert got == want
    whole = {(r["stem"], r["rel_path"]) for r in co.mentions(docs, whole_word=True).where("stem <> 'ab'").collect()}
    assert whole == {(f"documentation_{(i + 1) % n:05d}", f"p/{i}.md") for i in range(n)}
