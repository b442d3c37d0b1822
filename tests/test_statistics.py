"""Fixed and brute-force cases for tests, intervals, agreement and designs."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialspark import design as ds
from trialspark.functions import special as sp
from trialspark.operators import agreement as ag
from trialspark.operators import curves as c
from trialspark.operators import doe
from trialspark.operators import stats as st


def test_special_functions():
    assert sp.f_sf(5.14, 2, 6) == pytest.approx(0.05006, abs=1e-5)
    assert sp.t_ppf(0.975, 8) == pytest.approx(2.306004, abs=1e-6)
    assert sp.norm_ppf_scalar(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert sp.srange_sf(3.773, 3, 12) == pytest.approx(0.05, abs=2e-4)
    assert sp.srange_sf(4.327, 4, 10) == pytest.approx(0.05, abs=2e-4)
    assert sp.anova_power(3, 53, 0.25, 0.05) >= 0.80 > sp.anova_power(3, 52, 0.25, 0.05)


def test_norm_ppf_column(spark):
    p = np.concatenate([[1e-12, 1e-6, 0.01], np.linspace(0.05, 0.95, 10), [1 - 1e-6]])
    got = spark.createDataFrame(pd.DataFrame({"p": p})).select(sp.norm_ppf(F.col("p")).alias("z")).toPandas().z
    np.testing.assert_allclose([sp.norm_cdf(z) for z in got], p, rtol=1e-9)


def test_holm_and_bh(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.06)], "family string, test string, p_value double")
    got = {r.test: r for r in c.holm(df, ["family"], ["test"]).collect()}
    assert [round(got[t].corrected_p, 9) for t in "abc"] == [0.03, 0.08, 0.08]
    assert [got[t].significant for t in "abc"] == [True, False, False]
    bh = [r.corrected_p for r in c.benjamini_hochberg(df, ["family"], ["test"]).orderBy("p_value").collect()]
    np.testing.assert_allclose(bh, [0.03, 0.06, 0.06])


def _wilcoxon(spark, a, b):
    pdf = pd.DataFrame({"k": 1, "score_a": a, "score_b": b})
    return st.wilcoxon(spark.createDataFrame(pdf), ["k"]).first()


def test_wilcoxon_cases(spark):
    same = _wilcoxon(spark, [0.1, 0.5, 0.9], [0.1, 0.5, 0.9])
    assert (same.p_value, same.effect_size, same.significant, same.statistic) == (1.0, 0.0, False, 0.0)
    # a published paired sample: V = 40, n = 9, exact two-sided p = 0.0390625
    x = [1.83, 0.50, 1.62, 2.48, 1.68, 1.88, 1.55, 3.06, 1.30]
    y = [0.878, 0.647, 0.598, 2.05, 1.06, 1.29, 1.06, 3.14, 1.29]
    r = _wilcoxon(spark, x, y)
    assert r.statistic == 5.0
    assert r.p_value == pytest.approx(0.0390625)
    assert r.effect_size == pytest.approx(1 - 2 * 5 / 45)


def test_bootstrap(spark):
    flat = spark.createDataFrame(pd.DataFrame({"k": "a", "x": [0.5] * 6}))
    r = st.bootstrap_ci(flat, ["k"], "x", 200).first()
    assert r.point_estimate == r.ci_lower == r.ci_upper == 0.5
    one = st.bootstrap_ci(spark.createDataFrame(pd.DataFrame({"k": "a", "x": [0.5]})), ["k"], "x", 200).first()
    assert math.isnan(one.ci_lower)
    with pytest.raises(ValueError):
        st.bootstrap_ci(flat, ["k"], "x", 50)


def test_bootstrap_slices_keep_the_distribution(spark, monkeypatch):
    x = np.random.default_rng(3).normal(10, 2, 400)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "x": x}))
    whole = st.bootstrap_ci(df, ["k"], "x", 2000).first()
    monkeypatch.setattr(st, "SLICE_VALUES", 60)
    cut = st.bootstrap_ci(df, ["k"], "x", 2000).first()
    half = 1.96 * x.std() / 20
    for r in (whole, cut):
        assert r.ci_lower == pytest.approx(x.mean() - half, abs=0.04)
        assert r.ci_upper == pytest.approx(x.mean() + half, abs=0.04)


def test_shapiro(spark):
    # a published sample: W = 0.79, p about 0.007 (n = 11)
    x = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = spark.createDataFrame(pd.DataFrame({"k": 1, "x": np.array(x, float), "i": range(11)}))
    r = st.shapiro_wilk(df, ["k"], "x", "i").first()
    assert r.statistic == pytest.approx(0.7888, abs=2e-3)
    assert r.p_value == pytest.approx(0.0067, abs=1e-3)


def test_levene_and_single_group(spark):
    a, b = [1.0, 2, 3, 4, 10], [2.0, 2, 2, 3, 3]
    pdf = pd.DataFrame({"f": "x", "g": ["a"] * 5 + ["b"] * 5, "v": a + b})
    r = st.levene(spark.createDataFrame(pdf), ["f"], "g", "v").first()
    za, zb = np.abs(np.array(a) - 3), np.abs(np.array(b) - 2)
    every = np.concatenate([za, zb])
    between = 5 * ((za.mean() - every.mean()) ** 2 + (zb.mean() - every.mean()) ** 2)
    within = ((za - za.mean()) ** 2).sum() + ((zb - zb.mean()) ** 2).sum()
    assert r.statistic == pytest.approx(between / (within / 8))
    assert r.p_value == pytest.approx(sp.f_sf(r.statistic, 1, 8))
    only = st.levene(spark.createDataFrame(pdf[pdf.g == "a"]), ["f"], "g", "v").first()
    assert (only.statistic, only.p_value) == (0.0, 1.0)


def _pair(spark, x, y):
    return spark.createDataFrame(pd.DataFrame({"k": 1, "x": np.array(x, float), "y": np.array(y, float)}))


def test_agreement_cases(spark):
    s = [0.1, 0.3, 0.5, 0.7, 0.9]
    assert ag.kappa(_pair(spark, s, s), ["k"], "x", "y").first().kappa == 1.0
    ten = [i / 10 for i in range(10)]
    assert ag.kappa(_pair(spark, ten, ten[::-1]), ["k"], "x", "y").first().kappa < 0.3
    flat = _pair(spark, [0.5] * 4, [0.5] * 4)
    assert ag.kappa(flat, ["k"], "x", "y").first().kappa == 1.0
    assert ag.spearman(flat, ["k"], "x", "y").first().rho == 0.0
    assert ag.kendall(flat, ["k"], "x", "y").first().tau == 0.0


def test_kendall_brute_force(spark):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 40, 150) / 40, rng.random(150).round(2)
    pairs = [(np.sign(x[i] - x[j]), np.sign(y[i] - y[j])) for i, j in itertools.combinations(range(150), 2)]
    a, b = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    want = (a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum())
    assert ag.kendall(_pair(spark, x, y), ["k"], "x", "y").first().tau == pytest.approx(want)
    assert ag.kendall(_pair(spark, x, y), [], "x", "y").first().tau == pytest.approx(want)


def test_panel(spark):
    rows = [(f"e{i}", m, s) for m, ss in (("a", (0.8, 0.6, 0.4)), ("b", (0.7, 0.5, 0.3)), ("c", (0.9, 0.7, 0.5))) for i, s in enumerate(ss)]
    r = ag.panel_aggregate(spark.createDataFrame(rows, "example_id string, judge_model string, score double")).where("example_id = 'e0'").first()
    assert r.aggregate == pytest.approx(0.8)
    assert r.spread == pytest.approx(0.2)


# ---- designs -------------------------------------------------------------
@pytest.mark.parametrize("name", ["L4", "L8", "L9", "L16", "L18", "L25", "L27", "L81"])
def test_balanced_arrays(name):
    rows, levels = ds.orthogonal_array(name)
    cols = list(zip(*rows))
    for i, j in itertools.combinations(range(len(levels)), 2):
        counts = {}
        for p in zip(cols[i], cols[j]):
            counts[p] = counts.get(p, 0) + 1
        assert len(counts) == levels[i] * levels[j]
        assert len(set(counts.values())) == 1


@pytest.mark.parametrize(
    ("name", "runs", "columns"),
    [("L12", 12, 11), ("L36", 36, 23), ("L50", 50, 12), ("L54", 54, 26), ("L64", 64, 21)],
)
def test_array_shapes(name, runs, columns):
    rows, levels = ds.orthogonal_array(name)
    assert (len(rows), len(levels), {len(r) for r in rows}) == (runs, columns, {columns})
    assert all(max(c) == n - 1 for c, n in zip(zip(*rows), levels))


def test_select_array():
    assert ds.select_array([2, 2, 2]) == "L4"
    assert ds.select_array([3, 3, 3, 3]) == "L9"
    assert ds.select_array([5, 4, 3, 3, 2]) == "L25"
    with pytest.raises(ValueError):
        ds.select_array([9, 9])
    with pytest.raises(ValueError):
        ds.fractional_factorial({"a": ("x", "y")})


def _trials(spark, rows):
    return spark.createDataFrame(rows, "oa_row_id long, score double")


def test_sn_ratio_cases(spark):
    def sn(values, kind):
        return doe.sn_ratios(_trials(spark, [(1, float(v)) for v in values]), (), kind).first().sn

    assert sn([1, 1, 1], "larger_is_better") == pytest.approx(0.0, abs=1e-6)
    assert sn([2, 2, 2], "larger_is_better") == pytest.approx(6.0206, abs=1e-4)
    assert sn([1, 1, 1], "nominal_is_best") == 100.0
    assert all(math.isfinite(sn([0, 0], k)) for k in ("larger_is_better", "smaller_is_better", "nominal_is_best"))
    with pytest.raises(ValueError):
        doe.sn_expr("best", F.col("score"))


def test_anova_shares_sum_to_one(spark):
    factors = {"a": ["a0", "a1", "a2"], "b": ["b0", "b1", "b2"]}
    design = ds.design_frame(spark, ds.array_design(factors, "L9"))
    levels = ds.literal_rows(spark, [(f, x, i) for f, xs in factors.items() for i, x in enumerate(xs)], "factor, level, level_pos")
    sn = doe.sn_ratios(_trials(spark, [(i, 0.2 + 0.05 * i + (i % 3) * 0.1) for i in range(1, 10)]))
    table = doe.anova(sn, doe.main_effects(sn, design, levels)).toPandas()
    assert table.eta_squared.sum() + table.error_eta_squared.iloc[0] == pytest.approx(1.0)
    assert (table.omega_squared <= table.eta_squared + 1e-12).all()
    assert table.p_value.between(0, 1).all()


def test_predict_optimal(spark):
    rows = [("s", "flat", 0, 1.0), ("s", "2tier", 1, 3.0), ("s", "3tier", 2, 5.0), ("m", "path", 0, 2.0), ("m", "summary", 1, 4.0), ("m", "tokens", 2, 3.0)]
    r = doe.predict_optimal(ds.literal_rows(spark, rows, "factor, level, level_pos, mean_sn")).first()
    assert r.optimal == "m=summary+s=3tier"
    assert r.predicted_sn == pytest.approx(6.0)


def test_factorial_effects_and_lenth(spark):
    design = ds.full_factorial({"A": ("-", "+"), "B": ("-", "+")})
    y = {("-", "-"): 20.0, ("+", "-"): 40.0, ("-", "+"): 30.0, ("+", "+"): 52.0}
    level = {(r, f): lv for r, f, lv, _ in design}
    resp = ds.literal_rows(spark, [(r, y[level[r, "A"], level[r, "B"]]) for r in range(1, 5)], "run_id, y")
    fx = doe.factorial_effects(resp, doe.effect_signs(spark, design))
    assert {r.effect: r.estimate for r in fx.collect()} == {"A": 21.0, "B": 11.0, "A:B": 1.0}
    out = doe.lenth(fx.withColumn("f", F.lit(1)), ["f"]).first()
    assert out.pse == pytest.approx(1.5 * 11.0)
    with pytest.raises(ValueError):
        doe.effect_signs(spark, [(1, "A", "x", 1)])


def test_checking_sql_of_tails():
    """The SQL twins of the tail functions, which compute them another way."""
    import duckdb

    from trialspark.functions import special as sp
    from trialspark.plans import tails

    def value(expression, **cols):
        names = ", ".join(f"{v!r} AS {k}" if isinstance(v, int) else f"{v!r}::DOUBLE AS {k}" for k, v in cols.items())
        return duckdb.sql(f"SELECT {expression} FROM (SELECT {names})").fetchall()[0][0]

    for z in (-9.0, -3.3, -0.2, 0.0, 0.7, 5.0, 7.5):
        assert abs(value(tails.norm_cdf("z"), z=z) - sp.norm_cdf(z)) < 1e-14
    for p in (1e-6, 0.01, 0.5, 0.9, 0.99999):
        assert abs(value(tails.norm_ppf("p"), p=p) - sp.norm_ppf_scalar(p)) < 1e-10
    for d1, d2, nc in ((2, 30, 7.5), (6, 4000, 0.3), (6, 900, 40.0)):
        c = value(tails.f_ppf("0.05", "d1", "d2"), d1=d1, d2=d2)
        assert abs(c - sp.f_ppf(0.95, d1, d2)) < 1e-8
        assert abs(value(tails.ncf_sf("c", "d1", "d2", "nc"), c=c, d1=d1, d2=d2, nc=nc) - sp.ncf_sf(c, d1, d2, nc)) < 1e-8
    for q, k, df in ((0.3, 7, 3000), (3.4, 3, 20), (4.2, 7, 900)):
        got = duckdb.sql(f"WITH e AS (SELECT 1 AS g, {q}::DOUBLE AS q, {k} AS k, {df} AS df), {tails.srange_sf('e', 'g')} SELECT p FROM sr").fetchall()[0][0]
        assert abs(got - sp.srange_sf(q, k, df)) < 1e-9
