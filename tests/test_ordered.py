"""Sliced running sums against plain pandas, with a hot key and several slices."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialspark.operators import ordered as o


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    keys = np.where(rng.random(600) < 0.6, "hot", rng.choice(["a", "b", "c"], 600))
    return pd.DataFrame({"k": keys, "t": rng.permutation(600), "v": rng.integers(0, 50, 600)})


@pytest.mark.parametrize("how", ["sum", "max", "min"])
@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running(spark, frame, how, reverse, exclusive):
    df = spark.createDataFrame(frame)
    got = o.running(df, ["k"], ["t"], {"r": F.col("v")}, how, reverse=reverse, exclusive=exclusive, parts=5)
    got = got.toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    want = []
    for _, g in frame.sort_values(["k", "t"], ascending=[True, not reverse]).groupby("k"):
        acc = {"sum": g.v.cumsum(), "max": g.v.cummax(), "min": g.v.cummin()}[how]
        if exclusive:
            acc = acc.shift(1, fill_value=0) if how == "sum" else acc.shift(1)
        want.append(g.assign(r=acc))
    want = pd.concat(want).sort_values(["k", "t"]).reset_index(drop=True)
    np.testing.assert_allclose(got.r.astype(float), want.r.astype(float))


def test_slices_split_the_hot_key(spark, frame):
    sliced = o.range_slices(spark.createDataFrame(frame), ["k", "t"], 5)
    assert sliced.where("k = 'hot'").select(o.SLICE).distinct().count() > 1


def test_ordinals_and_previous_without_key(spark, frame):
    df = spark.createDataFrame(frame)
    assert [r.n for r in o.ordinals(df, [], ["t"], "n").orderBy("t").collect()] == list(range(1, 601))
    prev = [r.p for r in o.previous(df, [], ["t"], F.col("v"), "p").orderBy("t").collect()]
    values = frame.sort_values("t").v.tolist()
    assert prev == [None, *values[:-1]]


def test_exact_quantiles(spark, frame):
    probs = {"lo": 0.0, "q1": 0.25, "mid": 0.5, "hi": 0.9}
    got = o.exact_quantiles(spark.createDataFrame(frame.astype({"v": float})), ["k"], "v", probs).toPandas().set_index("k")
    for k, g in frame.groupby("k"):
        np.testing.assert_allclose(got.loc[k, list(probs)].astype(float), np.quantile(g.v, list(probs.values())))
