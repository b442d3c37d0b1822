"""A sample of queries per area against their SQL; all of them with TRIALSPARK_ALL=1."""

import math
import os

import pytest

import __spark_entry__ as entry_module

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = sorted(entry_module.oracle_sql())
SAMPLE = CHECKED if os.environ.get("TRIALSPARK_ALL") else CHECKED[::8]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module", autouse=True)
def many_slices(spark):
    """Range slices stay apart, so ordered work takes the carry from slice to slice even on small tables."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def canon(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5)
    return x


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = entry_module.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(canon(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = [tuple(canon(r[i]) for i in order) for r in cur.fetchall()]
    assert cols == sorted(names)
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted(got, key=key) == sorted(want, key=key)
