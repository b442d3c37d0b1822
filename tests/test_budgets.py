"""Budgets over one order of documents against the plain greedy walk."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.operators import budgets, render


def greedy(sizes, room):
    taken = []
    for place, n in enumerate(sizes):
        if n <= room:
            taken.append(place)
            room -= n
    return taken


def corpora(seed=3):
    r = random.Random(seed)
    return {
        "hot": [r.choice([2, 50, r.randrange(1, 1000)]) for _ in range(60)],
        "small": [r.randrange(1, 9) for _ in range(7)],
        "large": [10**12, 10**12 + 1, 3, 10**12],
    }


@pytest.mark.parametrize("block,walks", [(16, 3), (1000, 1000)])
def test_budgets_equal_the_plain_walk(spark, block, walks):
    found = corpora()
    placed = spark.createDataFrame([(s, k, n) for s, sizes in found.items() for k, n in enumerate(sizes)], "source string, place long, tokens long")
    r = random.Random(9)
    wanted = [(s, t) for s, sizes in found.items() for t in {0, -5, 1, 2, 3, sum(sizes), sum(sizes) - 1, 10**12, *[r.randrange(1 + sum(sizes)) for _ in range(12)]}]
    asked = spark.createDataFrame([*wanted, ("hot", 77), ("hot", 77), ("unknown", 5)], "source string, target_tokens long")
    got = {}
    for x in budgets.budget_stretches(placed, asked, block, walks).collect():
        got.setdefault((x.source, x.target_tokens), []).extend(range(x.first, x.last))
    assert {k: sorted(v) for k, v in got.items()} == {(s, t): greedy(found[s], t) for s, t in {*wanted, ("hot", 77)} if t > 0 and greedy(found[s], t)}


def test_next_small_entry():
    r = np.random.default_rng(1)
    for n in (1, 2, 5, 64, 100):
        sizes = r.integers(0, 50, n)
        table = budgets.least_table(sizes)
        at, room = r.integers(0, n + 1, 40), r.integers(0, 30, 40)
        want = [next((k for k in range(a, n) if sizes[k] <= m), n) for a, m in zip(at, room)]
        assert budgets.next_small(table, at, room).tolist() == want


def test_texts_per_task_and_null_sizes(spark):
    docs = spark.createDataFrame([("s", f"f{k}", f"text {k}", {3: None, 5: 0}.get(k, 10 + k)) for k in range(12)], "source string, rel_path string, content string, token_count long")
    relevant = spark.createDataFrame(
        [("one", "s", 0, "f2", False), ("two", "s", 0, "f1", False), ("two", "s", 1, "gone", False), ("all", "s", None, None, True), ("none", "s", 0, "gone", False)],
        "task_id string, source string, pos int, rel_path string, whole_corpus boolean",
    )
    wanted = render.oracle_tokens(relevant, docs)
    assert {r.task_id: r.target_tokens for r in wanted.collect()} == {"one": 12, "two": 11, "all": sum(10 + k for k in range(12) if k not in (3, 5)), "none": 0}
    order = docs.withColumn("o", render.shuffle_key()).orderBy("o", "rel_path").collect()
    texts = {r.text_id: r.content for r in render.pages(render.length_matched_texts(wanted, docs), ["text_id"]).collect()}
    assert set(texts) == {"random/s/12", "random/s/11", f"random/s/{sum(10 + k for k in range(12) if k not in (3, 5))}"}
    for t in texts:
        taken = greedy([r.token_count or 0 for r in order], int(t.split("/")[2]))
        assert texts[t] == "\n\n".join(f"## {order[k].rel_path}\n{order[k].content}" for k in taken)
    assert render.length_matched(docs.limit(0), wanted.select("source", "target_tokens")).count() == 0
    assert render.length_matched(docs, wanted.where(F.lit(False))).count() == 0
