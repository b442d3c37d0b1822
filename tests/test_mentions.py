"""Stems found by keys: stems of every length against a plain search."""

import random

import numpy as np

from trialspark.operators import corpus as co


def test_stems_of_3_to_40_characters(spark):
    r = random.Random(8)
    letters = "abcdé_🙂"
    stems = sorted({"".join(r.choice(letters) for _ in range(r.randrange(3, 41))) for _ in range(150)} | {"a" * k for k in range(1, 14)} | {"Mixed_CASE_é", "x" * 8, "x" * 9})
    rows = []
    for i, s in enumerate(stems):
        named = r.sample(stems, 4)
        filler = "".join(r.choice(letters + " ") for _ in range(r.choice([0, 3, 40])))
        rows.append((r.choice(["s", "t"]), f"p/{i}", s, filler.join(x.upper() if k % 2 else x for k, x in enumerate(named))))
    docs = spark.createDataFrame(rows, "source string, rel_path string, stem string, content string").repartition(5)
    got = {(x.source, x.stem, x.rel_path) for x in co.mentions(docs, whole_word=False).collect()}
    lower = docs.selectExpr("source", "rel_path", "lower(stem) AS low", "stem", "lower(content) AS text").collect()
    want = {(a.source, a.stem, b.rel_path) for a in lower for b in lower if a.source == b.source and a.low in b.text}
    assert got == want and len(want) > 500


def test_texts_send_a_share_of_their_runs():
    r = random.Random(2)
    points = co._code_points("".join(r.choice("abcdefghij ") for _ in range(20_000)))
    runs, windows = co._keys_of(points, {co.GRAM}), co._keys_of(points, {0})
    assert len(windows) < 0.4 * len(runs)
    for at in range(0, 19_000, 97):  # every window of a stem's length has its least run among the text's
        part = co._keys_of(points[at : at + co.GRAM + co.SPAN - 1], {0})
        assert len(part) == 1 and np.isin(part, windows).all()


def test_no_stems_and_no_texts(spark):
    docs = spark.createDataFrame([("s", "p", "", "text"), ("s", "q", None, None)], "source string, rel_path string, stem string, content string")
    assert co.mentions(docs, whole_word=True).count() == 0
    assert co.mentions(docs.limit(0), whole_word=False).count() == 0
