"""Stems read off the texts in one pass."""

import random
import re

from trialspark.operators import corpus as co


def test_whole_words_against_a_plain_search(spark):
    r = random.Random(5)
    letters = "ab_é-1 中🙂"
    stems = sorted({"".join(r.choice(letters) for _ in range(r.randrange(1, 7))) for _ in range(60)} | {"aaa", "a" * 31, "a" * 32, "a" * 33, "B_long" * 7})
    rows = []
    for i, s in enumerate(stems):
        text = "".join(r.choice(["", " ", "-", "a", "é", "\n", "."]) + x for x in r.sample(stems, 6)) + r.choice(["", "\n", "b"])
        rows.append((r.choice(["s", "t"]), f"p/{i}", s, text))
    docs = spark.createDataFrame(rows, "source string, rel_path string, stem string, content string").repartition(3)
    got = {(x.source, x.stem, x.rel_path) for x in co.mentions(docs, whole_word=True).collect()}

    def holds(stem, text):
        word = lambda c: bool(re.match(r"\w", c))
        at = [i for i in range(len(text)) if text.startswith(stem, i)]
        edge = lambda i: (i > 0 and word(text[i - 1])) != (i < len(text) and word(text[i]))
        return any(edge(i) and edge(i + len(stem)) for i in at)

    want = {(a[0], a[2], b[1]) for a in rows for b in rows if a[0] == b[0] and holds(a[2].lower(), b[3].lower())}
    assert got == want and len(want) > 50


def test_no_text_is_searched_per_stem(spark, capsys):
    docs = spark.createDataFrame([("s", "p", "stem", "a stem"), ("s", "q", "other", "stems")], "source string, rel_path string, stem string, content string")
    for whole in (False, True):
        found = co.mentions(docs, whole)
        found.explain()
        plan = capsys.readouterr().out
        assert "Contains(" not in plan and r"\b" not in plan
        assert {(x.stem, x.rel_path) for x in found.collect()} == ({("stem", "p")} if whole else {("stem", "p"), ("stem", "q")})
