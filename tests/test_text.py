"""Fixed cases for scorers, fuzzy matching and Markdown functions."""

import random

import pytest
from pyspark.sql import functions as F

from trialspark.functions import fuzzy
from trialspark.functions import markdown as md
from trialspark.functions import scorers as s
from trialspark.functions import text as tx


def one(spark, column, **values):
    kinds = {str: "string", list: "array<string>", dict: "map<string,string>", int: "int"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("response", "expected", "score"),
    [
        ("see src/auth.py and ./Docs/Auth.md", ["src/auth.py", "docs/auth.md"], 1.0),
        ("none of them", ["src/auth.py", "docs/auth.md"], 0.0),
        ("nothing", [], 1.0),
        ("a.md", [], 0.0),
        ("lib/auth.py", ["src/auth.py"], 0.5),
    ],
)
def test_retrieval(spark, response, expected, score):
    assert one(spark, s.score_retrieval(F.col("r"), F.col("e")), r=response, e=expected) == pytest.approx(score)


def test_multi_hop(spark):
    def score(response, chain, steps=()):
        return one(spark, s.score_multi_hop(F.col("r"), F.col("c"), F.col("d")), r=response, c=list(chain), d=list(steps))

    weak = "alpha bravo charlie delta echoes"  # one of five keywords is below the threshold
    assert score("only alpha here", [weak]) == 0.0
    assert score("alpha bravo", [weak]) == pytest.approx(0.4)
    assert score("throttle", ["TTL"]) == 0.0
    assert score("the TTL is 3", ["TTL"]) == 1.0
    assert score("x", ["the and"]) == 1.0
    assert score("first second", ["third"], ["first", "second"]) == 1.0


def test_negative(spark):
    for text, want in (("It cannot be determined.", 1.0), ("It's unclear, sorry", 0.7), ("I'm making an assumption", 0.3), ("42", 0.0)):
        assert one(spark, s.score_negative(F.col("r")), r=text) == want


def test_fact_layers(spark):
    def score(r, answer, aliases=()):
        return one(spark, s.score_fact(F.col("r"), F.col("a"), F.col("al")), r=r, a=answer, al=list(aliases))

    assert score("it is Port 8080 indeed", "port 8080") == 1.0
    assert score("use eight thousand", "port 8080", ["EIGHT thousand"]) == 1.0
    assert score("8080 port", "port 8080") == 0.9
    assert score("anything", "") == 0.0
    assert score("zzz qqq", "connection pool") == 0.0


def test_code(spark):
    c = s.score_code(F.col("r"), F.col("t"), F.col("f"))
    code = "```python\nimport os\nprint(1)\n```"
    assert one(spark, c, r=code, t="import\\s+os\nprint", f=["eval("]) == pytest.approx(1.0)
    assert one(spark, c, r="def broken(", t="nothing", f=["broken"]) == pytest.approx(0.0)
    assert one(spark, c, r="x = 1", t="", f=[]) == pytest.approx(1.0)


def test_compositional(spark):
    c = s.score_compositional(F.col("r"), F.col("a"))
    assert one(spark, c, r="Alpha and gamma", a=["alpha", "", "gamma"]) == 1.0
    assert one(spark, c, r="configuraton file", a=["configuration manual"]) == pytest.approx(0.5)
    assert one(spark, c, r="x", a=[""]) == 1.0


def test_code_patterns(spark):
    rows = [
        ("x = 1\nprint(x)", "x = \\d\n\n  \nPRINT", ["import os", "[", "("], 1.0, 1 / 3, True),
        ("```python\nfoo(\n```", "foo", [], 1.0, 0.0, False),
        ("STRASSE \u017f", "s\nz", ["K|z", "e"], 0.5, 0.5, False),
        ("", "a.b\n(", None, 0.0, 0.0, True),
        ("ok", None, ["o"], 1.0, 1.0, True),
        (None, "a", ["b"], None, None, None),
    ]
    df = spark.createDataFrame(rows, "r string, t string, f array<string>, found double, broken double, valid boolean")
    args = [F.col(c) for c in ("r", "t", "f")]
    for r in df.select("*", s.code_parts(*args).alias("p"), s.score_code(*args).alias("score")).collect():
        assert (r.p.found, r.p.broken, r.p.valid) == (r.found, pytest.approx(r.broken) if r.r is not None else None, r.valid)
        want = None if r.r is None else min(1.0, 0.7 * r.found + 0.2 * (1 - r.broken) + 0.1 * r.valid)
        assert r.score == (None if want is None else pytest.approx(want))


def test_json_or_words(spark):
    for raw, want in (('["a", "b c"]', ["a", "b c"]), ('"one"', ["one"]), ("12", ["12"]), ("plain words", ["plain", "words"]), (" ", [])):
        assert one(spark, tx.json_or_words(F.col("r")), r=raw) == want


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[j]))
    return row[-1]


def _plain(text):
    return "".join(c if c.isalnum() else " " for c in text.lower()).strip()


def _stretch_found(needle, hay):
    a, b = sorted((_plain(needle), _plain(hay)), key=len)
    m = len(a)
    stretches = {b[max(i, 0) : i + m] for i in range(1 - m, len(b))}
    return m > 0 and any(200 * _common(a, s) >= 80 * (m + len(s)) for s in stretches)


def _sets_alike(a, b):
    left, right = set(_plain(a).split()), set(_plain(b).split())
    if not left or not right:
        return None
    shared, x, y = (" ".join(sorted(w)) for w in (left & right, left - right, right - left))
    pairs = [((shared + " " + x).strip(), (shared + " " + y).strip())]
    if shared:
        pairs += [(shared, (shared + " " + z).strip()) for z in (x, y)]
    alike = max(200 * _common(p, q) / (len(p) + len(q)) for p, q in pairs)
    return 0.9 if alike >= 85 else 0.7 if alike >= 70 else None


def _texts(rnd, n):
    """Pairs of unlike texts and of copies with edits, short ones and ones over several machine words."""
    for _ in range(n):
        letters = rnd.choice(["ab", "abcd", "abcde \u00e9-", "a\u00df\u6f22\U0001f600 b"])
        size = rnd.choice([3, 7, 20, 70, 150])
        draw = lambda k: "".join(rnd.choice(letters) for _ in range(rnd.randint(0, k)))  # noqa: E731, B023
        a = draw(size)
        b = list(a) if rnd.random() < 0.6 else list(draw(2 * size))
        for _ in range(len(b) // 6):
            b[rnd.randrange(len(b))] = rnd.choice(letters)
        yield a, draw(9) + "".join(b)


def test_fuzzy_against_brute_force(spark):
    pairs = [*_texts(random.Random(2), 300), ("", ""), ("needlf x", "y" * 2000 + " needle x"), ("fuzzy was a bear", "fuzzy fuzzy was a bear")]
    df = spark.createDataFrame(pairs, "a string, b string").repartition(4)
    a, b = F.col("a"), F.col("b")
    rows = df.select(
        "a",
        "b",
        fuzzy.common_length(fuzzy.bit_masks(a), b).alias("common"),
        fuzzy.partial_hit(fuzzy.plain(a), fuzzy.plain(b)).alias("found"),
        fuzzy.close_match(a, b).alias("close"),
    ).collect()
    for r in rows:
        assert (r.common, r.found, r.close) == (_common(r.a, r.b), _stretch_found(r.a, r.b), _sets_alike(r.a, r.b)), (r.a, r.b)
    assert {True, False} == {r.found for r in rows} and {0.9, 0.7, None} == {r.close for r in rows}
    assert one(spark, fuzzy.close_match(F.col("r"), F.lit(None).cast("string")), r="x") is None


def test_markdown(spark):
    f = lambda fn, text: one(spark, fn(F.col("c")), c=text)
    assert f(md.compress_markdown, "Line 1\n\n\n\nLine 2") == "Line 1\n\nLine 2"
    assert f(md.compress_markdown, "<!-- a\nb -->#Head  \ntext") == "# Head\ntext"
    assert f(md.brief_summary, "\n## \n# Title here\nbody") == "Title here"
    assert f(md.summarise, "x" * 120) == "x" * 97 + "..."
    assert f(md.content_summary, "# a\n\n b") == "a b"
    assert f(md.paragraph_leads, "a\nb\n\nc\n\n\nd") == "a\nc\nd"
    assert f(md.restructure, "# A\ntext\n## B\n") == "### Table of Contents\n\n- A\n  - B\n\n### Excerpts\n- **A**: text\n- **B**"
    assert f(md.detect_version, "since version 2.1 or v3.0") == "v2.1"
    assert f(md.detect_version, "none") == "unversioned"


def test_summary_shortcuts_equal_whole_text(spark):
    rnd = random.Random(4)
    texts = ["\n".join(" " * rnd.randint(0, 3) + rnd.choice(["", "#", "## ", "# x", "word " * rnd.randint(1, 30)]) for _ in range(rnd.randint(1, 60))) for _ in range(200)]
    texts += ["\n" * 900 + "# late title", "# " * 300 + "\nx", " " * 1000]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    for r, t in zip(df.select("c", md.brief_summary(F.col("c")).alias("b"), md.content_summary(F.col("c")).alias("s")).collect(), texts):
        want = next((x.strip().lstrip("# ") for x in r.c.splitlines() if x.strip().lstrip("# ")), "")[:80]
        flat = " ".join(r.c.split()).lstrip("# ").strip()
        assert r.b == want
        assert r.s == (flat[:100].rstrip() + "..." if len(flat) > 100 else flat)


@pytest.mark.parametrize(("path", "want"), [("README.md", ""), ("docs/setup.md", ""), ("docs/guides/auth.md", "guides"), ("docs/api/v2/users/create.md", "api")])
def test_section(spark, path, want):
    assert one(spark, md.extract_section(F.col("p")), p=path) == want


@pytest.mark.parametrize(
    ("path", "want"),
    [("a.md", "one"), ("d/a.md", "three"), ("README.md", "one"), ("x/y/README.md", "two"), ("docs/api/v1/x.md", "two"), ("z.txt", "three")],
)
def test_tiers(spark, path, want):
    tiers = [("one", ["*.md"]), ("two", ["**/README.md", "docs/**/*.md"]), ("three", [])]
    assert one(spark, md.assign_tier(F.col("p"), tiers), p=path) == want
    assert one(spark, md.assign_tier(F.col("p"), []), p=path) == ""
