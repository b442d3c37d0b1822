"""Digests of paged texts against a plain computation over the whole text."""

import hashlib
import random

from trialspark.operators import render as rd

SCHEMA = "source string, variant string, page long, content string"


def paged(text, source, variant, rng):
    """Pages of any length, some of them empty, with gaps between their numbers."""
    rows, at, page = [], 0, 0
    while at < len(text) or not rows:
        n = rng.choice([0, 1, 3, 20, 90])
        rows.append((source, variant, page, text[at : at + n]))
        at, page = at + n, page + rng.choice([1, 1, 5])
    return rows


def plain(text, block):
    parts = [text[i : i + block] for i in range(0, len(text), block)]
    return sum(int(hashlib.md5(f"{b}:{t}".encode()).hexdigest()[:12], 16) for b, t in enumerate(parts)) % 2**61


def test_digest_does_not_depend_on_pages(spark):
    rng = random.Random(3)
    texts = {f"v{i}": "".join(rng.choice("ab \n\u00e9\u4e2d\U0001f600") for _ in range(n)) for i, n in enumerate([0, 1, 7, 14, 100, 400])}
    rows = [r for v, t in texts.items() for s in ("x", "y") for r in paged(t, s, v, rng)]
    rng.shuffle(rows)
    for block in (7, 1000):
        got = {(r.source, r.variant): r for r in rd.digests(spark.createDataFrame(rows, SCHEMA), block=block).collect()}
        assert len(got) == 2 * len(texts)
        for (_, v), r in got.items():
            assert (r.n_chars, r.digest) == (len(texts[v]), plain(texts[v], block))


def test_order_of_blocks_counts(spark):
    rows = [("x", "a", 0, "abcdefg1234567"), ("x", "b", 0, "1234567abcdefg")]
    a, b = rd.digests(spark.createDataFrame(rows, SCHEMA), block=7).collect()
    assert a.digest != b.digest
    assert rd.digests(spark.createDataFrame([], SCHEMA)).count() == 0
