"""Orthogonal arrays and the checking SQL for F tails."""

import itertools
from collections import Counter

import duckdb
import pytest

from trialspark import design
from trialspark.functions import special
from trialspark.plans import tails


@pytest.mark.parametrize("name", design.ARRAYS)
def test_every_pair_of_columns_is_balanced(name):
    rows, levels = design.orthogonal_array(name)
    assert len(rows) == int(name[1:]) and all(len(r) == len(levels) for r in rows)
    for a, b in itertools.combinations(range(len(levels)), 2):
        counts = Counter((r[a], r[b]) for r in rows)
        assert len(counts) == levels[a] * levels[b] and len(set(counts.values())) == 1, (name, a, b)


def test_arrays_cover_what_they_are_known_for():
    counts = {n: Counter(design.orthogonal_array(n)[1]) for n in design.ARRAYS}
    assert counts["L12"] == {2: 11} and counts["L36"] == {2: 11, 3: 12} and counts["L50"] == {2: 1, 5: 11}
    assert counts["L54"] == {2: 1, 3: 25} and counts["L64"] == {4: 21} and counts["L18"] == {2: 1, 3: 7}


def test_f_tails_of_the_checking_sql():
    con = duckdb.connect()
    for d1, d2, f in itertools.product((1, 2, 5, 40), (1, 2, 30, 3347, 100_000, 1_000_000), (0.01, 0.6, 0.93, 1.0, 2.5, 9.0)):
        got = con.execute(f"SELECT {tails.f_sf(str(f) + '::DOUBLE', str(d1), str(d2))}").fetchone()[0]
        assert got == pytest.approx(float(special.f_sf(f, d1, d2)), rel=2e-7, abs=1e-12), (d1, d2, f)
