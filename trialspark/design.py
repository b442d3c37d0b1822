"""Experimental designs as small literal tables (at most 81 runs)."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The 18-run mixed array (one two-level, seven three-level columns).
L18_ROWS: list[list[int]] = [
    [0, 0, 0, 0, 0, 0, 0, 0],
    [0, 0, 1, 1, 1, 1, 1, 1],
    [0, 0, 2, 2, 2, 2, 2, 2],
    [0, 1, 0, 0, 1, 1, 2, 2],
    [0, 1, 1, 1, 2, 2, 0, 0],
    [0, 1, 2, 2, 0, 0, 1, 1],
    [0, 2, 0, 1, 0, 2, 1, 2],
    [0, 2, 1, 2, 1, 0, 2, 0],
    [0, 2, 2, 0, 2, 1, 0, 1],
    [1, 0, 0, 2, 1, 2, 0, 1],
    [1, 0, 1, 0, 2, 0, 1, 2],
    [1, 0, 2, 1, 0, 1, 2, 0],
    [1, 1, 0, 1, 2, 0, 2, 1],
    [1, 1, 1, 2, 0, 1, 0, 2],
    [1, 1, 2, 0, 1, 2, 1, 0],
    [1, 2, 0, 2, 2, 1, 1, 0],
    [1, 2, 1, 0, 0, 2, 2, 1],
    [1, 2, 2, 1, 1, 0, 0, 2],
]
# Fixed values, found by a search: first rows of the 3 x 3 circulant blocks of a difference scheme of 12 rows modulo 3.
SCHEME_12: list[list[list[int]]] = [
    [[0, 1, 0], [0, 0, 1], [1, 2, 2], [1, 2, 1]],
    [[2, 1, 1], [2, 1, 2], [1, 2, 1], [1, 1, 2]],
    [[0, 1, 0], [0, 2, 2], [0, 1, 0], [2, 1, 2]],
    [[0, 0, 2], [1, 2, 1], [1, 2, 1], [2, 0, 2]],
]


def literal_rows(spark: SparkSession, rows: Sequence[tuple], names: str) -> DataFrame:
    """A fixed list of rows as a local relation, so its size is known to the optimizer."""
    def cell(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else f"CAST({v} AS BIGINT)"

    body = ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def _field(levels: int):
    """Addition and multiplication of the field with 4 or a prime number of elements."""
    if levels == 4:  # polynomials over two elements modulo x^2 + x + 1

        def times(a: int, b: int) -> int:
            c = (a if b & 1 else 0) ^ (2 * a if b & 2 else 0)
            return c ^ 7 if c & 4 else c

        return lambda a, b: a ^ b, times
    return lambda a, b: (a + b) % levels, lambda a, b: a * b % levels


def _linear(levels: int, k: int) -> list[list[int]]:
    """Full product of k base columns plus every combination with leading coefficient one."""
    plus, times = _field(levels)
    forms = []
    for size in range(1, k + 1):
        for where in itertools.combinations(range(k), size):
            for rest in itertools.product(range(1, levels), repeat=size - 1):
                form = [0] * k
                for pos, c in zip(where, (1, *rest)):
                    form[pos] = c
                forms.append(form)
    return [
        [functools.reduce(plus, (times(c, x) for c, x in zip(form, point))) for form in forms]
        for point in itertools.product(range(levels), repeat=k)
    ]


def _quadratic_scheme(p: int) -> list[list[int]]:
    """Difference scheme of 2p rows and columns modulo an odd prime p: any two rows differ by every value equally often.

    The classical construction from quadratic forms, with a non-square n."""
    quarter = pow(4, -1, p)
    n = min(set(range(1, p)) - {x * x % p for x in range(p)})
    over_n = pow(n, -1, p)
    top = [[(i * j + quarter * i * i) % p for j in range(p)] + [(i * j + n * quarter * i * i) % p for j in range(p)] for i in range(p)]
    low = [
        [(i * j - j * j - quarter * i * i) % p for j in range(p)] + [over_n * (i * j - j * j - quarter * i * i) % p for j in range(p)]
        for i in range(p)
    ]
    return top + low


def _circulant_scheme() -> list[list[int]]:
    return [[block[(j - i) % 3] for block in blocks for j in range(3)] for blocks in SCHEME_12 for i in range(3)]


def _kronecker(a: list[list[int]], b: list[list[int]], p: int) -> list[list[int]]:
    """Every row of a against every row of b, entries added; of two difference schemes it is one again."""
    return [[(x + y) % p for x in r for y in s] for r in a for s in b]


def _developed(scheme: list[list[int]], p: int, heads: list[list[int]]) -> list[list[int]]:
    """Each row of a difference scheme with every value added to it, behind columns ``heads`` of the row's number."""
    return [[*head, *[(x + g) % p for x in row]] for head, row in zip(heads, scheme) for g in range(p)]


def _residue_array(p: int) -> list[list[int]]:
    """Two-level array of p + 1 runs from the squares modulo p (p = 3 modulo 4)."""
    squares = {x * x % p for x in range(1, p)}
    return [[0] * p, *[[int((j - i) % p in squares or i == j) for j in range(p)] for i in range(p)]]


def _binary_counting(k: int) -> list[list[int]]:
    """Two-level array whose column number, read in binary, names the base columns it adds."""
    return [
        [sum(point[i] for i in range(k) if (column >> i) & 1) % 2 for column in range(1, 2**k)]
        for point in itertools.product((0, 1), repeat=k)
    ]


def orthogonal_array(name: str) -> tuple[list[list[int]], list[int]]:
    """Rows and the number of levels of every column of a standard array."""
    if name in ("L4", "L9", "L16", "L25", "L27", "L64", "L81"):
        levels, k = {"L4": (2, 2), "L9": (3, 2), "L16": (2, 4), "L25": (5, 2), "L27": (3, 3), "L64": (4, 3), "L81": (3, 4)}[name]
        rows = _linear(levels, k)
        return rows, [levels] * len(rows[0])
    if name == "L8":
        return _binary_counting(3), [2] * 7
    if name == "L12":
        return _residue_array(11), [2] * 11
    if name == "L18":
        return [list(r) for r in L18_ROWS], [2] + [3] * 7
    if name == "L36":
        return _developed(_circulant_scheme(), 3, _residue_array(11)), [2] * 11 + [3] * 12
    if name == "L50":
        return _developed(_quadratic_scheme(5), 5, [[r // 5, r % 5] for r in range(10)]), [2] + [5] * 11
    if name == "L54":
        scheme = _kronecker([[i * j % 3 for j in range(3)] for i in range(3)], _quadratic_scheme(3), 3)
        return _developed(scheme, 3, L18_ROWS), [2] + [3] * 25
    raise KeyError(f"unknown orthogonal array {name}")


ARRAYS = ["L4", "L8", "L9", "L12", "L16", "L18", "L25", "L27", "L36", "L50", "L54", "L64", "L81"]


def select_array(level_counts: Sequence[int]) -> str:
    """The smallest array whose columns, largest first, cover the factors, largest first."""
    need = sorted(level_counts, reverse=True)
    for name in ARRAYS:
        have = sorted(orthogonal_array(name)[1], reverse=True)
        if len(have) >= len(need) and all(h >= n for h, n in zip(have, need)):
            return name
    raise ValueError(f"no array fits {len(need)} factors with up to {need[0]} levels")


def array_design(factors: dict[str, list[str]], array: str | None = None) -> list[tuple]:
    """Long design rows (run_id, factor, level, code): each factor takes the first fitting free column."""
    rows, levels = orthogonal_array(array or select_array([len(v) for v in factors.values()]))
    free = list(range(len(levels)))
    out = []
    for factor, names in factors.items():
        column = next((c for c in free if levels[c] >= len(names)), None)
        if column is None:
            raise ValueError(f"no free column with {len(names)} levels for {factor}")
        free.remove(column)
        for run, row in enumerate(rows, 1):
            code = row[column] % len(names)
            out.append((run, factor, names[code], code))
    return out


def full_factorial(factors: dict[str, tuple[str, str]]) -> list[tuple]:
    if not factors:
        raise ValueError("at least one factor is needed")
    out = []
    for run, codes in enumerate(itertools.product((-1, 1), repeat=len(factors)), 1):
        out += [(run, f, lv[(c + 1) // 2], c) for (f, lv), c in zip(factors.items(), codes)]
    return out


def fractional_factorial(factors: dict[str, tuple[str, str]]) -> list[tuple]:
    """Half of 2^5: the fifth code is the product of the other four."""
    if len(factors) != 5:
        raise ValueError(f"exactly 5 factors are needed, got {len(factors)}")
    out = []
    for run, codes in enumerate(itertools.product((-1, 1), repeat=4), 1):
        last = codes[0] * codes[1] * codes[2] * codes[3]
        out += [(run, f, lv[(c + 1) // 2], c) for (f, lv), c in zip(factors.items(), (*codes, last))]
    return out


def design_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return literal_rows(spark, rows, "run_id, factor, level, code")


def prune(design: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """Wide design plus excluded flag and reason of the first matching rule; rows are kept."""
    reason = F.coalesce(*[F.when(cond, F.lit(why)) for cond, why in rules]) if rules else F.lit(None).cast("string")
    return design.withColumn("exclusion_reason", reason).withColumn("excluded", F.col("exclusion_reason").isNotNull())


def active_rows(design: DataFrame) -> DataFrame:
    return design.where(~F.col("excluded"))


def wide(design: DataFrame, factors: Sequence[str]) -> DataFrame:
    return design.groupBy("run_id").pivot("factor", list(factors)).agg(F.first("level"))


def factors_from_axes(variants: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """One factor per axis with its level names, and a model factor if there are several models."""
    axes = variants.groupBy("axis").agg(F.array_sort(F.collect_set("variant_name")).alias("levels")).select(
        F.concat(F.lit("axis_"), F.col("axis").cast("string")).alias("factor"), F.col("axis").cast("long").alias("axis"), "levels"
    )
    if models is not None:
        one = models.agg(F.array_sort(F.collect_set("model")).alias("levels")).where(F.size("levels") > 1)
        axes = axes.unionByName(one.select(F.lit("model").alias("factor"), F.lit(None).cast("long").alias("axis"), "levels"))
    return axes.select("factor", "axis", F.size("levels").alias("n_levels"), F.array_join("levels", ",").alias("levels"))


def balance(design: DataFrame) -> DataFrame:
    """Level crosstab counts of every factor pair; unequal counts mean the array is not orthogonal here."""
    right = design.select("run_id", F.col("factor").alias("factor_b"), F.col("level").alias("level_b"))
    return (
        design.join(right, "run_id")
        .where(F.col("factor") < F.col("factor_b"))
        .groupBy("factor", "factor_b", "level", "level_b")
        .agg(F.count(F.lit(1)).alias("runs"))
    )
