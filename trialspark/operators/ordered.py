"""Order-dependent work without funnelling one key into one task.

A plain window over ``PARTITION BY model ORDER BY time`` puts every row of a
model into a single task.  Here the rows are range-partitioned on
(keys, order), so a hot key is spread over many slices; each slice is
reduced to its totals, the totals of earlier slices become a carry, and the
remaining window runs inside one slice only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.session import frozen

SLICE = "_slice"


def range_slices(df: DataFrame, order: Sequence, parts: int | None = None) -> DataFrame:
    """Cut ``df`` along ``order`` into contiguous slices numbered in that order.

    Range bounds come from a sample, so two evaluations may cut differently;
    the result is therefore frozen before anyone reads it twice.
    """
    args = list(order)
    ranged = df.repartitionByRange(parts, *args) if parts else df.repartitionByRange(*args)
    return frozen(ranged.withColumn(SLICE, F.spark_partition_id()))


_COMBINE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    how: str = "sum",
    *,
    reverse: bool = False,
    exclusive: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """Add running ``how`` (sum, max or min) of ``values`` per key along ``order``.

    ``order`` must be unique within a key and keys must not be NULL.
    ``reverse`` runs from the end, ``exclusive`` leaves the current row out.
    """
    keys, order = list(keys), list(order)
    agg, combine = _COMBINE[how]
    tmp = {f"_v_{name}": expr for name, expr in values.items()}
    sliced = range_slices(df.withColumns(tmp), keys + order, parts)
    direction = F.desc if reverse else F.asc
    frame = (Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
    in_order = [direction(c) for c in order]
    earlier = (
        Window.partitionBy(*keys)
        .orderBy(direction(SLICE))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = (
        sliced.groupBy(*keys, SLICE)
        .agg(*[agg(c).alias(c) for c in tmp])
        .select(*keys, SLICE, *[agg(c).over(earlier).alias(f"_c{c}") for c in tmp])
    )
    inside = Window.partitionBy(*keys, SLICE).orderBy(*in_order).rowsBetween(*frame)
    out = sliced.join(carry, [*keys, SLICE]).withColumns(
        {n: combine(F.col(f"_c_v_{n}"), agg(f"_v_{n}").over(inside)) for n in values}
    )
    return out.drop(SLICE, *tmp, *[f"_c{c}" for c in tmp])


def running_totals(df, keys, order, values, **kw) -> DataFrame:
    """Inclusive running sums; see :func:`running`."""
    return running(df, keys, order, values, "sum", **kw)


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str):
    """``value`` of the preceding row in ``order``, NULL for the first."""
    packed = {name: F.struct(*order, value.alias("_was"))}
    out = running(df, keys, order, packed, "max", exclusive=True)
    return out.withColumn(name, F.col(name)["_was"])


def ordinals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "ordinal"
) -> DataFrame:
    """1-based position of every row within its key; ``order`` must be unique."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("long")})


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per key with their multiplicity ``n`` (map-side combined)."""
    return df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n")
    )


def ranked_values(df: DataFrame, keys: Sequence[str], value: str, extra=None) -> DataFrame:
    """Distinct values per key with count ``n``, cumulative ``cum`` and average rank ``rank``."""
    counts = value_counts(df, keys, value) if extra is None else extra
    cum = running_totals(counts, keys, [value], {"cum": F.col("n")})
    return cum.withColumn("rank", F.col("cum") - (F.col("n") - 1) / 2.0)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Linear-interpolated quantiles per key from value counts, never from raw lists."""
    if not keys:
        return exact_quantiles(df.withColumn("_all", F.lit(1)), ["_all"], value, probs).drop("_all")
    cum = running_totals(value_counts(df, keys, value), keys, [value], {"cum": F.col("n")})
    totals = cum.groupBy(*keys).agg(F.sum("n").alias("_total"))
    placed = cum.join(totals, list(keys))
    picks = []
    for name, p in probs.items():
        pos = F.lit(p) * (F.col("_total") - 1)
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("cum") > at) & (F.col("cum") - F.col("n") <= at)
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{tag}"))
        picks.append(F.max(pos - F.floor(pos)).alias(f"_{name}_w"))
    agg = placed.groupBy(*keys).agg(F.max("_total").alias("n"), *picks)
    return agg.select(
        *keys,
        "n",
        *[
            (
                F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * F.col(f"_{name}_w")
            ).alias(name)
            for name in probs
        ],
    )
