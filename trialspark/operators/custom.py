"""Registry of user metrics: named functions from a column lookup to a score column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS: dict[str, Callable[[Callable[[str], Column]], Column]] = {}


def register_metric(name: str, fn: Callable[[Callable[[str], Column]], Column]) -> None:
    """``fn`` gets a column lookup and returns a Column; an Arrow UDF is welcome."""
    METRICS[name] = fn


def compute_metrics(responses: DataFrame, names: Sequence[str]) -> DataFrame:
    return responses.withColumns({n: METRICS[n](F.col) for n in names})
