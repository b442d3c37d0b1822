"""Named queries with the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialspark.plans.base_sql import BASE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Round doubles to six places and widen ints, so engines compare equal."""
    cols = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType | T.FloatType):
            c = (F.round(c.cast("double"), 6) + F.lit(0.0)).alias(field.name)
        elif isinstance(field.dataType, T.IntegerType | T.ShortType):
            c = c.cast("long").alias(field.name)
        cols.append(c)
    return df.select(*cols)


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` together with its checking SQL."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir))

        run.__name__ = name
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = complete_sql(oracle)
        return fn

    return wrap


def _expand_rounding(sql: str) -> str:
    """``R(x)`` in a checking query means ``round(x, 6)`` without negative zero."""
    out, i = [], 0
    for m in re.finditer(r"\bR\(", sql):
        if m.start() < i:
            continue
        depth, j = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        out.append(sql[i : m.start()] + f"(round(({sql[m.end() : j - 1]})::DOUBLE, 6) + 0.0)")
        i = j
    return "".join(out) + sql[i:]


def complete_sql(body: str) -> str:
    """Prepend the shared view definitions that ``body`` mentions."""
    body = _expand_rounding(body.strip().rstrip(";"))
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, definition in BASE.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(definition)
                if name not in needed:
                    needed.append(name)

    visit(body)
    own = ""
    recursive = ""
    m = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    if m:
        recursive = "RECURSIVE " if m.group(1) else ""
        own, body = body[m.end() :], ""
    heads = [f"{n} AS ({BASE[n].strip()})" for n in needed]
    if own:
        return f"WITH {recursive}" + ",\n".join([*heads, own])
    return ("WITH " + ",\n".join(heads) + "\n" if heads else "") + body
