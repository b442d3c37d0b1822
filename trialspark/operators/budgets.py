"""Many token budgets answered from one order of documents.

A budget takes the documents of its corpus in order, each one that still fits. What it takes are a few stretches of
neighbours, so a budget jumps: as far as everything fits (prefix sums), then to the next document that is small enough (a table of
least sizes over powers of two). The order is cut into blocks of ``block`` documents. A *walk* is a row (corpus, budget, what
is left of it, the block it stands at). In every round the walks first jump over the blocks by their sums and least sizes to a block
that fits only in part, and then through the documents of that block. After such a block what is left is less than each document
passed over, so few blocks are entered per walk, whatever the length of the order. Documents without a token fit every budget; they
are left out of the walks and added to each budget in the end.

Walks of one corpus, or of one block, are dealt over several tasks if there are more than ``walks`` of them; the
sizes of one block go to each of those. No corpus, and no list of walks of one corpus, is gathered in a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.operators.ordered import running_totals
from trialspark.session import frozen

BLOCK = 65_536
WALKS = 65_536
STATE = "source string, target_tokens long, room long, block long, first long, last long"


def least_table(sizes: np.ndarray) -> list[np.ndarray]:
    """Row k holds the least of the 2^k sizes from each place on (as far as there are any)."""
    rows = [sizes]
    while (1 << len(rows)) <= len(sizes):
        half, step = rows[-1], 1 << (len(rows) - 1)
        rows.append(np.minimum(half[: len(half) - step], half[step:]))
    return rows


def next_small(table: list[np.ndarray], at: np.ndarray, room: np.ndarray) -> np.ndarray:
    """First place from ``at`` on whose size is at most ``room``; the number of places if there is none."""
    n = len(table[0])
    at = at.copy()
    for k in reversed(range(len(table))):  # pass over 2^k places that are all too large
        row = table[k]
        while True:
            ahead = at + (1 << k) <= n
            skip = ahead & (row[np.where(ahead, at, 0)] > room)
            if not skip.any():
                break
            at = np.where(skip, at + (1 << k), at)
    return at


def walk(sums: np.ndarray, least: np.ndarray, at: np.ndarray, room: np.ndarray):
    """All walks at once over entries with a sum and a least size: stretches taken whole, and where a walk stops.

    Yields (walks, first, last) of stretches; returns places and rooms. A walk stops at an entry that fits in part only
    (its least size fits, its sum does not) or behind the last entry; single documents have equal sum and least size and never do."""
    n = len(sums)
    upto = np.concatenate(([0], np.cumsum(sums)))
    table = least_table(least)
    stretches = []
    at, room = at.copy(), room.copy()
    live = np.flatnonzero(at < n)
    while len(live):
        to = np.searchsorted(upto, upto[at[live]] + room[live], side="right") - 1
        moved = to > at[live]
        stretches.append((live[moved], at[live][moved], to[moved]))
        room[live] -= upto[to] - upto[at[live]]
        at[live] = next_small(table, to, room[live])
        live = live[at[live] < n]
        live = live[sums[at[live]] <= room[live]]
    return at, room, stretches


def _rows(walks: pd.DataFrame, sums, least, base: int, unit: int, end: int) -> pd.DataFrame:
    """Walks over one list of entries: their new state, and a row per stretch (first, last in documents)."""
    at = walks["block"].to_numpy() if unit > 1 else np.zeros(len(walks), dtype=np.int64)
    at, room, stretches = walk(sums, least, at, walks["room"].to_numpy())
    block = at if unit > 1 else walks["block"].to_numpy() + 1
    out = [pd.DataFrame({"target_tokens": walks["target_tokens"].to_numpy(), "room": room, "block": block, "first": -1, "last": -1})]
    for who, first, last in stretches:
        out.append(pd.DataFrame({"target_tokens": walks["target_tokens"].to_numpy()[who], "room": 0, "block": -1, "first": base + first * unit, "last": np.minimum(base + last * unit, end)}))
    done = pd.concat(out)
    done.insert(0, "source", walks["source"].iloc[0])
    return done


def budget_stretches(placed: DataFrame, budgets: DataFrame, block: int = BLOCK, walks: int = WALKS) -> DataFrame:
    """``source, target_tokens, first, last``: the stretches [first, last) of places that each distinct budget takes.

    ``placed``: source, place (from 0), tokens (1 or more). A budget of nothing takes nothing."""
    spark = placed.sparkSession
    cut = placed.withColumn("block", F.floor(F.col("place") / block))
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("place", "tokens"))), lambda x: x["tokens"])  # at most ``block`` numbers
    blocks = frozen(cut.groupBy("source", "block").agg(sizes.alias("sizes"), F.sum("tokens").alias("sum"), F.min("tokens").alias("least")))
    summary = frozen(blocks.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("block", "sum", "least"))).alias("entries"), F.sum(F.size("sizes")).alias("n_docs")))  # one entry per ``block`` documents
    live = frozen(
        budgets.where("target_tokens > 0").select("source", "target_tokens").distinct().join(summary.select("source"), "source", "left_semi")
        .select("source", "target_tokens", F.col("target_tokens").alias("room"), F.lit(0).cast("long").alias("block"), F.lit(-1).cast("long").alias("first"), F.lit(-1).cast("long").alias("last"))
    )
    found = []

    def shared(walking: DataFrame, side: DataFrame, keys: list[str]):
        """Both sides with a share: walks by hash, the other side once per share."""
        shares = walking.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / walks).cast("int").alias("shares"))
        left = walking.join(shares, keys).withColumn("share", F.pmod(F.xxhash64("target_tokens"), F.col("shares")).cast("int")).drop("shares")
        right = side.join(shares, keys).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
        return left.groupBy(*keys, "share"), right.groupBy(*keys, "share")

    def over_blocks(walking: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        entries = side["entries"].iloc[0]
        sums, least = (np.array([e[k] for e in entries], dtype=np.int64) for k in ("sum", "least"))
        return _rows(walking, sums, least, 0, block, int(side["n_docs"].iloc[0]))

    def over_documents(walking: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        tokens = np.asarray(side["sizes"].iloc[0], dtype=np.int64)
        start = int(side["block"].iloc[0]) * block
        return _rows(walking, tokens, tokens, start, 1, start + len(tokens))

    ends = summary.select("source", F.size("entries").alias("n_blocks"))
    while not live.isEmpty():
        left, right = shared(live, summary, ["source"])
        jumped = frozen(left.cogroup(right).applyInPandas(over_blocks, STATE))
        inside = jumped.where("first < 0").join(ends, "source").where("block < n_blocks").select("source", "target_tokens", "room", "block", "first", "last")
        left, right = shared(inside, blocks.select("source", "block", "sizes"), ["source", "block"])
        read = frozen(left.cogroup(right).applyInPandas(over_documents, STATE))
        found += [jumped.where("first >= 0"), read.where("first >= 0")]
        live = frozen(read.where("first < 0").join(ends, "source").where("block < n_blocks AND room >= 0").select("source", "target_tokens", "room", "block", "first", "last"))
    out = found[0] if found else spark.createDataFrame([], STATE)
    for more in found[1:]:
        out = out.union(more)
    return out.select("source", "target_tokens", "first", "last")


def budget_documents(docs: DataFrame, budgets: DataFrame, order: list[str], block: int = BLOCK, walks: int = WALKS) -> DataFrame:
    """``source, target_tokens, place, rel_path, tokens`` for every document that a distinct budget takes; place is in the whole order.

    ``order`` must tell the documents of a corpus apart; a null number of tokens counts as 0."""
    sized = docs.select("source", "rel_path", F.coalesce("token_count", F.lit(0)).cast("long").alias("tokens"), *[c for c in order if c != "rel_path"])
    one, filled = F.lit(1).cast("long"), (F.col("tokens") > 0).cast("long")
    placed = running_totals(sized, ["source"], order, {"n": one, "rank": filled})
    placed = frozen(placed.select("source", "rel_path", "tokens", (F.col("n") - 1).alias("position"), (F.col("rank") - 1).alias("place")))
    filled_docs = placed.where("tokens > 0")
    runs = budget_stretches(filled_docs, budgets, block, walks)
    # a long stretch is cut into blocks first, so no array of places is longer than one
    parts = runs.withColumn("b", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("last") - 1) / block))))
    inside = F.sequence(F.greatest("first", F.col("b") * block), F.least("last", (F.col("b") + 1) * block) - 1)
    places = parts.select("source", "target_tokens", F.explode(inside).alias("place"))
    taken = places.join(filled_docs, ["source", "place"])
    free = placed.where("tokens = 0").join(budgets.where("target_tokens > 0").select("source", "target_tokens").distinct(), "source")
    names = ["source", "target_tokens", F.col("position").alias("place"), "rel_path", "tokens"]
    return taken.select(*names).union(free.select(*names))
