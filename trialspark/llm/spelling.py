"""Spelling variants: frequent words grouped by single edits (dense prefix-suffix tiling).

1. *Words.* Runs of letters (``[A-Za-z\\u00C0-\\u00FF]+``) of whole texts, A-Z lower-cased. A share of 1/199 of the distinct
   (document, run) pairs, chosen by crc32 of ``<doc_id>:<run>``, loses the code point at place crc32 mod length. Words of at least
   ``MIN_LENGTH`` code points with at least ``MIN_COUNT`` occurrences stay; occurrences are added up in the map tasks first.
2. *Tiles.* Two words are near if one code point is inserted, deleted or replaced. With M the longer length, their common
   prefix and suffix together reach M - 1, so one of the two has at least ceil((M - 1) / 2) code points. Each word is sent
   to the groups of its equal-length and its one-longer and one-shorter partners that share such a prefix, and the same for suffixes: six
   rows a word. A group of more than ``tile`` words is cut into blocks and every two blocks meet in a group of their own.
3. *Dense comparison.* The words of two blocks stand in padded code-point matrices; column by column from the left and from the
   right the common prefix and suffix lengths of all pairs grow, and a pair counts if they sum to M - 1 at least. A pair with both halves long
   enough is counted in its prefix group only. A group gives one row per word: how many near words, and the best one.
4. *Forms.* form = near word of largest n (ties: smallest in code-point order) if that n is at least ``RATIO`` times the
   word's own n. root: forms followed to the last, by pointer doubling.

Null texts have no words; a null id counts as the empty string in the crc; repeated rows count twice; an empty table gives
no rows. Null, empty and very long texts and runs need nothing special: a run of any length is one word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trialspark.llm.common import columns
from trialspark.session import scratch_path

RUN = r"[A-Za-zÀ-ÿ]+"
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
DROP = 199
TILE = 2048  # words of a block
CELLS = 4_000_000  # pairs compared at once
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NEAR = "word string, n_near long, form_n long, form string"


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop: int = DROP) -> DataFrame:
    """``word, n`` of the frequent words, after the deletions."""
    rows = columns(docs, id=id_col, text=text_col)
    runs = rows.select(
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"),
    ).filter(F.length("run") >= min_length)
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    n = F.length("run")
    at = F.pmod(F.col("h"), n).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, n))
    word = F.when(F.pmod(F.col("h"), F.lit(drop)) == 0, cut).otherwise(F.col("run"))
    words = runs.withColumn("h", h).select(word.alias("word")).filter(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def memberships(words: DataFrame) -> DataFrame:
    """``short, gap, side, affix, longer, word, n``: the groups a word takes part in."""
    n = F.length("word")

    def member(short: Column, gap: int, side: str, longer: bool) -> Column:
        half = F.ceil((short + (gap - 1)) / 2).cast("int")  # ceil((M - 1) / 2)
        affix = F.substring(F.col("word"), F.lit(1), half) if side == "prefix" else F.substring(F.col("word"), n - half + 1, half)
        return F.struct(short.cast("int").alias("short"), F.lit(gap).alias("gap"), F.lit(side).alias("side"), affix.alias("affix"), F.lit(longer).alias("longer"))

    kinds = [member(n, 0, s, False) for s in ("prefix", "suffix")]
    kinds += [member(n - 1 if longer else n, 1, s, longer) for s in ("prefix", "suffix") for longer in (False, True)]
    return words.select("word", "n", F.explode(F.array(*kinds)).alias("g")).select("g.*", "word", "n")


def tiles(members: DataFrame, tile: int) -> DataFrame:
    """Rows of ``members`` with their block ``at`` and the pair of blocks ``i <= j`` that meet; groups without a pair are gone."""
    key = ["short", "gap", "side", "affix"]
    held = members.groupBy(*key).agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("longer").cast("int")).alias("longs"))
    held = held.filter(F.when(F.col("gap") == 0, F.col("size") > 1).otherwise((F.col("longs") > 0) & (F.col("longs") < F.col("size"))))
    held = held.select(*key, F.ceil(F.col("size") / tile).cast("int").alias("blocks"))
    placed = members.join(held, key).withColumn("at", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select(*key, "longer", "word", "n", "at", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"))


def code_points(words: list[str], width: int, right: bool) -> np.ndarray:
    """Padded code-point matrix, from the left or (reversed) from the right."""
    out = np.zeros((len(words), width), dtype=np.uint32)
    for k, w in enumerate(words):
        points = np.frombuffer(w.encode("utf-32-le"), dtype="<u4")
        out[k, : len(points)] = points[::-1] if right else points
    return out


def common_lengths(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Leading equal columns of every pair of rows, at most ``width``."""
    alive = np.ones((len(a), len(b)), dtype=bool)
    length = np.zeros(alive.shape, dtype=np.uint16)
    for c in range(width):
        alive &= a[:, c][:, None] == b[:, c]
        if not alive.any():
            break
        length += alive
    return length


def near_pairs(left: list[str], right: list[str], short: int, gap: int, side: str):
    """Indices (into left, into right) of near pairs that this side's group has to count; block pair by block pair."""
    half, width = -(-(short + gap - 1) // 2), short + gap
    forward = [code_points(x, width, False) for x in (left, right)]
    backward = [code_points(x, width, True) for x in (left, right)]
    step = max(1, CELLS // max(1, len(right)))
    for s in range(0, len(left), step):
        pre = common_lengths(forward[0][s : s + step], forward[1], short)
        suf = common_lengths(backward[0][s : s + step], backward[1], short)
        hit = (pre + suf >= width - 1) & (pre < width)  # equal words are no pair
        hit &= pre >= half if side == "prefix" else (pre < half) & (suf >= half)
        x, y = np.nonzero(hit)
        yield x + s, y


def compare_tile(group: dict, names: list[str], counts: list[int], longer: list[bool], at: list[int]) -> dict[str, list]:
    """One row per word of the tile that has a near word: how many, and the largest (n, then smallest word)."""
    block, is_long = np.array(at), np.array(longer)
    if group["gap"] == 0:
        sides = [(block == group["i"], block == group["j"])]
    else:
        sides = [((block == group["i"]) & ~is_long, (block == group["j"]) & is_long)]
        if group["i"] != group["j"]:
            sides.append(((block == group["j"]) & ~is_long, (block == group["i"]) & is_long))
    n = np.array(counts, dtype=np.int64)
    rank = np.empty(len(names), dtype=np.int64)  # 0: the best form of all
    rank[sorted(range(len(names)), key=lambda k: (-counts[k], names[k]))] = np.arange(len(names))
    near, best = np.zeros(len(names), dtype=np.int64), np.full(len(names), len(names), dtype=np.int64)
    for one, two in sides:
        one, two = np.flatnonzero(one), np.flatnonzero(two)
        if not len(one) or not len(two):
            continue
        for x, y in near_pairs([names[k] for k in one], [names[k] for k in two], group["short"], group["gap"], group["side"]):
            a, b = one[x], two[y]
            np.add.at(near, a, 1)
            np.minimum.at(best, a, rank[b])
            if group["gap"] or group["i"] != group["j"]:  # inside one block of equal lengths both orders come up by themselves
                np.add.at(near, b, 1)
                np.minimum.at(best, b, rank[a])
    by_rank = np.argsort(rank)
    found = np.flatnonzero(near)
    form = by_rank[best[found]]
    return {"word": [names[k] for k in found], "n_near": near[found].tolist(), "form_n": n[form].tolist(), "form": [names[k] for k in form]}


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """``word, n_near, form_n, form``: the number of near words and the largest of them, for words that have any."""
    key = ["short", "gap", "side", "affix", "i", "j"]
    groups = tiles(memberships(words), tile).repartition(*key).sortWithinPartitions(*key)
    schema = StructType.fromDDL(NEAR)

    def run(batches):
        arrow = to_arrow_schema(schema)

        def compared(table: pa.Table) -> dict[str, list]:
            group = {k: table[k][0].as_py() for k in key}
            return compare_tile(group, *(table[c].to_pylist() for c in ("word", "n", "longer", "at")))

        def batch_of(parts: list[dict[str, list]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v for p in parts for v in p[f.name]], type=f.type) for f in arrow], schema=arrow)

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            if not len(table):
                continue
            changed = np.zeros(len(table) - 1, dtype=bool)
            for c in key:
                values = table[c].to_numpy()
                changed |= values[1:] != values[:-1]
            starts = [0, *(np.flatnonzero(changed) + 1).tolist()]
            yield batch_of([compared(table.slice(s, e - s)) for s, e in zip(starts, starts[1:])])
            rest = table.slice(starts[-1])  # its group may go on in the next batch
        if rest is not None and len(rest):
            yield batch_of([compared(rest)])

    found = groups.select(*key, "longer", "word", "n", "at").mapInArrow(run, schema)
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("form_n"), F.col("b.form").alias("form"))


def roots(forms: DataFrame, save) -> DataFrame:
    """``word, root`` for words with a form: pointers are doubled until none moves, so rounds grow with the log of a chain."""
    at = save(forms.select("word", F.col("form").alias("root")))
    while True:
        hop = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = save(at.join(hop, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = new.select("word", "root")
        if not new.filter("moved").limit(1).count():
            return at


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, tile: int = TILE, **how) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every frequent word; see the module's text."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "spelling")
    state = {"n": 0}

    def save(df: DataFrame) -> DataFrame:
        state["n"] += 1
        path = f"{folder}/{state['n']}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    words = save(count_words(docs, id_col, text_col, **how))
    found = words.join(near_words(words, tile), "word", "left")
    takes = F.col("form_n") >= ratio * F.col("n")
    formed = save(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("form")).alias("form"), F.when(takes, F.col("form_n")).alias("form_n")))
    ends = roots(formed.filter(F.col("form").isNotNull()), save)
    return formed.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
