"""SimHash near-duplicates by vantage-point trees.

1. *Fingerprints.* A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, every four-word shingle with repeats (fewer words: the
   whole sequence), XXH64 with seed 42; bit k is 1 if it is set in more than half of the hashes. No words, empty or null: 0.
2. *Nodes.* Equal fingerprints are one node with the smallest id of its documents. Everything up to step 5 works on nodes.
3. *Trees.* Two fingerprints that differ in at most ``radius`` = 4 bits differ in at most 1 bit of one of three disjoint parts of 22, 21
   and 21 bits. Each part has a vantage-point tree of its own over Hamming distances within the part: a node has a vantage
   point v and a median t, points with d(v, x) <= t are inside. By the triangle inequality a query with reach r has to enter the inside only if
   d(v, q) - r <= t and the outside only if d(v, q) + r > t. The top of each tree is fitted on a bounded sample (``sample`` smallest
   hashes), which decides how even the shards are and nothing else.
4. *Shards.* A fingerprint lives in one leaf of a tree, its shard, and is sent as a query to the shards with smaller numbers whose
   boundary it overlaps; so both ends of every link meet in a shard. A shard of more than ``shard_rows`` fingerprints is cut into
   blocks and every block of residents meets every block of the others. In a task a deeper tree over the residents takes all queries at once
   through the same bounds; what is left in a leaf is compared over all 64 bits. Pairs whose ends are joined already are not kept: a task
   gives a spanning forest of its links, never more rows than it read.
5. *Components* of these links; component_id is the smallest id of all documents of a component.

Result: one row per row of the input: ``id, fingerprint`` (16 hex digits) and ``component_id``. Repeated rows come back
repeated. A row with a null id takes part like any other but can't name a component; component_id is null if all ids are.
Texts of any length are handled whole; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trialspark.llm.common import columns, map_rows
from trialspark.llm.near_dedup import components
from trialspark.session import scratch_path

WORDS = 4
SEED = 42
RADIUS = 4
PARTS = (22, 21, 21)  # bits; one part of each pair within the radius differs in at most RADIUS // len(PARTS) bits
SAMPLE = 16_384
SHARD_ROWS = 32_768
LEAF = 48
CELLS = 1 << 20  # pairs compared at once
SENT = "tree int, shard int, lives boolean, fp long"


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    tokens = text.lower().split()  # bytes: A-Z only, and exactly the six white-space bytes
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(tokens)
    k = min(words, len(tokens))
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.fromiter((digest(joined[s:e], SEED) for s, e in spans), dtype=np.uint64, count=len(tokens) - k + 1)


def simhash(hashes: np.ndarray) -> int:
    """Bit k is set if more than half of the hashes have it."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``id, fp`` of the columns id and text; fp is the unsigned fingerprint's bits as a long."""
    kind = docs.schema["id"].dataType.simpleString()

    def work():
        def step(batch: pa.RecordBatch):
            texts = batch.column(1).to_pylist()
            prints = [simhash(shingle_hashes(t, words)) if t else 0 for t in texts]
            yield {"id": batch.column(0), "fp": np.array(prints, dtype=np.uint64).view(np.int64)}

        return step

    return map_rows(docs.select("id", F.col("text").cast("binary").alias("text")), f"id {kind}, fp long", work)


def distance(a: np.ndarray, b, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((a ^ b) & mask).astype(np.int16)


def split(points: np.ndarray, mask: np.uint64) -> tuple[np.uint64, int] | None:
    """A vantage point and a threshold that leave points on both sides, the evenest of a few; None if all are equal."""
    best = None
    for k in range(4):
        v = points[(len(points) * (2 * k + 1)) // 8]
        d = distance(points, v, mask)
        if d.max() == d.min():
            continue
        t = int(np.partition(d, (len(d) - 1) // 2)[(len(d) - 1) // 2])
        t = min(t, int(d.max()) - 1)
        off = abs(2 * int((d <= t).sum()) - len(d))
        if best is None or off < best[0]:
            best = (off, v, t)
    return best and best[1:]


def fit_tree(points: np.ndarray, mask: np.uint64, leaves: int):
    """The top of a tree: (vantage, threshold, inside, outside) down to shards (numbers from 0, left to right)."""
    number = iter(range(1 << 30))

    def grow(points, leaves):
        cut = split(points, mask) if leaves > 1 and len(points) > 1 else None
        if cut is None:
            return next(number)
        v, t = cut
        near = distance(points, v, mask) <= t
        return v, t, grow(points[near], leaves // 2), grow(points[~near], leaves - leaves // 2)

    return grow(points, leaves)


def routes(tree, points: np.ndarray, mask: np.uint64, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, indices of the points that live there or overlap it, which of them live there)."""

    def walk(node, at, lives):
        if not len(at):
            return
        if isinstance(node, int):
            yield node, at, lives
            return
        v, t, inside, outside = node
        d = distance(points[at], v, mask)
        near, far = d - reach <= t, d + reach > t
        yield from walk(inside, at[near], (lives & (d <= t))[near])
        yield from walk(outside, at[far], (lives & (d > t))[far])

    yield from walk(tree, np.arange(len(points)), np.ones(len(points), dtype=bool))


class Forest:
    """Union-find over places 0..n-1 with vectorised look-ups; the root of a tree is its smallest place."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            a, b = self.parent[x], self.parent[y]
            apart = a != b
            if not apart.any():
                return
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.parent[self.parent]
                if (up == self.parent).all():
                    break
                self.parent = up


def link(residents: np.ndarray, queries: np.ndarray, fps: np.ndarray, mask: np.uint64, reach: int, radius: int, forest: Forest) -> None:
    """Join every query (a place in fps) with the residents within ``radius`` bits, down a vantage-point tree of the residents."""

    def compare(res, qry):
        step = max(1, CELLS // len(res))
        for s in range(0, len(qry), step):
            q = qry[s : s + step]
            x, y = np.nonzero(np.bitwise_count(fps[q][:, None] ^ fps[res]) <= radius)
            forest.add(q[x], res[y])

    def walk(res, qry):
        if not len(res) or not len(qry):
            return
        cut = split(fps[res], mask) if len(res) > LEAF else None
        if cut is None:
            compare(res, qry)
            return
        v, t = cut
        d, e = distance(fps[res], v, mask), distance(fps[qry], v, mask)
        walk(res[d <= t], qry[e - reach <= t])
        walk(res[d > t], qry[e + reach > t])

    walk(residents, queries)


def shard_links(pdf_fp: np.ndarray, lives: np.ndarray, mask: np.uint64, reach: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): a spanning forest of the links between residents and everything else in a shard."""
    fps, place = np.unique(pdf_fp, return_inverse=True)
    residents = np.unique(place[lives])
    forest = Forest(len(fps))
    if len(residents):
        link(residents, np.arange(len(fps)), fps, mask, reach, radius, forest)
    moved = np.flatnonzero(forest.parent != np.arange(len(fps)))
    return fps[forest.parent[moved]], fps[moved]


def masks(parts: tuple[int, ...]) -> list[np.uint64]:
    out, at = [], 0
    for bits in parts:
        out.append(np.uint64(((1 << bits) - 1) << at))
        at += bits
    return out


def sent_to_shards(nodes: DataFrame, trees: list, parts: tuple[int, ...], reach: int) -> DataFrame:
    """``tree, shard, lives, fp``: each node once where it lives and once in every earlier shard it overlaps."""

    def work():
        kinds = masks(parts)

        def step(batch: pa.RecordBatch):
            fps = batch.column(0).to_numpy().view(np.uint64)
            for number, (tree, mask) in enumerate(zip(trees, kinds)):
                found = list(routes(tree, fps, mask, reach))
                home = np.zeros(len(fps), dtype=np.int32)
                for shard, at, lives in found:
                    home[at[lives]] = shard
                at = np.concatenate([a[home[a] >= s] for s, a, _ in found] or [np.empty(0, dtype=np.int64)])
                shards = np.concatenate([np.full(int((home[a] >= s).sum()), s, dtype=np.int32) for s, a, _ in found] or [np.empty(0, dtype=np.int32)])
                for s in range(0, len(at), 65_536):
                    a, b = at[s : s + 65_536], shards[s : s + 65_536]
                    yield {"tree": np.full(len(a), number, dtype=np.int32), "shard": b, "lives": home[a] == b, "fp": fps[a].view(np.int64)}

        return step

    return map_rows(nodes.select("fp"), SENT, work)


def links(nodes: DataFrame, n: int, radius: int = RADIUS, parts: tuple[int, ...] = PARTS, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``a, b``: links between fingerprints whose components are those of all links; step 3 and 4 of the module's text."""
    spark = nodes.sparkSession
    reach = radius // len(parts)
    drawn = np.array([r.fp for r in nodes.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()], dtype=np.int64).view(np.uint64)
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    leaves = min(max(spread, -(-n // shard_rows)), max(1, sample // 8))
    trees = [fit_tree(drawn, mask, leaves) for mask in masks(parts)]
    sent = sent_to_shards(nodes, trees, parts, reach)
    sizes = sent.groupBy("tree", "shard").agg(F.sum(F.col("lives").cast("int")).alias("r"), F.count(F.lit(1)).alias("q")).filter("q > 1 AND r > 0")
    sizes = sizes.select("tree", "shard", F.ceil(F.col("r") / shard_rows).cast("int").alias("rows"), F.ceil(F.col("q") / (32 * shard_rows)).cast("int").alias("others"))
    place = lambda c: F.pmod(F.xxhash64("fp"), F.col(c)).cast("int")
    # a row meets, as a resident, every block of queries, and as a query every block of residents
    at = F.array_distinct(F.concat(
        F.when(F.col("lives"), F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda o: F.struct(place("rows").alias("i"), o.alias("j")))).otherwise(F.array()),
        F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: F.struct(r.alias("i"), place("others").alias("j"))),
    ))
    met = sent.join(sizes, ["tree", "shard"]).select("tree", "shard", "fp", (F.col("lives")).alias("lives"), place("rows").alias("own"), F.explode(at).alias("at"))
    groups = met.select("tree", "shard", "at.i", "at.j", (F.col("lives") & (F.col("own") == F.col("at.i"))).alias("lives"), "fp")
    key = ["tree", "shard", "i", "j"]
    groups = groups.repartition(*key).sortWithinPartitions(*key)
    schema = StructType.fromDDL("a long, b long")

    def run(batches):
        arrow, kinds = to_arrow_schema(schema), masks(parts)

        def found(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            fps = table["fp"].to_numpy().view(np.uint64)
            return shard_links(fps, table["lives"].to_numpy(), kinds[table["tree"][0].as_py()], reach, radius)

        def batch_of(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            both = [np.concatenate([p[k] for p in pairs] or [np.empty(0, dtype=np.uint64)]).view(np.int64) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in both], schema=arrow)

        held: list[pa.RecordBatch] = []  # of a group that goes on
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in key])
            starts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            done = []
            for s, e in zip(starts, starts[1:]):
                if held and any(held[-1].column(c)[0].as_py() != batch.column(c)[s].as_py() for c in key):
                    done.append(found(pa.Table.from_batches(held)))
                    held = []
                held.append(batch.slice(s, e - s))
            yield batch_of(done)
        if held:
            yield batch_of([found(pa.Table.from_batches(held))])

    return groups.mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = WORDS, **how) -> DataFrame:
    """``id, fingerprint, component_id`` for every row; see the module's text."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "simhash")
    state = {"n": 0}

    def save(df: DataFrame) -> DataFrame:
        state["n"] += 1
        path = f"{folder}/{state['n']}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    prints = save(fingerprints(columns(docs, id=id_col, text=text_col), words))
    nodes = save(prints.groupBy("fp").agg(F.min("id").alias("first")))
    found = save(links(nodes, nodes.count(), radius, **how).distinct())
    comp = components(found, save).select(F.col("node").alias("fp"), "comp")
    placed = save(nodes.join(comp, "fp", "left").select("fp", "first", F.coalesce("comp", "fp").alias("comp")))
    least = placed.groupBy("comp").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "comp").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
