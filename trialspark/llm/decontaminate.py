"""Benchmark passages in documents by greedy string tiling.

1. *Seeds.* All runs of ``min_match`` words (lower-cased) of the benchmark items; an item with fewer words is one seed.
   Documents are scanned whole; only those that share a seed with an item go on, as (document, item) pairs.
2. *Tiles.* For a pair, running Karp-Rabin hashes find the common runs of unmarked words; the longest are marked first, the
   length goes down to ``min_match``, and no word is marked twice. Order does not matter, so reordered passages count.
3. *Coverage.* Marked words of the item over its words; a pair at ``threshold`` or more is reported.

The benchmark is sent to the tasks in blocks of at most ``block_words`` words, so what is sent is bounded whatever its
size, one block after the other; documents are scanned once per block. Null and empty texts match nothing; equal items are reported each; repeated
documents give their rows each; null ids stay null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import columns, map_rows
from trialspark.session import scratch_path

MIN_MATCH = 5
THRESHOLD = 0.5
BLOCK_WORDS = 2_000_000
WORD = re.compile(r"\w+")
PRIME, BASE = (1 << 61) - 1, 911382323


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def common_runs(a: list[int], b: list[int], marked_a: bytearray, marked_b: bytearray, size: int) -> list[tuple[int, int, int]]:
    """(length, start in a, start in b) of the maximal common unmarked runs of ``size`` words or more."""

    def rolling(x, marked):
        lead = pow(BASE, size - 1, PRIME)
        h = run = 0
        for i, v in enumerate(x):
            if marked[i] or v < 0:
                h = run = 0
                continue
            if run >= size:
                h -= (x[i - size] + 1) * lead
            h = (h * BASE + v + 1) % PRIME
            run += 1
            if run >= size:
                yield i - size + 1, h

    table: dict[int, list[int]] = {}
    for j, h in rolling(b, marked_b):
        table.setdefault(h, []).append(j)
    out, reach = [], {}
    for i, h in rolling(a, marked_a):
        for j in table.get(h, ()):
            if reach.get(i - j, -1) > i:  # inside a run of this diagonal that is known already
                continue
            if a[i : i + size] != b[j : j + size]:
                continue
            n = size
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] >= 0 and not marked_a[i + n] and not marked_b[j + n]:
                n += 1
            reach[i - j] = i + n - size + 1
            out.append((n, i, j))
    return out


def tile(a: list[int], b: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: non-overlapping (length, start in a, start in b), longest first. Negative words match nothing."""
    marked_a, marked_b = bytearray(len(a)), bytearray(len(b))
    tiles, size = [], max(min_match, min(20, len(a), len(b)))
    while True:
        found = sorted(common_runs(a, b, marked_a, marked_b, size), key=lambda x: (-x[0], x[1], x[2]))
        if found and found[0][0] > 2 * size:
            size = found[0][0]
            continue
        for n, i, j in found:
            if not any(marked_a[i : i + n]) and not any(marked_b[j : j + n]):
                marked_a[i : i + n] = marked_b[j : j + n] = b"\1" * n
                tiles.append((n, i, j))
            # a run that lost a part to a longer one comes back at the next length
        if size == min_match:
            if not any(any(marked_a[i : i + n]) != all(marked_a[i : i + n]) for n, i, j in found):
                return tiles
            left = common_runs(a, b, marked_a, marked_b, size)
            if not left:
                return tiles
            continue
        size = max(min_match, size // 2)


class Benchmark:
    """Words, seeds and items of one block of the benchmark."""

    def __init__(self, rows: list, min_match: int):
        self.ids = [r["item_id"] for r in rows]
        self.vocabulary: dict[str, int] = {}
        self.items = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(r["text"])] for r in rows]
        self.min_match = min_match
        self.seeds: dict[int, dict[int, list[int]]] = {}  # length -> hash -> items
        for k, item in enumerate(self.items):
            size = min(min_match, len(item))
            if size:
                for h in set(self.hashes(np.array(item, dtype=np.int64), size).tolist()):
                    self.seeds.setdefault(size, {}).setdefault(h, []).append(k)
        self.keys = {size: np.array(sorted(s), dtype=np.int64) for size, s in self.seeds.items()}

    @staticmethod
    def hashes(x: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the windows of ``size`` words; windows with an unknown word are -1."""
        n = max(0, len(x) - size + 1)
        h, bad = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        with np.errstate(over="ignore"):
            for i in range(size):
                part = x[i : i + n]
                h = h * np.int64(6364136223846793005) + part + np.int64(1442695040888963407)
                bad |= part < 0
        h &= np.int64(0x7FFFFFFFFFFFFFFF)
        h[bad] = -1
        return h

    def candidates(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """item -> (start, size) of the document's windows that are seeds of the item."""
        out: dict[int, list[tuple[int, int]]] = {}
        for size, keys in self.keys.items():
            h = self.hashes(ids, size)
            at = np.searchsorted(keys, h)
            at[at == len(keys)] = 0
            for i in np.flatnonzero(keys[at] == h).tolist():
                for k in self.seeds[size][int(h[i])]:
                    out.setdefault(k, []).append((i, size))
        return out

    def coverage(self, ids: np.ndarray, item: int, hits: list[tuple[int, int]]) -> tuple[int, int]:
        """Marked words and number of tiles. Only words inside seed windows can be in a tile, so the others are left out."""
        a: list[int] = []
        end = -1
        for start, size in hits:
            if start > end >= 0:
                a.append(-1)
            a += ids[max(start, end) : start + size].tolist()
            end = max(end, start + size)
        tiles = tile(a, self.items[item], min(self.min_match, len(self.items[item])))
        return sum(n for n, _, _ in tiles), len(tiles)


def block_count(benchmark: DataFrame, block_words: int) -> int:
    total = benchmark.agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first()["n"] or 0
    return max(1, -(-int(total) // block_words))


def benchmark_blocks(benchmark: DataFrame, n: int) -> Iterator[list]:
    """The items in ``n`` lists of about equal size, each read by hash when it is asked for."""
    for b in range(n):
        block = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else benchmark
        yield sorted((r.asDict() for r in block.collect()), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"] or ""))


def in_seeds(hits: list[tuple[int, int]]) -> int:
    """Words of the document inside its seed windows (sorted): no tiling marks more."""
    n, end = 0, 0
    for start, size in hits:
        n += max(0, start + size - max(start, end))
        end = max(end, start + size)
    return n


def found_in(known: Benchmark, texts: list[str | None], threshold: float):
    """``place, item, matched words, tiles, coverage`` of the texts' items at ``threshold`` or more."""
    get = known.vocabulary.get
    ids = [np.array([get(w, -1) for w in words_of(t)] + [-1], dtype=np.int64) for t in texts]
    ends = np.cumsum([len(x) for x in ids])
    merged = np.concatenate(ids)
    # one look at all texts; those with no seed are done
    touched = set()
    for size, keys in known.keys.items():
        h = known.hashes(merged, size)
        if len(h):
            pos = np.searchsorted(keys, h)
            pos[pos == len(keys)] = 0
            touched |= set(np.searchsorted(ends, np.flatnonzero(keys[pos] == h), side="right").tolist())
    for i in sorted(touched):
        for k, hits in sorted(known.candidates(ids[i]).items()):
            least = threshold * len(known.items[k])
            if in_seeds(sorted(hits)) < least:
                continue
            words, tiles = known.coverage(ids[i], k, sorted(hits))
            if words / len(known.items[k]) >= threshold:
                yield i, k, words, tiles, words / len(known.items[k])


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``id, item_id, matched_words, tiles, coverage`` of the pairs at ``threshold`` or more. No shuffle.

    With more than one block, each block's pairs are written before the next block is read, so driver and tasks hold one."""
    spark = docs.sparkSession
    slim = columns(docs, **{id_col: id_col, "text": text_col})
    items = columns(benchmark, item_id=item_col, text=item_text_col)
    schema = f"`{id_col}` {slim.schema[0].dataType.simpleString()}, item_id {items.schema[0].dataType.simpleString()}, matched_words int, tiles int, coverage double"

    def scan(shared) -> DataFrame:
        def work():
            known = Benchmark(shared.value, min_match)

            def step(batch: pa.RecordBatch):
                out: dict = {id_col: [], "item_id": [], "matched_words": [], "tiles": [], "coverage": []}
                for at in range(0, batch.num_rows, 256):
                    for i, k, words, tiles, share in found_in(known, batch.column(1).slice(at, 256).to_pylist(), threshold):
                        row = (batch.column(0)[at + i].as_py(), known.ids[k], words, tiles, share)
                        for values, value in zip(out.values(), row):
                            values.append(value)
                yield out

            return step

        return map_rows(slim, schema, work)

    total = block_count(items, block_words)
    folder = scratch_path(spark, "benchmark-pairs") if total > 1 else None
    for rows in benchmark_blocks(items, total):
        shared = spark.sparkContext.broadcast(rows)
        if folder is None:
            return scan(shared)
        scan(shared).write.mode("append").parquet(folder)
        shared.unpersist()
    return spark.read.schema(schema).parquet(folder)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that cover no item; each row is judged by its own text, so null and repeated ids play no part.

    With more than one block, what a block leaves is written before the next block is read."""
    spark = docs.sparkSession
    items = columns(benchmark, item_id=item_col, text=item_text_col)
    place = docs.columns.index(text_col)

    def clean(docs: DataFrame, shared) -> DataFrame:
        def run(batches):
            known = Benchmark(shared.value, min_match)
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for at in range(0, batch.num_rows, 256):
                    for i, *_ in found_in(known, batch.column(place).slice(at, 256).to_pylist(), threshold):
                        keep[at + i] = False
                yield batch.filter(pa.array(keep))

        return docs.mapInArrow(run, docs.schema)

    total = block_count(items, block_words)
    for k, rows in enumerate(benchmark_blocks(items, total)):
        shared = spark.sparkContext.broadcast(rows)
        docs = clean(docs, shared)
        if k + 1 < total:
            path = scratch_path(spark, "benchmark-clean")
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
            shared.unpersist()
    return docs
