"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

1. *Shingles.* Five-word shingles of every whole text (lower-cased words; a text of one to four words is one
   shingle, a text without words is one shingle made of itself, null is empty). Each task packs the
   shingle hashes of a few thousand documents, sorted, into one compressed block per bucket of hashes: the only
   shuffle that holds every shingle once. A shingle that many documents of a block share is sent as a count.
2. *Document frequencies.* A bucket counts in how many documents each shingle stands and answers every block with
   the shingles that stand in two or more; the others can't be shared, so their number is all that matters.
3. *Signatures.* weight = tf x (1 + ln((N+1)/(df+1)) / ln(N+1)). A pair of similarity s needs s of either side's weight
   in shared shingles, so documents with less are done: this loses nothing. The others get ``hashes`` samples
   (r, c ~ Gamma(2,1), b ~ U(0,1), t = floor(ln w / r + b), ln a = ln c - r (t - b + 1); the smallest a wins). The smallest a
   of the shingles nobody shares is drawn from its law, an exponential with their whole weight.
4. *Bands.* Documents that agree in all ``rows`` samples of a band are candidates. Each is first verified against one end
   (smallest or largest id) of a band it is in, by weighted Jaccard similarity over all shingles. Then, in each band that still
   holds several classes, every two documents of different classes are compared: those outside the band's largest class, cut
   into blocks, meet each other and the blocks of that class, two blocks to a group. A group compares one document with all
   of a block at once over their sorted shingles; no pair is left out but those whose weights are too unequal for a
   link, those already joined by links of the same group, and those that meet in an earlier band.
5. *Classes.* Connected documents; class id = smallest id. Documents with equal word sequences are one from the start.

Result: one row per distinct (id, words) of the input, ``id, class_id, n_links``; n_links counts the verified links
of its word sequence to others. Null ids are left out, repeated rows are one, empty input gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from trialspark.llm.common import columns, map_rows
from trialspark.session import scratch_path

WORDS = 5
SIMILARITY = 0.8
HASHES, ROWS = 64, 4
BLOCK_ROWS, BLOCK_CHARS = 8192, 8_000_000
HOT = 64  # documents of a block that share a shingle before it is sent as a count
BAND_DOCS, BAND_BYTES = 256, 8_000_000  # of one block of a band
HASH_MASK = np.uint64((1 << 56) - 1)
WORD = re.compile(r"\w+")
BLOCK = "bucket int, block long, kind int, body binary"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur3's)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, the first sorted and kept as differences; bytes of equal rank stand together."""
    first = np.diff(arrays[0], prepend=arrays[0].dtype.type(0))
    parts = [np.array([len(first)], dtype="<u4").tobytes()]
    for a in (first, *arrays[1:]):
        parts.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(body: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(body)
    n, at, out = int(np.frombuffer(data[:4], "<u4")[0]), 4, []
    for k in kinds:
        size = np.dtype(k).itemsize
        a = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T
        out.append(np.ascontiguousarray(a).view(k).reshape(n))
        at += n * size
    out[0] = np.cumsum(out[0], dtype=out[0].dtype)
    return out


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8"), digest_size=8).digest(), "little")


def make_shingler(words: int = WORDS):
    """text -> (digest of its words, shingle hashes with repeats)."""
    memo: dict[str, int] = {}
    factors = [np.uint64(f | 1) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]

    def shingles(text: str) -> tuple[bytes, np.ndarray]:
        tokens = WORD.findall(text.lower())
        if not tokens:
            digest = hashlib.md5(b"\0" + text.encode("utf-8")).digest()
            return digest, mix(np.frombuffer(digest[:8], "<u8")) & HASH_MASK
        digest = hashlib.md5(" ".join(tokens).encode("utf-8")).digest()
        hashes = []
        for t in tokens:
            h = memo.get(t)
            if h is None:
                h = word_hash(t)
                if len(memo) >= 500_000:
                    memo.clear()
                memo[t] = h
            hashes.append(h)
        h = np.array(hashes, dtype=np.uint64)
        k = min(words, len(h))
        total = np.zeros(len(h) - k + 1, dtype=np.uint64)
        for i in range(k):
            total = mix(total * np.uint64(31) + h[i : i + len(total)] * factors[i % len(factors)])
        return digest, total & HASH_MASK

    return shingles


def blocks(docs: DataFrame, buckets: int, words: int) -> DataFrame:
    """Step 1. kind 0: shingles of a bucket; 1: the block's documents; 2: documents of shingles sent as counts."""

    def work():
        shingles = make_shingler(words)
        state = {"n": 0}

        def block(ids, texts):
            number = (TaskContext.get().partitionId() << 24) + state["n"]
            state["n"] += 1
            digests, hs, ds, fs, totals = [], [], [], [], []
            for i, t in enumerate(texts):
                digest, h = shingles(t or "")
                digests.append(digest)
                totals.append(len(h))
                h, tf = np.unique(h, return_counts=True)
                hs.append(h)
                ds.append(np.full(len(h), i, np.uint16))
                fs.append(tf)
            h, d, tf = np.concatenate(hs), np.concatenate(ds), np.concatenate(fs).astype(np.uint32)
            order = np.argsort(h, kind="stable")
            h, d, tf = h[order], d[order], tf[order]
            meta = pa.BufferOutputStream()
            table = pa.table({"id": ids, "digest": pa.array(digests), "total": pa.array(totals, pa.int64())})
            with pa.ipc.new_stream(meta, table.schema) as w:
                w.write_table(table)
            home = int(mix(np.array([number], dtype=np.uint64))[0] % np.uint64(buckets))  # numbers of one task must not share a bucket
            out = [(home, number, 1, zstandard.ZstdCompressor(level=1).compress(meta.getvalue().to_pybytes()))]
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            sizes = np.diff(np.append(starts, len(h)))
            hot = np.repeat(sizes > HOT, sizes)
            if hot.any():
                out.append((home, number, 2, pack(h[hot], d[hot], tf[hot])))
                first = np.zeros(len(h), bool)
                first[starts] = True
                counts = np.repeat(sizes, sizes)
                keep = ~hot | first
                d = np.where(hot, 0xFFFF, d).astype(np.uint16)
                tf = np.where(hot, counts, tf).astype(np.uint32)
                h, d, tf = h[keep], d[keep], tf[keep]
            ends = np.searchsorted(h, bounds, side="left")
            for b, (s, e) in enumerate(zip(np.append(0, ends), np.append(ends, len(h)))):
                if e > s:
                    out.append((b, number, 0, pack(h[s:e], d[s:e], tf[s:e])))
            return {name: [x[k] for x in out] for k, name in enumerate(("bucket", "block", "kind", "body"))}

        bounds = np.array([(b << 56) // buckets for b in range(1, buckets)], dtype=np.uint64)

        def step(batch: pa.RecordBatch):
            sizes = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(float)))
            at = 0
            while at < batch.num_rows:
                base = sizes[at - 1] if at else 0
                end = int(np.clip(np.searchsorted(sizes, base + BLOCK_CHARS), at + 1, at + BLOCK_ROWS))
                end = min(end, batch.num_rows)
                yield block(batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at).to_pylist())
                at = end

        return step

    return map_rows(docs, BLOCK, work)


def count_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Step 2 for one bucket: shingles of two or more documents, with their frequency, back to each block."""
    out = [(r.block, r.kind, r.body) for r in pdf[pdf.kind != 0].itertuples()]
    own = pdf[pdf.kind == 0].sort_values("block")
    if len(own):
        parts = [unpack(b, "<u8", "<u2", "<u4") for b in own.body]
        h = np.concatenate([p[0] for p in parts])
        d = np.concatenate([p[1] for p in parts])
        tf = np.concatenate([p[2] for p in parts])
        which = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        distinct, inverse = np.unique(h, return_inverse=True)
        df = np.bincount(inverse, weights=np.where(d == 0xFFFF, tf, 1), minlength=len(distinct)).astype(np.uint32)[inverse]
        keep = df >= 2
        h, d, tf, df, which = h[keep], d[keep], tf[keep], df[keep], which[keep]
        ends = np.searchsorted(which, np.arange(len(parts) + 1))
        for k, block in enumerate(own.block):
            s, e = ends[k], ends[k + 1]
            if e > s:
                out.append((block, 0, pack(h[s:e], d[s:e], tf[s:e], df[s:e])))
    return pd.DataFrame(out, columns=["block", "kind", "body"])


def idf(df: np.ndarray | float, n_docs: int):
    return 1 + np.log((n_docs + 1) / (df + 1)) / math.log(n_docs + 1)


def samples(h: np.ndarray, w: np.ndarray, starts: np.ndarray, alone: np.ndarray, seeds: np.ndarray, hashes: int) -> np.ndarray:
    """Step 3: one row of ``hashes`` samples per document; entries of a document stand together from ``starts``."""
    out = np.zeros((len(starts), hashes), dtype=np.uint64)
    log_w = np.log(w)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(h))))
    unit = 1.0 / (1 << 53)
    with np.errstate(divide="ignore"):
        for k in range(hashes):
            x = mix(h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            y = mix(x + np.uint64(0x632BE59BD9B4E019))
            # two 32-bit uniforms from each word for the gammas, one more word for b
            low = np.uint64(0xFFFFFFFF)
            u = [((v + 0.5) / 4294967296.0) for v in ((x & low).astype(float), (x >> np.uint64(32)).astype(float), (y & low).astype(float), (y >> np.uint64(32)).astype(float))]
            r, log_c = -np.log(u[0] * u[1]), np.log(-np.log(u[2] * u[3]))
            b = (mix(y) >> np.uint64(11)).astype(float) * unit
            t = np.floor(log_w / r + b)
            log_a = log_c - r * (t - b + 1)
            least = np.minimum.reduceat(log_a, starts)
            at = np.flatnonzero(log_a == least[owner])
            first = at[np.unique(owner[at], return_index=True)[1]]
            out[:, k] = mix(h[first] ^ mix(t[first].astype(np.int64).view(np.uint64)))
            z = mix(seeds + np.uint64(k + 1))
            rest = np.log(-np.log(((z >> np.uint64(11)).astype(float) + 0.5) * unit)) - np.log(alone)
            out[:, k] = np.where(rest < least, z, out[:, k])
    return out


def make_signer(n_docs: int, hashes: int, rows: int, similarity: float):
    """Steps 3 and 4 for one block: its documents, with bands and packed shingles where they can have a partner."""

    def sign(pdf: pd.DataFrame) -> pd.DataFrame:
        meta = pdf[pdf.kind == 1].body.iloc[0]
        table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(meta)).read_all().to_pandas()
        out = pd.DataFrame({"id": table.id, "digest": table.digest, "total": 0.0, "bands": None, "shingles": None, "block": pdf.block.iloc[0]})
        parts = [unpack(b, "<u8", "<u2", "<u4", "<u4") for b in pdf[pdf.kind == 0].body]
        if not parts:
            return out
        h, d, tf, df = (np.concatenate([p[k] for p in parts]) for k in range(4))
        counts = d == 0xFFFF
        if counts.any():
            known, found = h[counts], df[counts]
            order = np.argsort(known)
            known, found = known[order], found[order]
            hot = [unpack(b, "<u8", "<u2", "<u4") for b in pdf[pdf.kind == 2].body]
            hh, hd, hf = (np.concatenate([p[k] for p in hot]) for k in range(3))
            h, d, tf, df = (
                np.concatenate((a[~counts], b)) for a, b in ((h, hh), (d, hd), (tf, hf), (df, found[np.searchsorted(known, hh)]))
            )
        w = tf * idf(df, n_docs)
        one = float(idf(1.0, n_docs))
        n = len(table)
        shared = np.bincount(d, weights=w, minlength=n)
        alone = (table.total.to_numpy() - np.bincount(d, weights=tf, minlength=n)) * one
        live = shared >= (similarity - 1e-9) * (shared + alone)
        keep = live[d]
        h, d, w = h[keep], d[keep], w[keep]
        if not len(h):
            return out
        order = np.lexsort((h, d))
        h, d, w = h[order], d[order], w[order]
        who, starts = np.unique(d, return_index=True)
        digests = np.frombuffer(b"".join(table.digest.iloc[who]), "<u8").reshape(-1, 2)[:, 0].copy()
        sig = samples(h, w, starts, alone[who], digests, hashes)
        bands = np.zeros((len(who), hashes // rows), dtype=np.uint64)
        for b in range(bands.shape[1]):
            key = np.full(len(who), b + 1, dtype=np.uint64)
            for k in range(rows):
                key = mix(key * np.uint64(31) + sig[:, b * rows + k])
            bands[:, b] = key
        ends = np.append(starts[1:], len(h))
        total = shared + alone
        w32 = w.astype(np.float32)
        bodies = [pack(h[s:e], w32[s:e]) for s, e in zip(starts, ends)]
        at = {int(i): k for k, i in enumerate(who)}
        out["total"] = total
        out["bands"] = [bands[at[i]].view(np.int64).tolist() if i in at else None for i in range(n)]
        out["shingles"] = [bodies[at[i]] if i in at else None for i in range(n)]
        return out

    return sign


def weighted_jaccard(a: bytes, b: bytes, total_a: float, total_b: float) -> float:
    ha, wa = unpack(a, "<u8", "<f4")
    hb, wb = unpack(b, "<u8", "<f4")
    _, i, j = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    both = float(np.minimum(wa[i], wb[j]).sum(dtype=float))
    return both / max(1e-12, total_a + total_b - both)


def verify(pairs: DataFrame, signed: DataFrame, similarity: float) -> DataFrame:
    """``a, b`` of the pairs whose weighted Jaccard similarity is high enough. A member's shingles travel to its leader."""
    side = signed.select("doc", "total", "shingles")
    one = side.select(F.col("doc").alias("b"), F.col("total").alias("total_b"), F.col("shingles").alias("shingles_b"))
    two = side.select(F.col("doc").alias("a"), F.col("total").alias("total_a"), F.col("shingles").alias("shingles_a"))
    joined = pairs.join(one, "b").join(two, "a").select("a", "b", "total_a", "total_b", "shingles_a", "shingles_b")

    def work():
        def step(batch: pa.RecordBatch):
            a, b, ta, tb, sa, sb = (c.to_pylist() for c in batch.columns)
            hit = [weighted_jaccard(x, y, p, q) >= similarity - 1e-6 for x, y, p, q in zip(sa, sb, ta, tb)]
            yield {"a": [x for x, k in zip(a, hit) if k], "b": [x for x, k in zip(b, hit) if k]}

        return step

    return map_rows(joined, f"a {signed.schema['doc'].dataType.simpleString()}, b {signed.schema['doc'].dataType.simpleString()}", work)


def links_between(i: int, j: int, group: dict[str, list], similarity: float) -> list[tuple]:
    """``a, b`` of documents of block i and block j of a band that are similar enough and whose classes were not joined yet."""
    block, n = np.array(group["at"]), len(group["at"])
    total, pos = np.array(group["total"]), group["pos"][0]
    earlier = np.array([b[:pos] for b in group["bands"]], dtype=np.int64).reshape(n, pos)
    codes: dict = {}
    cls = np.array([codes.setdefault(c, len(codes)) for c in group["comp"]])
    root = np.arange(len(codes))
    right, order, out, parts = block == j, np.arange(n), [], None
    for x in np.flatnonzero(block == i):
        ask = right & (root[cls] != root[cls[x]]) & (np.minimum(total, total[x]) >= (similarity - 1e-6) * np.maximum(total, total[x]))
        if i == j:
            ask &= order > x
        if pos and ask.any():
            ask &= ~(earlier == earlier[x]).any(axis=1)
        if not ask.any():
            continue
        if parts is None:
            parts = [unpack(b, "<u8", "<f4") for b in group["shingles"]]
            theirs = np.flatnonzero(right)
            h, w = (np.concatenate([parts[k][c] for k in theirs]) for c in (0, 1))
            owner = np.repeat(theirs, [len(parts[k][0]) for k in theirs])
            by = np.argsort(h, kind="stable")
            h, w, owner = h[by], w[by], owner[by]
        mine, weight = parts[x]
        start = np.searchsorted(h, mine, side="left")
        runs = np.searchsorted(h, mine, side="right") - start
        at = np.repeat(start - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
        both = np.bincount(owner[at], weights=np.minimum(w[at], np.repeat(weight, runs)), minlength=n)
        for y in np.flatnonzero(ask & (both >= (similarity - 1e-6) * np.maximum(1e-12, total + total[x] - both))):
            one, two = root[cls[x]], root[cls[y]]
            if one != two:
                root[root == two] = one
                out.append((min(group["doc"][x], group["doc"][y]), max(group["doc"][x], group["doc"][y])))
    return out


def compare_classes(banded: DataFrame, comp: DataFrame, live: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: links between the classes ``comp`` (node, comp) in every band that holds more than one of them."""
    label = banded.join(comp.select(F.col("node").alias("doc"), "comp"), "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    held = label.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    mixed = held.groupBy("key").agg(
        F.max(F.struct("n", "comp", "size")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("bytes"), F.count("*").alias("classes")
    ).filter("classes > 1")
    cut = lambda n, size: F.greatest(F.ceil(n / BAND_DOCS), F.ceil(size / BAND_BYTES), F.lit(1)).cast("int")
    mixed = mixed.select("key", F.col("main.comp").alias("main"), cut(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.size")).alias("others"), cut(F.col("main.n"), F.col("main.size")).alias("mains"))
    spot = F.xxhash64("doc")
    in_main = F.col("comp") == F.col("main")
    placed = label.join(mixed, "key").select(
        "key", "pos", "doc", "comp",
        F.when(in_main, F.col("others") + F.pmod(spot, F.col("mains"))).otherwise(F.pmod(spot, F.col("others"))).cast("int").alias("at"),
        F.when(in_main, F.col("others")).otherwise(F.col("others") + F.col("mains")).alias("meets"),
    )
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("meets") - 1))).select(
        "key", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "pos", "doc", "comp"
    )
    groups = sent.join(live, "doc").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    names = ["at", "pos", "doc", "comp", "total", "bands", "shingles"]
    schema = StructType([StructField(x, live.schema["doc"].dataType) for x in ("a", "b")])

    def run(batches):
        arrow = to_arrow_schema(schema)

        def links(table: pa.Table):
            i, j = table["i"][0].as_py(), table["j"][0].as_py()
            return links_between(i, j, {x: table[x].to_pylist() for x in names}, similarity)

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], type=arrow.field(k).type) for k in (0, 1)], schema=arrow)

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            place = np.stack([table[x].to_numpy() for x in ("key", "i", "j")])
            starts = np.flatnonzero(np.concatenate(([True], (place[:, 1:] != place[:, :-1]).any(axis=0)))).tolist() if len(table) else [0]
            yield batch_of([f for s, e in zip(starts, starts[1:]) for f in links(table.slice(s, e - s))])
            rest = table.slice(starts[-1])  # its group may go on in the next batch
        if rest is not None and len(rest):
            yield batch_of(links(rest))

    return groups.select("key", "i", "j", *names).mapInArrow(run, schema)


def components(edges: DataFrame, save) -> DataFrame:
    """``node, comp`` (the smallest node): smallest label over the neighbours and then over the label's own label,
    until nothing changes. Edges touching a busy node are pre-aggregated; only a count comes to the driver."""
    both = save(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct())
    labels = save(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "comp"), "y").groupBy(F.col("x").alias("node")).agg(F.min("comp").alias("near"))
        hop = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = labels.join(near, "node", "left").join(hop, "comp", "left").select(
            "node", F.least("comp", F.coalesce("near", "comp"), F.coalesce("up", "comp")).alias("next"), "comp"
        )
        new = save(new)
        moved = new.filter(F.col("next") != F.col("comp")).limit(1).count()
        labels = new.select("node", F.col("next").alias("comp"))
        if not moved:
            return labels


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, hashes: int = HASHES, rows: int = ROWS) -> DataFrame:
    """One row per distinct (id, words): ``id, class_id, n_links``; see the module's text."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "near-dedup")
    state = {"n": 0}

    def save(df: DataFrame) -> DataFrame:
        state["n"] += 1
        path = f"{folder}/{state['n']}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    slim = columns(docs, id=id_col, text=text_col).filter(F.col("id").isNotNull())
    kind = slim.schema["id"].dataType.simpleString()
    n_docs = slim.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, 2 * slim.rdd.getNumPartitions())
    answered = blocks(slim, buckets, words).groupBy("bucket").applyInPandas(count_bucket, "block long, kind int, body binary")
    schema = f"id {kind}, digest binary, total double, bands array<long>, shingles binary, block long"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    try:
        spark.conf.set(cleanup, "true")  # the shingle shuffle goes as soon as the signatures are written
        signed_rows = save(answered.groupBy("block").applyInPandas(make_signer(max(n_docs, 2), hashes, rows, similarity), schema).drop("block"))
    finally:
        spark.conf.set(cleanup, before) if before is not None else spark.conf.unset(cleanup)
    # equal word sequences are one document from here on
    texts = signed_rows.groupBy("digest").agg(F.min("id").alias("doc"))
    live = save(signed_rows.filter(F.col("bands").isNotNull()).groupBy("digest").agg(F.min(F.struct("id", "total", "bands", "shingles")).alias("x")).select(F.col("x.id").alias("doc"), "x.total", "x.bands", "x.shingles"))
    banded = save(live.select("doc", F.length("shingles").alias("size"), F.posexplode("bands").alias("pos", "key")))
    ends = banded.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n")).filter("n > 1")
    met = banded.join(ends, "key")
    near = met.select(F.col("low").alias("a"), F.col("doc").alias("b")).filter("a < b").union(met.select(F.col("doc").alias("a"), F.col("high").alias("b")).filter("a < b"))
    pairs = save(near.groupBy("a", "b").agg(F.count("*").alias("n")))
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a") if kind in ("bigint", "int") else "a")).alias("a")).select("a", "b")
    links = save(verify(best, live, similarity))
    links = save(links.union(compare_classes(banded, components(links, save), live, similarity)))
    comp = components(links, save)
    degree = links.select(F.col("a").alias("doc")).union(links.select(F.col("b").alias("doc"))).groupBy("doc").agg(F.count("*").alias("n_links"))
    reps = texts.join(comp.select(F.col("node").alias("doc"), "comp"), "doc", "left").join(degree, "doc", "left").select(
        "digest", F.coalesce("comp", "doc").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    members = signed_rows.select("digest", "id").distinct()
    return members.join(reps, "digest").select(F.col("id").alias(id_col), "class_id", "n_links")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose id is its class's smallest.

    Rows with one id are one document: they stay if one of their texts does. Rows without an id go by their text
    and stand behind all others: a null row stays only if no document with an id is like it, and its repeats stay with it.
    """
    text_key = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    if isinstance(docs.schema[id_col].dataType, StringType):
        stand_in = F.concat(F.lit("\U0010ffff"), text_key)
    else:
        stand_in = F.lit(1 << 62) + F.pmod(F.xxhash64(text_key), F.lit(1 << 61))
    keyed = docs.withColumn("_doc", F.coalesce(F.col(f"`{id_col}`"), stand_in))
    classes = near_duplicate_classes(keyed, "_doc", text_col, **how)
    gone = classes.groupBy("_doc").agg(F.min(F.when(F.col("_doc") == F.col("class_id"), 0).otherwise(1)).alias("gone")).filter("gone = 1").select("_doc")
    return keyed.join(gone, "_doc", "left_anti").drop("_doc")
