"""Corpus jobs: scanning, drift, incremental transforms, cross-references, relevant documents."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from trialspark.functions import markdown as md
from trialspark.operators.monitor import top_per_group
from trialspark.session import frozen

# Documentation file types and directories never scanned.
EXTENSIONS = [".md", ".mdx", ".rst", ".txt"]
IGNORED = ["node_modules", "__pycache__", ".git", ".venv"]


# ---- scanning ------------------------------------------------------------
def doc_scan(spark: SparkSession, root: str, extensions=EXTENSIONS, ignore=IGNORED) -> DataFrame:
    """Files under ``root`` as documents; files that are not UTF-8 are left out."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:(//)?", ""), "^" + base.replace(".", r"\.") + "/", "")
    kept = files.withColumn("rel_path", rel).where(
        md.extension(F.col("rel_path")).isin(extensions) & ~md.ignored(F.col("rel_path"), ignore)
    )
    return kept.where(F.is_valid_utf8(F.col("content").cast("string"))).select(
        "rel_path",
        F.col("content").cast("string").alias("content"),
        F.col("length").alias("size_bytes"),
        F.sha2(F.col("content"), 256).alias("content_hash"),
        F.col("modificationTime").alias("last_modified"),
        F.lit("").alias("tier"),
        F.lit("").alias("section"),
    )


def dir_index(paths: DataFrame, strip_prefix: str = "") -> DataFrame:
    """Distinct (dir, name) of visible directories, any number of sources already unioned.

    One row per file: a directory with very many files stays spread out, and
    :func:`dir_listing` folds names in order only where a text is wanted.
    """
    visible = paths.where(~F.exists(F.split(md.parent(F.col("rel_path")), "/"), lambda p: p.startswith(".")))
    d = md.parent(F.col("rel_path"))
    if strip_prefix:
        prefix = strip_prefix.rstrip("/")
        d = F.when(d.startswith(prefix), F.regexp_replace(F.substring(d, len(prefix) + 1, 1 << 30), "^/+", "")).otherwise(d)
    return visible.select(d.alias("dir"), F.substring_index("rel_path", "/", -1).alias("name")).distinct()


def listing_stats(index: DataFrame) -> DataFrame:
    """Files per extension, with directory and file totals and the size of the joined listing."""
    per_ext = index.groupBy(md.extension(F.col("name")).alias("ext")).agg(F.count(F.lit(1)).alias("files"))
    # dir:{a,b} joined by '|': names and their commas, plus dir, colon and braces, plus bars
    per_dir = index.groupBy("dir").agg(F.sum(F.octet_length("name") + 1).alias("n"))
    totals = per_dir.agg(
        F.count(F.lit(1)).alias("directories"), (F.sum(F.col("n") - 1 + F.octet_length("dir") + 3) + F.count(F.lit(1)) - 1).alias("bytes")
    ).select(F.struct("*").alias("t")).scalar()
    return per_ext.withColumn("_t", totals).select(
        "ext", "files", F.col("_t.directories").alias("directories"), F.col("_t.bytes").alias("listing_bytes")
    )


# ---- drift and transforms ------------------------------------------------
def index_drift(indexed: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """missing (indexed only), extra (present only), stale (hashes differ); no rows means valid."""
    a = indexed.select(*keys, F.lit(True).alias("_a"), F.col("content_hash").alias("_ha"))
    b = present.select(*keys, F.lit(True).alias("_b"), F.col("content_hash").alias("_hb"))
    stale = (F.coalesce("_ha", F.lit("")) != "") & (F.coalesce("_hb", F.lit("")) != "") & (F.col("_ha") != F.col("_hb"))
    drift = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(stale, "stale")
    return a.join(b, list(keys), "full_outer").select(*keys, drift.alias("drift")).where(F.col("drift").isNotNull())


def changed_docs(docs: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Documents whose source hash is not in the stored state."""
    return docs.join(state.select(*keys, "content_hash"), [*keys, "content_hash"], "left_anti")


def unchanged_docs(docs: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    return docs.join(state.select(*keys, "content_hash"), [*keys, "content_hash"], "left_semi")


def _note(kind: str) -> Callable[[Column], Column]:
    return lambda c: F.concat(F.lit(f"<!-- LLM {kind} would be applied here (model: default) -->\n"), c)


STEPS: dict[str, Callable[[Column], Column]] = {
    "passthrough": lambda c: c,
    "algorithmic": md.compress_markdown,
    "llm/compressed": _note("compression"),
    "llm/restructured": _note("restructuring"),
    "llm/tagged": _note("tagging"),
}


def register_step(name: str, fn: Callable[[Column], Column]) -> None:
    """Add a named text transform for :func:`transform_docs`."""
    STEPS[name] = fn


def transform_docs(docs: DataFrame, steps: Sequence[str], state: DataFrame | None, keys: Sequence[str]):
    """Ordered steps over changed documents; returns (documents, new state of source hashes)."""
    changed = docs if state is None else changed_docs(docs, state, keys)
    out = F.col("content")
    for s in steps:
        out = STEPS[s](out)
    done = changed.withColumn("_new", out).select(
        *keys, F.col("_new").alias("content"), F.sha2("_new", 256).alias("content_hash"),
        F.octet_length("_new").cast("long").alias("size_bytes"), F.lit("+".join(steps)).alias("strategy"),
    )
    fresh = changed.select(*keys, "content_hash")
    if state is None:
        return done, fresh
    same = unchanged_docs(docs, state, keys).select(
        *keys, "content", "content_hash", F.octet_length("content").cast("long").alias("size_bytes"), F.lit("unchanged").alias("strategy")
    )
    kept = state.select(*keys, "content_hash").join(fresh, list(keys), "left_anti")
    return done.unionByName(same), kept.unionByName(fresh)


# ---- cross-references ----------------------------------------------------
GRAM = 5  # characters of a run
SPAN = 5  # runs of a window; a window is GRAM + SPAN - 1 characters long
TABLE_BITS = (1 << 22, 1 << 28)  # least and most bits of the table of wanted runs
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(ODD[0])
    return x ^ (x >> np.uint64(29))


def _runs(points: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` code points, different for every n."""
    m = max(0, len(points) - n + 1)
    out = np.full(m, n, dtype=np.uint64)
    for k in range(n):
        out += points[k : k + m] * np.uint64(ODD[k])
    return _mixed(out)


def _window_runs(points: np.ndarray) -> np.ndarray:
    """The least hash of each window of ``SPAN`` runs of ``GRAM`` code points."""
    runs = _runs(points, GRAM)
    m = len(runs) - SPAN + 1
    if m <= 0:
        return runs[:0]
    least = runs[:m].copy()
    for k in range(1, SPAN):
        np.minimum(least, runs[k : k + m], out=least)
    return _mixed(least + np.uint64(1))  # apart from the runs themselves


def _keys_of(points: np.ndarray, kinds: set[int]) -> np.ndarray:
    """Keys of a text for stems of the given kinds: their length below GRAM, GRAM for runs, 0 for windows."""
    parts = [_window_runs(points) if k == 0 else _runs(points, k) for k in sorted(kinds)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, dtype=np.uint64)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def _stem_kind(n: int) -> int:
    return 0 if n >= GRAM + SPAN - 1 else min(n, GRAM)


def _keyed(df: DataFrame, text: str, keep: list[str], keys_of: Callable[[str], np.ndarray], accept=None) -> DataFrame:
    """``keep`` and ``_key``: one row per key of each text, in parts of bounded size."""
    schema = StructType([*[df.schema[c] for c in keep], StructField("_key", LongType())])

    def run(batches):
        arrow = to_arrow_schema(schema)
        test = accept() if accept else None
        for batch in batches:
            texts, kept = batch.column(batch.schema.get_field_index(text)), [batch.column(batch.schema.get_field_index(c)) for c in keep]
            at, held, size = [], [], 0
            for k in range(batch.num_rows + 1):
                if size >= 1 << 16 or (k == batch.num_rows and held):
                    who = pa.array(np.repeat(at, [len(h) for h in held]))
                    yield pa.RecordBatch.from_arrays([*[c.take(who).cast(f.type) for c, f in zip(kept, arrow)], pa.array(np.concatenate(held).view(np.int64))], schema=arrow)
                    at, held, size = [], [], 0
                if k < batch.num_rows:
                    keys = keys_of(texts[k].as_py() or "")
                    keys = keys[test(keys)] if test else keys
                    if len(keys):
                        at.append(k)
                        held.append(keys)
                        size += len(keys)

    return df.select(*keep, *[c for c in (text,) if c not in keep]).mapInArrow(run, schema)


def _rarest_key(stems: DataFrame) -> DataFrame:
    """Adds ``_key``: of the keys that a text with the stem is sure to have, the one that the fewest stems have."""
    each = _keyed(stems, "_low", ["source", "stem", "stem_path"], lambda t: _keys_of(p := _code_points(t), {_stem_kind(len(p))}))
    shared = each.groupBy("source", "_key").agg(F.count(F.lit(1)).alias("_n"))
    best = each.join(shared, ["source", "_key"]).groupBy("source", "stem", "stem_path").agg(F.min_by("_key", F.struct("_n", "_key")).alias("_key"))
    return best


def _wanted_table(stems: DataFrame) -> tuple[np.ndarray, int]:
    """Bits of the keys that some stem has, eight for each key at least (between TABLE_BITS), and how far keys are shifted for their place.

    The words of the table come to the driver: at most 32 MB, half a megabyte below half a million keys."""
    wanted = stems.select("_key").distinct()
    bits = TABLE_BITS[0]
    n = wanted.count()
    while bits < min(8 * n, TABLE_BITS[1]):
        bits *= 2
    shift = 64 - bits.bit_length() + 1
    place = F.shiftrightunsigned("_key", shift)
    words = wanted.groupBy(F.shiftrightunsigned(place, 6).alias("id")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_key, {shift}) & 63 as int))")).alias("w"))
    table = np.zeros(bits // 64, dtype=np.uint64)
    for r in words.toLocalIterator():
        table[r["id"]] = np.array(r["w"], dtype=np.int64).view(np.uint64)
    return table, shift


FIRST = 4  # characters of a stem that are looked at together
LONGEST = 32  # longer stems are found by keys and a search
STEP = np.uint64(0x9E3779B97F4A7C15)
_SPELLED = "(?U)^(?:\\w|\\w\\W|\\W\\w)\\z"  # a boundary between two characters, or of one at an end of the text


def _starts(points: np.ndarray, seed: int, n: int) -> np.ndarray:
    """A hash of ``n`` characters from every place."""
    m = max(0, len(points) - n + 1)
    out = np.full(m, np.int64(seed)).view(np.uint64)
    for k in range(n):
        out = out * STEP + points[k : k + m]
    return out


def _prefix_keys(stems: Sequence[str], seeds: Sequence[int], first: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all beginnings of ``stems`` of ``first`` characters or more, and whether each is that of a whole stem."""
    sums, ends = [], []
    for stem, seed in zip(stems, seeds):
        h = seed
        for n, c in enumerate(stem, 1):
            h = (h * int(STEP) + ord(c)) % (1 << 64)
            if n >= first:
                sums.append(h)
                ends.append(n == len(stem))
    return _mixed(np.array(sums, dtype=np.uint64)), np.array(ends, dtype=bool)


def _places(points: np.ndarray, seed: int, first: int, begins, ends):
    """(places, length) at which the key of a stem stands: beginnings grow by one character and go on where some stem does."""
    at, h, n = np.arange(max(0, len(points) - first + 1)), _starts(points, seed, first), first
    while len(at) and n <= LONGEST:
        key = _mixed(h)
        on = begins(key)
        at, h, key = at[on], h[on], key[on]
        hit = at[ends(key)]
        if len(hit):
            yield hit, n
        more = at + n < len(points)
        at, h = at[more], h[more]
        h = h * STEP + points[at + n]
        n += 1


def _tester(table: np.ndarray, shift: int) -> Callable[[np.ndarray], np.ndarray]:
    def test(keys: np.ndarray) -> np.ndarray:
        at = keys >> np.uint64(shift)
        return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1

    return test


def _letters(points: np.ndarray) -> np.ndarray:
    return (points >= 97) & (points <= 122)


def _spelled(text: str, seed: int, first: int, begins, ends, whole_word: bool) -> set[tuple[str, str, str]]:
    """Different (stem, character before, character after) of a text; no characters unless whole words are wanted."""
    points, out = _code_points(text), set()
    plain = np.concatenate([[False], _letters(points), [False]])  # at place + 1
    for at, n in _places(points, seed, first, begins, ends):
        if whole_word:  # between two letters there is no boundary
            at = at[~(plain[at] & plain[at + 1]) & ~(plain[at + n] & plain[at + n + 1])]
            out.update((text[i : i + n], text[max(i - 1, 0) : i], text[i + n : i + n + 1]) for i in at.tolist())
        else:
            out.update((text[i : i + n], "", "") for i in at.tolist())
    return out


def _short_mentions(text: DataFrame, stems: DataFrame, first: int, whole_word: bool) -> DataFrame:
    """Stems of at most LONGEST characters: one pass over a text, whose work does not grow with the number of stems it holds.

    Two bit tables hold the keys of all stems and of their beginnings, each within its corpus. The strings found meet the
    stems by equality, so neither a key nor a bit decides.
    """

    def keyed(batches):
        for batch in batches:
            keys, ends = _prefix_keys(*[c.to_pylist() for c in batch.columns], first)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ends)], ["_key", "_end"])

    keys = frozen(stems.select("_low", F.xxhash64("source").alias("_seed")).mapInArrow(keyed, "_key long, _end boolean").distinct())
    sc = stems.sparkSession.sparkContext
    begins, ends = sc.broadcast(_wanted_table(keys)), sc.broadcast(_wanted_table(keys.where("_end")))

    def run(batches):
        tests = [_tester(*b.value) for b in (begins, ends)]
        for batch in batches:
            rows: list[tuple] = []
            for k, (source, path, low, seed) in enumerate(zip(*[c.to_pylist() for c in batch.columns])):
                rows += [(source, path, *x) for x in _spelled(low or "", seed, first, *tests, whole_word)]
                if rows and (len(rows) >= 1 << 16 or k == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names)

    names = ["source", "rel_path", "_low", "_before", "_after"]
    found = text.select("source", "rel_path", "_low", F.xxhash64("source").alias("_seed")).mapInArrow(run, ", ".join(f"{n} string" for n in names))
    if whole_word:
        edge = lambda *c: F.regexp_like(F.concat(*c), F.lit(_SPELLED))
        found = found.where(edge(F.col("_before"), F.left("_low", F.lit(1))) & edge(F.right("_low", F.lit(1)), F.col("_after")))
        found = found.select("source", "rel_path", "_low").distinct()  # a few spellings of one stem in one text
    return found.join(stems, ["source", "_low"]).select("source", "rel_path", "stem", "stem_path")


def mentions(docs: DataFrame, whole_word: bool) -> DataFrame:
    """(source, stem, stem_path, rel_path): documents of the same corpus whose text holds the stem.

    Stems of up to LONGEST characters are read off the texts in one pass; longer ones are found by keys and a search.
    ``stem_path`` is the last path where several share a stem; a document may
    mention its own stem, so callers drop the pairs they do not want.
    """
    stems = docs.groupBy("source", F.col("stem")).agg(F.max("rel_path").alias("stem_path")).where(F.col("stem") != "")
    stems = frozen(stems.withColumn("_low", F.lower("stem")))
    text = docs.select("source", "rel_path", F.lower("content").alias("_low"))
    short = F.length("_low") <= LONGEST
    least, some_long = stems.agg(F.min(F.when(short, F.length("_low"))), F.coalesce(F.bool_or(~short), F.lit(False))).first()
    found = _short_mentions(text, stems.where(short), min(least or FIRST, FIRST), whole_word)
    return found.unionByName(_long_mentions(text, stems.where(~short), whole_word)) if some_long else found


def _long_mentions(text: DataFrame, stems: DataFrame, whole_word: bool) -> DataFrame:
    """Not a join of documents with stems: text and stem meet at a key that a text with the stem is sure to have, and only then the
    stem is looked for. A long stem (a window of characters or more) is known by the least run of one of its windows; a text has the
    least runs of its windows, about a third of its runs. Of the keys of a stem the one that the fewest stems have is taken. A bit
    table that grows with the number of keys wanted drops the others before they travel.
    """
    stems = frozen(_rarest_key(stems))
    table = text.sparkSession.sparkContext.broadcast(_wanted_table(stems))
    keys = _keyed(text, "_low", ["source", "rel_path"], lambda t: _keys_of(_code_points(t), {0}), lambda: _tester(*table.value))
    candidates = keys.join(stems, ["source", "_key"]).select("source", "rel_path", "stem", "stem_path")
    # the text meets its candidates at its own key and is tested there, never copied per candidate
    holds = F.contains(F.col("_low"), F.lower("stem"))
    if whole_word:
        holds = holds & F.regexp_like("_low", F.concat(F.lit(r"(?U)\b\Q"), F.lower("stem"), F.lit(r"\E\b")))
    tested = candidates.join(text, ["source", "rel_path"]).where(holds)
    return tested.select("source", "rel_path", "stem", "stem_path")


def section_peers(docs: DataFrame, n: int) -> DataFrame:
    """Per document the first ``n`` other paths of its section, as an array."""
    paths = docs.select("source", "section", "rel_path")
    top = top_per_group(paths, ["source", "section"], ["rel_path"], n + 1)
    heads = top.groupBy("source", "section").agg(F.array_sort(F.collect_list("rel_path")).alias("_h"))
    peers = F.slice(F.filter("_h", lambda p: p != F.col("rel_path")), 1, n)
    return paths.join(heads, ["source", "section"]).select("source", "rel_path", peers.alias("peers"))


def related_docs(docs: DataFrame, n: int = 3) -> DataFrame:
    """First ``n`` paths that share the section or mention the stem as a whole word."""
    own = docs.select("source", "rel_path", "stem", "section")
    place = docs.select("source", F.col("rel_path").alias("other"), F.col("section").alias("other_section"))
    found = mentions(docs, whole_word=True).select("source", "stem", F.col("rel_path").alias("other"))
    # n + 1 mentioners per stem and section are enough, whoever asks
    found = top_per_group(found.join(place, ["source", "other"]), ["source", "stem", "other_section"], ["other"], n + 1)
    outside = own.join(found.drop("rank"), ["source", "stem"]).where(
        (F.col("section") != F.col("other_section")) & (F.col("rel_path") != F.col("other"))
    )
    top = top_per_group(outside, ["source", "rel_path"], ["other"], n)
    top = top.groupBy("source", "rel_path").agg(F.collect_list("other").alias("_m"))
    joined = section_peers(docs, n).join(top, ["source", "rel_path"], "left")
    both = F.array_union("peers", F.coalesce("_m", F.array().cast("array<string>")))
    return joined.select("source", "rel_path", F.slice(F.array_sort(both), 1, n).alias("related"))


# ---- relevant documents --------------------------------------------------
def relevant_docs(tasks: DataFrame, docs: DataFrame) -> DataFrame:
    """(task_id, source, pos, rel_path) by the first kind of reference a task carries.

    A task without any reference relates to its whole corpus; that is one row
    with ``whole_corpus`` set, not a copy of the corpus per task.
    """
    # a name matches by path suffix; the least path is wanted. A name without a folder is looked up among the suffixes of base names,
    # with their least paths; one with a folder holds the whole base name. Names are met once, not once per task
    base = F.substring_index("rel_path", "/", -1)
    tails = docs.select("source", "rel_path", F.explode(F.transform(F.sequence(F.lit(1), F.length(base)), lambda i: F.substr(base, i))).alias("name"))
    named = tasks.select("task_id", "source", F.posexplode("source_names").alias("pos", "name")).where(F.col("name") != "")
    asked = named.select("source", "name").distinct()
    plain = asked.join(tails.groupBy("source", "name").agg(F.min("rel_path").alias("path")), ["source", "name"])
    deep = asked.where(F.contains("name", F.lit("/"))).withColumn("_base", F.substring_index("name", "/", -1))
    nested = deep.join(docs.select("source", "rel_path", base.alias("_base")), ["source", "_base"]).where(F.endswith("rel_path", "name"))
    paths = plain.unionByName(nested.groupBy("source", "name").agg(F.min("rel_path").alias("path")))
    first = named.join(paths, ["source", "name"]).groupBy("task_id", "pos").agg(F.min("path").alias("path"))
    by_name = first.groupBy("task_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"]).alias("_named")
    )
    filled = lambda a: F.when(F.size(a) > 0, a)
    chosen = F.coalesce(
        filled(F.col("expected_files")),
        filled(F.map_keys("files")),
        filled(F.col("_named")),
        F.when(F.coalesce("nearest_doc", F.lit("")) != "", F.array("nearest_doc")),
    )
    return tasks.join(by_name, "task_id", "left").select("task_id", "source", F.posexplode_outer(chosen).alias("pos", "rel_path")).withColumn(
        "whole_corpus", F.col("rel_path").isNull()
    )
