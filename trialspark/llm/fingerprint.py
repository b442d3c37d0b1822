"""Weighted document fingerprints by consistent weighted sampling. DataFrame functions only.

Terms are the lower-cased words between white space, the weight of a term is its count. For sample k a term gets, from one
hash of (term, k), r and c ~ Gamma(2, 1) and b ~ U(0, 1); t = floor(ln w / r + b), ln a = ln c - r (t - b + 1), and the
term with the smallest a is the sample. Two texts agree in a sample with a probability of their generalised Jaccard
similarity, sum of min / sum of max of the weights; the likeness of two fingerprints is the share of samples in which they agree.

A fingerprint has ``samples`` times six hex digits (24 bits of a hash of the winning term and its t). The hash is cut into
13 bits for each factor of a gamma and 12 for b, which is far finer than what ``samples`` can tell apart. A text with no
term (null, empty, white space) has all digits ``f``, so such texts are alike in everything and unlike all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.llm.common import columns

SAMPLES = 32
EMPTY = "ffffff"


def terms_of(text: Column) -> Column:
    """The sorted hashes of a text's terms, with repeats."""
    spaced = F.lower(text)
    for space in "\t\n\r\f":
        spaced = F.replace(spaced, F.lit(space), F.lit(" "))
    hashes = F.transform(F.split(spaced, " "), lambda w: F.xxhash64(w))
    return F.sort_array(F.array_remove(hashes, F.xxhash64(F.lit(""))))


def run_starts(terms: Column) -> Column:
    """The places (from 0) where a new hash begins in the sorted array."""
    places = F.when(F.size(terms) > 0, F.sequence(F.lit(0), F.size(terms) - 1))
    return F.filter(places, lambda i: ~F.get(terms, i).eqNullSafe(F.get(terms, i - 1)))


def sample(term: Column, log_weight: Column, k: int) -> Column:
    """a (39 bits, smaller is better) above 24 bits that name the winner; the minimum over a text's terms is its sample.

    ln a lies between -96 and 32 for any weight a text can have."""
    h = F.xxhash64(term.bitwiseXOR(F.lit((k + 1) * 0x1E3779B97F4A7C15 & 0x7FFFFFFFFFFFFFFF)))
    bits = lambda at, n: (F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << n) - 1)) + 0.5) * (1.0 / (1 << n))
    r = -F.log(bits(0, 13) * bits(13, 13))
    log_c = F.log(-F.log(bits(26, 13) * bits(39, 13)))
    t = F.floor(log_weight / r + bits(52, 12))
    log_a = log_c - r * (t - bits(52, 12) + 1)
    name = h.bitwiseXOR(t * F.lit(0x5851F42D)).bitwiseAND(F.lit((1 << 24) - 1))
    return F.shiftleft(((log_a + 96.0) * float(1 << 32)).cast("long"), 24).bitwiseOR(name)


def hex_of(samples: list[Column]) -> Column:
    return F.concat(*[F.coalesce(F.lpad(F.lower(F.hex(s.bitwiseAND(F.lit((1 << 24) - 1)))), 6, "0"), F.lit(EMPTY)) for s in samples])


def likeness(a: Column, b: Column, samples: int) -> Column:
    """Share of samples in which two fingerprints agree."""
    same = [(F.substring(a, 6 * k + 1, 6) == F.substring(b, 6 * k + 1, 6)).cast("int") for k in range(samples)]
    total = same[0]
    for s in same[1:]:
        total = total + s
    return total / samples


def fingerprints(texts: DataFrame, keys: list[str], text_col: str, samples: int) -> DataFrame:
    """``keys, fingerprint``: a text's terms are exploded and reduced to minima at once; rows that are already
    clustered by some of ``keys`` are not shuffled again. ``keys`` must tell the rows apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    arrays = texts.select(*keys, terms_of(text).alias("terms"))
    runs = arrays.select(*keys, "terms", run_starts(F.col("terms")).alias("starts"))
    pairs = F.transform(
        "starts", lambda at, i: F.struct(F.get("terms", at).alias("term"), (F.coalesce(F.get("starts", i + 1), F.size("terms")) - at).cast("double").alias("weight"))
    )
    rows = runs.select(*keys, F.explode_outer(pairs).alias("p")).select(*keys, F.col("p.term").alias("term"), F.log("p.weight").alias("log_weight"))
    mins = rows.groupBy(*keys).agg(*[F.min(sample(F.col("term"), F.col("log_weight"), k)).alias(f"s{k}") for k in range(samples)])
    return mins.select(*keys, hex_of([F.col(f"s{k}") for k in range(samples)]).alias("fingerprint"))


def ranges(docs: DataFrame, parts: int) -> list:
    """The first (largest) ids of about equal ranges, in descending order; found on the id column alone."""
    shares = [k / parts for k in range(1, parts)] or [0.5]
    found = docs.agg(F.max("doc_id").alias("top"), F.percentile_approx("doc_id", shares, 10_000).alias("b")).first()
    return sorted({x for x in (found["top"], *(found["b"] or [])) if x is not None}, reverse=True)


def range_of(doc_id: Column, bounds: list) -> Column:
    """The range (0: largest ids) of an id; a boundary is the first id of its range. Null ids stand behind all others.

    Two steps over about sqrt(n) boundaries each."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    array = lambda xs: F.array(*[F.lit(x) for x in xs])
    heads = array([g[0] for g in groups])
    group = F.size(F.filter(heads, lambda b: b >= doc_id))
    inner = F.get(F.array(*[array(g) for g in groups]), group - 1)
    place = (group - 1) * step + F.size(F.filter(inner, lambda b: b >= doc_id))
    return F.when(doc_id.isNull(), F.lit(len(bounds))).when(group == 0, F.lit(0)).otherwise(place)


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses.

    The edited text has the last floor(n/2) code points replaced by the first as many (or all) of the next document in
    descending id order (behind the last comes the first). Documents with one id are ordered by text; null ids come last. A null text is
    empty. A table of one document is its own next one; without any id the last row follows itself. Texts are shuffled once, by ranges of ids; the first
    document of each range also goes to the range before it, so that the last one there finds its successor.
    """
    base = columns(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    firsts = ranges(base, parts or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n = len(firsts)
    home = F.struct(range_of(F.col("doc_id"), firsts[1:]).alias("part"), F.lit(False).alias("copy"))
    places = F.array(home)
    if n:  # the first document of a range is also the successor of the last one in the range before
        before = F.create_map(*[x for k, b in enumerate(firsts) for x in (F.lit(b), F.lit((k - 1) % n))])
        is_first = F.array_contains(F.array(*[F.lit(b) for b in firsts]), F.col("doc_id"))
        copy = F.struct(F.element_at(before, F.col("doc_id")).alias("part"), F.lit(True).alias("copy"))
        places = F.when(is_first, F.array(home, copy)).otherwise(places)
    spread = base.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.part", "p.copy")
    order = Window.partitionBy("part").orderBy(F.col("copy"), F.desc_nulls_last("doc_id"), "text")
    placed = spread.select(
        "part", "doc_id", "text", "copy", F.row_number().over(order).alias("row"), F.lead("text").over(order).alias("next")
    )
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.coalesce("next", "text"), F.lit(1), half))
    ready = placed.withColumn("edited", F.when(~F.col("copy"), edited))
    facts = ready.select(
        "part", "row", "doc_id", "copy", F.length("text").cast("long").alias("n_chars"),
        F.unhex(F.sha2("edited", 256)).alias("sha"),
        F.explode(F.when(F.col("copy"), F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")))).otherwise(
            F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("body")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("body")))
        )).alias("x"),
    ).select("part", "row", "doc_id", "copy", "n_chars", "sha", "x.which", "x.body")
    done = fingerprints(facts, ["part", "row", "doc_id", "copy", "n_chars", "sha", "which"], "body", samples)
    wide = done.groupBy("part", "row", "doc_id", "copy", "n_chars", "sha").agg(
        F.max(F.when(F.col("which") == 0, F.col("fingerprint"))).alias("fingerprint"),
        F.max(F.when(F.col("which") == 1, F.col("fingerprint"))).alias("edited_fingerprint"),
    )
    follow = Window.partitionBy("part").orderBy("row")
    out = wide.withColumn("next_print", F.coalesce(F.lead("fingerprint").over(follow), F.col("fingerprint"))).filter(~F.col("copy"))
    return out.select(
        F.col("doc_id").alias(id_col),
        "n_chars",
        F.lower(F.hex("sha")).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_print"), samples).alias("near_next"),
    )
