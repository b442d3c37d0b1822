"""Rendering corpora into index texts.

A variant is a set of *pieces*: rows with a sort key and a text that already
carries its leading separator.  One expression per document yields the pieces
of all chosen variants in a single scan; headings come from small aggregates.
Pieces are numbered and measured with sliced running sums and folded into
pages of bounded size, so the index of a corpus of millions of files is never
built in one task.  The pages of a variant, read in order, are its text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.functions import markdown as md
from trialspark.functions import text as tx
from trialspark.operators import corpus
from trialspark.operators.budgets import budget_documents
from trialspark.operators.monitor import top_per_group
from trialspark.operators.ordered import ordinals, running
from trialspark.session import frozen, scratch_path

KEY = ("a", "b", "c", "k", "path", "seq")
PIECE = "struct<a:string,b:string,c:string,k:int,path:string,seq:int,text:string>"
#: what a piece says of the list that ends its text: which one, the items left out, the characters of the others
LIST = "struct<id:string,skip:array<string>,chars:bigint>"

# Order of tiers, distractor texts, and the tier list with its instructions.
TIER_ORDER = ["required", "recommended", "reference"]
DISTRACTORS = [
    "Internal reference document",
    "Auto-generated configuration stub",
    "Legacy migration notes",
    "Temporary scaffolding overview",
    "Deprecated helper utilities",
    "Build system integration notes",
    "Draft specification placeholder",
    "Compatibility shim documentation",
    "Generated type definitions",
    "Archived design decision log",
]
INSTRUCTION = "Prefer retrieval-led reasoning over pre-training-led reasoning."
TIERS = {
    "required": "Read these files at the start of every session.",
    "recommended": "Read these files when working on related tasks.",
    "reference": "Consult these files when you need specific details.",
}
TIER_VERBS = {
    "required": "Read these files at the start of every task.",
    "recommended": "Read these files when working on related areas.",
    "reference": "Consult these files when you need specific details.",
}


@dataclass(frozen=True)
class Listed:
    """Pieces, some of which end with a list that many share (``_list``, null without one), and the ``lists``: ``id``, ``items``.

    A text with its list is put together on its way to a page or block, so such texts take no room before.
    """

    rows: DataFrame
    lists: DataFrame | None = None

    def whole(self) -> DataFrame:
        """Pieces with their whole texts."""
        return _with_lists(self.rows, self.rows, self.lists).drop("_list")


@dataclass(frozen=True)
class Variant:
    """``per_doc``: array of pieces of one prepared document; ``more``: further pieces from all of them."""

    name: str
    axis: int
    per_doc: Callable[[], Column] | None = None
    more: Callable[[DataFrame], DataFrame | Listed] | None = None


VARIANTS: dict[str, Variant] = {}


def register_variant(name: str, axis: int, per_doc=None, more=None) -> Variant:
    VARIANTS[name] = Variant(name, axis, per_doc, more)
    return VARIANTS[name]


def _s(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def piece(text, a="", b="", c="", k=0, path="", seq=0) -> Column:
    return F.struct(
        _s(a).alias("a"), _s(b).alias("b"), _s(c).alias("c"), _s(k).cast("int").alias("k"),
        _s(path).alias("path"), _s(seq).cast("int").alias("seq"), _s(text).alias("text"),
    )


def join(*parts) -> Column:
    return F.concat(*[_s(p) if not (isinstance(p, str) and p.startswith("$")) else F.col(p[1:]).cast("string") for p in parts])


def prepare(docs: DataFrame) -> DataFrame:
    """Adds the summaries every variant draws on, computed once per document."""
    c = F.col("content")
    own = F.when(F.coalesce("summary", F.lit("")) != "", F.col("summary"))
    base = docs.withColumns({"brief": md.brief_summary(c), "first": md.summarise(c), "flat": md.content_summary(c)})
    ready = base.withColumns(
        {
            "brief_own": F.coalesce(own, "brief"),
            "first_own": F.coalesce(own, "first"),
            "tokens": F.coalesce("token_count", F.lit(0)),
            "p": F.col("rel_path"),
            "name": F.substring_index("rel_path", "/", -1),
            "dir": F.coalesce(F.nullif(md.parent(F.col("rel_path")), F.lit("")), F.lit("(root)")),
        }
    )
    return ready.withColumns({"section_lines": _sections(), "definition_lines": _definitions()})


def _one(*text, **key) -> Callable[[], Column]:
    """One piece per document in path order."""
    return lambda: F.array(piece(join(*text), path=F.col("p"), k=1, **{n: f() for n, f in key.items()}))


def _rows(df: DataFrame, p: Column) -> DataFrame:
    return df.select("source", F.inline(F.array(p)))


def _heads(docs: DataFrame, cols: Sequence[str], p: Callable[[], Column]) -> DataFrame:
    return _rows(docs.select("source", *cols).distinct(), p())


def _union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ---- baselines, structure, metadata, format ------------------------------
register_variant("no-docs", 0, _one("\n- ", "$p", " (tier: ", "$tier", ", section: ", "$section", ")"))
register_variant("structure-flat", 1, _one("\n- ", "$p", " (", "$tier", "): ", "$brief_own"))

section = lambda: F.col("section")
tier = lambda: F.col("tier")
folder = lambda: F.col("dir")
_ENTRY = ("\n- ", "$p", ": ", "$brief")


def _cap(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def _deep(per_doc, heads):
    """Nested headings: each level sorts before what it contains."""
    return per_doc, lambda docs: _union(*[_heads(docs, cols, p) for cols, p in heads])


_h2 = (["section"], lambda: piece(join("\n\n## ", "$section"), a=section(), k=0))
_h3 = (["section", "tier"], lambda: piece(F.concat(F.lit("\n### "), _cap(tier())), a=section(), b=tier(), k=1))
_h4 = (
    ["section", "tier", "dir"],
    lambda: piece(join("\n#### ", "$dir"), a=section(), b=tier(), c=folder(), k=2),
)


def _nested(*keys):
    args = dict(zip("abc", keys))
    return lambda: F.array(piece(join(*_ENTRY), path=F.col("p"), k=3, **{n: f() for n, f in args.items()}))


register_variant("structure-2tier", 1, *_deep(_nested(section), [_h2]))
register_variant("structure-3tier", 1, *_deep(_nested(section, tier), [_h2, _h3]))
register_variant("structure-4tier", 1, *_deep(_nested(section, tier, folder), [_h2, _h3, _h4]))
register_variant(
    "structure-inline-required",
    1,
    lambda: F.array(
        piece(
            F.when(tier() == "required", join("\n\n## ", "$p", " [REQUIRED]\n", "$content")).otherwise(
                join("\n\n- ", "$p", " (", "$tier", "): ", "$brief")
            ),
            path=F.col("p"),
        )
    ),
)
register_variant("metadata-path-only", 2, _one("\n- ", "$p"))
register_variant("metadata-with-summary", 2, _one("\n- ", "$p", " — ", "$flat"))
register_variant("metadata-with-tokens", 2, _one("\n- ", "$p", " [tier: ", "$tier", ", ~", "$tokens", " tokens]"))


def _related(docs: DataFrame) -> DataFrame:
    both = docs.join(corpus.related_docs(docs), ["source", "rel_path"])
    tail = F.when(F.size("related") > 0, F.concat(F.lit(". Related: "), F.array_join("related", ", "))).otherwise("")
    return _rows(both, piece(F.concat(join("\n- ", "$p", " — ", "$flat"), tail), path=F.col("p")))


register_variant("metadata-with-related", 2, None, _related)


def _title(text: str) -> Callable[[DataFrame], DataFrame]:
    return lambda docs: _heads(docs, [], lambda: piece(text, k=-1))


def _cells(*cols: str) -> list[Column]:
    return [md.escape_pipe(F.col(c).cast("string")) for c in cols]


register_variant("no-index", 0, None, _title(""))

_COLUMNS = ("rel_path", "section", "tier", "tokens", "first_own")
register_variant(
    "format-pipe-delimited",
    3,
    lambda: F.array(piece(F.concat(F.lit("\n"), F.concat_ws("|", *_cells(*_COLUMNS))), path=F.col("p"))),
    _title("path|section|tier|tokens|summary"),
)
register_variant(
    "format-markdown-table",
    3,
    lambda: F.array(
        piece(F.concat(F.lit("\n| "), F.concat_ws(" | ", *_cells(*_COLUMNS)), F.lit(" |")), path=F.col("p"))
    ),
    _title(
        "# Documentation Index\n\n| Path | Section | Tier | Tokens | Summary |\n"
        "|------|---------|------|--------|---------|"
    ),
)


def _yaml() -> Column:
    y = lambda c: md.yaml_scalar(F.col(c))
    text = F.concat(
        F.lit("\n  - path: "), y("rel_path"), F.lit("\n    section: "), y("section"), F.lit("\n    tier: "), y("tier"),
        F.lit("\n    tokens: "), F.col("tokens").cast("string"), F.lit("\n    summary: "), y("first_own"),
    )
    return F.array(piece(text, path=F.col("p")))


register_variant("format-yaml", 3, _yaml, _title("files:"))
register_variant(
    "format-markdown-list",
    3,
    _one("\n- **", "$p", "** (", "$tier", ", ~", "$tokens", " tokens) — ", "$first_own", a=section),
    lambda docs: _union(
        _title("# Documentation Index")(docs),
        _heads(docs, ["section"], lambda: piece(join("\n\n## ", "$section"), a=section())),
    ),
)


def _plain(docs: DataFrame) -> DataFrame:
    """Sentences: the first and last file of a section, and the first and last section, differ."""
    ends = docs.groupBy("source", "section").agg(F.min("rel_path").alias("_lo"), F.max("rel_path").alias("_hi"))
    outer = ends.groupBy("source").agg(F.min("section").alias("_s0"), F.max("section").alias("_s1"))
    both = docs.join(ends, ["source", "section"])
    at = F.col("p")
    lead = (
        F.when(at == F.col("_lo"), join("\n\nThe ", "$section", " section includes "))
        .when(at == F.col("_hi"), ", and ")
        .otherwise(", ")
    )
    stop = F.when(at == F.col("_hi"), ".").otherwise("")
    body = F.concat(lead, join("$name", " (", "$tier", ") covering ", "$first_own"), stop)
    label = F.when(section() == "Guides", "guides").otherwise(join("$section", " references"))
    opening = F.concat(
        F.when(section() == F.col("_s0"), "The documentation contains ").otherwise(" and "),
        label,
        F.when(section() == F.col("_s1"), ".").otherwise(""),
    )
    return _union(
        _rows(both, piece(body, a=section(), k=1, path=at)),
        _rows(ends.join(outer, "source"), piece(opening, k=0, path=section())),
    )


register_variant("format-plain-markdown", 3, None, _plain)


# ---- position ------------------------------------------------------------
def bluf_key() -> Column:
    """Tier order (unknown last), priority descending, path: as one sortable text."""
    rank = F.coalesce(*[F.when(tier() == t, F.lit(str(i))) for i, t in enumerate(TIER_ORDER)], F.lit("9"))
    return F.concat(rank, F.lpad((F.lit(10**9) - F.col("priority")).cast("string"), 12, "0"), "rel_path")


def edges_bands(docs: DataFrame) -> DataFrame:
    """Band 0 for the first half of the required files, 2 for the second half, 1 for all others."""
    required = docs.where(tier() == "required").select("source", "rel_path")
    n = required.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    placed = ordinals(required, ["source"], ["rel_path"], "_i").join(n, "source")
    band = F.when(F.col("_i") <= F.ceil(F.col("_n") / 2), 0).otherwise(2)
    return docs.join(placed.select("source", "rel_path", band.alias("_band")), ["source", "rel_path"], "left").na.fill(1, ["_band"])


def shuffle_key(seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}/"), F.col("rel_path")).cast("binary"))


def _two_tier(ordered: DataFrame) -> DataFrame:
    """Sections in order of their first document in ``_ord``, documents inside them in that order."""
    firsts = ordered.groupBy("source", "section").agg(F.min("_ord").alias("_sec"))
    both = ordered.join(firsts, ["source", "section"])
    line = join("\n- ", "$p", " (", "$tier", ", ~", "$tokens", " tokens) -- ", "$first_own")
    return _union(
        _title("# Documentation Index")(ordered),
        _rows(firsts, piece(join("\n\n## ", "$section"), a=F.col("_sec"))),
        _rows(both, piece(line, a=F.col("_sec"), k=1, path=F.col("_ord"))),
    )


register_variant("position-natural", 4, None, lambda d: _two_tier(d.withColumn("_ord", F.concat(F.lit("0"), "rel_path"))))
register_variant("position-bluf", 4, None, lambda d: _two_tier(d.withColumn("_ord", bluf_key())))
register_variant(
    "position-edges", 4, None, lambda d: _two_tier(edges_bands(d).withColumn("_ord", F.concat(F.col("_band").cast("string"), "rel_path")))
)
register_variant("position-random", 4, None, lambda d: _two_tier(d.withColumn("_ord", F.concat(shuffle_key(), "rel_path"))))


# ---- transforms, scale, noise, granularity -------------------------------
def _body(fn: Callable[[Column], Column]) -> Callable[[], Column]:
    return lambda: F.array(piece(F.concat(join("\n\n## ", "$p", "\n\n"), fn(F.col("content"))), path=F.col("p")))


register_variant("transform-passthrough", 5, _body(lambda c: c))
register_variant("transform-algorithmic", 5, _body(md.first_lines))
register_variant("transform-llm-compressed", 5, _body(md.paragraph_leads))
register_variant("transform-restructured", 5, _body(md.restructure))
register_variant(
    "transform-tagged",
    5,
    lambda: F.array(
        piece(
            F.concat(
                join("\n- ", "$p", " ["),
                F.array_join(md.build_tags(tier(), section(), F.col("content")), ", "),
                join("]: ", "$brief"),
            ),
            path=F.col("p"),
        )
    ),
)


def _scale(n: int) -> Callable[[DataFrame], DataFrame]:
    line = ("\n- ", "$p", " (", "$tier", "): ", "$brief")
    return lambda docs: _rows(
        top_per_group(docs, ["source"], ["rel_path"], n), piece(join(*line), path=F.col("p"))
    )


for _n in (5, 15, 50, 100, 200):
    register_variant(f"scale-{_n}", 6, None, _scale(_n))


def _noise(count: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    def more(docs: DataFrame) -> DataFrame:
        n = docs.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
        # ranges are exploded, not collected; a text is drawn by hash
        extra = n.select("source", F.explode(F.sequence(F.lit(1), count(F.col("_n")))).alias("_i"))
        number = F.lpad("_i", F.greatest(F.lit(3), F.length(F.col("_i").cast("string"))), F.lit("0"))
        path = F.concat(F.lit("docs/internal/generated_"), number, F.lit(".md"))
        pick = F.element_at(
            F.array(*[F.lit(x) for x in DISTRACTORS]), (tx.hash_number(F.concat(F.lit("42/"), F.col("_i").cast("string"))) % 10 + 1).cast("int")
        )
        return _rows(extra.withColumn("_p", path), piece(F.concat(F.lit("\n- "), F.col("_p"), F.lit(": "), pick), k=1, path=F.col("_p")))

    return more


register_variant("noise-0", 7, _one(*_ENTRY))
register_variant("noise-25", 7, _one(*_ENTRY), _noise(lambda n: F.greatest(F.lit(1), F.floor(n / 3))))
register_variant("noise-50", 7, _one(*_ENTRY), _noise(lambda n: n))
register_variant("noise-75", 7, _one(*_ENTRY), _noise(lambda n: n * 3))


def _entries(items: Column, text: Callable[[Column], Column]) -> Column:
    """The lines of a document, one text; empty without items."""
    return F.array_join(F.transform(items, text), "")


def _sections() -> Column:
    return _entries(
        md.split_sections(F.col("content")), lambda x: F.concat(join("\n- ", "$p", "#"), x["name"], F.lit(": "), x["summary"])
    )


def _definitions() -> Column:
    return _entries(
        md.split_definitions(F.col("content")), lambda x: F.concat(join("\n- ", "$p", "::"), x["name"], F.lit(" ("), x["kind"], F.lit(")"))
    )


def _or_file(*choices: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in choices], join(*_ENTRY))


def _mixed() -> Column:
    n = F.length("content")
    return F.when(n < 500, join(*_ENTRY)).when(n <= 2000, _or_file("section_lines")).otherwise(_or_file("definition_lines", "section_lines"))


def _per_file(text: Callable[[], Column]) -> Callable[[], Column]:
    return lambda: F.array(piece(text(), path=F.col("p")))


register_variant("granularity-file", 8, _one("\n[FILE] ", "$p", ": ", "$brief_own"))
register_variant("granularity-section", 8, _per_file(lambda: _or_file("section_lines")))
register_variant("granularity-function", 8, _per_file(lambda: _or_file("definition_lines")))
register_variant("granularity-mixed", 8, _per_file(_mixed))


# ---- cross-references ----------------------------------------------------
_OWN = ("\n- ", "$p", ": ", "$brief_own")


def _see_also(peers: DataFrame) -> DataFrame:
    text = F.concat(F.lit("\n  See also: "), F.array_join("peers", ", "))
    return _rows(peers.where(F.size("peers") > 0), piece(text, a=F.col("rel_path"), k=2))


#: neighbouring paths of a corpus whose mentions of a stem make one list
CHUNK = 65_536


def _dense(docs: DataFrame) -> Listed:
    """Peers, then every mentioner, then every mentioned file, however many.

    The links of a text grow with the square of a corpus, what is stored and sorted does not: the mentioners of a stem are listed once per
    ``CHUNK`` neighbouring paths, and every file of the stem names these lists, with the peers that it leaves out.
    """
    peers = corpus.section_peers(docs, 3)
    found = _written(corpus.mentions(docs, whole_word=False).where(F.col("stem_path") != F.col("rel_path")), "links")
    first = peers.select("source", F.explode("peers").alias("by")).distinct().withColumn("_peer", F.lit(True))
    paths = ordinals(docs.select("source", F.col("rel_path").alias("by")), ["source"], ["by"], "_i").join(first, ["source", "by"], "left")
    by = found.select("source", "stem", F.col("rel_path").alias("by"))
    chunked = by.join(paths.select("source", "by", "_peer", F.floor((F.col("_i") - 1) / CHUNK).alias("_chunk")), ["source", "by"])
    lists = chunked.groupBy("source", "stem", "_chunk").agg(
        F.array_sort(F.collect_list("by")).alias("items"),
        F.collect_list(F.when(F.col("_peer"), F.col("by"))).alias("_peers"),
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.length("by") + 2).alias("_chars"),
    )
    lists = _written(lists.withColumn("id", F.monotonically_increasing_id().cast("string")), "lists")
    slim = lists.select("source", "stem", "id", "_chunk", F.element_at("items", 1).alias("_from"), "_peers", "_n", "_chars")
    start = slim.groupBy("source", "stem").agg(F.min("_chunk").alias("_lo"))
    mine = peers.select("source", F.col("rel_path").alias("of"), "peers")
    link = docs.select("source", F.col("rel_path").alias("of"), "stem").join(mine, ["source", "of"]).join(start, ["source", "stem"])
    mentioned = link.join(slim, ["source", "stem"]).withColumn("_skip", F.array_intersect("peers", "_peers")).where(F.col("_n") > F.size("_skip"))
    opens = (F.size("peers") == 0) & (F.col("_chunk") == F.col("_lo"))
    left = F.col("_chars") - 2 - F.aggregate("_skip", F.lit(0), lambda n, x: n + F.length(x) + 2)
    named = F.struct("id", F.col("_skip").alias("skip"), left.alias("chars")).cast(LIST)
    also = piece(F.when(opens, "\n  See also: ").otherwise(", "), a=F.col("of"), b=F.concat(F.lit("1"), "_from"))
    # the stems that one text holds are no more than its length allows
    refs = found.groupBy("source", "rel_path").agg(F.array_sort(F.collect_list(F.struct("stem", "stem_path"))).alias("_refs"))
    ref = F.concat(F.lit("\n  Referenced by: "), F.array_join(F.transform("_refs", lambda x: x["stem_path"]), ", "))
    plain = _union(_see_also(peers), _rows(refs, piece(ref, a=F.col("rel_path"), b="2")))
    listed = mentioned.select("source", named.alias("_list"), F.inline(F.array(also)))
    return Listed(listed.unionByName(plain, allowMissingColumns=True), lists.select("id", "items"))


_file = lambda: F.array(piece(join(*_OWN), a=F.col("p")))
register_variant("xref-none", 9, _file)
register_variant("xref-light", 9, _file, lambda d: _see_also(corpus.section_peers(d, 2)))
register_variant("xref-dense", 9, _file, _dense)


# ---- time ----------------------------------------------------------------
def _tagged(tag: Callable[[], Column]) -> Callable[[], Column]:
    return lambda: F.array(piece(F.concat(join("\n- ", "$p", " ["), tag(), join("]: ", "$brief_own")), path=F.col("p")))


register_variant("temporal-none", 10, _tagged(lambda: F.lit("no-date")))
register_variant("temporal-version", 10, _tagged(lambda: md.detect_version(F.col("content"))))
register_variant(
    "temporal-modified",
    10,
    _tagged(lambda: F.concat(F.lit("modified: "), F.coalesce(F.date_format("last_modified", "yyyy-MM-dd"), F.lit("unknown")))),
)
register_variant(
    "temporal-deprecated",
    10,
    _tagged(lambda: F.when(md.is_deprecated(F.col("content")), "DEPRECATED").otherwise("CURRENT")),
)


# ---- assembling ----------------------------------------------------------
def listed_pieces(docs: DataFrame, names: Sequence[str]) -> Listed:
    """All pieces of the named variants; per-document pieces come from one scan.

    Where more than three variants read the documents again, these are prepared once and written.
    """
    ready = prepare(docs)
    if sum(VARIANTS[n].more is not None for n in names) > 3:
        ready = _written(ready, "prepared")
    frames, lists = [], []
    per_doc = [VARIANTS[n] for n in names if VARIANTS[n].per_doc]
    if per_doc:
        def label(variant: Variant) -> Column:
            tagged = lambda x: F.struct(F.lit(variant.name).alias("variant"), x.alias("x"))
            return F.transform(variant.per_doc().cast(f"array<{PIECE}>"), tagged)

        labelled = [label(x) for x in per_doc]
        every = labelled[0] if len(labelled) == 1 else F.concat(*labelled)
        flat = ready.select("source", F.explode(every).alias("e")).select("source", "e.variant", "e.x.*")
        frames.append(flat.select("source", "variant", *KEY, "text", F.lit(None).cast(LIST).alias("_list")))
    for n in names:
        more = VARIANTS[n].more(ready) if VARIANTS[n].more else None
        if more is None:
            continue
        mark = F.lit(None)
        if isinstance(more, Listed):
            of = lambda c, n=n: F.concat(F.lit(f"{n}/"), c)
            lists.append(more.lists.withColumn("id", of(F.col("id"))))
            mark, more = F.when(F.col("_list").isNotNull(), F.struct(of(F.col("_list.id")).alias("id"), "_list.skip", "_list.chars")), more.rows
        frames.append(more.select("source", F.lit(n).alias("variant"), *KEY, "text", mark.cast(LIST).alias("_list")))
    return Listed(_union(*frames), _union(*lists) if lists else None)


def pieces(docs: DataFrame, names: Sequence[str]) -> DataFrame:
    """All pieces of the named variants with their whole texts."""
    return listed_pieces(docs, names).whole()


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: characters of text that a task puts together
TASK_CHARS = 1 << 26


def _dealt(df: DataFrame, chars: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in as many parts as ``chars`` characters need, if these are more than the session's."""
    n = -(-chars // TASK_CHARS)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _with_lists(rows: DataFrame, stored: DataFrame, lists: DataFrame | None) -> DataFrame:
    """``rows`` with whole texts; ``stored`` has the same lists, and is read for how long their texts are.

    The lists travel, a text is put together where it meets its list; one that very many texts end with goes to several tasks.
    """
    if lists is None:
        return rows
    of = F.col("_list.id").alias("_of")
    used = stored.where(F.col("_list").isNotNull()).groupBy(of).agg(F.sum("_list.chars").alias("_chars"))
    used = frozen(used.withColumn("_parts", F.greatest(F.ceil(F.col("_chars") / TASK_CHARS), F.lit(1)).cast("int")))
    chars = used.agg(F.coalesce(F.sum("_chars"), F.lit(0))).first()[0]
    used = used.drop("_chars")
    part = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in ("text", "_list")]), F.col("_parts")).cast("int")
    naming = rows.where(F.col("_list").isNotNull()).withColumn("_of", of).join(used, "_of").withColumn("_part", part).drop("_parts")
    copies = lists.withColumnRenamed("id", "_of").join(used, "_of").select("_of", "items", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    both = _dealt(naming, chars, "_of", "_part").join(_dealt(copies, chars, "_of", "_part"), ["_of", "_part"])
    skip = F.col("_list.skip")
    items = F.when(F.size(skip) > 0, F.filter("items", lambda x: ~F.array_contains(skip, x))).otherwise(F.col("items"))
    return rows.where(F.col("_list").isNull()).unionByName(both.withColumn("text", F.concat("text", F.array_join(items, ", "))).select(*rows.columns))


def _in_order(parts: Listed, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pieces, written once without their lists, and per piece its number and the characters up to its end; ``_lead``: line breaks it starts with."""
    size = lambda c: F.coalesce(F.length(c).cast("long"), F.lit(0).cast("long"))
    lead = size("text") - size(F.regexp_replace("text", "^\n+", ""))
    chars = size("text") + F.coalesce(F.col("_list.chars"), F.lit(0).cast("long"))
    rows = parts.rows if parts.lists is not None else parts.rows.withColumn("_list", F.lit(None).cast(LIST))
    sized = rows.select(*keys, *KEY, "text", "_list", chars.alias("_len"), lead.alias("_lead")).withColumn("_id", F.monotonically_increasing_id())
    stored = _written(sized, "pieces")
    totals = {"ordinal": F.lit(1).cast("long"), "_cum": F.col("_len")}
    return stored, running(stored.select(*keys, *KEY, "_len", "_lead", "_id"), keys, KEY, totals)


def pages(parts: DataFrame | Listed, keys: Sequence[str] = ("source", "variant"), page_chars: int = 1_000_000) -> DataFrame:
    """Fold pieces into pages of about ``page_chars`` characters, in order.

    Pieces are written once; only their keys and lengths are put in order, and
    the texts then move to their page.  The first piece of a text loses the
    blank lines it would start with.
    """
    keys = list(keys)
    parts = parts if isinstance(parts, Listed) else Listed(parts)
    stored, slim = _in_order(parts, keys)
    page = F.floor((F.col("_cum") - F.col("_len")) / page_chars).alias("page")
    placed = stored.select(*keys, "_id", "text", "_list").join(slim.select("_id", "ordinal", page), "_id")
    text = F.when(F.col("ordinal") == 1, F.regexp_replace("text", "^\n+", "")).otherwise(F.col("text"))
    whole = _with_lists(placed.select(*keys, "page", "ordinal", text.alias("text"), "_list"), stored, parts.lists).drop("_list")
    if parts.lists is not None:
        whole = _dealt(whole, stored.agg(F.coalesce(F.sum("_len"), F.lit(0))).first()[0], *keys, "page")
    return (
        whole.groupBy(*keys, "page")
        .agg(
            F.count(F.lit(1)).alias("pieces"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "").alias("content"),
        )
    )


def render_variants(docs: DataFrame, names: Sequence[str], page_chars: int = 1_000_000) -> DataFrame:
    return pages(listed_pieces(docs, names), page_chars=page_chars)


def sizes(rendered: DataFrame, keys: Sequence[str] = ("source", "variant")) -> DataFrame:
    n = F.sum(F.length("content"))
    return rendered.groupBy(*keys).agg(n.alias("n_chars"), F.floor(n / 4).alias("est_tokens"), F.count(F.lit(1)).alias("pages"))


#: characters of a text that are hashed together
DIGEST_BLOCK = 65_536


def digests(rendered: DataFrame, keys: Sequence[str] = ("source", "variant"), block: int = DIGEST_BLOCK) -> DataFrame:
    """Length, pages and one number per whole text, put together from its pages; no text is ever in one row.

    A text is cut at every ``block`` characters, wherever its pages end; a block and its number give an MD5, and the first 48 bits of
    all blocks add up, modulo 2^61. Equal texts have equal numbers however they are paged. Pages are written
    once; offsets are running sums of their lengths, and a task holds one block of a text. An empty text has the number 0.
    """
    keys = list(keys)
    spark = rendered.sparkSession
    path = scratch_path(spark, "paged")
    rendered.select(*keys, "page", "content").write.parquet(path)
    stored = spark.read.schema(rendered.select(*keys, "page", "content").schema).parquet(path)
    sized = stored.select(*keys, "page", F.length("content").cast("long").alias("_len"))
    ends = running(sized, keys, ["page"], {"_end": F.col("_len")}).select(*keys, "page", "_len", (F.col("_end") - F.col("_len")).alias("_start"))
    at, start = F.col("_block") * block, F.col("_start")
    covered = F.sequence(F.floor(start / block), F.floor((start + F.col("_len") - 1) / block))
    cut = (
        stored.join(ends.where(F.col("_len") > 0), [*keys, "page"])
        .select(*keys, "page", "content", "_start", F.explode(covered).alias("_block"))
        .withColumn("_from", F.greatest(at - start, F.lit(0)))
        .select(*keys, "page", "_block", F.substring("content", (F.col("_from") + 1).cast("int"), (at + block - start - F.col("_from")).cast("int")).alias("_text"))
    )
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "_text"))), lambda x: x["_text"]), "")
    blocks = cut.groupBy(*keys, "_block").agg(F.concat(F.col("_block").cast("string"), F.lit(":"), whole).alias("_t"))
    found = _block_sums(blocks, keys)
    return sizes(stored, keys).join(found, keys, "left").withColumn("digest", F.coalesce("_n", F.lit(0).cast("long"))).drop("_n")


def _number(text: Column) -> Column:
    """The number of a block whose ``text`` begins with the block's place."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("decimal(38,0)")


def _block_sums(blocks: DataFrame, keys: list[str]) -> DataFrame:
    return blocks.groupBy(*keys).agg((F.sum(_number(F.col("_t"))) % F.lit(2**61)).cast("long").alias("_n"))


def piece_digests(parts: DataFrame | Listed, keys: Sequence[str] = ("source", "variant"), block: int = DIGEST_BLOCK) -> DataFrame:
    """``n_chars`` and ``digest`` of :func:`digests` straight from the pieces: each is cut where a block ends, no page lies between.

    A block inside one piece is hashed where the piece is; only the ends of a piece travel to the others of their blocks.
    """
    keys = list(keys)
    parts = parts if isinstance(parts, Listed) else Listed(parts)
    stored, slim = _in_order(parts, keys)
    # the first piece loses the line breaks it starts with, and all others move up by as much
    moved = slim.join(slim.where(F.col("ordinal") == 1).select(*keys, F.col("_lead").alias("_off")), keys)
    skip = F.when(F.col("ordinal") == 1, F.col("_lead")).otherwise(F.lit(0).cast("long"))
    placed = moved.select(*keys, "_id", "ordinal", skip.alias("_skip"), (F.col("_len") - skip).alias("_n"), (F.col("_cum") - F.col("_off")).alias("_end"))
    start, at = F.col("_end") - F.col("_n"), F.col("_block") * block
    covered = F.sequence(F.floor(start / block), F.floor((F.col("_end") - 1) / block))
    origin = F.greatest(at, start)
    size = F.least(at + block, F.col("_end")) - origin
    moving = stored.select("_id", "text", "_list").join(placed.where(F.col("_n") > 0), "_id")
    cut = (
        _with_lists(moving, stored, parts.lists)
        .withColumn("_block", F.explode(covered))
        .select(
            *keys, "ordinal", "_block", (size == block).alias("_full"),
            F.substring("text", (origin - start + F.col("_skip") + 1).cast("int"), size.cast("int")).alias("_text"),
        )
    )
    place = F.concat(F.col("_block").cast("string"), F.lit(":"))
    held = cut.select(
        *keys, "_block",
        F.when(F.col("_full"), _number(F.concat(place, "_text"))).alias("_n"),
        F.when(~F.col("_full"), F.struct("ordinal", "_text")).alias("_piece"),
    )
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("_piece")), lambda x: x["_text"]), "")
    blocks = held.groupBy(*keys, "_block").agg(F.coalesce(F.max("_n"), _number(F.concat(place, whole))).alias("_n"))
    found = blocks.groupBy(*keys).agg((F.sum("_n") % F.lit(2**61)).cast("long").alias("_n"))
    total = placed.groupBy(*keys).agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_chars"))
    return total.join(found, keys, "left").select(*keys, "n_chars", F.coalesce("_n", F.lit(0).cast("long")).alias("digest"))


def composite(docs: DataFrame, design: dict[str, Sequence[str]], page_chars: int = 1_000_000) -> DataFrame:
    """Component texts in axis order separated by a blank line, per named combination."""
    used = sorted({n for names in design.values() for n in names})
    parts = listed_pieces(docs, used)
    order = lambda names: sorted(names, key=lambda n: VARIANTS[n].axis)
    slots = F.array(
        *[
            F.struct(F.lit("+".join(order(names))).alias("name"), F.lit(n).alias("component"), F.lit(i).alias("slot"))
            for names in design.values()
            for i, n in enumerate(order(names))
        ]
    )
    spread = parts.rows.select("*", F.explode(F.filter(slots, lambda s: s["component"] == F.col("variant"))).alias("_slot"))
    firsts = _components(spread)
    return pages(Listed(firsts, parts.lists), page_chars=page_chars)


def _components(spread: DataFrame) -> DataFrame:
    """Component pieces under the combination's name; each component's first piece opens a paragraph."""
    key = F.struct("a", "b", "c", "k", "path", "seq")
    lo = spread.groupBy("source", "_slot").agg(F.min(key).alias("_lo"))
    both = spread.join(lo, ["source", "_slot"])
    lead = F.concat(F.lit("\n\n"), F.regexp_replace("text", "^\n+", ""))
    return both.select(
        "source",
        F.col("_slot.name").alias("variant"),
        F.concat(F.lpad(F.col("_slot.slot").cast("string"), 3, "0"), F.col("a")).alias("a"),
        "b", "c", "k", "path", "seq",
        F.when(key == F.col("_lo"), lead).otherwise(F.col("text")).alias("text"),
        "_list",
    )


# ---- tiered index targets and directory listings -------------------------
def _tier_text(values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("tier"))


def tiered_index(docs: DataFrame, target: str, tiers: dict[str, str] | None = None, instruction: str = INSTRUCTION) -> DataFrame:
    """Pieces of one list target; ``cursor-rules`` gives one text per tier."""
    tiers = tiers or TIERS
    place = F.coalesce(*[F.when(tier() == t, F.lit(str(i))) for i, t in enumerate(tiers)])
    known = docs.withColumn("_t", place).where(F.col("_t").isNotNull()).withColumn("_ord", bluf_key())
    by_section = target == "agents.md"
    group = ["source", "_t", "tier", *(["section"] if by_section else [])]
    ends = known.groupBy(*group).agg(F.min("_ord").alias("_lo"), F.max("_ord").alias("_hi"))
    both = known.join(ends, group)
    tag = lambda df: df.withColumn("variant", F.lit(target))
    title = _cap(F.col("tier"))
    last = F.col("_ord") == F.col("_hi")
    tiers_of = known.select("source", "_t", "tier").distinct()
    corpora = docs.select("source").distinct()
    head = lambda text: _rows(corpora, piece(text))
    if by_section:
        place_of = F.when(F.col("section") == "", "").otherwise(F.concat(F.lit("1"), F.col("_lo")))
        titled = ends.where(F.col("section") != "")
        out = _union(
            head(f"IMPORTANT: {instruction}\n\n"),
            _rows(tiers_of, piece(F.concat(F.lit("## "), title, F.lit(" ["), _tier_text(tiers), F.lit("]\n\n")), a=F.col("_t"))),
            _rows(titled, piece(F.concat(F.lit("### "), _cap(section()), F.lit("\n")), a=F.col("_t"), b=place_of, k=1)),
            _rows(both, piece(F.concat("rel_path", F.when(last, "\n\n").otherwise("\n")), a=F.col("_t"), b=place_of, k=2, path=F.col("_ord"))),
            _rows(corpora, piece(f"IMPORTANT: {instruction}\n", a="~")),
        )
        return tag(out)
    if target == "cursor-rules":
        by = lambda df, p: df.select("source", F.concat("tier", F.lit("-docs.mdc")).alias("variant"), F.inline(F.array(p)))
        first = F.col("_ord") == F.col("_lo")
        opening = F.concat(F.lit("---\ndescription: "), _tier_text(tiers), F.lit("\nglobs: "))
        return _union(
            by(tiers_of, piece(opening)),
            by(both, piece(F.concat(F.when(first, "").otherwise(", "), "rel_path"), a="1", path=F.col("_ord"))),
            by(tiers_of, piece(F.concat(F.lit("\n---\n\n# "), title, F.lit(" Documentation\n\n")), a="2")),
            by(both, piece(F.concat(F.lit("- "), "rel_path", F.lit("\n")), a="3", path=F.col("_ord"))),
        )
    styles = {
        "claude.md": ("# Project Documentation", _tier_text(tiers | {k: v for k, v in TIER_VERBS.items() if k in tiers}), "- `", "`"),
        "copilot-instructions": ("# Copilot Instructions", F.concat(F.lit("_"), _tier_text(tiers), F.lit("_")), "- ", ""),
    }
    if target not in styles:
        raise ValueError(f"unknown output target {target}")
    name, verb, left, right = styles[target]
    out = _union(
        head(f"{name}\n\n{instruction}\n\n"),
        _rows(tiers_of, piece(F.concat(F.lit("## "), title, F.lit("\n\n"), verb, F.lit("\n\n")), a=F.col("_t"))),
        _rows(both, piece(F.concat(F.lit(left), "rel_path", F.lit(right), F.when(last, "\n\n").otherwise("\n")), a=F.col("_t"), k=1, path=F.col("_ord"))),
    )
    return tag(out)


def dir_listing(index: DataFrame, marker: str, title: str, root: str, expanded: bool = False, instruction: str = INSTRUCTION, fallback: str = "") -> DataFrame:
    """Pieces of the directory listing; ``index`` has source, dir and name, one row per file."""
    ends = index.groupBy("source", "dir").agg(F.min("name").alias("_lo"), F.max("name").alias("_hi"))
    corpora = index.select("source").distinct()
    nl = "\n" if expanded else ""
    parts = [f"<!-- {marker}-START -->", f"[{title}]", f"|root: {root}", f"|IMPORTANT: {instruction}"]
    parts += [f"|If docs missing run: {fallback}"] if fallback else []
    opening = nl.join(parts) + (nl * 2 if expanded else "")
    lead = F.when(
        F.col("name") == F.col("_lo"),
        F.concat(F.lit("|"), F.when(F.col("dir") == "", ".").otherwise(F.col("dir")), F.lit(":{")),
    ).otherwise(",")
    stop = F.when(F.col("name") == F.col("_hi"), "}" + nl).otherwise("")
    out = _union(
        _rows(corpora, piece(opening)),
        _rows(index.join(ends, ["source", "dir"]), piece(F.concat(lead, "name", stop), a=F.concat(F.lit("1"), "dir"), path=F.col("name"))),
        _rows(corpora, piece(f"<!-- {marker}-END -->", a="~")),
    )
    return out.withColumn("variant", F.lit("expanded" if expanded else "compressed"))


def oracle_texts(relevant: DataFrame, docs: DataFrame) -> DataFrame:
    """Pieces per text: the relevant documents of a task in listed order, or a whole corpus by path.

    Tasks without references share one text of their corpus instead of copies of it;
    :func:`oracle_text_ids` says which text a task reads.
    """
    slim = docs.select("source", "rel_path", "content")
    text = join("\n\n## ", "$rel_path", "\n", "$content")
    listed = relevant.where(~F.col("whole_corpus")).join(slim, ["source", "rel_path"])
    shared = slim.join(relevant.where("whole_corpus").select("source").distinct(), "source", "left_semi")
    return listed.select(F.col("task_id").alias("text_id"), F.inline(F.array(piece(text, a=F.lpad(F.col("pos").cast("string"), 20, "0"), path=F.col("rel_path"))))).unionByName(
        shared.select(corpus_text_id().alias("text_id"), F.inline(F.array(piece(text, seq=F.lit(0), path=F.col("rel_path")))))
    )


def corpus_text_id() -> Column:
    return F.concat(F.lit("corpus/"), "source")


def oracle_text_ids(relevant: DataFrame) -> DataFrame:
    """One row per task: the id of the text it reads."""
    return relevant.select("task_id", F.when(F.col("whole_corpus"), corpus_text_id()).otherwise(F.col("task_id")).alias("text_id")).distinct()


def length_matched(docs: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """``source, target_tokens, place, rel_path, tokens``: for every distinct target of a corpus the documents in hash order, each
    taken if it still fits what is left of the target. A null count of tokens is 0; a target of 0 or less takes nothing."""
    keyed = docs.withColumn("_o", shuffle_key(seed))
    return budget_documents(keyed, targets, ["_o", "rel_path"]).select("source", "target_tokens", "place", "rel_path", "tokens")


def oracle_tokens(relevant: DataFrame, docs: DataFrame) -> DataFrame:
    """``task_id, source, target_tokens``: tokens of a task's relevant documents, of its whole corpus if it names none."""
    sizes = docs.select("source", "rel_path", F.coalesce("token_count", F.lit(0)).alias("tokens"))
    corpus = sizes.groupBy("source").agg(F.sum("tokens").alias("all_tokens"))
    named = relevant.join(sizes, ["source", "rel_path"], "left").groupBy("task_id", "source").agg(F.sum("tokens").alias("tokens"), F.max("whole_corpus").alias("whole"))
    return named.join(corpus, "source", "left").select(
        "task_id", "source", F.coalesce(F.when(F.col("whole"), F.col("all_tokens")).otherwise(F.col("tokens")), F.lit(0)).cast("long").alias("target_tokens")
    )


def random_text_id() -> Column:
    return F.concat(F.lit("random/"), F.col("source"), F.lit("/"), F.col("target_tokens").cast("string"))


def length_matched_texts(wanted: DataFrame, docs: DataFrame, seed: int = 42) -> DataFrame:
    """Pieces per text: the documents that a target takes, in hash order. Tasks of one corpus and target share a text."""
    taken = length_matched(docs, wanted.select("source", "target_tokens"), seed)
    text = join("\n\n## ", "$rel_path", "\n", "$content")
    return taken.join(docs.select("source", "rel_path", "content"), ["source", "rel_path"]).select(
        random_text_id().alias("text_id"), F.inline(F.array(piece(text, a=F.lpad(F.col("place").cast("string"), 20, "0"), path=F.col("rel_path"))))
    )
