"""Queries for document corpora: text functions, drift, transforms, cross-references."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark import views as v
from trialspark.functions import markdown as md
from trialspark.functions.fixed_text import WHITE, WORD_CHARS
from trialspark.operators import corpus as co
from trialspark.operators import render as rd
from trialspark.operators import trials as t
from trialspark.plans.registry import query
from trialspark.session import scratch_path

NL = md.LINE_BREAK


def strip(x):
    return f"regexp_replace({x}, '^{WHITE}|{WHITE}$', '', 'g')"


def unhash(x):
    return f"regexp_replace({x}, '^[# ]+', '')"


def lines(x):
    return f"regexp_split_to_array({x}, '{NL}')"


BRIEF = f"coalesce(list_filter(list_transform({lines('content')}, lambda x: {unhash(strip('x'))}), lambda x: x <> '')[1], '')[1:80]"
_F1 = strip("string_split(content, chr(10))[1]")
FIRST = f"(CASE WHEN length({_F1}) > 100 THEN ({_F1})[1:97] || '...' ELSE {_F1} END)"
_FL = strip(unhash(strip(f"regexp_replace(content, '{WHITE}', ' ', 'g')")))
FLAT = f"(CASE WHEN length({_FL}) > 100 THEN regexp_replace(({_FL})[1:100], '{WHITE}$', '') || '...' ELSE {_FL} END)"
YAML_PLAIN = (
    "regexp_matches(x, '^[\\p{L}_/(][^\\n]*$') AND NOT regexp_matches(x, '(: |:$| #|^\\s|\\s$)') AND lower(x) NOT IN "
    "('true', 'false', 'yes', 'no', 'on', 'off', 'null', 'y', 'n')"
)
COMPRESS = strip(
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '(?s)<!--.*?-->', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), "
    r"'(?m)[ \t]+$', '', 'g'), '(?m)^(#{1,6})([^\s#])', '\1 \2', 'g')"
)
FIRST20 = (
    f"array_to_string(list_transform(list_filter(list_transform({lines('content')}[1:20], lambda x: {strip('x')}), lambda x: x <> ''), "
    r"lambda x: regexp_replace(x, '\s{2,}', ' ', 'g')), chr(10))"
)
_BARE = f"list_transform({lines('content')}, lambda x: {strip('x')})"
# every non-blank line whose predecessor is blank (or that starts the text)
LEADS = f"array_to_string(list_filter(list_transform({_BARE}, lambda x, i: CASE WHEN x <> '' AND (i = 1 OR ({_BARE})[i - 1] = '') THEN x END), lambda x: x IS NOT NULL), chr(10))"
DEFS = (
    f"list_transform(list_filter({_BARE}, lambda x: regexp_matches(x, '^(?:def|class)\\s+([{WORD_CHARS}]+)')), "
    f"lambda x: {{'name': regexp_extract(x, '^(?:def|class)\\s+([{WORD_CHARS}]+)', 1), 'kind': CASE WHEN starts_with(x, 'class ') THEN 'class' ELSE 'function' END}})"
)
_HEAD2 = "regexp_matches(l, '^## .')"
# sections line by line: number the lines, count headings so far, take the first non-blank line below each
SECTION_CTE = f"""ln AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM docs),
lg AS (SELECT *, sum({_HEAD2}::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM ln),
sections AS (SELECT doc_id, CAST(g AS BIGINT) AS g, max({strip(unhash('l'))}) FILTER ({_HEAD2}) AS name,
  coalesce(arg_min(({strip('l')})[1:80], i) FILTER (NOT {_HEAD2} AND {strip('l')} <> ''), '') AS summary FROM lg WHERE g > 0 GROUP BY ALL)"""
_HEADN = r"regexp_matches(l, '^#{1,6}[ \t\f\r]')"
_HTITLE = strip(r"regexp_extract(l, '^#{1,6}[ \t\f\r]+([^\n]*)', 1)")
RESTRUCTURE_CTE = f"""rl AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS l, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM docs),
rg AS (SELECT *, sum({_HEADN}::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM rl),
rh AS (SELECT doc_id, g, max({_HTITLE}) FILTER ({_HEADN}) AS t, max(length(regexp_extract(l, '^(#*)', 1))) FILTER ({_HEADN}) AS lv,
  coalesce(arg_min(({strip('l')})[1:120], i) FILTER (NOT {_HEADN} AND {strip('l')} <> ''), '') AS e FROM rg WHERE g > 0 GROUP BY ALL),
rs AS (SELECT doc_id, '### Table of Contents' || chr(10) || chr(10) || string_agg(repeat('  ', lv::INT - 1) || '- ' || t, chr(10) ORDER BY g) || chr(10) || chr(10) || '### Excerpts' || chr(10)
  || string_agg('- **' || t || '**' || CASE WHEN e <> '' THEN ': ' || e ELSE '' END, chr(10) ORDER BY g) AS r FROM rh GROUP BY 1),
restructured AS (SELECT d.doc_id, coalesce(r, ({strip(f"string_split({strip('content')}, chr(10))[1]")})[1:120]) AS r FROM docs d LEFT JOIN rs ON d.doc_id = rs.doc_id)"""
_LANGS = f"list_transform(regexp_extract_all(content, '(?m)^```([{WORD_CHARS}]+)', 1), lambda x: lower(x))"
_TOPICS = rf"list_filter(list_transform(regexp_extract_all(content, '(?m)^#{{1,6}}\s+(.*)', 1), lambda x: lower({strip('x')})), lambda x: x <> '')"


def _distinct(x):
    return f"list_filter({x}, lambda y, i: list_position({x}, y) = i)"


TAGS = (
    f"array_to_string(list_concat(['tier:' || tier, 'section:' || section], list_transform({_distinct(_LANGS)}, lambda x: 'lang:' || x), "
    f"list_transform({_distinct(_TOPICS)}[1:3], lambda x: 'topic:' || x)), ', ')"
)
VERSION = "coalesce('v' || coalesce(" + ", ".join(f"nullif(regexp_extract(content, '(?i){p}', 1), '')" for p in md.VERSION_PATTERNS) + "), 'unversioned')"
DEPRECATED = f"regexp_matches(content, '(?i){md.DEPRECATION}')"


def per_doc(name, sql, fn, extra_ctes=""):
    """Register one expression over every document."""

    @query(name, f"{extra_ctes}SELECT doc_id, {sql} AS value FROM docs")
    def _(spark, sf):
        return v.docs(spark, sf).select("doc_id", fn(F.col("content")).alias("value"))


# ---- scanning ------------------------------------------------------------
@query("src01_doc_scan", "SELECT 'source=' || source AS dir, CAST(sum(strlen(content) + 1) AS BIGINT) AS bytes FROM docs GROUP BY 1")
def _(spark, sf):
    """Documents written out as text files per source, then scanned back from the directory."""
    path = scratch_path(spark, "scan")
    v.docs(spark, sf).select("source", F.col("content").alias("value")).write.partitionBy("source").text(path)
    scanned = co.doc_scan(spark, path, extensions=[".txt"])
    return scanned.groupBy(md.parent(F.col("rel_path")).alias("dir")).agg(F.sum("size_bytes").alias("bytes"))


_PATHS = "paths AS (SELECT source, CASE doc_id % 9 WHEN 0 THEN 'node_modules/' WHEN 1 THEN '.hidden/' ELSE '' END || CASE WHEN doc_id % 8 = 0 THEN replace(rel_path, '.md', '.PY') ELSE rel_path END AS rel_path FROM docs)"


def _paths(spark, sf):
    i = F.col("doc_id")
    lead = F.when(i % 9 == 0, "node_modules/").when(i % 9 == 1, ".hidden/").otherwise("")
    path = F.when(i % 8 == 0, F.replace("rel_path", F.lit(".md"), F.lit(".PY"))).otherwise(F.col("rel_path"))
    return v.docs(spark, sf).select("source", F.concat(lead, path).alias("rel_path"))


@query("src02_extension_filter", f"WITH {_PATHS} SELECT rel_path FROM paths WHERE lower(regexp_extract(rel_path, '(\\.[^./]+)$', 1)) IN ('.md', '.mdx', '.rst', '.txt')")
def _(spark, sf):
    return _paths(spark, sf).select("rel_path").where(md.extension(F.col("rel_path")).isin(co.EXTENSIONS))


@query("src03_ignore_filter", f"WITH {_PATHS} SELECT rel_path FROM paths WHERE NOT list_has_any(string_split(rel_path, '/'), ['node_modules', '__pycache__', '.git', '.venv'])")
def _(spark, sf):
    return _paths(spark, sf).select("rel_path").where(~md.ignored(F.col("rel_path"), co.IGNORED))


_DIRS = f"""{_PATHS}, vis AS (SELECT regexp_replace(rel_path, '/[^/]*$', '') AS d, regexp_extract(rel_path, '([^/]*)$', 1) AS name FROM paths WHERE NOT starts_with(rel_path, '.hidden')),
di AS (SELECT DISTINCT CASE WHEN starts_with(d, 'en') THEN regexp_replace(substr(d, 3), '^/+', '') ELSE d END AS dir, name FROM vis)"""


@query("src04_dir_index", f"WITH {_DIRS} SELECT dir, count(*) AS n, string_agg(name, ',' ORDER BY name) AS files FROM di GROUP BY 1")
def _(spark, sf):
    """Directory index; folding names is safe here because test directories are small."""
    idx = co.dir_index(_paths(spark, sf), "en")
    return idx.groupBy("dir").agg(t.n_rows().alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("files"))


@query(
    "agg17_listing_stats",
    f"""WITH {_DIRS}, per AS (SELECT dir || ':{{' || string_agg(name, ',' ORDER BY name) || '}}' AS s FROM di GROUP BY dir)
SELECT lower(regexp_extract(name, '(\\.[^./]+)$', 1)) AS ext, count(*) AS files, (SELECT count(*) FROM per) AS directories,
(SELECT CAST(sum(strlen(s)) + count(*) - 1 AS BIGINT) FROM per) AS listing_bytes FROM di GROUP BY 1""",
)
def _(spark, sf):
    return co.listing_stats(co.dir_index(_paths(spark, sf), "en"))


@query("agg18_corpus_tokens", "SELECT source, CAST(sum(coalesce(token_count, 0)) AS BIGINT) AS total_tokens, count(*) AS files FROM docs GROUP BY 1")
def _(spark, sf):
    return v.docs(spark, sf).groupBy("source").agg(F.sum(F.coalesce("token_count", F.lit(0))).alias("total_tokens"), t.n_rows().alias("files"))


# ---- text functions ------------------------------------------------------
@query("txt28_summaries", f"SELECT doc_id, {BRIEF} AS brief, {FIRST} AS first, {FLAT} AS flat FROM docs")
def _(spark, sf):
    c = F.col("content")
    return v.docs(spark, sf).select(
        "doc_id", md.brief_summary(c).alias("brief"), md.summarise(c).alias("first"), md.content_summary(c).alias("flat")
    )


@query(
    "txt29_escape_and_quote",
    f"""WITH s AS (SELECT doc_id, replace(content, '|', '\\|') AS escaped, replace({FIRST}, chr(10), ' ') AS x FROM docs)
SELECT doc_id, escaped, CASE WHEN {YAML_PLAIN} THEN x ELSE '''' || replace(x, '''', '''''') || '''' END AS scalar FROM s""",
)
def _(spark, sf):
    c = F.col("content")
    return v.docs(spark, sf).select("doc_id", md.escape_pipe(c).alias("escaped"), md.yaml_scalar(md.summarise(c)).alias("scalar"))


per_doc("txt30_compress_markdown", COMPRESS, md.compress_markdown)

_STATE = "st AS (SELECT source, rel_path, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE content_hash END AS content_hash FROM docs WHERE doc_id % 3 <> 0)"
_NOTED = f"'<!-- LLM tagging would be applied here (model: default) -->' || chr(10) || {COMPRESS}"


def _state(spark, sf):
    i = F.col("doc_id")
    return v.docs(spark, sf).where(i % 3 != 0).select(
        "source", "rel_path", F.when(i % 4 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash")
    )


KEYS = ["source", "rel_path"]


@query(
    "txt31_transform_steps",
    f"""WITH {_STATE}, d AS (SELECT d.source, d.rel_path, s.rel_path IS NOT NULL AS same, content, {_NOTED} AS n FROM docs d LEFT JOIN st s ON s.source = d.source AND s.rel_path = d.rel_path AND s.content_hash = d.content_hash)
SELECT source, rel_path, CASE WHEN same THEN content ELSE n END AS content, sha256(CASE WHEN same THEN content ELSE n END) AS content_hash,
CAST(strlen(CASE WHEN same THEN content ELSE n END) AS BIGINT) AS size_bytes, CASE WHEN same THEN 'unchanged' ELSE 'algorithmic+llm/tagged' END AS strategy FROM d""",
)
def _(spark, sf):
    out, _state_after = co.transform_docs(v.docs(spark, sf), ["algorithmic", "llm/tagged"], _state(spark, sf), KEYS)
    return out


@query("txt31_transform_state", "SELECT source, rel_path, content_hash FROM docs")
def _(spark, sf):
    _out, after = co.transform_docs(v.docs(spark, sf), ["algorithmic"], _state(spark, sf), KEYS)
    return after


@query("udf07_custom_step", f"SELECT source, rel_path, sha256(replace({COMPRESS}, 'e', 'E')) AS content_hash FROM docs")
def _(spark, sf):
    co.register_step("shout", lambda c: F.replace(c, F.lit("e"), F.lit("E")))
    out, _after = co.transform_docs(v.docs(spark, sf), ["algorithmic", "shout"], None, KEYS)
    return out.select("source", "rel_path", "content_hash")


TIER_GLOBS = [("core", ["en/src?/*.md", "**/doc_1*.md"]), ("deep", ["de/**", "*/src1*/**/*.md"]), ("rest", [])]


@query(
    "txt32_assign_tiers",
    """SELECT doc_id, rel_path, CASE WHEN regexp_full_match(rel_path, 'en/src[^/]/[^/]*\\.md') OR regexp_full_match(rel_path, '(.+/)?doc_1[^/]*\\.md') THEN 'core'
WHEN starts_with(rel_path, 'de') OR regexp_full_match(rel_path, '[^/]*/src1[^/]*(/.+)?/?[^/]*\\.md') THEN 'deep' ELSE 'rest' END AS tier FROM docs""",
)
def _(spark, sf):
    return v.docs(spark, sf).select("doc_id", "rel_path", md.assign_tier(F.col("rel_path"), TIER_GLOBS).alias("tier"))


@query("txt33_extract_section", "SELECT doc_id, CASE WHEN len(string_split(rel_path, '/')) > 2 THEN string_split(rel_path, '/')[2] ELSE '' END AS section FROM docs")
def _(spark, sf):
    return v.docs(spark, sf).select("doc_id", md.extract_section(F.col("rel_path")).alias("section"))


@query(
    "txt34_auto_tier",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'required' WHEN 1 THEN 'reference' WHEN 2 THEN 'required' ELSE 'recommended' END AS tier FROM docs""",
)
def _(spark, sf):
    i = F.col("doc_id")
    path = F.concat(F.when(i % 4 == 0, "Getting-Started.md/api/").when(i % 4 == 1, "my-api_notes/setup/").when(i % 4 == 2, "x/post_install.txt/").otherwise("guide/"), "doc_id", F.lit(".md"))
    return v.docs(spark, sf).select("doc_id", md.auto_tier(path).alias("tier"))


per_doc("txt35_detect_version", VERSION, md.detect_version)
per_doc("txt36_detect_deprecated", DEPRECATED, md.is_deprecated)


@query("txt37_build_tags", f"SELECT doc_id, {TAGS} AS tags FROM docs")
def _(spark, sf):
    tags = md.build_tags(F.col("tier"), F.col("section"), F.col("content"))
    return v.docs(spark, sf).select("doc_id", F.array_join(tags, ", ").alias("tags"))


@query("txt38_split_sections", f"WITH {SECTION_CTE} SELECT doc_id, g AS pos, name, summary FROM sections")
def _(spark, sf):
    d = v.docs(spark, sf).select("doc_id", F.posexplode(md.split_sections(F.col("content"))).alias("pos", "s"))
    return d.select("doc_id", (F.col("pos") + 1).alias("pos"), "s.name", "s.summary")


@query("txt39_split_definitions", f"SELECT doc_id, s.name AS name, s.kind AS kind, count(*) AS n FROM (SELECT doc_id, unnest({DEFS}) AS s FROM docs) GROUP BY ALL")
def _(spark, sf):
    d = v.docs(spark, sf).select("doc_id", F.inline(md.split_definitions(F.col("content"))))
    return d.groupBy("doc_id", "name", "kind").agg(t.n_rows().alias("n"))


@query("txt40_restructure", f"WITH {RESTRUCTURE_CTE} SELECT doc_id, r AS value FROM restructured")
def _(spark, sf):
    return v.docs(spark, sf).select("doc_id", md.restructure(F.col("content")).alias("value"))


@query("txt41_leads_and_first_lines", f"SELECT doc_id, {LEADS} AS leads, {FIRST20} AS first_lines FROM docs")
def _(spark, sf):
    c = F.col("content")
    return v.docs(spark, sf).select("doc_id", md.paragraph_leads(c).alias("leads"), md.first_lines(c).alias("first_lines"))


per_doc("txt43_content_hash", "sha256(content)", lambda c: F.sha2(c, 256))


# ---- joins ---------------------------------------------------------------
@query(
    "join08_index_drift",
    """WITH a AS (SELECT source, rel_path, content_hash FROM docs WHERE doc_id % 10 <> 0), b AS (SELECT source, rel_path, CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE content_hash END AS h FROM docs WHERE doc_id % 11 <> 0)
SELECT coalesce(a.source, b.source) AS source, coalesce(a.rel_path, b.rel_path) AS rel_path, CASE WHEN b.h IS NULL THEN 'missing' WHEN a.rel_path IS NULL THEN 'extra' ELSE 'stale' END AS drift
FROM a FULL JOIN b ON a.source = b.source AND a.rel_path = b.rel_path WHERE a.rel_path IS NULL OR b.h IS NULL OR a.content_hash <> b.h""",
)
def _(spark, sf):
    d, i = v.docs(spark, sf), F.col("doc_id")
    present = d.where(i % 11 != 0).withColumn("content_hash", F.when(i % 13 == 0, "x").otherwise(F.col("content_hash")))
    return co.index_drift(d.where(i % 10 != 0), present, KEYS)


@query("join12_incremental_anti", f"WITH {_STATE} SELECT d.source, d.rel_path FROM docs d LEFT JOIN st s ON s.source = d.source AND s.rel_path = d.rel_path AND s.content_hash = d.content_hash WHERE s.rel_path IS NULL")
def _(spark, sf):
    return co.changed_docs(v.docs(spark, sf), _state(spark, sf), KEYS).select(*KEYS)


_STEMS = "stems AS (SELECT source, stem, max(rel_path) AS stem_path FROM docs GROUP BY ALL)"


@query(
    "join11_xref_mentions",
    f"WITH {_STEMS} SELECT d.source, d.rel_path, s.stem, s.stem_path FROM docs d JOIN stems s ON d.source = s.source AND s.stem_path <> d.rel_path AND contains(lower(d.content), s.stem)",
)
def _(spark, sf):
    found = co.mentions(v.docs(spark, sf), whole_word=False).where(F.col("stem_path") != F.col("rel_path"))
    return found.select("source", "rel_path", "stem", "stem_path")


@query(
    "join11_xref_whole_word",
    f"""WITH {_STEMS} SELECT d.source, d.rel_path, s.stem, s.stem_path FROM docs d JOIN stems s ON d.source = s.source AND s.stem_path <> d.rel_path
AND contains(lower(d.content), s.stem) AND regexp_matches(lower(d.content), '(^|[^{WORD_CHARS}])' || s.stem || '($|[^{WORD_CHARS}])')""",
)
def _(spark, sf):
    found = co.mentions(v.docs(spark, sf), whole_word=True).where(F.col("stem_path") != F.col("rel_path"))
    return found.select("source", "rel_path", "stem", "stem_path")


_TASKS = """tk AS (SELECT 't_' || doc_id AS task_id, source, doc_id % 5 AS kind, rel_path, stem FROM docs)"""


def doc_tasks(spark, sf):
    """A task about every document, each with one kind of reference."""
    d = v.docs(spark, sf)
    kind = F.col("doc_id") % 5
    none = F.array().cast("array<string>")
    return d.select(
        F.concat(F.lit("t_"), F.col("doc_id").cast("string")).alias("task_id"),
        "source",
        F.when(kind == 0, F.array(F.col("rel_path"), F.lit("gone.md"))).otherwise(none).alias("expected_files"),
        F.when(kind == 1, F.create_map("rel_path", "stem")).otherwise(F.create_map().cast("map<string,string>")).alias("files"),
        F.when(kind == 2, F.array(F.lit("nothing.md"), F.concat(F.substring("stem", 3, 50), F.lit(".md")))).otherwise(none).alias("source_names"),
        F.when(kind == 3, F.col("rel_path")).alias("nearest_doc"),
    )


_RELEVANT = f"""{_TASKS}, nm AS (SELECT task_id, min(d.rel_path) AS p FROM tk JOIN docs d ON d.source = tk.source AND ends_with(d.rel_path, substr(tk.stem, 3) || '.md') WHERE kind = 2 GROUP BY 1),
rel AS (SELECT task_id, source, 0 AS pos, rel_path FROM tk WHERE kind IN (0, 1, 3) UNION ALL SELECT task_id, source, 1, 'gone.md' FROM tk WHERE kind = 0
UNION ALL SELECT tk.task_id, source, CASE WHEN p IS NOT NULL THEN 0 END, p FROM tk LEFT JOIN nm ON nm.task_id = tk.task_id WHERE kind = 2 UNION ALL SELECT task_id, source, NULL, NULL FROM tk WHERE kind = 4)"""


@query("join10_relevant_docs", f"WITH {_RELEVANT} SELECT task_id, source, CAST(pos AS BIGINT) AS pos, rel_path, rel_path IS NULL AS whole_corpus FROM rel")
def _(spark, sf):
    return co.relevant_docs(doc_tasks(spark, sf), v.docs(spark, sf))


# ---- orders --------------------------------------------------------------
_RANK = "CASE tier WHEN 'required' THEN 0 WHEN 'recommended' THEN 1 WHEN 'reference' THEN 2 ELSE 99 END"


@query(
    "sort01_bluf_sort",
    f"SELECT source, rel_path, row_number() OVER (PARTITION BY source ORDER BY {_RANK}, priority DESC, rel_path) AS pos FROM docs",
)
def _(spark, sf):
    d = v.docs(spark, sf).select("source", "rel_path", rd.bluf_key().alias("k"))
    return rd.ordinals(d, ["source"], ["k"], "pos").drop("k")


@query(
    "sort02_edges_sort",
    """WITH r AS (SELECT source, rel_path, row_number() OVER (PARTITION BY source ORDER BY rel_path) AS i, count(*) OVER (PARTITION BY source) AS n FROM docs WHERE tier = 'required')
SELECT d.source, d.rel_path, CAST(CASE WHEN r.i IS NULL THEN 1 WHEN r.i <= ceil(r.n / 2) THEN 0 ELSE 2 END AS BIGINT) AS band FROM docs d LEFT JOIN r ON r.source = d.source AND r.rel_path = d.rel_path""",
)
def _(spark, sf):
    return rd.edges_bands(v.docs(spark, sf)).select("source", "rel_path", F.col("_band").alias("band"))


@query(
    "sort03_seeded_shuffle",
    "SELECT source, rel_path, row_number() OVER (PARTITION BY source ORDER BY md5('42/' || rel_path), rel_path) AS pos FROM docs",
)
def _(spark, sf):
    d = v.docs(spark, sf).select("source", "rel_path", rd.shuffle_key().alias("k"))
    return rd.ordinals(d, ["source"], ["k", "rel_path"], "pos").drop("k")
