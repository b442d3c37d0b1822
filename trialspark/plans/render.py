"""Queries that render corpora into index texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark import views as v
from trialspark.operators import corpus as co
from trialspark.operators import render as rd
from trialspark.plans.corpus import (

    _PATHS,
    _RELEVANT,
    _STEMS,
    BRIEF,
    DEFS,
    DEPRECATED,
    FIRST,
    FIRST20,
    FLAT,
    LEADS,
    RESTRUCTURE_CTE,
    SECTION_CTE,
    TAGS,
    VERSION,
    YAML_PLAIN,
    _paths,
    doc_tasks,
)
from trialspark.plans.registry import ORACLES, query

PAGE = 10_000_000
P = "rel_path"
NL = "chr(10)"
_PREP = f"""prep AS (SELECT *, brief AS b0, coalesce(summary, brief) AS bo, coalesce(summary, first) AS fo, CASE WHEN contains(rel_path, '/') THEN regexp_replace(rel_path, '/[^/]*$', '') ELSE '(root)' END AS dir,
  string_split(rel_path, '/')[-1] AS name FROM (SELECT *, {BRIEF} AS brief, {FIRST} AS first, {FLAT} AS flat FROM docs))"""


def flat(line, order="rel_path", sep=NL, where="", frm="prep"):
    """Text per source: lines in order."""
    return f"SELECT source, string_agg({line}, {sep} ORDER BY {order}) AS content FROM {frm} {where} GROUP BY source"


#: variant -> its registered query
CHECKED: dict[str, str] = {}


def rendered(name, sql, ctes="", prep=True):
    """Register a variant; the checking SQL builds the whole text of each corpus at once."""
    key = rendered.key
    heads = [x for x in (_PREP if prep else "", ctes) if x]
    with_ = ("WITH " + ", ".join(heads) + " ") if heads else ""

    CHECKED[name] = f"{key}_{name.replace('-', '_')}"

    @query(CHECKED[name], f"{with_}SELECT source, '{name}' AS variant, CAST(0 AS BIGINT) AS page, content FROM ({sql})" if sql else None)
    def _(spark, sf):
        return rd.render_variants(v.docs(spark, sf), [name], PAGE).drop("pieces")


def at(key):
    rendered.key = key


def digest_sql(content):
    """``operators.render.digests`` of a whole text."""
    block = rd.DIGEST_BLOCK
    part = f"md5(b || ':' || substr({content}, CAST(b * {block} + 1 AS BIGINT), {block}))[1:12]"
    return f"CAST(coalesce(list_sum(list_transform(range(0, (length({content}) + {block - 1}) // {block}), lambda b: ('0x' || {part})::BIGINT)), 0) % {2**61} AS BIGINT)"


at("idx01")
rendered("no-index", "SELECT DISTINCT source, '' AS content FROM docs", prep=False)
rendered("no-docs", flat(f"'- ' || {P} || ' (tier: ' || tier || ', section: ' || section || ')'"))
at("idx04")
rendered("structure-flat", flat(f"'- ' || {P} || ' (' || tier || '): ' || bo"))
at("idx05")
_ENTRY = f"'- ' || {P} || ': ' || b0"
rendered(
    "structure-2tier",
    f"SELECT source, string_agg(s, {NL} || {NL} ORDER BY section) AS content FROM (SELECT source, section, '## ' || section || {NL} || string_agg({_ENTRY}, {NL} ORDER BY {P}) AS s FROM prep GROUP BY source, section) GROUP BY 1",
)
at("idx06")
_CAP = "upper(tier[1:1]) || lower(tier[2:])"
rendered(
    "structure-3tier",
    f"""SELECT source, string_agg(s, {NL} || {NL} ORDER BY section) AS content FROM (SELECT source, section, '## ' || section || {NL} || string_agg(s, {NL} ORDER BY tier) AS s FROM
(SELECT source, section, tier, '### ' || {_CAP} || {NL} || string_agg({_ENTRY}, {NL} ORDER BY {P}) AS s FROM prep GROUP BY source, section, tier) GROUP BY source, section) GROUP BY 1""",
)
at("idx07")
rendered(
    "structure-4tier",
    f"""SELECT source, string_agg(s, {NL} || {NL} ORDER BY section) AS content FROM (SELECT source, section, '## ' || section || {NL} || string_agg(s, {NL} ORDER BY tier) AS s FROM
(SELECT source, section, tier, '### ' || {_CAP} || {NL} || string_agg(s, {NL} ORDER BY dir) AS s FROM
(SELECT source, section, tier, dir, '#### ' || dir || {NL} || string_agg({_ENTRY}, {NL} ORDER BY {P}) AS s FROM prep GROUP BY source, section, tier, dir) GROUP BY source, section, tier) GROUP BY source, section) GROUP BY 1""",
)
at("idx08")
rendered(
    "structure-inline-required",
    flat(f"CASE WHEN tier = 'required' THEN '## ' || {P} || ' [REQUIRED]' || {NL} || content ELSE '- ' || {P} || ' (' || tier || '): ' || b0 END", sep=f"{NL} || {NL}"),
)
at("idx09")
rendered("metadata-path-only", flat(f"'- ' || {P}", frm="docs"), prep=False)
rendered("metadata-with-summary", flat(f"'- ' || {P} || ' — ' || flat"))
rendered("metadata-with-tokens", flat(f"'- ' || {P} || ' [tier: ' || tier || ', ~' || token_count || ' tokens]'"))
at("idx10")
# the stem of every document against every other text of its corpus, as the words of that text
_REL = """wd AS (SELECT DISTINCT source, rel_path AS other, section AS os, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+')) AS w FROM docs),
rp AS (SELECT d.source, d.rel_path, o.rel_path AS other FROM docs d JOIN docs o ON d.source = o.source AND d.section = o.section AND d.rel_path <> o.rel_path
UNION SELECT d.source, d.rel_path, other FROM docs d JOIN wd ON d.source = wd.source AND wd.w = d.stem AND other <> d.rel_path),
rl3 AS (SELECT source, rel_path, array_to_string(list_sort(list(other))[1:3], ', ') AS rel FROM rp GROUP BY ALL)"""
rendered(
    "metadata-with-related",
    flat(f"'- ' || p.{P} || ' — ' || flat || CASE WHEN rel IS NOT NULL THEN '. Related: ' || rel ELSE '' END", order="p.rel_path", frm="prep p LEFT JOIN rl3 ON rl3.rel_path = p.rel_path AND rl3.source = p.source").replace("SELECT source", "SELECT p.source AS source").replace("GROUP BY source", "GROUP BY p.source"),
    _REL,
)
at("idx11")


def esc(x):
    return f"replace({x}, '|', '\\|')"


_CELLS = [esc(P), esc("section"), esc("tier"), "token_count", esc("fo")]
rendered(
    "format-pipe-delimited",
    "SELECT source, 'path|section|tier|tokens|summary' || chr(10) || content AS content FROM (" + flat(" || '|' || ".join(_CELLS)) + ")",
)
rendered(
    "format-markdown-table",
    "SELECT source, '# Documentation Index' || chr(10) || chr(10) || '| Path | Section | Tier | Tokens | Summary |' || chr(10) || '|------|---------|------|--------|---------|' || chr(10) || content AS content FROM ("
    + flat("'| ' || " + " || ' | ' || ".join(_CELLS) + " || ' |'")
    + ")",
)
at("idx12")


def yaml(x):
    x = f"replace({x}, chr(10), ' ')"
    return f"(CASE WHEN {YAML_PLAIN} THEN {{x}} ELSE '''' || replace({{x}}, '''', '''''') || '''' END)".replace("(x,", f"({x},").replace("(x)", f"({x})").replace("{x}", x)


rendered(
    "format-yaml",
    f"SELECT source, 'files:' || {NL} || content AS content FROM ("
    + flat(f"'  - path: ' || {yaml(P)} || {NL} || '    section: ' || {yaml('section')} || {NL} || '    tier: ' || {yaml('tier')} || {NL} || '    tokens: ' || token_count || {NL} || '    summary: ' || {yaml('fo')}")
    + ")",
)
at("idx13")
rendered(
    "format-markdown-list",
    f"""SELECT source, '# Documentation Index' || string_agg({NL} || {NL} || '## ' || section || {NL} || s, '' ORDER BY section) AS content FROM
(SELECT source, section, string_agg('- **' || {P} || '** (' || tier || ', ~' || token_count || ' tokens) — ' || fo, {NL} ORDER BY {P}) AS s FROM prep GROUP BY ALL) GROUP BY 1""",
)
at("idx14")
rendered(
    "format-plain-markdown",
    f"""SELECT source, 'The documentation contains ' || string_agg(CASE WHEN section = 'Guides' THEN 'guides' ELSE section || ' references' END, ' and ' ORDER BY section) || '.' ||
string_agg({NL} || {NL} || 'The ' || section || ' section includes ' || CASE WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[1:-2], ', ') || ', and ' || l[-1] END || '.', '' ORDER BY section) AS content FROM
(SELECT source, section, list(name || ' (' || tier || ') covering ' || fo ORDER BY {P}) AS l FROM prep GROUP BY ALL) GROUP BY 1""",
)
at("idx15")


def two_tier(order):
    return f"""WITH o AS (SELECT *, {order} AS ord FROM prep), s AS (SELECT source, section, min(ord) AS k, string_agg('- ' || {P} || ' (' || tier || ', ~' || token_count || ' tokens) -- ' || fo, {NL} ORDER BY ord) AS s FROM o GROUP BY ALL)
SELECT source, '# Documentation Index' || string_agg({NL} || {NL} || '## ' || section || {NL} || s, '' ORDER BY k) AS content FROM s GROUP BY 1"""


rendered("position-natural", two_tier(P))
rendered(
    "position-bluf",
    two_tier("CASE tier WHEN 'required' THEN '0' WHEN 'recommended' THEN '1' WHEN 'reference' THEN '2' ELSE '9' END || (10 - priority) + 10 || rel_path".replace("(10 - priority) + 10", "CAST(20 - priority AS VARCHAR)")),
)
rendered(
    "position-edges",
    two_tier(
        "CASE WHEN tier <> 'required' THEN '1' WHEN row_number() OVER (PARTITION BY source, tier ORDER BY rel_path) <= ceil(count(*) OVER (PARTITION BY source, tier) / 2) THEN '0' ELSE '2' END || rel_path"
    ),
)
rendered("position-random", two_tier("md5('42/' || rel_path) || rel_path"))
at("idx16")
_BODY = f"'## ' || {P} || {NL} || {NL} || "
_SEP2 = f"{NL} || {NL}"
rendered("transform-passthrough", flat(_BODY + "content", sep=_SEP2, frm="docs"), prep=False)
rendered("transform-algorithmic", flat(_BODY + FIRST20, sep=_SEP2, frm="docs"), prep=False)
rendered("transform-llm-compressed", flat(_BODY + LEADS, sep=_SEP2, frm="docs"), prep=False)
rendered(
    "transform-restructured",
    flat(_BODY + "r", sep=_SEP2, frm="docs JOIN restructured ON docs.doc_id = restructured.doc_id"),
    RESTRUCTURE_CTE,
    prep=False,
)
rendered("transform-tagged", flat(f"'- ' || {P} || ' [' || {TAGS} || ']: ' || b0"))
at("idx17")
for _n in (5, 15, 50, 100, 200):
    rendered(
        f"scale-{_n}",
        flat(f"'- ' || {P} || ' (' || tier || '): ' || b0", frm=f"(SELECT *, row_number() OVER (PARTITION BY source ORDER BY {P}) AS rn FROM prep)", where=f"WHERE rn <= {_n}"),
    )
at("idx18")
rendered("noise-0", flat(_ENTRY))
_STUBS = "[" + ", ".join(f"'{x}'" for x in rd.DISTRACTORS) + "]"
for _n, _extra in ((25, "greatest(1, n // 3)"), (50, "n"), (75, "n * 3")):
    rendered(
        f"noise-{_n}",
        f"SELECT source, string_agg('- ' || path || ': ' || stub, {NL} ORDER BY path) AS content FROM (SELECT source, {P} AS path, b0 AS stub FROM prep UNION ALL FROM stubs) GROUP BY 1",
        f"""stubs AS (SELECT source, 'docs/internal/generated_' || lpad(i::VARCHAR, greatest(3, length(i::VARCHAR))::INT, '0') || '.md' AS path, ({_STUBS})[('0x' || md5('42/' || i)[1:8])::BIGINT % 10 + 1] AS stub
FROM (SELECT source, unnest(range(1, {_extra} + 1)) AS i FROM (SELECT source, count(*) AS n FROM docs GROUP BY 1)))""",
    )


@query(
    "idx18_noise_counts",
    """WITH n AS (SELECT source, count(*) AS n FROM docs GROUP BY 1) SELECT source, 'noise-25' AS variant, n + greatest(1, n // 3) AS lines FROM n
UNION ALL SELECT source, 'noise-50', 2 * n FROM n UNION ALL SELECT source, 'noise-75', 4 * n FROM n""",
)
def _(spark, sf):
    parts = rd.pieces(v.docs(spark, sf), ["noise-25", "noise-50", "noise-75"])
    return parts.groupBy("source", "variant").agg(F.count(F.lit(1)).alias("lines"))


at("idx19")
_SECT = f"ss AS (SELECT doc_id, string_agg('- ' || rel_path || '#' || name || ': ' || s.summary, {NL} ORDER BY g) AS l FROM sections s JOIN (SELECT doc_id, rel_path FROM docs) USING (doc_id) GROUP BY 1)"
_DEFT = f"CASE WHEN len({DEFS}) > 0 THEN array_to_string(list_transform({DEFS}, lambda x: '- ' || {P} || '::' || x.name || ' (' || x.kind || ')'), {NL}) END"
rendered("granularity-file", flat(f"'[FILE] ' || {P} || ': ' || bo"))
_WITH_SS = "prep LEFT JOIN ss ON ss.doc_id = prep.doc_id"
rendered("granularity-section", flat(f"coalesce(l, {_ENTRY})", frm=_WITH_SS), f"{SECTION_CTE}, {_SECT}")
rendered("granularity-function", flat(f"coalesce({_DEFT}, {_ENTRY})"))
rendered(
    "granularity-mixed",
    flat(f"CASE WHEN length(content) < 500 THEN {_ENTRY} WHEN length(content) <= 2000 THEN coalesce(l, {_ENTRY}) ELSE coalesce({_DEFT}, l, {_ENTRY}) END", frm=_WITH_SS),
    f"{SECTION_CTE}, {_SECT}",
)
at("idx20")
_OWN = f"'- ' || {P} || ': ' || bo"
rendered("xref-none", flat(_OWN))
_PEERS = """pe AS (SELECT d.source, d.rel_path, list_sort(list(o.rel_path)) AS l FROM docs d JOIN docs o ON d.source = o.source AND d.section = o.section AND d.rel_path <> o.rel_path GROUP BY ALL)"""
rendered(
    "xref-light",
    f"SELECT p.source AS source, string_agg('- ' || p.rel_path || ': ' || bo || CASE WHEN l IS NOT NULL THEN {NL} || '  See also: ' || array_to_string(l[1:2], ', ') ELSE '' END, {NL} ORDER BY p.rel_path) AS content FROM prep p LEFT JOIN pe ON pe.source = p.source AND pe.rel_path = p.rel_path GROUP BY 1",
    _PEERS,
)
_DENSE = f"""{_STEMS}, {_PEERS}, mn AS (SELECT d.source, d.rel_path AS by_path, s.stem, s.stem_path FROM docs d JOIN stems s ON d.source = s.source AND s.stem_path <> d.rel_path AND contains(lower(d.content), s.stem)),
al AS (SELECT d.source, d.rel_path, string_agg(by_path, ', ' ORDER BY by_path) AS m FROM docs d JOIN mn ON mn.source = d.source AND mn.stem = d.stem LEFT JOIN pe ON pe.source = d.source AND pe.rel_path = d.rel_path
  WHERE NOT coalesce(list_contains(l[1:3], by_path), false) GROUP BY ALL),
rf AS (SELECT source, by_path AS rel_path, string_agg(stem_path, ', ' ORDER BY stem) AS r FROM mn GROUP BY ALL)"""
rendered(
    "xref-dense",
    f"""SELECT p.source AS source, string_agg('- ' || p.rel_path || ': ' || bo || coalesce({NL} || '  See also: ' || concat_ws(', ', array_to_string(l[1:3], ', '), m), '') ||
coalesce({NL} || '  Referenced by: ' || r, ''), {NL} ORDER BY p.rel_path) AS content FROM prep p LEFT JOIN pe ON pe.source = p.source AND pe.rel_path = p.rel_path
LEFT JOIN al ON al.source = p.source AND al.rel_path = p.rel_path LEFT JOIN rf ON rf.source = p.source AND rf.rel_path = p.rel_path GROUP BY 1""".replace(
        f"coalesce({NL} || '  See also: ' || concat_ws(', ', array_to_string(l[1:3], ', '), m), '')",
        f"CASE WHEN l IS NULL AND m IS NULL THEN '' ELSE {NL} || '  See also: ' || concat_ws(', ', array_to_string(l[1:3], ', '), m) END",
    ),
    _DENSE,
)
at("idx21")
for _name, _tag in (
    ("temporal-none", "'no-date'"),
    ("temporal-version", VERSION),
    ("temporal-modified", "'modified: ' || coalesce(strftime(last_modified, '%Y-%m-%d'), 'unknown')"),
    ("temporal-deprecated", f"CASE WHEN {DEPRECATED} THEN 'DEPRECATED' ELSE 'CURRENT' END"),
):
    rendered(_name, flat(f"'- ' || {P} || ' [' || {_tag} || ']: ' || bo"))


# ---- many variants at once -----------------------------------------------
@query(
    "idx00_render_variants",
    f"""WITH {_PREP}, a AS ({flat(_ENTRY)}), b AS ({flat(f"'- ' || {P}", frm='docs')}), c AS ({flat(f"'- ' || {P} || ' (' || tier || '): ' || bo")}),
t AS (SELECT source, 'noise-0' AS variant, content FROM a UNION ALL SELECT source, 'metadata-path-only', content FROM b UNION ALL SELECT source, 'structure-flat', content FROM c)
SELECT source, variant, CAST(length(content) AS BIGINT) AS n_chars, CAST(length(content) // 4 AS BIGINT) AS est_tokens, {digest_sql('content')} AS digest FROM t""",
)
def _(spark, sf):
    """Three variants in one pass, in pages small enough that every text has several."""
    r = rd.render_variants(v.docs(spark, sf), ["noise-0", "metadata-path-only", "structure-flat"], 1000)
    return rd.digests(r).drop("pages")


EVERY = [n for n in rd.VARIANTS if not n.startswith("custom")]


@query("idx00_all_variant_sizes")
def _(spark, sf):
    """Every registered variant of every corpus: sizes and digests of the rendered texts."""
    return rd.piece_digests(rd.listed_pieces(v.docs(spark, sf), EVERY))


ORACLES["idx00_all_variant_sizes"] = " UNION ALL ".join(
    f"SELECT source, variant, CAST(length(content) AS BIGINT) AS n_chars, {digest_sql('content')} AS digest FROM ({ORACLES[CHECKED[n]]})" for n in EVERY
)


@query(
    "idx22_composite",
    f"""WITH {_PREP}, a AS ({flat(f"'- ' || {P} || ' (' || tier || '): ' || bo")}), b AS ({flat(f"'- ' || {P} || ' [no-date]: ' || bo")})
SELECT a.source, 'structure-flat+temporal-none' AS variant, CAST(0 AS BIGINT) AS page, a.content || chr(10) || chr(10) || b.content AS content FROM a JOIN b ON a.source = b.source
UNION ALL SELECT source, 'temporal-none', 0, content FROM b""",
)
def _(spark, sf):
    design = {"both": ["temporal-none", "structure-flat"], "one": ["temporal-none"]}
    return rd.composite(v.docs(spark, sf), design, PAGE).drop("pieces")


# ---- per-task texts ------------------------------------------------------
@query(
    "idx02_oracle",
    f"""WITH {_RELEVANT}, whole AS (SELECT DISTINCT source FROM rel WHERE rel_path IS NULL)
SELECT rel.task_id AS text_id, CAST(NULL AS VARCHAR) AS task_id, CAST(0 AS BIGINT) AS page, string_agg('## ' || d.rel_path || chr(10) || content, chr(10) || chr(10) ORDER BY pos) AS content
FROM rel JOIN docs d ON d.source = rel.source AND d.rel_path = rel.rel_path GROUP BY 1
UNION ALL SELECT 'corpus/' || d.source, NULL, 0, string_agg('## ' || d.rel_path || chr(10) || content, chr(10) || chr(10) ORDER BY d.rel_path) FROM docs d JOIN whole USING (source) GROUP BY d.source
UNION ALL SELECT DISTINCT CASE WHEN rel_path IS NULL THEN 'corpus/' || source ELSE task_id END, task_id, NULL::BIGINT, NULL FROM rel""",
)
def _(spark, sf):
    d = v.docs(spark, sf)
    relevant = co.relevant_docs(doc_tasks(spark, sf), d)
    texts = rd.pages(rd.oracle_texts(relevant, d), ["text_id"], PAGE).drop("pieces")
    return texts.unionByName(rd.oracle_text_ids(relevant), allowMissingColumns=True)


@query(
    "idx03_length_matched_random",
    f"""WITH RECURSIVE {_RELEVANT}, corpus AS (SELECT source, sum(token_count) AS n FROM docs GROUP BY 1),
want AS (SELECT rel.task_id, rel.source, CAST(coalesce(CASE WHEN bool_or(rel.rel_path IS NULL) THEN min(corpus.n) ELSE sum(d.token_count) END, 0) AS BIGINT) AS target
  FROM rel JOIN corpus ON corpus.source = rel.source LEFT JOIN docs d ON d.source = rel.source AND d.rel_path = rel.rel_path GROUP BY ALL),
o AS (SELECT source, rel_path, content, coalesce(token_count, 0) AS tokens, row_number() OVER (PARTITION BY source ORDER BY md5('42/' || rel_path), rel_path) AS i FROM docs),
take AS (SELECT DISTINCT source, target, target AS room, 0::BIGINT AS i, false AS taken FROM want WHERE target > 0
UNION ALL SELECT t.source, target, CASE WHEN o.tokens <= room THEN room - o.tokens ELSE room END, o.i, o.tokens <= room FROM take t JOIN o ON o.source = t.source AND o.i = t.i + 1)
SELECT 'random/' || o.source || '/' || target AS text_id, CAST(NULL AS VARCHAR) AS task_id, CAST(0 AS BIGINT) AS page, string_agg('## ' || rel_path || chr(10) || content, chr(10) || chr(10) ORDER BY o.i) AS content
FROM take JOIN o ON o.source = take.source AND o.i = take.i WHERE taken GROUP BY 1
UNION ALL SELECT 'random/' || source || '/' || target, task_id, NULL::BIGINT, NULL FROM want""",
)
def _(spark, sf):
    d = v.docs(spark, sf)
    wanted = rd.oracle_tokens(co.relevant_docs(doc_tasks(spark, sf), d), d)
    texts = rd.pages(rd.length_matched_texts(wanted, d), ["text_id"], PAGE).drop("pieces")
    return texts.unionByName(wanted.select("task_id", rd.random_text_id().alias("text_id")), allowMissingColumns=True)


# ---- tiered index targets and listings -----------------------------------
_INS = rd.INSTRUCTION
_TI = "CASE tier " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in rd.TIERS.items()) + " END"
_TV = "CASE tier " + " ".join(f"WHEN '{k}' THEN '{x}'" for k, x in rd.TIER_VERBS.items()) + " END"
_TK = "CASE tier WHEN 'required' THEN 0 WHEN 'recommended' THEN 1 ELSE 2 END"
_BLUF = "priority DESC, rel_path"


def _target(key, target, sql):
    @query(f"idx23_{key}", f"WITH {sql}")
    def _(spark, sf):
        return rd.pages(rd.tiered_index(v.docs(spark, sf), target), page_chars=PAGE).drop("pieces")


_target(
    "tiered_index",
    "agents.md",
    f"""o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_TK}, {_BLUF}) AS k FROM docs), s AS (SELECT source, tier, section, min(k) AS k, string_agg(rel_path || {NL}, '' ORDER BY k) AS s FROM o GROUP BY ALL),
t AS (SELECT source, tier, '## ' || {_CAP} || ' [' || {_TI} || ']' || {NL} || {NL} || string_agg('### ' || upper(section[1:1]) || lower(section[2:]) || {NL} || s || {NL}, '' ORDER BY k) AS s FROM s GROUP BY source, tier)
SELECT source, 'agents.md' AS variant, CAST(0 AS BIGINT) AS page, 'IMPORTANT: {_INS}' || {NL} || {NL} || string_agg(s, '' ORDER BY {_TK}) || 'IMPORTANT: {_INS}' || {NL} AS content FROM t GROUP BY 1""",
)
for _key, _name, _title, _lead, _l, _r in (
    ("claude_target", "claude.md", "# Project Documentation", _TV, "- `", "`"),
    ("copilot_target", "copilot-instructions", "# Copilot Instructions", f"'_' || {_TI} || '_'", "- ", ""),
):
    _target(
        _key,
        _name,
        f"""t AS (SELECT source, tier, '## ' || {_CAP} || {NL} || {NL} || {_lead} || {NL} || {NL} || string_agg('{_l}' || rel_path || '{_r}' || {NL}, '' ORDER BY {_BLUF}) || {NL} AS s FROM docs GROUP BY source, tier)
SELECT source, '{_name}' AS variant, CAST(0 AS BIGINT) AS page, '{_title}' || {NL} || {NL} || '{_INS}' || {NL} || {NL} || string_agg(s, '' ORDER BY {_TK}) AS content FROM t GROUP BY 1""",
    )
_target(
    "cursor_target",
    "cursor-rules",
    f"""t AS (SELECT source, tier, string_agg(rel_path, ', ' ORDER BY {_BLUF}) AS g, string_agg('- ' || rel_path || {NL}, '' ORDER BY {_BLUF}) AS l FROM docs GROUP BY ALL)
SELECT source, tier || '-docs.mdc' AS variant, CAST(0 AS BIGINT) AS page, '---' || {NL} || 'description: ' || {_TI} || {NL} || 'globs: ' || g || {NL} || '---' || {NL} || {NL} || '# ' || {_CAP} || ' Documentation' || {NL} || {NL} || l AS content FROM t""",
)


def _listing_sql(name, expanded):
    nl = NL if expanded else "''"
    head = f" || {nl} || ".join(["'<!-- DOCS-START -->'", "'[Docs Index]'", "'|root: ./.docs'", f"'|IMPORTANT: {_INS}'"])
    return f"""WITH {_PATHS}, vis AS (SELECT DISTINCT source, regexp_replace(rel_path, '/[^/]*$', '') AS dir, regexp_extract(rel_path, '([^/]*)$', 1) AS name FROM paths WHERE NOT starts_with(rel_path, '.hidden')),
d AS (SELECT source, dir, '|' || dir || ':{{' || string_agg(name, ',' ORDER BY name) || '}}' || {nl} AS s FROM vis GROUP BY source, dir)
SELECT source, '{name}' AS variant, CAST(0 AS BIGINT) AS page, {head} || {nl} || {nl} || string_agg(s, '' ORDER BY dir) || '<!-- DOCS-END -->' AS content FROM d GROUP BY 1"""


def _listing(spark, sf, expanded):
    paths = _paths(spark, sf)
    visible = paths.where(~F.col("rel_path").startswith("."))
    index = visible.select("source", F.regexp_replace("rel_path", "/[^/]*$", "").alias("dir"), F.substring_index("rel_path", "/", -1).alias("name")).distinct()
    return rd.pages(rd.dir_listing(index, "DOCS", "Docs Index", "./.docs", expanded), page_chars=PAGE).drop("pieces")


@query("idx24_compressed_listing", _listing_sql("compressed", False))
def _(spark, sf):
    return _listing(spark, sf, False)


@query("idx24_expanded_listing", _listing_sql("expanded", True))
def _(spark, sf):
    return _listing(spark, sf, True)


