"""Queries for task files and question-set conversions, on raw tables shaped from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark import views as v
from trialspark.functions.markdown import brief_summary
from trialspark.plans.base_sql import words_sql
from trialspark.plans.corpus import BRIEF
from trialspark.plans.registry import query
from trialspark.sources import conversions as cv
from trialspark.sources import tasks as tk


def raw(spark, sf):
    """Documents with their first line as a title ``q``; ``seq`` is the input order."""
    d = v.docs(spark, sf)
    return d.select(
        F.col("doc_id").alias("seq"), "doc_id", "stem", "section", "source", "content", "rel_path",
        brief_summary(F.col("content")).alias("q"),
    )


_RAW = f"raw AS (SELECT doc_id, stem, section, source, content, rel_path, {BRIEF} AS q FROM docs)"


def num(prefix, where="true", order="doc_id"):
    """Numbered ids in SQL: place after filtering, at least three digits."""
    place = f"row_number() OVER (ORDER BY {order}) - 1"
    return f"numbered AS (SELECT *, '{prefix}' || CASE WHEN {place} < 1000 THEN lpad(CAST({place} AS VARCHAR), 3, '0') ELSE CAST({place} AS VARCHAR) END AS task_id FROM raw WHERE {where})"


def tokens(x):
    return f"len({words_sql(x)})"


def joined(a, f, sep="|"):
    return F.array_join(F.transform(a, f), sep)


# ---- task files ----------------------------------------------------------
def _yaml_text():
    """Task files as text: every ninth is broken, every seventh has a bad domain, ids repeat now and then."""
    i = F.col("doc_id")
    head = F.concat(F.lit("task_id: retrieval_"), F.when(i % 50 == 0, F.lit(0)).otherwise(i).cast("string"), F.lit("\ntype: retrieval\nquestion: "), "q")
    tail = F.concat(
        F.lit("\ndomain: "), F.when(i % 7 == 0, "nowhere").otherwise("library_docs"),
        F.lit("\ndifficulty: easy\ntags: [a, b]\nmetadata:\n  expected_files: ['"), "rel_path", F.lit("']\n"),
    )
    return F.when(i % 9 == 0, F.lit("{broken: [")).otherwise(F.concat(head, tail))


def _files(spark, sf):
    r = raw(spark, sf).withColumn("q", F.regexp_replace("q", r"[^\p{L} ]", ""))
    return r.select(F.col("rel_path").alias("path"), _yaml_text().alias("text"))


@query(
    "src05_task_ingest",
    """SELECT rel_path AS path, 'retrieval_' || CASE WHEN doc_id % 50 = 0 THEN 0 ELSE doc_id END AS task_id, 'retrieval' AS type,
CASE WHEN doc_id % 7 = 0 THEN 'nowhere' ELSE 'library_docs' END AS domain, rel_path AS expected_files FROM docs WHERE doc_id % 9 <> 0""",
)
def _(spark, sf):
    t = tk.task_ingest(_files(spark, sf))
    return t.select("path", "task_id", "type", "domain", F.array_join("metadata.expected_files", ",").alias("expected_files"))


@query(
    "src06_task_validate",
    """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 'Bad-' || doc_id ELSE 'multi_hop_' || doc_id END AS task_id, CASE WHEN doc_id % 7 = 0 THEN 'essay' ELSE 'multi_hop' END AS type, section FROM docs)
SELECT task_id, concat_ws(',', CASE WHEN doc_id % 8 = 0 THEN 'task_id' END, CASE WHEN doc_id % 7 = 0 THEN 'type' END, CASE WHEN section = 'fr' THEN 'domain' END, CASE WHEN doc_id % 5 = 0 THEN 'difficulty' END) AS reasons FROM t""",
)
def _(spark, sf):
    i = F.col("doc_id")
    t = raw(spark, sf).select(
        F.when(i % 8 == 0, F.concat(F.lit("Bad-"), i.cast("string"))).otherwise(F.concat(F.lit("multi_hop_"), i.cast("string"))).alias("task_id"),
        F.when(i % 7 == 0, "essay").otherwise("multi_hop").alias("type"),
        F.when(F.col("section") == "fr", "nowhere").otherwise("library_docs").alias("domain"),
        F.when(i % 5 != 0, "hard").alias("difficulty"),
    )
    return tk.task_validate(t).select("task_id", F.array_join("reasons", ",").alias("reasons"))


@query("src07_task_duplicates", "SELECT 'retrieval_0' AS task_id, count(*) AS n FROM docs WHERE doc_id % 50 = 0")
def _(spark, sf):
    i = F.col("doc_id")
    ids = F.concat(F.lit("retrieval_"), F.when(i % 50 == 0, F.lit(0)).otherwise(i).cast("string"))
    return tk.task_duplicates(raw(spark, sf).select(ids.alias("task_id")))


# ---- conversions ---------------------------------------------------------
def _ambig(spark, sf):
    i = F.col("doc_id")
    pair = lambda q, a: F.struct(q.alias("question"), a.alias("answer"))
    none = F.array().cast("array<string>")
    pairs = F.array(pair(F.concat(F.lit("is it "), "stem"), F.array("section", "stem")), pair(F.lit("or not"), none))
    return raw(spark, sf).select(
        "seq", F.concat(F.lit("r"), F.floor(i / 3).cast("string")).alias("id"), F.col("q").alias("question"),
        F.when(i % 4 != 0, pairs).otherwise(F.array().cast(pairs_type())).alias("qaPairs"),
    )


def pairs_type():
    return "array<struct<question:string,answer:array<string>>>"


@query(
    "src12_conv_ambigqa",
    f"WITH {_RAW}, {num('ambigqa_disambiguation_', 'doc_id % 4 <> 0')} SELECT task_id, q AS question, 'interpretation_0=is it ' || stem || ': ' || section || '|interpretation_1=or not: unknown' AS options, 'interpretation_0' AS expected FROM numbered",
)
def _(spark, sf):
    t = cv.ambigqa_tasks(_ambig(spark, sf))
    return t.select("task_id", "question", joined("interpretations", lambda o: F.concat_ws("=", o["label"], o["answer"])).alias("options"), F.col("expected_interpretation").alias("expected"))


@query(
    "src12_conv_ambigqa_docs",
    f"""WITH {_RAW}, l AS (SELECT doc_id // 3 AS r, max(doc_id) AS doc_id FROM raw GROUP BY 1), d AS (SELECT 'ambigqa/r' || r || '.md' AS rel_path,
'# ' || q || chr(10) || CASE WHEN raw.doc_id % 4 <> 0 THEN chr(10) || '- is it ' || stem || ': ' || section || ', ' || stem || chr(10) || '- or not: ' ELSE '' END AS content FROM l JOIN raw ON raw.doc_id = l.doc_id)
SELECT rel_path, content, {tokens('content')} AS token_count FROM d""",
)
def _(spark, sf):
    return cv.ambigqa_docs(_ambig(spark, sf)).select("rel_path", "content", "token_count")


def _bigcode(spark, sf):
    return raw(spark, sf).select(
        "seq", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("q")).alias("instruct_prompt"), F.col("stem").alias("complete_prompt"),
        F.array("section", "stem").alias("libs"), F.col("content").alias("canonical_solution"),
    )


@query(
    "src13_conv_bigcodebench",
    f"""WITH {_RAW}, {num('bigcodebench_compositional_')} SELECT task_id, CASE WHEN doc_id % 3 = 0 OR q = '' THEN stem ELSE q END AS question,
'How would you use the ' || section || ' library for this task?|How would you use the ' || stem || ' library for this task?' AS sub_questions, 'code,compositional,' || section || ',' || stem AS tags FROM numbered""",
)
def _(spark, sf):
    t = cv.bigcodebench_tasks(_bigcode(spark, sf))
    return t.select("task_id", "question", F.array_join("sub_questions", "|").alias("sub_questions"), F.array_join("tags", ",").alias("tags"))


@query(
    "src13_conv_bigcodebench_docs",
    """WITH e AS (SELECT doc_id, unnest([section, stem]) AS lib, content FROM docs), f AS (SELECT lib, arg_min(content, doc_id) AS c FROM e GROUP BY 1)
SELECT 'bigcodebench/' || lib || '/api.md' AS rel_path, '# ' || lib || ' API' || chr(10) || chr(10) || 'Library used in compositional tasks.' || chr(10) || chr(10) || c[1:500] AS content, lib || ' library documentation' AS summary FROM f""",
)
def _(spark, sf):
    return cv.bigcodebench_docs(_bigcode(spark, sf)).select("rel_path", "content", "summary")


def _titled(spark, sf):
    """Two linked documents per row, one without a title; every third row has none."""
    doc = lambda t, x: F.struct(t.alias("title"), x.alias("text"))
    pair = F.array(doc(F.concat_ws(".", "section", "stem"), F.col("content")), doc(F.lit(""), F.lit("untitled")))
    none = F.array().cast("array<struct<title:string,text:string>>")
    return raw(spark, sf).select(
        "seq", F.col("q").alias("prompt"), F.when(F.col("doc_id") % 3 == 0, none).otherwise(pair).alias("docs"),
        F.array(F.lit("assert a"), F.col("stem")).alias("test"),
    )


@query(
    "src14_conv_code_rag",
    f"WITH {_RAW}, {num('coderagbench_retrieval_', 'doc_id % 3 <> 0')} SELECT task_id, q AS question, 'library-docs/' || section || '/' || stem || '.md' AS expected_files, content[1:200] AS evidence_passage FROM numbered",
)
def _(spark, sf):
    t = cv.code_rag_tasks(_titled(spark, sf))
    return t.select("task_id", "question", F.array_join("expected_files", ",").alias("expected_files"), "evidence_passage")


@query(
    "src14_conv_code_rag_docs",
    f"""WITH c AS (SELECT CASE WHEN doc_id % 2 = 0 THEN section || '.' || stem ELSE stem END AS d, doc_id, content FROM docs), l AS (SELECT d, arg_max(content, doc_id) AS content FROM c GROUP BY 1)
SELECT 'library-docs/' || replace(d, '.', '/') || '.md' AS rel_path, {tokens('content')} AS token_count, CASE WHEN contains(d, '.') THEN string_split(d, '.')[1] ELSE 'general' END AS section,
CASE WHEN contains(content[1:100], '.') THEN string_split(content[1:100], '.')[1] || '.' ELSE content[1:100] END AS summary FROM l""",
)
def _(spark, sf):
    name = F.when(F.col("doc_id") % 2 == 0, F.concat_ws(".", "section", "stem")).otherwise(F.col("stem"))
    corpus = raw(spark, sf).select("seq", name.alias("doc_id"), F.col("content").alias("doc_content"))
    return cv.code_rag_docs(corpus).select("rel_path", "token_count", "section", "summary")


@query(
    "src15_conv_ds1000",
    f"WITH {_RAW}, {num('ds1000_code_generation_')} SELECT task_id, q AS question, 'assert a' || chr(10) || stem AS test, 'eval(,exec(' AS forbidden FROM numbered",
)
def _(spark, sf):
    t = cv.ds1000_tasks(_titled(spark, sf))
    return t.select("task_id", "question", "test", F.array_join("forbidden_patterns", ",").alias("forbidden"))


@query(
    "src15_conv_ds1000_docs",
    f"WITH {_RAW}, f AS (SELECT section || '.' || stem AS t, section, arg_min(content, doc_id) AS content FROM raw WHERE doc_id % 3 <> 0 GROUP BY ALL) SELECT 'ds1000/' || replace(t, '.', '/') || '.md' AS rel_path, content, section, t AS summary FROM f",
)
def _(spark, sf):
    return cv.ds1000_docs(_titled(spark, sf)).select("rel_path", "content", "section", "summary")


def _notes(spark, sf):
    return raw(spark, sf).where(F.col("doc_id") % 2 == 0).select(
        "seq", F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("id"), F.col("stem").alias("title"), F.col("content").alias("text")
    )


@query(
    "src16_conv_techqa",
    f"""WITH {_RAW}, qa AS (SELECT doc_id, q, doc_id - doc_id % 2 AS doc, doc_id % 40 AS s, CASE WHEN doc_id % 5 = 0 THEN 100000000 ELSE doc_id % 40 + 20 END AS e FROM raw WHERE doc_id % 3 <> 0),
k AS (SELECT qa.*, n.stem, n.content FROM qa JOIN raw n ON n.doc_id = qa.doc AND n.doc_id % 2 = 0),
{num('ibmtechqa_fact_extraction_').replace('FROM raw', 'FROM k')} SELECT task_id, 'About ' || doc || ': ' || q AS question, 'n' || doc AS source_location, CASE WHEN s < e AND e <= length(content) THEN substr(content, s + 1, e - s) ELSE stem END AS expected_answer FROM numbered""",
)
def _(spark, sf):
    i = F.col("doc_id")
    doc = (i - i % 2).cast("string")
    qa = raw(spark, sf).select(
        "seq", F.when(i % 3 != 0, "Y").otherwise("N").alias("ANSWERABLE"), F.concat(F.lit("n"), doc).alias("DOCUMENT"),
        (i % 40).cast("int").alias("START_OFFSET"), F.when(i % 5 == 0, 100000000).otherwise(i % 40 + 20).cast("int").alias("END_OFFSET"),
        F.concat(F.lit("About "), doc).alias("QUESTION_TITLE"), F.col("q").alias("QUESTION_TEXT"),
    )
    t = cv.techqa_tasks(qa, _notes(spark, sf).drop("seq"))
    return t.select("task_id", "question", "source_location", "expected_answer")


@query("src16_conv_techqa_docs", f"SELECT 'technotes/n' || doc_id || '.md' AS rel_path, {tokens('content')} AS token_count, stem AS summary FROM docs WHERE doc_id % 2 = 0")
def _(spark, sf):
    return cv.techqa_docs(_notes(spark, sf)).select("rel_path", "token_count", "summary")


def _evidence(spark, sf):
    e = lambda s, f: F.struct(s.alias("source"), f.alias("fact"))
    paper = F.concat(F.lit("paper_"), F.floor(F.col("doc_id") / 12).cast("string"))
    return raw(spark, sf).select("seq", F.col("q").alias("query"), F.array(e(paper, F.col("content")), e(F.lit("x"), F.lit("")), e(F.lit("other"), F.col("stem"))).alias("evidence_list"))


@query(
    "src17_conv_multihop",
    f"WITH {_RAW}, {num('multihoprag_multi_hop_')} SELECT task_id, CASE WHEN content <> '' THEN content || '|' ELSE '' END || stem AS chain, CASE WHEN content <> '' THEN 'Evidence from paper_' || (doc_id // 12) || ': ' || content || '|' ELSE '' END || 'Evidence from other: ' || stem AS steps FROM numbered",
)
def _(spark, sf):
    t = cv.multihop_tasks(_evidence(spark, sf))
    return t.select("task_id", F.array_join("reasoning_chain", "|").alias("chain"), F.array_join("question_decomposition", "|").alias("steps"))


@query(
    "src17_conv_multihop_docs",
    f"""WITH {_RAW}, f AS (SELECT 'paper_' || (doc_id // 12) AS s, content AS fact, doc_id FROM raw WHERE content <> '' UNION ALL SELECT 'other', stem, doc_id FROM raw)
SELECT 'news/' || s || '.md' AS rel_path, CAST(0 AS BIGINT) AS page, string_agg(fact, chr(10) || chr(10) ORDER BY doc_id) AS content, arg_min({tokens('fact')}, doc_id) AS token_count, arg_min(fact[1:100], doc_id) AS summary FROM f GROUP BY 1, 2""",
)
def _(spark, sf):
    return cv.multihop_docs(_evidence(spark, sf), 10_000_000)


def _repliqa(spark, sf):
    i = F.col("doc_id")
    return raw(spark, sf).select(
        "seq", F.col("q").alias("question"), F.when(i % 2 == 0, "UNANSWERABLE").otherwise(F.col("stem")).alias("answer"),
        F.concat(F.lit("p"), F.floor(i / 3).cast("string")).alias("document_id"), F.col("section").alias("document_topic"),
        F.col("rel_path").alias("document_path"), F.col("content").alias("document_extracted"),
    )


@query(
    "src18_conv_repliqa",
    f"WITH {_RAW}, {num('repliqa_negative_', 'doc_id % 2 = 0')} SELECT task_id, q AS question, 'The document covers topic ''' || section || ''' but does not contain information to answer this question.' AS reason, rel_path AS nearest_doc, content[1:200] AS nearest_content FROM numbered",
)
def _(spark, sf):
    return cv.repliqa_tasks(_repliqa(spark, sf)).select("task_id", "question", "reason", "nearest_doc", "nearest_content")


@query(
    "src18_conv_repliqa_docs",
    f"""WITH l AS (SELECT doc_id // 3 AS r, min(doc_id) AS doc_id FROM docs GROUP BY 1) SELECT 'repliqa/' || section || '/p' || r || '.md' AS rel_path, {tokens('content')} AS token_count,
CASE WHEN contains(content[1:100], '.') THEN string_split(content[1:100], '.')[1] || '.' ELSE content[1:100] END AS summary FROM l JOIN docs USING (doc_id)""",
)
def _(spark, sf):
    return cv.repliqa_docs(_repliqa(spark, sf)).select("rel_path", "token_count", "summary")


def _swe(spark, sf):
    i = F.col("doc_id")
    return raw(spark, sf).select(
        "seq", F.concat(F.lit("inst-"), i.cast("string")).alias("instance_id"), F.concat_ws("/", "section", "source").alias("repo"), F.col("content").alias("problem_statement"),
        F.when(i % 4 == 0, "").otherwise(F.col("content")).alias("hints_text"),
        F.when(i % 5 == 0, "[oops").otherwise(F.concat(F.lit('["test_'), "stem", F.lit('", "test_b"]'))).alias("FAIL_TO_PASS"), F.lit("[]").alias("PASS_TO_PASS"),
    )


@query(
    "src19_conv_swe_bench",
    f"""WITH {_RAW}, {num('swebench_agentic_')} SELECT task_id, section || '/' || source || '/docs/README.md=Repository documentation for ' || section || '/' || source ||
CASE WHEN doc_id % 4 <> 0 THEN '|' || section || '/' || source || '/hints.md=' || content[1:200] ELSE '' END AS files, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'test_' || stem || ',test_b' END AS fail_to_pass, 'swe-bench,agentic,' || section AS tags FROM numbered""",
)
def _(spark, sf):
    t = cv.swe_tasks(_swe(spark, sf))
    return t.select(
        "task_id", joined(F.map_entries("files"), lambda e: F.concat_ws("=", e["key"], e["value"])).alias("files"),
        F.array_join("fail_to_pass", ",").alias("fail_to_pass"), F.array_join("tags", ",").alias("tags"),
    )


@query(
    "src19_conv_swe_bench_docs",
    f"WITH {_RAW} SELECT 'swe-bench/inst-' || doc_id || '.md' AS rel_path, '# inst-' || doc_id || chr(10) || chr(10) || 'Repository: ' || section || '/' || source || chr(10) || chr(10) || content AS content, section, content[1:100] AS summary FROM raw",
)
def _(spark, sf):
    return cv.swe_docs(_swe(spark, sf)).select("rel_path", "content", "section", "summary")


def _wiki(spark, sf):
    title = F.concat(F.lit("Article on "), "stem")
    return raw(spark, sf).select("seq", title.alias("article_title"), F.col("content").alias("statement_1"), F.col("stem").alias("statement_2"), F.col("section").alias("section_1"), F.col("source").alias("section_2"))


@query(
    "src20_conv_wikicontradict",
    f"""WITH {_RAW}, {num('wikicontradict_conflicting_')} SELECT task_id, 'The article ''Article on ' || stem || ''' contains contradicting claims: ''' || content || ''' vs ''' || stem || '''. Which is correct?' AS question,
'Article on ' || stem || ' (' || section || ')=' || content || '|Article on ' || stem || ' (' || source || ')=' || stem AS sources FROM numbered""",
)
def _(spark, sf):
    t = cv.wikicontradict_tasks(_wiki(spark, sf))
    return t.select("task_id", "question", joined("sources", lambda s: F.concat_ws("=", s["name"], s["claim"])).alias("sources"))


@query(
    "src20_conv_wikicontradict_docs",
    f"WITH {_RAW}, f AS (SELECT stem, arg_min(content, doc_id) AS q FROM raw GROUP BY 1) SELECT 'wikicontradict/Article_on_' || stem || '.md' AS rel_path, '# Article on ' || stem || chr(10) || chr(10) || q || chr(10) || chr(10) || stem AS content FROM f",
)
def _(spark, sf):
    return cv.wikicontradict_docs(_wiki(spark, sf)).select("rel_path", "content")


# ---- derived tasks -------------------------------------------------------
def _base_tasks(spark, sf):
    i = F.lpad(F.col("doc_id").cast("string"), 9, "0")
    return raw(spark, sf).select(
        F.concat(F.lit("fact_"), i).alias("task_id"), F.col("content").alias("question"), F.col("content").alias("expected_answer"), F.array("stem").alias("answer_aliases")
    )


_DRAW = "CAST(('0x' || md5('42/' || base || '/{0}')[1:8]) AS BIGINT)"
_PERTURBED = """CASE
WHEN kind IN ('typo', 'char_swap') THEN CASE WHEN n < 2 THEN content WHEN size > 2 THEN array_to_string(list_transform(w, lambda x, k: CASE WHEN k = i THEN x[1:sw - 1] || x[sw + 1] || x[sw] || x[sw + 2:] ELSE x END), ' ') ELSE joined END
WHEN kind = 'char_delete' THEN CASE WHEN n = 0 THEN content WHEN size > 2 THEN array_to_string(list_transform(w, lambda x, k: CASE WHEN k = i THEN x[1:dr - 1] || x[dr + 1:] ELSE x END), ' ') ELSE joined END
WHEN kind = 'word_swap' THEN CASE WHEN n > 2 THEN array_to_string(list_transform(w, lambda x, k: CASE WHEN k = i THEN w[j] WHEN k = j THEN w[i] ELSE x END), ' ') ELSE joined END
WHEN n = 0 THEN content
ELSE array_to_string(list_transform(w, lambda x, k: CASE WHEN k <> i THEN x WHEN lower(x) = x AND upper(x) <> x THEN upper(replace(x, 'ß', 'ss')) ELSE lower(x) END), ' ') END"""


@query(
    "src21_gen_perturbation",
    f"""WITH {_RAW}, {num('perturbation_robustness_')},
a AS (SELECT *, 'fact_' || lpad(doc_id::VARCHAR, 9, '0') AS base, {words_sql('content')} AS w FROM numbered),
b AS (SELECT *, len(w) AS n, array_to_string(w, ' ') AS joined, (['typo', 'char_swap', 'char_delete', 'word_swap', 'case_change'])[(row_number() OVER (ORDER BY doc_id) - 1) % 5 + 1] AS kind, {_DRAW.format('word')} % greatest(len(w), 1) + 1 AS i FROM a),
c AS (SELECT *, length(w[i]) AS size, (i + {_DRAW.format('other')} % greatest(n - 1, 1)) % greatest(n, 1) + 1 AS j FROM b),
d AS (SELECT *, {_DRAW.format('swap')} % greatest(size - 1, 1) + 1 AS sw, {_DRAW.format('drop')} % greatest(size - 1, 1) + 2 AS dr FROM c)
SELECT task_id, {_PERTURBED} AS question, kind AS perturbation_type, base AS base_task_id, content AS original_question, content AS expected_answer FROM d""",
)
def _(spark, sf):
    return tk.gen_perturbation(_base_tasks(spark, sf)).drop("answer_aliases")


@query(
    "src22_gen_efficiency",
    f"""WITH {_RAW}, {num('syntheticefficiency_efficiency_')}, x AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS n, greatest({tokens('content')} * 2, 10) AS ideal FROM numbered)
SELECT task_id, content AS question, content AS expected_answer, (['tight', 'moderate', 'generous'])[n % 3 + 1] AS budget_tier, ideal AS ideal_token_usage, CAST(greatest(floor(ideal * ([0.5, 1, 2])[n % 3 + 1]), 5) AS BIGINT) AS token_budget FROM x""",
)
def _(spark, sf):
    return tk.gen_efficiency(_base_tasks(spark, sf))


# ---- extension points ----------------------------------------------------
@query("udf04_custom_conversion", f"WITH {_RAW}, {num('house_fact_extraction_', 'doc_id % 2 = 1')} SELECT task_id, q AS question, stem AS expected_answer FROM numbered")
def _(spark, sf):
    """A user mapping registered beside the built-in ones and run by name."""
    cv.register_conversion(
        "house",
        lambda r, limit=None: cv._tasks(r.where(F.col("doc_id") % 2 == 1), "house", "fact_extraction", limit, question=F.col("q"), expected_answer=F.col("stem")),
    )
    return cv.CONVERSIONS["house"]["tasks"](raw(spark, sf)).select("task_id", "question", "expected_answer")
