"""Public question sets mapped to tasks and documents.

Each mapping takes a raw table with a ``seq`` column (input order) and gives
tasks numbered after filtering, or documents.  Raw columns keep the names the
data sets publish.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.functions.text import words
from trialspark.operators import render as rd
from trialspark.sources.tasks import numbered

# Sentences of converted tasks and documents; names in braces are filled in per row.
LIBRARY_BODY = "# {library} API\n\nLibrary used in compositional tasks.\n\n{parts}"
LIBRARY_SUMMARY = "{library} library documentation"
EVIDENCE = "Evidence from {source}: {fact}"
NO_ANSWER = "The document covers topic '{topic}' but does not contain information to answer this question."
REPOSITORY_NOTE = "Repository documentation for {repository}"
REPOSITORY_BODY = "# {instance}\n\nRepository: {repository}\n\n{problem}"
CONTRADICTION_QUESTION = "The article '{title}' contains contradicting claims: '{one}' vs '{two}'. Which is correct?"
CONTRADICTION_RESOLUTION = "These statements from '{title}' contradict each other and require verification against authoritative sources."
CONTRADICTION_SUMMARY = "Contradicting claims about {title}"

CONVERSIONS: dict[str, dict[str, Callable]] = {}


def register_conversion(name: str, tasks: Callable, docs: Callable | None = None) -> None:
    """Add a mapping: functions from raw DataFrames to tasks and documents."""
    CONVERSIONS[name] = {"tasks": tasks, "docs": docs}


def _tasks(raw: DataFrame, name: str, kind: str, limit: int | None, **columns: Column) -> DataFrame:
    out = numbered(raw, ["seq"], f"{name}_{kind}_", limit)
    return out.select(F.col("new_id").alias("task_id"), F.lit(kind).alias("type"), *[c.alias(k) for k, c in columns.items()])


def _docs(df: DataFrame, path: Column, content: Column, tier: str, section: Column, summary: Column, keep: str = "first") -> DataFrame:
    """One document per path: the first (or last) in input order where paths clash."""
    pick = F.min_by if keep == "first" else F.max_by
    cols = F.struct(content.alias("content"), section.alias("section"), summary.alias("summary"))
    rows = df.select(path.alias("rel_path"), "seq", cols.alias("d"))
    one = rows.groupBy("rel_path").agg(pick("d", "seq").alias("d")).select("rel_path", "d.*")
    return one.select(
        "rel_path",
        "content",
        F.octet_length("content").cast("long").alias("size_bytes"),
        F.size(words(F.col("content"))).cast("long").alias("token_count"),
        F.lit(tier).alias("tier"),
        "section",
        "summary",
    )


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _fill(sentence: str, **columns: Column) -> Column:
    """``sentence`` with the names in braces replaced by columns."""
    return F.concat(*[columns[part] if i % 2 else F.lit(part) for i, part in enumerate(re.split(r"\{(\w+)\}", sentence))])


def _or(c: Column, default: str = "") -> Column:
    return F.coalesce(c, F.lit(default))


def _lead(content: Column) -> Column:
    """First sentence of the first hundred characters."""
    head = F.left(content, F.lit(100))
    return F.when(F.contains(head, F.lit(".")), F.concat(F.substring_index(head, ".", 1), F.lit("."))).otherwise(head)


def _before_dot(c: Column) -> Column:
    return F.when(F.contains(c, F.lit(".")), F.substring_index(c, ".", 1)).otherwise("general")


def _dotted(prefix: str, c: Column) -> Column:
    return _say(prefix, F.replace(c, F.lit("."), F.lit("/")), ".md")


def _owner(repo: Column) -> Column:
    return F.substring_index(repo, "/", 1)


# ---- ambiguous questions: id, question, qaPairs array<struct<question, answer array>> ----
def ambigqa_tasks(raw: DataFrame, limit: int | None = None) -> DataFrame:
    pairs = F.col("qaPairs")
    answer = lambda p: _or(F.get(p["answer"], F.lit(0)), "unknown")
    options = F.transform(
        pairs,
        lambda p, i: F.struct(
            _say("interpretation_", i.cast("string")).alias("label"), _say(_or(p["question"]), ": ", answer(p)).alias("answer")
        ),
    )
    some = raw.where(F.size("qaPairs") > 0)
    return _tasks(some, "ambigqa", "disambiguation", limit, question=F.col("question"), interpretations=options, expected_interpretation=F.lit("interpretation_0"))


def ambigqa_docs(raw: DataFrame) -> DataFrame:
    lines = F.transform("qaPairs", lambda p: _say("- ", _or(p["question"]), ": ", F.array_join(p["answer"], ", ")))
    body = F.array_join(F.concat(F.array(_say("# ", F.col("question"), "\n")), lines), "\n")
    return _docs(raw, _say("ambigqa/", F.col("id"), ".md"), body, "reference", F.lit("wikipedia"), F.left("question", F.lit(100)), "last")


# ---- library tasks: instruct_prompt, complete_prompt, libs array, canonical_solution ----
def bigcodebench_tasks(raw: DataFrame, limit: int | None = None) -> DataFrame:
    libs = F.coalesce("libs", F.array().cast("array<string>"))
    each = lambda a, b: F.transform(libs, lambda x: _say(a, x, b))
    prompt = F.coalesce(F.nullif(F.col("instruct_prompt"), F.lit("")), F.col("complete_prompt"), F.lit(""))
    return _tasks(
        raw, "bigcodebench", "compositional", limit,
        question=prompt,
        sub_questions=each("How would you use the ", " library for this task?"),
        expected_answers=each("Use ", " API as shown in the solution."),
        tags=F.concat(F.array(F.lit("code"), F.lit("compositional")), libs),
    )


def bigcodebench_docs(raw: DataFrame) -> DataFrame:
    lib = F.col("lib")
    each = raw.select("seq", F.explode("libs").alias("lib"), F.left("canonical_solution", F.lit(500)).alias("s"))
    body = _fill(LIBRARY_BODY, library=lib, parts=F.col("s"))
    return _docs(each, _say("bigcodebench/", lib, "/api.md"), body, "recommended", lib, _fill(LIBRARY_SUMMARY, library=lib))


# ---- retrieval with library docs: prompt, docs array<struct<title, text>>; corpus: doc_id, doc_content ----
def code_rag_tasks(raw: DataFrame, limit: int | None = None) -> DataFrame:
    titled = F.filter("docs", lambda d: _or(d["title"]) != "")
    some = raw.withColumn("_files", F.transform(titled, lambda d: _dotted("library-docs/", d["title"]))).where(F.size("_files") > 0)
    evidence = F.left(_or(F.get("docs", F.lit(0))["text"]), F.lit(200))
    return _tasks(some, "coderagbench", "retrieval", limit, question=F.col("prompt"), expected_files=F.col("_files"), evidence_passage=evidence)


def code_rag_docs(corpus: DataFrame) -> DataFrame:
    doc, body = F.col("doc_id"), F.col("doc_content")
    return _docs(corpus, _dotted("library-docs/", doc), body, "recommended", _before_dot(doc), _lead(body), "last")


# ---- data science code: prompt, test array, docs, canonical_solution ----
def ds1000_tasks(raw: DataFrame, limit: int | None = None) -> DataFrame:
    return _tasks(
        raw, "ds1000", "code_generation", limit,
        question=F.col("prompt"),
        test=F.array_join(F.coalesce("test", F.array().cast("array<string>")), "\n"),
        forbidden_patterns=F.array(F.lit("eval("), F.lit("exec(")),
    )


def ds1000_docs(raw: DataFrame) -> DataFrame:
    each = raw.select(F.col("seq").alias("_s"), F.posexplode("docs").alias("_p", "d")).where(
        (_or(F.col("d.title")) != "") & (_or(F.col("d.text")) != "")
    )
    each = each.select(F.struct("_s", "_p").alias("seq"), "d.*")
    title = F.col("title")
    return _docs(each, _dotted("ds1000/", title), F.col("text"), "recommended", _before_dot(title), title)


# ---- technical notes: QA records joined with notes (id, title, text) ----
def techqa_tasks(raw: DataFrame, notes: DataFrame, limit: int | None = None) -> DataFrame:
    joined = raw.where(F.col("ANSWERABLE") == "Y").join(notes, raw["DOCUMENT"] == notes["id"])
    s, e, text = F.col("START_OFFSET"), F.col("END_OFFSET"), F.col("text")
    valid = (s >= 0) & (s < e) & (e <= F.length(text))
    answer = F.when(valid, F.substr(text, s + 1, e - s)).otherwise(_or(F.col("title"), "unknown"))
    asked = F.when(_or(F.col("QUESTION_TEXT")) != "", _say(F.col("QUESTION_TITLE"), ": ", F.col("QUESTION_TEXT"))).otherwise(F.col("QUESTION_TITLE"))
    return _tasks(joined, "ibmtechqa", "fact_extraction", limit, question=asked, expected_answer=answer, source_location=F.col("DOCUMENT"))


def techqa_docs(notes: DataFrame) -> DataFrame:
    return _docs(notes, _say("technotes/", F.col("id"), ".md"), F.col("text"), "recommended", F.lit("technotes"), F.left("title", F.lit(100)))


# ---- multi-hop news: query, evidence_list array<struct<source, fact>> ----
def multihop_tasks(raw: DataFrame, limit: int | None = None) -> DataFrame:
    facts = F.filter("evidence_list", lambda e: _or(e["fact"]) != "")
    return _tasks(
        raw, "multihoprag", "multi_hop", limit,
        question=F.col("query"),
        reasoning_chain=F.transform(facts, lambda e: e["fact"]),
        question_decomposition=F.transform(facts, lambda e: _fill(EVIDENCE, source=_or(e["source"], "unknown"), fact=e["fact"])),
    )


def multihop_docs(raw: DataFrame, page_chars: int = 1_000_000) -> DataFrame:
    """Facts of one source appended in input order, in pages so that a huge source stays spread out."""
    each = raw.select("seq", F.posexplode("evidence_list").alias("pos", "e")).where(
        (_or(F.col("e.source")) != "") & (_or(F.col("e.fact")) != "")
    )
    order = F.lpad(F.col("seq").cast("string"), 19, "0")
    path = _say("news/", F.col("e.source"), ".md").alias("rel_path")
    parts = each.select(path, F.inline(F.array(rd.piece(_say("\n\n", F.col("e.fact")), a=order, seq=F.col("pos")))))
    text = rd.pages(parts, ["rel_path"], page_chars).drop("pieces")
    first = each.groupBy(path).agg(F.min_by(F.col("e.fact"), F.struct("seq", "pos")).alias("f"))
    return text.join(first, "rel_path").select(
        "rel_path", "page", "content", F.size(words(F.col("f"))).cast("long").alias("token_count"), F.left("f", F.lit(100)).alias("summary")
    )


# ---- unanswerable questions: question, answer, document_id, document_topic, document_path, document_extracted ----
def repliqa_tasks(raw: DataFrame, limit: int | None = None) -> DataFrame:
    topic = F.col("document_topic")
    reason = _fill(NO_ANSWER, topic=topic)
    return _tasks(
        raw.where(F.col("answer") == "UNANSWERABLE"), "repliqa", "negative", limit,
        question=F.col("question"), expected_answer=F.lit("unanswerable"), reason=reason,
        nearest_doc=F.col("document_path"), nearest_content=F.left("document_extracted", F.lit(200)),
    )


def repliqa_docs(raw: DataFrame) -> DataFrame:
    cols = F.struct("document_topic", "document_extracted", "seq")
    one = raw.groupBy("document_id").agg(F.min_by(cols, "seq").alias("d")).select("document_id", "d.*")
    topic, body = F.col("document_topic"), F.col("document_extracted")
    return _docs(one, _say("repliqa/", topic, "/", F.col("document_id"), ".md"), body, "required", topic, _lead(body))


# ---- repository issues: instance_id, repo, problem_statement, hints_text, FAIL_TO_PASS, PASS_TO_PASS ----
def swe_tasks(raw: DataFrame, limit: int | None = None) -> DataFrame:
    repo, hints = F.col("repo"), _or(F.col("hints_text"))
    listed = lambda c: F.coalesce(F.from_json(F.col(c), "array<string>"), F.array().cast("array<string>"))
    readme = F.create_map(_say(repo, "/docs/README.md"), _fill(REPOSITORY_NOTE, repository=repo))
    hint = F.create_map(_say(repo, "/hints.md"), F.left(hints, F.lit(200)))
    return _tasks(
        raw, "swebench", "agentic", limit,
        question=F.col("problem_statement"),
        files=F.when(hints != "", F.map_concat(readme, hint)).otherwise(readme),
        fail_to_pass=listed("FAIL_TO_PASS"), pass_to_pass=listed("PASS_TO_PASS"),
        tags=F.array(F.lit("swe-bench"), F.lit("agentic"), _owner(repo)),
    )


def swe_docs(raw: DataFrame) -> DataFrame:
    i, repo, problem = F.col("instance_id"), F.col("repo"), F.col("problem_statement")
    body = _fill(REPOSITORY_BODY, instance=i, repository=repo, problem=problem)
    return _docs(raw, _say("swe-bench/", i, ".md"), body, "required", _owner(repo), F.left(problem, F.lit(100)), "last")


# ---- contradicting claims: article_title, statement_1/2, section_1/2 ----
def wikicontradict_tasks(raw: DataFrame, limit: int | None = None) -> DataFrame:
    title, one, two = F.col("article_title"), F.col("statement_1"), F.col("statement_2")
    source = lambda sec, claim: F.struct(
        _say(title, " (", F.col(sec), ")").alias("name"), claim.alias("claim"), F.lit(5).alias("authority")
    )
    return _tasks(
        raw, "wikicontradict", "conflicting", limit,
        question=_fill(CONTRADICTION_QUESTION, title=title, one=one, two=two),
        sources=F.array(source("section_1", one), source("section_2", two)),
        expected_resolution=_fill(CONTRADICTION_RESOLUTION, title=title),
    )


def wikicontradict_docs(raw: DataFrame) -> DataFrame:
    title = F.col("article_title")
    body = _say("# ", title, "\n\n", F.col("statement_1"), "\n\n", F.col("statement_2"))
    path = _say("wikicontradict/", F.replace(title, F.lit(" "), F.lit("_")), ".md")
    return _docs(raw, path, body, "reference", F.lit("wikipedia"), _fill(CONTRADICTION_SUMMARY, title=title))


for _name, _t, _d in (
    ("ambigqa", ambigqa_tasks, ambigqa_docs),
    ("bigcodebench", bigcodebench_tasks, bigcodebench_docs),
    ("code-rag-bench", code_rag_tasks, code_rag_docs),
    ("ds1000", ds1000_tasks, ds1000_docs),
    ("ibm-techqa", techqa_tasks, techqa_docs),
    ("multihop-rag", multihop_tasks, multihop_docs),
    ("repliqa", repliqa_tasks, repliqa_docs),
    ("swe-bench", swe_tasks, swe_docs),
    ("wikicontradict", wikicontradict_tasks, wikicontradict_docs),
):
    register_conversion(_name, _t, _d)
