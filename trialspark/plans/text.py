"""Queries for scorers, metrics, prompts and judge output."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialspark import views as v
from trialspark.functions import fixed_text as fx
from trialspark.functions import scorers as s
from trialspark.functions import text as tx
from trialspark.operators import metrics as mt
from trialspark.plans.base_sql import words_sql
from trialspark.plans.registry import ORACLES, query


def _list(values):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in values) + "]"


STOP = _list(fx.KEYWORD_STOPWORDS)
LOW = "lower(response)"


def kw(x):
    return (
        f"list_filter(list_transform({words_sql(x)}, lambda w: trim(w, '{fx.KEYWORD_TRIM}')), "
        f"lambda w: length(w) >= 3 AND NOT list_contains({STOP}, lower(w)))"
    )


def hits(k, low=LOW):
    return f"len(list_filter({k}, lambda w: contains({low}, lower(w))))"


def cov(k, low=LOW):
    return f"(CASE WHEN len({k}) > 0 THEN {hits(k, low)} / len({k}) ELSE 0.0 END)"


def anyof(phrases, low=LOW):
    return f"len(list_filter({_list(phrases)}, lambda p: contains({low}, p))) > 0"


def scored(name, oracle, *fields):
    """Register a scorer over every case with its SQL expression."""
    sql = f"SELECT case_id, R({oracle}) AS score FROM cases" if oracle else None

    @query(name, sql)
    def _(spark, sf):
        scorer = s.SCORERS[fields[0]]
        return v.cases(spark, sf).select("case_id", scorer(F.col).alias("score"))


# ---- expressions ---------------------------------------------------------
@query(
    "txt01_extract_keywords",
    f"SELECT doc_id, len({kw('content')}) AS n, array_to_string({kw('content')}, ' ') AS keywords FROM docs",
)
def _(spark, sf):
    k = tx.extract_keywords(F.col("content"))
    df = v.docs(spark, sf).select("doc_id", k.alias("k"))
    return df.select("doc_id", F.size("k").alias("n"), F.array_join("k", " ").alias("keywords"))


@query(
    "txt02_keyword_coverage",
    f"SELECT case_id, R({cov(kw('question'))}) AS coverage FROM cases",
)
def _(spark, sf):
    c = tx.keyword_coverage(tx.extract_keywords(F.col("question")), F.lower("response"))
    return v.cases(spark, sf).select("case_id", c.alias("coverage"))


# ---- scorers -------------------------------------------------------------
_EXT = "|".join(fx.PATH_EXTENSIONS)
_PATHS = f"regexp_extract_all(response, '(?i)((?:[{fx.WORD_CHARS}./-]+/)?[{fx.WORD_CHARS}.-]+\\.(?:{_EXT}))', 1)"
_NORM = "lower(rtrim(replace(CASE WHEN starts_with(trim(p), './') THEN substr(trim(p), 3) ELSE trim(p) END, '\\', '/'), '/'))"


@query(
    "txt03_score_retrieval",
    f"""WITH a AS (SELECT case_id, list_distinct(list_transform({_PATHS}, lambda p: {_NORM})) AS got,
  list_distinct(list_transform(expected_files, lambda p: {_NORM})) AS want FROM cases),
b AS (SELECT *, list_filter(want, lambda p: list_contains(got, p)) AS exact FROM a),
c AS (SELECT *, list_transform(list_filter(got, lambda p: NOT list_contains(exact, p)), lambda p: string_split(p, '/')[-1]) AS names,
  list_filter(want, lambda p: NOT list_contains(exact, p)) AS miss FROM b),
d AS (SELECT *, len(exact) + 0.5::DOUBLE * len(list_filter(miss, lambda p: list_contains(names, string_split(p, '/')[-1]))) AS tp FROM c)
SELECT case_id, R(CASE WHEN len(got) = 0 OR tp = 0 THEN 0.0 ELSE 5.0::DOUBLE * (tp / len(got)) * (tp / len(want)) / (4.0::DOUBLE * tp / len(got) + tp / len(want)) END) AS score FROM d""",
)
def _(spark, sf):
    return v.cases(spark, sf).select("case_id", s.SCORERS["retrieval"](F.col).alias("score"))


_IN = f"(contains({LOW}, lower(expected_answer)) OR len(list_filter(answer_aliases, lambda a: contains({LOW}, lower(a)))) > 0)"
_ANSWER = f"CASE WHEN expected_answer = '' THEN 0.0 WHEN {_IN} THEN 1.0 ELSE {cov(kw('expected_answer'))} END"
# Common subsequences in DuckDB: one bit per character of the shorter text in a HUGEINT, which holds 126 of them.
_PLAIN = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]', ' ', 'g'))"
_SETS = "list_distinct(list_filter(string_split({}, ' '), lambda w: w <> ''))"
_BITS = "coalesce(list_sum(list_transform(range(length(a)), lambda i: CASE WHEN substring(a, (i + 1)::BIGINT, 1) = c THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END)), 0)::HUGEINT"
_LCS = f"""(CASE WHEN length(a) > 126 THEN error('over 126 characters') ELSE length(a) - bit_count(list_reduce(
  list_transform(list_filter(string_split(b, ''), lambda c: contains(a, c)), lambda c: {_BITS}),
  lambda r, m: ((r + (r & m)) | (r - (r & m))) & ((1::HUGEINT << length(a)::INT) - 1), (1::HUGEINT << length(a)::INT) - 1)) END)"""
_CLOSE = f"""fa AS (SELECT case_id, {_SETS.format(_PLAIN.format('expected_answer'))} AS x, {_SETS.format(_PLAIN.format('response'))} AS y FROM cases WHERE expected_answer <> '' AND NOT {_IN}),
fb AS (SELECT case_id, len(x) > 0 AND len(y) > 0 AS filled, length(array_to_string(list_intersect(x, y), ' ')) AS n,
  array_to_string(list_sort(list_filter(x, lambda w: NOT list_contains(y, w))), ' ') AS p, array_to_string(list_sort(list_filter(y, lambda w: NOT list_contains(x, w))), ' ') AS q FROM fa),
fc AS (SELECT case_id, filled, n, CASE WHEN length(p) <= length(q) THEN p ELSE q END AS a, CASE WHEN length(p) <= length(q) THEN q ELSE p END AS b FROM fb),
fd AS (SELECT *, CASE WHEN a = '' OR b = '' THEN 0 ELSE {_LCS} END AS l, length(a) + length(b) + 2 * (CASE WHEN n > 0 THEN n + 1 ELSE 0 END) AS whole FROM fc),
fe AS (SELECT case_id, CASE WHEN NOT filled THEN 0 WHEN n > 0 AND a = '' THEN 100 ELSE greatest(100 * (1 - (length(a) + length(b) - 2 * l)::DOUBLE / whole),
  CASE WHEN n > 0 THEN 200 * n::DOUBLE / (2 * n + 1 + length(a)) ELSE 0 END) END AS alike FROM fd)"""


@query(
    "txt04_score_fact",
    f"""WITH {_CLOSE} SELECT c.case_id, R(CASE WHEN alike >= 85 THEN 0.9 WHEN alike >= 70 THEN 0.7 ELSE {_ANSWER} END) AS score
FROM cases c LEFT JOIN fe ON fe.case_id = c.case_id""",
)
def _(spark, sf):
    return v.cases(spark, sf).select("case_id", s.SCORERS["fact_extraction"](F.col).alias("score"))


scored("txt05_score_code", None, "code_generation")
_CODE_HIT = f"coalesce(TRY(regexp_matches(response, p, 'i')), contains({LOW}, lower(p)))"


@query(
    "txt05_code_patterns",
    f"""WITH w AS (SELECT case_id, response, true AS wanted, unnest(list_filter(string_split(test, chr(10)), lambda p: regexp_matches(p, '[^\\s]'))) AS p FROM cases
  UNION ALL SELECT case_id, response, false, unnest(forbidden_patterns) FROM cases),
h AS (SELECT case_id, avg({_CODE_HIT}::INT) FILTER (wanted) AS found, avg({_CODE_HIT}::INT) FILTER (NOT wanted) AS broken FROM w GROUP BY case_id)
SELECT c.case_id, R(coalesce(found, 1)) AS found, R(coalesce(broken, 0)) AS broken FROM cases c LEFT JOIN h ON h.case_id = c.case_id""",
)
def _(spark, sf):
    parts = s.code_parts(*(F.col(c) for c in ("response", "test", "forbidden_patterns")))
    return v.cases(spark, sf).select("case_id", parts.alias("p")).select("case_id", "p.found", "p.broken")


@query("txt04_fact_exact_layers", f"SELECT case_id, {_IN} AS exact, R({_ANSWER}) AS score FROM cases")
def _(spark, sf):
    args = (F.col("response"), F.col("expected_answer"), F.col("answer_aliases"))
    return v.cases(spark, sf).select(
        "case_id", s.contained(*args).alias("exact"), s.score_answer(*args).alias("score")
    )


_TOOLS = _list(fx.TOOL_NAMES)
_MENTIONED = f"list_distinct(regexp_extract_all({LOW}, '\\b({'|'.join(fx.TOOL_NAMES)})\\b', 1))"
_FOUND = f"list_filter(expected_tools, lambda n: contains({LOW}, n))"
_TOOL_CTE = f"""tl AS (SELECT *, {_FOUND} AS found, list_transform({_FOUND}, lambda n: instr({LOW}, n)) AS places, {_MENTIONED} AS mentioned FROM cases),
tu AS (SELECT *, CASE WHEN len(found) = 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE * len(found) / len(expected_tools) + 0.3::DOUBLE * (places = list_sort(places))::INT
  + 0.2::DOUBLE * (CASE WHEN len(mentioned) > 0 THEN 1 - len(list_filter(mentioned, lambda m: NOT list_contains(expected_tools, m))) / len(mentioned) ELSE 1 END) END AS usage FROM tl)"""


@query("txt07_tool_usage", f"WITH {_TOOL_CTE} SELECT case_id, R(usage) AS usage FROM tu")
def _(spark, sf):
    return v.cases(spark, sf).select(
        "case_id", s.tool_usage(F.col("response"), F.col("expected_tools")).alias("usage")
    )


_NOTES = f"flatten(list_transform(map_values(files), lambda t: {kw('t')}))"
_AGENTIC = (
    f"WITH {_TOOL_CTE} SELECT case_id, R((0.4::DOUBLE * ({hits('map_keys(files)')}) / len(map_keys(files)) + 0.4::DOUBLE * {cov(_NOTES)} "
    f"+ 0.2::DOUBLE * {hits('fail_to_pass')} / len(fail_to_pass) + 0.2::DOUBLE * usage) / 1.2::DOUBLE) AS score FROM tu"
)


@query("txt06_score_agentic", _AGENTIC)
def _(spark, sf):
    return v.cases(spark, sf).select("case_id", s.SCORERS["agentic"](F.col).alias("score"))


_JSON = "['[\"t_a\", \"t_b\"]', '\"one\"', '12', 'plain words here', '', '[broken']"


@query(
    "txt08_json_or_words",
    f"""WITH x AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '["' || replace(rel_path, '"', '') || '", "b' || doc_id || '"]' WHEN 1 THEN '"' || stem || '"'
  WHEN 2 THEN CAST(doc_id AS VARCHAR) WHEN 3 THEN section || ' ' || stem ELSE '' END AS raw, rel_path, stem, section FROM docs)
SELECT doc_id, array_to_string(CASE doc_id % 5 WHEN 0 THEN [rel_path, 'b' || doc_id] WHEN 1 THEN [stem] WHEN 2 THEN [CAST(doc_id AS VARCHAR)] WHEN 3 THEN [section, stem] ELSE [] END, '|') AS items FROM x""",
)
def _(spark, sf):
    d = v.docs(spark, sf)
    n, i = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    raw = (
        F.when(i == 0, F.concat(F.lit('["'), "rel_path", F.lit('", "b'), n, F.lit('"]')))
        .when(i == 1, F.concat(F.lit('"'), "stem", F.lit('"')))
        .when(i == 2, n)
        .when(i == 3, F.concat_ws(" ", "section", "stem"))
        .otherwise("")
    )
    return d.select("doc_id", F.array_join(tx.json_or_words(raw), "|").alias("items"))


_WORDS = f"list_distinct(regexp_extract_all({LOW}, '[{fx.WORD_CHARS}]+'))"
_STEPS = "(CASE WHEN len(reasoning_chain) < len(question_decomposition) THEN question_decomposition ELSE reasoning_chain END)"
_PRESENT = (
    f"CASE WHEN length(w) > 4 THEN contains({LOW}, lower(w)) WHEN regexp_full_match(lower(w), '[{fx.WORD_CHARS}]+') THEN list_contains(ws, lower(w)) "
    f"ELSE regexp_matches({LOW}, '(^|[^{fx.WORD_CHARS}])' || regexp_replace(lower(w), '([^{fx.WORD_CHARS}])', '\\\\\\1', 'g') || '($|[^{fx.WORD_CHARS}])') END"
)


@query(
    "txt09_score_multi_hop",
    f"""WITH a AS (SELECT case_id, response, {_WORDS} AS ws, list_filter(list_transform({_STEPS}, lambda t: {kw('t')}), lambda k: len(k) > 0) AS steps FROM cases),
b AS (SELECT case_id, steps, list_transform(steps, lambda k: len(list_filter(k, lambda w: {_PRESENT})) / len(k)) AS c FROM a)
SELECT case_id, R(CASE WHEN len(steps) = 0 THEN 1.0 ELSE coalesce(list_sum(list_filter(c, lambda x: x >= 0.3)), 0) / len(steps) END) AS score FROM b""",
)
def _(spark, sf):
    return v.cases(spark, sf).select("case_id", s.SCORERS["multi_hop"](F.col).alias("score"))


_NEG = f"CASE WHEN {anyof(fx.FIRM_REFUSALS)} THEN 1.0 WHEN {anyof(fx.HEDGES)} THEN 0.7 WHEN {anyof(fx.DISCLAIMERS)} THEN 0.3 ELSE 0.0 END"
scored("txt10_score_negative", _NEG, "negative")
# every stretch of the response against every keyword of a sub-answer that it misses
_COMPOSED = f"""pa AS (SELECT case_id, response, {_PLAIN.format('response')} AS hay, unnest(list_filter(list_transform(sub_answers, lambda w: lower(w)), lambda w: w <> '')) AS answer FROM cases),
pb AS (SELECT case_id, hay, answer, contains({LOW}, answer) AS exact, {kw('answer')} AS ks FROM pa),
pc AS (SELECT DISTINCT case_id, hay, w, {_PLAIN.format('w')} AS needle FROM (SELECT case_id, hay, unnest(ks) AS w FROM pb WHERE NOT exact)),
pd AS (SELECT case_id, w, CASE WHEN length(needle) <= length(hay) THEN needle ELSE hay END AS a, CASE WHEN length(needle) <= length(hay) THEN hay ELSE needle END AS long FROM pc),
pe AS (SELECT case_id, w, a, long, unnest(range(1 - length(a), length(long))) AS i FROM pd WHERE a <> '' AND NOT contains(long, a)),
pf AS (SELECT DISTINCT case_id, w, a, substring(long, greatest(i, 0) + 1, length(a) + least(i, 0)) AS b FROM pe),
pg AS (SELECT DISTINCT case_id, w FROM pf WHERE 200 * {_LCS} >= 80 * (length(a) + length(b))
  UNION SELECT case_id, w FROM pd WHERE a <> '' AND contains(long, a)),
ph AS (SELECT case_id, list(w) AS near FROM pg GROUP BY case_id),
pi AS (SELECT pb.case_id, avg(CASE WHEN exact THEN 1.0 WHEN len(ks) = 0 THEN 0.0 ELSE len(list_filter(ks, lambda k: coalesce(list_contains(near, k), false))) / len(ks) END) AS composed
  FROM pb LEFT JOIN ph ON ph.case_id = pb.case_id GROUP BY pb.case_id)"""


@query(
    "txt11_score_compositional",
    f"WITH {_COMPOSED} SELECT c.case_id, R(coalesce(composed, 1.0)) AS score FROM cases c LEFT JOIN pi ON pi.case_id = c.case_id",
)
def _(spark, sf):
    return v.cases(spark, sf).select("case_id", s.SCORERS["compositional"](F.col).alias("score"))


_MINE = "list_filter(interpretations, lambda i: i.label = expected_interpretation)[1].answer"
_AMB = f"(CASE WHEN {anyof(fx.AMBIGUITY)} THEN 0.1 ELSE 0.0 END)"
_LABEL = f"(CASE WHEN contains({LOW}, expected_interpretation) OR contains({LOW}, replace(expected_interpretation, '_', ' ')) THEN 0.5 ELSE 0.0 END)"
scored(
    "txt12_score_disambiguation",
    f"greatest(CASE WHEN len({kw(_MINE)}) > 0 THEN least(1.0, {cov(kw(_MINE))} + {_AMB}) ELSE 0.0 END, {_LABEL})",
    "disambiguation",
)
scored(
    "txt13_score_conflicting",
    f"CASE WHEN expected_resolution = '' THEN 0.0 WHEN contains({LOW}, lower(expected_resolution)) THEN 1.0 ELSE {cov(kw('expected_resolution'))} END",
    "conflicting",
)
scored("txt14_score_robustness", _ANSWER, "robustness")
_NW = f"len({words_sql('response')})"
scored(
    "txt15_score_efficiency",
    f"({_ANSWER})::DOUBLE * (CASE WHEN {_NW} > token_budget THEN token_budget / {_NW} ELSE 1.0 END)",
    "efficiency",
)


_BY_TYPE = {
    "retrieval": "txt03_score_retrieval",
    "fact_extraction": "txt04_score_fact",
    "agentic": "txt06_score_agentic",
    "multi_hop": "txt09_score_multi_hop",
    "negative": "txt10_score_negative",
    "compositional": "txt11_score_compositional",
    "disambiguation": "txt12_score_disambiguation",
    "conflicting": "txt13_score_conflicting",
    "robustness": "txt14_score_robustness",
    "efficiency": "txt15_score_efficiency",
}


@query(
    "txt16_score_by_columns",
    " UNION ALL ".join(
        f"SELECT c.case_id, c.task_type, q.score FROM cases c JOIN ({ORACLES[name]}) q ON q.case_id = c.case_id WHERE c.task_type = '{kind}'"
        for kind, name in _BY_TYPE.items()
    )
    + " UNION ALL SELECT case_id, task_type, 0.0 FROM cases WHERE task_type = 'code_generation'",
)
def _(spark, sf):
    """The scores that need no Python; code answers, whose syntax check does, count as an unknown type."""
    score = s.score_all(F.col("task_type"), only=list(_BY_TYPE))
    return v.cases(spark, sf).select("case_id", "task_type", score.alias("score"))


@query("txt16_score_all")
def _(spark, sf):
    return v.cases(spark, sf).select("case_id", "task_type", s.score_all(F.col("task_type")).alias("score"))


# ---- metrics -------------------------------------------------------------
_ASCII = "regexp_extract_all(lower({}), '[a-z0-9]+')"


@query(
    "txt17_faithfulness",
    f"""WITH k AS (SELECT DISTINCT case_id, unnest({_ASCII.format('text')}) AS w FROM cases JOIN conversations USING (conv_id) WHERE role = 'user'),
t AS (SELECT case_id, unnest(list_filter({_ASCII.format('response')}, lambda w: NOT list_contains({_list(fx.FAITHFULNESS_STOPWORDS)}, w))) AS w FROM cases),
a AS (SELECT t.case_id, avg((k.w IS NOT NULL)::INT) AS f FROM t LEFT JOIN k ON k.case_id = t.case_id AND k.w = t.w GROUP BY 1)
SELECT case_id, R(coalesce(f, 0)) AS faithfulness FROM cases LEFT JOIN a USING (case_id)""",
)
def _(spark, sf):
    """The sources of a response are what the user said in its conversation."""
    cases = v.cases(spark, sf)
    said = v.table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "text")
    return mt.faithfulness(cases, cases.select("case_id", "conv_id").join(said, "conv_id"), "case_id")


@query(
    "txt18_abstention",
    f"SELECT case_id, R((({anyof(fx.ABSTENTIONS)}) = (case_id % 3 = 0))::INT) AS abstention FROM cases",
)
def _(spark, sf):
    answerable = F.col("case_id") % 3 != 0
    return v.cases(spark, sf).select("case_id", mt.abstention(F.col("response"), answerable).alias("abstention"))


@query(
    "txt19_consistency",
    f"""WITH t AS (SELECT conv_id, turn, {_WORDS} AS ws FROM cases),
p AS (SELECT a.conv_id, a.turn, len(list_filter(a.ws, lambda w: list_contains(b.ws, w))) AS i, len(a.ws) + len(b.ws) AS n
  FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn < a.turn),
m AS (SELECT conv_id, turn, avg(CASE WHEN n = 0 THEN 1.0 ELSE i / (n - i) END) AS c FROM p GROUP BY ALL)
SELECT t.conv_id, t.turn, R(coalesce(c, 1)) AS consistency FROM t LEFT JOIN m ON t.conv_id = m.conv_id AND t.turn = m.turn""",
)
def _(spark, sf):
    return mt.consistency(v.cases(spark, sf), ["conv_id"], "turn")


@query(
    "txt20_first_attempt",
    "SELECT trial_id, R((repetition = 1 AND score >= 0.5)::INT) AS first_attempt FROM trials",
)
def _(spark, sf):
    c = mt.first_attempt(F.col("repetition"), F.col("score"))
    return v.trials(spark, sf).select("trial_id", c.alias("first_attempt"))


_CALLS_SQL = """calls AS (SELECT o_orderkey AS trial_id, ['read_file', 'OpenDoc', 'grep', 'get_page'][l_linenumber % 4 + 1] AS tool,
  CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 'f_' || (l_partkey % 6) END AS file FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
expect AS (SELECT DISTINCT o_orderkey AS trial_id, 'f_' || ((o_orderkey + k) % 6) AS file FROM orders, (SELECT unnest([0, 2]) AS k) WHERE o_orderkey % 5 <> 0)"""


@query(
    "txt21_navigation_path",
    f"""WITH {_CALLS_SQL}, r AS (SELECT trial_id, file FROM calls WHERE tool <> 'grep' AND file IS NOT NULL),
c AS (SELECT trial_id, count(*) AS reads, count(DISTINCT file) AS u FROM r GROUP BY 1),
h AS (SELECT trial_id, count(*) AS rel FROM r JOIN expect USING (trial_id, file) GROUP BY 1), o AS (SELECT trial_id, count(*) AS opt FROM expect GROUP BY 1),
ids AS (SELECT trial_id FROM c UNION SELECT trial_id FROM o)
SELECT trial_id, coalesce(reads, 0) AS reads, R(CASE WHEN coalesce(reads, 0) = 0 THEN 0.0 WHEN coalesce(opt, 0) = 0 THEN 1.0
  ELSE 0.4::DOUBLE * coalesce(rel, 0) / reads + 0.3::DOUBLE * least(opt / reads, 1) + 0.3::DOUBLE * (1 - (reads - u) / reads) END) AS navigation
FROM ids LEFT JOIN c USING (trial_id) LEFT JOIN h USING (trial_id) LEFT JOIN o USING (trial_id)""",
)
def _(spark, sf):
    li, orders = v.table(spark, sf, "lineitem"), v.table(spark, sf, "orders")
    tool = v.pick(["read_file", "OpenDoc", "grep", "get_page"], F.col("l_linenumber") % 4)
    file = F.concat(F.lit("f_"), (F.col("l_partkey") % 6).cast("string"))
    args = F.when(F.col("l_linenumber") % 3 == 0, F.create_map(F.lit("query"), file)).otherwise(
        F.create_map(F.lit("file_path"), file)
    )
    calls = li.join(orders, li.l_orderkey == orders.o_orderkey).select(
        F.col("o_orderkey").alias("trial_id"), tool.alias("tool"), args.alias("arguments")
    )
    expect = orders.where(F.col("o_orderkey") % 5 != 0).select(
        F.col("o_orderkey").alias("trial_id"), F.explode(F.array(F.lit(0), F.lit(2))).alias("k")
    )
    expect = expect.select("trial_id", F.concat(F.lit("f_"), ((F.col("trial_id") + F.col("k")) % 6).cast("string")).alias("file"))
    return mt.navigation_path(calls, expect)


@query(
    "txt22_tool_calls",
    "SELECT l_orderkey AS trial_id, count(*) AS n, R(1 - least(count(*) / 10, 1)) AS score FROM lineitem GROUP BY 1",
)
def _(spark, sf):
    n = v.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("trial_id")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("score", mt.tool_call_score(F.col("n")))


_RAW = """raw AS (SELECT case_id, CASE case_id % 4 WHEN 0 THEN 'Rationale: ' || question || chr(10) || ' Score: 0.' || (case_id % 10)
  WHEN 1 THEN 'RATIONALE: good' || chr(10) || 'SCORE: 1.5' WHEN 2 THEN 'no score here' ELSE 'SCORE: ' || (case_id % 2) END AS raw, question FROM cases)"""


@query(
    "txt23_judge_parse",
    f"""WITH {_RAW}, p AS (SELECT case_id, question, CASE case_id % 4 WHEN 0 THEN (case_id % 10) / 10 WHEN 3 THEN case_id % 2 END AS sc FROM raw)
SELECT case_id, R(sc) AS score, CASE WHEN sc IS NULL THEN NULL WHEN case_id % 4 = 0 THEN regexp_replace(question, '^\\s+|\\s+$', '', 'g') ELSE '' END AS rationale, sc IS NOT NULL AS accepted FROM p""",
)
def _(spark, sf):
    i = F.col("case_id")
    raw = (
        F.when(i % 4 == 0, F.concat(F.lit("Rationale: "), "question", F.lit("\n Score: 0."), (i % 10).cast("string")))
        .when(i % 4 == 1, F.lit("RATIONALE: good\nSCORE: 1.5"))
        .when(i % 4 == 2, F.lit("no score here"))
        .otherwise(F.concat(F.lit("SCORE: "), (i % 2).cast("string")))
    )
    parts = mt.parse_judge(F.col("raw"))
    return v.cases(spark, sf).select("case_id", raw.alias("raw")).select(
        "case_id", *[c.alias(k) for k, c in parts.items()]
    )


# ---- prompts -------------------------------------------------------------
def _quote(x):
    return "'" + x.replace("'", "''") + "'"


def _type_case(values, default):
    whens = " ".join(f"WHEN {_quote(k)} THEN {_quote(x)}" for k, x in values.items())
    return f"CASE task_type {whens} ELSE {_quote(default)} END"


def _prompt_cols(df, prompt):
    p = df.withColumn("_p", prompt)
    return p.select(
        "case_id", F.col("_p")[0]["content"].alias("system"), F.col("_p")[1]["content"].alias("user"),
        mt.message_tokens(F.col("_p")).alias("tokens"),
    )


def _prompt_sql(system, user):
    return f"""WITH p AS (SELECT case_id, {system} AS system, {user} AS user_ FROM cases)
SELECT case_id, system, user_ AS user, CAST(length(system || user_) // 4 AS BIGINT) AS tokens FROM p"""


_JUDGE_SYS = f"{_quote(fx.JUDGE_BEFORE_TYPE)} || task_type || {_quote(fx.JUDGE_BEFORE_RUBRIC)} || ({_type_case(fx.RUBRICS, fx.GENERIC_RUBRIC)}) || {_quote(fx.JUDGE_AFTER_RUBRIC)}"


@query(
    "txt24_judge_prompt",
    _prompt_sql(_JUDGE_SYS, "'## Question' || chr(10) || question || chr(10) || chr(10) || '## Response to Evaluate' || chr(10) || response"),
)
def _(spark, sf):
    p = mt.judge_prompt(F.col("task_type"), F.col("question"), F.col("response"))
    return _prompt_cols(v.cases(spark, sf), p)


@query(
    "txt25_task_prompt",
    _prompt_sql(f"({_type_case(fx.SYSTEM_PROMPTS, fx.GENERIC_PROMPT)}) || chr(10) || chr(10) || 'index of ' || conv_id", "question"),
)
def _(spark, sf):
    index = F.concat(F.lit("index of "), F.col("conv_id").cast("string"))
    return _prompt_cols(v.cases(spark, sf), mt.task_prompt(F.col("task_type"), F.col("question"), index))


_FRAME_USER = "'## Documentation Index' || chr(10) || 'index of ' || conv_id || chr(10) || chr(10) || '## Question' || chr(10) || question"
_ADAPTED = fx.ADAPTED_FRAMING.split("{format_description}")


@query(
    "txt26_framing_prompt",
    _prompt_sql(
        f"CASE WHEN case_id % 2 = 0 THEN {_quote(fx.CONSTANT_FRAMING)} ELSE {_quote(_ADAPTED[0])} || 'format ' || task_type || {_quote(_ADAPTED[1])} END",
        _FRAME_USER,
    ),
)
def _(spark, sf):
    index = F.concat(F.lit("index of "), F.col("conv_id").cast("string"))
    constant = mt.framing_prompt(F.col("question"), index)
    adapted = mt.framing_prompt(F.col("question"), index, F.concat(F.lit("format "), "task_type"))
    return _prompt_cols(v.cases(spark, sf), F.when(F.col("case_id") % 2 == 0, constant).otherwise(adapted))


@query(
    "txt27_token_count",
    f"SELECT doc_id, CAST(length(content) // 4 AS BIGINT) AS tokens, len({words_sql('content')}) AS words FROM docs",
)
def _(spark, sf):
    c = F.col("content")
    return v.docs(spark, sf).select("doc_id", tx.token_count(c).alias("tokens"), F.size(tx.words(c)).alias("words"))
