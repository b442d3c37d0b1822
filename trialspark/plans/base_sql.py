"""The trial-analytics views over the driver tables, as SQL for the checking engine.

``trialspark.views`` builds the same relations with the DataFrame API.
"""

from __future__ import annotations

from trialspark.constants import TASK_TYPES, WEIGHT_SCHEMES, TYPE_WEIGHTS

_TYPES = "[" + ", ".join(f"'{t}'" for t in TASK_TYPES) + "]"

_WHITE = r"[\s\x1c-\x1f\x85\p{Z}]+"


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_WHITE}'), lambda w: w <> '')"


def _cut(words: str, start: int, length: int) -> str:
    return f"array_to_string({words}[{start}:{start + length - 1}], ' ')"


def _values(rows: list[tuple], names: str) -> str:
    body = ", ".join(
        "(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" for v in row) + ")"
        for row in rows
    )
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


BASE: dict[str, str] = {
    "type_weights": _values(list(TYPE_WEIGHTS.items()), "task_type, weight"),
    "weight_schemes": _values(
        [(s, t, w) for s, ws in WEIGHT_SCHEMES.items() for t, w in ws.items()],
        "scheme, task_type, weight",
    ),
    "trials": f"""
SELECT event_id AS trial_id, 'run_' || (user_id % 6) AS run_id, 't_' || (event_id % 440) AS task_id,
  ({_TYPES})[event_id % 11 + 1] AS task_type, 'v_' || (user_id % 7) AS variant_name,
  CAST((event_id // 440) % 5 + 1 AS BIGINT) AS repetition,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100 AS score,
  CAST(floor(value * 10) AS BIGINT) AS prompt_tokens, CAST(floor(value) AS BIGINT) AS completion_tokens,
  CAST(floor(value * 10) AS BIGINT) + CAST(floor(value) AS BIGINT) AS total_tokens,
  CASE WHEN event_type = 'signup' THEN NULL ELSE value / 1000 END AS cost, value / 100 AS latency_seconds,
  'm_' || (user_id % 3) AS model, 'src_' || (event_id % 3) AS source,
  CASE WHEN event_type = 'error' THEN 'failed' END AS error, epoch_us(ts) AS ts_us,
  event_id % 9 + 1 AS oa_row_id,
  CASE user_id % 6 % 3 WHEN 0 THEN 'screening' WHEN 1 THEN 'confirmation' ELSE 'refinement' END AS phase
FROM events""",
    "trials_big": """
SELECT 'run_' || year(o_orderdate) AS run_id, l_returnflag || l_linestatus AS variant_name,
  l_discount * 10 AS score, CASE WHEN l_tax = 0 THEN NULL ELSE l_extendedprice / 1000000 END AS cost,
  'm_' || (l_suppkey % 5) AS model, l_quantity AS tokens, l_partkey AS task_key
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "runs": """
SELECT run_id, CASE CAST(substr(run_id, 5) AS INT) % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'active' ELSE 'failed' END AS status,
  min(ts_us) AS created_us, max(ts_us) AS heartbeat_us, min(phase) AS phase,
  'chain_' || (CAST(substr(run_id, 5) AS INT) % 2) AS chain_id
FROM trials GROUP BY run_id""",
    "docs": """
SELECT *, CAST(length(content) // 4 AS BIGINT) AS token_count, sha256(content) AS content_hash,
  section || '/' || source || '/' || CASE WHEN doc_id % 2 = 0 THEN doc_id || '/' ELSE '' END || stem || '.md' AS rel_path,
  CASE WHEN doc_id % 7 = 0 THEN 'Summary of ' || stem END AS summary
FROM (SELECT doc_id, source, lang AS section, n_chars, CAST(doc_id % 5 AS BIGINT) AS priority,
  CASE WHEN n_chars < 800 THEN 'required' WHEN n_chars < 2500 THEN 'recommended' ELSE 'reference' END AS tier,
  CASE WHEN doc_id % 10 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 365 AS INT) END AS last_modified,
  CASE WHEN doc_id % 2 = 0 THEN coalesce(nullif(lower(regexp_extract(text, '([A-Za-z]{4,})', 1)), ''), 'word') ELSE 'doc_' || doc_id END AS stem,
  CASE WHEN doc_id % 3 = 0 THEN '# Title ' || doc_id || chr(10) || chr(10) ELSE '' END ||
  CASE doc_id % 4 WHEN 0 THEN replace(text, chr(10), chr(10) || chr(10) || '## Part ') WHEN 1 THEN replace(text, chr(10), chr(10) || 'def fn_x(a):' || chr(10))
    WHEN 2 THEN replace(text, '. ', '.  ' || chr(10) || chr(10) || chr(10) || chr(10) || '#Note ') || '<!-- hidden' || chr(10) || 'note -->' ELSE text END ||
  CASE doc_id % 5 WHEN 0 THEN chr(10) || '```python' || chr(10) || 'x = 1' || chr(10) || '```' WHEN 1 THEN ' since version 2.' || (doc_id % 7) || ' legacy'
    WHEN 2 THEN ' see v1.4.2 | end' ELSE '' END AS content
FROM documents)""",
    "case_words": f"""
SELECT r.conv_id * 1000 + r.turn AS case_id, r.conv_id, r.turn, u.text AS question, r.text AS answer_text,
  {words_sql("u.text")} AS qw, {words_sql("r.text")} AS aw
FROM conversations r JOIN conversations u ON u.conv_id = r.conv_id AND u.turn = r.turn - 1
WHERE r.role = 'assistant' AND u.role = 'user'""",
    "cases": f"""
SELECT case_id, conv_id, turn, ({_TYPES})[case_id % 11 + 1] AS task_type, question,
  answer_text || (CASE WHEN case_id % 2 = 0 THEN ' See ./docs/Guide_' || (case_id % 3) || '.md, lib/auth.py.' ELSE '' END)
    || ([' The answer cannot be determined.', ' It''s unclear.', ' This may not be accurate.', ' It could mean first reading.',
         ' First run_tests then read_file and deploy_app.', '', '']::VARCHAR[])[case_id % 7 + 1] AS response,
  {_cut("qw", 1, 6)} AS expected_answer,
  [CASE WHEN case_id % 5 = 0 THEN {_cut("aw", 3, 2)} ELSE {_cut("qw", 7, 2)} END] AS answer_aliases,
  ['docs/guide_' || (case_id % 4) || '.md', 'src/auth.py'] AS expected_files,
  [{_cut("qw", 1, 5)}, {_cut("qw", 6, 5)}, {_cut("aw", 1, 4)}] AS reasoning_chain,
  CASE WHEN case_id % 3 = 0 THEN [{_cut("qw", 1, 3)}, {_cut("qw", 4, 3)}, {_cut("aw", 2, 3)}, {_cut("aw", 9, 5)}] ELSE [] END AS question_decomposition,
  MAP {{'src/auth.py': {_cut("aw", 1, 3)}, 'docs/x_' || (case_id % 3) || '.md': {_cut("qw", 1, 4)}}} AS files,
  [{_cut("aw", 2, 1)}, 'test_login'] AS fail_to_pass,
  CASE WHEN case_id % 2 = 0 THEN ['read_file', 'run_tests'] ELSE ['run_tests', 'search'] END AS expected_tools,
  [{_cut("qw", 1, 2)}, {_cut("aw", 2, 3)}, '', {_cut("qw", 3, 4)}] AS sub_answers,
  [{{'label': 'first_reading', 'answer': {_cut("qw", 1, 5)}}}, {{'label': 'other_reading', 'answer': {_cut("aw", 5, 5)}}}] AS interpretations,
  CASE WHEN case_id % 3 = 0 THEN 'other_reading' ELSE 'first_reading' END AS expected_interpretation,
  CASE WHEN case_id % 4 = 0 THEN {_cut("aw", 4, 3)} ELSE {_cut("qw", 2, 6)} END AS expected_resolution,
  20 + case_id % 50 AS token_budget,
  concat_ws(chr(10), {_cut("aw", 1, 1)}, {_cut("qw", 1, 1)}, '[') AS test,
  [{_cut("qw", 2, 1)}] AS forbidden_patterns
FROM case_words""",
    "gold": f"""
SELECT l.doc_id AS example_id, ({_TYPES})[l.doc_id % 11 + 1] AS task_type, (quality * 6 + n_chars % 5) / 10 AS human_score
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "judge_scores": """
SELECT l.doc_id AS example_id, 'judge_' || j AS judge_model, (quality * 5 + (n_chars + j * toxic) % 5 + (l.doc_id * j) % 3) / 12 AS score, j AS seq
FROM labels l JOIN documents d ON l.doc_id = d.doc_id, (SELECT unnest([0, 1, 2]) AS j)""",
    "local_models": """
SELECT 'model_' || p_partkey AS id, p_name AS name, CAST(p_size * 1000 AS BIGINT) AS context_length, p_retailprice / 1000 AS prompt_price, p_retailprice / 500 AS completion_price,
  p_type AS modality, p_brand AS tokenizer, ([['tools'], ['tools', 'json'], ['json', 'vision', 'tools']])[p_size % 3 + 1] AS supported_params,
  p_partkey % 90 AS first_seen, 100 AS last_seen, CASE WHEN p_partkey % 23 = 0 THEN 150 END AS removed_at
FROM part WHERE p_partkey % 11 <> 0""",
    "remote_models": """
SELECT 'model_' || p_partkey AS id, p_name || CASE WHEN p_partkey % 6 = 0 THEN ' v2' ELSE '' END AS name, CAST(p_size * 1000 AS BIGINT) AS context_length,
  CASE WHEN p_partkey % 7 = 0 THEN p_retailprice / 900 ELSE p_retailprice / 1000 END AS prompt_price,
  CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 8 = 0 THEN 0.0 ELSE p_retailprice / 500 END AS completion_price, p_type AS modality, p_brand AS tokenizer
FROM part WHERE p_partkey % 10 <> 0""",
    "provider_costs": """
SELECT trial_id, CASE WHEN trial_id % 4 = 0 THEN coalesce(cost, 0) WHEN trial_id % 4 = 1 THEN coalesce(cost, 0) + 0.005 WHEN trial_id % 4 = 2 THEN coalesce(cost, 0) * 1.2 + 0.02 ELSE coalesce(cost, 0) * 1.005 END AS provider_cost,
  CAST(prompt_tokens * (1 + trial_id % 3) // 2 AS BIGINT) AS prompt_tokens, completion_tokens FROM trials WHERE trial_id % 5 <> 0""",
}
