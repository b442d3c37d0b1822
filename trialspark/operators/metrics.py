"""Response metrics beyond the task scores, prompts and judge output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.functions import fixed_text as fx
from trialspark.functions import text as tx


def faithfulness(responses: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Share of a response's non-stop words (repeats count) found in the sources of that response.

    Responses are cut to (response, word, count) before the equi-join on
    response and word, so neither a long response nor a common word is gathered
    in one place. ``sources`` has the ``key`` and ``text`` columns; a response
    without sources has 0.
    """
    ascii_words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))
    kept = F.filter(ascii_words(F.col("response")), lambda w: ~w.isin(fx.FAITHFULNESS_STOPWORDS))
    tokens = (
        responses.select(key, F.explode(kept).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    )
    known = sources.select(key, F.explode(F.array_distinct(ascii_words(F.col("text")))).alias("word")).distinct()
    share = (
        tokens.join(known.withColumn("known", F.lit(1)), [key, "word"], "left")
        .groupBy(key)
        .agg((F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("faithfulness"))
    )
    return responses.select(key).join(share, key, "left").na.fill(0.0, ["faithfulness"])


def abstention(response: Column, answerable: Column) -> Column:
    abstained = tx.any_phrase(F.lower(response), fx.ABSTENTIONS)
    return (abstained == (F.coalesce(answerable, F.lit(True)) == F.lit(False))).cast("double")


def consistency(responses: DataFrame, group: list[str], order: str) -> DataFrame:
    """Mean Jaccard similarity of each response's word set with every earlier response of its group.

    A group is one task cell and its size the number of repetitions, so the
    pairs stay few per cell; only 8-byte word hashes travel, never the text.
    """
    words = F.transform(tx.word_set(F.col("response")), lambda w: F.xxhash64(w))
    sets = responses.select(*group, order, words.alias("words"))
    earlier = sets.select(*group, F.col(order).alias("_before"), F.col("words").alias("_words"))
    shared = F.size(F.array_intersect("words", "_words"))
    union = F.size("words") + F.size("_words") - shared
    pairs = sets.join(earlier, group).where(F.col("_before") < F.col(order))
    mean = pairs.groupBy(*group, order).agg(
        F.avg(F.when(union == 0, 1.0).otherwise(shared / union)).alias("consistency")
    )
    return responses.select(*group, order).join(mean, [*group, order], "left").na.fill(1.0, ["consistency"])


def first_attempt(attempt: Column, score: Column, threshold: float = 0.5) -> Column:
    return ((attempt == 1) & (F.coalesce(score, F.lit(0.0)) >= threshold)).cast("double")


def tool_call_score(n: Column) -> Column:
    return 1.0 - F.least(n / 10.0, F.lit(1.0))


def navigation_path(calls: DataFrame, expected: DataFrame) -> DataFrame:
    """.4 relevant reads + .3 optimal/actual + .3 no repeats, per trial.

    ``calls``: trial_id, tool, arguments (map); ``expected``: trial_id, file.
    """
    path = F.coalesce(*[F.element_at("arguments", F.lit(k)) for k in fx.PATH_ARGUMENTS])
    reads = calls.where(F.col("tool").rlike("(?i)" + "|".join(fx.READ_TOOL_WORDS))).select(
        "trial_id", path.alias("file")
    ).where(F.col("file").isNotNull())
    per_file = reads.groupBy("trial_id", "file").agg(F.count(F.lit(1)).alias("reads"))
    wanted = expected.select("trial_id", "file").distinct()
    both = per_file.join(wanted.withColumn("relevant", F.lit(1)), ["trial_id", "file"], "full_outer")
    agg = both.groupBy("trial_id").agg(
        F.coalesce(F.sum("reads"), F.lit(0)).alias("reads"),
        F.count("reads").alias("distinct_reads"),
        F.count("relevant").alias("optimal"),
        F.coalesce(F.sum(F.when(F.col("relevant") == 1, F.col("reads"))), F.lit(0)).alias("relevant_reads"),
    )
    score = (
        0.4 * F.col("relevant_reads") / F.col("reads")
        + 0.3 * F.least(F.col("optimal") / F.col("reads"), F.lit(1.0))
        + 0.3 * (1.0 - (F.col("reads") - F.col("distinct_reads")) / F.col("reads"))
    )
    return agg.select(
        "trial_id",
        "reads",
        F.when(F.col("reads") == 0, 0.0).when(F.col("optimal") == 0, 1.0).otherwise(score).alias("navigation"),
    )


def parse_judge(raw: Column) -> dict[str, Column]:
    """Columns score (NULL when missing or outside 0..1), rationale and accepted."""
    number = F.regexp_extract(raw, r"(?im)^\s*SCORE\s*:\s*([0-9]*\.?[0-9]+)\s*$", 1)
    value = F.when(number != "", number.cast("double"))
    ok = F.coalesce(value.between(0.0, 1.0), F.lit(False))
    why = F.regexp_extract(raw, r"(?is)RATIONALE\s*:\s*(.*?)\n\s*SCORE\s*:", 1)
    why = F.regexp_replace(why, r"^\s+|\s+$", "")
    return {"score": F.when(ok, value), "rationale": F.when(ok, why), "accepted": ok}


def _by_type(values: dict[str, str], default: str, task_type: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.element_at(mapping, task_type), F.lit(default))


def _messages(system: Column, user: Column) -> Column:
    role = lambda name, content: F.struct(F.lit(name).alias("role"), content.alias("content"))
    return F.array(role("system", system), role("user", user))


def judge_prompt(task_type: Column, question: Column, response: Column, rubric: Column | None = None) -> Column:
    rules = _by_type(fx.RUBRICS, fx.GENERIC_RUBRIC, task_type)
    rules = F.coalesce(rubric, rules) if rubric is not None else rules
    system = F.concat(
        F.lit(fx.JUDGE_BEFORE_TYPE), task_type, F.lit(fx.JUDGE_BEFORE_RUBRIC), rules, F.lit(fx.JUDGE_AFTER_RUBRIC)
    )
    user = F.concat(F.lit("## Question\n"), question, F.lit("\n\n## Response to Evaluate\n"), response)
    return _messages(system, user)


def task_prompt(task_type: Column, question: Column, index: Column) -> Column:
    lead = _by_type(fx.SYSTEM_PROMPTS, fx.GENERIC_PROMPT, task_type)
    return _messages(F.concat(lead, F.lit("\n\n"), index), question)


def framing_prompt(question: Column, index: Column, format_description: Column | None = None) -> Column:
    """Constant framing, or adapted to the format when a description is given."""
    if format_description is None:
        system = F.lit(fx.CONSTANT_FRAMING)
    else:
        before, after = fx.ADAPTED_FRAMING.split("{format_description}")
        system = F.concat(F.lit(before), format_description, F.lit(after))
    user = F.concat(F.lit("## Documentation Index\n"), index, F.lit("\n\n## Question\n"), question)
    return _messages(system, user)


def message_tokens(messages: Column) -> Column:
    """Four characters per token over the joined contents."""
    return tx.token_count(F.array_join(F.transform(messages, lambda m: m["content"]), ""))
