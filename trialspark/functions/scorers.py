"""Response scorers as column expressions, one per task type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialspark.functions import fuzzy, text
from trialspark.functions.fixed_text import (
    AMBIGUITY,
    DISCLAIMERS,
    FIRM_REFUSALS,
    HEDGES,
    TOOL_NAMES,
)
from trialspark.functions.text import extract_keywords, hits, keyword_coverage, let, ratio


def _low(c: Column) -> Column:
    return F.lower(c)


def _size(a: Column) -> Column:
    return F.coalesce(F.array_size(a), F.lit(0))


def score_retrieval(response: Column, expected_files: Column) -> Column:
    """F-beta (2) of mentioned against expected paths; an equal file name elsewhere counts half."""
    paths = lambda a: F.array_distinct(F.transform(a, text.normalize_path))
    both = F.struct(paths(text.mentioned_paths(response)).alias("got"), paths(expected_files).alias("want"))

    def compare(s: Column) -> Column:
        got, want, exact = s["got"], s["want"], F.array_intersect(s["want"], s["got"])
        rest_names = F.transform(F.array_except(got, exact), text.base_name)
        near = let(
            rest_names,
            lambda names: F.size(F.filter(F.array_except(want, exact), lambda p: F.array_contains(names, text.base_name(p)))),
        )
        true = F.size(exact) + 0.5 * near
        return F.struct(true.alias("true"), F.size(got).alias("got"), _size(want).alias("want"))

    def fbeta(c: Column) -> Column:
        precision, recall = c["true"] / c["got"], c["true"] / c["want"]
        score = 5.0 * precision * recall / (4.0 * precision + recall)
        return (
            F.when((c["want"] == 0) & (c["got"] == 0), 1.0)
            .when((c["want"] == 0) | (c["got"] == 0) | (c["true"] == 0), 0.0)
            .otherwise(F.least(score, F.lit(1.0)))
        )

    return let(both, lambda s: let(compare(s), fbeta))


def contained(response: Column, answer: Column, aliases: Column) -> Column:
    return let(
        _low(response), lambda low: F.contains(low, _low(answer)) | F.exists(aliases, lambda a: F.contains(low, _low(a)))
    )


def score_answer(response: Column, answer: Column, aliases: Column) -> Column:
    """1 for the answer or an alias, else the share of its keywords (the robustness score)."""
    share = let(_low(response), lambda low: let(extract_keywords(answer), lambda k: keyword_coverage(k, low)))
    return (
        F.when(F.coalesce(answer, F.lit("")) == "", 0.0)
        .when(contained(response, answer, aliases), 1.0)
        .otherwise(share)
    )


def score_fact(response: Column, answer: Column, aliases: Column) -> Column:
    """As :func:`score_answer` with a fuzzy layer that only sees rows the exact layers missed."""
    low = _low(response)
    hit = F.contains(low, _low(answer)) | F.exists(aliases, lambda a: F.contains(low, _low(a)))
    missed = (F.coalesce(answer, F.lit("")) != "") & ~hit
    close = F.when(missed, fuzzy.close_match(answer, response))
    return F.coalesce(close, score_answer(response, answer, aliases))


def code_parts(response: Column, test: Column, forbidden: Column) -> Column:
    """Struct of the found share of the wanted patterns, that of the forbidden ones, and whether the code is valid.

    Patterns without special characters are matched as columns; Python gets
    the others (whose dialect is its own) and the text for the syntax check.
    """
    special = lambda p: p.rlike(r"[\\.^$*+?{}\[\]|()]")
    wanted = F.filter(F.split(test, "\n"), lambda p: p.rlike(r"(?U)\S"))
    found = lambda patterns: F.size(
        F.filter(patterns, lambda p: ~special(p) & F.regexp_like(response, F.concat(F.lit("(?iu)"), p)))
    )
    odd = fuzzy.code_udf(F.filter(wanted, special), F.filter(forbidden, special), response)
    share = lambda n, patterns, none: F.when(_size(patterns) > 0, n / F.size(patterns)).otherwise(none)
    return let(
        odd,
        lambda o: F.struct(
            share(found(wanted) + o["found"], wanted, 1.0).alias("found"),
            share(found(forbidden) + o["broken"], forbidden, 0.0).alias("broken"),
            o["valid"].alias("valid"),
        ),
    )


def score_code(response: Column, test: Column, forbidden: Column) -> Column:
    total = lambda c: 0.7 * c["found"] + 0.2 * (1.0 - c["broken"]) + F.when(c["valid"], 0.1).otherwise(0.0)
    score = let(code_parts(response, test, forbidden), lambda c: F.least(total(c), F.lit(1.0)))
    return F.when(response.isNotNull(), score)


def tool_usage(response: Column, tools: Column) -> Column:
    """.5 coverage + .3 order of first mention + .2 share of mentioned tools that were expected."""
    known = F.lit(r"\b(" + "|".join(TOOL_NAMES) + r")\b")

    def judge(low: Column) -> Column:
        names = F.filter(F.transform(tools, _low), lambda n: n != "")
        found = F.filter(names, lambda n: F.contains(low, n))
        places = F.transform(found, lambda n: F.position(n, low))
        ordered = F.when(places == F.array_sort(places), 1.0).otherwise(0.0)
        precision = let(
            F.array_distinct(F.regexp_extract_all(low, known, F.lit(1))),
            lambda m: F.when(F.size(m) > 0, 1.0 - F.size(F.array_except(m, names)) / F.size(m)).otherwise(1.0),
        )
        return F.when(F.size(found) == 0, 0.0).otherwise(
            0.5 * F.size(found) / F.size(names) + 0.3 * ordered + 0.2 * precision
        )

    return let(_low(response), judge)


def score_agentic(response: Column, files: Column, fail_to_pass: Column, tools: Column) -> Column:
    """Weighted mean of the parts whose expectations are given; .5 when none is."""
    paths, notes = F.map_keys(files), F.map_values(files)
    keywords = F.flatten(F.transform(notes, extract_keywords))
    share = lambda wanted: let(
        _low(response), lambda low: let(wanted, lambda w: ratio(hits(w, low), F.size(w)))
    )
    has_files, has_tests, has_tools = _size(paths) > 0, _size(fail_to_pass) > 0, _size(tools) > 0
    parts = [
        (has_files, 0.4, share(paths)),
        (has_files, 0.4, share(keywords)),
        (has_tests, 0.2, share(fail_to_pass)),
        (has_tools, 0.2, tool_usage(response, tools)),
    ]
    weight = sum((F.when(on, w).otherwise(0.0) for on, w, _ in parts), F.lit(0.0))
    total = sum((F.when(on, w * s).otherwise(0.0) for on, w, s in parts), F.lit(0.0))
    return F.when(weight == 0, 0.5).otherwise(F.least(total / weight, F.lit(1.0)))


def score_multi_hop(response: Column, chain: Column, decomposition: Column) -> Column:
    """Mean keyword coverage over steps, a step below .30 counting nothing; short keywords match whole words."""
    steps = F.when(_size(chain) < _size(decomposition), decomposition).otherwise(chain)
    keyword_lists = F.filter(F.transform(steps, extract_keywords), lambda k: F.size(k) > 0)

    def in_words(low: Column, words: Column, w: Column) -> Column:
        bounded = F.concat(F.lit(r"(?U)\b"), F.regexp_replace(w, r"([^\p{L}\p{N}_])", r"\\$1"), F.lit(r"\b"))
        return F.when(w.rlike(r"^[\p{L}\p{N}_]+$"), F.array_contains(words, w)).otherwise(F.regexp_like(low, bounded))

    def mean(r: Column) -> Column:
        present = lambda w: F.when(
            F.length(w) <= 4, in_words(r["low"], r["words"], _low(w))
        ).otherwise(F.contains(r["low"], _low(w)))
        covered = F.transform(r["k"], lambda k: F.size(F.filter(k, present)) / F.size(k))
        counted = F.aggregate(covered, F.lit(0.0), lambda a, c: a + F.when(c >= 0.30, c).otherwise(0.0))
        return F.when(_size(r["k"]) == 0, 1.0).otherwise(counted / F.size(r["k"]))

    row = F.struct(_low(response).alias("low"), text.word_set(response).alias("words"), keyword_lists.alias("k"))
    return let(row, mean)


def score_negative(response: Column) -> Column:
    low = _low(response)
    return (
        F.when(text.any_phrase(low, FIRM_REFUSALS), 1.0)
        .when(text.any_phrase(low, HEDGES), 0.7)
        .when(text.any_phrase(low, DISCLAIMERS), 0.3)
        .otherwise(0.0)
    )


def score_compositional(response: Column, answers: Column) -> Column:
    """Mean over non-empty sub-answers: 1 if contained, else share of fuzzily found keywords."""
    wanted = F.filter(F.transform(answers, _low), lambda a: a != "")

    def share(answer: Column, low: Column, hay: Column) -> Column:
        near = lambda w: let(fuzzy.plain(w), lambda n: fuzzy.partial_hit(n, hay))
        fuzzily = let(extract_keywords(answer), lambda k: ratio(F.size(F.filter(k, near)), F.size(k)))
        return F.when(F.contains(low, answer), 1.0).otherwise(fuzzily)

    def mean(r: Column) -> Column:
        total = F.aggregate(r["wanted"], F.lit(0.0), lambda t, a: t + share(a, r["low"], r["hay"]))
        return F.when(_size(r["wanted"]) == 0, 1.0).otherwise(total / F.size(r["wanted"]))

    row = F.struct(wanted.alias("wanted"), _low(response).alias("low"), fuzzy.plain(response).alias("hay"))
    return let(row, mean)


def score_disambiguation(response: Column, interpretations: Column, expected: Column) -> Column:
    """max(keyword coverage + .1 for naming the ambiguity, .5 for naming the label)."""
    low = _low(response)
    mine = F.filter(interpretations, lambda i: i["label"] == expected)
    keywords = extract_keywords(F.get(mine, F.lit(0))["answer"])
    bonus = F.when(text.any_phrase(low, AMBIGUITY), 0.1).otherwise(0.0)
    scored = lambda k, x: F.when(
        _size(k) > 0, F.least(F.lit(1.0), keyword_coverage(k, x) + bonus)
    ).otherwise(0.0)
    answer = let(low, lambda x: let(keywords, lambda k: scored(k, x)))
    label = _low(expected)
    named = F.contains(low, label) | F.contains(low, F.replace(label, F.lit("_"), F.lit(" ")))
    return F.when((F.coalesce(expected, F.lit("")) == "") | (_size(mine) == 0), 0.0).otherwise(
        F.greatest(answer, F.when(named, 0.5).otherwise(0.0))
    )


def score_conflicting(response: Column, resolution: Column) -> Column:
    return score_answer(response, resolution, F.array().cast("array<string>"))


def score_efficiency(response: Column, answer: Column, aliases: Column, budget: Column) -> Column:
    """The answer score, shrunk by budget / words when the response is too long."""
    n = F.size(text.words(response))
    shrink = F.when((budget > 0) & (n > budget), budget / n).otherwise(1.0)
    return score_answer(response, answer, aliases) * shrink


# type -> function of a column lookup; register_scorer adds custom types
SCORERS: dict[str, Callable[[Callable[[str], Column]], Column]] = {
    "retrieval": lambda c: score_retrieval(c("response"), c("expected_files")),
    "fact_extraction": lambda c: score_fact(c("response"), c("expected_answer"), c("answer_aliases")),
    "code_generation": lambda c: score_code(c("response"), c("test"), c("forbidden_patterns")),
    "agentic": lambda c: score_agentic(c("response"), c("files"), c("fail_to_pass"), c("expected_tools")),
    "multi_hop": lambda c: score_multi_hop(c("response"), c("reasoning_chain"), c("question_decomposition")),
    "negative": lambda c: score_negative(c("response")),
    "compositional": lambda c: score_compositional(c("response"), c("sub_answers")),
    "robustness": lambda c: score_answer(c("response"), c("expected_answer"), c("answer_aliases")),
    "disambiguation": lambda c: score_disambiguation(
        c("response"), c("interpretations"), c("expected_interpretation")
    ),
    "conflicting": lambda c: score_conflicting(c("response"), c("expected_resolution")),
    "efficiency": lambda c: score_efficiency(
        c("response"), c("expected_answer"), c("answer_aliases"), c("token_budget")
    ),
}
_PYTHON_TYPES = {"code_generation"}


def register_scorer(task_type: str, fn: Callable[[Callable[[str], Column]], Column]) -> None:
    """Add or replace the scorer of a task type; ``fn`` gets a column lookup."""
    SCORERS[task_type] = fn


def score_all(task_type: Column, only: list[str] | None = None) -> Column:
    """Dispatch by type in one expression; Python-backed scorers see only rows of their own type.

    An unknown type scores 0; ``only`` limits the dispatch to types known to occur.
    """
    out = F.lit(0.0)
    for name, fn in SCORERS.items():
        if only is not None and name not in only:
            continue
        if name in _PYTHON_TYPES:
            lookup = lambda c, n=name: F.when(task_type == n, F.col(c))
        else:
            lookup = F.col
        out = F.when(task_type == name, fn(lookup)).otherwise(out)
    return out
