"""Column expressions on text used by scorers and corpus jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialspark.functions.fixed_text import (
    KEYWORD_STOPWORDS,
    KEYWORD_TRIM,
    PATH_EXTENSIONS,
    WHITE,
    WORD_CHARS,
)


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` computed once per row, however often and deep ``fn`` uses it.

    Inside array lambdas an outer expression is evaluated again for every
    element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0 where there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def hash_number(key: Column) -> Column:
    """A number from 0 to 2^32 - 1 drawn from ``key``: the first 32 bits of its MD5, the same in any engine."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def words(text: Column) -> Column:
    """Whitespace-separated words; an empty text has none."""
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def extract_keywords(text: Column) -> Column:
    """Words without edge punctuation, three letters or more, no stop words; repeats and case kept."""
    bare = F.transform(words(text), lambda w: F.btrim(w, F.lit(KEYWORD_TRIM)))
    return F.filter(bare, lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(KEYWORD_STOPWORDS))


def hits(keywords: Column, lowered: Column) -> Column:
    return F.size(F.filter(keywords, lambda w: F.contains(lowered, F.lower(w))))


def keyword_coverage(keywords: Column, lowered: Column) -> Column:
    """Share of keywords that occur as substrings."""
    return ratio(hits(keywords, lowered), F.size(keywords))


def any_phrase(lowered: Column, phrases) -> Column:
    found = F.contains(lowered, F.lit(phrases[0]))
    for p in phrases[1:]:
        found = found | F.contains(lowered, F.lit(p))
    return found


def word_set(text: Column) -> Column:
    """Distinct lower-cased runs of letters, digits and underscores, in any script."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"([{WORD_CHARS}]+)"), F.lit(1)))


def mentioned_paths(text: Column) -> Column:
    pattern = (
        f"(?i)((?:[{WORD_CHARS}./-]+/)?[{WORD_CHARS}.-]+\\.(?:" + "|".join(PATH_EXTENSIONS) + "))"
    )
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def normalize_path(path: Column) -> Column:
    bare = F.regexp_replace(F.trim(path), r"^\./", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r"\\", "/"), "/+$", ""))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def token_count(text: Column) -> Column:
    """Four characters per token."""
    return F.floor(F.length(text) / 4).cast("long")


def json_or_words(text: Column) -> Column:
    """A JSON list as is, another JSON scalar as one item, anything else as words."""
    as_list = F.from_json(text, "array<string>")
    is_list = text.rlike(r"^\s*\[") & as_list.isNotNull()
    scalar = text.rlike(r'^\s*("([^"\\]|\\.)*"|-?\d+(\.\d+)?([eE][+-]?\d+)?|true|false|null)\s*$')
    bare = F.regexp_extract(text, r'^\s*"?(.*?)"?\s*$', 1)
    return (
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.array().cast("array<string>"))
        .when(is_list, as_list)
        .when(scalar, F.array(bare))
        .otherwise(words(text))
    )
