"""Column expressions on Markdown documents and their paths."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialspark.functions.fixed_text import WHITE, WORD_CHARS

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"

# Patterns for versions and deprecation, and path words that decide a tier.
VERSION_PATTERNS = [r"@since\s+([\d]+(?:\.[\d]+)*)", r"version\s+([\d]+(?:\.[\d]+)*)", r"\bv([\d]+(?:\.[\d]+)+)\b"]
DEPRECATION = r"@deprecated|DEPRECATED|obsolete|legacy|no longer supported"
REQUIRED_WORDS = ["getting-started", "getting_started", "quickstart", "quick-start", "quick_start", "setup", "install", "installation"]
REFERENCE_WORDS = ["api", "reference", "ref", "spec", "specification"]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WHITE}|{WHITE}$", "")


def lines(content: Column) -> Column:
    return F.split(content, LINE_BREAK)


def unhash(c: Column) -> Column:
    """Leading hash signs and spaces removed."""
    return F.regexp_replace(c, "^[# ]+", "")


def _first(array: Column) -> Column:
    return F.coalesce(F.get(array, F.lit(0)), F.lit(""))


HEAD = 400


def _head_first(content: Column, of: Callable[[Column], Column], enough: Callable[[Column], Column], head: Column) -> Column:
    """``of(content)``, read off the start of the text where that already settles it.

    Only a shortcut: wherever the start does not decide the result, the whole
    text is processed, so the value is always that of the whole text.
    """
    short = of(head)
    return F.when((F.length(content) > HEAD) & enough(short), short).otherwise(of(content))


def brief_summary(content: Column, n: int = 80) -> Column:
    """First line that is not empty without heading marks, cut to ``n`` characters."""

    def first(text: Column) -> Column:
        bare = F.transform(lines(text), lambda x: unhash(strip(x)))
        return F.left(_first(F.filter(bare, lambda x: x != "")), F.lit(n))

    # complete lines only: the last one may have been cut
    head = F.regexp_replace(F.left(content, F.lit(HEAD)), r"[^\n]*$", "")
    return _head_first(content, first, lambda x: x != "", head)


def summarise(content: Column) -> Column:
    first = strip(F.substring_index(content, "\n", 1))
    return F.when(F.length(first) > 100, F.concat(F.left(first, F.lit(97)), F.lit("..."))).otherwise(first)


def content_summary(content: Column, n: int = 100) -> Column:
    """The text on one line, cut to ``n`` characters."""
    flatten = lambda text: strip(unhash(strip(F.regexp_replace(text, WHITE, " "))))
    flat = _head_first(content, flatten, lambda x: F.length(x) > n, F.left(content, F.lit(HEAD)))
    cut = F.regexp_replace(F.left(flat, F.lit(n)), f"{WHITE}$", "")
    return F.when(F.length(flat) > n, F.concat(cut, F.lit("..."))).otherwise(flat)


def escape_pipe(c: Column) -> Column:
    return F.replace(c, F.lit("|"), F.lit("\\|"))


def yaml_scalar(c: Column) -> Column:
    """A one-line YAML value: plain when unambiguous, single-quoted otherwise."""
    v = F.replace(c, F.lit("\n"), F.lit(" "))
    plain = (
        v.rlike(r"^[\p{L}_/(][^\n]*$")
        & ~v.rlike(r"(: |:$| #|^\s|\s$)")
        & ~F.lower(v).isin("true", "false", "yes", "no", "on", "off", "null", "y", "n")
    )
    return F.when(plain, v).otherwise(F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("''")), F.lit("'")))


def compress_markdown(content: Column) -> Column:
    c = F.regexp_replace(content, r"(?s)<!--.*?-->", "")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"(?dm)[ \t]+$", "")
    return strip(F.regexp_replace(c, r"(?dm)^(#{1,6})([^\s#])", "$1 $2"))


def first_lines(content: Column, n: int = 20) -> Column:
    head = F.slice(F.split(content, LINE_BREAK, n + 1), 1, n)
    bare = F.filter(F.transform(head, strip), lambda x: x != "")
    return F.array_join(F.transform(bare, lambda x: F.regexp_replace(x, r"\s{2,}", " ")), "\n")


def paragraph_leads(content: Column) -> Column:
    """The first line of every paragraph, a paragraph being a run of non-blank lines."""

    def leads(bare: Column) -> Column:
        before = F.concat(F.array(F.lit("")), F.slice(bare, 1, F.greatest(F.size(bare) - 1, F.lit(1))))
        starts = F.zip_with(bare, before, lambda x, prev: F.when((x != "") & (prev == ""), x))
        return F.array_join(F.array_compact(starts), "\n")

    # the array of one array names the lines, so they are stripped once
    return F.get(F.transform(F.array(F.transform(lines(content), strip)), leads), F.lit(0))


def _first_body_line(chunk: Column, n: int) -> Column:
    body = F.filter(F.transform(F.slice(lines(chunk), 2, 1 << 30), strip), lambda x: x != "")
    return F.left(_first(body), F.lit(n))


def split_sections(content: Column) -> Column:
    """array<struct<name, summary>> of the second-level headings."""
    chunks = F.filter(F.split(content, r"(?dm)^(?=## .)"), lambda x: x.rlike(r"^## ."))
    return F.transform(
        chunks,
        lambda x: F.struct(
            strip(unhash(F.get(F.split(x, "\n"), F.lit(0)))).alias("name"), _first_body_line(x, 80).alias("summary")
        ),
    )


def split_definitions(content: Column) -> Column:
    """array<struct<name, kind>> of def and class lines."""
    pattern = rf"^(?:def|class)\s+([{WORD_CHARS}]+)"
    found = F.filter(F.transform(lines(content), strip), lambda x: x.rlike(pattern))
    return F.transform(
        found,
        lambda x: F.struct(
            F.regexp_extract(x, pattern, 1).alias("name"),
            F.when(x.startswith("class "), "class").otherwise("function").alias("kind"),
        ),
    )


def restructure(content: Column, n: int = 120) -> Column:
    """Table of contents by heading level plus the first line under each heading."""
    heading = r"^(#{1,6})[ \t\x0b\f\r]+([^\n]*)"
    chunks = F.filter(F.split(content, r"(?dm)^(?=#{1,6}[ \t\x0b\f\r])"), lambda x: x.rlike(heading))
    title = lambda x: strip(F.regexp_extract(x, heading, 2))
    toc = F.transform(
        chunks,
        lambda x: F.concat(F.repeat(F.lit("  "), F.length(F.regexp_extract(x, heading, 1)) - 1), F.lit("- "), title(x)),
    )
    excerpt = F.transform(
        F.transform(chunks, lambda x: F.struct(title(x).alias("t"), _first_body_line(x, n).alias("e"))),
        lambda s: F.concat(
            F.lit("- **"), s["t"], F.lit("**"), F.when(s["e"] != "", F.concat(F.lit(": "), s["e"])).otherwise("")
        ),
    )
    full = F.array_join(
        F.concat(
            F.array(F.lit("### Table of Contents"), F.lit("")), toc, F.array(F.lit(""), F.lit("### Excerpts")), excerpt
        ),
        "\n",
    )
    plain = F.left(strip(F.substring_index(strip(content), "\n", 1)), F.lit(n))
    return F.when(F.size(chunks) > 0, full).otherwise(plain)


def build_tags(tier: Column, section: Column, content: Column) -> Column:
    langs = F.array_distinct(
        F.transform(F.regexp_extract_all(content, F.lit(rf"(?dm)^```([{WORD_CHARS}]+)"), F.lit(1)), F.lower)
    )
    heads = F.transform(
        F.regexp_extract_all(content, F.lit(r"(?dm)^#{1,6}\s+(.*)"), F.lit(1)), lambda h: F.lower(strip(h))
    )
    topics = F.slice(F.array_distinct(F.filter(heads, lambda h: h != "")), 1, 3)
    tag = lambda prefix, a: F.transform(a, lambda x: F.concat(F.lit(prefix), x))
    return F.concat(
        F.array(F.concat(F.lit("tier:"), tier), F.concat(F.lit("section:"), section)),
        tag("lang:", langs),
        tag("topic:", topics),
    )


def detect_version(content: Column) -> Column:
    found = [F.nullif(F.regexp_extract(content, "(?i)" + p, 1), F.lit("")) for p in VERSION_PATTERNS]
    return F.coalesce(F.concat(F.lit("v"), F.coalesce(*found)), F.lit("unversioned"))


def is_deprecated(content: Column) -> Column:
    return content.rlike("(?i)" + DEPRECATION)


# ---- paths ---------------------------------------------------------------
def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def ignored(path: Column, names) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def extract_section(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, F.get(parts, F.lit(1))).otherwise("")


def glob_to_regex(glob: str) -> str:
    """``*`` and ``?`` stay inside a path component, ``**`` spans any depth."""

    def simple(part: str) -> str:
        out = ""
        for token in re.findall(r"\*|\?|[^*?]+", part):
            out += {"*": "[^/]*", "?": "[^/]"}.get(token) or re.escape(token)
        return out

    parts = glob.split("**")
    out = ""
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        body = part.lstrip("/") if i else part
        body = body if last else body.rstrip("/")
        out += simple(body)
        if not last:
            out += "(?:.+/)?" if i == 0 and not body else "(?:/.+)?/?"
    return f"^{out}$"


def assign_tier(path: Column, tiers: list[tuple[str, list[str]]]) -> Column:
    """Name of the first tier with a matching glob, the last tier if none matches."""
    if not tiers:
        return F.lit("")
    hits = [F.when(path.rlike(glob_to_regex(g)), F.lit(name)) for name, globs in tiers for g in globs]
    return F.coalesce(*hits, F.lit(tiers[-1][0]))


def auto_tier(path: Column) -> Column:
    """The first path component that names a required or reference word decides."""
    parts = F.split(F.lower(F.regexp_replace(path, r"\\", "/")), "/")
    names = F.transform(parts, lambda p: F.regexp_replace(p, r"(?<=.)\.[^.]*$", ""))
    words = lambda p: F.concat(F.array(p), F.split(F.regexp_replace(p, "-", "_"), "_"))
    group = lambda p, w: F.arrays_overlap(words(p), F.array(*[F.lit(x) for x in w]))
    verdict = F.transform(
        names, lambda p: F.when(group(p, REQUIRED_WORDS), "required").when(group(p, REFERENCE_WORDS), "reference")
    )
    return F.coalesce(F.get(F.array_compact(verdict), F.lit(0)), F.lit("recommended"))
