"""Personal data replaced by surrogates of the same kind and form.

Entities: e-mail addresses, IPv4 addresses, telephone numbers, payment card numbers (with a right check
digit) and names behind a form of address. A surrogate is drawn by HMAC-SHA256 from a secret key, the kind,
the entity's canonical form and a try number, so an entity is replaced alike everywhere and in all its forms
(coreference): a card or number with other separators, a mail in other case, a surname behind other forms of
address or with a given name. It is printed in the form of the place. It keeps

* letters as letters of the same case and script, digits as digits, everything else as it is;
* the last label of a mail domain, the leading one (1, 7) or two digits of a number behind a +, the first digit and a
  right check digit of a card, the lengths, private IPv4 ranges as private;
* the gender of a name (from the form of address) and the number of its parts.

Collision checks keep distinct entities distinct: a surrogate must differ from every entity found in the input and from
every other surrogate of its kind; the entity that loses draws again with the next try number, until all are
settled. From the fifth try on surrogates get longer (a private address moves to the largest private range), since a
short form may have no free surrogate left. Texts are null where they were null; texts without entities come back as they were; equal
texts (repeated rows too) get equal results; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import sys
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import columns, map_rows
from trialspark.session import frozen

MAX_TRIES = 64

#: Forms of address and given names by gender and script; fixed values.
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Sra", "Doña", "Госпожа"],
    "n": ["Dr", "Prof"],
}
GIVEN = {
    ("latin", "m"): ["Adam", "Bruno", "Carlos", "David", "Emil", "Felix", "Gabriel", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noah", "Oscar", "Pablo"],
    ("latin", "f"): ["Alice", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irene", "Julia", "Klara", "Laura", "Maria", "Nora", "Olivia", "Paula"],
    ("latin", "n"): ["Alex", "Charlie", "Dominique", "Eden", "Jules", "Kim", "Robin", "Sascha"],
    ("cyrillic", "m"): ["Алексей", "Борис", "Виктор", "Иван", "Михаил", "Николай", "Павел", "Сергей"],
    ("cyrillic", "f"): ["Анна", "Вера", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Татьяна"],
    ("cyrillic", "n"): ["Женя", "Саша", "Валя", "Шура"],
}
SYLLABLES = {
    "latin": ["ba", "den", "fel", "gar", "hol", "ka", "lin", "mor", "nes", "ost", "per", "ro", "sel", "tan", "vel", "win"],
    "cyrillic": ["ба", "ве", "гор", "да", "зим", "ка", "лев", "мар", "нов", "ор", "пет", "ро", "сан", "тар", "фед", "чер"],
}
TITLE_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
NAME = r"[^\W\d_a-zа-я][^\W\d_]+"
PATTERN = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,})"
    r"|(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d))"
    r"|(?P<card>(?<![\d\w])\d(?:[ \-]?\d){12,18}(?![\d\w]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[.\-])\d{3,4}[ .\-]\d{3,4}(?![\w])|(?<![\w+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?![\w]))"
    rf"|(?P<name>(?<!\w)(?:{'|'.join(TITLE_GENDER)})\.? {NAME}(?: {NAME})?)"
)
PHONE = re.compile(PATTERN.pattern[PATTERN.pattern.index("(?P<phone>") : PATTERN.pattern.index("|(?P<name>")])
DIGIT_RUN = re.compile(r"\d+(?:[ \-]\d+)*")
CARD_DIGITS = 13, 19
#: The other digits of Python's \d, as ranges; Java's \d has ASCII digits only, and its Unicode tables may be older.
OTHER_DIGITS = "".join(rf"\x{{{c:x}}}-\x{{{c + 9:x}}}" for c in range(128, sys.maxunicode + 1) if chr(c).isdecimal() and unicodedata.decimal(chr(c)) == 0)
#: Texts that this does not find (in the JVM) have no entity; they are neither sent to Python nor shuffled. A part of every
#: match of each kind: mail, telephone with +, IPv4, card, other telephone, name; or a digit that is not ASCII.
MAYBE = (
    rf"@|\+[0-9]|[0-9](?:\.[0-9]|(?:[ \-]?[0-9]){{{CARD_DIGITS[0] - 1}}}|[0-9]{{2}}[ .\-][0-9]{{3}})"
    rf"|(?=[{''.join(sorted({t[0] for t in TITLE_GENDER}))}])(?:{'|'.join(TITLE_GENDER)})[. ]|(?=[^\x00-\x7f])[{OTHER_DIGITS}]"
)


def check_digit_ok(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c)
        total += v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def cards_inside(text: str, start: int) -> tuple[list[tuple[int, int, str]], int]:
    """Cards in the run of digit groups that begins at ``start``, cut at separators, the longest first; and the run's end."""
    run = DIGIT_RUN.match(text, start)
    groups = [m.span() for m in re.compile(r"\d+").finditer(text, start, run.end())]
    tail = run.end() < len(text) and (text[run.end()].isalnum() or text[run.end()] == "_")
    found = []
    for i, (s, _) in enumerate(groups):
        n = 0
        for j in range(i, len(groups)):
            e = groups[j][1]
            n += e - groups[j][0]
            if n > CARD_DIGITS[1] or tail and e == run.end():
                break
            if n >= CARD_DIGITS[0] and check_digit_ok(re.sub(r"\D", "", text[s:e])):
                found.append((-n, s, e))
    out: list[tuple[int, int, str]] = []
    taken = bytearray(run.end() - start)
    for _, s, e in sorted(found):
        if not any(taken[s - start : e - start]):
            taken[s - start : e - start] = b"\1" * (e - s)
            out.append((s, e, "card"))
    return sorted(out), run.end()


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), in order and without overlaps. Where an IPv4 or a card is refused, what stands inside it still counts."""
    out, at, searched = [], 0, 0
    while m := PATTERN.search(text, at):
        kind, value, (start, at) = m.lastgroup, m.group(), m.span()
        refused = kind == "ip" and any(int(x) > 255 for x in value.split(".")) or kind == "card" and not check_digit_ok(re.sub(r"\D", "", value))
        if not refused:
            out.append((start, at, kind))
            continue
        cards = []
        if kind == "card" and start >= searched:
            cards, searched = cards_inside(text, start)
        at = start
        for card in cards:
            out += [(p.start(), p.end(), "phone") for p in PHONE.finditer(text, at, card[0])] + [card]
            at = card[1]
        if not cards:
            phone = PHONE.match(text, start)
            if phone:
                out.append((start, phone.end(), "phone"))
            at = phone.end() if phone else start + 1
    return out


def stream(key: bytes, kind: str, value: str, attempt: int) -> Callable[[int], int]:
    """Numbers below n, one after the other, from the key and the entity."""
    seed = hmac.new(key, f"{kind}\0{attempt}\0{value}".encode(), hashlib.sha256).digest()
    state = {"pool": int.from_bytes(seed, "big"), "left": 1 << 256, "n": 0}

    def draw(n: int) -> int:
        if state["left"] < n << 64:
            state["n"] += 1
            state["pool"] = int.from_bytes(hashlib.sha256(seed + state["n"].to_bytes(4, "big")).digest(), "big")
            state["left"] = 1 << 256
        state["pool"], out = divmod(state["pool"], n)
        state["left"] //= n
        return out

    return draw


def alphabet(char: str) -> str:
    """The characters that may stand for this one: same script and case, or digits."""
    if char.isdigit():
        return "0123456789"
    if "а" <= char.lower() <= "я":
        letters = "абвгдежзиклмнопрстуфхцчшщэюя"
    elif "α" <= char.lower() <= "ω":
        letters = "αβγδεζηθικλμνξοπρστυφχψω"
    else:
        letters = "abcdefghijklmnopqrstuvwxyz"
    return letters.upper() if char.isupper() else letters


def scramble(text: str, draw: Callable[[int], int]) -> str:
    return "".join(a[draw(len(a))] if c.isalnum() else c for c in text for a in (alphabet(c),))


def digits_of(text: str) -> str:
    return "".join(str(unicodedata.digit(c)) for c in text if c.isdigit())


def canonical(kind: str, value: str) -> str:
    """What forms of one entity have in common: folded mail, digits (with a leading +), numbers of an address, folded surname."""
    if kind == "email":
        return value.lower()
    if kind == "ip":
        return ".".join(str(int(x)) for x in value.split("."))
    if kind == "name":
        return value.split(" ")[-1].lower()
    return ("+" if value.startswith("+") else "") + digits_of(value)


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """The surrogate of a canonical form, canonical itself. Every fourth try is wider, so a form that is used up has room again."""
    draw = stream(key, kind, value, attempt)
    wide = attempt // 4
    some = lambda n: "".join(str(draw(10)) for _ in range(n))
    if kind == "email":
        head, _, last = value.rpartition(".")
        local, _, domain = head.partition("@")
        return f"{scramble(local, draw)}{scramble('x' * wide, draw)}@{scramble(domain, draw)}.{last}"
    if kind == "ip":
        parts = [int(x) for x in value.split(".")]
        keep = 1 if parts[0] in (10, 127) else 2 if tuple(parts[:2]) == (192, 168) or parts[0] == 172 and 16 <= parts[1] < 32 else 0
        if keep == 2 and wide:  # the larger private range
            parts, keep = [10, 0, 0, 0], 1
        if wide >= 8:
            keep = 0
        new = parts[:keep] + [draw(256) for _ in parts[keep:]]
        if not keep:
            new[0] = [x for x in range(1, 224) if x not in (10, 127, 172, 192)][draw(219)]
        return ".".join(map(str, new))
    if kind == "phone":
        plus, digits = value[: value.startswith("+")], value.lstrip("+")
        code = digits[: (1 if digits[:1] in "17" else 2) if plus else 0]
        return plus + code + some(len(digits) - len(code) + wide)
    if kind == "card":
        new = value[0] + some(min(CARD_DIGITS[1], len(value) + wide) - 2)
        return new + next(c for c in "0123456789" if check_digit_ok(new + c))
    script = "cyrillic" if re.search("[а-яА-Я]", value) else "latin"
    return "".join(SYLLABLES[script][draw(16)] for _ in range(3 + wide))


def cased(text: str, like: str) -> str:
    return "".join(c.upper() if k < len(like) and like[k].isupper() else c for k, c in enumerate(text))


def printed(key: bytes, kind: str, value: str, new: str) -> str:
    """The surrogate ``new`` in the form of the place: case, separators, form of address. Given names are drawn by gender."""
    if kind == "email":
        local, _, domain = new.rpartition(".")[0].partition("@")
        head, _, last = value.rpartition(".")
        was_local, _, was_domain = head.partition("@")
        return f"{cased(local, was_local)}@{cased(domain, was_domain)}.{last}"
    if kind in ("card", "phone"):
        left = list(new.lstrip("+"))
        out = "".join(left.pop(0) if c.isdigit() else c for c in value)
        return out + "".join(left)
    if kind == "ip":
        return new
    title, *names = value.split(" ")
    gender = TITLE_GENDER[title.rstrip(".")]
    out = [title]
    for n in names[:-1]:
        given = GIVEN["cyrillic" if re.search("[а-яА-Я]", n) else "latin", gender]
        new_given = given[stream(key, "given", n.lower(), 0)(len(given))]
        out.append(new_given.upper() if n.isupper() and len(n) > 1 else new_given)
    last = names[-1]
    return " ".join([*out, new.upper() if last.isupper() and len(last) > 1 else new.capitalize()])


def detect(docs: DataFrame) -> DataFrame:
    """``text_key, entities`` (place, kind, canonical value) from ``text_key, text``; texts without entities give no row."""

    def work():
        def step(batch: pa.RecordBatch):
            keys, found = [], []
            for at in range(0, batch.num_rows, 512):
                for k, t in zip(batch.column(0).slice(at, 512), batch.column(1).slice(at, 512).to_pylist()):
                    spans = find_entities(t) if t else []
                    if spans:
                        keys.append(k.as_py())
                        found.append([{"start": s, "end": e, "kind": kind, "value": canonical(kind, t[s:e])} for s, e, kind in spans])
            yield {"text_key": keys, "entities": found}

        return step

    return map_rows(docs, "text_key binary, entities array<struct<start:int,end:int,kind:string,value:string>>", work)


def assign_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """``kind, value, surrogate`` for distinct ``kind, value`` (canonical); rounds go on until no surrogate collides."""

    def drawn(df: DataFrame, attempt: int) -> DataFrame:
        def work():
            def step(batch: pa.RecordBatch):
                kinds, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                yield {"kind": kinds, "value": values, "surrogate": [surrogate(key, k, v, attempt) for k, v in zip(kinds, values)]}

            return step

        return map_rows(df.select("kind", "value"), "kind string, value string, surrogate string", work)

    pending, settled = entities, None
    for attempt in range(MAX_TRIES):
        tries = drawn(pending, attempt)
        winner = tries.groupBy("kind", "surrogate").agg(F.min("value").alias("winner"))
        taken = entities.select("kind", F.col("value").alias("surrogate"))
        if settled is not None:
            taken = taken.union(settled.select("kind", "surrogate"))
        free = winner.join(taken, ["kind", "surrogate"], "left_anti").select("kind", F.col("winner").alias("value"), "surrogate")
        good = frozen(free)
        settled = good if settled is None else frozen(settled.union(good))
        pending = frozen(pending.join(good, ["kind", "value"], "left_anti"))
        if not pending.limit(1).count():
            return settled
    raise RuntimeError(f"some entities have no free surrogate after {MAX_TRIES} tries")


def replace_entities(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text, n_entities`` for every row. Texts without entities are not shuffled."""
    slim = columns(docs, **{id_col: id_col, "text": text_col})
    maybe = F.coalesce(F.col("text").rlike(MAYBE), F.lit(False))
    keyed = slim.filter(maybe).withColumn("text_key", F.unhex(F.md5(F.col("text").cast("binary"))))
    found = frozen(detect(keyed.select("text_key", "text")))
    found = found.dropDuplicates(["text_key"])
    spans = found.select("text_key", F.explode("entities").alias("e")).select("text_key", "e.*")
    names = assign_surrogates(frozen(spans.select("kind", "value").distinct()), key)
    named = spans.join(names, ["kind", "value"]).groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind", "surrogate"))).alias("spans"))
    kind = slim.schema[id_col].dataType.simpleString()

    def work():
        def step(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 256):
                out: dict = {id_col: batch.column(0).slice(at, 256), "text": [], "n_entities": []}
                for t, spans in zip(batch.column(1).slice(at, 256).to_pylist(), batch.column(2).slice(at, 256).to_pylist()):
                    done, parts = 0, []
                    for s in spans or ():
                        parts += [t[done : s["start"]], printed(key, s["kind"], t[s["start"] : s["end"]], s["surrogate"])]
                        done = s["end"]
                    out["text"].append(t if t is None else "".join(parts) + t[done:])
                    out["n_entities"].append(len(spans or ()))
                yield out

        return step

    joined = keyed.join(named, "text_key", "left").select(id_col, "text", "spans")
    replaced = map_rows(joined, f"`{id_col}` {kind}, text string, n_entities int", work)
    return replaced.union(slim.filter(~maybe).select(id_col, "text", F.lit(0).alias("n_entities")))
