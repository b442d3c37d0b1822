"""Secrets in texts: candidates by pattern, false positives removed by a random forest. DataFrame functions only.

Candidates are runs of 16 or more key characters, runs of 8 or more of them behind ``=``, ``:`` or a quote, and values: 8 or
more characters of any kind behind an assignment, a quote or a credential word, with or without white space between, up to
the next quote or white space. A run may stand inside a value; both are candidates then. The forest sees

* length, shares of digits, upper and lower case letters, distinct characters;
* character transitions: changes of class per character, and the same for letters to digits;
* dictionary coverage: the share of the candidate's character triples that stand in a word of the dictionary (the most
  frequent words of all texts; its triples are a table of 26^3 bits);
* path: whether it looks like tests, samples or documents, or like configuration;
* neighbouring words: credential or checksum words before it, an assignment or quote in front, what follows.

It is trained from labelled findings, of which at most ``per_label`` for each label are used (smallest hashes), so
training has a fixed size; scanning and the dictionary cover all texts whole. Null and empty texts have no
candidates; equal candidates at several places are findings each; with labels of one kind only, that label is given to all.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.llm.common import columns
from trialspark.session import frozen

KEY = r"A-Za-z0-9_+/\-"
#: A run starts where a stretch of key characters starts, so nothing is tried inside a word.
RUN = rf"(?<![{KEY}])((?:(?<=[=:\"'])[{KEY}]{{8,}}+|[{KEY}]{{16,}}+)={{0,2}})"
WORDS_BEFORE = r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|credential|auth|bearer|private)"
#: Values behind something in the same word (the lead is used up, the value only looked at, so values may overlap); in a
#: word behind these; and words that can have any of them.
VALUE = rf"(?:[=:\"'`]|{WORDS_BEFORE}[^\w\s]{{1,3}})(?=([^\s\"'`]{{8,}}))"
LEADS = rf"(?:[=:]>?|{WORDS_BEFORE}[^\w\s]*)$"
FIRST = r"^[(\[{<]*(?=([^\s\"'`]{8,}))"
MAYBE = rf"[=:\"'`](?=[^\s\"'`]{{8}})|(?<![{KEY}])[{KEY}]{{16}}|{WORDS_BEFORE}[^\w\s]"
MASK = "[secret]"
DICTIONARY_WORDS = 5000
PER_LABEL = 2000
CREDENTIAL = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|credential|auth|bearer|private)\W*$"
CHECKSUM = r"(?i)(sha\d*|md5|commit|checksum|digest|hash|uuid|etag|revision|isbn)\W*$"
FEATURES = ["length", "digits", "uppers", "lowers", "distinct_chars", "transitions", "letter_digit", "coverage", "path_test", "path_config", "credential", "checksum", "assigned", "quoted", "next_word"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """``id, text_key, path, word_no, run_no, candidate, before, after``: one row per place. A place takes its neighbours along
    when it is cut out of the text, so no text or array of words travels with it."""
    wanted = {"id": id_col, "text": text_col} | ({"path": path_col} if path_col else {})
    slim = columns(docs, **wanted)
    if not path_col:
        slim = slim.withColumn("path", F.lit(""))
    words = slim.select("id", F.coalesce("path", F.lit("")).alias("path"), F.md5(F.col("text").cast("binary")).alias("text_key"), F.split("text", r"\s+").alias("w"))
    near = lambda i: F.coalesce(F.get("w", i), F.lit(""))
    long = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.length(F.get("w", i)) >= 8)
    hit = lambda i: near(i).rlike(MAYBE) | (near(i - 1).rlike(LEADS) & near(i).rlike(FIRST))
    place = lambda i: F.struct(
        i.alias("word_no"), near(i).alias("word"), near(i - 1).alias("lead"), F.concat_ws(" ", near(i - 2), near(i - 1)).alias("back"), near(i + 1).alias("after")
    )
    placed = words.select("id", "path", "text_key", F.explode(F.transform(F.filter(long, hit), place)).alias("p")).select("id", "path", "text_key", "p.*")
    every = lambda pattern: F.regexp_extract_all("word", F.lit(pattern), 1)
    first = F.when(F.col("lead").rlike(LEADS), every(FIRST)).otherwise(F.array().cast("array<string>"))
    found = placed.withColumn("runs", every(RUN)).withColumn("all", F.concat("runs", F.array_except(F.concat(every(VALUE), first), "runs")))
    cut = found.select("*", F.posexplode("all").alias("run_no", "candidate"))  # runs keep their numbers and their repeats
    nth = F.size(F.filter(F.slice("all", 1, F.col("run_no") + 1), lambda c: c == F.col("candidate")))
    return cut.select(
        "id",
        "text_key",
        "path",
        "word_no",
        "run_no",
        "candidate",
        F.concat("back", F.lit(" "), F.call_function("substring_index", "word", "candidate", nth)).alias("before"),
        "after",
    )


def dictionary_triples(docs: DataFrame, text_col: str = "text", n_words: int = DICTIONARY_WORDS) -> bytes:
    """A bit table (one byte each) of the letter triples in the ``n_words`` most frequent words of 3 to 12 letters.

    Words are counted in the map tasks before the shuffle; the driver gets at most 26^3 triples.
    """
    words = columns(docs, text=text_col).select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("word")).filter(F.length("word").between(3, 12))
    top = words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(n_words)
    triples = top.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 2), lambda i: F.substring("word", i, F.lit(3)))).alias("t")).distinct()
    table = bytearray(26**3)
    for r in triples.collect():
        a, b, c = (ord(x) - 97 for x in r["t"])
        table[(a * 26 + b) * 26 + c] = 1
    return bytes(table)


def coverage(candidate: Column, table: bytes) -> Column:
    """Share of the candidate's triples that are in the table."""
    low = F.lower(candidate)
    code = lambda i: F.ascii(F.substring(low, i, F.lit(1))) - 97
    inside = lambda c: c.between(0, 25)

    def known(i):
        a, b, c = code(i), code(i + 1), code(i + 2)
        bit = F.hex(F.substring(F.lit(table), (a * 26 + b) * 26 + c + 1, F.lit(1)))
        return inside(a) & inside(b) & inside(c) & (bit == "01")

    hits = F.size(F.filter(F.sequence(F.lit(1), F.length(low) - 2), known))
    return hits / (F.length(low) - 2)


def with_features(found: DataFrame, table: bytes) -> DataFrame:
    c = F.col("candidate")
    n = F.length(c)
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    flag = lambda column, pattern: F.col(column).rlike(pattern).cast("double")
    return found.select(
        "*",
        n.cast("double").alias("length"),
        share("[0-9]").alias("digits"),
        share("[A-Z]").alias("uppers"),
        share("[a-z]").alias("lowers"),
        (F.size(F.array_distinct(F.split(c, ""))) / n).alias("distinct_chars"),
        share("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])").alias("transitions"),
        share("(?<=[A-Za-z])(?=[0-9])").alias("letter_digit"),
        coverage(c, table).alias("coverage"),
        flag("path", r"(?i)test|spec|sample|example|mock|fixture|doc").alias("path_test"),
        flag("path", r"(?i)env|conf|\.ya?ml|\.ini|\.json|\.pem|secret").alias("path_config"),
        flag("before", CREDENTIAL).alias("credential"),
        flag("before", CHECKSUM).alias("checksum"),
        flag("before", r"[=:]\W*$").alias("assigned"),
        flag("before", r"[\"'`]$").alias("quoted"),
        flag("after", r"^[A-Za-z]+[.,;]?$").alias("next_word"),
    )


def train(labelled: DataFrame, table: bytes, per_label: int = PER_LABEL, trees: int = 20, depth: int = 6, seed: int = 11):
    """A forest from findings with a 0/1 ``label`` column; None-like constants if only one label is there.

    Equal findings (candidate, surroundings, path) count once; the sample is the ``per_label`` smallest hashes of each label.
    """
    kinds = ["candidate", "before", "after", "path", "label"]
    distinct = labelled.select(*kinds).distinct().withColumn("h", F.xxhash64(*kinds))
    picked = [distinct.filter(F.col("label") == k).orderBy("h", *kinds).limit(per_label) for k in (0, 1)]
    rows = [r for p in picked for r in p.collect()]  # at most 2 x per_label short rows
    labels = {r["label"] for r in rows}
    if len(labels) < 2:
        return float(labels.pop()) if labels else 0.0
    sample = labelled.sparkSession.createDataFrame([tuple(r[k] for k in kinds) for r in rows], "candidate string, before string, after string, path string, label int")
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(sample, table)).select("features", F.col("label").cast("double").alias("label")).coalesce(1)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features").fit(ready)


def score(found: DataFrame, model, table: bytes) -> DataFrame:
    """The candidates with ``score``, the forest's share of votes for a secret."""
    if isinstance(model, float):
        return found.withColumn("score", F.lit(model))
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(found, table))
    done = model.transform(ready)
    return done.select(*found.columns, vector_to_array("probability")[1].alias("score"))


def weak_labels(found: DataFrame) -> DataFrame:
    """Labels for texts that come without: 1 for documented key formats and values assigned to credential words, 0 for words,
    numbers and checksums; other candidates get none and are left out."""
    c = F.col("candidate")
    yes = (
        c.rlike("^AKIA[0-9A-Z]{16}$")
        | c.rlike("^gh[pousr]_[A-Za-z0-9]{36}$")
        | c.rlike("^AIza[A-Za-z0-9_\\-]{35}$")
        | (F.col("before").rlike(CREDENTIAL) & c.rlike("[0-9]") & c.rlike("[A-Za-z]"))
    )
    no = c.rlike("^[A-Za-z_/\\-]+$") | c.rlike("^[0-9\\-]+$") | (F.col("before").rlike(CHECKSUM) & c.rlike("^[0-9a-f]+$"))
    return found.withColumn("label", F.when(yes, 1).when(no, 0)).filter(F.col("label").isNotNull())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", labelled: DataFrame | None = None, threshold: float = 0.5, n_words: int = DICTIONARY_WORDS, per_label: int = PER_LABEL) -> DataFrame:
    """Findings at ``threshold`` or more: ``id, text_key, word_no, run_no, candidate, score``."""
    table = dictionary_triples(docs, text_col, n_words)
    found = frozen(candidates(docs, id_col, text_col, path_col))  # read for both labels and for the scores
    model = train(weak_labels(found) if labelled is None else labelled, table, per_label)
    return score(found, model, table).filter(F.col("score") >= threshold).select("id", "text_key", "word_no", "run_no", "candidate", "score")


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", **how) -> DataFrame:
    """All rows and columns of ``docs``; secrets in the text become ``[secret]``. Findings are joined by the text's digest, one
    row per text, so copies and null ids are masked as well."""
    found = scan(docs, id_col, text_col, path_col, **how)
    per_text = found.groupBy(F.col("text_key").alias("_key")).agg(F.collect_set("candidate").alias("_secrets"))
    longest_first = F.transform(F.sort_array(F.transform("_secrets", lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))), asc=False), lambda x: x["s"])
    keyed = docs.withColumn("_key", F.md5(F.col(text_col).cast("binary")))
    masked = F.aggregate(longest_first, F.col(text_col), lambda t, s: F.replace(t, s, F.lit(MASK)))
    joined = keyed.join(per_text, "_key", "left").withColumn(text_col, F.when(F.col("_secrets").isNull(), F.col(text_col)).otherwise(masked))
    return joined.select(*docs.columns)
