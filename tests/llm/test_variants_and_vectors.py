"""SimHash components, whitening and spelling variants against plain Python, and their odd cases."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trialspark.llm import decontaminate, language_id, near_dedup, pii, queries, simhash, spelling, whitening

SF = "/root/testdata/sf0.001"


# --- op11 -------------------------------------------------------------------------------------------------------------


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(4, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def plain_components(prints, ids, radius=4):
    """Smallest id reachable, over all pairs."""
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(set(prints)), 2):
        if (a ^ b).bit_count() <= radius:
            root[find(b)] = find(a)
    least = {}
    for p, i in zip(prints, ids):
        if i is not None:
            least[find(p)] = min(i, least.get(find(p), i))
    return [least.get(find(p)) for p in prints]


def test_simhash_equals_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op11_simhash_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_simhash(r.text) for r in rows]
    want = plain_components(prints, [r.doc_id for r in rows])
    assert got == {r.doc_id: (f"{p:016x}", c) for r, p, c in zip(rows, prints, want)}


def families(seed=5):
    """Random fingerprints, chains of links, dense balls, and pairs at 4 and 5 bits."""
    r = random.Random(seed)
    flip = lambda x, n: x ^ sum(1 << b for b in r.sample(range(64), n))
    out = [r.getrandbits(64) for _ in range(300)] + [0, (1 << 64) - 1]
    for _ in range(40):
        x = r.getrandbits(64)
        out += [x, flip(x, 4), flip(x, 5)]
    x = r.getrandbits(64)
    for _ in range(60):
        x = flip(x, r.choice([3, 4, 5]))
        out.append(x)
    core = r.getrandbits(64)
    return out + [flip(core, r.randrange(9)) for _ in range(400)]


@pytest.mark.parametrize("how", [{}, {"shard_rows": 40}, {"sample": 64}, {"sample": 1}, {"parts": (64,)}, {"parts": (32, 32), "shard_rows": 100}])
def test_links_keep_all_components(spark, how):
    prints = sorted(set(families()))
    nodes = spark.createDataFrame([(int(np.array(p, dtype=np.uint64).view(np.int64)),) for p in prints], "fp long")
    edges = simhash.links(nodes, len(prints), **how).collect()
    unsigned = lambda x: x & (1 << 64) - 1
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        root[find(unsigned(e.b))] = find(unsigned(e.a))
    order = {p: k for k, p in enumerate(prints)}
    want = plain_components(prints, [order[p] for p in prints])
    label = {}
    for p in prints:
        label[find(p)] = min(order[p], label.get(find(p), order[p]))
    assert [label[find(p)] for p in prints] == want


def test_simhash_odd_rows(spark):
    texts = ["", None, " \t\n", "one", "One", "a b c", "a b c d e", "\x0bA\x0cB  C", "é É ß 漢字 🙂 ünï", " x y z w q", "w " * 50_000]
    rows = [(k, t, "x", k) for k, t in enumerate(texts)] + [(3, "one", "x", 0), (None, "", "y", 0), (None, "nobody else here at all", "y", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, component_id long")
    got = simhash.near_duplicates(docs).collect()
    prints = [plain_simhash(r[1]) for r in rows]
    want = plain_components(prints, [r[0] for r in rows])
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, want))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    one = simhash.near_duplicates(docs.filter("doc_id = 5")).collect()
    assert [(r.doc_id, r.component_id) for r in one] == [(5, 5)]


# --- op12 -------------------------------------------------------------------------------------------------------------


def plain_whitening(vectors):
    """Exact sums by Python integers; covariance over the distinct integer vectors."""
    xs = {i: tuple(math.floor(256 * float(c)) for c in v) for i, v in vectors.items()}
    fit = list(dict.fromkeys(xs.values()))
    n, d = len(fit), len(fit[0])
    sums = [sum(v[k] for v in fit) for k in range(d)]
    centred = [[n * v[k] - sums[k] for k in range(d)] for v in fit]
    cov = np.array([[sum(z[i] * z[j] for z in centred) / n**3 for j in range(d)] for i in range(d)])
    far = {i: sum((n * v[k] - sums[k]) ** 2 for k in range(d)) for i, v in xs.items()}
    return n, far, cov, {i: np.array([v[k] - sums[k] / n for k in range(d)]) for i, v in xs.items()}


def check_whitening(rows, vectors, top=4):
    n, far, cov, centred = plain_whitening(vectors)
    values, parts = np.linalg.eigh(cov)
    order = np.argsort(-values)[:top]
    got = {(r.vec_id, r.component): r for r in rows}
    assert set(got) == {(i, k + 1) for i in vectors for k in range(min(top, len(cov)))}
    for k, o in enumerate(order):
        a = np.array([got[i, k + 1].whitened for i in vectors])
        b = np.array([centred[i] @ parts[:, o] / math.sqrt(values[o]) for i in vectors])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
    for r in rows:
        assert (r.n, int(r.deviation)) == (n, far[r.vec_id])
        assert r.explained == pytest.approx(values[order[r.component - 1]] / np.trace(cov), rel=1e-9)
        assert r.identity_error < 1e-9
    assert len({r.identity_error for r in rows}) == 1


def test_whitening_equals_plain_integers(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in table.collect()}
    check_whitening(queries.op12_embedding_whitening(spark, SF).collect(), vectors)


def test_bit_sliced_scatter_is_exact():
    r = random.Random(3)
    for rows, low, high in [(1, -3, 3), (63, -5, 5), (64, 0, 1), (65, -(2**40), 2**40), (200, -(2**62), 2**62), (70, -(2**63), 2**63 - 1), (9, 7, 7)]:
        x = [[r.randint(low, high) for _ in range(5)] for _ in range(rows)]
        sums, cross = whitening.scatter(np.array(x, dtype=np.int64))
        assert sums.tolist() == [sum(v[i] for v in x) for i in range(5)]
        assert cross.tolist() == [[sum(v[i] * v[j] for v in x) if j >= i else 0 for j in range(5)] for i in range(5)]


def test_whitening_odd_rows(spark):
    r = random.Random(1)
    good = {i: [2.0**20 * r.gauss(0, 1), 2.0**20 * r.gauss(0, 3), 2.0**20 * r.gauss(2, 0.5)] for i in range(40)}
    rows = [(i, v, 0.0) for i, v in good.items()]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [1.0, 2.0])]
    kinds = "vec_id long, embedding array<double>, whitened double"
    got = whitening.whiten(spark.createDataFrame(rows + [(i, v, 1.0) for i, v in bad], kinds)).collect()
    check_whitening(got, good)
    # repeated rows come back and count once in the fit
    twice = whitening.whiten(spark.createDataFrame(rows + rows[:5] + [(None, good[3], 0.0)], kinds)).collect()
    assert Counter(x.vec_id for x in twice)[0] == 6 and Counter(x.vec_id for x in twice)[None] == 3 and {x.n for x in twice} == {40}
    for few in ([], [(1, None, 0.0)]):
        assert whitening.whiten(spark.createDataFrame(few, kinds)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0.0), (2, [1.0, 3.0], 0.0)], kinds)).collect()
    assert {(x.component, x.whitened is None) for x in flat} == {(1, False), (2, True)} and all(x.identity_error < 1e-9 for x in flat)
    alone = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0.0)], kinds)).collect()
    assert [(x.deviation, x.whitened, x.explained, x.identity_error) for x in alone] == [(0, None, None, None)] * 2


# --- op13 -------------------------------------------------------------------------------------------------------------


def plain_spelling(rows, min_length=6, min_count=5):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    by_hole, near = {}, {w: set() for w in words}
    for w in words:
        for k in range(len(w)):
            by_hole.setdefault((w[:k], w[k + 1 :]), []).append(w)
            shorter = w[:k] + w[k + 1 :]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in by_hole.values():
        for a, b in itertools.permutations(group, 2):
            near[a].add(b)
    forms = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= 5 * n else None

    def root(w):
        while forms[w]:
            w = forms[w]
        return w

    return {w: (forms[w], root(w), n, len(near[w]), words.get(forms[w])) for w, n in words.items()}


def spelled(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_spelling_equals_plain_neighbours(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plain_spelling(rows)
    assert spelled(queries.op13_spelling_variants(spark, sf)) == want
    assert sum(w[0] is not None for w in want.values()) > 50


def edits(seed=2):
    """Words with all kinds of edits, repeated letters, long words and equal halves."""
    r = random.Random(seed)
    base = ["banana", "bananaa", "bbanana", "aaaaaa", "aaaaaaa", "ababab", "bababa", "éclairs", "eclairs", "straße", "strasse", "x" * 300, "x" * 301, "x" * 150 + "y" + "x" * 150]
    for _ in range(60):
        w = "".join(r.choice("abé") for _ in range(r.randrange(6, 9)))
        k = r.randrange(len(w))
        base += [w, w[:k] + w[k + 1 :], w[:k] + r.choice("abÿ") + w[k:], w[:k] + "q" + w[k + 1 :]]
    return [" ".join([w] * r.choice([1, 4, 5, 6, 30, 200])) for w in base]


@pytest.mark.parametrize("tile", [2048, 7])
def test_spelling_tiles_and_odd_rows(spark, tile):
    texts = edits() + ["", None, "...", "×÷×÷×÷ " * 9, "ABCdefÀ " * 7, "漢字 only", "kitten_kitten-Kitten " * 4]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "banana kitten " * 5)]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n long")
    assert spelled(spelling.spelling_variants(docs, tile=tile)) == plain_spelling(rows)
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
    assert spelling.spelling_variants(docs.select("doc_id", F.lit(None).cast("string").alias("text"))).count() == 0


def test_roots_follow_chains(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(9)] + [("v", "w0")]
    got = spelling.roots(spark.createDataFrame(chain, "word string, form string"), lambda df: df.cache())
    assert {(r.word, r.root) for r in got.collect()} == {(w, "w9") for w, _ in chain}


# --- letters, ids and blocks of the earlier operators -----------------------------------------------------------------


def test_numerals_are_no_letters(spark):
    texts = ["½", "① ②", "Ⅷ", "²", "_ 12", "ª", "ß", "漢", "½ ab"]
    rows = [(k, t, "en" if k % 2 else "es") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}
    assert [got[k] == "und" for k in range(9)] == [True] * 5 + [False] * 4
    letters = {r.doc_id for r in docs.filter(F.col("text").rlike(r"\p{L}")).collect()}
    assert letters == {k for k, v in got.items() if v != "und"}


def test_training_sample_without_letters(spark):
    docs = spark.createDataFrame([(k, "1" * 10_000 + "a" + "2" * 10_000, lang) for k, lang in enumerate(["en", "es"])], "doc_id long, text string, lang string")
    model = language_id.train(docs, windows_per_text=1)
    assert model.langs == ["en", "es"]
    assert {r.lang_pred for r in language_id.predict(docs, model).collect()} <= {"en", "es"}


def test_stages_with_null_and_repeated_ids(spark):
    import corpus_pipeline

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    text = lambda: " ".join(word() for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, a), (None, a), (None, b), (5, b), (6, c), (6, d), (7, c), (None, None), (8, "12 34"), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], kinds)
    left = Counter((x.doc_id, x.text) for x in near_dedup.drop_near_duplicates(docs).collect())
    assert left == Counter({(None, a): 2, (5, b): 1, (6, c): 1, (6, d): 1, (8, "12 34"): 1, (9, None): 1})
    bench = spark.createDataFrame([(1, " ".join(c.split()[:20])), (2, " ".join(b.split()[30:50])), (3, None)], "item_id long, text string")
    for block_words in (1000, 15):
        left = Counter((x.doc_id, x.text) for x in decontaminate.drop_contaminated(docs, bench, block_words=block_words).collect())
        assert left == Counter([(i, t) for i, t in rows if t not in (b, c)])
        pairs = decontaminate.contaminated_pairs(docs, bench, block_words=block_words).collect()
        assert sorted((str(p.doc_id), p.item_id, p.matched_words) for p in pairs) == [("5", 2, 20), ("6", 1, 20), ("7", 1, 20), ("None", 2, 20)]
    model = language_id.train(docs)
    kept = corpus_pipeline.keep_known_languages(spark, docs, SF)
    assert Counter((x.doc_id, x.text) for x in kept.collect()) == Counter([(i, t) for i, t in rows if t and t != "12 34"]) and kept.columns == docs.columns
    assert model.langs == ["en"]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


# --- surrogates: forms of one entity, and forms that are used up ------------------------------------------------------


def test_forms_of_an_entity_share_a_surrogate(spark):
    texts = ["pay 4111 1111 1111 1111 or 4111111111111111 or 4111-1111-1111-1111.", "call +1 555 555 1234 or +1-555-555-1234!", "Ann@x.org and ann@X.org", "Mr Karl Weber, Mr. Weber, Herr WEBER, Mrs Karla Weber"]
    got = [r.text for r in pii.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), b"k").orderBy("doc_id").collect()]
    cards = re.findall(r"\d[\d \-]{14,}\d", got[0])
    assert len({re.sub(r"\D", "", c) for c in cards}) == 1 and [len(c) for c in cards] == [19, 16, 19] and pii.check_digit_ok(re.sub(r"\D", "", cards[0]))
    numbers = re.findall(r"\+1[ \-]\d{3}[ \-]\d{3}[ \-]\d{4}", got[1])
    assert len(numbers) == 2 and len({re.sub(r"\D", "", n) for n in numbers}) == 1
    mails = got[2].split(" and ")
    assert mails[0].lower() == mails[1].lower() and mails[0][0].isupper() and mails[1].split("@")[1][0].isupper() and mails[0] != "Ann@x.org"
    names = re.fullmatch(r"Mr (\w+) (\w+), Mr\. (\w+), Herr (\w+), Mrs (\w+) (\w+)", got[3])
    assert {names[2], names[3], names[4].capitalize(), names[6]} == {names[2]} and names[2] != "Weber" and names[4].isupper()
    assert names[1] in pii.GIVEN["latin", "m"] and names[5] in pii.GIVEN["latin", "f"]


def test_used_up_forms_get_wider(spark):
    mails = [f"{a}@{b}.co" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    got = pii.replace_entities(spark.createDataFrame(list(enumerate(mails)), "doc_id long, text string"), b"k").collect()
    new = {r.text for r in got}
    assert len(new) == len(mails) and not new & set(mails) and all(re.fullmatch(r"[a-z]{2,}@[a-z]\.co", t) for t in new)
