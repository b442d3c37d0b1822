"""Language of texts by a small convolutional network over bytes, trained here in numpy.

A text is cut into windows of ``WINDOW`` bytes that cover all of it. Bytes are embedded, filters of
several widths slide over a window, each filter keeps its maximum, and one linear layer with softmax
gives the languages. A text's language is the one with the highest sum of the windows' log
probabilities, each window counting by its bytes; the score is the softmax of that mean.

Learning uses a bounded sample: for each language about ``per_lang`` labelled texts, those with the smallest
hashes of each share, and at most ``windows_per_text`` windows of each. Applying covers all texts whole.
Texts that are null or have no letter are ``und`` with score 0. Ties between languages go to the one
first in the alphabet. With no labelled text every text is ``und``; with one language that one is given; if no window of the
sample holds a letter nothing is learned and the first weights decide.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from trialspark.llm.common import columns

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 24  # of each width
EMBED = 8
PER_LANG = 600  # rounded up to a multiple of SHARES
SHARES = 64
WINDOWS_PER_TEXT = 6
UNKNOWN = "und"
WORDLIKE = re.compile(r"[^\W\d_]")  # letters, and numerals such as U+00BD

def has_letter(text: str) -> bool:
    """A code point of a category L, as ``\\p{L}`` in the JVM; the pattern only finds where to look."""
    return any(m[0].isalpha() for m in WORDLIKE.finditer(text))


def windows(data: bytes) -> np.ndarray:
    """Rows of ``WINDOW`` bytes covering ``data``, filled up with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, dtype=np.uint8)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(n, WINDOW)


class ByteCnn:
    """Embedding, filters of several widths, max pooling, softmax."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embed[0] = 0
        self.filters = [rng.normal(0, (2 / (w * EMBED)) ** 0.5, (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def _spread(self, e: np.ndarray, w: int) -> np.ndarray:
        n, length, d = e.shape
        s = e.strides
        view = np.lib.stride_tricks.as_strided(e, (n, length - w + 1, w * d), (s[0], s[1], s[2]))
        return np.ascontiguousarray(view).reshape(-1, w * d)

    def forward(self, x: np.ndarray, keep: bool = False):
        e = self.embed[x]
        pooled, held = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias):
            c = self._spread(e, w)
            y = (c @ f).reshape(len(x), -1, FILTERS)
            top = y.argmax(1) if keep else None
            m = y.max(1) + b
            pooled.append(np.maximum(m, 0))
            held.append((c.reshape(len(x), -1, c.shape[1]), top) if keep else None)
        h = np.concatenate(pooled, 1)
        z = h @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        logp = z - np.log(np.exp(z).sum(1, keepdims=True))
        return (logp, h, held) if keep else logp

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.004, seed: int = 7) -> None:
        """Adam on shuffled batches."""
        rng = np.random.default_rng(seed)
        params = [self.embed, *self.filters, *self.bias, self.out, self.out_bias]
        m1, m2, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                xb, yb = x[order[at : at + batch]], y[order[at : at + batch]]
                n = len(xb)
                logp, h, held = self.forward(xb, keep=True)
                dz = np.exp(logp)
                dz[np.arange(n), yb] -= 1
                dz /= n
                dh = (dz @ self.out.T) * (h > 0)
                de = np.zeros((256, EMBED), np.float32)
                grads_f, grads_b = [], []
                for k, w in enumerate(WIDTHS):
                    d = dh[:, k * FILTERS : (k + 1) * FILTERS]
                    c, top = held[k]
                    picked = c[np.arange(n)[:, None], top]  # n, filters, w*d
                    grads_f.append(np.einsum("nf,nfw->wf", d, picked))
                    grads_b.append(d.sum(0))
                    back = (d[:, :, None] * self.filters[k].T[None]).reshape(n, FILTERS, w, EMBED)
                    at_bytes = xb[np.arange(n)[:, None, None], top[:, :, None] + np.arange(w)]
                    np.add.at(de, at_bytes.ravel(), back.reshape(-1, EMBED))
                de[0] = 0
                grads = [de, *grads_f, *grads_b, h.T @ dz, dz.sum(0)]
                t += 1
                for p, g, a, b in zip(params, grads, m1, m2):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)

    def window_log_probs(self, x: np.ndarray, batch: int = 512) -> np.ndarray:
        return np.concatenate([self.forward(x[at : at + batch]) for at in range(0, len(x), batch)])


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int = PER_LANG, windows_per_text: int = WINDOWS_PER_TEXT) -> DataFrame:
    """``lang, h, pieces``: windows of about ``per_lang`` texts of each language.

    A language's texts fall into ``SHARES`` shares by the low bits of their hash; of each share the same number of
    texts with the smallest hashes is taken, so a language with most of the rows is spread over the tasks and no
    step sees all of it. Only windows travel, never texts."""
    rows = columns(docs, id=id_col, text=text_col, lang=lang_col).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    step = F.greatest(F.lit(1), F.floor(F.length("text") / windows_per_text)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(windows_per_text - 1)), lambda i: F.substring("text", i * step + 1, F.lit(WINDOW)))
    slim = rows.select("lang", F.xxhash64("id", "text").alias("h"), F.array_distinct(pieces).alias("pieces"))
    share = Window.partitionBy("lang", F.pmod("h", F.lit(SHARES))).orderBy("h", "pieces")
    ranked = slim.withColumn("rank", F.row_number().over(share))
    return ranked.filter(F.col("rank") <= -(-per_lang // SHARES)).select("lang", "h", "pieces")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, windows_per_text: int = WINDOWS_PER_TEXT) -> ByteCnn | None:
    """Fit on the bounded sample of ``docs`` (rows that may be learned from); None if there is none."""
    sample = training_sample(docs, id_col, text_col, lang_col, per_lang, windows_per_text)
    rows = sorted(sample.collect(), key=lambda r: (r["lang"], r["h"], r["pieces"]))  # at most languages x (per_lang + SHARES) short rows
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return None
    x, y = [], []
    for r in rows:
        for p in r["pieces"]:
            if has_letter(p):
                x.append(windows(p.encode("utf-8")[:WINDOW])[0])
                y.append(langs.index(r["lang"]))
    model = ByteCnn(langs)
    if len(langs) > 1 and x:
        model.train(np.stack(x), np.array(y))
    return model


def predict(docs: DataFrame, model: ByteCnn | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` for every row, from its text alone. No shuffle."""
    return with_language(columns(docs, **{id_col: id_col, "text": text_col}), model, "text").select(id_col, "lang_pred", "score")


def with_language(docs: DataFrame, model: ByteCnn | None, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All rows and columns of ``docs``, with the language and its score behind them. No shuffle, no join, so ids play no part."""
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else vars(model))
    place = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField(lang, StringType()), StructField(score, DoubleType())])

    def work(net, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if net is not None and t and has_letter(t)]
        if known:
            data = [texts[i].encode("utf-8") for i in known]
            cut = [windows(d) for d in data]
            logp = net.window_log_probs(np.concatenate(cut))
            ends = np.cumsum([len(c) for c in cut])
            weight = np.full(ends[-1], float(WINDOW))
            weight[ends - 1] = [max(1, len(d) - WINDOW * (len(c) - 1)) for d, c in zip(data, cut)]
            total = np.add.reduceat(logp * weight[:, None], np.concatenate(([0], ends[:-1])))
            mean = total / np.array([[max(1, len(d))] for d in data])
            best = total.argmax(1)
            p = np.exp(mean - mean.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for k, i in enumerate(known):
                langs[i], scores[i] = net.langs[best[k]], float(p[k, best[k]])
        return langs, scores

    def run(batches):
        net = None
        if shared.value is not None:
            net = ByteCnn.__new__(ByteCnn)
            net.__dict__.update(shared.value)
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                langs, scores = work(net, part.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays([*[c.cast(f.type) for c, f in zip(part.columns, arrow)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=arrow)

    return docs.mapInArrow(run, schema)


def held_out(id_col: Column) -> Column:
    """True for the documents that a model must not learn from: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))
