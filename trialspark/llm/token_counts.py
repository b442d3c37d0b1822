"""Token counts of documents by a trie over distinct pre-tokens.

The distinct pre-tokens of a batch go into a trie. Every node keeps the best unigram score of its
prefix and the number of tokens on that best path; both follow from the node's ancestors alone, so
they are worked out once per shared prefix, when the node is made. A pre-token's count is what its
last node keeps, and a document's count is the sum over its pre-tokens.

Pre-tokens are the space-led chunks of ``pieces``, so counts equal the lengths of its encodings. A
character without a piece counts as its UTF-8 bytes (as one token if the model has no byte pieces).
Null and empty texts have 0 tokens. The trie stays in a task from batch to batch and starts anew
when it has ``max_nodes`` nodes; counts do not depend on that. It holds the first ``DEPTH`` characters of
a pre-token; behind them the scores roll on over the last prefixes a piece can start from, so a run of
millions of characters takes no nodes of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from trialspark.llm.common import PIECE_MODEL, columns, map_rows
from trialspark.llm.pieces import MARK, _parts, chunk_pattern, load_model, unknown_ids

MAX_NODES = 1_000_000
DEPTH = 64


def make_counter(model: dict, max_nodes: int = MAX_NODES) -> Callable[[Iterable[str]], dict[str, int]]:
    """A function that adds distinct pre-tokens to the trie and returns pre-token -> tokens."""
    score = {p: s for p, _, s in model["pieces"]}
    longest, depth = max(map(len, score)), max(1, min(DEPTH, max_nodes - 1))
    byte_ids, unk_id, unk_score = model["byte_ids"], model["unk_id"], model["unk_score"]
    kids: dict[tuple[int, str], int] = {}
    best: list[float] = [0.0]  # forward score of the node's prefix
    count: list[int] = [0]  # tokens on its best path
    done: dict[str, int] = {}  # terminal counts

    def insert(word: str) -> int:
        node, path = 0, [0]
        for i, char in enumerate(word[:depth]):
            child = kids.get((node, char))
            if child is None:
                top, tokens = float("-inf"), 0
                for start in range(max(0, i + 1 - longest), i + 1):
                    s = score.get(word[start : i + 1])
                    if s is not None and best[path[start]] + s > top:
                        top, tokens = best[path[start]] + s, count[path[start]] + 1
                if char not in score and best[node] + unk_score > top:
                    top, tokens = best[node] + unk_score, count[node] + len(unknown_ids(char, byte_ids, unk_id))
                child = kids[node, char] = len(best)
                best.append(top)
                count.append(tokens)
            node = child
            path.append(node)
        return count[node] if len(word) <= depth else roll(word, path)

    def roll(word: str, path: list[int]) -> int:
        """The count of a word whose first characters are ``path``; a prefix keeps its place modulo ``longest``."""
        tops, counted = [0.0] * longest, [0] * longest
        for length in range(max(0, len(path) - longest), len(path)):
            tops[length % longest], counted[length % longest] = best[path[length]], count[path[length]]
        for i in range(depth, len(word)):
            top, tokens = float("-inf"), 0
            for start in range(max(0, i + 1 - longest), i + 1):
                s = score.get(word[start : i + 1])
                if s is not None and tops[start % longest] + s > top:
                    top, tokens = tops[start % longest] + s, counted[start % longest] + 1
            char = word[i]
            if char not in score and tops[i % longest] + unk_score > top:
                top, tokens = tops[i % longest] + unk_score, counted[i % longest] + len(unknown_ids(char, byte_ids, unk_id))
            tops[(i + 1) % longest], counted[(i + 1) % longest] = top, tokens
        return counted[len(word) % longest]

    def counts(words: Iterable[str]) -> dict[str, int]:
        out = {}
        for w in sorted(words):
            tokens = done.get(w)
            if tokens is None:
                if len(best) + min(len(w), depth) > max_nodes:
                    kids.clear()
                    done.clear()
                    del best[1:], count[1:]
                tokens = insert(w)
                if len(w) <= 64:
                    done[w] = tokens
            out[w] = tokens
        return out

    return counts


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = PIECE_MODEL, max_nodes: int = MAX_NODES) -> DataFrame:
    """One row per document: ``id, n_chars, n_pretokens, n_tokens``. Repeated rows are counted each; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model_path))

    def work():
        model = shared.value
        counts, cut = make_counter(model, max_nodes), chunk_pattern(model).findall
        mark_tokens = len(unknown_ids(MARK, model["byte_ids"], model["unk_id"]))

        def step(batch: pa.RecordBatch):
            for at in range(0, batch.num_rows, 512):
                texts = batch.column(1).slice(at, 512).to_pylist()
                words = [[cut(p) for p in _parts(t)] if t else [] for t in texts]
                known = counts({w for parts in words for part in parts for w in part})
                yield {
                    id_col: batch.column(0).slice(at, 512),
                    "n_chars": [len(t or "") for t in texts],
                    "n_pretokens": [sum(map(len, parts)) for parts in words],
                    "n_tokens": [sum(known[w] for part in parts for w in part) + mark_tokens * max(0, len(parts) - 1) for parts in words],
                }

        return step

    slim = columns(docs, **{id_col: id_col, "text": text_col})
    return map_rows(slim, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, n_chars long, n_pretokens long, n_tokens long", work)
