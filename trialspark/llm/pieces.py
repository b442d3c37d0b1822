"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi.

The pieces and scores of a SentencePiece model file are read as a unigram model: the best split of a
text is the one with the highest sum of piece scores. One pass of the automaton reports, for every
end position, all pieces that end there (the node's own piece, then those on its output links,
longest first); each relaxes the best score of that position. Ties keep the longer last piece.

No piece has a space mark behind another character, and none has a line break, so the best split of
a text is the best splits of its space-led chunks put together. Chunks repeat, so a task keeps the
splits of those it has seen in a table of bounded size.

Spaces become U+2581 and one is put in front of the text, as the model file asks. Characters without
a piece become byte pieces. U+2581 itself, if a text has it, is written as byte pieces too, so that
decoding gives back every text exactly. Null texts give no pieces and decode to null; an empty text
gives an empty list and decodes to an empty text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trialspark.llm.common import PIECE_MODEL, columns, map_rows

MARK = "▁"
MEMO_ENTRIES = 300_000  # splits that a task keeps; beyond this it starts anew
MEMO_CHARS = 64  # longer chunks are split again each time


def load_model(path: str = PIECE_MODEL) -> dict:
    """Pieces, scores and special ids of a SentencePiece model file as plain lists."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    normal, byte_ids = [], [-1] * 256
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            normal.append((piece, i, sp.get_score(i)))
    return {
        "pieces": normal,
        "byte_ids": byte_ids if min(byte_ids) >= 0 else None,
        "unk_id": sp.unk_id(),
        "unk_score": min(score for _, _, score in normal) - 10.0,
        "size": sp.get_piece_size(),
    }


def chunk_pattern(model: dict) -> re.Pattern:
    """Cuts a marked text where no piece can span the cut."""
    if any(MARK in p.lstrip(MARK) for p, _, _ in model["pieces"]):
        return re.compile("(?s).+")
    if any("\n" in p for p, _, _ in model["pieces"]):
        return re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
    return re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


def _parts(text: str) -> list[str]:
    """The text with spaces as marks and one in front, cut at marks that the text itself has."""
    first, *rest = text.split(MARK)
    return [MARK + first.replace(" ", MARK), *(x.replace(" ", MARK) for x in rest)]


def make_encoder(model: dict) -> Callable[[str], list[int]]:
    """A function from a text to its piece ids."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for piece, i, score in model["pieces"]:
        automaton.add_word(piece, (i, len(piece), score))
    automaton.make_automaton()
    single = {p for p, _, _ in model["pieces"] if len(p) == 1}
    byte_ids, unk_id, unk_score = model["byte_ids"], model["unk_id"], model["unk_score"]
    matches, pattern = automaton.iter, chunk_pattern(model)
    mark_ids = unknown_ids(MARK, byte_ids, unk_id)
    low = float("-inf")

    def split(chunk: str) -> tuple[int, ...]:
        n = len(chunk)
        best, size, ids = [low] * (n + 1), [1] * (n + 1), [-1] * (n + 1)
        best[0], at = 0.0, 0
        for end, (i, length, score) in matches(chunk):
            while at <= end:
                at += 1
                if chunk[at - 1] not in single:
                    best[at] = best[at - 1] + unk_score
            total = best[at - length] + score
            if total > best[at]:
                best[at], size[at], ids[at] = total, length, i
        while at < n:
            at += 1
            best[at] = best[at - 1] + unk_score
        out, at = [], n
        while at:
            out.append((ids[at], at))
            at -= size[at]
        flat: list[int] = []
        for i, at in reversed(out):
            if i >= 0:
                flat.append(i)
            else:
                flat += unknown_ids(chunk[at - 1], byte_ids, unk_id)
        return tuple(flat)

    memo: dict[str, tuple[int, ...]] = {}

    def encode(text: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(_parts(text) if text else ()):
            if k:
                out += mark_ids
            for chunk in pattern.findall(part):
                ids = memo.get(chunk)
                if ids is None:
                    ids = split(chunk)
                    if len(chunk) <= MEMO_CHARS:
                        if len(memo) >= MEMO_ENTRIES:
                            memo.clear()
                        memo[chunk] = ids
                out += ids
        return out

    return encode


def unknown_ids(char: str, byte_ids: list[int] | None, unk_id: int) -> list[int]:
    return [byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if byte_ids else [unk_id]


def make_decoder(model: dict) -> Callable[[list[int]], str]:
    """A function from piece ids to the text."""
    table = [b""] * model["size"]
    for piece, i, _ in model["pieces"]:
        table[i] = piece.replace(MARK, " ").encode("utf-8")
    for b, i in enumerate(model["byte_ids"] or ()):
        table[i] = bytes([b])

    def decode(ids: list[int]) -> str:
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")[1:]

    return decode


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = PIECE_MODEL) -> DataFrame:
    """One row per document: ``id, pieces array<int>``. No shuffle; a task keeps only the model and its table."""
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model_path))

    def work():
        encode = make_encoder(shared.value)

        def step(batch: pa.RecordBatch):
            texts = batch.column(1).to_pylist()
            yield {id_col: batch.column(0), "pieces": [None if t is None else encode(t) for t in texts]}

        return step

    slim = columns(docs, **{id_col: id_col, "text": text_col})
    return map_rows(slim, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, pieces array<int>", work)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", pieces_col: str = "pieces", model_path: str = PIECE_MODEL) -> DataFrame:
    """One row per encoded document: ``id, text``."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_model(model_path))

    def work():
        decode = make_decoder(shared.value)

        def step(batch: pa.RecordBatch):
            yield {id_col: batch.column(0), "text": [None if x is None else decode(x) for x in batch.column(1).to_pylist()]}

        return step

    slim = columns(encoded, **{id_col: id_col, "pieces": pieces_col})
    return map_rows(slim, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, text string", work)


def encoded_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = PIECE_MODEL, with_pieces: bool = False) -> DataFrame:
    """Encoding and decoding in one pass: ``id, n_pieces, pieces_sha256, decoded_sha256, exact`` (and ``pieces``).

    pieces_sha256 is over the ids as little-endian 32-bit numbers; exact: decoding gave back the text.
    A null text has 0 pieces, the digest of nothing, a null decoded_sha256 and is exact.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_model(model_path))

    def work():
        encode, decode = make_encoder(shared.value), make_decoder(shared.value)

        def step(batch: pa.RecordBatch):
            ids = batch.column(0)
            for at in range(0, len(ids), 256):
                texts = batch.column(1).slice(at, 256).to_pylist()
                out: dict = {id_col: ids.slice(at, 256), "n_pieces": [], "pieces_sha256": [], "decoded_sha256": [], "exact": [], "pieces": []}
                for t in texts:
                    pieces = encode(t or "")
                    back = None if t is None else decode(pieces) if pieces else ""
                    flat = np.array(pieces, dtype="<i4")
                    out["n_pieces"].append(len(pieces))
                    out["pieces_sha256"].append(hashlib.sha256(flat.tobytes()).hexdigest())
                    out["decoded_sha256"].append(None if back is None else hashlib.sha256(back.encode("utf-8")).hexdigest())
                    out["exact"].append(back == t)
                    if with_pieces:
                        out["pieces"].append(flat)
                yield out

        return step

    slim = columns(docs, **{id_col: id_col, "text": text_col})
    schema = f"`{id_col}` {slim.schema[0].dataType.simpleString()}, n_pieces long, pieces_sha256 string, decoded_sha256 string, exact boolean"
    return map_rows(slim, schema + (", pieces array<int>" if with_pieces else ""), work)
