"""Lists that many pieces share: stored once, put into texts on their way to a page or block."""

import pytest
from pyspark.sql import functions as F

from trialspark.operators import render as rd

SCHEMA = "source string, rel_path string, section string, tier string, stem string, content string, summary string, token_count long, priority long, last_modified date"


@pytest.fixture
def docs(spark, monkeypatch):
    """One stem of a whole corpus, in two sections and one of a single file; lists of 16 paths, a few of them to a task."""
    monkeypatch.setattr(rd, "CHUNK", 16)
    monkeypatch.setattr(rd, "TASK_CHARS", 4000, raising=False)
    section = lambda i: "lone" if i == 30 else f"s{i % 2}"
    rows = [("a", f"{section(i)}/{i:03}/same.md", section(i), "required", "same", "the same" if i % 3 else "other", None, 1, 1, None) for i in range(60)]
    return spark.createDataFrame(rows, SCHEMA)


def _text(rows):
    own = [(r.rel_path, r.section, "same" in r.content) for r in sorted(rows, key=lambda r: r.rel_path)]
    last, out = own[-1][0], []
    for path, section, names in own:
        peers = [p for p, s, _ in own if s == section and p != path][:3]
        by = [p for p, _, n in own if n and p != last and p not in peers]
        out += [f"- {path}: {'the same' if names else 'other'}", "  See also: " + ", ".join(peers + by)]
        out += [f"  Referenced by: {last}"] if names and path != last else []
    return "\n".join(out)


def test_lists_are_not_stored_with_every_text(docs, monkeypatch):
    stored, write = {}, rd._written

    def seen(df, name):
        out = write(df, name)
        if "text" in df.columns:
            stored[name] = stored.get(name, 0) + out.agg(F.sum(F.length("text"))).first()[0]
        return out

    monkeypatch.setattr(rd, "_written", seen)
    want = _text(docs.collect())
    rows = rd.render_variants(docs, ["xref-dense"], 3000).orderBy("page").collect()
    assert "".join(r.content for r in rows) == want and len(rows) > 5
    assert stored["pieces"] < len(want) / 3


def test_blocks_inside_a_text_have_the_digest_of_the_pages(docs):
    found = rd.listed_pieces(docs, ["xref-dense", "xref-none"])
    key = lambda r: (r.variant, r.n_chars, r.digest)
    for block in (40, 3000):
        want = rd.digests(rd.render_variants(docs, ["xref-dense", "xref-none"], 3000), block=block)
        assert sorted(map(key, rd.piece_digests(found, block=block).collect())) == sorted(map(key, want.collect()))
