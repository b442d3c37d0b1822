"""Links between documents in few pieces, and digests straight from pieces."""

from trialspark import views as v
from trialspark.operators import render as rd
from trialspark.plans.render import EVERY

SCHEMA = "source string, rel_path string, section string, tier string, stem string, content string, summary string, token_count long, priority long, last_modified date"


def _docs(spark, n):
    stem = lambda i: f"stem{i % 6}" if i % 3 else f"own_{i:03}"
    section = lambda i: "alone" if i == 7 else f"s{i % 4}"
    text = lambda i: " ".join(stem(j) for j in range(i % 5, n, 7))
    rows = [("a" if i % 9 else "b", f"{section(i)}/{i * 37 % n:03}/{stem(i)}.md", section(i), "required", stem(i), text(i), None, 1, 1, None) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_dense_links_take_few_pieces(spark, monkeypatch):
    monkeypatch.setattr(rd, "CHUNK", 8, raising=False)
    docs, rows = _docs(spark, 90)
    parts = rd.pieces(docs, ["xref-dense"])
    got = {r.source: r.content for r in rd.pages(parts).collect()}
    links = 0
    for source in ("a", "b"):
        own = sorted((r for r in rows if r[0] == source), key=lambda r: r[1])
        last = {}
        for r in own:
            last[r[4]] = r[1]
        found = {(r[1], s) for r in own for s in last if s in r[5] and last[s] != r[1]}
        out = []
        for r in own:
            peers = [x[1] for x in own if x[2] == r[2] and x[1] != r[1]][:3]
            by = [p for p, s in sorted(found) if s == r[4] and p not in peers]
            refs = [last[s] for p, s in sorted(found) if p == r[1]]
            links += len(by) + len(refs)
            out.append(f"- {r[1]}: {r[5][:80]}")
            out += ["  See also: " + ", ".join(peers + by)] if peers + by else []
            out += ["  Referenced by: " + ", ".join(refs)] if refs else []
        assert got[source] == "\n".join(out)
    assert parts.count() < links / 2


def test_sections_of_a_document_are_one_piece(spark):
    row = ("a", "p.md", "s", "required", "p", "\n".join(f"## h{i}\nx{i}\ndef f{i}(a):" for i in range(200)), None, 1, 1, None)
    docs = spark.createDataFrame([row], SCHEMA)
    for name in ("granularity-section", "granularity-function", "granularity-mixed"):
        assert rd.pieces(docs, [name]).count() == 1


def test_digests_of_pieces_are_those_of_pages(spark):
    docs = v.docs(spark, "/root/testdata/sf0.001")
    names = EVERY[::4] + ["no-index", "xref-dense"]
    key = lambda r: (r.source, r.variant, r.n_chars, r.digest)
    want = rd.digests(rd.render_variants(docs, sorted(set(names)), 3000), block=1000)
    got = rd.piece_digests(rd.pieces(docs, sorted(set(names))), block=1000)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
