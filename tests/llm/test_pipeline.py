"""The pipeline over the smallest tables: what each stage decided holds in the end."""

import re

import corpus_pipeline
from trialspark.llm import decontaminate, near_dedup, pieces

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "sentencepiece"]
    rows = corpus_pipeline.run(spark, SF).collect()
    kept = {r.doc_id for r in rows}
    assert len(kept) == len(rows) and all(r.exact for r in rows)
    classes = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(docs).collect()}
    hit = {r.doc_id for r in decontaminate.contaminated_pairs(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert kept == {i for i, c in classes.items() if i == c} - hit
    decode = pieces.make_decoder(pieces.load_model())
    key = re.compile(r'AKIA[0-9A-Z]{16}|token = "[0-9a-f]{40}"|password=[0-9a-f]{18}')
    for r in rows:
        text = decode(r.pieces)
        assert not key.search(text)
        if not key.search(texts[r.doc_id]) and "[secret]" not in text:
            assert text == texts[r.doc_id]
