"""Pages of a text, read in order, against the whole text."""

from trialspark.operators import render as rd


def test_joined_pages_are_the_text(spark):
    paths = [f"f{i:03}.md" for i in range(60)]
    docs = spark.createDataFrame([("s", p, p * (i % 7 + 1)) for i, p in enumerate(paths)], "source string, rel_path string, content string")
    relevant = spark.createDataFrame([("t", "s", None, None, True)], "task_id string, source string, pos long, rel_path string, whole_corpus boolean")
    rows = rd.pages(rd.oracle_texts(relevant, docs), ["text_id"], 200).orderBy("page").collect()
    assert len(rows) > 5
    assert "".join(r.content for r in rows) == "\n\n".join(f"## {p}\n{p * (i % 7 + 1)}" for i, p in enumerate(paths))
