"""The stored index against BM25 over the whole text, through appends, merges and broken runs."""

import random

import pytest
from pyspark.sql import functions as F

from siltworks.operators import index
from siltworks.operators.retrieval import bm25


def rows(df):
    return sorted((r["q"], r["doc_id"], r["score"], r["rank"]) for r in df.collect())


def test_index_equals_bm25_through_appends_and_merges(spark, tmp_path):
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choices(words, weights=[40 / (i + 1) for i in range(40)], k=r.choice([0, 1, 5, 30]))) for _ in range(300)]
    texts[7:20] = [texts[6]] * 13  # ties
    texts[21], texts[30] = None, "rare rare w39"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame([(0, "w0 w1 w1"), (1, "rare"), (2, "none such"), (3, None), (4, "w39 w38 w0"), (5, texts[6])], "q int, qt string")
    path, block = str(tmp_path / "ix"), F.expr("doc_id div 8")
    with pytest.raises(ValueError, match="no index"):
        index.search(asked, path, "q", "qt", 3)
    assert index.append(docs.filter("doc_id < 100"), path, "doc_id", "text", block) == 100
    assert index.append(docs.filter("doc_id % 2 = 0"), path, "doc_id", "text", block) == 100
    assert index.append(docs.filter("doc_id < 100"), path, "doc_id", "text", block) == 0
    part = docs.filter("doc_id < 100 or doc_id % 2 = 0")
    assert rows(index.search(asked, path, "q", "qt", 3)[0]) == rows(bm25(part, asked, "doc_id", "text", "q", "qt", 3))
    (tmp_path / "ix/manifest/9").mkdir()  # a manifest that was never finished
    assert index.append(docs, path, "doc_id", "text", block) == 100
    index.merge(spark, path)
    assert index.segments(spark, path).count() == 1
    for k in (1, 3):
        found, told = index.search(asked, path, "q", "qt", k)
        assert rows(found) == rows(bm25(docs, asked, "doc_id", "text", "q", "qt", k))
        share = {x["q"]: (x["blocks"], x["scored"]) for x in told.collect()}
        assert set(share) == {0, 1, 4, 5} and share[1] == (1, 1) and all(0 < s <= b for b, s in share.values())
    assert share[4][1] < share[4][0]  # some blocks are skipped
