"""The trigram language filter against plain sums, and with unequal amounts of text a language."""

import collections
import math
import re

import pytest

from siltworks.operators import grams as G
from tests.checks import SF


def plain(text):
    """Trigram buckets of a text, by plain loops; words are runs of ASCII letters here."""
    out = []
    for w in re.findall(r"[a-zé]{1,32}", (text or "").lower()):
        p = f" {w} "
        out += [(ord(p[i]) * 7919 + ord(p[i + 1]) * 127 + ord(p[i + 2])) % G.BUCKETS for i in range(len(p) - 2)]
    return out


def test_equals_plain_sums(spark):
    train = [("a", "the house of the mouse"), ("b", "das Haus der Maus"), ("b", None), ("b", "12 !"), (None, "zzz yyy"), ("c", "été " * 3)]
    docs = [(1, "the moths"), (2, "der Hausherr"), (3, None), (4, ""), (5, "?? 12"), (6, "qqq"), (7, "été"), (8, "a" * 3000 + " mouse"), (9, "the"), (9, "house"), (None, "das Haus")]
    counts = collections.defaultdict(collections.Counter)
    for x, s in train:
        if x and plain(s):
            counts[x].update(plain(s))
    sizes = {x: sum(c.values()) for x, c in counts.items()}
    known = set().union(*counts.values())
    mean = {g: sum(c[g] / sizes[x] for x, c in counts.items()) / len(counts) for g in known}
    weight = {(x, g): round(1000 * math.log((c[g] / mean[g] + G.PRIOR) / (sizes[x] + G.PRIOR))) for x, c in counts.items() for g in known}
    texts = collections.defaultdict(list)
    for i, s in docs:
        texts[i] += [g for g in plain(s) if g in known]
    want = set()
    for i, gs in texts.items():
        best = sorted((-sum(weight[x, g] for g in gs), x) for x in counts)
        want.add((i, best[0][1], best[1][0] - best[0][0]) if gs else (i, "und", 0))
    d = spark.createDataFrame(docs, "id long, text string")
    t = spark.createDataFrame(train, "label string, text string")
    model = G.fit(t, "text", "label")
    assert model[1] == ["a", "b", "c"] and {tuple(r) for r in G.predict(d, model, "id", "text").collect()} == want
    assert G.predict(d.limit(0), model, "id", "text").count() == 0
    none = G.fit(t.limit(0), "text", "label")
    assert {r["lang"] for r in G.predict(d, none, "id", "text").collect()} == {"und"}
    one = G.predict(d, G.fit(t.filter("label = 'a'"), "text", "label"), "id", "text")
    assert {r["id"]: r["lang"] for r in one.collect()} == {1: "a", 2: "und", 3: "und", 4: "und", 5: "und", 6: "und", 7: "und", 8: "a", 9: "a", None: "und"}  # "der" and "das Haus" hold none of its trigrams


def test_labels_are_bounded(spark):
    many = spark.range(G.LABELS + 1).selectExpr("cast(id as string) as label", "'abc' as text")
    with pytest.raises(ValueError, match="labels"):
        G.fit(many, "text", "label")


@pytest.mark.parametrize("least", [2000, 40000])
def test_unequal_samples(spark, least):
    """A label with little text loses no texts of its own and takes none of others."""
    d = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").filter("lang is not null and length(text) >= 200").select("doc_id", "lang", "text").toPandas().sort_values("doc_id")
    held, rest = d[d.doc_id % 3 == 1], d[d.doc_id % 3 != 1]
    few = sorted(set(d.lang))[-1]
    train = [(x, "\n".join(part.text)[: least if x == few else 400_000]) for x, part in rest.groupby("lang")]
    model = G.fit(spark.createDataFrame(train, "lang string, text string"), "text", "lang")
    got = G.predict(spark.createDataFrame(held[["doc_id", "text"]]), model, "doc_id", "text").toPandas().merge(held, on="doc_id")
    hits = (got.lang_x == got.lang_y).groupby(got.lang_y).mean()
    print(hits)
    assert hits.min() > 0.95
