"""Language by hashed character trigrams: log-probability ratios fitted by one aggregation, scored as a sparse dot product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..plans.shared import spread, stored

#: Buckets of hashed trigrams, so that a model is a table of at most BUCKETS rows of a number a label.
BUCKETS = 1 << 14
#: Letters of a word; longer runs of letters count as several words, so that taking trigrams is linear.
WORD = r"\p{L}{1,32}"
#: Trigrams of the mean language that every language is taken to have had besides its own.
PRIOR = 2000
#: Labels a model may have; more are refused.
LABELS = 200
#: Factors of a trigram's code points.
MIX = (7919, 127, 1)


def words(df: DataFrame, text: str) -> DataFrame:
    """The other columns and __w, a row a word; a text without letters is one row of null."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.explode_outer(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("__w"))


def grams(df: DataFrame) -> DataFrame:
    """The columns but __w and __g, a row for each trigram of the word with a blank on either side; null for a null word."""
    rest = [c for c in df.columns if c != "__w"]
    at = df.select(*rest, F.concat(F.lit(" "), F.col("__w"), F.lit(" ")).alias("__p"))
    at = at.select(*rest, "__p", F.explode_outer(F.sequence(F.lit(1), F.length("__p") - 2)).alias("__i"))
    code = [F.ascii(F.substring(F.col("__p"), F.col("__i") + k, F.lit(1))) * m for k, m in enumerate(MIX)]
    return at.select(*rest, F.pmod(code[0] + code[1] + code[2], F.lit(BUCKETS)).alias("__g"))


def fit(docs: DataFrame, text: str, label: str) -> tuple[DataFrame, list[str]]:
    """The model (__g, __w0, __w1, ...) and its labels in order: a number for each label and trigram that any label's texts hold.

    A weight is a thousand times the logarithm of the trigram's share in the label's texts, mixed with PRIOR trigrams of the mean
    language, over its share in the mean language, in which all labels weigh the same however much text they have. Rows without
    a label or a letter teach nothing. Equal words of a label are counted before they are cut, so most text never becomes trigrams.
    """
    said = words(docs.filter(F.col(label).isNotNull()).select(F.col(label).alias("__l"), F.col(text).alias("__t")), "__t").filter("__w is not null")
    said = said.groupBy("__l", "__w").agg(F.count("*").alias("__times"))
    c = stored(grams(said).groupBy("__l", "__g").agg(F.sum("__times").alias("__n")))
    sizes = c.groupBy("__l").agg(F.sum("__n").alias("n")).orderBy("__l").limit(LABELS + 1).collect()
    if len(sizes) > LABELS:
        raise ValueError(f"more than {LABELS} labels")
    labels = [r["__l"] for r in sizes]
    if not labels:
        return c.select("__g"), labels
    wide = c.groupBy("__g").agg(*[F.sum(F.when(F.col("__l") == x, F.col("__n")).otherwise(0)).alias(f"__c{i}") for i, x in enumerate(labels)])
    mean = sum((F.col(f"__c{i}") / r["n"] for i, r in enumerate(sizes)), F.lit(0.0)) / len(labels)
    wide = wide.withColumn("__mean", mean)
    weight = lambda i, n: F.round(1000 * F.log((F.col(f"__c{i}") / F.col("__mean") + PRIOR) / (n + PRIOR))).cast("long").alias(f"__w{i}")
    return stored(wide.select("__g", *[weight(i, r["n"]) for i, r in enumerate(sizes)])), labels


def predict(docs: DataFrame, model: tuple[DataFrame, list[str]], key: str, text: str) -> DataFrame:
    """(key, lang, margin): the label of the greatest sum of weights, the first by code point among equals, and by how much it leads the next.

    The model, whose size is bounded, is broadcast; a text's trigrams add up in the task that reads it, so a row a text is shuffled.
    Rows of one key are one text. A text without a known trigram is `und` with margin 0; a sole label leads by its own sum.
    """
    weights, labels = model
    if not labels:
        return docs.select(key).distinct().select(key, F.lit("und").alias("lang"), F.lit(0).cast("long").alias("margin"))
    hits = grams(words(docs.select(F.col(key).alias("__k"), F.col(text).alias("__t")), "__t")).join(F.broadcast(weights), "__g", "left")
    sums = hits.groupBy("__k").agg(*[F.sum(f"__w{i}").alias(f"__s{i}") for i in range(len(labels))])
    places = F.array_sort(F.array(*[F.struct((-F.col(f"__s{i}")).alias("cost"), F.lit(x).alias("lang")) for i, x in enumerate(labels)]))
    got = sums.select("__k", F.col("__s0").isNull().alias("__none"), places.alias("__p"))
    second = F.col("__p")[1]["cost"] if len(labels) > 1 else F.lit(0)
    lead = second - F.col("__p")[0]["cost"]
    return got.select(F.col("__k").alias(key), F.when(F.col("__none"), "und").otherwise(F.col("__p")[0]["lang"]).alias("lang"), F.when(F.col("__none"), 0).otherwise(lead).cast("long").alias("margin"))


_SQL = rf"""WITH w AS (SELECT doc_id, lang, ' ' || unnest(regexp_extract_all(lower(text), '{WORD}')) || ' ' AS p FROM documents),
g AS (SELECT doc_id, lang, (unicode(substr(p, i, 1)) * {MIX[0]} + unicode(substr(p, i + 1, 1)) * {MIX[1]} + unicode(substr(p, i + 2, 1))) % {BUCKETS} AS g FROM (SELECT *, unnest(range(1, length(p) - 1)) AS i FROM w)),
c AS (SELECT lang, g, count(*) AS c FROM g WHERE doc_id % 3 <> 1 AND lang IS NOT NULL GROUP BY ALL), n AS (SELECT lang, sum(c)::DOUBLE AS n FROM c GROUP BY lang),
b AS (SELECT g, sum(c / n) / (SELECT count(*) FROM n) AS mean FROM c JOIN n USING (lang) GROUP BY g),
m AS (SELECT b.g, n.lang, round(1000 * ln((coalesce(c, 0) / mean + {PRIOR}) / (n + {PRIOR})))::BIGINT AS w FROM b CROSS JOIN n LEFT JOIN c ON c.g = b.g AND c.lang = n.lang),
s AS (SELECT doc_id, m.lang, sum(w)::BIGINT AS s FROM g JOIN m USING (g) GROUP BY ALL),
r AS (SELECT doc_id, lang, s - lead(s) OVER o AS margin, row_number() OVER o AS r FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY s DESC, lang)),
o AS (SELECT d.doc_id, d.lang AS label, coalesce(r.lang, 'und') AS lang, coalesce(margin, 0)::BIGINT AS margin FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND r = 1)"""


def _predicted(t) -> DataFrame:
    """Learnt from the labelled documents whose id leaves no 1 when divided by 3."""
    d = spread(t("documents").select("doc_id", "text", "lang"))
    return predict(d, fit(d.filter("doc_id % 3 <> 1"), "text", "lang"), "doc_id", "text")


@query("lang_grams", f"{_SQL} SELECT doc_id, lang, margin FROM o")
def _grams(t):
    return _predicted(t)


@query("lang_recall", f"{_SQL} SELECT label, count(*)::BIGINT AS n, count(*) FILTER (lang = label)::BIGINT AS hits FROM o WHERE doc_id % 3 = 1 AND label IS NOT NULL GROUP BY label")
def _recall(t):
    """How many of the held-out documents of each label are told right."""
    held = t("documents").filter("doc_id % 3 = 1 and lang is not null").select("doc_id", F.col("lang").alias("label"))
    return _predicted(t).join(held, "doc_id").groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("label")).alias("hits"))
