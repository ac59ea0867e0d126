"""Chunks, BM25, density slices and leak rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.catalog import query
from ..plans.shared import BROADCAST_ROWS, cut, spread
from ..sources.derived import DATED, dated

SIZE, OVERLAP, LEAST = 500, 100, 120
K1, B = 1.5, 0.75


def chunks(df: DataFrame, text: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """Overlapping chunks of white-space-joined text: ix, chunk; chunks of ``least`` characters or less go."""
    rest = [c for c in df.columns if c != text]
    t = df.select(*rest, X.squeeze(F.col(text)).alias("__t"))
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.lit(1), F.length("__t") - overlap) - 1, F.lit(step))
    out = t.select(*rest, "__t", F.posexplode(starts).alias("ix", "at"))
    return out.select(*rest, "ix", F.substring(F.col("__t"), F.col("at") + 1, F.lit(size)).alias("chunk")).filter(F.length("chunk") > least)


_CH = r"WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents), c AS (SELECT doc_id, t, unnest(range(0, greatest(1, length(t) - 100), 400)) AS pos FROM s), k AS (SELECT doc_id, (pos // 400)::INT AS ix, substr(t, pos + 1, 500) AS chunk FROM c WHERE length(substr(t, pos + 1, 500)) > 120)"


@query("chunk_overlap", f"{_CH} SELECT doc_id, ix, md5(chunk) AS chunk_md5 FROM k")
def _chunk(t):
    return chunks(spread(t("documents").select("doc_id", "text")), "text").select("doc_id", "ix", F.md5("chunk").alias("chunk_md5"))


def bm25(items: DataFrame, queries: DataFrame, item: str, text: str, qid: str, qtext: str, k: int, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, item, score, rank): the k best of each query, ties to the later item, only scores above 0.

    Only occurrences of query terms become postings (term, item, tf), so that what is shuffled follows from the queries.
    Queries are a stated set: while their terms are within the checked bound they are broadcast, and with them what is
    known per term; beyond it the same joins shuffle. A repeated query term counts each time.
    """
    asked = cut(queries.select(F.col(qid).alias("q"), F.explode(X.tokens(F.col(qtext))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("times")))
    small = F.broadcast if asked.count() <= BROADCAST_ROWS else lambda x: x
    said = items.select(F.col(item).alias("i"), F.explode(X.tokens(F.col(text))).alias("term")).join(small(asked.select("term").distinct()), "term", "left_semi")
    post = said.groupBy("i", "term").agg(F.count("*").alias("tf"))
    size = items.select(F.col(item).alias("li"), F.size(X.tokens(F.col(text))).alias("len"))
    whole = size.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    t = post.join(small(df), "term").join(size, F.col("i") == F.col("li")).crossJoin(F.broadcast(whole))  # one row
    weight = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    scored = t.select("term", "i", weight.alias("w")).join(small(asked), "term").groupBy("q", "i").agg(F.round(F.sum(F.col("w") * F.col("times")), 6).alias("score")).filter("score > 0")
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.desc("i"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(F.col("q").alias(qid), F.col("i").alias(item), "score", "rank")


def _bm(k: int) -> str:
    return rf"""
t AS (SELECT doc_id AS i, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
p AS (SELECT term, i, count(*) AS tf FROM t GROUP BY ALL), l AS (SELECT doc_id AS i, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS len FROM documents), w AS (SELECT count(*) AS n, avg(len) AS mean FROM l),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT item_id, p.i AS doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)) * times), 6) AS score FROM q JOIN p USING (term) JOIN f USING (term) JOIN l ON l.i = p.i CROSS JOIN w GROUP BY item_id, p.i),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC)::INT AS rank FROM s WHERE score > 0 QUALIFY rank <= {k})"""


@query("bm25_topk", f"WITH {_bm(5).strip()} SELECT * FROM r")
def _topk(t):
    return bm25(spread(t("documents").select("doc_id", "text")), t("benchmark").select("item_id", F.col("text").alias("qt")), "doc_id", "text", "item_id", "qt", 5)


@query("leak_rate", rf"WITH {_bm(3).strip()}, h AS (SELECT r.item_id, bool_or(contains(lower(d.text), lower(substr(b.text, 1, 40)))) AS leaks FROM r JOIN documents d ON d.doc_id = r.doc_id JOIN benchmark b ON b.item_id = r.item_id GROUP BY 1) SELECT count(*)::BIGINT AS n, count(*) FILTER (leaks)::BIGINT AS leaked, round(avg(leaks::INT), 6) AS rate FROM h")
def _leak(t):
    """Share of naive queries whose top hits already hold the leak term."""
    b = t("benchmark").select("item_id", F.col("text").alias("qt"), F.lower(F.substring("text", 1, 40)).alias("term"))
    top = bm25(t("documents"), b, "doc_id", "text", "item_id", "qt", 3).select("item_id", "doc_id")
    hit = top.join(t("documents").select("doc_id", "text"), "doc_id").join(b.select("item_id", "term"), "item_id")
    h = hit.groupBy("item_id").agg(F.bool_or(F.contains(F.lower("text"), F.col("term"))).alias("leaks"))
    return h.agg(F.count("*").alias("n"), F.count_if("leaks").alias("leaked"), F.round(F.avg(F.col("leaks").cast("int")), 6).alias("rate"))


TOPIC = "(?i)there|tion|des|und"


@query("topic_slice", f"WITH {DATED}, s AS (SELECT doc_id, date, len(regexp_extract_all(text, '{TOPIC}')) AS hits, length(text) AS n FROM d WHERE date BETWEEN '2026-02-01' AND '2026-03-31'), o AS (SELECT *, hits * 1000.0::DOUBLE / greatest(n, 1) AS density FROM s WHERE hits >= 3), c AS (SELECT *, coalesce(sum(least(n, 2500)) OVER (ORDER BY density DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM o) SELECT doc_id, hits::BIGINT AS hits, round(density, 6) AS density FROM c WHERE cum <= 26000")
def _slice(t):
    """A budget prefix by density: only what can be within the budget, the densest rows by a top-k, reaches the window."""
    d = dated(t("documents")).filter(F.col("date").between("2026-02-01", "2026-03-31"))
    s = d.select("doc_id", F.regexp_count("text", F.lit(TOPIC)).alias("hits"), F.length("text").alias("n")).filter("hits >= 3")
    s = s.withColumn("density", F.col("hits") * F.lit(1000.0) / F.greatest(F.col("n"), F.lit(1)))
    top = s.orderBy(F.desc("density"), "doc_id").limit(26_000 + 2)  # rows of one character or more: no more fit
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("density"), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    c = top.withColumn("cum", F.coalesce(F.sum(F.least(F.col("n"), F.lit(2500))).over(w), F.lit(0)))
    return c.filter("cum <= 26000").select("doc_id", F.col("hits").cast("long").alias("hits"), F.round("density", 6).alias("density"))
