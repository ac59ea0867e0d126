"""BM25 on a stored inverted index: postings in blocks with bounds, segments for new documents, exact search that skips blocks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.catalog import query
from ..plans.shared import BROADCAST_ROWS, at_least, cut, same, scratch, spread
from ..sources.writers import exists
from .retrieval import K1, B, _bm

#: Documents of a block; folders by hash of the term; blocks whose postings of one folder make a task's share.
BLOCK, PARTS, GROUP = 32, 32, 4096
#: Characters and tokens of a task's share of a shuffle.
SHARE_CHARS, SHARE_TOKENS = 4_000_000, 500_000
#: What rounded sums in another order may differ by, with room.
SLACK = 1e-5
_MANIFEST = "segment string, docs long, sized long, tokens long"


def _manifests(spark: SparkSession, path: str) -> list[int]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/manifest")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n) for n in names if n.isdigit() and exists(spark, f"{path}/manifest/{n}/_SUCCESS"))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The live segments, by the newest manifest that was written whole; none before any."""
    known = _manifests(spark, path)
    return spark.read.schema(_MANIFEST).json(f"{path}/manifest/{known[-1]}") if known else spark.createDataFrame([], _MANIFEST)


def _commit(live: DataFrame, path: str) -> None:
    known = _manifests(live.sparkSession, path)
    live.coalesce(1).write.mode("overwrite").json(f"{path}/manifest/{known[-1] + 1 if known else 0}")  # a row a segment


def _read(spark: SparkSession, path: str, kind: str, names: list[str]) -> DataFrame:
    return spark.read.option("basePath", f"{path}/{kind}").parquet(*[f"{path}/{kind}/segment={n}" for n in names])


def append(items: DataFrame, path: str, item: str, text: str, block: Column) -> int:
    """Adds the documents of ``items`` whose id the index at ``path`` doesn't hold, as a segment; returns how many.

    ``block`` is a long that at most some tens of documents share, best those that are alike; a document keeps its own.
    Texts are shuffled once, by block; what follows within a block is local. Then postings move once, to the folder of
    their term; a frequent term is dealt out by groups of blocks. A segment counts once its manifest is written, so a
    run that broke off leaves only files that nothing reads. Ids must not be null; of rows that share one, the least text counts.
    """
    spark = items.sparkSession
    live = segments(spark, path)
    names = [r["segment"] for r in live.select("segment").collect()]  # a handful
    new = items.select(F.col(item).alias("i"), F.col(text).alias("t"), block.cast("long").alias("block")).filter("i is not null")
    if names:
        old = _read(spark, path, "docs", names).select(F.col("i").alias("old"))
        new = new.join(old, F.col("i") == F.col("old"), "left_anti")
    new = new.groupBy("block", "i").agg(F.min("t").alias("t"))
    name = uuid.uuid4().hex
    chars = new.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    with at_least(spark, chars // SHARE_CHARS + 1):
        said = new.repartition("block").select("block", "i", X.tokens(F.col("t")).alias("ts")).withColumn("len", F.size("ts"))
        said.select("block", "i", "len").write.parquet(f"{path}/docs/segment={name}")
        tf = said.select("block", "i", "len", F.explode("ts").alias("term")).groupBy("block", "term", "i").agg(F.count("*").cast("int").alias("tf"), F.first("len").alias("len"))
        _postings(tf.groupBy("block", "term").agg(F.sort_array(F.collect_list(F.struct("i", "tf", "len"))).alias("posts")), path, name)
    size = spark.read.parquet(f"{path}/docs/segment={name}").agg(F.lit(name).alias("segment"), F.count("*").alias("docs"), F.count("len").alias("sized"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens"))
    n = size.first()["docs"]
    if n:
        _commit(live.unionByName(size), path)
    return n


def _postings(rows: DataFrame, path: str, name: str) -> None:
    """Blocks with what bounds them: their largest count and shortest document, which no later segment changes."""
    least = lambda f, of: of(F.transform("posts", lambda p: p[f]))
    out = rows.select("block", "term", "posts", F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int").alias("part"))
    out = out.repartition("part", F.expr(f"block div {GROUP}")).sortWithinPartitions("part", "term", "block")
    out = out.select("block", "term", F.size("posts").alias("n"), least("tf", F.array_max).alias("most"), least("len", F.array_min).alias("least"), "posts", "part")
    out.write.partitionBy("part").parquet(f"{path}/posts/segment={name}")


def merge(spark: SparkSession, path: str) -> None:
    """Writes all live segments as one; blocks of one number become one. The old ones' files stay for readers that still hold them."""
    live = segments(spark, path)
    names = [r["segment"] for r in live.select("segment").collect()]
    if len(names) < 2:
        return
    name = uuid.uuid4().hex
    _read(spark, path, "docs", names).drop("segment").write.parquet(f"{path}/docs/segment={name}")
    posts = _read(spark, path, "posts", names).groupBy("block", "term").agg(F.sort_array(F.flatten(F.collect_list("posts"))).alias("posts"))
    with at_least(spark, live.agg(F.sum("tokens")).first()[0] // SHARE_TOKENS + 1):
        _postings(posts, path, name)
    _commit(live.agg(F.lit(name).alias("segment"), *[F.sum(c).alias(c) for c in ("docs", "sized", "tokens")]), path)


def _weight(tf: Column, length: Column, idf: Column, mean: float) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))


def search(queries: DataFrame, path: str, qid: str, qtext: str, k: int, item: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(qid, item, score, rank) as bm25() gives them, and (qid, blocks, scored): how many blocks hold a query's terms and how many were scored.

    A block's bound for a query is the sum of its terms' bounds there. Each query scores its k blocks of the highest bounds
    whole; its k-th score is a floor, as every such block has a document that scores. Of the rest only blocks whose bound
    reaches the floor are scored; no document of another can be among the first k, ties included. Only folders that hold a
    query's terms are read, and positions of scored blocks only meet their queries. Queries are a stated set, as in bm25().
    """
    spark = queries.sparkSession
    live = segments(spark, path).collect()  # a row a segment
    if not live:
        raise ValueError("no index at this path")
    n, sized, tokens = (sum(r[c] for r in live) for c in ("docs", "sized", "tokens"))
    mean = tokens / sized if tokens else 1.0
    with at_least(spark, tokens // SHARE_TOKENS + 1):
        asked = cut(queries.select(F.col(qid).alias("q"), F.explode(X.tokens(F.col(qtext))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("times")))
        terms = asked.select("term").distinct()
        small = F.broadcast if asked.count() <= BROADCAST_ROWS else lambda x: x
        parts = [r[0] for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")).distinct().collect()]  # PARTS at most
        posts = _read(spark, path, "posts", [r["segment"] for r in live]).filter(F.col("part").isin(parts) if parts else F.lit(False)).join(small(terms), "term", "left_semi")
        df = posts.groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        asked = cut(asked.join(df, "term").select("q", "term", "times", idf.alias("idf")))  # terms that no document has are gone
        bound = _weight(F.col("most"), F.col("least"), F.col("idf"), mean) * F.col("times")
        bounds = cut(posts.select("segment", "block", "term", "most", "least").join(small(asked), "term").groupBy("q", "segment", "block").agg(F.sum(bound).alias("bound")))

        def score(pairs: DataFrame) -> DataFrame:
            """Of (q, segment, block): the k best documents of each query there."""
            wanted = pairs.select("q", "segment", "block").join(small(asked), "q")
            few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS  # then postings stay where they are
            t = (F.broadcast(wanted) if few else wanted).join(posts, ["segment", "block", "term"])
            t = t.select("q", "times", "idf", F.explode("posts").alias("p"))
            t = t.groupBy("q", F.col("p.i").alias("i")).agg(F.round(F.sum(_weight(F.col("p.tf"), F.col("p.len"), F.col("idf"), mean) * F.col("times")), 6).alias("score"))
            return best(t.filter("score > 0"))

        def best(t: DataFrame) -> DataFrame:
            return t.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.desc("i")))).filter(F.col("rank") <= k)

        order = Window.partitionBy("q").orderBy(F.desc("bound"), "segment", "block")  # tasks pass on k blocks a query
        tops = cut(bounds.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r"))
        found = cut(score(tops))
        floor = found.filter(F.col("rank") == k).select(F.col("q").alias("fq"), F.col("score").alias("floor"))
        t = tops.select(F.col("q").alias("tq"), F.col("segment").alias("ts"), F.col("block").alias("tb"))
        rest = bounds.join(floor, F.col("q").eqNullSafe(F.col("fq")), "left").filter(F.coalesce(F.col("bound") >= F.col("floor") - SLACK, F.lit(True)))
        rest = cut(rest.join(t, same(rest, t, [("q", "tq"), ("segment", "ts"), ("block", "tb")]), "left_anti").select("q", "segment", "block"))
        rows = best(found.drop("rank").unionByName(cut(score(rest)).drop("rank")))
        seen = tops.select("q").unionByName(rest.select("q")).groupBy("q").agg(F.count("*").alias("scored"))
        told = bounds.groupBy("q").agg(F.count("*").alias("blocks")).join(seen, "q").select(F.col("q").alias(qid), "blocks", "scored")
        return rows.select(F.col("q").alias(qid), F.col("i").alias(item), "score", "rank"), told


@query("bm25_indexed", f"WITH {_bm(5).strip()} SELECT * FROM r")
def _indexed(t):
    """An index of two thirds of the documents, the rest appended, then searched; the rows are bm25_topk's."""
    d = spread(t("documents").select("doc_id", "text"))
    path, block = scratch(d.sparkSession, "index"), F.expr(f"doc_id div {BLOCK}")
    append(d.filter("doc_id % 3 <> 0"), path, "doc_id", "text", block)
    append(d, path, "doc_id", "text", block)
    return search(t("benchmark").select("item_id", F.col("text").alias("qt")), path, "item_id", "qt", 5)[0]
