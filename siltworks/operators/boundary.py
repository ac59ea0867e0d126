"""The boundary to outside models: batch inference, resuming, refusing to report."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..plans.shared import cut, same, scratch, ship
from ..sources.writers import exists


class StubClient:
    """A deterministic stand-in for a model."""

    def __call__(self, prompt: str) -> str:
        return "ok " + hashlib.md5(prompt.encode()).hexdigest()[:8]


def ai_map(df: DataFrame, prompt: str, client: Callable[[], Callable[[str], str]] = StubClient, retries: int = 3, wait: float = 0.0) -> DataFrame:
    """Adds reply and error: one client a partition, bounded retries with growing waits; what fails becomes a dead letter."""
    ship(df.sparkSession)
    empty = F.lit(None).cast("string")
    schema = df.select("*", empty.alias("reply"), empty.alias("error")).schema

    def run(batches: Iterator) -> Iterator:
        call = client()
        for pdf in batches:
            replies, errors = [], []
            for p in pdf[prompt]:
                reply = error = None
                for n in range(retries):
                    try:
                        reply, error = call(p), None
                        break
                    except Exception as e:  # whatever an outside service raises is recorded with its row
                        error = f"{type(e).__name__}: {e}"[:200]
                        time.sleep(wait * 2**n)
                replies.append(reply)
                errors.append(error)
            yield pdf.assign(reply=replies, error=errors)

    return df.mapInPandas(run, schema)


def refuse_above(df: DataFrame, bad, share: float = 0.02) -> DataFrame:
    """The rows, cut once, unless more than ``share`` of them are bad: then an error instead of a report."""
    out = cut(df)
    n = out.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).first()
    if n["bad"] > share * max(n["n"], 1):
        raise ValueError(f"{n['bad']} of {n['n']} rows failed; the limit is {share:.1%}")
    return out


@query("ai_map_stub", "SELECT item_id, 'ok ' || substr(md5(text), 1, 8) AS reply FROM benchmark")
def _stub(t):
    d = ai_map(t("benchmark").select("item_id", "text"), "text")
    return refuse_above(d, F.col("reply").isNull()).select("item_id", "reply")


@query("resume_anti", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _resume(t):
    return t("documents").select("doc_id", "source").join(t("labels").select("doc_id"), "doc_id", "left_anti")


@query("job_plan", "SELECT source || ':' || rd || ':' || (['news','memo','faq'])[k + 1] AS call_id FROM (SELECT DISTINCT source FROM documents) CROSS JOIN (SELECT unnest(range(0, 3)) AS rd) CROSS JOIN (SELECT unnest(range(0, 3)) AS k) WHERE NOT (rd = 0 AND source IN ('src1', 'src2'))")
def _plan(t):
    """Rounds by groups by strategies, less what is done."""
    g = t("documents").select("source").distinct().withColumn("rd", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("kind", F.explode(F.array(F.lit("news"), F.lit("memo"), F.lit("faq"))))
    done = g.filter("rd = 0 and source in ('src1', 'src2')").select("source", "rd", "kind")
    return g.join(done, ["source", "rd", "kind"], "left_anti").select(F.concat_ws(":", "source", F.col("rd").cast("string"), "kind").alias("call_id"))


class JobTable:
    """Write-ahead state of batch jobs at an outside service, as an append-only table of (batch_id, round, state, at, docs, tokens).

    ``submit`` records a batch before it is sent on for collecting, so that a run that dies leaves it pending; ``pending`` is
    what the next run adopts; ``harvest`` records what was collected, once. The latest state of a batch counts.
    """

    SCHEMA = "batch_id string, round int, state string, at bigint, docs bigint, tokens bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def log(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], self.SCHEMA)

    def states(self) -> DataFrame:
        """One row a batch: a harvest outweighs what was recorded before it, however often it was submitted."""
        rank = F.struct((F.col("state") == "done").alias("done"), "at")
        return self.log().groupBy("batch_id").agg(F.max_by(F.struct("round", "state", "docs", "tokens"), rank).alias("s")).select("batch_id", "s.*")

    def append(self, rows: DataFrame, state: str) -> None:
        now = time.time_ns()
        zero = F.lit(0).cast("long")
        get = lambda c: F.col(c).cast("long") if c in rows.columns else zero
        rows.select(F.col("batch_id").cast("string"), F.col("round").cast("int"), F.lit(state).alias("state"), F.lit(now).alias("at"), get("docs").alias("docs"), get("tokens").alias("tokens")).write.mode("append").parquet(self.path)

    def submit(self, batches: DataFrame) -> None:
        """Batches (batch_id, round) that aren't known yet become pending."""
        known = self.states().select("batch_id")
        self.append(cut(batches.join(known, "batch_id", "left_anti")), "pending")

    def pending(self) -> DataFrame:
        return self.states().filter("state = 'pending'").select("batch_id", "round")

    def harvest(self, results: DataFrame) -> None:
        """Results (batch_id, docs, tokens) of pending batches; of others they are not counted again."""
        self.append(cut(results.join(self.pending(), "batch_id")), "done")

    def next_round(self, target: int) -> int | None:
        """The round to submit next; none once the tokens collected reach the target or while a round is pending."""
        s = self.states().agg(F.coalesce(F.max("round"), F.lit(-1)).alias("round"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count_if(F.col("state") == "pending").alias("open")).first()
        return None if s["tokens"] >= target or s["open"] else s["round"] + 1


@query("job_state", "WITH d AS (SELECT source || ':' || (doc_id % 3) AS batch_id, (doc_id % 3)::INT AS round, length(text) // 4 AS tok FROM documents WHERE source IS NOT NULL) SELECT batch_id, round, CASE WHEN round < 2 THEN 'done' ELSE 'pending' END AS state, CASE WHEN round < 2 THEN count(*) ELSE 0 END::BIGINT AS docs, CASE WHEN round < 2 THEN sum(tok) ELSE 0 END::BIGINT AS tokens FROM d GROUP BY batch_id, round")
def _jobs(t):
    """Two rounds are submitted, one is collected and the run dies; the next adopts what is pending, submits a third round and dies."""
    d = t("documents").filter("source is not null").select(F.concat_ws(":", "source", (F.col("doc_id") % 3).cast("string")).alias("batch_id"), (F.col("doc_id") % 3).cast("int").alias("round"), F.expr("length(text) div 4").alias("tok"))
    batches, path = d.select("batch_id", "round").distinct(), scratch(d.sparkSession, "jobs")
    results = d.groupBy("batch_id").agg(F.count("*").alias("docs"), F.sum("tok").alias("tokens"))
    first, second = JobTable(d.sparkSession, path), JobTable(d.sparkSession, path)
    first.submit(batches.filter("round < 2"))
    first.harvest(results.join(batches.filter("round = 0"), "batch_id").drop("round"))
    second.harvest(results.join(second.pending(), "batch_id").drop("round"))
    second.submit(batches)
    return second.states()


def untried(candidates: DataFrame, key: str, *seen: DataFrame) -> DataFrame:
    """Candidates whose key neither the documents there are nor the log of rejects holds."""
    for s in seen:
        candidates = candidates.join(s.select(key), key, "left_anti")
    return candidates


@query("reject_log", "WITH c AS (SELECT doc_id, length(text) >= 500 AS long FROM documents) SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END::INT AS run FROM c WHERE long")
def _rejects(t):
    """Two runs over growing candidates: what was too short is logged, and neither it nor what was taken is tried again."""
    d = t("documents").select("doc_id", "text")
    path = scratch(d.sparkSession, "sink")
    read = lambda part, schema: d.sparkSession.read.schema(schema).parquet(f"{path}/{part}")
    for run, tried in ((1, d.filter("doc_id % 2 = 0")), (2, d)):
        if run > 1:
            tried = untried(tried, "doc_id", read("docs", "doc_id long, run int"), read("rejects", "doc_id long"))
        tried = cut(tried.select("doc_id", (F.length("text") >= 500).alias("long")))
        tried.filter("long").select("doc_id", F.lit(run).alias("run")).write.mode("append").parquet(f"{path}/docs")
        tried.filter("long is null or not long").select("doc_id").write.mode("append").parquet(f"{path}/rejects")
    return read("docs", "doc_id long, run int")


def cached(keys: DataFrame, key: str, path: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results of the keys, null included, by a lookup table at ``path``: what isn't there is computed, each key once, and appended before it is read."""
    spark, asked = keys.sparkSession, keys.select(key).distinct()
    if exists(spark, path):
        old = spark.read.parquet(path).select(F.col(key).alias("__old"))
        asked = asked.join(old, same(asked, old, [(key, "__old")]), "left_anti")
    new = cut(compute(asked))
    new.write.mode("append").parquet(path)
    table = spark.read.schema(new.schema).parquet(path).withColumnRenamed(key, "__key")
    return keys.join(table, same(keys, table, [(key, "__key")]), "left").drop("__key")


@query("cached_lookup", "WITH q AS (SELECT doc_id, split_part(text, ' ', 1) AS q FROM documents), f AS (SELECT DISTINCT q FROM q WHERE doc_id % 3 = 0) SELECT doc_id, q, 'r:' || md5(q) AS result, CASE WHEN q IN (SELECT q FROM f) THEN 1 ELSE 2 END::INT AS run FROM q")
def _cached(t):
    """Searches of two runs over one table of results: the second computes only what the first did not ask."""
    d = t("documents").select("doc_id", F.split_part("text", F.lit(" "), F.lit(1)).alias("q"))
    path = scratch(d.sparkSession, "sink")
    search = lambda run: lambda x: x.select("q", F.concat(F.lit("r:"), F.md5("q")).alias("result"), F.lit(run).alias("run"))
    cached(d.filter("doc_id % 3 = 0"), "q", path, search(1))
    return cached(d, "q", path, search(2)).select("doc_id", "q", "result", "run")
