"""All queries of the library proper and their SQL; importing the operator modules registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import assembly, boundary, budget, cleaning, collect, content, dedup, diversity, evaluation, filters, grams, index, needles, parsing, retrieval, sinks, windows  # noqa: F401
from .plans.catalog import ORACLES, QUERIES, query
from .sources.derived import DATED, dated

_SQL = rf"WITH {DATED}, k AS (SELECT *, {dedup._K} AS k, {dedup._PRIO} AS prio FROM d WHERE length(text) BETWEEN (CASE WHEN stream = 'deaths' THEN 40 ELSE 350 END) AND 24000), u AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY prio, doc_id) = 1) SELECT substr(date, 1, 7) AS month, stream, count(*)::BIGINT AS docs, sum(est_tokens)::BIGINT AS tokens FROM u GROUP BY 1, 2"


@query("assemble", _SQL)
def _assemble(t):
    """Length filter by stream, priority dedup by text key, totals by month and stream."""
    d = dated(t("documents")).filter((F.length("text") <= 24000) & (F.length("text") >= filters.stream_floor(F.col("stream"))))
    d = d.select("doc_id", "date", "stream", "est_tokens", dedup.prefix_key(F.col("text")).alias("k"), dedup.priority(F.col("stream")).alias("prio"))
    u = dedup.first_by(d, ["k"], ["prio", "doc_id"])
    return u.groupBy(F.substring("date", 1, 7).alias("month"), "stream").agg(F.count("*").alias("docs"), F.sum("est_tokens").cast("long").alias("tokens"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["assemble"](spark, sf_dir)
