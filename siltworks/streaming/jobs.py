"""Structured Streaming: resumable file jobs and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as X


def clean(docs: DataFrame) -> DataFrame:
    """The stateless cleaner, the same for tables and streams: length bounds, scaffold and boilerplate lines."""
    body, n = X.strip_boilerplate(F.col("text"))
    return docs.filter(F.length("text").between(350, 24000)).select(*[c for c in docs.columns if c != "text"], X.strip_scaffold(body).alias("text"), n.alias("boilerplate"))


def run_to_end(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs what is there to a table under ``path``; its checkpoint is the set of what is done, so a rerun resumes."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", path + "/state").outputMode(mode).trigger(availableNow=True).start(path + "/out")
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path + "/out")


def clean_stream(spark: SparkSession, source: str, schema: StructType, path: str) -> DataFrame:
    return run_to_end(clean(spark.readStream.schema(schema).parquet(source)), path)


def first_seen(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Rows whose key wasn't seen within the watermark: the state is bounded by it, so copies further apart both stay."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums a tumbling window and type; the time column is ts."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type")
    return g.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def watermark(spark: SparkSession, path: str) -> int:
    """Milliseconds of the watermark of the last batch that the checkpoint of run_to_end has; 0 before any."""
    logged = spark.read.text(path + "/state/offsets").select(F.get_json_object("value", "$.batchWatermarkMs").cast("long").alias("ms"))
    return logged.agg(F.max("ms")).first()[0] or 0


def hourly(spark: SparkSession, source: str, schema: StructType, path: str) -> DataFrame:
    """All windows so far: those the watermark has closed, as the stream wrote them, and those still open, as they stand.

    The stream emits a window once its watermark has passed the window's end, and drops rows of such windows that come later;
    so the open ones are a batch aggregate of the rows of windows that end after the last batch's watermark. A row too late for its window
    counts in no run, and a window once shown closed stays as it is.
    """
    read = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp"))
    out = run_to_end(windowed(read(spark.readStream.schema(schema).parquet(source))), path)
    ms = watermark(spark, path)
    rows = read(spark.read.schema(schema).parquet(source)).filter(F.col("ts") >= F.timestamp_millis(F.lit(ms - ms % 3_600_000)))
    return out.unionByName(windowed(rows)).withColumn("start", F.col("start").cast("timestamp_ntz"))
