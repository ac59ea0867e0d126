"""Sources: JSONL, directories of one-document files, Atom XML, WARC, path lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .warc import register

#: Fields of a crawled document, in the order of the record.
DOCUMENT = "tier STRING, date STRING, url STRING, domain STRING, title STRING, text STRING, est_tokens BIGINT, src STRING"
LINKED = DOCUMENT + ", points BIGINT, hn_url STRING"
NEWS = "kind STRING, date STRING, url STRING, domain STRING, title STRING, published_at STRING, text STRING"
SYNTHETIC = "call_id STRING, doc_ix INT, kind STRING, gen STRING, date STRING, `group` STRING, source_urls ARRAY<STRING>, est_tokens BIGINT, text STRING"
KB_PAGE = "id STRING, title STRING, content STRING"
CHAT = "messages ARRAY<STRUCT<role: STRING, content: STRING>>"
SCORE = "question STRING, answer STRING, month STRING, logprob DOUBLE, n_answer_tokens INT"
RUN = "event_id STRING, date STRING, logprob DOUBLE"
GRADE = "event_id STRING, correct BOOLEAN"
FORECAST = "model STRING, label STRING, search BOOLEAN, rq STRING, rows ARRAY<STRUCT<topic: STRING, band: STRING, domain: STRING, n: INT, n_searches: INT, queries: ARRAY<STRING>, brier: DOUBLE, score: DOUBLE, probs: ARRAY<DOUBLE>, notes_chars: INT>>"
SIMULATION = "simulations ARRAY<STRUCT<task_id: STRING, reward_info: STRUCT<reward: DOUBLE, action_checks: ARRAY<STRUCT<action_match: BOOLEAN>>>, messages: ARRAY<STRUCT<role: STRING, content: STRING, tool_calls: ARRAY<STRUCT<name: STRING>>>>, termination_reason: STRING>>"


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True, origin: bool = False) -> DataFrame:
    """One row a non-blank line under an explicit schema; malformed lines fail, or go where ``strict`` is off.

    Missing fields are null. ``origin`` adds file, in whose sorted order a reader would see the shards.
    """
    df = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return df.withColumn("file", F.col("_metadata.file_path")) if origin else df


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON reports, one row a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_kb(spark: SparkSession, path: str) -> DataFrame:
    """A knowledge base of one JSON page a file, with its category: the second and third part of the id."""
    pages = read_report(spark, path, KB_PAGE)
    return pages.withColumn("category", F.array_join(F.slice(F.split("id", "_"), 2, 2), "_"))


def read_atom(spark: SparkSession, path: str, schema: str, tag: str = "entry") -> DataFrame:
    """Entries of Atom feeds."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def xml_text(column, limit: int = 6000):
    """Text of marked-up content: tags to spaces, single spaces, cut to ``limit``."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(column, "<[^>]+>", " "), r"\s+", " ")), 1, limit)


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """Lists of paths, gzip or not."""
    return spark.read.text(path).filter("trim(value) <> ''").withColumnRenamed("value", "path")


def read_warc(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """url, date and html of all response records of WARC files, packed or not; options as in ``warc``."""
    register(spark)
    return spark.read.format("warc").options(**options).load(path).select("url", "date", "html")
