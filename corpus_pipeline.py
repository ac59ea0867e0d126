"""The corpus pipeline: language ID, near-duplicates, decontamination, PII surrogates, mixing, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``docs`` and what a
stage decides takes effect on all that follow. Clean documents stay in every filtering stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm import decontam, language, mixing, neardup, pii
from siltworks.plans.shared import stored

#: Share of a text's letters at which phrases may end in its best language; above it the text is of no learned language.
MOST_ODD = 0.6


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows without a language: null texts, texts without letters, texts of no learned language. Rows keep their own ``lang``."""
    return language.identified(docs, language.fit(docs), MOST_ODD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id in each group at five words and 80 %."""
    return neardup.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold 80 % of a benchmark item's five-word shingles."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the text by surrogates; ``n_chars``, where there is one, follows the text."""
    out = pii.redact(docs, pii.session_key(spark, pii.DEMO_KEY))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as its source's target asks."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("pii", private),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs


#: Language ID and surrogates have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None
