"""Sinks: JSONL, month shards that skip what is done, appends that resume, one-row reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import same

#: The folder of rows without a value.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """One object a line, UTF-8, null fields kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """By Spark's own file systems, so that any store counts."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_new(df: DataFrame, path: str, key: list[str], order: list[str] | None = None) -> DataFrame:
    """Appends the rows whose key, nulls included, isn't in the table at ``path`` and returns the whole table.

    Of rows that share a key the first by ``order`` (all columns unless given) is taken. The table read is the state before
    the write, so a run that was broken off resumes where it stopped.
    """
    spark = df.sparkSession
    new = df.groupBy(*key).agg(F.min_by(F.struct(*df.columns), F.struct(*(order or df.columns))).alias("__row")).select("__row.*")
    if exists(spark, path):
        old = spark.read.schema(df.schema).parquet(path).select(*[F.col(k).alias(f"__old_{k}") for k in key])
        new = new.join(old, same(new, old, [(k, f"__old_{k}") for k in key]), "left_anti")
    new.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folders(spark: SparkSession, path: str, by: str) -> list[str]:
    """Values of the partition folders of ``by`` below ``path``, by a listing alone."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p) if s.isDirectory()]
    unescape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    return [unescape(n.partition("=")[2]) for n in names if n.startswith(f"{by}=")]


def write_shards(df: DataFrame, path: str, by: str = "month", redo: bool = False) -> None:
    """One folder a month; months that are there stay untouched unless ``redo``, which overwrites just those written."""
    spark = df.sparkSession
    if redo:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).json(path)
        return
    if exists(spark, path) and (done := folders(spark, path, by)):
        df = df.filter(~F.coalesce(F.col(by).cast("string"), F.lit(NO_VALUE)).isin(done))
    df.write.mode("append").partitionBy(by).json(path)


def report(df: DataFrame) -> str:
    """A one-row frame as an indented object."""
    rows = df.limit(2).toJSON().collect()  # the report's one row
    if len(rows) != 1:
        raise ValueError("a report has one row")
    return json.dumps(json.loads(rows[0]), ensure_ascii=False, indent=1)
