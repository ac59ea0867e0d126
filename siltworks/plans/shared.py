"""Lineage cuts and size-checked joins that every layer uses."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few numbers a row may be broadcast.
BROADCAST_ROWS = 50_000
#: Salts for the large side of a join that is too large to broadcast.
SALTS = 32


#: Arrow batches between the JVM and Python workers, which both hold several of them outside the heap; Spark's own bound.
BATCH_BYTES, SPARK_BATCH_BYTES = "4m", "67108864b"


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, once a context: their Python need not have it installed, nor share a folder.

    Bounds the session's Arrow batches too, unless it has its own bound.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", SPARK_BATCH_BYTES) == SPARK_BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    sc = spark.sparkContext
    if getattr(sc, "_siltworks", False):
        return
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="siltworks-")) / "siltworks_modules.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(path))
    sc._siltworks = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the context's own; one of this machine where neither is set and the master is local, as in tests."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="siltworks-")
        spark.conf.set("spark.checkpoint.dir", known)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(known)
    return known


@contextmanager
def used_once(spark: SparkSession) -> Iterator[None]:
    """Within, shuffle files go as soon as the rows they lead to are written, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def at_least(spark: SparkSession, n: int) -> Iterator[None]:
    """Within, shuffles of what is run have n partitions or more, so that a task's share doesn't follow the input's size; adaptive execution joins small ones."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(n, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: rows are written once to the shared folder and survive lost executors."""
    shared_dir(df.sparkSession)
    with used_once(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a plan of its own, made under the setting


def stored(df: DataFrame) -> DataFrame:
    """Like cut, but as a compressed, column-pruned Parquet table in the shared folder."""
    path = scratch(df.sparkSession, "table")
    with used_once(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Paths below the shared folder that this process wrote.
_tables: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted by release()."""
    _tables.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _tables[-1]


def release(spark: SparkSession) -> int:
    """Deletes what stored() and sinks wrote to the shared folder; to be called once the results that read them are written. Returns how many."""
    n = 0
    while _tables:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_tables.pop())
        n += bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))
    return n


def spread(df: DataFrame) -> DataFrame:
    """Rows of a narrow scan over all cores, where its files make fewer tasks than these; anything else stays as it is."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    if any(x in plan for x in ("Exchange", "Join", "Aggregate", "Adaptive")):
        return df  # asking for its tasks would run it
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def same(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, (left[a].eqNullSafe(right[b]) for a, b in keys))


def join_checked(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], spread: Column, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Left join with a small, stored ``right``: broadcast while its counted rows are within ``limit``, else salted.

    ``spread`` is a well-spread expression over ``left`` that deals the rows of a hot key to SALTS tasks.
    Key columns of ``right`` must not clash with names in ``left``; they are dropped.
    """
    if (right.count() if rows is None else rows) <= limit:
        out = left.join(F.broadcast(right), same(left, right, keys), "left")
    else:
        salted = left.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
        copies = right.withColumn("__salt_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = salted.join(copies, same(salted, copies, keys) & (F.col("__salt") == F.col("__salt_r")), "left").drop("__salt", "__salt_r")
    return out.drop(*[b for _, b in keys])
