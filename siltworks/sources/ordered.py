"""A sink of numbered shards that, read one after the other, hold a table in one total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..plans.prefix import prefix_sum
from ..plans.shared import join_checked
from .writers import exists, folders


def plan_shards(df: DataFrame, order: list[str], size: str, room: int, bucket: Column) -> DataFrame:
    """(bucket, cuts): the shards that have rows in each bucket of the order, and each one's first key there.

    A row's shard is the sum of ``size`` over all rows before it, in units of ``room``. Sums are exact, over the columns of the order
    alone; ``order`` must refine ``bucket``, whose values should be thousands, however many rows there are: their totals meet in one
    task, and while the cuts are few the whole plan is broadcast. Rows that share a whole key go to one shard, the last that any of them reaches.
    """
    narrow = df.select(*order, F.coalesce(F.col(size), F.lit(0)).alias("__size"), bucket.alias("__bucket"))
    at = prefix_sum(narrow, "", "__size", [*order, "__size"], "__at", None, F.col("__bucket"))
    first = at.groupBy("__bucket", F.expr(f"__at div {room}").alias("shard")).agg(F.min(F.struct(*order)).alias("key"))
    return first.groupBy(F.col("__bucket").alias("bucket")).agg(F.sort_array(F.collect_list(F.struct("shard", "key"))).alias("cuts"))


def write_ordered(df: DataFrame, path: str, order: list[str], size: str, room: int, bucket: Column) -> DataFrame:
    """Writes ``df`` below ``path`` in shards of about ``room`` of ``size`` each, one sorted file a shard, and returns the manifest.

    Where shards begin is planned once and kept in the folder, so a run that was broken off is finished by the same call: shards
    that are there are not written again. Whole rows are shuffled once. Null keys sort first, a null size is 0; rows larger than
    ``room`` may leave shard numbers out. A finished folder stays as it is.
    """
    spark = df.sparkSession
    if not exists(spark, f"{path}/plan/_SUCCESS"):
        plan_shards(df, order, size, room, bucket).write.mode("overwrite").parquet(f"{path}/plan")
    plan = spark.read.parquet(f"{path}/plan").withColumnRenamed("bucket", "__of")
    cuts = plan.agg(F.coalesce(F.sum(F.size("cuts")), F.lit(0))).first()[0]
    rows = join_checked(df.withColumn("__bucket", bucket), plan, [("__bucket", "__of")], F.struct(*order), cuts)
    key = F.struct(*order)
    shard = F.element_at(F.filter("cuts", lambda c: c["key"] <= key), -1)["shard"]
    rows = rows.select(*df.columns, shard.alias("shard"))
    if exists(spark, f"{path}/shards") and (done := folders(spark, f"{path}/shards", "shard")):
        rows = rows.filter(~F.col("shard").isin([int(x) for x in done]))
    rows.repartition("shard").sortWithinPartitions("shard", *order).write.mode("append").partitionBy("shard").parquet(f"{path}/shards")
    if not exists(spark, f"{path}/manifest/_SUCCESS"):
        made = read_ordered(spark, path, df.schema).groupBy("shard").agg(F.count("*").alias("rows"), F.sum(F.coalesce(F.col(size), F.lit(0))).alias("size"), F.min(F.struct(*order)).alias("first"))
        w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
        before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_before")
        made.select("*", before("rows"), before("size")).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_ordered(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All rows, of the ``schema`` that was written, with their shard and ``row``, the place in it from 0."""
    whole = StructType([*schema, StructField("shard", LongType())])
    return spark.read.schema(whole).parquet(f"{path}/shards").select("*", F.col("_metadata.row_index").alias("row"))
