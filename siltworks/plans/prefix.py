"""Exact prefix sums over a whole table without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a hashed order: the first three hex digits, so 4,096 tasks' worth of rows and as many totals.
DIGITS = 3


def hashed(seed: str, *ids: Column) -> Column:
    """A reproducible shuffle key, the same in any engine with md5."""
    return F.md5(F.concat(F.lit(seed + ":"), *[i.cast("string") for i in ids]))


def prefix_sum(df: DataFrame, key: str, value: str, order: list[str], out: str = "cum", by: list[str] | None = None, bucket: Column | None = None) -> DataFrame:
    """Adds the exclusive prefix sum of ``value`` in the order of (bucket of ``key``, ``order``), per ``by``.

    Two levels: rows are windowed within buckets of a sortable key (its first DIGITS characters unless given), bucket
    totals are windowed among themselves, and the two sums meet. Buckets are spread over tasks, totals are a small table
    whose size follows from the key's alphabet; every row meets its bucket's total by an equi-join.
    """
    by = by or []
    b = F.substring(F.col(key), 1, DIGITS) if bucket is None else bucket
    t = df.withColumn("__b", b)
    totals = t.groupBy(*by, "__b").agg(F.sum(value).alias("__t"))
    over = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__b").alias("__tb"), F.coalesce(F.sum("__t").over(over), F.lit(0)).alias("__before"))
    inner = Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("__in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    on = F.col("__b").eqNullSafe(F.col("__tb"))
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    out_df = t.join(totals, on, "left").withColumn(out, F.col("__before") + F.col("__in"))
    return out_df.drop("__b", "__tb", "__in", "__before", *[f"__k_{c}" for c in by])


#: Ids of a bucket, where ids in order are ranked by prefix sums.
ID_BUCKET = 65_536


def ranked(df: DataFrame, by: list[str], order: list[str], bucket: Column, name: str = "rank") -> DataFrame:
    """Places from 1 within each group, by exact prefix sums, so that a hot group isn't one task's; ``order`` refines ``bucket``."""
    return prefix_sum(df.withColumn("__one", F.lit(1)), "", "__one", order, name, by, bucket).withColumn(name, F.col(name) + 1).drop("__one")


def by_id(column: str = "doc_id") -> Column:
    return F.expr(f"{column} div {ID_BUCKET}")


def by_hash(column: str = "h") -> Column:
    return F.substring(column, 1, DIGITS)
