"""Documents of each event's window of days: an interval join by buckets, not a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..plans.shared import join_checked, stored
from ..sources.derived import DATED, dated

#: Days of a bucket, rows of a bucket's part.
DAYS, PART = 32, 1_000_000


def within(events: DataFrame, docs: DataFrame, lo: str, hi: str, date: str, spread: str, days: int = DAYS, part: int = PART) -> DataFrame:
    """Every event with every document of its window, ``lo`` and ``hi`` included; all columns of both, which must differ in name.

    Windows and documents meet by buckets of days: a window goes to each bucket it touches, a document to its own, so the join is an equi-join
    and adaptive execution may split it. A bucket of more than ``part`` documents is dealt to several parts by a hash of ``spread``, and the windows that
    touch it go to each. Null ends are open: they reach to the first or last document. Undated documents and windows that end
    before they begin meet nothing; repeated rows meet as often as they stand there.
    """
    bucket = lambda c: F.floor(F.unix_date(c) / days).cast("int")
    d = docs.filter(F.col(date).isNotNull()).withColumn("__b", bucket(F.col(date)))
    parts = stored(d.groupBy("__b").agg(F.count("*").alias("n"), F.min(date).alias("first"), F.max(date).alias("last")).select(F.col("__b").alias("__pb"), F.ceil(F.col("n") / part).cast("int").alias("__parts"), "first", "last"))
    first, last = (F.lit(x).cast("date") for x in parts.agg(F.min("first"), F.max("last")).first())
    e = events.withColumns({"__lo": F.greatest(F.coalesce(lo, first), first), "__hi": F.least(F.coalesce(hi, last), last)})
    e = e.filter("__lo <= __hi").withColumn("__b", F.explode(F.sequence(bucket(F.col("__lo")), bucket(F.col("__hi")))))
    sizes = parts.select("__pb", "__parts")  # a row a bucket
    e = join_checked(e, sizes, [("__b", "__pb")], F.xxhash64(*events.columns)).filter("__parts is not null").withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    d = join_checked(d, sizes, [("__b", "__pb")], F.xxhash64(spread)).withColumn("__part", F.pmod(F.xxhash64(spread), F.col("__parts").cast("bigint")).cast("int")).drop("__parts")
    both = e.drop("__parts").join(d, ["__b", "__part"])
    return both.filter(F.col(date).between(F.col("__lo"), F.col("__hi"))).select(*events.columns, *docs.columns)


_EV = "item_id, CASE WHEN item_id % 10 <> 1 THEN {add}(DATE'2026-01-01', CAST(item_id * 3 % 212 AS INT) - 1) END AS lo, CASE WHEN item_id % 10 <> 0 THEN {add}(DATE'2026-01-01', CAST(item_id * 3 % 212 AS INT) + CAST(item_id % 22 AS INT)) END AS hi"


@query("window_docs", f"WITH {DATED}, e AS (SELECT {_EV.format(add='date_add_days')} FROM benchmark) SELECT item_id, doc_id FROM e JOIN d ON d.date::DATE BETWEEN coalesce(lo, DATE '1900-01-01') AND coalesce(hi, DATE '2100-01-01')".replace("date_add_days(DATE'2026-01-01', ", "(DATE '2026-01-01' + "))
def _docs(t):
    """Documents from a day before each event to some days after; windows overlap, and some are open to one side."""
    e = t("benchmark").selectExpr(*_EV.format(add="date_add").replace("END AS lo, ", "END AS lo|").replace("item_id, ", "item_id|", 1).split("|"))
    d = dated(t("documents")).select("doc_id", F.to_date("date").alias("day"))
    return within(e, d, "lo", "hi", "day", "doc_id").select("item_id", "doc_id")
