"""Mixing sources to target weights (native).

Sizes are word counts. Tokens are aggregated per source; targets follow by filling weighted shares under a cap;
each document is emitted floor(rate) times plus one hash-seeded Bernoulli copy with probability equal to the
fraction, rate being target / source size.

Defined results: null or blank text has size 0 and rate as its source; a null source is a source of its own, last
in order; repeated doc_ids draw alike, null ones by their texts; a source of size 0 has target 0 and rate 0; empty tables give empty results;
further columns, whatever their names, pass through ``mix`` untouched.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import cut, join_checked
from .words import free, word_count

WEIGHTS, CAP, SEED = (5, 2, 1), 3, "mix-1"


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(__mix_src, __mix_source_size, __mix_target) from rows (__mix_src, __mix_size).

    A source's target is min(cap * size, level * weight); the level is the one at which all targets add up to all
    sizes, which is where sharing out the excess again and again ends. In order of cap/weight the capped sources
    come first, so prefix sums over the aggregated sources find it; comparisons are exact.
    """
    big, many = "decimal(20,0)", lcm(*weights)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.col("__mix_rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    per = sized.groupBy("__mix_src").agg(F.sum("__mix_size").alias("__mix_source_size"))
    per = per.withColumn("__mix_rank", F.row_number().over(Window.orderBy(F.col("__mix_src").asc_nulls_last()))).withColumn("__mix_w", w).withColumn("__mix_c", F.lit(cap) * F.col("__mix_source_size"))
    rows = Window.orderBy(F.col("__mix_c") * (F.lit(many) / F.col("__mix_w")).cast("long"), "__mix_rank")
    before, whole = rows.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    part = lambda c, over: F.coalesce(F.sum(c).over(over), F.lit(0))
    per = per.select("*", part("__mix_source_size", whole).alias("__mix_all"), part("__mix_w", whole).alias("__mix_all_w"), part("__mix_c", before).alias("__mix_pc"), part("__mix_w", before).alias("__mix_pw"))
    per = per.withColumn("__mix_capped", F.col("__mix_c").cast(big) * (F.col("__mix_all_w") - F.col("__mix_pw")).cast("decimal(18,0)") <= F.col("__mix_w").cast("decimal(18,0)") * (F.col("__mix_all") - F.col("__mix_pc")).cast(big))
    used = lambda c: part(F.when(F.col("__mix_capped"), F.col(c)).otherwise(0), whole)
    per = per.select("*", used("__mix_c").alias("__mix_uc"), used("__mix_w").alias("__mix_uw"))
    share = (F.col("__mix_w") * (F.col("__mix_all") - F.col("__mix_uc"))).cast("double") / F.nullif(F.col("__mix_all_w") - F.col("__mix_uw"), F.lit(0)).cast("double")
    return per.select("__mix_src", "__mix_source_size", F.when(F.col("__mix_capped"), F.col("__mix_c").cast("double")).otherwise(share).alias("__mix_target"))


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """An even number in [0, 1) of 52 bits that depends on the seed and the id alone, or on the text where there is no id."""
    own = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), own)), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``docs`` with __mix_size, __mix_source_size, __mix_target and __mix_copies; every row stays."""
    per = cut(source_targets(docs.select(F.col(source_col).alias("__mix_src"), word_count(F.col(text_col)).alias("__mix_size")), weights, cap))
    out = join_checked(docs.withColumn("__mix_size", word_count(F.col(text_col))), per, [(source_col, "__mix_src")], F.struct(F.col(id_col), F.col("__mix_size")))
    rate = F.coalesce(F.col("__mix_target") / F.nullif(F.col("__mix_source_size"), F.lit(0)).cast("double"), F.lit(0.0))
    copies = F.floor(rate) + F.when(draw(F.col(id_col), F.col(text_col), seed) < rate - F.floor(rate), 1).otherwise(0)
    return out.withColumn("__mix_copies", copies.cast("long"))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs`` alone."""
    away = {c: free(docs.columns, f"kept{i}")[0] for i, c in enumerate(docs.columns) if c.lower().startswith("__mix_")}
    chosen = plan(docs.withColumnsRenamed(away), **kw)
    out = chosen.filter("__mix_copies > 0").withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_copies"))))
    return out.select(*[chosen[away.get(c, c)].alias(c) for c in docs.columns])
