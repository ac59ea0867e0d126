"""Union-find grouping of links as DataFrames: hooks to the smallest neighbour, pointer jumps, contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for every id in ``links`` (a, b); comp is the smallest id that links reach.

    Each round every vertex hooks to its smallest neighbour, chains are shortened by jumps, and what stays linked between
    roots is the next round's, so rounds are few; each is cut by a checkpoint. Links without both ends are left out.
    """
    edges = cut(links.filter("a is not null and b is not null and a <> b").select("a", "b").distinct())
    known = None
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("up")))
        moved = True
        while moved:  # to the roots, else links between parts of a chain would be lost
            over = hook.select(F.col("id").alias("x"), F.col("up").alias("y"))
            jumped = cut(hook.join(over, F.col("up") == F.col("x"), "left").select("id", F.coalesce("y", "up").alias("to"), "up"))
            moved = jumped.filter("to <> up").limit(1).count() > 0
            hook = jumped.select("id", F.col("to").alias("up"))
        left, right = hook.select(F.col("id").alias("a"), F.col("up").alias("ua")), hook.select(F.col("id").alias("b"), F.col("up").alias("ub"))
        edges = cut(edges.join(left, "a").join(right, "b").filter("ua <> ub").select(F.col("ua").alias("a"), F.col("ub").alias("b")).distinct())
        if known is None:
            known = hook.select("id", F.col("up").alias("comp"))
        else:
            step = hook.select(F.col("id").alias("comp"), "up")
            known = known.join(step, "comp", "left").select("id", F.coalesce("up", "comp").alias("comp"))
        known = cut(known)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("comp")) if known is None else known
