"""Words as the contracts define them: runs of [^\\x20\\x09-\\x0D]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The separators besides the space itself.
BLANKS = "\t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text: Column) -> Column:
    """Words of a text; null or blank text: an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shingle_hashes(words: Column, k: int) -> Column:
    """xxhash64 of every run of k words by position; fewer than k words: the whole sequence as one; none: empty.

    ``words`` must be a plain column, as it is used several times.
    """
    n = F.greatest(F.size(words) - (k - 1), F.lit(0))
    runs = F.arrays_zip(*[F.slice(words, i + 1, n).alias(f"w{i}") for i in range(k)])
    hashed = F.transform(runs, lambda r: F.xxhash64(*[r[f"w{i}"] for i in range(k)]))
    short = F.array(F.xxhash64(F.concat_ws("\n", words)))
    return F.when(F.size(words) >= k, hashed).when(F.size(words) > 0, short).otherwise(F.array().cast("array<bigint>"))


def free(names: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores after it as keep it apart from ``names``, whatever their case."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
