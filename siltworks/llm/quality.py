"""Quality rules (native): fixed base rules, then thresholds that adapt to each language and source.

Four measures a document (symbol share, repeated-line share, repeated-word share, mean word length) go into mergeable
quantile sketches: integer buckets whose width is at most 1/32 of their value, counted per (lang, source). Sketches
merge by adding counts, so partial aggregation, the language's sketch and the corpus's sketch all come from the same
rows, and reruns agree to the bit. A document's threshold is its group's far fence, q75 + 3 * (q75 - q25), with a least
slack; groups of fewer than MIN_GROUP documents use their language's, then the corpus's. Thresholds join back.

Defined results: null text has no words and fails the base rules; null lang or source is a group of its own; repeated
rows count each; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import cut, join_checked, stored
from .words import shingle_hashes, word_array

MIN_GROUP = 30
#: Repeated lines and words that any text may have, as a heading given twice; only what exceeds them counts as a share.
DUPS, REPEATS = 2, 30
#: Measure: least slack above the upper quartile, and below the lower one where that counts; in the measure's unit.
SLACK = {"q_sym": (300, None), "q_dup": (2000, None), "q_rep": (2000, None), "q_len": (150, 150)}


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text column, with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words as q_*."""
    rest = [c for c in docs.columns if c != text_col]
    t = docs.select(*rest, F.coalesce(F.col(text_col), F.lit("")).alias("q_text")).withColumn("q_w", word_array(F.col("q_text")))
    t = t.select(
        *rest, "q_w", F.size("q_w").cast("long").alias("q_words"), F.length(F.array_join("q_w", "")).cast("long").alias("q_chars"),
        F.length(F.regexp_replace("q_text", "[^#*$%&|<>]+", "")).cast("long").alias("q_symbols"),
        F.filter(F.split("q_text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("q_ls"),
    )
    t = t.select(*rest, "q_words", "q_chars", "q_symbols", F.size("q_ls").cast("long").alias("q_lines"), (F.size("q_ls") - F.size(F.array_distinct("q_ls"))).cast("long").alias("q_dups"), F.when(F.size("q_w") > 3, shingle_hashes(F.col("q_w"), 3)).otherwise(F.array().cast("array<bigint>")).alias("q_h"))
    # windows found twice or more, from sorted neighbours
    t = t.withColumn("q_s", F.sort_array(F.transform("q_h", lambda h, i: F.struct(h.alias("h"), i.alias("p")))))
    t = t.withColumn("q_e", F.zip_with("q_s", F.slice("q_s", 2, F.greatest(F.size("q_s") - 1, F.lit(0))), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    twice = F.filter(F.arrays_zip(F.col("q_s").alias("s"), F.col("q_e").alias("e"), F.concat(F.array(F.lit(False)), F.slice("q_e", 1, F.greatest(F.size("q_e") - 1, F.lit(0)))).alias("b")), lambda x: x["e"] | x["b"])
    t = t.withColumn("q_p", F.sort_array(F.transform(twice, lambda x: x["s"]["p"])))
    gaps = F.zip_with("q_p", F.slice("q_p", 2, F.greatest(F.size("q_p") - 1, F.lit(0))), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return t.select(*rest, "q_words", "q_chars", "q_symbols", "q_lines", "q_dups", F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x).alias("q_repeat"))


def bucket(v: Column) -> Column:
    """The sketch's bucket of a count: its six leading bits."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def thresholds(sketch: DataFrame) -> DataFrame:
    """Fences per (t_lang, t_source) from sketch rows (lang, source, m, b, n): arrays in the order of SLACK."""
    level = {"g": ["lang", "source"], "l": ["lang"], "a": []}
    fences = {}
    for name, keys in level.items():
        merged = sketch.groupBy(*keys, "m", "b").agg(F.sum("n").alias("n"))
        own = Window.partitionBy(*keys, "m")
        ranked = merged.select("*", F.sum("n").over(own.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)).alias("c"), F.sum("n").over(own).alias("all"))
        q = lambda k: F.min(F.when(F.col("c") * 4 >= F.col("all") * k, F.col("b")))  # noqa: B023, E731
        quart = ranked.groupBy(*keys, "m").agg(q(1).alias("q1"), q(3).alias("q3"), F.max("all").alias("all"))
        up = F.element_at(F.create_map(*[F.lit(x) for k, v in SLACK.items() for x in (k, v[0])]), F.col("m"))
        quart = quart.withColumn("hi", F.col("q3") + F.greatest(3 * (F.col("q3") - F.col("q1")), up)).withColumn("lo", F.col("q1") - F.greatest(3 * (F.col("q3") - F.col("q1")), up))
        wide = quart.groupBy(*keys).agg(F.max("all").alias(f"{name}_n"), *[F.max(F.when(F.col("m") == m, F.col(side))).alias(f"{name}_{m}_{side}") for m in SLACK for side in ("hi", "lo")])
        fences[name] = wide.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], *[c for c in wide.columns if c not in keys])
    out = fences["g"].join(fences["l"], F.col("g_lang").eqNullSafe(F.col("l_lang"))).crossJoin(F.broadcast(fences["a"]))  # the corpus's row is one
    pick = lambda m, side: F.when(F.col("g_n") >= MIN_GROUP, F.col(f"g_{m}_{side}")).when(F.col("l_n") >= MIN_GROUP, F.col(f"l_{m}_{side}")).otherwise(F.col(f"a_{m}_{side}"))
    return out.select(F.col("g_lang").alias("t_lang"), F.col("g_source").alias("t_source"), *[pick(m, side).alias(f"{m}_{side}") for m in SLACK for side in ("hi", "lo")])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per row: id, lang, source, the measures, base_failed and kept. The text is read once; what follows uses stored numbers."""
    base = (F.col("q_words") < 50) | (100 * F.col("q_repeat") > 50 * F.col("q_words"))
    share = lambda a, b, unit: F.expr(f"{unit} * {a} div greatest({b}, 1)")
    m = stored(measured(docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))).select(
        "*", base.alias("base_failed"), share("q_symbols", "q_chars", 10000).alias("q_sym"), share(f"greatest(q_dups - {DUPS}, 0)", "q_lines", 10000).alias("q_dup"),
        share(f"greatest(q_repeat - {REPEATS}, 0)", "q_words", 10000).alias("q_rep"), share("q_chars", "q_words", 100).alias("q_len"),
    ))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("m"), bucket(F.col(k)).alias("b")) for k in SLACK]))
    sketch = m.filter(~F.col("base_failed")).select("lang", "source", each.alias("x")).groupBy("lang", "source", F.col("x.m").alias("m"), F.col("x.b").alias("b")).agg(F.count("*").alias("n"))
    fence = cut(thresholds(cut(sketch)))
    out = join_checked(m, fence, [("lang", "t_lang"), ("source", "t_source")], F.struct("doc_id", "q_words"))
    fine = F.lit(True)
    for k, (_, low) in SLACK.items():
        fine = fine & (F.col(k) <= F.col(f"{k}_hi"))
        if low is not None:
            fine = fine & (F.col(k) >= F.col(f"{k}_lo"))
    return out.select("doc_id", "lang", "source", "q_words", "q_chars", "q_symbols", "q_dups", "q_repeat", "base_failed", (~F.col("base_failed") & F.coalesce(fine, F.lit(True))).alias("kept"))
