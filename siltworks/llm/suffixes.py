"""Suffix-array dedup with a sparse, distributed suffix array.

Suffixes of word sequences are kept only at content-selected places: a place is kept if its k-gram of GRAM words has the
least hash in some window of WINDOW k-grams. Any match of WINDOW - 1 + PREFIX words or more holds such a place with PREFIX
words after it, so MIN_WORDS (50) loses none. Suffixes sort over the whole cluster, range partitioned, in the order of
their blocks: the first PREFIX words, then NEXT words, then (doc_id, place), blocks ordered by their hashes. So suffixes
with a common start of PREFIX words stand together, among them those that share NEXT words more, first copies first, and a
frequent passage spreads over many tasks. Each suffix is compared with its neighbour, across partition borders too;
neighbours on one diagonal of two documents extend each other.

What they cover in MIN_WORDS words or more is a match as it stands. A suffix array holds only what follows a place, so the
neighbour need not share the longest match to the left: wherever a suffix has a neighbour and a window of MIN_WORDS words
around it is within no such match, these windows and those around the first suffix of its start are compared by hashes of
their own with the first copy of each, left and right of the place. As no first copy lies within a match, every repeated
window is found, and the matches cover exactly the words of repeated windows.

A match is reported for its later copy, against an earlier one; the first copy of a passage stays untouched.
Comparison ignores ASCII case and the white space between words; blocks and words compare by 64-bit hashes.

Defined results: null, blank or short texts have no suffixes; a null doc_id sorts first; a document is an id and a text
(told apart by a 30-bit hash within the id), so rows that repeat both are not matched with themselves and rows of one id
with different texts are; a passage repeated within a document is matched; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import ship, stored
from .neardup import mixed, with_words

GRAM, WINDOW, PREFIX, NEXT, MIN_WORDS = 8, 16, 32, 16, 50
U = np.uint64
_C = U(0x9E3779B97F4A7C15)
#: Bits of a place in its text; bits that tell the texts of one id apart (places' differences are longs too).
PLACE, TEXTS = (1 << 32) - 1, (1 << 30) - 1


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place, by doubling; n is a power of two. Places too near the end hold rubbish."""
    step = 1
    while step < n:
        later = np.r_[h[step:], np.zeros(min(step, h.size), U)][: h.size]
        h = mixed(h * _C + mixed(later + U(step)))
        step *= 2
    return h


def kept_places(h: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places with PREFIX words after them that a minimiser selects, the hash of those words and that of NEXT words more (0 where the text has fewer)."""
    if h.size < WINDOW + PREFIX:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)
    gram, prefix = rolled(h, GRAM), rolled(h, PREFIX)
    end = np.repeat(np.cumsum(lens), lens)
    views = np.lib.stride_tricks.sliding_window_view(gram, WINDOW)
    start = np.arange(views.shape[0])
    whole = start + WINDOW - 1 + GRAM <= end[: start.size]  # windows within one document
    at = np.unique((start + views.argmin(1))[whole])
    at = at[at + PREFIX <= end[at]]
    h2 = rolled(h, NEXT)[np.minimum(at + PREFIX, h.size - 1)]
    return at, prefix[at], np.where(at + PREFIX + NEXT <= end[at], h2, U(0))


def suffix_rows(docs: DataFrame) -> DataFrame:
    """(h, h2, doc_id, p) of every kept suffix of (doc_id, x, text); p is x * 2 ** 32 + place."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, i = np.diff(b.column("s").offsets.to_numpy()), 0
            total = np.cumsum(size)
            while i < size.size:
                m = max(1, int(np.searchsorted(total[i:] - (total[i] - size[i]), 1_000_000)))
                part = b.slice(i, m)
                i += m
                lens = np.diff(part.column("s").offsets.to_numpy())
                at, h, h2 = kept_places(part.column("s").flatten().to_numpy().view(U), lens)
                doc = np.repeat(np.arange(lens.size), lens)[at]
                p = (part.column("x").to_numpy().astype(np.int64)[doc] << 32) + at - (np.cumsum(lens) - lens)[doc]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(h2.view(np.int64)), part.column("doc_id").take(pa.array(doc)), pa.array(p)], names=["h", "h2", "doc_id", "p"])

    return hashed(docs).select("doc_id", "x", "s").mapInArrow(run, f"h bigint, h2 bigint, doc_id {kind}, p bigint")


def hashed(docs: DataFrame, *more: str) -> DataFrame:
    return with_words(docs).select("doc_id", "x", F.transform("w", lambda x: F.xxhash64(x)).alias("s"), *more)


def neighbours(rows: DataFrame) -> DataFrame:
    """(h, doc_id, p, q_id, q, s): each suffix whose neighbour before it in the sorted array has the same first words (itself, where rows repeat); s: that one has none before it."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, alone = TaskContext.get().partitionId(), None, True

        def out(edge: int, h, d, p, d0, p0, s) -> pa.RecordBatch:
            n = len(h)
            return pa.RecordBatch.from_arrays([pa.array([edge] * n, pa.int32()), pa.array([part] * n, pa.int32()), h, d, p, d0, p0, pa.array(s, pa.bool_())], names=["edge", "part", "h", "doc_id", "p", "q_id", "q", "s"])

        for b in batches:
            if not b.num_rows:
                continue
            h, d, p = b.columns
            if last is None:
                yield out(1, h[:1], d[:1], p[:1], pa.nulls(1, d.type), pa.nulls(1, p.type), [None])
                lh, ld, lp = h[:0], d[:0], p[:0]
            else:
                lh, ld, lp = last
            h2, d2, p2 = pa.concat_arrays([lh, h]), pa.concat_arrays([ld, d]), pa.concat_arrays([lp, p])
            x = h2.to_numpy(zero_copy_only=False)
            start = np.r_[alone, x[1:] != x[:-1]]
            at = np.flatnonzero(~start[1:])
            a, z = pa.array(at + 1), pa.array(at)
            yield out(0, h2.take(a), d2.take(a), p2.take(a), d2.take(z), p2.take(z), start[at])
            last, alone = tuple(c[len(c) - 1 :] for c in (h, d, p)), bool(start[-1])
        if last is not None:
            yield out(2, *last, pa.nulls(1, last[1].type), pa.nulls(1, last[2].type), [alone])

    order = ["h", "h2", "doc_id", "p"]
    found = stored(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("h", "doc_id", "p").mapInArrow(run, f"edge int, part int, h bigint, doc_id {kind}, p bigint, q_id {kind}, q bigint, s boolean"))
    # borders: one first and one last row a partition
    w = Window.orderBy("part", "edge")
    border = found.filter("edge > 0").select("edge", "part", "h", "doc_id", "p", F.lag(F.struct("h", "doc_id", "p", "s")).over(w).alias("b")).filter("edge = 1 and b.h = h")
    both = found.filter("edge = 0").drop("edge", "part").unionByName(border.select("h", "doc_id", "p", F.col("b.doc_id").alias("q_id"), F.col("b.p").alias("q"), "b.s"))
    return both


def within(a: np.ndarray, z: np.ndarray, spans: pa.Array) -> np.ndarray:
    """Which ranges a to z lie in one of the spans (a, z)."""
    if not len(spans):
        return np.zeros(a.size, bool)
    x, y = (spans.field(k).to_numpy(zero_copy_only=False) for k in ("a", "z"))
    order = np.argsort(x, kind="stable")
    far, at = np.maximum.accumulate(y[order]), np.searchsorted(x[order], a, "right")
    return (at > 0) & (far[at - 1] >= z)


def text_of(p: str) -> Column:
    return F.shiftright(p, 32)


def spans_of(done: DataFrame) -> DataFrame:
    """(d_id, d_x, spans) of the documents with spans (doc_id, a, z)."""
    return done.groupBy(F.col("doc_id").alias("d_id"), text_of("a").alias("d_x")).agg(F.collect_list(F.struct("a", "z")).alias("spans"))


def open_places(near: DataFrame, done: DataFrame, min_words: int) -> DataFrame:
    """(h, doc_id, p): suffixes with a window around them that no span of ``done`` holds."""
    kind = near.schema["doc_id"].dataType.simpleString()
    own = near.groupBy("doc_id", text_of("p").alias("x")).agg(F.collect_list(F.struct("p", "h")).alias("at"))
    both = own.join(spans_of(done), F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("x") == F.col("d_x")), "left").select("doc_id", "at", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, ps, ns = [], [], []
            for at, spans in zip(b.column("at"), b.column("spans"), strict=True):
                p, h = (at.values.field(k).to_numpy() for k in ("p", "h"))
                open_ = ~within(np.maximum(p - WINDOW + 1, p & ~PLACE), p + min_words, spans.values if spans.is_valid else pa.array([]))
                hs.append(h[open_])
                ps.append(p[open_])
                ns.append(int(open_.sum()))
            if hs:
                doc = np.repeat(np.arange(len(ns)), ns)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), b.column("doc_id").take(pa.array(doc)), pa.array(np.concatenate(ps))], names=["h", "doc_id", "p"])

    return both.mapInArrow(run, f"h bigint, doc_id {kind}, p bigint")


def window_rows(own: DataFrame, places: DataFrame, done: DataFrame, min_words: int) -> DataFrame:
    """(w, doc_id, a): hash of the windows around ``places`` (doc_id, p) that no span of ``done`` holds; w null: a's place is the number of words."""
    kind, power = own.schema["doc_id"].dataType.simpleString(), 1 << (min_words.bit_length() - 1)
    at = places.groupBy(F.col("doc_id").alias("p_id"), text_of("p").alias("p_x")).agg(F.collect_set("p").alias("at"))
    at = at.join(spans_of(done), F.col("p_id").eqNullSafe(F.col("d_id")) & (F.col("p_x") == F.col("d_x")), "left").drop("d_id", "d_x")
    text = hashed(own.join(at, own["doc_id"].eqNullSafe(at["p_id"]) & (own["x"] == at["p_x"])), "at", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (text, s, at, spans) in enumerate(zip(b.column("x").to_numpy().astype(np.int64) << 32, b.column("s"), b.column("at"), b.column("spans"), strict=True)):
                h, p = s.values.to_numpy().view(U), at.values.to_numpy() & PLACE
                near = np.zeros(h.size + 1, np.int64)
                np.add.at(near, np.maximum(p - WINDOW + 1, 0), 1)
                np.add.at(near, p + 1, -1)
                a = np.flatnonzero(np.cumsum(near))
                a = a[a + min_words <= h.size]
                a = a[~within(a + text, a + text + min_words, spans.values if spans.is_valid else pa.array([]))]
                part = rolled(h, power)
                x = mixed(part[a] * _C + mixed(part[a + min_words - power] + U(min_words)))
                n = a.size + 1
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[x.view(np.int64), 0], mask=np.arange(n) == n - 1), b.column("doc_id").take(pa.array(np.full(n, i))), pa.array(np.r_[a, h.size] + text)], names=["w", "doc_id", "a"])

    return text.mapInArrow(run, f"w bigint, doc_id {kind}, a bigint")


def merged_spans(pieces: DataFrame) -> DataFrame:
    """(doc_id, q_id, g, a, z): pieces on one diagonal that touch or overlap, as one."""
    w = Window.partitionBy("doc_id", "q_id", "g").orderBy("a", "z")
    pieces = pieces.withColumn("new", F.coalesce((F.col("a") > F.max("z").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1)))
    pieces = pieces.withColumn("c", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return pieces.groupBy("doc_id", "q_id", "g", "c").agg(F.min("a").alias("a"), F.max("z").alias("z")).drop("c")


def matches(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x, n_words, start, length, other_id, other_start): matches of a later copy, in words, that cover all it repeats; x tells texts of one id apart."""
    ship(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("doc_id"), F.hash(text_col).bitwiseAND(F.lit(TEXTS)).alias("x"), F.col(text_col).alias("text"))
    known = neighbours(stored(suffix_rows(own)))
    near = known.filter(~(F.col("doc_id").eqNullSafe(F.col("q_id")) & (F.col("p") == F.col("q"))))
    pair = near.select(F.greatest(F.struct("doc_id", "p"), F.struct(F.col("q_id").alias("doc_id"), F.col("q").alias("p"))).alias("l"), F.least(F.struct("doc_id", "p"), F.struct(F.col("q_id").alias("doc_id"), F.col("q").alias("p"))).alias("f"))
    chain = merged_spans(pair.select(F.col("l.doc_id").alias("doc_id"), F.col("f.doc_id").alias("q_id"), (F.col("l.p") - F.col("f.p")).alias("g"), F.col("l.p").alias("a"), (F.col("l.p") + PREFIX).alias("z")).distinct())
    chain = stored(chain.filter(F.col("z") - F.col("a") >= min_words))
    opened = stored(open_places(near, chain, min_words))
    # of each start's suffixes the first in the array is nobody's later neighbour; it counts where another is open (if it is itself a later copy, the first copy is)
    starts = known.filter("s").select("h", F.col("q_id").alias("doc_id"), F.col("q").alias("p")).join(opened.select("h").distinct(), "h")
    places = opened.select("doc_id", "p").unionByName(starts.select("doc_id", "p"))
    rows = stored(window_rows(own, places, chain, min_words))
    windows = rows.filter("w is not null")
    first = windows.groupBy("w").agg(F.min(F.struct("doc_id", "a")).alias("f"), F.max(F.struct("doc_id", "a")).alias("l")).filter(~F.col("f").eqNullSafe(F.col("l"))).select("w", "f")
    late = windows.join(stored(first), "w").filter(~F.struct("doc_id", "a").eqNullSafe(F.col("f")))
    late = late.select("doc_id", F.col("f.doc_id").alias("q_id"), (F.col("a") - F.col("f.a")).alias("g"), "a", (F.col("a") + min_words).alias("z")).distinct()
    both = merged_spans(chain.select(*late.columns).unionByName(late)).withColumn("x", text_of("a"))
    place = lambda c: c.bitwiseAND(F.lit(PLACE))
    size = rows.filter("w is null").groupBy(F.col("doc_id").alias("n_id"), text_of("a").alias("n_x")).agg(F.max(place(F.col("a"))).alias("n_words"))
    both = both.join(size, F.col("doc_id").eqNullSafe(F.col("n_id")) & (F.col("x") == F.col("n_x")))
    return both.select("doc_id", "x", "n_words", place(F.col("a")).alias("start"), (F.col("z") - F.col("a")).alias("length"), F.col("q_id").alias("other_id"), place(F.col("a") - F.col("g")).alias("other_start"))


def repeated(docs: DataFrame, **kw) -> DataFrame:
    """Per document with matches: doc_id, n_words, n_dup_words (covered by any match), other_ids, spans (start, length, other_id, other_start)."""
    g = matches(docs, **kw).groupBy("doc_id", "x").agg(F.max("n_words").alias("n_words"), F.array_sort(F.collect_list(F.struct("start", "length", "other_id", "other_start"))).alias("spans"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(x["start"] + x["length"] - F.greatest(x["start"], s["end"]), F.lit(0).cast("long"))).alias("n"), F.greatest(s["end"], x["start"] + x["length"]).alias("end"))
    covered = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), step)["n"]
    return g.select("doc_id", "n_words", covered.alias("n_dup_words"), F.array_sort(F.array_distinct(F.filter(F.transform("spans", lambda x: x["other_id"]), lambda x: x.isNotNull()))).alias("other_ids"), "spans")
