"""MinHash near-duplicates: SuperMinHash signatures, banding, exact verification, union-find grouping.

SuperMinHash: an element gives every slot one rank of a permutation of its own plus a fraction, round j giving rank j to
one slot. A slot keeps its least value, so once all slots of a document hold less than the next rank, later rounds
cannot matter and it stops early: long documents need a few rounds, not SLOTS. The permutation is an affine one modulo a
prime, so each rank goes to each slot alike and P(equal slot) is the similarity.

Copies: documents with equal shingle sets (a 128-bit sum over the set) are one class; only its first (id, text hash) goes
on. Banding: BANDS x ROWS slots; at a similarity of 0.85 a pair is missed with a chance below 1e-6. Candidates of small
buckets are compared pairwise (below SMALL members, a constant). In larger ones every member is compared with the
bucket's densest member (the one with most company over all bands), and what the grouping still leaves apart of a bucket's
largest component is compared with it, and among itself, exactly, in blocks of bounded size, links alone leaving the task;
so no group is expanded into pairs of rows, and none is cut off. Where more than APART shingles are apart, the bucket is first
dealt out by shingles: sets that are similar enough share one among each one's first few, its rarest in the bucket, so that members
which share but a passage don't meet and no pair is lost; it changes the cost alone. A signature estimate more than five
standard deviations below the threshold saves a comparison. Shingle sets, not words, go through joins.

Defined results: null or blank text has an empty set, is linked with nothing and is kept; rows that repeat a doc_id go by
their own texts; a null doc_id links nothing, gets the group of its equals, if any, and is not kept; ids are of any
ordered type; order and further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import BROADCAST_ROWS, cut, ship, stored
from .graph import components
from .words import ascii_lower, shingle_hashes, word_array

SLOTS, BANDS, ROWS = 127, 25, 5
#: Members of buckets compared pairwise; shingles of a block; shingles apart in a bucket from which a second band counts.
SMALL, BLOCK, APART = 12, 100_000, 1_000_000
U = np.uint64
_A, _B, _C = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * _A
    x = (x ^ (x >> U(27))) * _B
    return x ^ (x >> U(31))


def superminhash(h: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Signatures (documents x SLOTS) of the sets that stand one after another in ``h``."""
    sig = np.full((lens.size, SLOTS), np.iinfo(np.uint64).max, U)
    base = mixed(h + _C)
    step, at = (base % U(SLOTS - 1) + U(1)).astype(np.int64), (mixed(base) % U(SLOTS)).astype(np.int64)
    doc = np.repeat(np.arange(lens.size), lens)
    for j in range(SLOTS):
        value = (U(j) << U(48)) | (mixed(base + np.array([j + 1], U) * _C) >> U(16))
        np.minimum.at(sig.reshape(-1), doc * SLOTS + (at + j * step) % SLOTS, value)
        more = sig.max(1) >= U(j + 1) << U(48)
        if not more.any():
            break
        if (keep := more[doc]).sum() < 0.8 * doc.size:
            base, step, at, doc = base[keep], step[keep], at[keep], doc[keep]
            if not doc.size:
                break
    return sig


def bands_of(sig: np.ndarray) -> np.ndarray:
    out = np.empty((sig.shape[0], BANDS), U)
    for b in range(BANDS):
        k = np.full(sig.shape[0], b + 1, U)
        for r in range(ROWS):
            k = mixed(k * _C + sig[:, b * ROWS + r])
        out[:, b] = k
    return out


def shingles(text: Column, k: int) -> Column:
    """The distinct k-word shingles of a text that is lower-cased by ASCII rules; ``text``'s words are made once by the caller."""
    return F.array_distinct(shingle_hashes(text, k))


def with_words(docs: DataFrame, text: str = "text", to: str = "w") -> DataFrame:
    return docs.withColumn(to, word_array(ascii_lower(F.col(text))))


def signed(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, x, n, d1, d2, sig, bands) of every row; x is a hash of the text, d1 and d2 identify the set."""
    names, kind = ["doc_id", "x", "n", "d1", "d2", "sig", "bands"], docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column("s").offsets.to_numpy())
            i = 0
            while i < len(size):
                m = max(1, int(np.searchsorted(np.cumsum(size[i:]), 400_000)))
                part = batch.slice(i, m)
                i += m
                lens = np.diff(part.column("s").offsets.to_numpy())
                h = part.column("s").flatten().to_numpy().view(U)
                some = lens > 0
                d1, d2 = np.zeros(lens.size, U), np.zeros(lens.size, U)
                starts = (np.cumsum(lens) - lens)[some]
                if h.size:
                    d1[some], d2[some] = np.add.reduceat(mixed(h ^ _A), starts), np.add.reduceat(mixed(h ^ _B), starts)
                sig = superminhash(h, lens)
                bands = bands_of(sig)
                bytes_ = mixed(sig).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("x"), pa.array(lens.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                    pa.array([x.tobytes() for x in bytes_], pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(bands.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64())),
                ], names=names)

    rows = with_words(docs.select("doc_id", F.xxhash64("text").alias("x"), "text")).select("doc_id", "x", shingles(F.col("w"), k).alias("s"))
    return rows.mapInArrow(run, f"doc_id {kind}, x bigint, n bigint, d1 bigint, d2 bigint, sig binary, bands array<bigint>")


def alike(a: str, b: str) -> Column:
    """Equal bytes of two signatures, by native arrays."""
    part = lambda c: F.transform(F.sequence(F.lit(1), F.lit(SLOTS)), lambda i: F.substring(F.col(c), i, F.lit(1)))
    return F.aggregate(F.zip_with(part(a), part(b), lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are similar enough; ``sets`` has (rep, s)."""
    a, b = (sets.select(F.col("rep").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("i"), (F.size("sa") + F.size("sb")).alias("t"))
    return both.filter(100 * F.col("i") >= percent * (F.col("t") - F.col("i"))).select("a", "b")


def linked_within(percent: int, floor: int):
    """For two blocks of a large bucket, or one with itself: exact links between members the grouping so far leaves apart."""

    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        ids, side = t["rep"].combine_chunks(), t["side"].to_numpy()
        band, before, rest, lo, hi = (int(t[c][0].as_py()) for c in ("band", "before", "rest", "lo", "hi"))
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(len(ids), SLOTS)
        bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(len(ids), BANDS)[:, :band]
        sets = [x.values.to_numpy() for x in t["s"].combine_chunks()]  # sorted
        size = np.array([len(x) for x in sets])
        names: dict = {}
        group = np.array([names.setdefault(tuple(c.values()), len(names)) for c in t["comp"].to_pylist()])
        root = list(range(len(names)))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        a, b = [], []
        crossed = not rest or lo != hi
        for x in np.flatnonzero(side == 0) if crossed else range(len(ids)):
            y = np.flatnonzero((group != group[x]) & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x])))
            y = y[side[y] == 1] if crossed else y[y > x]
            y = y[(sig[y] == sig[x]).sum(1) >= floor]
            y = y[(bands[y] == bands[x]).sum(1) == before]  # pairs that share earlier bands are compared there
            for z in y:
                if find(group[x]) == find(group[z]):
                    continue
                at = np.searchsorted(sets[x], sets[z])
                at[at == sets[x].size] = 0
                i = int((sets[x][at] == sets[z]).sum())
                if 100 * i >= percent * (size[x] + size[z] - i):
                    root[find(group[x])] = find(group[z])
                    a.append(x)
                    b.append(z)
        return pa.table({"a": ids.take(pa.array(a, pa.int64())), "b": ids.take(pa.array(b, pa.int64()))})

    return run


def by_rare_shingles(at: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``at`` with its buckets dealt out to sub-buckets in which every pair of similar sets of a bucket meets: by prefixes in the order of rarity.

    Of two sets that share c shingles each one's rarest of these stands among its first n - c + 1; c is at least percent / 100 * n.
    Shingles of one member, or of the largest component alone, lead to nothing.
    """
    said = at.join(sets, "rep").select("key", "rep", "n", "apart", F.explode("s").alias("shingle"))
    times = said.groupBy("key", "shingle").agg(F.count("*").alias("times"), F.max("apart").alias("some"))
    told = said.join(times, ["key", "shingle"])
    first = told.groupBy("key", "rep", "n").agg(F.array_sort(F.collect_list(F.struct("times", "shingle", "some"))).alias("s"))  # a document's own set
    kept = F.expr(f"slice(s, 1, cast(n - ceil(n * {percent} / 100) + 1 as int))")
    first = first.select(F.col("key").alias("of"), F.col("rep").alias("r"), F.explode(F.filter(kept, lambda x: (x["times"] > 1) & x["some"])).alias("x"))
    out = at.join(first, (F.col("key") == F.col("of")) & (F.col("rep") == F.col("r")))
    return out.withColumn("key", F.xxhash64("key", "x.shingle")).drop("of", "r", "x")


def links_in_blocks(at: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, floor: int) -> DataFrame:
    """Links (a, b) between members of large buckets, ``at`` (key, band, rep, n, comp), that are in different components.

    A bucket's largest component needs no comparison within, so its members lie in blocks of their own, each met by the
    blocks of the rest, and the rest's blocks meet one another: what is copied over blocks is the rest alone, mostly little.
    """
    per = at.groupBy("key", "comp").agg(F.sum("n").alias("m")).groupBy("key").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("all"))
    per = cut(per.select("key", F.col("top.comp").alias("main"), (F.col("all") - F.col("top.m")).alias("few"), F.col("top.m").alias("many")).filter("few > 0"))
    at = at.join(per, "key").withColumn("apart", F.col("comp") != F.col("main")).join(nodes.select("rep", "sig", "bands"), "rep")
    one = at.filter(F.col("few") <= APART).withColumn("before", F.lit(0))
    two = by_rare_shingles(at.filter(F.col("few") > APART).withColumn("before", F.lit(0)).drop("few", "many"), sets, percent)
    share = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    met = two.groupBy("key").agg(share(F.col("apart")).alias("few"), share(~F.col("apart")).alias("many")).filter("few > 0")
    rows = one.unionByName(two.join(met, "key")).withColumns({"mine": F.ceil(F.col("few") / BLOCK).cast("int"), "theirs": F.ceil(F.col("many") / BLOCK).cast("int"), "h": F.xxhash64("rep")})
    own = F.pmod(F.col("h"), F.when(F.col("apart"), F.col("mine")).otherwise(F.col("theirs"))).cast("int")
    place = lambda rest, lo, hi, side: F.struct(F.lit(rest).alias("rest"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"), side.cast("int").alias("side"))
    over = lambda n, fn: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), fn)).otherwise(F.array().cast("array<struct<rest:int,lo:int,hi:int,side:int>>"))
    of_rest = F.concat(over(F.col("theirs"), lambda i: place(0, F.col("own"), i, F.lit(0))), over(F.col("mine"), lambda i: place(1, F.least("own", i), F.greatest("own", i), F.col("own") > i)))
    rows = rows.withColumn("own", own).withColumn("p", F.explode(F.when(F.col("apart"), of_rest).otherwise(over(F.col("mine"), lambda i: place(0, i, F.col("own"), F.lit(1))))))
    rows = rows.select("key", "band", "before", "rep", "comp", "sig", "bands", "p.*")
    kind = nodes.schema["rep"].dataType.simpleString()
    return rows.join(sets, "rep").groupBy("key", "rest", "lo", "hi").applyInArrow(linked_within(percent, floor), f"a {kind}, b {kind}")


def grouped(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, x, n_shingles, first) per row of ``docs`` (doc_id, text): first is the least (doc_id, x) of its group, null in an empty set."""
    ship(docs.sparkSession)
    share = percent / 100
    floor = max(0, int(SLOTS * share - 5 * (SLOTS * share * (1 - share)) ** 0.5))
    base, key = stored(signed(docs, k)), ["n", "d1", "d2"]
    node = F.struct("doc_id", "x")
    nodes = stored(base.filter("n > 0 and doc_id is not null").groupBy(*key).agg(F.min(node).alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands")))
    keys = nodes.select("rep", "n", F.posexplode("bands").alias("band", "key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("all")).filter("c > 1")
    member = stored(keys.join(buckets, "key"))
    # densest member of each larger bucket
    large = member.filter(F.col("c") > SMALL)
    dense = large.groupBy("rep").agg(F.sum("c").alias("dense"))
    pivot = large.join(dense, "rep").groupBy("key").agg(F.min(F.struct((-F.col("dense")).alias("dense"), "rep")).alias("x")).select("key", F.col("x.rep").alias("b"))
    pivot = cut(pivot)  # one row a large bucket; cut, so that the join with a hot bucket's members can be split
    star = large.join(pivot, "key").filter("rep <> b").select(F.col("rep").alias("a"), "b")
    few = member.filter(F.col("c") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("rep")).alias("xs"))  # at most SMALL ids
    few = few.select(F.posexplode("xs").alias("i", "a"), "xs").select("a", F.explode(F.slice("xs", F.col("i") + 2, SMALL)).alias("b"))
    pairs = few.unionByName(star).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for x in "ab":
        pairs = pairs.join(nodes.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}")), x)
    near = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (alike("sa", "sb") >= floor)
    pairs = cut(pairs.filter(near).select("a", "b"))
    # whole sets of what may be linked or lies in a larger bucket
    needed = pairs.select(F.explode(F.array("a", "b")).alias("rep")).unionByName(large.select("rep")).distinct()
    texts = docs.select(F.struct("doc_id", F.xxhash64("text").alias("x")).alias("rep"), "text").join(needed, "rep", "left_semi").dropDuplicates(["rep"])
    sets = stored(with_words(texts).select("rep", F.sort_array(shingles(F.col("w"), k)).alias("s")))
    comp = components(verified(pairs, sets, percent))
    at = large.join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    more = cut(links_in_blocks(at, nodes, sets, percent, floor))
    if more.limit(1).count():
        comp = components(comp.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionByName(more))
    found = nodes.select(*key, "rep").join(comp.withColumnRenamed("id", "rep"), "rep", "left").select(*key, F.coalesce("comp", "rep").alias("first"))
    return base.select("doc_id", "x", *key).join(found, key, "left").select("doc_id", "x", F.col("n").alias("n_shingles"), "first")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``."""
    g = grouped(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), k, percent)
    g = g.select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))
    return g.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without near copies: of each group its first (id, text hash) stays, once; rows of one id and one empty set stay once too; null ids stay."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    g = grouped(own, k, percent).filter("doc_id is not null").groupBy("doc_id", "x").agg(F.count("*").alias("c"), F.max(F.struct("doc_id", "x").eqNullSafe(F.coalesce("first", F.struct("doc_id", "x")))).alias("stays"))
    other = cut(g.filter("not stays or c > 1").select(F.col("doc_id").alias("o_id"), F.col("x").alias("o_x"), "stays"))
    n = other.groupBy("stays").count().collect()  # two rows at most
    if sum(r["count"] for r in n) <= BROADCAST_ROWS:
        other = F.broadcast(other)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("x"))
    rows = rows.join(other, (F.col("id") == F.col("o_id")) & (F.col("x") == F.col("o_x")), "left").filter("stays is null or stays")
    if any(r["stays"] for r in n):  # rows that repeat an id and a text: the first by a hash of all columns, by a combining aggregate
        told = F.xxhash64(*[F.col("row")[c] for c, kind in docs.dtypes if "map<" not in kind])
        once = rows.filter("stays").groupBy("id", "x").agg(F.min_by("row", told).alias("row")).select("row")
        rows = rows.filter("stays is null").select("row").unionByName(once)
    return rows.select("row.*")
