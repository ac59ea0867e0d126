"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item's minimum under a hash function lies in a document with the probability of the item's containment in it,
however long the document is. Items are partitioned by size; each partition has its own number of hash functions and so
its own floor for the share of minima found, five standard deviations below the threshold. Minima of all items form one
sorted index; a document's shingles look it up once, and items whose floor is reached are verified by exact containment
of their shingle set in the whole document's.

The index is built from blocks of items of at most BLOCK shingles, each broadcast on its own and searched against all rows,
so its size has a bound whatever the benchmark's size.

Defined results: a text or item of fewer than k words is one shingle; null or blank ones have none and never match; rows
that repeat an id give a match each; items that repeat an id and a set count once; with no items nothing matches; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import cut, ship
from .neardup import mixed, with_words
from .words import free, shingle_hashes

K, SHARE = 5, 0.8
#: Partitions: items of up to so many shingles have so many hash functions.
PARTITIONS = ((16, 64), (64, 96), (256, 128), (1 << 60, 160))
BLOCK = 1_000_000
U = np.uint64


class Index:
    """Minima of one block of items, and their whole sets for verification."""

    def __init__(self, items: list[tuple[object, list[int]]], share: float):
        self.ids = [i for i, _ in items]
        self.sets = [np.unique(np.array(s, np.int64)) for _, s in items]
        anchors, owner = [], []
        self.floor = np.zeros(len(items))
        for n, s in enumerate(self.sets):
            m = next(m for top, m in PARTITIONS if s.size <= top)
            least = np.array([s[np.argmin(mixed(s.view(U) ^ mixed(np.array([p + 1], U))))] for p in range(m)])
            anchors.append(least)
            owner.append(np.full(m, n))
            self.floor[n] = max(1.0, m * share - 5 * (m * share * (1 - share)) ** 0.5)
        anchors, owner = np.concatenate(anchors), np.concatenate(owner)
        order = np.argsort(anchors, kind="stable")
        self.anchors, self.first, self.count = np.unique(anchors[order], return_index=True, return_counts=True)
        self.owner, self.share = owner[order], share

    def search(self, h: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
        """(document, item, shared shingles) of the batch whose shingles are h."""
        at = np.searchsorted(self.anchors, h)
        at[at == self.anchors.size] = 0
        hit = np.flatnonzero(self.anchors[at] == h)
        if not hit.size:
            return []
        pairs = np.unique(doc[hit] * self.anchors.size + at[hit])
        d, a = pairs // self.anchors.size, pairs % self.anchors.size
        n = self.count[a]
        item = self.owner[np.repeat(self.first[a], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        both, votes = np.unique(np.repeat(d, n) * len(self.ids) + item, return_counts=True)
        found = []
        for x in both[votes >= self.floor[both % len(self.ids)]]:
            d1, i1 = divmod(int(x), len(self.ids))
            lo, hi = np.searchsorted(doc, [d1, d1 + 1])
            shared = int(np.isin(self.sets[i1], h[lo:hi]).sum())
            if shared >= self.share * self.sets[i1].size:
                found.append((d1, i1, shared))
        return found


def blocks(bench: DataFrame, share: float, k: int, id_col: str, text_col: str) -> Iterator[Index]:
    items = with_words(bench.select(F.col(id_col).alias("i"), F.col(text_col).alias("text"))).select("i", F.array_distinct(shingle_hashes(F.col("w"), k)).alias("s"))
    items = cut(items.filter(F.size("s") > 0).dropDuplicates(["i", "s"]))
    total = items.agg(F.coalesce(F.sum(F.size("s")), F.lit(0)).alias("n")).first()["n"]
    parts = -(-total // BLOCK)
    for b in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("i", "s"), F.lit(parts)) == b).collect()  # a block of bounded size
        if rows:
            yield Index([(r["i"], r["s"]) for r in sorted(rows, key=lambda r: (str(r["i"]), len(r["s"])))], share)


def search(docs: DataFrame, index: Index, carry: list[str], item_type: str, k: int = K, text_col: str = "text", into: str = "items") -> DataFrame:
    """Rows of ``docs`` (columns ``carry``) with ``into``: array of struct (item, shared, size), empty where nothing matches."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    text, w, s = free([*docs.columns, into], "text", "w", "s")
    rows = with_words(docs.select(*carry, F.col(text_col).alias(text)), text, w).select(*carry, shingle_hashes(F.col(w), k).alias(s))
    schema = rows.select(*carry).withColumn(into, F.expr(f"cast(array() as array<struct<item:{item_type},shared:bigint,size:bigint>>)")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value
        for b in batches:
            sets = b.column(b.num_columns - 1)
            lens = np.diff(sets.offsets.to_numpy())
            h = sets.flatten().to_numpy()
            out: list[list] = [[] for _ in range(b.num_rows)]
            for d, i, n in x.search(h, np.repeat(np.arange(lens.size), lens)):
                out[d].append({"item": x.ids[i], "shared": n, "size": int(x.sets[i].size)})
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, kinds)], names=[*b.schema.names[:-1], into])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = to_arrow_type(schema[-1].dataType)
    return rows.mapInArrow(run, schema)


def matches(docs: DataFrame, bench: DataFrame, k: int = K, share: float = SHARE, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) of every document row and item that it contains."""
    kind = bench.select(item_col).dtypes[0][1]
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = docs.sparkSession.createDataFrame([], f"doc_id {own.dtypes[0][1]}, item_id {kind}, n_shared bigint, n_item bigint")
    for index in blocks(bench, share, k, item_col, text_col):
        found = search(own, index, ["doc_id"], kind, k).select("doc_id", F.explode("items").alias("x"))
        out = out.unionByName(found.select("doc_id", F.col("x.item").alias("item_id"), F.col("x.shared").alias("n_shared"), F.col("x.size").alias("n_item")))
    return out


def clean(docs: DataFrame, bench: DataFrame, k: int = K, share: float = SHARE, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that contain an item; one narrow pass a block, nothing is shuffled."""
    kind, names = bench.select(item_col).dtypes[0][1], docs.columns
    (items,) = free(names, "items")
    for index in blocks(bench, share, k, item_col, text_col):
        docs = search(docs, index, names, kind, k, text_col, items).filter(F.size(items) == 0).select(*names)
    return docs
