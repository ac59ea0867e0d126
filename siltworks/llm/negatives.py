"""Hard negatives by two-dimensional block products.

Anchors and rows are dealt by hash into stripes of bounded bytes. Every pair of stripes is a task's share: it multiplies blocks of
ANCHORS anchors with blocks of ROWS rows, whole vectors each, and keeps a few rows an anchor and window as it goes, so that no score
leaves a task but its best ones. What moves are copies of the vectors, rows once for each stripe of anchors (65,536 anchors of 64
dimensions) and anchors once for each stripe of rows; the products, which are anchors times rows, move nothing.

Two rounds over the pairs: blocks of equal labels give each anchor its positives, the best ``positives`` rows of its label; their
scores set the windows, and rows of different labels give per anchor and positive the best ``negatives`` rows within its window.
A hot label is dealt out like any other.

Scores are integer inner products of components floor(scale * x), computed exactly: in floating point where every partial sum is
exact there, else in int64. Components saturate where scores could pass 2**55.

Defined results: rows without id, label or vector, or with a null or non-finite component, take no part; of rows that share an
id the least (label, vector) counts; vectors of other lengths count as filled with zeros; ties go to the smaller id; an anchor
without positives, or a window without rows, gives none; no anchors or rows: an empty result. Other columns are not read. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import join_checked, ship, stored

#: Rows of the two kinds of blocks; bytes of the two kinds of stripes.
ANCHORS, ROWS, ANCHOR_BYTES, ROW_BYTES = 256, 1024, 1 << 24, 1 << 23
LOWEST = -(1 << 62)  # below any score


def taking_part(vectors: DataFrame, id_col: str, label: Column, vector_col: str) -> DataFrame:
    """(vec_id, label, v): a row an id."""
    v = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), label.alias("label"), F.col(vector_col).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).filter(fine)
    return v.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m")).select("vec_id", "m.*")


def quantised(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, code, q): the components, floored and filled up to ``dims``, as 32-bit integers."""
    most = int((2**55 / max(dims, 1)) ** 0.5)  # below 2**28
    step = max(1, (1 << 20) // max(dims, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                t = whole.slice(at, step)
                v = t.column("v")
                flat = np.asarray(v.flatten().to_numpy(zero_copy_only=False), np.float64)
                lens = np.asarray(pa.compute.list_value_length(v).to_numpy(zero_copy_only=False), np.int64)
                q = np.zeros((t.num_rows, dims), "<i4")
                q[np.repeat(np.arange(lens.size), lens), np.arange(flat.size) - np.repeat(np.cumsum(lens) - lens, lens)] = np.clip(np.floor(scale * flat), -most, most)
                yield pa.RecordBatch.from_arrays([t.column("vec_id"), t.column("code"), pa.array([x.tobytes() for x in q], pa.binary())], names=["vec_id", "code", "q"])

    return rows.select("vec_id", "code", "v").mapInArrow(run, "vec_id bigint, code bigint, q binary")


def product(a: bytes | np.ndarray, b: bytes | np.ndarray, n: int, m: int) -> np.ndarray:
    """The exact tile of two blocks of n and m rows of 64-bit integers."""
    x, y = np.frombuffer(a, np.int64).reshape(n, -1), np.frombuffer(b, np.int64).reshape(m, -1)
    if not x.size or not y.size:
        return np.zeros((n, m), np.int64)
    most = int(np.abs(x).max()) * int(np.abs(y).max()) * x.shape[1]
    if most < 1 << 53:
        kind = np.float32 if most < 1 << 24 else np.float64
        return (x.astype(kind) @ y.astype(kind).T).astype(np.int64)
    return x @ y.T


class Stripe:
    """One side of a pair of stripes, in the order of ``by``."""

    def __init__(self, t: pa.Table, dims: int, *by: str):
        ids, codes = t["vec_id"].to_numpy(), t["code"].to_numpy()
        order = np.lexsort([{"vec_id": ids, "code": codes}[c] for c in reversed(by)])
        self.ids, self.codes, self.order = ids[order], codes[order], order
        self.q = np.frombuffer(b"".join(t["q"].to_pylist()), "<i4").reshape(len(ids), dims)[order].astype(np.int64)


def sifted(x: np.ndarray, y: np.ndarray, least: np.ndarray, most: np.ndarray, k: int, rows: int, hidden: Callable[[int, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, window, row of y, score): the k greatest products of each row of x within each of its windows (least, most), earlier rows of y first among equals.

    ``hidden(at, to)`` tells which products with y's rows from at to before ``to`` don't count. A window's k-th score is its floor for
    the rows that follow; blocks grow from a few rows up to ``rows``, so that a floor is known before most rows are met.
    """
    n, width = least.shape
    floor = least - 1
    score_of, row_of = np.full((n, width, k), LOWEST), np.full((n, width, k), -1)
    at, size = 0, min(32, rows)
    while at < len(y):
        to = min(len(y), at + size)
        tile = product(x, y[at:to], n, to - at)
        tile[hidden(at, to)] = LOWEST
        for w in range(width):
            r, c = np.nonzero((tile > floor[:, w, None]) & (tile <= most[:, w, None]))
            if not r.size:
                continue
            met = np.unique(r)
            i, j = np.nonzero(row_of[met, w] >= 0)
            r, c, s = np.r_[met[i], r], np.r_[row_of[met[i], w, j], c + at], np.r_[score_of[met[i], w, j], tile[r, c]]
            order = np.lexsort((c, -s, r))
            r, c, s = r[order], c[order], s[order]
            place = np.arange(r.size) - np.searchsorted(r, r)
            fine = place < k
            score_of[r[fine], w, place[fine]], row_of[r[fine], w, place[fine]] = s[fine], c[fine]
            floor[:, w] = np.maximum(floor[:, w], score_of[:, w, k - 1])
        at, size = to, min(2 * size, rows)
    r, w, j = np.nonzero(row_of >= 0)
    return r, w, row_of[r, w, j], score_of[r, w, j]


def best_of_label(k: int, dims: int, anchors: int, rows: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best rows of an anchor's label, other than itself."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, out = Stripe(left, dims, "code", "vec_id"), Stripe(right, dims, "code", "vec_id"), [np.zeros((3, 0), np.int64)]
        for code in np.intersect1d(a.codes, b.codes):
            first, last = np.searchsorted(b.codes, code), np.searchsorted(b.codes, code, "right")
            ids, y, end = b.ids[first:last], b.q[first:last], int(np.searchsorted(a.codes, code, "right"))
            for i in range(int(np.searchsorted(a.codes, code)), end, anchors):
                own = a.ids[i : min(end, i + anchors)]
                every = np.full((own.size, 1), LOWEST + 1)
                r, _, c, s = sifted(a.q[i : i + own.size], y, every, -every, k, rows, lambda at, to, own=own, ids=ids: own[:, None] == ids[at:to])
                out.append(np.stack([own[r], ids[c], s]))
        return pa.table(list(np.concatenate(out, 1)), names=["anchor_id", "other_id", "score"])

    return run


def best_in_windows(k: int, low: int, high: int, dims: int, anchors: int, rows: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best rows of other labels in each window of an anchor."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, out = Stripe(left, dims, "vec_id"), Stripe(right, dims, "vec_id"), [np.zeros((5, 0), np.int64)]
        windows = left["windows"].take(pa.array(a.order)).to_pylist()
        for i in range(0, a.ids.size if b.ids.size else 0, anchors):
            own, codes, mine = a.ids[i : i + anchors], a.codes[i : i + anchors], windows[i : i + anchors]
            width = max(map(len, mine))
            least, most = np.zeros((own.size, width), np.int64), np.full((own.size, width), LOWEST)  # nothing is in it
            for r, ws in enumerate(mine):
                for w, x in enumerate(ws):  # in Python's integers: no overflow
                    least[r, w] = min(max(-(-low * x["score"] // 100), LOWEST + 1), -LOWEST)
                    most[r, w] = min(max(high * x["score"] // 100, LOWEST), -LOWEST)
            r, w, c, s = sifted(a.q[i : i + anchors], b.q, least, most, k, rows, lambda at, to, codes=codes: codes[:, None] == b.codes[at:to])
            positive = [mine[p][q] for p, q in zip(r.tolist(), w.tolist(), strict=True)]
            out.append(np.stack([own[r], np.array([x["other_id"] for x in positive], np.int64), np.array([x["score"] for x in positive], np.int64), b.ids[c], s]))
        return pa.table(list(np.concatenate(out, 1)), names=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def mine(vectors: DataFrame, anchor: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): per anchor (rows whose vec_id fits ``anchor``, over vec_id) and
    positive the first negatives with low * positive_score <= 100 * negative_score <= high * positive_score."""
    spark = vectors.sparkSession
    ship(spark)
    v = stored(taking_part(vectors, id_col, label, vector_col))
    n, n_anchors, dims = v.agg(F.count("*"), F.count(F.when(anchor, 1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    if not n_anchors:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    first = v.groupBy("label").agg(F.min("vec_id").alias("code")).withColumnRenamed("label", "l")  # a label's number: its least id, a row a label
    v = stored(quantised(join_checked(v, first, [("label", "l")], F.col("vec_id")), dims, scale))
    wide = 4 * max(dims, 1)
    n_i = -(-n_anchors * wide // ANCHOR_BYTES)
    n_j = max(-(-n * wide // ROW_BYTES), min(2 * spark.sparkContext.defaultParallelism, -(-n // ROWS)))  # small tables go over all cores too

    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    anchors = lambda df: df.select("*", own(n_i).alias("i"), all_of(n_j).alias("j")).groupBy("i", "j")
    rows = v.select("*", own(n_j).alias("j"), all_of(n_i).alias("i")).groupBy("i", "j")
    of_anchors = v.filter(anchor)
    found = anchors(of_anchors).cogroup(rows).applyInArrow(best_of_label(positives, dims, ANCHORS, ROWS), "anchor_id bigint, other_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id"))
    positive = found.withColumn("r", place).filter(F.col("r") <= positives)
    windows = positive.groupBy("anchor_id").agg(F.collect_list(F.struct("other_id", "score")).alias("windows"))  # ``positives`` at most
    with_windows = stored(of_anchors.join(windows, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id"))
    found = anchors(with_windows).cogroup(rows).applyInArrow(best_in_windows(negatives, low, high, dims, ANCHORS, ROWS), "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    place = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")).alias("rank")
    return found.select("anchor_id", "positive_id", place, "negative_id", "positive_score", "negative_score").filter(F.col("rank") <= negatives)
