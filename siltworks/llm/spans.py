"""Substring dedup by sliding sentence spans.

A text is a row of units: sentences, cut before each word that has the least hash (the first of equals) in some window of
CUT_WINDOW words of its sentence, so that a passage is cut alike wherever in a sentence it starts. Two runs belong to every unit,
the shortest of at least RUN_UNITS units and RUN_WORDS words that starts there and the shortest that ends there; their hashes
join globally with all others. Together they cover every unit of every repeated run of any length: what no run from a unit on
reaches, the run up to the passage's last unit holds. A passage of 48
words or more holds a whole run: both its first and its last CUT_WINDOW words hold a cut or a sentence's start, all cuts
between them agree, and a run takes at most 36 words from its first. Of runs with equal hashes the first by (doc_id, place)
stays; units covered by any other are removed. Hashes are aggregated before they are joined, the least (doc_id, place) per
hash, so a passage in a third of all documents is no hot group; what remains is joined by equi-joins that adaptive execution
may split.

Comparison ignores ASCII case and the white space between words. Run hashes have 64 bits.

Defined results: null, blank or short texts have no runs and stay as they are; a null doc_id comes first of all; a
document is an id and a text (told apart by a 32-bit hash within the id), so rows that repeat both are not repeated by
themselves and rows of one id with different texts lose only what each repeats; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import ship, stored
from .neardup import mixed

CUT_WINDOW, RUN_UNITS, RUN_WORDS = 12, 3, 24
#: Bytes of text whose words are hashed at once.
HASHED = 1 << 20
U = np.uint64
_C = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_C), -1, 1 << 64))
#: By byte: white space, sentence ends, and a number that ignores ASCII case.
BLANK, STOP = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b" \t\n\v\f\r", b".!?"))
NUMBER = mixed(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(U) + U(1))


class Words:
    """The words of a row of texts, ``data`` in bytes of ``lens``: start, end, hash, text, and the words of each sentence.

    A sentence ends after full stops, exclamation and question marks and at a line's end; a word ends at white space and
    where its sentence does. A word's hash is a polynomial in its bytes, from prefix sums that are scaled back.
    """

    def __init__(self, data: np.ndarray, lens: np.ndarray):
        first = np.zeros(data.size + 1, bool)
        first[np.cumsum(lens) - lens] = True
        first = first[:-1]
        blank, stop = BLANK[data], STOP[data]
        last = lambda x: np.r_[False, x[:-1]] if x.size else x
        sentence = first | last(data == 10) | (last(stop) & ~stop)
        begins = ~blank & (first | last(blank) | sentence)
        self.start = np.flatnonzero(begins)
        edges = np.r_[np.flatnonzero(blank | begins | first), data.size]
        self.end = edges[np.searchsorted(edges, self.start, "right")]
        self.text = np.searchsorted(np.cumsum(lens), self.start, "right")
        of = np.cumsum(sentence)[self.start]
        self.sentences = np.diff(np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), of.size]) if of.size else np.zeros(0, np.int64)
        self.hash, i = np.zeros(self.start.size, U), 0
        while i < self.start.size:  # whole words, HASHED bytes or one word at a time
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + HASHED, "right")))
            a, z = self.start[i:j] - self.start[i], self.end[i:j] - self.start[i]
            x = NUMBER[data[self.start[i] : self.end[j - 1]]]
            sums = np.r_[U(0), np.cumsum(x * np.cumprod(np.full(x.size, _C)))]
            self.hash[i:j] = mixed((sums[z] - sums[a]) * np.cumprod(np.full(x.size, _INVERSE))[a] + (z - a).astype(U))
            i = j


def cut(h: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places in a row of word hashes where units start; ``lens``: words of each sentence, none of them 0."""
    start = np.zeros(h.size, bool)
    start[np.cumsum(lens) - lens] = True
    at = np.arange(max(h.size - CUT_WINDOW + 1, 0))
    at = at[at + CUT_WINDOW <= np.repeat(np.cumsum(lens), lens)[: at.size]]  # windows within one sentence
    best, least = at.copy(), h[at]
    for j in range(1, CUT_WINDOW):
        less = h[at + j] < least
        best[less], least = (at + j)[less], np.minimum(least, h[at + j])
    start[best] = True
    return np.flatnonzero(start)


class Units:
    """The units of all texts of a column: start and end in bytes of their texts, words, hash, text; and the texts' bytes."""

    def __init__(self, texts: pa.Array):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        data = texts.buffers()[2] if len(texts) else None
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.at = offsets - offsets[0]
        w = Words(self.data, np.diff(self.at))
        first = cut(w.hash, w.sentences)
        last = np.r_[first[1:], w.hash.size][: first.size] - 1
        self.words, self.text = last - first + 1, w.text[first]
        self.start, self.end = w.start[first] - self.at[self.text], w.end[last] - self.at[self.text]
        place = np.arange(w.hash.size) - np.repeat(first, self.words)
        self.hash = mixed(np.add.reduceat(mixed(w.hash * _C + place.astype(U) + U(1)), first)) if first.size else np.zeros(0, U)

    def of(self, i: int) -> slice:
        return slice(*np.searchsorted(self.text, [i, i + 1]))


def units(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, words) of each unit of a text, in code points."""
    u = Units(pa.array([text], pa.string()))
    point = np.r_[0, np.cumsum((u.data & 0xC0) != 0x80)]
    return list(zip(point[u.start].tolist(), point[u.end].tolist(), u.words.tolist(), strict=True))


def runs(hashes: np.ndarray, words: np.ndarray, doc: np.ndarray, least_units: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, units, hash) of the shortest run from each unit and of the shortest up to each unit, where there is one; ``doc`` tells texts apart."""
    at, sums = np.arange(hashes.size), np.r_[0, np.cumsum(words)]
    bounds = np.r_[np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]), hashes.size] if hashes.size else np.zeros(1, np.int64)
    of = np.searchsorted(bounds, at, "right")
    after = np.maximum(at + least_units, np.searchsorted(sums, sums[:-1] + least_words))
    fits = after <= bounds[of] if hashes.size else np.zeros(0, bool)
    first = np.minimum(at + 1 - least_units, np.searchsorted(sums, sums[1:] - least_words, "right") - 1)
    begun = first >= bounds[of - 1] if hashes.size else np.zeros(0, bool)
    both = np.unique(np.stack([np.r_[at[fits], first[begun]], np.r_[after[fits], at[begun] + 1]], 1), axis=0)
    start, size = both[:, 0], both[:, 1] - both[:, 0]
    acc, order = np.zeros(start.size, U), np.argsort(-size, kind="stable")
    for k, n in enumerate(np.searchsorted(-size[order], -np.arange(1, size.max(initial=0) + 1), "right").tolist()):  # runs of more than k units
        now = order[:n]
        acc[now] = mixed(acc[now] * _C + hashes[start[now] + k] + U(1))
    return start, size, acc


def run_rows(docs: DataFrame) -> DataFrame:
    """(h, doc_id, p, k): a row for every run of (doc_id, x, text); p is x * 2 ** 32 + unit."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x, u = b.column("doc_id"), b.column("x").to_numpy().astype(np.int64), Units(b.column("text"))
            at, k, h = runs(u.hash, u.words, u.text, RUN_UNITS, RUN_WORDS)
            if at.size:
                of = u.text[at]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), ids.take(pa.array(of)), pa.array((x[of] << 32) + at - np.searchsorted(u.text, of)), pa.array(k.astype(np.int32))], names=["h", "doc_id", "p", "k"])

    return docs.mapInArrow(run, f"h bigint, doc_id {kind}, p bigint, k int")


def told_apart(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.hash(text_col).alias("x"), F.col(text_col).alias("text"))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, x, spans): for documents (doc_id, x, text) with a repeated run that isn't the first; spans: sorted (i, k, first_id), units i to i + k."""
    ship(docs.sparkSession)
    rows = stored(run_rows(docs))
    first = rows.groupBy("h").agg(F.min(F.struct("doc_id", "p")).alias("f"), F.max(F.struct("doc_id", "p")).alias("l")).filter(~F.col("f").eqNullSafe(F.col("l"))).select("h", "f")
    first = stored(first)  # so that the join on a hot passage's hash can be split
    late = rows.join(first, "h").filter(~F.struct("doc_id", "p").eqNullSafe(F.col("f")))
    late = late.select("doc_id", F.shiftright("p", 32).cast("int").alias("x"), F.col("p").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("i"), "k", F.col("f.doc_id").alias("first_id"))
    return stored(late.groupBy("doc_id", "x").agg(F.array_sort(F.collect_set(F.struct("i", "k", "first_id"))).alias("spans")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of documents that lose units: doc_id, n_units, n_removed, removed_words, first_ids (sorted), text (what stays)."""
    own = told_apart(docs, id_col, text_col)
    r = repeats(own).withColumnsRenamed({"doc_id": "r_id", "x": "r_x"})
    both = own.join(r, own["doc_id"].eqNullSafe(r["r_id"]) & (own["x"] == r["r_x"])).select("doc_id", "text", "spans")
    kind = own.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            u = Units(b.column("text"))
            for i, spans in enumerate(b.column("spans").to_pylist()):
                own, t = u.of(i), u.data[u.at[i] : u.at[i + 1]]
                start, words = u.start[own], u.words[own]
                gone = np.zeros(start.size, bool)
                for s in spans:
                    gone[s["i"] : s["i"] + s["k"]] = True
                change = np.flatnonzero(np.diff(np.r_[False, gone, False]))  # first unit of each removed stretch, and the next that stays
                bounds = np.r_[start, t.size][change]
                kept = b"".join(t[x:y].tobytes() for x, y in np.r_[0, bounds, t.size].reshape(-1, 2))
                for c, v in zip(cols, (start.size, int(gone.sum()), int(words[gone].sum()), sorted({s["first_id"] for s in spans if s["first_id"] is not None}), kept.decode("utf-8", "surrogatepass")), strict=True):
                    c.append(v)
            ids = b.column("doc_id")
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.list_(ids.type)), pa.array(cols[4], pa.string())], names=["doc_id", "n_units", "n_removed", "removed_words", "first_ids", "text"])

    return both.mapInArrow(run, f"doc_id {kind}, n_units bigint, n_removed bigint, removed_words bigint, first_ids array<{kind}>, text string")
