"""Where many strings stand in many texts: one automaton over all of them, not a pattern or a pass each.

Needles make Aho-Corasick automata over their UTF-8 bytes, as flat tables (state, byte class) -> state, each of at most CELLS cells; a larger set
of needles makes several, and GROUP of them go to the workers at a time. Texts of a batch are cut into pieces that overlap
by the longest needle, and numpy steps through thousands of pieces at once; places where a state ends a needle are gathered, and
its shorter needles follow by links. Work per byte of text is one look-up an automaton, however many the needles.
The needles pass through the driver, so their count and bytes are checked (MOST_BYTES).

Defined results: all occurrences, overlapping and nested ones too; null or empty needles and null texts match nothing; needles of one
text each get their rows, repeated documents theirs. Comparison is exact; fold case before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import query
from ..plans.shared import join_checked, ship, spread, stored

#: Cells of a table, tables on the workers at once, bytes of all needles, pieces in step, bytes of a piece at least.
CELLS, GROUP, MOST_BYTES, LANES, PIECE = 4_000_000, 8, 64 << 20, 1 << 14, 1024


class Automaton:
    """Of distinct needles, numbered from ``first``."""

    def __init__(self, needles: list[bytes], first: int):
        used = sorted(set(b"".join(needles)))
        self.classes = np.zeros(256, np.int32)
        self.classes[used] = np.arange(1, len(used) + 1)
        self.width, self.longest = len(used) + 1, max(map(len, needles))
        edges: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for i, n in enumerate(needles):
            s = 0
            for b in n:
                c = int(self.classes[b])
                if c not in edges[s]:
                    edges[s][c] = len(edges)
                    edges.append({})
                s = edges[s][c]
            ends[s] = first + i
        self.go = np.zeros((len(edges), self.width), np.int32)
        self.needle, self.less = np.full(len(edges), -1, np.int64), np.zeros(len(edges), np.int32)
        for s, i in ends.items():
            self.needle[s] = i
        fail, row = np.zeros(len(edges), np.int32), [0]
        for s in row:  # by depth: a state's fall-back is shorter, so its row is done
            if s:
                self.go[s] = self.go[fail[s]]
                f = int(fail[s])
                self.less[s] = f if self.needle[f] >= 0 else self.less[f]
            for c, to in edges[s].items():
                fail[to] = self.go[s, c] if s else 0
                self.go[s, c] = to
                row.append(to)
        self.ends = (self.needle >= 0) | (self.less > 0)

    def places(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, needle, byte after its end) of all occurrences in the texts that start at ``first``."""
        piece = max(PIECE, 4 * self.longest)
        n = -(-size // piece)
        of = np.repeat(np.arange(size.size), n)
        own = (np.arange(of.size) - np.repeat(np.cumsum(n) - n, n)) * piece
        start = np.maximum(own - self.longest + 1, 0)
        left = np.minimum(own + piece, size[of]) - start
        order = np.argsort(-left, kind="stable")
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(0, of.size, LANES):
            lane = order[i : i + LANES]
            at, long = first[of[lane]] + start[lane], left[lane]
            state = np.zeros(lane.size, np.int32)
            for k, m in enumerate(np.searchsorted(-long, -np.arange(int(long[0])), "left").tolist()):
                state[:m] = self.go[state[:m], self.classes[data[at[:m] + k]]]
                hit = np.flatnonzero(self.ends[state[:m]])
                hit = hit[start[lane[hit]] + k >= own[lane[hit]]]  # what ends before is the piece's before
                if hit.size:
                    hits.append((of[lane[hit]], state[hit].copy(), start[lane[hit]] + k + 1))
        if not hits:
            return (np.zeros(0, np.int64),) * 3
        text, state, end = (np.concatenate(x) for x in zip(*hits, strict=True))
        out = []
        while state.size:
            full = self.needle[state] >= 0
            out.append((text[full], self.needle[state[full]], end[full]))
            state = self.less[state]
            text, state, end = text[state > 0], state[state > 0], end[state > 0]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def automata(needles: list[bytes]) -> list[Automaton]:
    """In blocks whose tables have at most CELLS cells, or one needle."""
    out, part, size = [], [], 0
    width = len(set(b"".join(needles))) + 1
    for i, n in enumerate(needles):
        if part and (size + len(n) + 1) * width > CELLS:
            out.append(Automaton(part, i - len(part)))
            part, size = [], 0
        part.append(n)
        size += len(n)
    return [*out, Automaton(part, len(needles) - len(part))] if part else out


def places(docs: DataFrame, needles: DataFrame, doc_col: str = "doc_id", text_col: str = "text", id_col: str = "needle_id", needle_col: str = "needle") -> DataFrame:
    """(doc_id, needle_id, place): a row an occurrence, place in characters from 0."""
    spark = docs.sparkSession
    ship(spark)
    n = stored(needles.select(F.col(id_col).alias("needle_id"), F.col(needle_col).alias("needle")).filter("needle <> ''"))
    if (n.agg(F.sum(F.octet_length("needle"))).first()[0] or 0) > MOST_BYTES:
        raise ValueError("needles for a join of their own, not for automata")
    every = sorted(r[0] for r in n.select("needle").distinct().collect())
    sizes = np.array([len(x) for x in every], np.int64)
    built, rows = automata([x.encode() for x in every]), docs.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema, out = f"doc_id {kind}, k bigint, place bigint", None
    for i in range(0, len(built), GROUP):
        shared = spark.sparkContext.broadcast((built[i : i + GROUP], sizes))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tables, long = shared.value
            for b in batches:
                texts = [t.encode() for t in b.column("text").to_pylist()]
                size = np.fromiter(map(len, texts), np.int64, len(texts))
                first, data = np.cumsum(size) - size, np.frombuffer(b"".join(texts), np.uint8)
                before = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]  # characters before each byte
                for a in tables:
                    of, k, end = a.places(data, first, size)
                    if of.size:
                        at = before[first[of] + end] - before[first[of]] - long[k]
                        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(of)), pa.array(k), pa.array(at)], names=["doc_id", "k", "place"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    numbers = spark.createDataFrame(pa.table({"k": pa.array(range(len(every)), pa.int64()), "said": pa.array(every, pa.string())}))
    ids = join_checked(n, numbers, [("needle", "said")], F.xxhash64("needle_id")).select("k", "needle_id")  # small tables both
    return out.join(ids, "k").select("doc_id", "needle_id", "place")


_PARTS = "[text, array_to_string(string_split(text, ' ')[1:2], ' '), array_to_string(string_split(text, ' ')[3:7], ' '), string_split(text, ' ')[4]]"


@query("needle_places", f"WITH n AS (SELECT 4 * item_id + i AS needle_id, p AS needle FROM (SELECT item_id, unnest(range(4)) AS i, unnest({_PARTS}) AS p FROM benchmark) WHERE p <> '') SELECT doc_id, needle_id, (instr(text, needle) - 1)::BIGINT AS first_place FROM documents JOIN n ON contains(text, needle)")
def _needles(t):
    """Whole benchmark items, phrases and single words of theirs, each in all documents: the first place."""
    w = F.split("text", " ")
    parts = F.array("text", F.array_join(F.slice(w, 1, 2), " "), F.array_join(F.slice(w, 3, 5), " "), F.get(w, F.lit(3)))
    n = t("benchmark").select("item_id", F.posexplode(parts).alias("i", "needle")).select((F.col("item_id") * 4 + F.col("i")).alias("needle_id"), "needle")
    found = places(spread(t("documents").select("doc_id", "text")), n)
    return found.groupBy("doc_id", "needle_id").agg(F.min("place").alias("first_place"))
