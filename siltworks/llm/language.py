"""Language ID by cross-parsing entropy.

Each language has a suffix automaton of labelled text. A text is parsed into the longest phrases that occur in the
language's text (a phrase ends where its longest match does). A longer sample has longer matches by chance, so a phrase counts
the logarithm of its language's sample length, which makes phrases per character a cross entropy; the least wins. States with one edge, which are most, hold it as such; others have a row of all characters, or, where scripts make
these rows more than CELLS, the edges of all automata stand in one hash table (state, character) -> state, so the model
grows with the sample and not with the number of scripts. Numpy parses thousands of pieces of texts in step, PIECE characters each, so that a
piece's end adds at most one phrase; whole texts count.

Fit: per language a bounded sample of SAMPLE_CHARS characters, for many languages TOTAL_CHARS over all, but MIN_CHARS each
at least; up to MOST_LABELS labels, more are refused, as they are no languages; texts are taken whole or cut to DOC_CHARS from the labelled documents that come first by a hash of their id. Every
labelled language is learned, and every letter of its sample.

Defined results: `und` with score 0 for a null text or one without a letter; a text of characters that no language knows
goes to the first of equals with score 0, as do other ties; with one language learned, its score is 1; with none, `und`.
Null doc_ids are never learned from; repeated rows give equal results; empty tables give empty results; columns of any
name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import ship
from .words import free

SAMPLE_CHARS, TOTAL_CHARS, MIN_CHARS, DOC_CHARS, SAMPLE_DOCS, MOST_LABELS = 40_000, 2_000_000, 2_000, 2_000, 200, 2_000
#: Characters of a piece; (piece, language) pairs parsed in step; characters of texts held at once.
PIECE, LANES, BATCH = 512, 1 << 15, 1_000_000
#: Cells of four bytes that rows may have.
CELLS = 8_000_000
#: Character classes besides the letters of the sample: what is no letter, a letter that no sample has.
GAP, OTHER = 0, 1
UND = "und"
U = np.uint64


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def automaton(classes: list[int]) -> list[dict[int, int]]:
    """Suffix automaton of a sequence: each state's edges, class to state; state 0 is the root."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in classes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return nxt


class Edges:
    """Hash table from int64 keys to int32 values; keys whose place is taken stand in a next table, the emptier the fewer they are."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.uint64]] = []
        while keys.size:
            bits = max(4, int(2 * 4 ** len(self.levels) * keys.size - 1).bit_length())
            shift = U(64 - bits)
            slot, own = np.unique((keys.view(U) * self.multiplier(len(self.levels))) >> shift, return_index=True)
            k, v = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
            k[slot], v[slot] = keys[own], values[own]
            self.levels.append((k, v, shift))
            rest = np.ones(keys.size, bool)
            rest[own] = False
            keys, values = keys[rest], values[rest]

    @staticmethod
    def multiplier(level: int) -> np.uint64:
        return U(0x9E3779B97F4A7C15 * (2 * level + 1) % (1 << 64))

    def into(self, out: np.ndarray, keys: np.ndarray) -> None:
        """Puts the values of the keys that are there into ``out``."""
        at = None
        for level, (k, v, shift) in enumerate(self.levels):
            slot = ((keys.view(U) * self.multiplier(level)) >> shift).astype(np.int64)
            found = k[slot]
            hit = found == keys
            where = np.flatnonzero(hit)
            out[where if at is None else at[where]] = v[slot[where]]
            more = np.flatnonzero(~hit & (found >= 0))
            if not more.size:
                return
            keys, at = keys[more], more if at is None else at[more]


class Model:
    """Automata of all languages, and the class of every character."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        known = sorted({c for t in samples.values() for c in t.lower() if c.isalpha()})
        self.classes = np.where(letters(), OTHER, GAP).astype(np.int32)
        for i, c in enumerate(known):
            for form in {c, c.upper()}:
                if len(form) == 1:
                    self.classes[ord(form)] = OTHER + 1 + i
        self.width = OTHER + 1 + len(known)
        self.roots = np.zeros(len(self.langs), np.int32)
        self.first = np.zeros((len(self.langs), self.width), np.int32)  # from the roots; entries are next state * 4 + phrases ended by the step
        self.price = np.ones(len(self.langs))  # of a phrase, 1 for a sample of SAMPLE_CHARS
        states, classes, targets, n = [], [], [], 0
        for j, x in enumerate(self.langs):
            own = self.encode([samples[x]])[0].tolist()
            self.price[j] = np.log(len(own) + 1) / np.log(SAMPLE_CHARS)
            nxt = automaton(own)
            self.roots[j] = n
            self.first[j] = n * 4 + 1  # an unknown character is a phrase of its own
            for c, to in nxt[0].items():
                self.first[j, c] = (n + to) * 4
            states.append(np.fromiter((n + s for s, row in enumerate(nxt) if s for _ in row), np.int64))
            classes.append(np.fromiter((c for row in nxt[1:] for c in row), np.int32))
            targets.append(np.fromiter(((n + to) * 4 for row in nxt[1:] for to in row.values()), np.int32))
            n += len(nxt)
        self.edges, self.rows = None, None
        if self.langs:
            self.lay_out(np.concatenate(states), np.concatenate(classes), np.concatenate(targets), n)

    def lay_out(self, states: np.ndarray, classes: np.ndarray, targets: np.ndarray, n: int) -> None:
        """Edges of states other than roots: rows of all classes for states with several, if these are few cells, else a hash table."""
        several = np.bincount(states, minlength=n) > 1
        if (several.sum() + 2 * len(self.langs)) * self.width > CELLS:
            self.edges = Edges(states * self.width + classes, targets)
            return
        lang = np.searchsorted(self.roots, np.arange(n), "right") - 1
        self.row = lang.astype(np.int32)  # the row of a language where the phrase so far ends and the next one starts
        self.row[self.roots] += len(self.langs)
        self.row[several] = 2 * len(self.langs) + np.arange(several.sum())
        self.rows = np.concatenate([self.first + 1, self.first, self.first[lang[several]] + 1])
        many = several[states]
        self.rows[self.row[states[many]], classes[many]] = targets[many]
        self.only, self.only_to = np.full(n, -1, np.int32), np.zeros(n, np.int32)  # the edge of states that have one
        self.only[states[~many]], self.only_to[states[~many]] = classes[~many], targets[~many]

    def step(self, own: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Next states * 4 + phrases ended, of states (pieces x languages) on reading a class a piece."""
        if self.edges is None:
            to = self.rows.ravel()[self.row[own] * self.width + x].ravel()
            at = np.flatnonzero((self.only[own] == x).ravel())
            to[at] = self.only_to[own.ravel()[at]]
        else:
            to = (self.first.ravel()[x + np.arange(len(self.langs)) * self.width] + (own != self.roots)).ravel()
            self.edges.into(to, (own.astype(np.int64) * self.width + x).ravel())
        return to.reshape(own.shape)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes of all texts in a row, each between gaps, runs of non-letters as one; the length and the letters of each text."""
        texts = [f" {t} " for t in texts]
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        c = self.classes[points]
        of = np.repeat(np.arange(len(texts), dtype=np.int32), lens)
        gap = c == GAP
        keep = np.ones(c.size, bool)
        keep[1:] = ~(gap[1:] & gap[:-1]) | (of[1:] != of[:-1])
        c, of = c[keep], of[keep]
        return c, np.bincount(of, minlength=len(texts)), np.bincount(of[c != GAP], minlength=len(texts))

    def phrases(self, c: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """Phrases of each text in each language: texts in pieces of PIECE, the longest pieces first, so that those that end leave the row."""
        pieces = -(-lens // PIECE)
        of = np.repeat(np.arange(lens.size), pieces)
        first = np.repeat(np.cumsum(lens) - lens, pieces) + (np.arange(of.size) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
        left = np.minimum(np.repeat(np.cumsum(lens), pieces) - first, PIECE)
        order = np.argsort(-left, kind="stable")
        of, first, left = of[order], first[order], left[order]
        n_lang = len(self.langs)
        lanes = max(64, LANES // n_lang)
        out = np.zeros((lens.size, n_lang), np.int64)
        for i in range(0, of.size, lanes):
            a, n = first[i : i + lanes], left[i : i + lanes]
            state = np.repeat(self.roots[None, :], n.size, 0)
            count = np.zeros_like(state)
            ends = np.searchsorted(-n, -np.arange(int(n[0])), "left")  # pieces longer than each step
            for step, m in enumerate(ends.tolist()):
                to = self.step(state[:m], c[a[:m] + step][:, None])
                count[:m] += to & 3
                state[:m] = to >> 2
            np.add.at(out, of[i : i + lanes], count + (state != self.roots))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and strangeness: the best language's phrases beyond the first, at their price, per letter."""
        if not self.langs:
            return [UND] * len(texts), [0.0] * len(texts), [1.0] * len(texts)
        c, lens, letters_of = self.encode([t or "" for t in texts])
        p = self.phrases(c, lens) * self.price
        best = p.argmin(1)
        if len(self.langs) > 1:
            low = np.partition(p, 1, axis=1)
            score = 1 - low[:, 0] / np.maximum(low[:, 1], self.price.min())
        else:
            score = np.ones(len(texts))
        some = letters_of > 0
        return [self.langs[b] if s else UND for b, s in zip(best, some, strict=True)], np.where(some, score, 0.0).tolist(), np.where(some, np.maximum(p.min(1) - self.price[best], 0) / np.maximum(letters_of, 1), 1.0).tolist()


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from rows that aren't held out and have an id, a text and a language.

    The count per language reads two narrow columns; its hash threshold then picks about SAMPLE_DOCS documents each.
    """
    spark = docs.sparkSession
    may = docs.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t")).filter(F.col("i").isNotNull() & F.col("l").isNotNull() & ~held_out(F.col("i")))
    draw = F.pmod(F.xxhash64(F.lit("fit"), F.col("i")), F.lit(1 << 30))
    n = {r["l"]: r["n"] for r in may.groupBy("l").agg(F.count("*").alias("n")).limit(MOST_LABELS + 1).collect()}  # a row a language
    if len(n) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    if not n:
        return Model({})
    chars = min(SAMPLE_CHARS, max(MIN_CHARS, TOTAL_CHARS // len(n)))
    most = min(SAMPLE_DOCS, 20 + 4 * chars // DOC_CHARS)
    bounds = spark.createDataFrame([(k, min(1 << 30, 1 + (most << 30) // v)) for k, v in n.items()], f"l {may.schema['l'].dataType.simpleString()}, bound bigint")
    picked = may.withColumn("d", draw).join(F.broadcast(bounds), "l").filter(F.col("d") < F.col("bound"))
    picked = picked.select("l", "d", F.crc32(F.col("t").cast("binary")).alias("x"), F.substring("t", 1, DOC_CHARS).alias("t")).filter(F.col("t").isNotNull())
    picked = picked.groupBy("l", "d").agg(F.min(F.struct("x", "t")).alias("m")).select("l", "d", "m.*")  # rows that repeat an id count once
    samples: dict[str, str] = {}
    for r in sorted(picked.collect(), key=lambda r: (r["l"], r["d"], r["x"])):
        if len(had := samples.get(r["l"], "")) < chars:
            samples[r["l"]] = (had + " " + r["t"])[:chars]
    return Model({k: v for k, v in samples.items() if any(map(str.isalpha, v))})


def tagged(docs: DataFrame, model: Model, into: tuple[str, str, str], text_col: str = "text") -> DataFrame:
    """``docs`` with three columns more: language, score and strangeness (near 1 where no learned language has even pairs of the letters); one narrow pass."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores, odd, part, size = [], [], [], [], 0
            for t in [*b.column(at).to_pylist(), ...]:
                if part and (t is ... or size + len(t or "") > BATCH):
                    x, y, z = shared.value.predict(part)
                    langs += x
                    scores += y
                    odd += z
                    part, size = [], 0
                if t is not ...:
                    part.append(t)
                    size += len(t or "")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(odd, pa.float64())], names=[*b.schema.names, *into])

    schema = docs.select("*", F.lit("").alias(into[0]), F.lit(0.0).alias(into[1]), F.lit(0.0).alias(into[2])).schema
    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    return tagged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, ("lang_pred", "score", "odd")).select("doc_id", "lang_pred", "score")


def identified(docs: DataFrame, model: Model, most_odd: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is of a learned language, that is, not `und` and at most ``most_odd`` strange."""
    lang, score, odd = free(docs.columns, "lid_pred", "lid_score", "lid_odd")
    return tagged(docs, model, (lang, score, odd), text_col).filter((F.col(lang) != UND) & (F.col(odd) <= most_odd)).select(*docs.columns)
