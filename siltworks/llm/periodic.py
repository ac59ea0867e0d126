"""Periodic runs of words by bit-parallel lags.

The words of a text get numbers; plane k is one big integer whose bit i is bit k of the number of word i. For a lag p the
planes are compared with themselves shifted by p places, XOR plane by plane, mismatches gathered by OR; what stays zero over
long stretches are words equal to those p places on. Shift-doubling AND over the complement keeps the places where a stretch
of the needed length starts, and a lag is given up as soon as no place is left, mostly after the first plane. A run of
period p has at least LEAST_REPEATS * p words and LEAST_WORDS, so the stretch has max(LEAST_WORDS - p, (LEAST_REPEATS - 1) * p).

Lags rise, so a stretch that a run of a smaller period holds has that period too and is no run of its own; by the periodicity
lemma that period divides the lag. In texts of over LONG words only lags that can hold a run are tried: such a run covers
a whole block of P words, P the power of two below or at p, whose words stand again p places on, so per P the polynomial
hashes of all P words tell the lags; equal blocks have equal hashes, none is lost.

Defined results: a null or blank text has no words, no run and the digests of the empty string; words are compared
exactly; texts of any length are taken whole; repeated rows give equal results; other columns are not read; an empty
table gives an empty result. Runs may overlap; each is reported, and a word that any run holds beyond its first period goes.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import ship

LEAST_WORDS, LEAST_REPEATS = 24, 3
#: Words from which lags are picked by hashes of blocks.
LONG = 4096
WORD = re.compile(r"[^\x20\x09-\x0D]+")
U = np.uint64
_B = U(0x9E3779B97F4A7C15)


def planes(ids: np.ndarray) -> list[int]:
    """Big integers, bit i of the k-th being bit k of ids[i]."""
    return [int.from_bytes(np.packbits((ids >> k) & 1, bitorder="little").tobytes(), "little") for k in range(int(ids.max()).bit_length())]


def stretches(z: int, n: int) -> list[tuple[int, int]]:
    """(first, after) of each row of ones in the n low bits."""
    bits = np.unpackbits(np.frombuffer(z.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little", count=n)
    edges = np.flatnonzero(np.diff(np.r_[0, bits, 0].astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def lags(ids: np.ndarray) -> Iterator[int]:
    """Lags that can hold a run, rising."""
    n = ids.size
    most = n // LEAST_REPEATS
    if n <= LONG:
        yield from range(1, most + 1)
        return
    power = np.cumprod(np.r_[U(1), np.full(n, _B)])
    sums = np.r_[U(0), np.cumsum((ids.astype(U) + U(1)) * power[:-1])]
    block = 1
    while block <= most:
        if block < 16:
            yield from range(block, min(2 * block - 1, most) + 1)
        else:
            windows = sums[block:] - sums[:-block]  # of the words from i, times power[i]
            found = np.zeros(block, bool)
            for a in range(0, n - 2 * block + 1, block):
                own = windows[a]
                later = windows[a + block : min(a + 2 * block, windows.size)]
                found[: later.size] |= own * power[block : block + later.size] == later
            yield from (block + np.flatnonzero(found[: most - block + 1])).tolist()
        block *= 2


def runs(words: list[str]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period."""
    n = len(words)
    if n < LEAST_WORDS:
        return []
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    rows, by = planes(ids), {}
    for p in lags(ids):
        need = max(LEAST_WORDS - p, (LEAST_REPEATS - 1) * p)
        if need > n - p:
            continue
        mask, bad, places = (1 << (n - p)) - 1, 0, 1
        whole = mask >> (need - 1)
        for plane in rows or [0]:
            bad |= plane ^ (plane >> p)
            places, have = ~bad & mask, 1
            while have < need and places:
                step = min(have, need - have)
                places &= places >> step
                have += step
            if not places:
                break
        if not places:
            continue
        for a, z in stretches(places & whole, n):
            z += need - 1 + p
            if not covered(by, p, a, z):
                by.setdefault(p, ([], []))
                by[p][0].append(a)
                by[p][1].append(z)
    return sorted((a, z - a, p) for p, (starts, ends) in by.items() for a, z in zip(starts, ends, strict=True))


def covered(by: dict[int, tuple[list[int], list[int]]], p: int, a: int, z: int) -> bool:
    """Whether a run of a smaller period that divides p holds all words from a to z."""
    divisors = {d for i in range(1, isqrt(p) + 1) if p % i == 0 for d in (i, p // i)} if len(by) > 64 else by
    for q in divisors:
        if q < p and p % q == 0 and q in by:
            i = bisect_right(by[q][0], a) - 1
            if i >= 0 and by[q][1][i] >= z:
                return True
    return False


def best(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period, exactly; of equals the first, then of the smallest period."""
    top = None
    for r in found:  # by start, then period
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    return top


def kept(words: list[str], found: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run holds beyond its first period."""
    if not found:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for a, n, p in found:
        depth[a + p] += 1
        depth[a + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0).tolist()]


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs, top, text): all runs as structs (start, length, period), the one of the greatest exponent or null, and the words that stay, joined by one space; one narrow pass."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def row(r: tuple[int, int, int] | None) -> dict[str, int] | None:
        return r and dict(zip(("start", "length", "period"), r, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, top, texts = [], [], []
            for t in b.column("text").to_pylist():
                w = WORD.findall(t or "")
                own = runs(w)
                found.append([row(r) for r in own])
                top.append(row(best(own)))
                texts.append(" ".join(kept(w, own)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(run_type)), pa.array(top, run_type), pa.array(texts, pa.string())], names=["doc_id", "runs", "top", "text"])

    struct = "struct<start:bigint,length:bigint,period:bigint>"
    return rows.mapInArrow(run, f"doc_id {kind}, runs array<{struct}>, top {struct}, text string")
