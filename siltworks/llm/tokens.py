"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch are held as one ragged numpy array of symbol ids. In each round every sequence finds the lowest
rank among its adjacent pairs and merges all occurrences of that pair at once (from the left, where they overlap);
sequences without a pair that merges are done, and their surviving symbols are counted. Ranks are looked up in the
sorted array of pair keys. Counts of pre-tokens already seen are kept per task, up to KEPT of them.

Defined results: null or empty text counts 0 tokens; special strings inside a text count as the one token that the
tokenizer's library makes of them; texts of any length are counted whole, in pieces of bounded memory; a vocabulary file
with another split, a normaliser or further rules is refused, not miscounted.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import ship

#: The byte-level pre-token pattern, with white space spelt out as Unicode's White_Space. Fixed values.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\sWS\p{L}\p{N}]+|[\sWS]+(?![^\sWS])|[\sWS]+".replace(r"\sWS", r"\t-\r \x85\xa0  -     　")
KEPT, BATCH_CHARS, BATCH_BYTES, SLICE = 600_000, 2_000_000, 1 << 20, 1_000_000


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, by the public rule: visible Latin-1 stands for itself, the rest counts up from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


def unsupported(spec: dict) -> str:
    """What in a tokenizer's file would be counted otherwise than its library does; empty if nothing."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    wanted = {
        "normalizer": spec.get("normalizer") is None, "model.type": model.get("type", "BPE") == "BPE",
        "pre_tokenizer": pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True),
        **{f"model.{k}": not model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")},
        "added_tokens": not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")),
    }
    return ", ".join(k for k, fits in wanted.items() if not fits)


class RankMerger:
    """Vocabulary as arrays: ids of single bytes, sorted pair keys, their ranks and merged ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if wrong := unsupported(spec):
            raise ValueError(f"not a plain byte-level BPE file: {wrong}")
        model, chars = spec["model"], byte_symbols()
        vocab = model["vocab"]
        self.n = max(vocab.values()) + 1
        self.bytes = np.zeros(256, np.int64)
        for c, b in chars.items():
            self.bytes[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], np.int64)
        keys, first = np.unique(keys, return_index=True)
        self.keys, self.ranks = keys, first.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[first]
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        self.special.sort(key=len, reverse=True)

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token."""
        out = np.zeros(len(tokens), np.int64)
        lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
        seq = np.repeat(np.arange(len(tokens)), lens)
        ids = self.bytes[np.frombuffer(b"".join(tokens), np.uint8)]
        none = np.iinfo(np.int32).max
        rank, at = np.full(ids.size, none, np.int32), np.zeros(ids.size, np.int64)
        new = np.flatnonzero(seq[1:] == seq[:-1])  # first symbols of pairs to look up
        while ids.size:
            key = ids[new] * self.n + ids[new + 1]
            pos = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
            rank[new], at[new] = np.where(self.keys[pos] == key, self.ranks[pos], none), pos
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            least = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, ids.size])
            done = least == none
            out[seq[first[done]]] = size[done]
            take = np.flatnonzero((rank == np.repeat(least, size)) & (rank != none))
            gap = np.diff(take, prepend=-2) != 1  # a pair of equal symbols overlaps itself: every other one
            if not gap.all():
                run = np.maximum.accumulate(np.where(gap, np.arange(take.size), 0))
                take = take[(np.arange(take.size) - run) % 2 == 0]
            ids[take] = self.merged[at[take]]
            rank[take] = none
            keep = np.repeat(~done, size)
            keep[take + 1] = False
            rank[take[take > 0] - 1] = none  # looked up again where they stay in one sequence
            dirty = np.zeros(ids.size, bool)
            dirty[take] = True
            dirty[take[take > 0] - 1] = True
            ids, seq, rank, at, dirty = ids[keep], seq[keep], rank[keep], at[keep], dirty[keep]
            new = np.flatnonzero(dirty[:-1] & (seq[1:] == seq[:-1]))
        return out


#: The same split for texts of which every character means the same to both pattern engines; frequent cases first, as no two alternatives begin alike.
QUICK = r" ?[^\W\d_]+| ?(?:[^\w\sWS]|_)+| ?\d+|[\sWS]+(?![^\sWS])|[\sWS]+".replace(r"\sWS", r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000")


@cache
def unlike() -> re.Pattern:
    """Characters that the quick split would class otherwise, all beyond the basic plane (one range is quick to test), and the apostrophe of contractions."""
    words = regex.compile(r"\p{L}")
    digits = regex.compile(r"\p{N}")
    odd, every = [], [chr(c) for c in range(0x10000)]
    for c in every:
        quick = "L" if c.isalnum() and not c.isdecimal() else "N" if c.isdecimal() else ""
        if quick != ("L" if words.match(c) else "N" if digits.match(c) else ""):
            odd.append(ord(c))
    runs, start = [], None
    for i, c in enumerate(odd):
        start = c if start is None else start
        if i + 1 == len(odd) or odd[i + 1] != c + 1:
            runs.append(f"\\U{start:08x}-\\U{c:08x}")
            start = None
    return re.compile("['" + "".join(runs) + "\U00010000-\U0010ffff]")


class Counter:
    """Counts texts with one merger; keeps the counts of pre-tokens."""

    def __init__(self, merger: RankMerger):
        self.merger, self.known = merger, {}
        self.find, self.quick, self.odd = regex.compile(PATTERN), re.compile(QUICK), unlike()
        self.split = regex.compile("|".join(map(regex.escape, merger.special))) if merger.special else None

    def learn(self, tokens: set[str]) -> None:
        """Counts what is new, in parts of bounded size; what is not of use now goes when there is too much."""
        new, i = list(tokens.difference(self.known)), 0
        if len(self.known) + len(new) > KEPT:
            self.known = {p: self.known[p] for p in tokens.intersection(self.known)}
        while i < len(new):
            part, size = [], 0
            while i < len(new) and (not part or size + len(new[i]) <= BATCH_BYTES // 4):
                part.append(new[i])
                size += len(new[i])
                i += 1
            self.known.update(zip(part, self.merger.counts([t.encode("utf-8", "surrogatepass") for t in part]).tolist(), strict=True))

    def texts(self, texts: list[str | None]) -> list[int]:
        out = [0] * len(texts)
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            self.learn(set(chain.from_iterable(x for _, x in held)))
            for i, x in held:
                out[i] += sum(map(self.known.__getitem__, x))
            held.clear()
            size = 0

        for i, t in enumerate(texts):
            parts = self.split.split(t) if t and self.split else [t]
            out[i] += len(parts) - 1
            for p in filter(None, parts):
                rule = self.quick if not self.odd.search(p) else self.find
                if len(p) <= SLICE:
                    held.append((i, rule.findall(p)))
                    size += len(p)
                else:  # a slice of pre-tokens at a time
                    flush()
                    found = (m.group() for m in rule.finditer(p))
                    while part := list(islice(found, SLICE)):
                        held.append((i, part))
                        flush()
                if size > BATCH_CHARS:
                    flush()
        flush()
        return out


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; the vocabulary's arrays, of a fixed size, go to the workers."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(RankMerger(path))
    state: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = state.get("counter") or state.setdefault("counter", Counter(shared.value))
        for b in batches:
            n = counter.texts(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
