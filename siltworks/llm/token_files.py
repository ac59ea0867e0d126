"""Token ids in seekable files: independent zstandard frames, a trailing seek table, a checksum per frame.

A file is a row of zstandard frames of at most FRAME_IDS ids each (little-endian unsigned 32 bits, no header of our own), so any
zstandard tool unpacks it, and after them the published seek table: a skippable frame with the packed size, the size and
the checksum (low 32 bits of XXH64 of the ids' bytes) of every frame. A frame ends before a document that would overfill
it; a document longer than a frame spans several. Beside the files stands an index, a Parquet table of (shard, doc_id, at, n)
in the files' order: the document's ids are the n from the at-th of its file. Readers look the wanted documents up there,
read the seek table, and then fetch and unpack only the frames that hold them, each checked against its checksum.

Documents are range-partitioned by (id, hash of the text), so that rows repeating one id are dealt out too, sorted, encoded
and written in one pass that holds a frame at a time; a task opens a new file after SHARD_IDS ids. The index's commit is the commit of
all: a lost or repeated task leaves files that no index row names, which ``write`` deletes at its end. Python workers
reach the folder by pyarrow's file systems (local and shared mounts, HDFS, S3, GCS).

Encoding is the tokenizer library's own. The pre-tokens of byte-level vocabularies are cut in the UTF-8 bytes of many texts at once, by
array operations on the classes of their characters; equal ones of a batch are looked up once, and the library's model is asked
for new ones, of which a worker keeps up to KEPT. Pieces with special strings, cut off before single spaces that a visible
character follows, and texts for vocabularies of other kinds go to the library whole.

Defined results: a null text counts as empty, so it holds the end id alone; a null id comes first; rows of one id come in the
order of their texts' hashes, then texts; repeated rows stand there as often; texts of any length are encoded piece by
piece; other columns are not read; an empty table gives an empty index and no files.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shared import join_checked, ship
from .tokens import byte_symbols, unsupported

#: Ids of a frame and of a file.
FRAME_IDS, SHARD_IDS = 1 << 18, 1 << 26
#: The published format's magic numbers: of the skippable frame, and of a seek table's footer; its flag for checksums.
SKIPPABLE, SEEKABLE, CHECKED = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Distinct pre-tokens that a worker keeps; characters of texts it encodes at once, characters of a slice of a long text.
KEPT, BATCH_CHARS, SLICE = 500_000, 4_000_000, 500_000
#: A piece starts at a space that no white space follows.
CUT = re.compile(r"(?= [^\s])")
#: What the byte-level pre-token pattern tells apart; all else is one class more, 0. Its white space, and the code points below which all letters and numbers are.
LETTER, NUMBER, WHITE = 1, 2, 3
SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
PLANES = 0x40000


class Pool:
    """Ids of pre-tokens already seen, in one array; beyond ``most`` only those that were asked for again stay, or none if these are most of them."""

    def __init__(self, most: int):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.used, self.start, self.size = np.zeros(1 << 20, np.uint32), 0, np.zeros(self.most, np.int64), np.zeros(self.most, np.int64)
        self.again = np.zeros(self.most, bool)

    def shrink(self) -> None:
        stay = np.flatnonzero(self.again[: len(self.known)])
        if 2 * stay.size > self.most:
            stay = stay[:0]
        ids, _ = self.joined(stay, np.zeros(0, np.int64))
        names, n = list(compress(self.known, self.again.tolist())) if stay.size else [], self.size[stay]
        self.forget()
        self.put(names, ids, n)

    def put(self, new: list[bytes], ids: np.ndarray, n: np.ndarray) -> None:
        while self.used + ids.size > self.ids.size:
            self.ids = np.r_[self.ids, np.zeros(self.ids.size, np.uint32)]
        self.ids[self.used : self.used + ids.size] = ids
        k = len(self.known)
        if k + len(new) > self.start.size:
            self.start, self.size, self.again = (np.r_[x, np.zeros(len(new), x.dtype)] for x in (self.start, self.size, self.again))
        self.start[k : k + len(new)], self.size[k : k + len(new)] = self.used + np.cumsum(n) - n, n
        self.known.update(zip(new, range(k, k + len(new)), strict=True))
        self.used += ids.size

    def places(self, wanted: list[bytes], learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Where the pre-tokens are kept; ``learn`` gives the ids of new ones."""
        find = lambda x: np.fromiter(map(self.known.get, x, repeat(-1)), np.int64, len(x))
        at = find(wanted)
        lacking = np.flatnonzero(at < 0)
        self.again[at[at >= 0]] = True
        if lacking.size:
            if len(self.known) + lacking.size > self.most:
                self.shrink()
                at = find(wanted)
                lacking = np.flatnonzero(at < 0)
            seen = [wanted[i] for i in lacking.tolist()]
            k = len(self.known)
            self.put(new := list(dict.fromkeys(seen)), *learn(new))
            at[lacking] = find(seen) if len(new) < len(seen) else np.arange(k, k + len(new))
        return at

    def joined(self, at: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens at these places in a row, and how many each row of ``lens`` pre-tokens has."""
        first, n = self.start[at], self.size[at]
        ends = np.cumsum(n)
        ids = self.ids[np.arange(int(n.sum())) + np.repeat(first - ends + n, n)]
        return ids, np.diff(np.r_[0, np.r_[0, ends][np.cumsum(lens)]])

    def rows(self, rows: list[list[bytes]], learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens in a row, and how many each of ``rows`` has."""
        return self.joined(self.places(list(chain.from_iterable(rows)), learn), np.fromiter(map(len, rows), np.int64, len(rows)))


def ragged(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(chain.from_iterable(rows), np.uint32, int(n.sum())), n


@cache
def kinds() -> np.ndarray:
    """The class of every code point in the library's own version of Unicode: what its cut leaves together is of one class."""
    from tokenizers import pre_tokenizers

    cut = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    code = np.setdiff1d(np.r_[:0xD800, 0xE000:PLANES], SPACES)
    text, out = code.astype("<u4").tobytes().decode("utf-32-le"), np.zeros(0x110000, np.uint8)
    for _, (a, z) in cut(text):
        out[code[a:z]] = next((k for k, x in ((LETTER, "a"), (NUMBER, "1")) if len(cut(x + text[a])) == 1), 0)
    out[SPACES] = WHITE
    return out


def begun(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in the UTF-8 bytes of texts in a row, which three zero bytes follow; ``first``: where each text that isn't empty begins."""
    n, table = data.size - 3, kinds()
    kind = table[data]
    lead = np.flatnonzero(data >= 0xC0)
    b, c, d, e = (data[lead + i].astype(np.int32) for i in range(4))
    code = np.where(b < 0xE0, (b & 31) << 6 | c & 63, np.where(b < 0xF0, (b & 15) << 12 | (c & 63) << 6 | d & 63, (b & 7) << 18 | (c & 63) << 12 | (d & 63) << 6 | e & 63))
    wide = 2 + (b >= 0xE0) + (b >= 0xF0)
    for i in range(4):  # a character's bytes are all of its class
        kind[lead[wide > i] + i] = table[code[wide > i]]
    edge = np.zeros(n + 3, bool)
    edge[first] = edge[n:] = True
    white = kind == WHITE
    fresh = np.r_[True, kind[1:n] != kind[: n - 1]]
    # one space belongs to what follows, and so the last of several is a pre-token's first; at a text's end they stay together
    out = fresh & np.r_[True, (data[: n - 1] != 32) | white[1:n]] | white[:n] & ~white[1 : n + 1] & ~edge[1 : n + 1]
    at, size = lead[white[lead]], wide[white[lead]]
    out[at] = fresh[at] | ~white[at + size] & ~edge[at + size]
    for i in (1, 2):
        out[at[size > i] + i] = False
    out[first] = True
    quote = np.flatnonzero(data[:n] == 39)
    quote = quote[out[quote] & ~edge[quote + 1]]
    b, c = data[quote + 1], data[quote + 2]
    short = np.isin(b, list(b"stmd"))
    long = ~edge[quote + 2] & ((b == ord("l")) & (c == ord("l")) | ((b == ord("r")) | (b == ord("v"))) & (c == ord("e")))
    out[quote[short | long] + 1] = False
    after = np.r_[quote[short] + 2, quote[long] + 3]
    out[after[after < n]] = True
    return np.flatnonzero(out)


class Encoder:
    """A tokenizer's library, of byte-level files asked once for each pre-token."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are as many as cores
        from tokenizers import Tokenizer

        self.own, parsed = Tokenizer.from_str(spec), json.loads(spec)
        self.own.no_truncation()
        self.own.no_padding()
        special = [t["content"] for t in parsed.get("added_tokens", [])]
        self.by_piece = not unsupported(parsed) and not any(" " in t for t in special)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.model, self.tokens = self.own.model, Pool(KEPT)
        self.table = np.zeros(256, "<u4")
        self.table[list(byte_symbols().values())] = list(map(ord, byte_symbols()))
        self.table[255] = ord(" ")  # no byte of UTF-8

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def of_tokens(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        spelt = self.table[np.frombuffer(b"\xff".join(new), np.uint8)].tobytes().decode("utf-32-le").split(" ")
        ids, n = [], []
        for t in spelt:
            got = self.model.tokenize(t)
            ids += [x.id for x in got]
            n.append(len(got))
        return np.array(ids, np.uint32), np.array(n, np.int64)

    def of_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.encode() for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        first, total = np.cumsum(size) - size, int(size.sum())
        if not total:
            return np.zeros(0, np.uint32), size
        data = b"".join([*raw, bytes(3)])
        at = begun(np.frombuffer(data, np.uint8), first[size > 0])
        cut = pa.Array.from_buffers(pa.large_binary(), at.size, [None, pa.py_buffer(np.r_[at, total]), pa.py_buffer(data)]).dictionary_encode()
        known = self.tokens.places(cut.dictionary.to_pylist(), self.of_tokens)
        return self.tokens.joined(known[cut.indices.to_numpy()], np.diff(np.searchsorted(at, np.r_[first, total])))

    def slices(self, text: str) -> Iterator[str]:
        """Parts of a text that encode by themselves, about SLICE characters each."""
        at = 0
        while self.by_piece and len(text) - at > SLICE and (m := CUT.search(text, at + SLICE)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each has."""
        if not self.by_piece:
            return ragged(self.whole(texts))
        if not self.special or not any(map(self.special.search, texts)):
            return self.of_texts(texts)
        rows = [CUT.split(t) if self.special.search(t) else [t] for t in texts]
        pieces = list(chain.from_iterable(rows))
        odd = [bool(self.special.search(p)) for p in pieces]
        ids, n = self.of_texts(["" if o else p for p, o in zip(pieces, odd, strict=True)])
        parts = np.split(ids, np.cumsum(n)[:-1])
        for i, more in zip(np.flatnonzero(odd).tolist(), self.whole(list(compress(pieces, odd))), strict=True):
            parts[i] = np.array(more, np.uint32)
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.concatenate(parts), np.add.reduceat(n, np.cumsum([0, *map(len, rows)])[:-1])

    def rows(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(text's number, ids, whether they end it), in order."""
        held: list[tuple[int, str, bool]] = []
        size = 0

        def flush() -> Iterator[tuple[int, np.ndarray, bool]]:
            ids, n = self.encode([t for _, t, _ in held])
            for (i, _, last), part in zip(held, np.split(ids, np.cumsum(n)[:-1]), strict=True):
                yield i, part, last

        for i, t in enumerate(texts):
            parts = iter(self.slices(t or ""))
            part = next(parts)
            while part is not None:
                after = next(parts, None)
                held.append((i, part, after is None))
                size += len(part)
                if size >= BATCH_CHARS:
                    yield from flush()
                    held.clear()
                    size = 0
                part = after
        if held:
            yield from flush()


_encoders: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """Of this Python worker, which tasks share as long as it lives."""
    key = xxhash.xxh64(spec).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec)
    return _encoders[key]


def opened(folder: str) -> tuple[pa.fs.FileSystem, str]:
    fs, path = pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
    return fs, path.rstrip("/")


class Shard:
    """A file that is being written."""

    def __init__(self, fs: pa.fs.FileSystem, folder: str, name: str, frame: int):
        self.frame, self.name, self.n, self.entries, self.held, self.size = frame, name, 0, [], [], 0
        self.out, self.pack = fs.open_output_stream(f"{folder}/{name}", compression=None), zstandard.ZstdCompressor(level=3)

    def add(self, ids: np.ndarray) -> None:
        self.n += ids.size
        while ids.size:
            part = ids[: self.frame - self.size]
            self.held.append(part)
            self.size += part.size
            ids = ids[part.size :]
            if self.size == self.frame:
                self.flush()

    def flush(self) -> None:
        if self.size:
            raw = np.concatenate(self.held).astype("<u4").tobytes()
            packed = self.pack.compress(raw)
            self.out.write(packed)
            self.entries.append(struct.pack("<III", len(packed), len(raw), xxhash.xxh64(raw).intdigest() & 0xFFFFFFFF))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), CHECKED, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(f: pa.NativeFile) -> np.ndarray:
    """Rows of frame's place, packed size, first byte and size unpacked, checksum."""
    end = f.size()
    f.seek(end - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE or not flags & CHECKED:
        raise ValueError("no seek table with checksums at the file's end")
    f.seek(end - 17 - 12 * n)
    head = struct.unpack("<II", f.read(8))
    if head != (SKIPPABLE, 12 * n + 9):
        raise ValueError("a seek table of another size than its frame's")
    e = np.frombuffer(f.read(12 * n), "<u4").reshape(n, 3).astype(np.int64)
    return np.stack([np.cumsum(e[:, 0]) - e[:, 0], e[:, 0], np.cumsum(e[:, 1]) - e[:, 1], e[:, 1], e[:, 2]], 1) if n else np.zeros((0, 5), np.int64)


class Reader:
    """A file that is read by its seek table; keeps the frame last unpacked."""

    def __init__(self, fs: pa.fs.FileSystem, path: str):
        self.path, self.file = path, fs.open_input_file(path)
        self.table, self.last, self.raw, self.unpacked = seek_table(self.file), -1, b"", 0

    def frame(self, k: int) -> bytes:
        if k != self.last:
            at, packed, _, size, check = self.table[k].tolist()
            self.file.seek(at)
            self.raw = zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=size)
            if len(self.raw) != size or xxhash.xxh64(self.raw).intdigest() & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} of {self.path} fails its checksum")
            self.last, self.unpacked = k, self.unpacked + 1
        return self.raw

    def ids(self, at: int, n: int) -> bytes:
        """The bytes of n ids from the at-th."""
        a, z, out = 4 * at, 4 * (at + n), []
        k = int(np.searchsorted(self.table[:, 2], a, "right")) - 1
        while a < z:
            first, size = int(self.table[k, 2]), int(self.table[k, 3])
            out.append(self.frame(k)[a - first : z - first])
            a, k = min(z, first + size), k + 1
        return b"".join(out)


def write(docs: DataFrame, path: str, tokenizer: str, end: int | None, id_col: str = "doc_id", text_col: str = "text", frame_ids: int = FRAME_IDS, shard_ids: int = SHARD_IDS) -> None:
    """Writes the ids of all texts, each followed by ``end`` unless None, below ``path`` in the order of ids; ``tokenizer`` is a file of the library's."""
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # a file of a few MB
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(text_col).alias("x"))
    rows = rows.repartitionByRange("doc_id", "x").sortWithinPartitions("doc_id", "x", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    folder = f"{path.rstrip('/')}/data"
    fs, top = opened(folder)
    fs.create_dir(top, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opened(folder)
        enc, shard, part, done = encoder(spec.value), None, TaskContext.get().partitionId(), 0
        for b in batches:
            of, at, n, names, begun = [], [], [], [], None
            for i, ids, last in enc.rows(b.column("text").to_pylist()):
                if begun is None:
                    if shard is not None and shard.n >= shard_ids:
                        shard.close()
                        shard, done = None, done + 1
                    shard = shard or Shard(fs, top, f"{part:06d}-{done:05d}-{uuid.uuid4().hex}.zst", frame_ids)
                    begun = shard.n
                    if shard.size and last and shard.size + ids.size >= frame_ids:
                        shard.flush()  # a document of one frame isn't cut by its border
                shard.add(ids)
                if last:
                    if end is not None:
                        shard.add(np.array([end], np.uint32))
                    of.append(i)
                    at.append(begun)
                    n.append(shard.n - begun)
                    names.append(shard.name)
                    begun = None
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), b.column("doc_id").take(pa.array(of, pa.int64())), pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["shard", "doc_id", "at", "n"])
        if shard is not None:
            shard.close()

    rows.mapInArrow(run, f"shard string, doc_id {kind}, at bigint, n bigint").write.parquet(f"{path.rstrip('/')}/index")
    known = {r["shard"] for r in index(spark, path).select("shard").distinct().collect()}  # a row a file
    for f in fs.get_file_info(pa.fs.FileSelector(top)):
        if f.base_name not in known:
            fs.delete_file(f.path)


def index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/index")


def read(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, ids) of all documents, or of the ids in the one column of ``wanted``; start: ids of all documents before it."""
    ship(spark)
    rows = index(spark, path)
    # a row a file: names sort as files do
    totals = rows.groupBy("shard").agg(F.max(F.col("at") + F.col("n")).alias("t"))
    totals = totals.select(F.col("shard").alias("s"), F.coalesce(F.sum("t").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    if wanted is not None:
        w = wanted.select(F.col(wanted.columns[0]).alias("w")).distinct().withColumn("hit", F.lit(True))
        rows = join_checked(rows, w, [("doc_id", "w")], F.col("at")).filter("hit").drop("hit")
    rows = join_checked(rows, totals, [("shard", "s")], F.col("at"))
    rows = rows.repartition("shard").sortWithinPartitions("shard", "at")
    kind = rows.schema["doc_id"].dataType.simpleString()
    folder = f"{path.rstrip('/')}/data"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opened(folder)
        reader = None
        for b in batches:
            of, out, size = [], [], 0
            start = pa.compute.add(b.column("before"), b.column("at"))
            for i, (name, at, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("shard", "at", "n")), strict=True)):
                if reader is None or not reader.path.endswith(name):
                    reader = Reader(fs, f"{top}/{name}")
                of.append(i)
                out.append(reader.ids(at, n))
                size += 4 * n
                if size > 4 * FRAME_IDS or i + 1 == b.num_rows:
                    here = pa.array(of, pa.int64())
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(here), start.take(here), pa.array(out, pa.binary())], names=["doc_id", "start", "ids"])
                    of, out, size = [], [], 0

    return rows.mapInArrow(run, f"doc_id {kind}, start bigint, ids binary")
