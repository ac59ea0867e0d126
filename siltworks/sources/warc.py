"""WARC files as a data source: every record by its Content-Length.

``spark.read.format("warc")`` after ``register``; options: ``types`` (record types wanted, by commas; responses), ``splitBytes``, ``body``
(true: also the payload's bytes), ``strict`` (false: a broken file ends where it breaks, else it raises).

A file is read in pieces of CHUNK bytes, and one record is held at a time. Gzip members are unpacked in a row, one task a file, since where
members begin can't be told without unpacking; plain files are dealt out by splitBytes. A task reads the heads from the file's
start on, seeking over the blocks, to the first record at or after its share, so what looks like a record inside a page never
starts one. Payloads are freed of chunked transfer and of gzip and deflate encodings, and decoded by their byte order mark,
declared or marked charset, else as UTF-8, bytes that don't fit replaced.
"""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.shared import ship
from .files import listed, opened

SCHEMA = "file string, offset bigint, type string, id string, url string, date string, status int, content_type string, charset string, html string, body binary"
TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.binary()]
#: Bytes read at once, of a batch of rows, of a head at most, of a share of a plain file.
CHUNK, BATCH, HEAD, SHARE = 1 << 18, 4 << 20, 1 << 20, 128 << 20
BLANK = re.compile(rb"\r?\n\r?\n")
MARKED = re.compile(rb"""<meta[^>]{0,200}?charset\s*=\s*["']?\s*([A-Za-z0-9_:.-]+)""", re.I)
#: Labels that the web reads as windows-1252.
WESTERN = {"iso8859-1", "ascii", "cp1252"}


class Bytes:
    """A file's bytes in a row, unpacked if it is gzip; ``at`` is the place in them."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.at, self.held = file, 0, bytearray()
        start = file.read(2)
        file.seek(0)
        self.unpack = zlib.decompressobj(31) if start == b"\x1f\x8b" else None
        self.packed = self.unpack is not None

    def more(self) -> bool:
        """One piece more; False at the end."""
        while True:
            raw = self.file.read(CHUNK)
            if not self.packed:
                self.held += raw
                return bool(raw)
            if not raw:
                if self.unpack is not None:
                    raise ValueError("a gzip member without an end")
                return False
            got = bytearray()
            while raw:
                if self.unpack is None:
                    raw = raw.lstrip(b"\0")
                    if not raw:
                        break
                    self.unpack = zlib.decompressobj(31)
                got += self.unpack.decompress(raw)
                raw = self.unpack.unused_data
                if self.unpack.eof:
                    self.unpack = None
            if got:
                self.held += got
                return True

    def drop(self, n: int) -> bytes:
        out = bytes(self.held[:n])
        del self.held[:n]
        self.at += n
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise ValueError("a block shorter than its Content-Length")
        return self.drop(n)

    def skip(self, n: int) -> None:
        while n > len(self.held):
            n -= len(self.held)
            self.drop(len(self.held))
            if not self.packed:
                if self.at + n > self.file.size():
                    raise ValueError("a block shorter than its Content-Length")
                self.file.seek(self.at + n)
                self.at += n
                return
            if not self.more():
                raise ValueError("a block shorter than its Content-Length")
        self.drop(n)

    def past_blanks(self) -> bool:
        """To the next byte that ends no line; False at the end."""
        while True:
            n = len(self.held) - len(self.held.lstrip(b"\r\n"))
            self.drop(n)
            if self.held:
                return True
            if not self.more():
                return False

    def head(self) -> bytes:
        """Up to the blank line, which goes too."""
        seen = 0
        while not (m := BLANK.search(self.held, seen)):
            seen = max(0, len(self.held) - 3)
            if len(self.held) > HEAD or not self.more():
                raise ValueError("a record's head without an end")
        return self.drop(m.end())[: m.start()]


def fields(head: bytes) -> dict[str, str]:
    """Fields below the first line, names in lower case, folded lines joined; of repeated fields the first."""
    out: dict[str, str] = {}
    for line in re.sub(rb"\r?\n[ \t]+", b" ", head).decode("utf-8", "replace").splitlines()[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def records(src: Bytes, start: int, end: int, types: set[str]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, fields, block) of the records that begin from ``start`` on and before ``end``."""
    while src.past_blanks() and src.at < end:
        at = src.at
        head = src.head()
        f = fields(head)
        if not head.startswith(b"WARC/") or not f.get("content-length", "").isdigit():
            raise ValueError(f"no record at byte {at}")
        n = int(f["content-length"])
        if at < start or types and f.get("warc-type") not in types:
            src.skip(n)
        else:
            yield at, f, src.take(n)


def dechunked(body: bytes) -> bytes:
    """Of a chunked body that keeps its form; any other stays."""
    out, at = [], 0
    while m := re.compile(rb"[ \t]*([0-9A-Fa-f]+)[ \t]*(?:;[^\r\n]*)?\r?\n").match(body, at):
        n = int(m[1], 16)
        if not n:
            return b"".join(out)
        out.append(body[m.end() : m.end() + n])
        at = m.end() + n
        at += 2 if body[at : at + 2] == b"\r\n" else body[at : at + 1] == b"\n"
    return b"".join(out) if out and at >= len(body) else body


def inflated(body: bytes, encoding: str) -> bytes:
    """A body that doesn't unpack stays."""
    for name in reversed([x.strip().lower() for x in encoding.split(",") if x.strip()]):
        for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(name, ()):
            try:
                body = zlib.decompressobj(bits).decompress(body)
                break
            except zlib.error:
                pass
    return body


def charset_of(body: bytes, content_type: str) -> tuple[str, bytes]:
    """The charset's name, and the body without a byte order mark."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if body.startswith(mark):
            return name, body[len(mark) :]
    declared = re.search(r"""charset\s*=\s*["']?\s*([\w:.-]+)""", content_type, re.I)
    marked = MARKED.search(body[:1024])
    for label in (declared and declared[1], marked and marked[1].decode()):
        try:
            if label:
                name = codecs.lookup(label).name
                return "cp1252" if name in WESTERN else name, body
        except LookupError:
            pass
    return "utf-8", body


def decoded(body: bytes, charset: str) -> str:
    if charset == "cp1252":
        try:
            return body.decode("cp1252")
        except UnicodeDecodeError:
            return body.decode("latin-1")
    return body.decode(charset, "replace")


def payload(f: dict[str, str], block: bytes) -> tuple[int | None, str, bytes]:
    """Status, content type and bytes of what was transferred; a block without an HTTP head is that itself."""
    m = BLANK.search(block) if block.startswith(b"HTTP/") or f.get("warc-type") == "response" else None
    if not m:
        return None, f.get("content-type", ""), block
    http, body = fields(block[: m.start()]), block[m.end() :]
    status = re.match(rb"HTTP/[\d.]+ +(\d{3})", block)
    if "chunked" in http.get("transfer-encoding", "").lower():
        body = dechunked(body)
    return int(status[1]) if status else None, http.get("content-type", ""), inflated(body, http.get("content-encoding", ""))


@dataclass
class Share(InputPartition):
    path: str
    start: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.share = options["path"], int(options.get("splitBytes", SHARE))
        self.types = {x.strip() for x in options.get("types", "response").split(",") if x.strip()}
        self.body, self.strict = options.get("body", "false").lower() == "true", options.get("strict", "true").lower() == "true"

    def partitions(self) -> list[Share]:
        fs, found = listed(self.path)
        out = []
        for f in found:
            with fs.open_input_file(f.path) as file:
                packed = file.read(2) == b"\x1f\x8b"
            out += [Share(f.path, a, a + self.share) for a in range(0, f.size, self.share)] if not packed else [Share(f.path, 0, 1 << 62)]
        return out or [Share("", 0, 0)]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        if not share.path:
            return
        fs, _ = opened(self.path)
        rows, size = [], 0
        with fs.open_input_file(share.path) as file:
            found = records(Bytes(file), share.start, share.end, self.types)
            while True:
                try:
                    at, f, block = next(found)
                except StopIteration:
                    break
                except (ValueError, zlib.error) as e:
                    if self.strict:
                        raise ValueError(f"{share.path}: {e}") from e
                    break
                status, kind, body = payload(f, block)
                charset, bare = charset_of(body, kind)
                rows.append((share.path, at, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-target-uri", "").strip("<>"), f.get("warc-date", "")[:10], status, kind, charset, decoded(bare, charset).replace("\0", "�"), body if self.body else None))
                size += len(body)
                if size >= BATCH:
                    yield self.batch(rows)
                    rows, size = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=names)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(WarcSource)
