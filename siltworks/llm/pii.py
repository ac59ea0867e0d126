"""PII surrogates: detected entities become keyed, type-consistent stand-ins.

Each type has a keyed permutation of its own format: letters stay letters of their script and case (vowels and
consonants apart in names, each part of a name by itself with its final letter kept, as it carries the gender; titles and
particles stay), digits stay
digits, punctuation stays; a card number keeps its checksum's state, an address its class (private, public, other), a
phone its country code, an e-mail its top-level domain. Being permutations, they keep distinct entities distinct and
equal ones equal over the whole corpus with no table of names, and none maps to itself: the permutation is a shift
conjugated by a keyed Feistel cipher, which has no fixed point. Entities compare by their normal form (10.0.0.01 is 10.0.0.1); should two in
a text still share a surrogate, the later takes the next one, up to TRIES times, and then an error says so. Whoever has the key can undo the surrogates, so it must be
given and kept secret; without it they can't be told from any others of their format.
Coreference: a name is found after its title, and wherever in the text one of its parts stands by itself, with or without
title, that mention gets the same stand-in.

Defined results: null text stays null, with no entities; texts of any length are scanned whole, in time proportional to
their length; overlapping finds go to the first and then the longest; repeated rows give equal results; other columns, of
any name, pass through untouched; an empty key is refused.
"""

from __future__ import annotations

import hashlib
import re
import warnings
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import ship

TYPES = ("email", "secret", "ip", "phone", "card", "ssn", "person")
KEY_SETTING, DEMO_KEY = "spark.siltworks.pii.key", "no secret: for synthetic test tables only"
#: Titles. Fixed values.
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Monsieur", "Madame", "Mme", "Don", "Doña", "Sr", "Sra", "г-н", "г-жа")
LETTER, UPPER = r"[^\W\d_]", r"[^\W\d_a-zß-öø-ÿа-я]"
#: A part of a name: inner capitals, and apostrophes before a capital or after the first letter; not a possessive's.
PART = rf"{UPPER}(?:['’](?={LETTER}{LETTER}))?(?:{LETTER}|['’](?={UPPER}))+"
PARTICLES = ("van", "von", "der", "den", "de", "da", "di", "del", "della", "dos", "du", "la", "le", "bin", "al", "el")
NAME = rf"(?:(?:{'|'.join(PARTICLES)}) )*{PART}(?:-{LETTER}+)*"
MENTION = re.compile(rf"(?<!\w){PART}")
RULES = {
    "secret": re.compile(r"""(?:(?<=["'= :])|(?<![0-9A-Za-z]))(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])|(?<=[tTyYdD][ =:]["'])[^"'\s]{8,}(?=["'])|(?<=[nNyYtTdD] = ["'])[^"'\s]{8,}(?=["'])"""),
    "ip": re.compile(r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d]|\.\d)"),
    "phone": re.compile(r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\d(])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d]|[.-]\d)"),
    "card": re.compile(r"(?<![\d.+-])\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}(?![\d])|(?<![\d.+])\d{13,19}(?!\d)"),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
}
#: An address around its @: at most LOCAL characters before it are looked at.
LOCAL, LOCAL_CHARS = 256, re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
RULES["person"] = re.compile(rf"\b(?:{'|'.join(TITLES)})\b\.? ((?:{UPPER}\. ?)*{NAME}(?: (?:{UPPER}\. ?)*{NAME}){{0,3}})")
ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "àáâãäåæèéêëìíîïòóôõöøùúûüýÿ", "çñðþšžœß"]
VOWELS = set("aeiouyаеиоуыэюяαεηιουω")
#: Values up to which a permutation is a table.
FEW = 5000
#: Characters of one class that are permuted as one number; longer runs in parts.
CHUNK = 64
#: Further surrogates tried where one is another entity's already.
TRIES = 16
CJK = (0x4E00, 0x9FFF)


def prf(key: bytes, tweak: str, r: int, x: int, n: int) -> int:
    """An even number below n that depends on all arguments."""
    h = hashlib.blake2b(f"{tweak}|{r}|{x}".encode(), key=key, digest_size=32)
    return int.from_bytes(h.digest() if n < 1 << 192 else b"".join(hashlib.blake2b(h.digest() + bytes([i]), key=key).digest() for i in range(1 + n.bit_length() // 400)), "big") % n  # at most CHUNK characters


def cipher(x: int, a: int, b: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of range(a * b): eight Feistel rounds over the two parts."""
    for r in reversed(range(8)) if back else range(8):
        hi, lo = divmod(x, b)
        d = -1 if back else 1
        if r % 2:
            hi = (hi + d * prf(key, tweak, r, lo, a)) % a
        else:
            lo = (lo + d * prf(key, tweak, r, hi, b)) % b
        x = hi * b + lo
    return x


@lru_cache(256)
def ring(n: int, key: bytes, tweak: str) -> list[int]:
    """For few values: each goes to the next in a keyed order."""
    order = sorted(range(n), key=lambda x: (prf(key, tweak, -1, x, 1 << 64), x))
    out = [0] * n
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        out[a] = b
    return out


def moved(x: int, n: int, a: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(n), n = a * b, that leaves nothing in its place (n > 1)."""
    if n <= FEW:
        return ring(n, key, tweak)[x]
    b = n // a
    return cipher((cipher(x, a, b, key, tweak) + 1) % n, a, b, key, tweak, True)


def permuted(digits: list[int], radix: int, key: bytes, tweak: str) -> list[int]:
    n = len(digits)
    if not n or radix < 2:
        return digits
    if n > CHUNK:
        return [d for i in range(0, n, CHUNK) for d in permuted(digits[i : i + CHUNK], radix, key, f"{tweak}|{i}")]
    x = 0
    for d in digits:
        x = x * radix + d
    x = moved(x, radix**n, radix ** (n // 2), key, f"{tweak}|{radix}|{n}")
    out = []
    for _ in range(n):
        x, d = divmod(x, radix)
        out.append(d)
    return out[::-1]


@lru_cache(4096)
def classed(c: str, names: bool) -> tuple[str, str] | None:
    """A character's class as the string of its members in order, and its lower form; None: it stays."""
    if c.isascii() and c.isdigit():
        return "0123456789", c
    low = c.lower()
    for a in ALPHABETS:
        if len(low) == 1 and low in a:
            if names and (v := [x for x in a if x in VOWELS]):
                return "".join(v) if low in VOWELS else "".join(x for x in a if x not in VOWELS), low
            return a, low
    return None


def formatted(text: str, key: bytes, tweak: str, names: bool = False, keep: frozenset[int] = frozenset()) -> str:
    """Permutes each class's characters of a text by themselves; case, other characters and the places in ``keep`` stay."""
    by: dict[str, list[int]] = {}
    chars, out = list(text), list(text)
    for i, c in enumerate(chars):
        if i in keep:
            continue
        if (k := classed(c, names)) is not None:
            by.setdefault(k[0], []).append(i)
        elif CJK[0] <= ord(c) <= CJK[1]:
            by.setdefault("", []).append(i)
    for k, at in by.items():
        if not k:
            for i, d in zip(at, permuted([ord(chars[i]) - CJK[0] for i in at], CJK[1] - CJK[0] + 1, key, tweak), strict=True):
                out[i] = chr(CJK[0] + d)
            continue
        place = {c: i for i, c in enumerate(k)}
        for i, d in zip(at, permuted([place[chars[i].lower()] for i in at], len(k), key, tweak + k[0]), strict=True):
            out[i] = k[d].upper() if chars[i] != chars[i].lower() and len(k[d].upper()) == 1 else k[d]
    return "".join(out)


def luhn(digits: list[int]) -> int:
    return -sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10


def ip_class(x: int) -> tuple:
    for prefix, bits in ((10, 8), (0xAC1, 12), (0xC0A8, 16)):
        if x >> (32 - bits) == prefix:
            return (prefix, 32 - bits)
    return ("public",) if 1 <= x >> 24 < 224 else ("other",)


def named(part: str, key: bytes) -> str:
    """A name's part with its last letter kept; initials have no other."""
    return formatted(part, key, "person", True, frozenset((len(part) - 1,) if len(part) > 1 else ()))


@lru_cache(65536)
def surrogate(kind: str, text: str, key: bytes) -> str:
    """The stand-in of an entity."""
    if kind == "email":
        name, _, domain = text.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{formatted(name, key, 'email')}@{formatted(host, key, 'host')}.{top}"
    if kind == "ip":
        parts = list(map(int, text.split(".")))
        x = int.from_bytes(bytes(parts), "big")
        kept = ip_class(x)
        if len(kept) == 2:
            low = (1 << kept[1]) - 1
            x = x & ~low | moved(x & low, low + 1, 1 << (kept[1] // 2), key, f"ip{kept}")
        else:
            y = moved(x, 1 << 32, 1 << 16, key, "ip")
            while ip_class(y) != kept:
                y = moved(y, 1 << 32, 1 << 16, key, "ip")
            x = y
        return ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "card":
        at = [i for i, c in enumerate(text) if c.isdigit()]
        digits = [int(text[i]) for i in at]
        state = (digits[-1] - luhn(digits[:-1])) % 10
        new = permuted(digits[:-1], 10, key, "card")
        new.append((luhn(new) + state) % 10)
        out = list(text)
        for i, d in zip(at, new, strict=True):
            out[i] = str(d)
        return "".join(out)
    if kind == "phone":
        code = re.match(r"\+\d{1,3}(?=\D)|\+\d", text)
        return formatted(text, key, "phone", keep=frozenset(range(code.end() if code else 0)))
    if kind == "person":
        return re.sub(r"[^\s.-]+", lambda m: m[0] if m[0] in PARTICLES else named(m[0], key), text)
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
        out = "".join("0123456789abcdef"[d] for d in permuted([int(c, 16) for c in text], 16, key, "hex"))
        return out.upper() if re.search("[A-F]", text) else out
    return formatted(text, key, kind)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of addresses, each looked for from its @ to both sides."""
    at, end = text.find("@"), 0
    while at >= 0:
        if m := DOMAIN.match(text, at + 1):
            a, least = at, max(end, at - LOCAL)
            while a > least and LOCAL_CHARS.match(text, a - 1):
                a -= 1
            while a < at and text[a] in "._%+-":
                a += 1
            if a < at:
                yield a, m.end()
                end = m.end()
        at = text.find("@", max(at + 1, end))


def entities(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, type) that don't overlap."""
    found = []
    if "@" in text:
        found += [(*x, "email") for x in emails(text)]
    if re.search(r"\d", text):
        found += [(*m.span(), k) for k in ("ip", "phone", "card", "ssn") for m in RULES[k].finditer(text)]
        found += [(*m.span(), "secret") for m in RULES["secret"].finditer(text)]
    elif '"' in text or "'" in text:
        found += [(*m.span(), "secret") for m in RULES["secret"].finditer(text)]
    found += [(*m.span(1), "person") for m in RULES["person"].finditer(text)]
    found.sort(key=lambda x: (x[0], -x[1], TYPES.index(x[2])))
    out: list[tuple[int, int, str]] = []
    for x in found:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return mentions(text, out)


def mentions(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans, and between them every other mention of the persons' name parts."""
    parts = {m[0] for a, b, kind in spans if kind == "person" for m in MENTION.finditer(text, a, b)}
    if not parts:
        return spans
    parts |= {x.upper() for x in parts} | {x.capitalize() for x in parts if x.isupper()}
    out, i = list(spans), 0
    for m in MENTION.finditer(text):
        if m[0] not in parts:
            continue
        while i < len(spans) and spans[i][1] <= m.start():
            i += 1
        if i < len(spans) and spans[i][0] < m.end():
            continue
        if len(out) > len(spans) and text[out[-1][1] : m.start()] in (" ", "-"):
            out[-1] = (out[-1][0], m.end(), "person")
        else:
            out.append((*m.span(), "person"))
    return sorted(out)


def normal(kind: str, text: str) -> str:
    """What tells entities of a type apart: addresses by their numbers, the rest without case."""
    return ".".join(str(int(x)) for x in text.split(".")) if kind == "ip" else text.lower()


def replaced(text: str | None, key: bytes) -> tuple[str | None, list[int]]:
    """The text with surrogates, and its entities by type in the order of TYPES."""
    n = [0] * len(TYPES)
    if not text or not (spans := entities(text)):
        return text, n
    out, at, of = [], 0, {}
    for a, b, kind in spans:
        new, own = surrogate(kind, text[a:b], key), normal(kind, text[a:b])
        for _ in range(TRIES):
            if of.setdefault((kind, normal(kind, new)), own) == own:
                break
            new = surrogate(kind, new, key)
        else:
            raise ValueError(f"no free surrogate of type {kind} after {TRIES} tries")
        out += [text[at:a], new]
        at = b
        n[TYPES.index(kind)] += 1
    return "".join(out) + text[at:], n


def ready(key: bytes) -> bytes:
    """A key of any length as the permutations take it."""
    if not key:
        raise ValueError("surrogates need a secret key")
    return hashlib.blake2b(key, digest_size=32).digest()


def redact(docs: DataFrame, key: bytes, text_col: str = "text", counts: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text_col`` and, where named, a column ``counts`` (array of bigint by TYPES); one narrow pass."""
    ship(docs.sparkSession)
    key = ready(key)
    at, more = docs.columns.index(text_col), [counts] if counts else []
    schema = (docs.withColumn(counts, F.array().cast("array<bigint>")) if counts else docs).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [replaced(t, key) for t in b.column(at).to_pylist()]
            cols = list(b.columns)
            cols[at] = pa.array([t for t, _ in done], b.schema.field(at).type)
            if counts:
                cols.append(pa.array([n for _, n in done], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *more])

    return docs.mapInArrow(run, schema)


def session_key(spark: SparkSession, unset: str | None = None) -> bytes:
    """The key in the session's setting KEY_SETTING, or ``unset`` where it isn't set; refused without either. DEMO_KEY protects nothing: who passes it says so."""
    key = spark.conf.get(KEY_SETTING, None)
    if key is None:
        if unset is None:
            raise ValueError(f"surrogates need a secret key in {KEY_SETTING}")
        if unset == DEMO_KEY:
            warnings.warn("surrogates under the public key can be undone by anyone", stacklevel=2)
    return (key or unset or "").encode()
