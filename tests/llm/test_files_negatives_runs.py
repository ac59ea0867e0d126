"""Token files, hard negatives and periodic runs against the library, brute force and edge cases."""

import collections
import io
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltworks.llm import negatives, periodic, token_files
from siltworks.llm.queries import QUERIES, made_periodic
from siltworks.plans.shared import release
from tests.checks import SF

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " \t\n", "one", "two  words ", " lead", "a\n b", "a \n b  c", "it's  <|endoftext|> in<|endoftext|>\x1c x \x85 y　 z", "é 😀 " * 300, "x" * 5000, "a b c d " * 400, "tie", "tie", "\x1f \x1f", " '", "don't  'll"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCAB)


# ---- 11 token files ----------------------------------------------------------------------------------
def expected(rows, library, end=2):
    """(doc_id, start, n, crc) in the files' order, up to rows of one id."""
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [end]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def files(path):
    fs, top = token_files.opened(path + "/data")
    return fs, [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(top))]


@pytest.mark.parametrize("frame,shard", [(1 << 18, 1 << 26), (7, 100), (256, 1)])
def test_token_files_round_trip(spark, tmp_path, library, frame, shard):
    rows = [(i * 3 - 20, t) for i, t in enumerate(ODD)] + [(None, "no id here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("shard", "at", "n", "x", "start")})
    path = str(tmp_path / "t")
    token_files.write(df, path, VOCAB, 2, frame_ids=frame, shard_ids=shard)
    got = [(r["doc_id"], r["start"], len(r["ids"]) // 4, zlib.crc32(r["ids"])) for r in token_files.read(spark, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected(rows, library)
    fs, names = files(path)
    plain = b""
    for name in sorted(names):  # any zstandard reader unpacks the frames in a row, and skips the table
        with fs.open_input_file(name) as f:
            table, raw = token_files.seek_table(f), b""
            f.seek(0)
            packed = f.read()
        for at, size, first, n, _ in table.tolist():
            one = zstandard.ZstdDecompressor().decompress(packed[at : at + size])
            assert (first, n) == (len(raw), len(one)) and n <= 4 * frame
            raw += one
        assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(packed), read_across_frames=True).read() == raw
        plain += raw
    assert len(plain) == 4 * sum(r[2] for r in got)


def test_only_wanted_frames_are_unpacked(spark, tmp_path, library):
    rows = [(i, f"text {i} " * (i % 50)) for i in range(300)]
    path = str(tmp_path / "t")
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), path, VOCAB, None, frame_ids=64)
    wanted = spark.createDataFrame([(7,), (7,), (123,), (299,), (1000,), (None,)], "id long")
    got = {r["doc_id"]: r["ids"] for r in token_files.read(spark, path, wanted).collect()}
    assert {k: np.frombuffer(v, "<u4").tolist() for k, v in got.items()} == {k: library.encode(rows[k][1]).ids for k in (7, 123, 299)}
    fs, names = files(path)
    reader = token_files.Reader(fs, max(names, key=lambda n: fs.get_file_info(n).size))
    frames = len(reader.table)
    reader.ids(70, 10)
    assert reader.unpacked == 1 < frames
    with fs.open_input_file(reader.path) as f:
        data = bytearray(f.read())
    data[int(reader.table[1, 0]) + int(reader.table[1, 1]) - 1] ^= 1
    (tmp_path / "bad.zst").write_bytes(data)
    bad = token_files.Reader(fs, str(tmp_path / "bad.zst"))
    assert bad.ids(0, 10) == reader.ids(0, 10)
    with pytest.raises(Exception, match="checksum|[Dd]ecompress"):
        bad.ids(70, 10)


def test_files_of_lost_tasks_go(spark, tmp_path):
    path = tmp_path / "t"
    (path / "data").mkdir(parents=True)
    (path / "data" / "orphan.zst").write_bytes(b"")
    token_files.write(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), str(path), VOCAB, 2)
    _, names = files(str(path))
    assert len(names) == 1 and "orphan" not in names[0]


def test_token_files_repeats_and_empty(spark, tmp_path, library):
    rows = [(1, "b"), (1, "a a"), (1, "b"), (0, "z")]
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "a"), VOCAB, 2)
    got = sorted((r["doc_id"], r["start"], len(r["ids"]) // 4) for r in token_files.read(spark, str(tmp_path / "a")).collect())
    assert [g[0] for g in got] == [0, 1, 1, 1] and [g[1] for g in got] == np.cumsum([0, *[g[2] for g in got[:-1]]]).tolist()
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "e"), VOCAB, 2)
    assert token_files.read(spark, str(tmp_path / "e")).count() == 0


def test_pieces_encode_like_whole_texts(library, monkeypatch):
    monkeypatch.setattr(token_files, "SLICE", 40)
    monkeypatch.setattr(token_files, "BATCH_CHARS", 100)
    r = random.Random(5)
    bits = [" ", "  ", "\n", "\t", "'s", "'", "word", "Wort", "12", "3", "é", "漢", "　", "\xa0", "\x1c", "\x85", "<|endoftext|>", ".", ",", "😀", "​"]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(80))) for _ in range(1500)]
    with open(VOCAB, encoding="utf-8") as f:
        enc = token_files.Encoder(f.read())
    got = collections.defaultdict(list)
    for i, ids, _ in enc.rows(texts):
        got[i] += ids.tolist()
    assert [got[i] for i in range(len(texts))] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_character_is_of_the_librarys_class(library):
    """Letters that the library's version of Unicode doesn't know are none to it."""
    with open(VOCAB, encoding="utf-8") as f:
        enc = token_files.Encoder(f.read())
    texts = [chr(c) + "'s" for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    got = [ids.tolist() for _, ids, _ in enc.rows(texts)]
    assert got == [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]


def test_work_in_python_follows_distinct_pre_tokens(library):
    """Not pieces between spaces, which are as many as a text's sentences have ends and beginnings."""
    with open(VOCAB, encoding="utf-8") as f:
        enc = token_files.Encoder(f.read())
    words = [f"{a}{b}" for a in "abcdefghij" for b in "qrstuvwxyz"]
    texts, calls = [" ".join(f"{a}.\n{b}" for b in words) for a in words], 0

    def called(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    next(enc.rows(["warm"]))
    sys.setprofile(called)
    try:
        ids, n = enc.encode(texts)
    finally:
        sys.setprofile(None)
    assert calls < len(words) ** 2 // 2  # 300 distinct pre-tokens, 10,000 pieces
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_other_vocabularies_encode_whole_texts(spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    own, t = Tokenizer.from_file(path), "It's  A test\nof words <|endoftext|> x"
    token_files.write(spark.createDataFrame([(1, t)], "doc_id long, text string"), str(tmp_path / "w"), path, None)
    assert np.frombuffer(token_files.read(spark, str(tmp_path / "w")).first()["ids"], "<u4").tolist() == own.encode(t, add_special_tokens=False).ids


def test_op11_equals_the_library(spark, library):
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op11_token_files"](spark, SF).collect())
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got == expected(rows, library)
    release(spark)


# ---- 12 hard negatives -------------------------------------------------------------------------------
def brute(rows, positives=5, negatives_=3, low=50, high=95):
    best = {}
    for i, label, v in rows:
        if None not in (i, label, v) and all(x is not None and np.isfinite(x) for x in v):
            best[i] = min(best.get(i, (label, v)), (label, v))
    width = max((len(v) for _, v in best.values()), default=0)
    q = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] + [0] * (width - len(v)) for i, (_, v) in best.items()}
    dot = lambda a, b: sum(x * y for x, y in zip(q[a], q[b], strict=True))
    out = []
    for a in q:
        if a % 5:
            continue
        order = sorted((b for b in q if b != a), key=lambda b: (-dot(a, b), b))
        for p in [b for b in order if best[b][0] == best[a][0]][:positives]:
            s = dot(a, p)
            fit = [b for b in order if best[b][0] != best[a][0] and low * s <= 100 * dot(a, b) <= high * s][:negatives_]
            out += [(a, p, k + 1, b, s, dot(a, b)) for k, b in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("seed,dims,sizes", [(1, 5, (4, 8)), (2, 70, (3, 16)), (3, 2, (256, 1024)), (4, 300, (8, 8))])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, seed, dims, sizes):
    monkeypatch.setattr(negatives, "ANCHORS", sizes[0])
    monkeypatch.setattr(negatives, "ROWS", sizes[1])
    r = random.Random(seed)
    label = lambda: 0 if r.random() < 0.4 else r.randrange(6)  # noqa: E731  (a hot one)
    rows = [(i, label(), [r.choice([0.0, 0.25, 0.5, 1.0, -0.5, r.random()]) for _ in range(dims)]) for i in range(90)]
    rows += [(200, None, [1.0] * dims), (None, 1, [1.0] * dims), (205, 2, None), (210, 2, [float("nan")] * dims), (215, 1, [float("inf")] * dims), (220, 1, [None] * dims)]
    rows += [(225, 1, []), (230, 1, [0.5]), (0, 0, [9.0] * dims), rows[3], rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumns({c: F.lit("x") for c in ("n", "block", "row", "v", "code")})
    got = sorted(tuple(x) for x in negatives.mine(df, F.col("vec_id") % 5 == 0, F.col("label")).collect())
    want = brute(rows)
    assert [(g[0], g[1], g[2], g[3], g[4], g[5]) for g in got] == want and want


def test_hard_negatives_without_rows_or_anchors(spark):
    for rows in ([], [(1, 1, [1.0])], [(5, 1, [1.0])], [(5, 1, []), (10, 1, []), (11, 2, [])]):
        df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
        assert sorted(tuple(x) for x in negatives.mine(df, F.col("vec_id") % 5 == 0, F.col("label")).collect()) == brute(rows)


def test_large_components_saturate(spark):
    rows = [(5, 1, [3e38, 1.0]), (6, 1, [3e38, 0.0]), (7, 2, [2e38, -1.0])]
    got = negatives.mine(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>"), F.col("vec_id") % 5 == 0, F.col("label"), high=100).collect()
    assert [(r["positive_id"], r["negative_id"]) for r in got] == [(6, 7)] and got[0]["positive_score"] < 1 << 55


def test_products_are_exact():
    g = np.random.default_rng(1)
    for top in (100, 1 << 30):
        a, b = g.integers(-top, top, (5, 8)), g.integers(-top, top, (7, 8))
        assert (negatives.product(a.tobytes(), b.tobytes(), 5, 7) == a @ b.T).all()


# ---- 13 periodic runs --------------------------------------------------------------------------------
def plain_runs(w):
    n, found = len(w), []
    for p in range(1, n // 3 + 1):
        i = 0
        while i < n - p:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            a, length = i, j - i + p
            smallest = next(q for q in range(1, p + 1) if all(w[k] == w[k + q] for k in range(a, a + length - q)))
            if smallest == p and length >= max(24, 3 * p):
                found.append((a, length, p))
            i = j
    return sorted(found)


@pytest.mark.parametrize("long", [4096, 10])
def test_runs_equal_brute_force(monkeypatch, long):
    monkeypatch.setattr(periodic, "LONG", long)
    r, some = random.Random(9), 0
    for _ in range(400):
        w = []
        while len(w) < r.randrange(5, 400):
            p = [r.choice("abc") for _ in range(r.choice([1, 2, 3, 5, 8, 20, 40]))]
            w += (p * r.randrange(1, 9))[: r.randrange(1, 200)] if r.random() < 0.7 else [r.choice("abcdefgh") for _ in range(r.randrange(9))]
        want = plain_runs(w)
        assert periodic.runs(w) == want
        some += len(want)
        gone = {i for a, n, p in want for i in range(a + p, a + n)}
        assert periodic.kept(w, want) == [x for i, x in enumerate(w) if i not in gone]
    assert some > 400


def test_long_texts_of_one_word_and_of_none_alike():
    assert periodic.runs(["a"] * 30_000) == [(0, 30_000, 1)]
    assert periodic.runs([str(i) for i in range(30_000)]) == []
    w = [str(i) for i in range(7000)]
    assert periodic.runs(w * 3) == [(0, 21_000, 7000)]


def test_the_best_run_is_the_first_of_equals():
    assert periodic.best([(0, 30, 10), (5, 24, 8), (50, 48, 8), (90, 6, 1), (99, 60, 10)]) == (50, 48, 8)
    assert periodic.best([]) is None


def test_collapse_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a " * 24), (4, "a " * 24), (5, "a " * 23), (None, "x y\n" * 20 + "end"), (6, " a " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("runs", "top", "w", "h")})
    got = collections.defaultdict(list)
    for r in periodic.collapse(df).collect():
        got[r["doc_id"]].append(([tuple(x) for x in r["runs"]], r["top"] and tuple(r["top"]), r["text"]))
    assert got[1] == got[2] == got[3] == [([], None, "")]
    assert got[4] == [([(0, 24, 1)], (0, 24, 1), "a")] * 2 and got[5] == [([], None, " ".join(["a"] * 23))]
    assert got[None] == [([(0, 40, 2)], (0, 40, 2), "x y end")] and got[6] == [([(0, 30, 1)], (0, 30, 1), " a")]
    assert periodic.collapse(df.limit(0)).count() == 0


def test_tails_are_made_periodic(spark):
    rows = [(i, " ".join(str(k) for k in range(i % 90))) for i in range(200)] + [(None, "a b"), (200, None)]
    got = {r["doc_id"]: r["text"] for r in made_periodic(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        h, w = zlib.crc32(str(i).encode()), (t or "").split()
        if i is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            assert got[i] == " ".join(w[:a] + [w[a + (k - a) % p] for k in range(a, n)])
        else:
            assert got[i] == t
