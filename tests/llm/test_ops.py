"""The ten operators against brute force, on edge cases and on the test tables."""

import collections
import hashlib
import itertools
import random
import re
import string
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks.llm import chat, decontam, graph, language, mixing, neardup, pii, quality, spans, suffixes, tokens
from siltworks.llm.queries import ORACLES, QUERIES
from tests.checks import SF, assert_same, connection

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def shingle_set(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def docs(spark, texts, extra=False):
    rows = [(i, t, "en", "s" if i % 2 else None, len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("x") for c in ("w", "h", "m_size", "size", "target", "component_id", "kept", "spans", "rep", "key", "lang_pred")}) if extra else df


ODD = [None, "", " \t\n", "one", "two words", "The same text here again and again", "the SAME text here again and again", "x" * 5000, "é " * 300, "a b c d e f g h " * 400, "tie", "tie"]


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert_same(QUERIES[name](spark, SF), con, ORACLES[name])


# ---- 1 chat ------------------------------------------------------------------------------------------
def test_chat_round_trip_and_masks(spark):
    r = random.Random(3)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", "&", "&amp;", "&lt;", "&#91;", "<", "[", "\n", "\\1$1", "ok ", "é😀", "x" * 200]
    rows = []
    for c in range(25):
        for i in range(r.randrange(1, 30)):
            role = "system" if i == 0 and c % 2 else r.choice(["user", "assistant", "assistant", "odd\nrole &<s>", None])
            rows.append((c, i, role, None if r.random() < 0.1 else "".join(r.choice(bits) for _ in range(r.randrange(12))), "z"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, win string")
    w = chat.windows(df, budget=200, history=2, history_tokens=60)
    got = {x["conv_id"]: x for x in chat.read_back(w).collect()}
    for c in range(25):
        own = [x for x in rows if x[0] == c]
        said = "".join((x[3] or "") for x in own if x[2] == "assistant")
        turns = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own)
        g = got[c]
        assert (g["n_turns"], g["loss_chars"]) == (len(own), len(said))
        assert g["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert g["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
    for x in w.collect():  # system turn first, spans inside; budgets have a test of their own
        assert all(0 <= s["start"] and s["start"] + s["length"] <= len(x["formatted"]) for s in x["loss_spans"])
        if x["conv_id"] % 2:
            assert x["formatted"].startswith("[INST]system\n")
    assert max(x["n_context"] for x in w.collect()) == 3


@pytest.mark.parametrize("seed", range(2))
def test_chat_windows_keep_the_budget(spark, seed):
    r = random.Random(40 + seed)
    rows = []
    for c in range(30):
        if c % 3:
            rows.append((c, 0 if c % 5 else 4, "system", "s" * r.choice((40, 1000, 1500, 3000, 4100))))
        rows += [(c, i, r.choice(["user", "assistant"]), "t" * int(r.choice((30, 200, 600, 1500, 5000)) * r.random())) for i in range(1, r.randrange(2, 40))]
    budget, tok = 1024, lambda n: n // 4 + 1
    w = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget).collect()
    many = 0
    for x in w:
        pieces = re.findall(chat.TURN, x["formatted"])
        sizes = [tok(len("".join(p)) + 1) for p in pieces]
        own, said = len(pieces) - x["n_context"], sum(p[1] == "system" for p in pieces)
        if sum(sizes) > budget:  # a turn that doesn't fit beside the system turn: no history, nothing else
            assert own == 1 and x["n_context"] == said - (pieces[-1][1] == "system")
        many += own > 1 and x["n_context"] > 1
    assert many > 10 and any(len(re.findall(chat.TURN, x["formatted"])) == 1 for x in w)


def test_chat_ties_repeats_and_nulls(spark):
    rows = [(1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "assistant", "a"), (1, None, "user", "first"), (1, 1, "user", "a"), (None, 1, "user", "n"), (None, 1, "assistant", None), (2, 1, "assistant", "x" * 9000), (2, 2, "assistant", "y" * 9000)]
    w = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {x["conv_id"]: x for x in chat.read_back(w).collect()}
    order = [("user", "first"), ("assistant", "a"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert got[1]["n_turns"] == 5 and got[1]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in order).encode()).hexdigest()
    assert got[None]["n_turns"] == 2 and got[None]["loss_chars"] == 0
    assert (got[2]["n_turns"], got[2]["loss_chars"], w.filter("conv_id = 2").count()) == (2, 18000, 2)


def test_chat_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.windows(df)).count() == 0


# ---- 2 language --------------------------------------------------------------------------------------
def phrases(text, sample):
    n, i = 0, 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in sample:
            k += 1
        i += max(1, k - 1)
        n += 1
    return n


@pytest.mark.parametrize("cells", [1 << 30, 0])
def test_phrases_equal_brute_force(monkeypatch, cells):
    monkeypatch.setattr(language, "CELLS", cells)
    r = random.Random(5)
    samples = {"a": "".join(r.choice("abc ") for _ in range(300)), "b": "".join(r.choice("bcd ") for _ in range(300))}
    m = language.Model(samples)
    assert (m.edges is None) == (cells > 0)
    texts = ["".join(r.choice("abcdZ ") for _ in range(r.randrange(1, 1800))) for _ in range(60)]
    c, lens, _ = m.encode(texts)
    got = m.phrases(c, lens)
    clean = lambda t: re.sub(r"[^a-z]+", " ", f" {t} ".lower())
    for t, row in zip(texts, got, strict=True):
        for lang, n in zip(m.langs, row, strict=True):
            pieces = [clean(t)[i : i + language.PIECE] for i in range(0, len(clean(t)), language.PIECE)]
            assert n == sum(phrases(x, clean(samples[lang])) for x in pieces)


def test_every_language_and_letter_is_learned(spark):
    r = random.Random(12)
    scripts = [[chr(0x4E00 + 700 * j + i) for i in range(600)] for j in range(3)]  # more letters than any alphabet has
    vocab = [["".join(x[i : i + 4]) for i in range(0, 600, 4)] for x in scripts]
    rows = [(3 * i, "".join(r.choice(vocab[i % 3]) for _ in range(40)), f"cjk{i % 3}") for i in range(240)]
    rows += [(10_000 + 7 * i, f"lang{i:04d} ".translate({48 + d: "bdfgklmnpr"[d] for d in range(10)}) * 30, f"l{i}") for i in range(700)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language.fit(d)
    may = {x["lang"] for x in d.filter(~language.held_out(F.col("doc_id"))).select("lang").distinct().collect()}
    assert set(m.langs) == may and len(may) > 450
    assert m.width > 1000  # no letter is folded into another
    got = language.predict(d.filter(d.lang.isin([f"cjk{j}" for j in range(3)])), m).join(d, "doc_id")
    assert got.filter("lang_pred <> lang").count() == 0


@pytest.mark.parametrize("chars", [400, 1000, 4000, 40_000])
def test_samples_of_unequal_length_are_priced(spark, chars):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(F.col("lang").isNotNull() & (F.length("text") > 200))
    texts = collections.defaultdict(list)
    for x in d.orderBy("doc_id").select("lang", F.substring("text", 1, 3000).alias("t")).collect():
        texts[x["lang"]].append(x["t"])
    for rare in texts:
        m = language.Model({k: " ".join(v)[: chars if k == rare else 40_000] for k, v in texts.items()})
        for k, v in texts.items():
            got = m.predict(v[-60:])[0]
            assert got.count(k) >= 0.97 * len(got), (rare, k, got.count(k))


def test_too_many_labels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LABELS", 3)
    with pytest.raises(ValueError, match="labels"):
        language.fit(spark.createDataFrame([(i, "some text", f"l{i}") for i in range(30)], DOCS.split(", n_chars")[0].replace(", source string", "")))


def test_language_held_out_accuracy_and_edges(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = language.fit(d)
    p = language.predict(d, m).join(d, "doc_id").filter(language.held_out(F.col("doc_id")))
    assert p.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.98
    got = language.predict(docs(spark, ODD, True), m).orderBy("doc_id").collect()
    assert [x["lang_pred"] for x in got[:3]] == ["und"] * 3 and all(0 <= x["score"] <= 1 for x in got)
    assert language.predict(docs(spark, ["the of", "12"]), language.fit(docs(spark, []))).filter("lang_pred <> 'und'").count() == 0


def test_held_out_rule(spark):
    got = spark.range(200).select("id", language.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in got)


# ---- 3 mixing ----------------------------------------------------------------------------------------
def filled(sizes, weights, cap):
    """Shares again and again until none is above."""
    total, target, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while left > 1e-9 and open_:
        w = sum(weights[i] for i in open_)
        for i in open_:
            target[i] += left * weights[i] / w
        left = 0.0
        for i in list(open_):
            if target[i] >= cap * sizes[i]:
                left += target[i] - cap * sizes[i]
                target[i] = float(cap * sizes[i])
                open_.discard(i)
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_equal_the_loop(spark, seed):
    r = random.Random(seed)
    names = [None, *(f"s{i}" for i in range(9))]
    rows = [(n, r.randrange(0, 200) if r.random() < 0.8 else 5) for n in names for _ in range(r.randrange(1, 6))]
    got = {x[0]: x[2] for x in mixing.source_targets(spark.createDataFrame(rows, "__mix_src string, __mix_size long")).collect()}
    order = sorted((n for n in names if n is not None)) + [None]
    sizes = [sum(s for n, s in rows if n == name) for name in order]
    want = filled(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))], 3)
    assert [got[n] for n in order] == pytest.approx(want)


def test_mix_edges(spark):
    d = docs(spark, ODD, True)
    out = mixing.mix(d)
    assert out.columns == d.columns
    p = mixing.plan(d)
    assert p.count() == len(ODD)
    assert sorted(map(tuple, p.select("doc_id", "__mix_copies").collect())) == sorted(map(tuple, mixing.plan(d.repartition(3)).select("doc_id", "__mix_copies").collect()))
    assert mixing.mix(docs(spark, [])).count() == 0
    clash = d.withColumns({c: F.lit("c") for c in ("__mix_size", "__mix_copies", "__MIX_target", "kept0")})
    assert mixing.mix(clash).columns == clash.columns and mixing.mix(clash).count() == out.count()
    assert mixing.mix(clash).filter("`__mix_size` <> 'c' or kept0 <> 'c'").count() == 0
    nameless = docs(spark, [f"a b c d {i}" for i in range(300)] + ["p q r"] * 40).withColumn("doc_id", F.lit(None).cast("long"))
    share = mixing.plan(nameless.withColumn("source", F.when(F.length("text") > 5, "big").otherwise("small"))).groupBy("source").agg((F.sum(F.col("__mix_size") * F.col("__mix_copies")) / F.max("__mix_target")).alias("x")).collect()
    assert all(0.8 < r["x"] < 1.2 for r in share if r["source"] == "big")  # null ids draw by their texts, not as one
    assert mixing.plan(docs(spark, [None, ""])).agg(F.sum("__mix_copies")).first()[0] == 0


# ---- 4 near-duplicates -------------------------------------------------------------------------------
def components_of(sets, percent):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(x) for x in range(len(sets))]


def copies(seed, groups, each, n=120):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(groups):
        base = [r.choice(vocab) for _ in range(n)]
        texts.append(" ".join(base))
        for _ in range(each):
            w = list(base)
            for _ in range(r.randrange(0, 12)):
                w[r.randrange(n)] = r.choice(vocab)
            if r.random() < 0.3:
                w = w[: r.randrange(80, n)]
            texts.append(" ".join(w))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize(("k", "percent", "each"), [(3, 85, 40), (5, 80, 6)])
def test_near_duplicates_equal_brute_force(spark, k, percent, each):
    texts = copies(k, 4, each) + ODD
    want = components_of([shingle_set(t, k) for t in texts], percent)
    got = neardup.near_duplicates(docs(spark, texts, True), k, percent).orderBy("doc_id").collect()
    assert [x["component_id"] for x in got] == want
    assert [x["n_shingles"] for x in got] == [len(shingle_set(t, k)) for t in texts]
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)


@pytest.mark.parametrize(("block", "apart", "small"), [(2_000, 2_000, 3), (1_000_000, 1_000_000, 2), (300, 300, 100), (150, 1_000_000, 2), (1_000, 100, 2)])
def test_large_buckets_equal_brute_force(spark, monkeypatch, block, apart, small):
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "APART", apart)
    monkeypatch.setattr(neardup, "SMALL", small)
    texts = copies(21, 3, 45) + [f"{' '.join(f'p{i}' for i in range(60))} {' '.join(f'x{j}y{i}' for i in range(20 + j % 30))}" for j in range(40)]
    want = components_of([shingle_set(t, 3) for t in texts], 85)
    d = docs(spark, texts).withColumn("doc_id", F.format_string("id-%05d", "doc_id"))
    got = neardup.near_duplicates(d, 3, 85).orderBy("doc_id").collect()
    assert [x["component_id"] for x in got] == [f"id-{c:05d}" for c in want]
    assert len(set(want)) > 45


def test_near_duplicates_edges(spark):
    d = docs(spark, ["a b c", "a b c", None]).unionByName(docs(spark, ["a b c"])).unionByName(docs(spark, ["a b c"]).withColumn("doc_id", F.lit(None).cast("long")))
    got = sorted(((x["doc_id"], x["component_id"], x["kept"]) for x in neardup.near_duplicates(d).collect()), key=str)
    assert got == sorted([(0, 0, True), (0, 0, True), (1, 0, False), (2, 2, True), (None, 0, False)], key=str)
    assert sorted((x["doc_id"] for x in neardup.deduplicated(d).collect()), key=str) == sorted([0, 2, None], key=str)
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    assert neardup.deduplicated(docs(spark, [])).count() == 0
    clash = docs(spark, ["a"], True).withColumns({c: F.lit(1) for c in ("x", "row", "id", "stays", "o_id", "o_x", "first", "n", "d1", "rep")})
    assert neardup.deduplicated(clash).columns == clash.columns


def test_rows_of_one_id_go_by_their_own_texts(spark):
    long = " ".join(f"k{i}" for i in range(80))
    rows = [(1, long), (2, long), (2, "quite another text that no other document has"), (2, long), (3, "unique words of the third"), (3, "unique words of the third"), (None, long), (None, None), (4, ""), (4, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    got = sorted(((x["doc_id"], x["text"]) for x in neardup.deduplicated(d).collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[4], rows[6], rows[7], rows[8]], key=str)


def test_signature_estimates_similarity():
    r = np.random.default_rng(1)
    errors = []
    for n, share in ((40, 0.5), (300, 0.8), (2000, 0.9)):
        for _ in range(20):
            pool = r.integers(0, 1 << 63, 2 * n, np.uint64)
            common = int(n * share)
            a, b = pool[:n], np.concatenate([pool[:common], pool[n : 2 * n - common]])
            s = neardup.superminhash(np.concatenate([a, b]), np.array([n, n]))
            errors.append((s[0] == s[1]).mean() - common / (2 * n - common))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(5, None)]
    got = {x["id"]: x["comp"] for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {x: find(x) for x in root}


# ---- 5 and 9: repeats --------------------------------------------------------------------------------
def covered(texts, n):
    first, out = {}, collections.defaultdict(set)
    for d, t in enumerate(texts):
        w = words(t)
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if k in first:
                out[d].update(range(i, i + n))
            else:
                first[k] = d
    return out


@pytest.fixture(scope="module")
def passages():
    r = random.Random(11)
    vocab = [f"v{i}" for i in range(900)]
    text = lambda n: [r.choice(vocab) + ("." if r.random() < 0.1 else "") for _ in range(n)]
    shared, out = [text(n) for n in (49, 50, 51, 80, 200)], []
    for i in range(60):
        t = text(r.randrange(0, 200)) + (["."] + shared[i % 5] + ["end."] if i % 2 else []) + text(r.randrange(0, 120))
        out.append(" ".join(t))
    return [*out, None, "", "la " * 300, out[3]]


def test_suffix_matches_equal_brute_force(spark, passages):
    want = covered(passages, suffixes.MIN_WORDS)
    got = {x["doc_id"]: x for x in suffixes.repeated(docs(spark, passages, True)).collect()}
    assert set(got) == set(want)
    for d, x in got.items():
        assert x["n_dup_words"] == len(want[d])
        assert {i for s in x["spans"] for i in range(s["start"], s["start"] + s["length"])} == want[d]
        w = words(passages[d])
        for s in x["spans"]:
            o = words(passages[s["other_id"]])
            assert w[s["start"] : s["start"] + s["length"]] == o[s["other_start"] : s["other_start"] + s["length"]]
    assert suffixes.repeated(docs(spark, [None, "", "a b"])).count() == 0
    assert suffixes.repeated(docs(spark, [])).count() == 0


def test_suffix_matches_are_not_shadowed(spark):
    r = random.Random(23)
    text = lambda n: [f"y{r.randrange(20000)}" for _ in range(n)]
    texts = []
    for _ in range(40):  # a quote too short to count between the copies
        p, q = text(60), text(200)
        for part in (p, p[:49], p, q, *(q[i : i + 48] for i in range(0, 150, 30)), q):
            texts.append(" ".join(text(r.randrange(0, 30)) + part + text(r.randrange(0, 30))))
    got = {x["doc_id"]: x["n_dup_words"] for x in suffixes.repeated(docs(spark, texts)).collect()}
    assert got == {d: len(w) for d, w in covered(texts, suffixes.MIN_WORDS).items()}


@pytest.mark.parametrize("seed", range(4))
def test_suffix_matches_of_overlapping_partial_copies(spark, seed):
    r = random.Random(100 + seed)
    text = lambda n: [f"z{r.randrange(20000)}" for _ in range(n)]
    pool, texts = [text(r.choice((60, 90, 300))) for _ in range(12)], []
    for i in range(150):
        p = pool[r.randrange(len(pool))]
        n = r.randrange(30, len(p) + 1)
        a = r.randrange(0, len(p) - n + 1)
        texts.append(" ".join(text(r.randrange(0, 25)) + p[a : a + n] + text(r.randrange(0, 25)) + (p[:48] if i % 7 == 0 else [])))
    texts += [" ".join(pool[0][:45] + text(3)), " ".join(text(2) + pool[0][15:]), " ".join(pool[0])]
    r.shuffle(texts)
    want = covered(texts, suffixes.MIN_WORDS)
    got = suffixes.repeated(docs(spark, texts)).collect()
    assert {x["doc_id"]: {i for s in x["spans"] for i in range(s["start"], s["start"] + s["length"])} for x in got} == dict(want)
    assert all((s["other_id"], s["other_start"]) < (x["doc_id"], s["start"]) for x in got for s in x["spans"])


def test_repeats_of_rows_that_share_an_id(spark):
    r = random.Random(31)
    text = lambda n: " ".join(f"g{r.randrange(20000)}" + ("." if i % 9 == 8 else "") for i in range(n))
    long, other, third = text(120), text(130), text(140)
    rows = [(1, long), (2, long), (2, other), (2, long), (3, third), (3, third), (None, other), (5, f"{third} {other}")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x["doc_id"], x["n_words"], x["n_dup_words"], tuple(x["other_ids"])) for x in suffixes.repeated(d).collect())
    assert got == [(2, 120, 120, (1,)), (2, 130, 130, ()), (5, 270, 270, (2, 3))]
    got = sorted((x["doc_id"], x["n_removed"] == x["n_units"], words(x["text"])) for x in spans.dedup(d).collect())
    seam = words(third)[-5:] + words(other)[:9]  # one sentence where the two texts meet, which neither has
    assert got == [(2, True, [])] * 3 + [(5, False, seam)]
    left = spans.dedup(spark.createDataFrame([(1, long), (2, long), (2, other)], "doc_id long, text string")).collect()
    assert [(x["doc_id"], words(x["text"])) for x in left] == [(2, [])]


def run_keys(t):
    """Every run of enough units and words, of any length."""
    u = [" ".join(words(t[a:b])) for a, b, _ in spans.units(t)]
    n = [len(x.split()) for x in u]
    return len(u), [(tuple(u[i:j]), i, j - i) for i in range(len(u)) for j in range(i + spans.RUN_UNITS, len(u) + 1) if sum(n[i:j]) >= spans.RUN_WORDS]


def test_repeated_passages_of_sentences_vanish_wholly(spark):
    r = random.Random(41)
    sentence = lambda n: " ".join(f"s{r.randrange(10**6)}" for _ in range(n)) + "."
    shared = [[sentence(n) for n in sizes] for sizes in ((8, 8, 8, 2, 2), (2, 2, 8, 8, 8), (9, 1, 1, 9, 4), (1, 1, 1, 30, 1, 1), (40, 2, 2))]
    texts = [" ".join([sentence(20), *shared[i % 5], sentence(20)]) for i in range(25)]
    got = {x["doc_id"]: x["text"] for x in spans.dedup(docs(spark, texts)).collect()}
    assert set(got) == set(range(5, 25))
    for i, t in got.items():
        assert not set(words(" ".join(shared[i % 5]))) & set(words(t)) and len(words(t)) == 40


def test_sentence_spans_equal_brute_force(spark, passages):
    first, gone, count = {}, collections.defaultdict(set), {}
    for d, t in enumerate(passages):
        count[d], found = run_keys(t or "")
        for key, i, k in found:
            if first.setdefault(key, (d, i)) != (d, i):
                gone[d].update(range(i, i + k))
    got = {x["doc_id"]: x for x in spans.dedup(docs(spark, passages, True)).collect()}
    assert {d: x["n_removed"] for d, x in got.items()} == {d: len(g) for d, g in gone.items()}
    for d, x in got.items():
        assert x["n_units"] == count[d]
        left = [w for i, (a, b, _) in enumerate(spans.units(passages[d])) if i not in gone[d] for w in words(passages[d][a:b])]
        assert words(x["text"]) == left
    assert spans.dedup(docs(spark, [])).count() == 0


@pytest.mark.parametrize("stop", [0, 0.03, 0.15])
def test_sentence_spans_find_passages_inside_sentences(spark, stop):
    r = random.Random(17)
    text = lambda n: [f"u{r.randrange(900)}" + ("." if r.random() < stop else "") for _ in range(n)]
    shared = [text(n) for n in (51, 51, 55, 64, 90)]
    texts = [" ".join(text(r.randrange(0, 60)) + shared[i % 5] + text(r.randrange(0, 60))) for i in range(100)]
    got = {x["doc_id"] for x in spans.dedup(docs(spark, texts)).select("doc_id").collect()}
    assert got == set(covered(texts, 51)) == set(range(5, 100))


# ---- 6 tokens ----------------------------------------------------------------------------------------
def test_tokens_equal_the_library(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    r = random.Random(2)
    pool = [chr(c) for c in [*range(0x250), 0x85, 0x1680, 0x2028, 0x3000, 0x4E00, 0x1F600, 0x301, 0x661, 0x2160]] + ["'s", "<|endoftext|>", " ", "\n\n"]
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(80))) for _ in range(400)] + [x for x in ODD if x is not None] + ["a" * 3000, " " * 500]
    got = tokens.count_tokens(docs(spark, [None, *texts], True), P.path("byte_bpe_50k.json")).orderBy("doc_id").collect()
    assert got[0]["n_tokens"] == 0 and got[0]["n_bytes"] == 0
    assert [x["n_tokens"] for x in got[1:]] == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [x["n_bytes"] for x in got[1:]] == [len(x.encode()) for x in texts]


def test_long_texts_are_counted_in_slices(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    r = random.Random(22)
    texts = ["".join(r.choice(["word ", "it's ", "\n\n", "  ", "é", "12", "<|endoftext|>", "x" * 50]) for _ in range(4000)), "a", None]
    want = [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    monkeypatch.setattr(tokens, "SLICE", 700)
    monkeypatch.setattr(tokens, "KEPT", 50)
    monkeypatch.setattr(tokens, "BATCH_CHARS", 900)
    assert tokens.Counter(tokens.RankMerger(P.path("byte_bpe_50k.json"))).texts(texts) == want


def test_other_tokenizer_files_are_refused():
    P = pytest.importorskip("public_tokenizers")
    with pytest.raises(ValueError, match="normalizer, pre_tokenizer"):
        tokens.RankMerger(P.path("word_bpe_49k.json"))


# ---- 7 quality ---------------------------------------------------------------------------------------
def test_quality_edges(spark):
    got = quality.judge(docs(spark, ODD)).orderBy("doc_id").collect()
    assert len(got) == len(ODD) and not any(x["kept"] for x in got[:5])
    assert (got[9]["q_words"], got[9]["q_repeat"], got[9]["base_failed"]) == (3200, 3200, True)
    assert quality.judge(docs(spark, [])).count() == 0


def judged(rows):
    """The whole operator by plain loops: measures, sketches by group, fences, verdicts."""
    measures = []
    for _, text, lang, source in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeat = len({i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)})
        chars, symbols, dups = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
        failed = len(w) < 50 or 100 * repeat > 50 * len(w)
        m = {"q_sym": 10000 * symbols // max(chars, 1), "q_dup": 10000 * max(dups - quality.DUPS, 0) // max(len(lines), 1), "q_rep": 10000 * max(repeat - quality.REPEATS, 0) // max(len(w), 1), "q_len": 100 * chars // max(len(w), 1)}
        measures.append((lang, source, failed, m, (len(w), chars, symbols, dups, repeat)))
    floor6 = lambda v: (v >> max(v.bit_length() - 6, 0)) << max(v.bit_length() - 6, 0) if v else 0
    out = []
    for lang, source, failed, m, own in measures:
        fine = not failed
        if fine:
            for k, (up, low) in quality.SLACK.items():
                good = [x for x in measures if not x[2]]
                group = [x for x in good if x[:2] == (lang, source)]
                group = group if len(group) >= quality.MIN_GROUP else [x for x in good if x[0] == lang]
                group = group if len(group) >= quality.MIN_GROUP else good
                v = sorted(floor6(x[3][k]) for x in group)
                q1, q3 = v[-(-len(v) // 4) - 1], v[-(-3 * len(v) // 4) - 1]
                slack = max(3 * (q3 - q1), up)
                fine = fine and m[k] <= q3 + slack and (low is None or m[k] >= q1 - slack)
        out.append((*own, failed, fine))
    return out


def test_quality_equals_plain_loops(spark):
    r = random.Random(14)
    rows = []
    for i in range(260):
        word = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
        w = [word(r.randrange(2, 9)) for _ in range(r.choice((20, 60, 90, 200)))]
        w += [r.choice(["###", "<b>", "$%"]) for _ in range(r.choice((0, 0, 0, 2, 30, 80)))]
        w += w[: r.choice((0, 0, 5, 40, 200))]
        text = "".join(x + r.choice([" ", " ", " ", "\n", "\t "]) for x in w) + "\nsame line" * r.choice((0, 0, 3, 30))
        rows.append((i, None if i % 50 == 7 else text, r.choice(["en", "en", "de", None]), r.choice(["s0", "s1", None])))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("x") for c in ("q_words", "kept", "m", "b", "g_n", "t_lang", "base_failed")})
    got = [tuple(x)[3:] for x in quality.judge(df).orderBy("doc_id").collect()]
    want = judged(rows)
    assert got == want and 20 < sum(x[-1] for x in want) < 250 and any(not x[-2] and not x[-1] for x in want)


def test_quality_keeps_clean_and_drops_junk(spark):
    r = random.Random(4)
    clean = [" ".join("".join(r.choice("etaoinshr") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(60, 300))) for _ in range(120)]
    junk = [" ".join(w + "###$$$" for w in t.split()) for t in clean[:6]]
    got = [x["kept"] for x in quality.judge(docs(spark, clean + junk)).orderBy("doc_id").collect()]
    assert all(got[:120]) and not any(got[120:])


# ---- 8 decontamination -------------------------------------------------------------------------------
def test_containment_equals_brute_force(spark):
    r = random.Random(8)
    vocab = [f"q{i}" for i in range(300)]
    items = [" ".join(r.choice(vocab) for _ in range(n)) for n in (3, 5, 8, 20, 40, 90, 400)] + [None, ""]
    texts = []
    for i in range(80):
        w = [r.choice(vocab) for _ in range(r.randrange(0, 900))]
        it = (items[i % 7]).split()
        for _ in range(r.randrange(0, 4)):
            it[r.randrange(len(it))] = r.choice(vocab)
        texts.append(" ".join(w[:50] + it + w[50:]) if i % 2 else " ".join(w))
    texts += [items[0], items[1].upper(), None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["n_shared"] for x in decontam.matches(docs(spark, texts, True), bench).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, q in enumerate(items):
            s, full = shingle_set(q, 5), shingle_set(t, 5)
            if s and len(s & full) >= 0.8 * len(s):
                want[d, i] = len(s & full)
    assert got == want
    clash = docs(spark, texts, True).withColumns({c: F.lit("x") for c in ("items", "s", "S_", "text_", "__dc_text", "__dc_items")})
    left = decontam.clean(clash, bench)
    assert left.columns == clash.columns
    assert sorted(x["doc_id"] for x in left.collect()) == sorted(set(range(len(texts))) - {d for d, _ in want})
    assert decontam.clean(docs(spark, texts), bench.limit(0)).count() == len(texts)


def test_several_blocks_of_repeated_items(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 100)
    r = random.Random(18)
    items = [" ".join(f"b{r.randrange(500)}" for _ in range(30)) for _ in range(12)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(100 + i, items[0]) for i in range(40)] + [(3, items[3])] * 5, "item_id long, text string")
    texts = [f"some words before {items[0]} and after", f"{items[3]} x", "nothing here at all of the kind"]
    got = sorted((x["doc_id"], x["item_id"]) for x in decontam.matches(docs(spark, texts), bench).collect())
    assert got == [(0, 0), *((0, 100 + i) for i in range(40)), (1, 3)]
    assert [x["doc_id"] for x in decontam.clean(docs(spark, texts), bench).collect()] == [2]


KEY = pii.ready(b"test")


# ---- 10 PII ------------------------------------------------------------------------------------------
def test_surrogates():
    key = KEY
    text = "Mail bob.Lee7@mail.example.com or BOB.lee7@mail.example.com, call +1 (663) 555-6869 / +1-663-555-6869, 10.1.2.3, 8.8.8.8, 4111 1111 1111 1111, 078-05-1120, Frau Anna Groß met Mr. Иван Петров."
    new, n = pii.replaced(text, key)
    assert n == [2, 0, 2, 2, 1, 1, 2]
    for gone in ("bob", "555-6869", "8.8.8.8", "4111", "078-05", "Anna", "Иван"):
        assert gone not in new
    a, b = [x for x in new.replace(",", "").split() if "@" in x]
    assert a.lower() == b.lower() and a != b and a.endswith(".com")
    assert " 10." in new and "Frau " in new and new.count("+1") == 2
    assert len(new) == len(text) or new.count(".") == text.count(".")
    assert pii.replaced(new.replace("x", "x"), key)[1] == n  # types hold


def test_later_mentions_of_names_get_the_same_surrogate():
    text = "Mr. John Smith met Mrs McDonald, Mr O'Brien and Mr John Paul Smith-Jones. Smith's friend John Smith wrote to smith@x.org; SMITH saw McDonald, Dr O'Brien, Ms J. van der Berg and Mr Smith."
    new, n = pii.replaced(text, KEY)
    for gone in ("Smith", "SMITH", "John", "Paul", "Jones", "Donald", "Brien", "Berg", "J. ", "smith@"):
        assert gone not in new
    john, smith, mc = (pii.surrogate("person", x, KEY) for x in ("John", "Smith", "McDonald"))
    assert new.startswith(f"Mr. {john} {smith} met Mrs {mc}, ") and f" {smith}'s friend {john} {smith} wrote" in new
    assert f"; {smith.upper()} saw {mc}, Dr " in new and new.endswith(f"Mr {smith}.") and " van der " in new
    assert n[pii.TYPES.index("person")] == 11 and len({john, smith, mc}) == 3


def test_surrogates_stay_distinct():
    r = random.Random(6)
    for kind, make in (("card", lambda: str(r.randrange(10**15, 10**16))), ("ip", lambda: f"{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}"), ("email", lambda: f"{''.join(r.choice('abc1') for _ in range(3))}@x{r.randrange(9)}.org"), ("person", lambda: "".join(r.choice("ABC") for _ in range(1)) + "".join(r.choice("aeibd") for _ in range(3)))):
        some = {make() for _ in range(1500)}
        new = {pii.surrogate(kind, x, KEY) for x in some}
        assert len(new) == len(some) and all(pii.surrogate(kind, x, KEY) != x for x in some)
    cards = ["4111111111111111", "4111111111111112"]
    assert [pii.luhn([*map(int, x[:-1])]) == int(x[-1]) for x in cards] == [pii.luhn([*map(int, y[:-1])]) == int(y[-1]) for y in (pii.surrogate("card", x, KEY) for x in cards)]


def test_collisions_are_resolved(monkeypatch):
    new, n = pii.replaced("10.0.0.1 and 10.0.0.01 and 10.0.0.2", KEY)
    a, b, c = new.split(" and ")
    assert a == b != c and n[pii.TYPES.index("ip")] == 3
    real = pii.surrogate
    monkeypatch.setattr(pii, "surrogate", lambda kind, text, key: "5.5.5.5" if text in ("8.8.8.8", "9.9.9.9") else real(kind, text, key))
    a, b, c = pii.replaced("8.8.8.8 9.9.9.9 9.9.9.9", KEY)[0].split()
    assert a == "5.5.5.5" != b == c


def planted(r):
    """A text of words and entities, and the spans of these, known as it is built."""
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 8)))
    digits = lambda n: "".join(r.choice("123456789") for _ in range(n))
    part = lambda: r.choice(["Anna", "Bo", "McDonald", "O'Brien", "Иван", "Müller", "Jean-Luc", "Rosa"])
    make = {
        "email": lambda: f"{word()}.{word()}{digits(2)}@{word()}.{word()}.org", "ip": lambda: ".".join(str(r.randrange(256)) for _ in range(4)),
        "phone": lambda: f"+{r.randrange(1, 99)} {digits(3)} {digits(3)} {digits(4)}", "card": lambda: digits(16), "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "secret": lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)),
    }
    text, spans = "", []
    for _ in range(r.randrange(0, 40)):
        text += f" {word()}{r.choice([' ', ', ', chr(10), ' (', ': '])}"
        kind = r.choice([*make, "person", None, None, None, None])
        if kind == "person":
            text += r.choice(["Mr. ", "Mrs ", "Frau "])
            made = part()
        else:
            made = make[kind]() if kind else word()
        if kind:
            spans.append((len(text), len(text) + len(made), kind))
        text += made
    return text, spans


def test_entities_and_surrogates_equal_what_was_planted():
    """The text is rebuilt from its planted spans alone: what lies between stays to the letter, each type keeps its format, equal and distinct entities stay so."""
    r = random.Random(77)
    back, there = {}, {}
    form = lambda t: re.sub(r"[a-z]", "a", re.sub(r"[A-ZÄÖÜ]", "A", re.sub(r"\d", "0", t)))
    for _ in range(400):
        text, spans = planted(r)
        assert pii.entities(text) == spans, text
        new, n = pii.replaced(text, KEY)
        at, shift = 0, 0
        for a, b, kind in spans:
            assert new[at + shift : a + shift] == text[at:a]
            end = next((i for i in range(a + shift, len(new) + 1) if new[i:].startswith(text[b : b + 1]) and kind == "ip" and not new[i : i + 1].isdigit() and new[i : i + 1] != "."), b + shift) if kind == "ip" else b + shift
            own, stand = text[a:b], new[a + shift : end]
            shift, at = end - b, b
            assert own != stand and there.setdefault((kind, own.lower()), stand.lower()) == stand.lower() and back.setdefault((kind, stand.lower()), own.lower()) == own.lower()
            if kind in ("phone", "card", "ssn", "secret"):
                assert form(own) == form(stand) or kind == "secret"
            if kind == "email":
                assert own.rpartition(".")[2] == stand.rpartition(".")[2] and form(own.partition("@")[0]) == form(stand.partition("@")[0])
            if kind == "person":
                assert own[-1] == stand[-1] and own[0].isupper() == stand[0].isupper() and ("а" <= own[1].lower() <= "я") == ("а" <= stand[1].lower() <= "я")
        assert new[at + shift :] == text[at:]
        assert n == [sum(k == t for _, _, k in spans) for t in pii.TYPES]


@pytest.mark.parametrize("text", ["a" * 1_000_000 + " @", "a@" * 400_000, "a." * 500_000 + "@x.org", "@" + "a." * 500_000, "Mr " + "A" * 1_000_000, "Mr A. " * 150_000, "1-" * 500_000, "0.0." * 250_000, "token='" + "x" * 1_000_000, "f" * 1_000_000])
def test_long_texts_take_linear_time(text):
    began = time.perf_counter()
    pii.replaced(text, KEY)
    assert time.perf_counter() - began < 20


def test_a_key_is_required(spark):
    with pytest.raises(ValueError, match="secret key"):
        pii.session_key(spark)
    with pytest.warns(UserWarning, match="public key"):
        assert pii.session_key(spark, pii.DEMO_KEY) == pii.DEMO_KEY.encode()


def test_keys_and_local_parts():
    with pytest.raises(ValueError):
        pii.ready(b"")
    text = f"write to bob@mail.org or {'x' * 400}@y.org, ..@z.org, a@b.c@d.org"
    new, n = pii.replaced(text, KEY)
    assert n[0] == 3 and "bob@" not in new and "x" * 257 not in new and "..@z.org" in new
    assert new != pii.replaced(text, pii.ready(b"other"))[0]


def test_redact_edges(spark):
    d = docs(spark, [*ODD, "write to a@b.org"], True)
    got = pii.redact(d, b"k").orderBy("doc_id").collect()
    assert [x["text"] for x in got[:-1]] == ODD and "a@b.org" not in got[-1]["text"]
    assert pii.redact(docs(spark, []), b"k").count() == 0
    twice = pii.redact(pii.redact(d, b"k", counts="n"), b"k", counts="m")
    assert twice.columns == [*d.columns, "n", "m"] and twice.count() == len(ODD) + 1


# ---- pipeline ----------------------------------------------------------------------------------------
def test_pipeline(spark):
    import corpus_pipeline as P

    d = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in d.collect()}
    stages = [d]
    for name, stage in P.STAGES:
        stages.append(stage(spark, stages[-1], SF).cache())
        assert stages[-1].columns == d.columns, name
    ids = [sorted(r["doc_id"] for r in s.select("doc_id").collect()) for s in stages]
    assert set(ids[1]) >= {i for i, r in rows.items() if len(r["text"]) > 200}
    comp = components_of([shingle_set(rows[i]["text"], 5) for i in ids[1]], 80)
    assert ids[2] == sorted({ids[1][c] for c in comp})
    items = [shingle_set(r["text"], 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {i for i in ids[2] if any(s and len(s & shingle_set(rows[i]["text"], 5)) >= 0.8 * len(s) for s in items)}
    assert dirty and ids[3] == sorted(set(ids[2]) - dirty) and ids[4] == ids[3]
    for r in stages[4].collect():
        assert r["text"] == pii.replaced(rows[r["doc_id"]]["text"], pii.ready(pii.session_key(spark, pii.DEMO_KEY)))[0] and r["n_chars"] == len(r["text"])
    n = collections.Counter(ids[5])
    assert set(n) <= set(ids[4]) and max(n.values()) <= 3
    assert sorted(r["doc_id"] for r in P.run(spark, SF).select("doc_id").collect()) == ids[5]


def test_pipeline_edges(spark):
    """Nulls in every column, empties, a long text, repeats, ties, near copies under one id and clashing columns, stage by stage."""
    import corpus_pipeline as P

    r = random.Random(50)
    d = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en' and length(text) between 400 and 900")
    clean = [x["text"] for x in d.orderBy("doc_id").limit(12).collect()]
    items = [x["text"] for x in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    clean = [t for t in clean if not any(len(shingle_set(i, 5) & shingle_set(t, 5)) >= 0.8 * len(shingle_set(i, 5)) for i in items)]
    long = " ".join(r.choice(" ".join(clean).split()) for _ in range(30_000))
    rows = [(100 + i, t, "en", "s") for i, t in enumerate(clean)]
    rows += [(1, None, None, None), (2, "", "en", "s"), (3, " \n\t", "en", None), (4, "12 34 !!", "en", "s"), (5, long, "en", "s"), (None, clean[0], None, None), (100, clean[0], "en", "s"), (100, clean[1], "en", "s"), (6, "漢字" * 200, "en", "s")]
    rows += [(200, clean[2] + " one more word", "en", "s"), (300, f"A letter of its own begins here and then goes on so: {items[0]}", "en", "s"), (301, "Please write to Mrs Anna Lindt at anna@lindt.org about the matter and tell her that the letter of last week has reached us all.", "en", "s")]
    names = ("w", "x", "s", "row", "items", "lid_pred", "lid_odd", "pii_n", "__lid_pred", "__pii_n", "__dc_text", "__mix_size", "rep", "first", "stays", "target")
    learn = [(10_000 + i, t, "en", "s") for i, t in enumerate(x["text"] for x in d.limit(40).collect())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit(c) for c in names})
    known = lambda x: sorted((r["doc_id"] for r in x.select("doc_id").collect() if r["doc_id"] is None or r["doc_id"] < 10_000), key=str)
    more = spark.createDataFrame(learn, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.lit(1).cast("long")).withColumns({c: F.lit(c) for c in names})
    stages = [df.unionByName(more)]
    for name, stage in P.STAGES:
        stages.append(stage(spark, stages[-1], SF).cache())
        assert stages[-1].columns == df.columns, name
        assert stages[-1].filter(" or ".join(f"`{c}` <> '{c}'" for c in names)).count() == 0, name
    ids = [known(x) for x in stages]
    assert ids[1] == sorted((x[0] for x in rows if x[0] not in (1, 2, 3, 4, 6)), key=str)
    into = [(x["doc_id"], x["text"]) for x in stages[1].collect()]
    comp = components_of([shingle_set(t, 5) for _, t in into], 80)
    least = {c: min(i for (i, _), o in zip(into, comp, strict=True) if o == c and i is not None) for c in set(comp)}
    want = sorted([i for i in least.values() if i < 10_000] + [i for i, _ in into if i is None], key=str)
    assert ids[2] == want and want.count(100) == 2 and not {101, 200} & set(want)  # two texts under 100 lead a group each
    assert ids[3] == [i for i in want if i != 300] and 300 in want and ids[4] == ids[3]
    text = {x["doc_id"]: x["text"] for x in stages[4].collect()}
    assert "Lindt" not in text[301] and "anna@" not in text[301] and len(text[5]) > 100_000
    assert set(ids[5]) <= set(ids[4])
    empty = df.limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0 and empty.columns == df.columns
