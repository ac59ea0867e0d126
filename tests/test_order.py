"""Order-dependent operators against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from siltworks.operators.budget import budget_trim, cap_per_group, capped_pick
from siltworks.operators.assembly import pack_stream
from siltworks.operators.dedup import dedup_then_cap, first_by, greedy_priority
from siltworks.operators.evaluation import medians, sign_p
from siltworks.operators.parsing import parse_qa, split_docs
from siltworks.plans.prefix import by_id, hashed, prefix_sum, ranked
from siltworks.plans.shared import join_checked, release, stored


def greedy(rows):
    texts, urls, kept = set(), set(), set()
    for prio, i, t, u in sorted((r[1], r[0], r[2], r[3]) for r in rows):
        if t in texts or (u and u in urls):
            continue
        texts.add(t)
        if u:
            urls.add(u)
        kept.add(i)
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_greedy_priority_replays_the_loop(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.randrange(4), f"t{r.randrange(12)}", r.choice(["", f"u{r.randrange(10)}"])) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, prio int, tk string, uk string")
    got = {x["id"] for x in greedy_priority(df, ["prio", "id"], ["tk", "uk"]).filter("stays").collect()}
    assert got == greedy(rows)


def test_long_chains_are_replayed_at_once(spark, monkeypatch):
    from siltworks.operators import dedup

    rows = [(i, i, f"t{i // 2}", f"u{(i + 1) // 2}") for i in range(60)] + [(100 + i, 0, f"x{i}", "") for i in range(5)]
    df = spark.createDataFrame(rows, "id long, prio int, tk string, uk string")
    for most in (1000, 10):  # small groups at once, larger ones go on in rounds
        monkeypatch.setattr(dedup, "AT_ONCE", most)
        assert {x["id"] for x in greedy_priority(df, ["prio", "id"], ["tk", "uk"]).filter("stays").collect()} == greedy(rows)


def test_exact_medians(spark):
    import statistics

    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), None if r.random() < 0.1 else r.uniform(-3, 3)) for _ in range(301)] + [("one", 2.0), ("none", None)]
    got = {x["k"]: (x["n"], x["median"], x["upper_median"], x["most"]) for x in medians(spark.createDataFrame(rows, "k string, v double"), "k", "v", F.floor(F.col("v"))).collect()}
    for k in {k for k, v in rows if v is not None}:
        v = sorted(v for g, v in rows if g == k and v is not None)
        assert got[k] == (len(v), pytest.approx(statistics.median(v)), v[len(v) // 2], v[-1])
    assert "none" not in got


def test_greedy_differs_from_two_passes(spark):
    rows = [(1, 0, "t1", "u1"), (2, 1, "t2", "u1"), (3, 2, "t2", "u3")]
    df = spark.createDataFrame(rows, "id long, prio int, tk string, uk string")
    assert {x["id"] for x in greedy_priority(df, ["prio", "id"], ["tk", "uk"]).filter("stays").collect()} == {1, 3}


def test_first_by_with_null_keys(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2), ("a", 5)], "k string, i int")
    assert sorted(r["i"] for r in first_by(df, ["k"], ["i"]).collect()) == [1, 2]
    assert {(r["i"], r["f"]) for r in first_by(df, ["k"], ["i"], mark="f").collect()} == {(3, False), (1, True), (2, True), (5, False)}


def test_prefix_sum_equals_one_window(spark):
    df = spark.range(500).select("id", (F.col("id") * 7919 % 101).alias("v"), hashed("s", F.col("id")).alias("h"))
    rows = sorted((r["h"], r["id"], r["v"], r["cum"]) for r in prefix_sum(df, "h", "v", ["h", "id"]).collect())
    total = 0
    for _, _, v, cum in rows:
        assert cum == total
        total += v
    by = prefix_sum(df.withColumn("g", F.col("id") % 3), "h", "v", ["h", "id"], by=["g"])
    sums = {}
    for r in sorted(by.collect(), key=lambda r: (r["g"], r["h"], r["id"])):
        assert r["cum"] == sums.get(r["g"], 0)
        sums[r["g"]] = sums.get(r["g"], 0) + r["v"]


@pytest.mark.parametrize("budget", [0, 50, 300, 10_000])
def test_budget_trim_equals_the_loop(spark, budget):
    r = random.Random(budget)
    rows = [(i, r.choice(["deaths", "wiki", "hn", "docs", "odd"]), r.randrange(1, 30)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, stream string, est_tokens long")
    got = {x["doc_id"] for x in budget_trim(df, budget).collect()}
    import hashlib

    excess, kept = sum(x[2] for x in rows) - budget, {x[0] for x in rows}
    for s in ("odd", "docs", "hn", "wiki"):
        for i, _, n in sorted((x for x in rows if x[1] == s), key=lambda x: (hashlib.md5(f"0:{x[0]}".encode()).hexdigest(), x[0])):
            if excess <= 0:
                break
            kept.discard(i)
            excess -= n
    assert got == kept


def test_cap_with_exempt_rows(spark):
    df = spark.createDataFrame([(i, "a", i % 2 == 0) for i in range(10)], "i int, g string, free boolean")
    assert sorted(r["i"] for r in cap_per_group(df, ["g"], ["i"], 2, F.col("free")).collect()) == [0, 1, 2, 3, 4, 6, 8]


def test_capped_pick_titles_do_not_use_places():
    import pandas as pd

    pdf = pd.DataFrame({"title": ["x", "x", "y", "", ""], "domain": ["d"] * 5})
    assert capped_pick(pdf, per=3).index.tolist() == [0, 2, 3]


def test_pack_stream_refuses(spark):
    with pytest.raises(ValueError, match="allow_mixing"):
        pack_stream(spark.range(1), "id", "id", ["id"], 8)


def test_parsers(spark):
    df = spark.createDataFrame([("Document 1: " + "a" * 251 + "<<<DOC>>>" + "b" * 250,)], "t string")
    assert [r["doc"] for r in split_docs(df, "t").collect()] == ["a" * 251]
    df = spark.createDataFrame([("Q: what is this here?\nA: one two three four<<<QA>>>Q: short\nA: a b c d<<<QA>>>junk",)], "t string")
    assert [(r["q"], r["a"]) for r in parse_qa(df, "t").collect()] == [("what is this here?", "one two three four")]


@pytest.mark.parametrize("limit", [100, 0])
def test_join_checked_both_ways(spark, limit):
    left = spark.createDataFrame([(i, None if i % 3 == 0 else f"s{i % 3}") for i in range(30)], "i int, s string")
    right = spark.createDataFrame([(None, 0), ("s1", 1), ("s2", 2)], "rs string, n int")
    got = join_checked(left, right, [("s", "rs")], F.col("i"), limit=limit).collect()
    assert sorted((r["i"], r["n"]) for r in got) == [(i, i % 3) for i in range(30)]


def test_stored_tables_can_be_released(spark):
    t = stored(spark.range(5))
    assert t.count() == 5
    assert release(spark) >= 1 and release(spark) == 0


def replay(rows, cap):
    seen, per, kept = set(), {}, set()
    for i, k, g, b in sorted(rows):
        if k in seen:
            continue
        if b:
            if per.get(g, 0) >= cap:
                continue
            per[g] = per.get(g, 0) + 1
        seen.add(k)
        kept.add(i)
    return kept


@pytest.mark.parametrize("seed", range(4))
def test_dedup_then_cap_replays_the_loop(spark, seed):
    r = random.Random(seed)
    rows = [(i, f"k{r.randrange(60)}", r.choice(["d0", "d1", "d2", None]), r.random() < 0.8) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, k string, g string, b boolean")
    got = dedup_then_cap(df, ["id"], "k", "g", F.col("b"), 5)
    assert {x["id"] for x in got.filter("stays").collect()} == replay(rows, 5) and got.count() == len(rows)


def test_a_capped_row_uses_up_no_key(spark):
    rows = [(1, "a", "d", True), (2, "b", "d", True), (3, "b", "e", True), (4, "a", "e", False)]
    df = spark.createDataFrame(rows, "id long, k string, g string, b boolean")
    assert {x["id"] for x in dedup_then_cap(df, ["id"], "k", "g", F.col("b"), 1).filter("stays").collect()} == {1, 3}


@pytest.mark.parametrize("seed", range(3))
def test_capped_pick_replays_the_loop(seed):
    import pandas as pd

    r = random.Random(seed)
    rows = [(r.choice(["", "t1", "t2", "t3", f"u{i}"]), f"d{r.randrange(4)}") for i in range(60)]
    want, per, titles = [], {}, set()
    for i, (t, d) in enumerate(rows):
        if len(want) < 9 and per.get(d, 0) < 3 and not (t and t in titles):
            want.append(i)
            per[d] = per.get(d, 0) + 1
            titles.add(t)
    assert list(capped_pick(pd.DataFrame(rows, columns=["title", "domain"]), 9, 3).index) == want


def test_exempt_rows_do_not_count(spark):
    df = spark.createDataFrame([(i, "g" if i % 4 else "h", None if i == 3 else i % 3 == 0) for i in range(24)], "i int, g string, e boolean")
    got = {x["i"] for x in cap_per_group(df, ["g"], ["i"], 2, F.col("e")).collect()}
    assert got == {i for i in range(24) if i != 3 and i % 3 == 0} | {1, 2} | {4, 8}


def test_groups_are_ranked_over_buckets(spark):
    df = spark.range(0, 400_000, 1000).select("id", (F.col("id") % 3000 == 0).alias("g"))
    seen = {}
    for x in sorted(ranked(df, ["g"], ["id"], by_id("id")).collect()):
        assert x["rank"] == seen.get(x["g"], 0) + 1
        seen[x["g"]] = x["rank"]


def test_signs_of_many_pairs(spark):
    import math

    pairs = [(0, 0), (1, 0), (3, 9), (60, 27), (600, 600), (700, 500), (5000, 5200), (0, 2000)]
    exact = lambda w, n: 1.0 if w + n == 0 else min(1.0, 2 * sum(math.comb(w + n, i) for i in range(min(w, n) + 1)) / 2 ** (w + n))
    got = {(x["w"], x["l"]): x["p"] for x in spark.createDataFrame(pairs, "w long, l long").select("w", "l", sign_p(F.col("w"), F.col("l")).alias("p")).collect()}
    for w, n in pairs:
        assert got[w, n] == pytest.approx(exact(w, n), rel=1e-8, abs=1e-300)



def test_null_keys_are_no_keys(spark):
    rows = [(1, None, "g"), (2, None, "g"), (3, "a", "g"), (4, "a", "h"), (5, None, None)]
    got = dedup_then_cap(spark.createDataFrame(rows, "i long, k string, g string"), ["i"], "k", "g", F.lit(True), 2)
    assert {r["i"]: r["stays"] for r in got.collect()} == {1: True, 2: True, 3: False, 4: True, 5: True}
    got = dedup_then_cap(spark.createDataFrame(rows, "i long, k string, g string"), ["i"], "k", "g", F.col("i") > 2, 0)
    assert {r["i"]: r["stays"] for r in got.collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}


@pytest.mark.parametrize("name,text,want", [("Jo X", "jo, known posthumously", True), ("Jo X", "Jo's deaths", True), ("Jo X", "Jo's funeral", False), ("E", "e died", True), (None, "died", None), ("A. Li", "LI IS DEAD", True)])
def test_relevance(spark, name, text, want):
    from siltworks.operators.collect import relevant

    d = spark.createDataFrame([(name, text)], "p string, t string")
    assert d.select(relevant(F.col("p"), F.col("t")).alias("r")).first()["r"] in ((want,) if want is not None else (None, False))
