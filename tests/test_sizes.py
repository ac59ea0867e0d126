"""What queries move or hold, on tables of two sizes."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siltworks.llm import neardup, negatives, token_files
from siltworks.operators import index


SF = "/root/testdata/sf0.01"


def shuffled(spark, run, of="shuffleWriteBytes"):
    """Bytes, or rows, that ``run`` writes to shuffles."""
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()

    def total():
        none = gateway.jvm.java.util.ArrayList()
        stages = store.stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
        return sum(getattr(stages.apply(i), of)() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_hard_negatives_move_vectors_not_products(spark):
    def moved(n):
        g = np.random.default_rng(n)
        rows = [(i, int(g.integers(5)), x) for i, x in enumerate(g.normal(size=(n, 40)).round(3).tolist())]
        df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
        return shuffled(spark, lambda: negatives.mine(df, F.col("vec_id") % 10 == 0, F.col("label")).collect())

    small, large = moved(1500), moved(6000)
    assert large < 6 * small and large < 5 * 6000 * 40 * 4


def test_frequent_pieces_stay_when_the_pool_is_full():
    pool, asked = token_files.Pool(100), []

    def learn(new):
        asked.extend(new)
        return np.arange(len(new), dtype=np.uint32), np.ones(len(new), np.int64)

    common = [f"c{i}" for i in range(20)]
    for k in range(30):
        pool.rows([common + [f"{k}-{i}" for i in range(40)]], learn)
    assert asked.count("c0") == 1 and len(pool.known) <= 100


def test_self_bleu_moves_texts_not_grams(spark):
    size = spark.read.parquet(f"{SF}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    assert shuffled(spark, lambda: entry.queries()["self_bleu"](spark, SF).collect()) < 2.5 * size


def test_distinct_grams_move_in_few_rows(spark):
    assert shuffled(spark, lambda: entry.queries()["distinct_n"](spark, SF).collect(), "shuffleWriteRecords") < 5000  # a row a gram is over 400,000


def test_tasks_of_the_index_do_not_grow_with_the_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "SHARE_CHARS", 1000)
    asked, postings = [], index._postings
    monkeypatch.setattr(index, "_postings", lambda *x: (asked.append(int(spark.conf.get("spark.sql.shuffle.partitions"))), postings(*x)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    d = spark.createDataFrame([(i, "some words of a text " * 5) for i in range(100)], "i long, t string")
    index.append(d, str(tmp_path / "i"), "i", "t", F.expr("i div 4"))
    assert asked == [100 * 105 // 1000 + 1] and spark.conf.get("spark.sql.shuffle.partitions") == before


def test_links_of_large_buckets_do_not_depend_on_their_size(spark, monkeypatch):
    """Pairs that share one band: all in one bucket, compared at once or dealt out."""
    rng = np.random.default_rng(4)
    shared = rng.integers(0, 1 << 60, 80)
    sets = []
    for _ in range(20):
        base = rng.integers(0, 1 << 60, 20)
        for _ in range(2):
            sets.append(np.unique(np.r_[shared, base, rng.integers(0, 1 << 60, 5)]))
    node = lambda i: (i, i)
    kind = "struct<doc_id:bigint,x:bigint>"
    bands = [[1, *(100 * i + k for k in range(1, neardup.BANDS))] for i in range(len(sets))]  # the first only in common
    at = spark.createDataFrame([(1, 0, node(i), s.size, node(i)) for i, s in enumerate(sets)], f"key bigint, band int, rep {kind}, n bigint, comp {kind}")
    nodes = spark.createDataFrame([(node(i), bytes(neardup.SLOTS), bands[i]) for i in range(len(sets))], f"rep {kind}, sig binary, bands array<bigint>")
    whole = spark.createDataFrame([(node(i), s.tolist()) for i, s in enumerate(sets)], f"rep {kind}, s array<bigint>")
    want = {(i, i + 1) for i in range(0, len(sets), 2)}
    for apart in (1_000_000, 0):
        monkeypatch.setattr(neardup, "APART", apart)
        got = neardup.links_in_blocks(at, nodes, whole, 85, 0).collect()
        assert {tuple(sorted((r["a"]["doc_id"], r["b"]["doc_id"]))) for r in got} == want
