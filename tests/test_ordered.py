"""The sink of ordered shards against a sorted list."""

import os
import random
import shutil

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltworks.sources.ordered import read_ordered, write_ordered

ORDER = ["day", "tie", "id"]
SCHEMA = StructType().add("day", "string").add("tie", "string").add("id", "long").add("size", "long")


def rows(n=600):
    r = random.Random(5)
    out = [(r.choice(["2026-01-01"] * 3 + ["2026-01-02", "2026-02-01", None]), f"{r.randrange(40):02x}", i, r.choice([0, 1, 5, 400, None])) for i in range(n)]
    return out + out[:20]  # whole rows twice


def key(x):
    return tuple((v is not None, v) for v in x[:3])


def places(spark, path, made):
    before = {m["shard"]: m["rows_before"] for m in made.collect()}
    got = read_ordered(spark, path, SCHEMA).collect()
    assert all(list(before.values())[i] <= list(before.values())[i + 1] for i in range(len(before) - 1))
    return [tuple(r[c] for c in [*ORDER, "size"]) for r in sorted(got, key=lambda r: before[r["shard"]] + r["row"])]


def files(path):
    return {f"{a}/{f}": os.stat(f"{a}/{f}").st_mtime_ns for a, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_order_and_resumption(spark, tmp_path):
    data, path = rows(), str(tmp_path / "out")
    df = spark.createDataFrame(data, SCHEMA).repartition(7)
    write = lambda: write_ordered(df, path, ORDER, "size", 1000, F.concat("day", F.substring("tie", 1, 1)))
    made = write()
    want = sorted(data, key=key)
    assert [x[:3] for x in places(spark, path, made)] == [x[:3] for x in want]
    table = {m["shard"]: m for m in made.collect()}
    total = 0
    for s in sorted(table):
        assert table[s]["size_before"] == total and tuple(table[s]["first"]) == want[table[s]["rows_before"]][:3]
        total += table[s]["size"]
    assert total == sum(x[3] or 0 for x in data) and len(table) > 20
    firsts, cum = {}, 0
    for x in want:  # whole rows twice go to the last shard that either reaches
        firsts[x[:3]] = cum // 1000
        cum += x[3] or 0
    got = {tuple(r[c] for c in ORDER): r["shard"] for r in read_ordered(spark, path, SCHEMA).collect()}
    assert {k: v for k, v in got.items() if k[2] >= 20} == {k: v for k, v in firsts.items() if k[2] >= 20}
    shards = sorted(d for d in os.listdir(f"{path}/shards") if d.startswith("shard="))
    assert all(sum(f.endswith(".parquet") for f in os.listdir(f"{path}/shards/{d}")) == 1 for d in shards)
    lost = shards[1::3]
    for d in lost:  # as if the run had been broken off before these and the manifest were written
        shutil.rmtree(f"{path}/shards/{d}")
    shutil.rmtree(f"{path}/manifest")
    kept = files(f"{path}/shards")
    assert [x[:3] for x in places(spark, path, write())] == [x[:3] for x in want]
    after = files(f"{path}/shards")
    assert {f: after.get(f) for f in kept} == kept and len(after) == len(shards)
    write()
    assert files(f"{path}/shards") == after


def test_empty_and_null(spark, tmp_path):
    b = F.coalesce("day", F.lit(""))
    assert write_ordered(spark.createDataFrame([(None, None, None, None)] * 3, SCHEMA), str(tmp_path / "nulls"), ORDER, "size", 10, b).first()["rows"] == 3
    assert write_ordered(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), ORDER, "size", 10, b).count() == 0
