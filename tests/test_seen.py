"""First-seen over growing folders against the loop it stands for."""

import random
from pathlib import Path

from siltworks.streaming.seen import seen_files

CAP = 3


def loop(rows):
    known, taken, out = set(), {}, set()
    for i, k, g in rows:
        if k is not None and k in known:
            continue
        known.add(k)
        if taken.get(g, 0) < CAP:
            taken[g] = taken.get(g, 0) + 1
            out.add((i, k, g, taken[g]))
    return out


def test_runs_over_a_growing_folder_equal_the_loop(spark, tmp_path):
    r = random.Random(3)
    rows = [(i, r.choice([None, "hot", *"abcdefghijkl"]), r.choice([None, "", "x", "x", "y", "z"])) for i in range(120)]
    source, schema, key = str(tmp_path / "in"), "i long, k string, g string", lambda x: x["i"]
    for run, (lo, hi) in enumerate([(0, 30), (30, 31), (31, 120)]):
        part = rows[lo:hi]
        spark.createDataFrame(r.sample(part, len(part)), schema).repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        got = seen_files(stream, str(tmp_path / "t"), "k", "g", "i", CAP)
        assert got.columns == ["i", "k", "g", "place"]
        assert {tuple(x) for x in got.collect()} == loop(rows[:hi]) and got.count() == len(loop(rows[:hi])), run
    commits = sorted((p for p in Path(tmp_path / "t/state/commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    commits[-1].unlink()  # as if the driver were lost after the sink's commit and before the query's
    got = seen_files(spark.readStream.schema(schema).parquet(source), str(tmp_path / "t"), "k", "g", "i", CAP)
    assert sorted(got.collect(), key=key) == sorted(set(got.collect()), key=key) and {tuple(x) for x in got.collect()} == loop(rows)
    assert not spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider")
