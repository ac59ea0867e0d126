"""Sources, sinks, streams and the model boundary."""

import collections
import datetime
import gzip
import random
import zlib

import pytest
from pyspark.sql import functions as F

from siltworks.operators.boundary import JobTable, ai_map, cached, refuse_above
from siltworks.plans.shared import shared_dir
from siltworks.sources import readers, writers
from siltworks.sources.warc import register
from siltworks.streaming.jobs import clean, first_seen, hourly


def test_jsonl(spark, tmp_path):
    (tmp_path / "b.jsonl").write_text('{"id": 2, "t": "é"}\n\n{"id": 3}\n', encoding="utf-8")
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": null}\n')
    rows = readers.read_jsonl(spark, str(tmp_path), "id int, t string", origin=True).orderBy("file", "id").collect()
    assert [(r["id"], r["t"]) for r in rows] == [(1, None), (2, "é"), (3, None)]
    (tmp_path / "c.jsonl").write_text('{"id": 9, "t": "x"\n')
    assert readers.read_jsonl(spark, str(tmp_path), "id int, t string", strict=False).select("id").distinct().count() >= 3
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_jsonl(spark, str(tmp_path), "id int, t string").collect()


def test_kb_and_reports(spark, tmp_path):
    (tmp_path / "p.json").write_text('{\n "id": "kb_bank_cards_1",\n "title": "T",\n "content": "C"\n}')
    assert readers.read_kb(spark, str(tmp_path)).first()["category"] == "bank_cards"


def test_atom(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<feed><entry><title>A</title><summary>x &lt;b&gt;y&lt;/b&gt;  z</summary></entry><entry><title>B</title><summary/></entry></feed>")
    rows = readers.read_atom(spark, str(tmp_path / "f.xml"), "title string, summary string").select("title", readers.xml_text(F.col("summary")).alias("s")).orderBy("title").collect()
    assert [(r["title"], r["s"]) for r in rows][0] == ("A", "x y z") and len(rows) == 2


@pytest.mark.parametrize("packed", [True, False])
def test_warc(spark, tmp_path, packed):
    def record(kind, uri, body):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nWARC-Date: 2026-01-02T00:00:00Z\r\nContent-Length: {len(body)}\r\n\r\n"
        return head.encode() + body + b"\r\n\r\n"

    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>WARC/1.0 in a body \xc3\xa9</p>\r\n\r\n<p>more</p>"
    parts = [record("warcinfo", "", b"x"), record("response", "http://a/1", page), record("response", "http://a/2", page), record("request", "http://a/3", page), record("response", "http://a/4", b"bare")]
    (tmp_path / f"x.warc{'.gz' if packed else ''}").write_bytes(b"".join(map(gzip.compress, parts)) if packed else b"".join(parts))
    rows = readers.read_warc(spark, str(tmp_path)).orderBy("url").collect()
    html = "<p>WARC/1.0 in a body é</p>\r\n\r\n<p>more</p>"
    assert [(r["url"], r["date"], r["html"]) for r in rows] == [("http://a/1", "2026-01-02", html), ("http://a/2", "2026-01-02", html), ("http://a/4", "2026-01-02", "bare")]


def warc_record(kind, uri, body, eol=b"\r\n"):
    head = f"WARC/1.1\nWARC-Type: {kind}\nWARC-Target-URI: <{uri}>\nWARC-Date: 2026-01-02T00:00:00Z\nX-Folded: a\n b\nContent-Length: {len(body)}\n\n"
    return head.encode().replace(b"\n", eol) + body + b"\r\n\r\n"


def http(body, *heads):
    return b"\r\n".join([b"HTTP/1.1 200 OK", *heads, b"", b""]) + body


@pytest.mark.parametrize("share,eol", [(500, b"\r\n"), (1 << 27, b"\n")])
def test_warc_records_come_whole_from_every_share(spark, tmp_path, share, eol):
    r = random.Random(4)
    bodies = []
    for i in range(18):
        inner = warc_record("response", "http://fake/", http(b"inner")) * r.randrange(3)
        bodies.append(r.choice([b"", b"\r\n\r\n", b"x" * r.randrange(900)]) + inner + r.choice([b"", b"\r\n\r\n\r\n", b"\r\n\r\nWARC/1.1\r\n"]))
    parts = [warc_record("response" if i % 3 else "metadata", f"http://a/{i}", http(b) if i % 3 else b, eol) for i, b in enumerate(bodies)]
    (tmp_path / "plain.warc").write_bytes(b"".join(parts))
    (tmp_path / "packed.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in parts[:10]) + gzip.compress(b"".join(parts[10:])) + b"\0" * 5)
    register(spark)
    w = spark.read.format("warc").option("splitBytes", share).option("types", "").option("body", "true").load(str(tmp_path))
    got = collections.Counter((x["file"].rsplit("/", 1)[-1], x["url"], bytes(x["body"])) for x in w.collect())
    assert got == collections.Counter((f, f"http://a/{i}", b) for f in ("plain.warc", "packed.warc.gz") for i, b in enumerate(bodies))
    if share == 500:
        assert w.rdd.getNumPartitions() > 10


def test_warc_payloads(spark, tmp_path):
    text = "caf\u00e9 \u20ac " * 50
    packed = gzip.compress(text.encode())
    chunks = b"".join(f"{len(packed[i:i + 40]):X};x=y\r\n".encode() + packed[i : i + 40] + b"\r\n" for i in range(0, len(packed), 40)) + b"0\r\n\r\n"
    cases = {
        "chunked-gzip": (http(chunks, b"Transfer-Encoding: chunked", b"Content-Encoding: gzip"), text),
        "deflate": (http(zlib.compress(text.encode()), b"Content-Encoding: deflate"), text),
        "raw-deflate": (http(zlib.compress(text.encode())[2:-4], b"content-encoding: Deflate"), text),
        "not-gzip": (http(text.encode(), b"Content-Encoding: gzip"), text),
        "not-chunked": (http(text.encode(), b"Transfer-Encoding: chunked"), text),
        "western": (http("\u20ac\u00e9".encode("cp1252"), b"Content-Type: text/html; charset=latin1"), "\u20ac\u00e9"),
        "meta": (http('<meta charset="windows-1251">\u0416'.encode("cp1251")), '<meta charset="windows-1251">\u0416'),
        "unknown": (http(b"ok", b"Content-Type: text/html; charset=none-such"), "ok"),
        "mark": (http("\ufeffz\u00e9".encode("utf-16-le"), b"Content-Type: text/html; charset=ascii"), "z\u00e9"),
        "broken": (http(b"a\xff\0b"), "a\ufffd\ufffdb"),
        "bare": (b"no head", "no head"),
    }
    (tmp_path / "x.warc").write_bytes(b"".join(warc_record("response", k, v) for k, (v, _) in cases.items()))
    got = {x["url"]: x["html"] for x in readers.read_warc(spark, str(tmp_path / "*.warc")).collect()}
    assert got == {k: v for k, (_, v) in cases.items()}


@pytest.mark.parametrize("packed", [True, False])
def test_broken_warc_files_are_told(spark, tmp_path, packed):
    whole = [warc_record("response", f"http://a/{i}", http(b"y" * 300)) for i in range(3)]
    broken = b"".join(map(gzip.compress, whole))[:-20] if packed else b"".join(whole)[:-100]
    (tmp_path / "x").write_bytes(broken)
    with pytest.raises(Exception, match="shorter|without an end"):
        readers.read_warc(spark, str(tmp_path)).collect()
    assert readers.read_warc(spark, str(tmp_path), strict="false").count() == 2
    (tmp_path / "x").write_bytes(b"")
    assert readers.read_warc(spark, str(tmp_path)).count() == 0


def test_paths(spark, tmp_path):
    (tmp_path / "l.gz").write_bytes(gzip.compress(b"a/1\n\nb/2\n"))
    assert sorted(r["path"] for r in readers.read_paths(spark, str(tmp_path / "l.gz")).collect()) == ["a/1", "b/2"]


def test_shards_and_appends(spark, tmp_path):
    df = spark.createDataFrame([(1, "2026-01"), (2, "2026-02")], "id int, month string")
    writers.write_shards(df, str(tmp_path / "s"))
    writers.write_shards(df.unionByName(spark.createDataFrame([(3, "2026-02"), (4, "2026-03")], "id int, month string")), str(tmp_path / "s"))
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "s")).collect()) == [1, 2, 4]
    writers.write_shards(spark.createDataFrame([(9, "2026-02")], "id int, month string"), str(tmp_path / "s"), redo=True)
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "s")).collect()) == [1, 4, 9]
    assert writers.append_new(df, str(tmp_path / "a"), ["id"]).count() == 2
    assert writers.append_new(df, str(tmp_path / "a"), ["id"]).count() == 2
    nothing = spark.createDataFrame([(7, None), (8, "2026-03")], "id int, month string")
    writers.write_shards(nothing, str(tmp_path / "s"))
    writers.write_shards(nothing, str(tmp_path / "s"))
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "s")).collect()) == [1, 4, 7, 9]
    twice = spark.createDataFrame([(5, "b"), (5, "a"), (6, "z"), (1, "no")], "id int, month string")
    assert sorted(map(tuple, writers.append_new(twice, str(tmp_path / "a"), ["id"], ["month"]).filter("id > 4").collect())) == [(5, "a"), (6, "z")]
    assert '"n": 2' in writers.report(df.agg(F.count("*").alias("n")))


def test_ai_map_records_failures(spark):
    class Fails:
        def __call__(self, p):
            if p == "bad":
                raise TimeoutError("slow")
            return p.upper()

    df = spark.createDataFrame([("a",), ("bad",)], "p string")
    got = {r["p"]: (r["reply"], r["error"]) for r in ai_map(df, "p", Fails, retries=2).collect()}
    assert got == {"a": ("A", None), "bad": (None, "TimeoutError: slow")}
    with pytest.raises(ValueError, match="1 of 2 rows failed"):
        refuse_above(ai_map(df, "p", Fails, retries=1), F.col("reply").isNull())


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * (300 + i)) for i in range(100)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    from siltworks.streaming.jobs import clean_stream

    for _ in range(2):  # the second run finds nothing new
        got = clean_stream(spark, str(tmp_path / "in"), df.schema, str(tmp_path))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, clean(df).collect()))


def test_first_seen(spark, tmp_path):
    df = spark.createDataFrame([(1, "k"), (2, "k"), (3, "l")], "i long, k string").withColumn("ts", F.lit("2026-01-01").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    q = first_seen(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "ts").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 2


def test_hourly_windows_go_on_after_a_run(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, event_type string, value double"
    at = lambda h, m: datetime.datetime(2026, 1, 1, h, m)
    first = [(1, at(0, 5), "a", 1.0), (2, at(0, 50), "a", 2.0), (3, at(2, 10), "b", 4.0), (4, at(2, 20), "a", 1.5)]
    later = [(5, at(2, 30), "b", 1.0), (6, at(5, 0), "a", 8.0)]
    source, seen = str(tmp_path / "in"), []
    for new in (first, later, [], [(7, at(9, 0), "c", 1.0)]):
        df = spark.createDataFrame(new, schema)
        if new:
            df.coalesce(1).write.mode("append").parquet(source)
        seen += new
        want = {}
        for _, ts, kind, v in seen:
            n, total = want.get((ts.hour, kind), (0, 0.0))
            want[ts.hour, kind] = (n + 1, total + v)
        got = hourly(spark, source, df.schema, str(tmp_path / "state")).collect()
        assert {(x["start"].hour, x["event_type"]): (x["n"], x["total"]) for x in got} == want and len(got) == len(want)
        assert spark.read.parquet(source).count() == len(seen)


def test_late_rows_neither_appear_nor_vanish(spark, tmp_path):
    at = lambda h, m: datetime.datetime(2026, 1, 1, h, m)
    shown = []
    for i, ts in enumerate([[at(1, 5), at(6, 5)], [at(4, 30), at(6, 10)], [at(9, 5)], [at(5, 59)]]):
        df = spark.createDataFrame([(i, x, "a", 1.0) for x in ts], "event_id long, ts timestamp_ntz, event_type string, value double")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = hourly(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "state")).collect()
        shown.append({x["start"].hour: x["n"] for x in got})
    assert shown == [{1: 1, 6: 1}, {1: 1, 6: 2}, {1: 1, 6: 2, 9: 1}, {1: 1, 6: 2, 9: 1}]


def test_null_keys_are_appended_and_looked_up_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    for _ in range(3):
        assert writers.append_new(df, str(tmp_path / "t"), ["k"]).count() == 2
    for run in range(3):
        got = cached(df, "k", str(tmp_path / "c"), lambda x, run=run: x.withColumn("run", F.lit(run)))
        assert sorted((x["v"], x["run"]) for x in got.collect()) == [(1, 0), (2, 0)]
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2


def test_jobs_are_adopted_once(spark, tmp_path):
    table = lambda: JobTable(spark, str(tmp_path / "jobs"))
    batches = spark.createDataFrame([("x", 0), ("y", 0)], "batch_id string, round int")
    results = spark.createDataFrame([("x", 3, 100), ("y", 1, 50), ("other", 9, 900)], "batch_id string, docs long, tokens long")
    assert table().next_round(120) == 0
    table().submit(batches)
    table().submit(batches)
    assert table().log().count() == 2 and table().next_round(120) is None
    table().harvest(results.filter("batch_id <> 'y'"))
    assert [x["batch_id"] for x in table().pending().collect()] == ["y"]  # what the next run adopts
    table().harvest(results)
    table().harvest(results)
    assert table().log().count() == 4 and table().next_round(120) is None and table().next_round(151) == 1
    assert sorted((x["batch_id"], x["state"], x["docs"]) for x in table().states().collect()) == [("x", "done", 3), ("y", "done", 1)]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    nowhere = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(nowhere)
