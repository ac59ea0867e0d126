"""Queries that go through sources and sinks and come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.catalog import query
from ..plans.prefix import hashed
from ..plans.shared import join_checked, scratch
from ..sources import readers, writers
from ..sources.derived import DATED, dated
from ..sources.ordered import read_ordered, write_ordered
from ..sources.warc import register
from ..streaming.jobs import clean_stream, hourly
from ..streaming.seen import seen_files
from .dedup import _K, prefix_key


def _folder(df) -> str:
    return scratch(df.sparkSession, "sink")


@query("jsonl_roundtrip", f"WITH {DATED} SELECT doc_id, date, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS source, md5(text) AS text_md5 FROM d")
def _jsonl(t):
    d = dated(t("documents")).select("doc_id", "date", F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("source"), "text")
    path = _folder(d)
    writers.write_jsonl(d, path)
    return readers.read_jsonl(d.sparkSession, path, "doc_id bigint, date string, source string, text string").select("doc_id", "date", "source", F.md5("text").alias("text_md5"))


@query("month_shards", f"WITH {DATED} SELECT substr(date, 1, 7) AS month, count(*)::BIGINT AS docs, sum(est_tokens)::BIGINT AS tokens FROM d WHERE substr(date, 1, 7) <> '2026-02' OR doc_id % 2 = 0 GROUP BY 1")
def _shards(t):
    """The second write finds February there and leaves it."""
    d = dated(t("documents")).select("doc_id", F.substring("date", 1, 7).alias("month"), "est_tokens")
    path = _folder(d)
    writers.write_shards(d.filter("month = '2026-02' and doc_id % 2 = 0"), path)
    writers.write_shards(d, path)
    got = d.sparkSession.read.schema("doc_id bigint, est_tokens bigint, month string").json(path)
    return got.groupBy("month").agg(F.count("*").alias("docs"), F.sum("est_tokens").alias("tokens"))


@query("resume_append", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'first' ELSE 'second' END AS run FROM documents")
def _append(t):
    d = t("documents").select("doc_id")
    path = _folder(d)
    writers.append_new(d.filter("doc_id % 3 = 0").withColumn("run", F.lit("first")), path, ["doc_id"])
    return writers.append_new(d.withColumn("run", F.lit("second")), path, ["doc_id"])


@query("stream_clean", "SELECT doc_id, source FROM documents WHERE length(text) BETWEEN 350 AND 24000")
def _clean(t):
    """The cleaner as a stream over the files that are there, to a checkpointed table."""
    d = t("documents").select("doc_id", "source", "text")
    path = _folder(d)
    d.write.parquet(path + "/in")
    return clean_stream(d.sparkSession, path + "/in", d.schema, path).select("doc_id", "source")


@query("stream_hourly", "SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _hourly(t):
    """An extra: tumbling windows under a watermark; what is still open comes from a batch."""
    e = t("events").select("event_id", "ts", "event_type", "value")
    path = _folder(e)
    e.write.parquet(path + "/in")
    return hourly(e.sparkSession, path + "/in", e.schema, path)


_PLACES = 20


@query("seen_files", rf"WITH k AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 'o' || doc_id ELSE 'k' || {_K} END AS k FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS nth FROM k), p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM f WHERE nth = 1) SELECT doc_id, source, place::BIGINT AS place FROM p WHERE place <= {_PLACES}")
def _seen(t):
    """First of each text key over all files, and its place in its source up to a cap, by state that a later run would go on from."""
    d = t("documents").select("doc_id", "source", prefix_key(F.col("text")).alias("k"))
    path = _folder(d)
    d.write.parquet(path + "/in")
    return seen_files(d.sparkSession.readStream.schema(d.schema).parquet(path + "/in"), path, "k", "source", "doc_id", _PLACES).select("doc_id", "source", "place")


@query("benchmark_join", f"WITH {DATED} SELECT substr(date, 1, 7) AS month, count(*)::BIGINT AS n, round(avg(logprob), 6) AS mean_logprob, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS right_share, count(*) FILTER (quality IS NULL)::BIGINT AS ungraded FROM (SELECT date, -(doc_id % 97) / 10.0::DOUBLE AS logprob, quality FROM d LEFT JOIN labels l USING (doc_id)) GROUP BY 1")
def _benchmark(t):
    """Runs and their grades, each a JSON line file under its own schema, joined by event; what has no grade is told."""
    d, path = dated(t("documents")), _folder(t("documents"))
    writers.write_jsonl(d.select(F.col("doc_id").cast("string").alias("event_id"), "date", (-(F.col("doc_id") % 97) / F.lit(10.0)).alias("logprob")), path + "/runs")
    writers.write_jsonl(t("labels").select(F.col("doc_id").cast("string").alias("event_id"), (F.col("quality") == 1).alias("correct")), path + "/graded")
    runs, graded = readers.read_jsonl(d.sparkSession, path + "/runs", readers.RUN), readers.read_jsonl(d.sparkSession, path + "/graded", readers.GRADE)
    j = runs.join(graded, "event_id", "left")
    return j.groupBy(F.substring("date", 1, 7).alias("month")).agg(F.count("*").alias("n"), F.round(F.avg("logprob"), 6).alias("mean_logprob"), F.round(F.avg(F.coalesce(F.col("correct").cast("int"), F.lit(0)).cast("double")), 6).alias("right_share"), F.count_if(F.col("correct").isNull()).alias("ungraded"))


@query("kb_scan", "SELECT 'kb_bank_' || (item_id % 3) || '_' || item_id AS id, 'bank_' || (item_id % 3) AS category, length(text)::BIGINT AS n FROM benchmark")
def _kb(t):
    """A knowledge base of one JSON page a file, read back with each page's category."""
    b = t("benchmark").select(F.concat(F.lit("kb_bank_"), (F.col("item_id") % 3).cast("string"), F.lit("_"), F.col("item_id").cast("string")).alias("id"), F.lit("T").alias("title"), F.col("text").alias("content"))
    path = _folder(b)
    b.repartitionByRange(8, "id").write.option("maxRecordsPerFile", 1).json(path)
    return readers.read_kb(b.sparkSession, path).select("id", "category", F.length("content").cast("long").alias("n"))


_QUOTED = "'WARC/1.0', NL, 'WARC-Type: response', NL, 'WARC-Target-URI: http://no/', NL, 'Content-Length: 2', NL, NL, 'no', NL, NL"
_PAGE = f"CASE WHEN page_id % 6 = 0 THEN concat(html, NL, NL, {_QUOTED}, 'end') WHEN page_id % 6 = 1 THEN concat(html, NL, NL) WHEN page_id % 6 = 2 THEN concat('WARC/1.0', NL, html) ELSE html END"
_WESTERN = "page_id % 6 = 3 AND NOT {}(html, '[^\\x00-\\x7F\\xA0-\\xFF]')"


@query("warc_scan", f"WITH p AS (SELECT url, page_id, html, {_PAGE.replace('NL', 'chr(13) || chr(10)')} AS page FROM pages) SELECT url, '2026-03-04' AS date, CASE WHEN {_WESTERN.format('regexp_matches')} THEN 'cp1252' ELSE 'utf-8' END AS charset, md5(page) AS html_md5 FROM p")
def _warc(t):
    """Pages written as response records among others, plain and packed, and read back: pages that quote records or end in blank lines, Latin-1, chunked ones."""
    p, nl = t("pages").select("page_id", "url", "html"), "\r\n"
    western = F.expr(_WESTERN.format("regexp_like").replace("\\", "\\\\"))
    page = F.expr(_PAGE.replace("NL", "'\\r\\n'"))
    body = F.when(western, F.encode(F.when(western, page).otherwise(F.lit("")), "ISO-8859-1")).otherwise(F.encode(page, "UTF-8"))
    raw = lambda *parts: F.concat(*[F.lit(x).cast("binary") if isinstance(x, str) else x.cast("binary") for x in parts])
    p = p.select("page_id", "url", "html", western.alias("western"), body.alias("body"))
    chunked = raw(F.lower(F.hex(F.octet_length("body"))), nl, F.col("body"), f"{nl}0{nl}{nl}")
    head = F.when(F.col("western"), F.lit("; charset=ISO-8859-1")).otherwise(F.lit("; charset=utf-8"))
    transfer = F.col("page_id") % 6 == 4
    http = raw(f"HTTP/1.1 200 OK{nl}Content-Type: text/html", head, F.when(transfer, F.lit(f"{nl}Transfer-Encoding: chunked")).otherwise(F.lit("")), nl + nl, F.when(transfer, chunked).otherwise(F.col("body")))
    record = lambda kind, b: raw(f"WARC/1.0{nl}WARC-Type: {kind}{nl}WARC-Target-URI: ", F.col("url"), f"{nl}WARC-Date: 2026-03-04T05:06:07Z{nl}Content-Length: ", F.octet_length(b).cast("string"), nl + nl, b, nl)
    both = p.select("page_id", raw(record("request", F.col("url")), nl, record("response", http)).cast("string").alias("value"))
    path = _folder(p)
    for packed, part in (("gzip", both.filter("page_id % 2 = 0")), ("none", both.filter("page_id % 2 = 1"))):
        part.select("value").write.option("lineSep", nl).option("compression", packed).text(f"{path}/{packed}")
    register(p.sparkSession)
    w = p.sparkSession.read.format("warc").option("splitBytes", 1 << 20).load(path)
    return w.select("url", "date", "charset", F.md5(F.encode("html", "UTF-8")).alias("html_md5"))


@query("atom_scan", "SELECT page_id, url AS title, 'a b' || (page_id % 9) || ' c' AS summary FROM pages")
def _atom(t):
    """Feed entries with marked-up content, and their plain text."""
    p = t("pages").select(F.col("page_id").cast("string").alias("id"), F.col("url").alias("title"), F.concat(F.lit("<p>a  <b>b"), (F.col("page_id") % 9).cast("string"), F.lit("</b> </p> c")).alias("summary"))
    path = _folder(p)
    p.write.format("xml").option("rootTag", "feed").option("rowTag", "entry").save(path)
    a = readers.read_atom(p.sparkSession, path, "id string, title string, summary string")
    return a.select(F.col("id").cast("long").alias("page_id"), "title", readers.xml_text(F.col("summary")).alias("summary"))


@query("path_list", "SELECT 'crawl/' || page_id || '.warc.gz' AS path FROM pages WHERE page_id % 3 <> 0")
def _paths(t):
    """Packed lists of paths; blank lines don't count."""
    p = t("pages").select(F.when(F.col("page_id") % 3 == 0, "  ").otherwise(F.concat(F.lit("crawl/"), F.col("page_id").cast("string"), F.lit(".warc.gz"))).alias("value"))
    path = _folder(p)
    p.write.option("compression", "gzip").text(path)
    return readers.read_paths(p.sparkSession, path)


_ROOM = 100_000


@query("ordered_shards", f"WITH {DATED}, o AS (SELECT doc_id, text, date, md5('7:' || doc_id) AS h, coalesce(est_tokens, 0) AS tok FROM d), c AS (SELECT *, row_number() OVER w - 1 AS place, coalesce(sum(tok) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o WINDOW w AS (ORDER BY date, h, doc_id)) SELECT doc_id, (before // {_ROOM})::BIGINT AS shard, place::BIGINT AS place, md5(concat('Date: ', date, chr(10), text)) AS record_md5 FROM c")
def _ordered(t):
    """The training file: dated records in order of days, shuffled within each, as numbered shards; places come from the manifest."""
    d = dated(t("documents")).select("doc_id", "date", F.col("est_tokens").alias("tok"), hashed("7", F.col("doc_id")).alias("h"), F.concat(F.lit("Date: "), F.col("date"), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("record"))
    path = _folder(d)
    shards = write_ordered(d, path, ["date", "h", "doc_id"], "tok", _ROOM, F.concat("date", F.substring("h", 1, 1)))  # sixteen buckets a day of the calendar
    rows = join_checked(read_ordered(d.sparkSession, path, d.schema), shards.select(F.col("shard").alias("__of"), "rows_before"), [("shard", "__of")], F.col("row"))
    return rows.select("doc_id", F.col("shard").cast("long").alias("shard"), (F.col("rows_before") + F.col("row")).alias("place"), F.md5("record").alias("record_md5"))
