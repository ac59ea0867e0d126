"""Collectors' rules: relevance, entries, listings, date plans, usage shares, leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..plans.catalog import lit, query
from ..sources.derived import DATED, dated
from .dedup import first_by

def surname(person: Column) -> Column:
    """The last word of more than one character, in lower case; the whole name where there is none."""
    parts = F.filter(F.split(F.lower(X.squeeze(person)), " "), lambda w: F.length(w) > 1)
    return F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(F.lower(person))


def relevant(person: Column, text: Column, head: int = 4000) -> Column:
    """Names the person anywhere and has a death word in its first ``head`` characters."""
    s = surname(person)
    return s.isNotNull() & F.contains(F.lower(text), F.coalesce(s, F.lit(""))) & F.substring(text, 1, head).rlike(P.DEATH)


_RT = "CASE WHEN doc_id % 3 = 0 THEN concat('He died. ', text) WHEN doc_id % 7 = 0 THEN concat('Known posthumously, after a funeral. ', text) WHEN doc_id % 7 = 1 THEN concat('A funeral; two deaths. ', text) ELSE text END"


@query("relevance_filter", rf"WITH d AS (SELECT doc_id, {_RT} AS t, CASE doc_id % 4 WHEN 1 THEN 'Ann Nowhere-Else J' WHEN 3 THEN 'E' ELSE 'Jo X Ing' END AS person FROM documents), s AS (SELECT *, coalesce(list_filter(string_split(lower(person), ' '), lambda w: length(w) > 1)[-1], lower(person)) AS sn FROM d) SELECT doc_id, sn AS surname FROM s WHERE contains(lower(t), sn) AND regexp_matches(substr(t, 1, 4000), {lit(P.DEATH)})")
def _relevance(t):
    d = t("documents").select("doc_id", F.expr(_RT).alias("t"), F.when(F.col("doc_id") % 4 == 1, "Ann Nowhere-Else J").when(F.col("doc_id") % 4 == 3, "E").otherwise("Jo X Ing").alias("person"))
    return d.filter(relevant(F.col("person"), F.col("t"))).select("doc_id", surname(F.col("person")).alias("surname"))


def entry_clean(text: Column) -> Column:
    for p, r in P.ENTRY:
        text = F.regexp_replace(text, p, r)
    return F.regexp_replace(text, r"^[ ,.;]+|[ ,.;]+$", "")


_EN = "concat('[[', coalesce(source, ''), ']], 71, [[poet|', lang, ' poet]], {{nowrap|x}} ', text, '<ref name=\"a\">b</ref><ref name=c/> ,.')"


def _duck(t: str, steps) -> str:
    for p, r in steps:
        t = f"regexp_replace({t}, {lit(p)}, {lit(r.replace('$', chr(92)))}, 'g')"
    return t


@query("entry_clean", f"SELECT doc_id, md5(regexp_replace({_duck(_EN, P.ENTRY)}, '^[ ,.;]+|[ ,.;]+$', '', 'g')) AS prose_md5 FROM documents")
def _entry(t):
    return t("documents").select("doc_id", F.md5(entry_clean(F.expr(_EN))).alias("prose_md5"))


def preamble_strip(text: Column) -> Column:
    """Drops announcing lines and opening fences at the top until none is left, then a closing fence; outer white space goes."""
    return X.strip(F.regexp_replace(X.strip(F.regexp_replace(X.strip(text), P.PREAMBLE, "")), "```$", ""))


_PR = "concat(CASE doc_id % 5 WHEN 0 THEN concat('Sure! Here it is.', chr(10), chr(10), '```text', chr(10)) WHEN 1 THEN concat('Here is an article about rain:', chr(10)) WHEN 2 THEN 'Certainly, ' WHEN 3 THEN concat('**Document**:', chr(10), ' document: ', chr(10), chr(10)) ELSE '' END, text, CASE WHEN doc_id % 5 = 0 THEN concat(chr(10), '```', chr(10)) ELSE '' END)"
_ST = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_P1 = _ST.format(f"regexp_replace(t, {lit(P.PREAMBLE)}, '')")


@query("preamble_strip", f"WITH a AS (SELECT doc_id, {_ST.format(_PR)} AS t FROM documents), b AS (SELECT doc_id, {_P1} AS t FROM a) SELECT doc_id, md5(CASE WHEN ends_with(t, '```') THEN {_ST.format('left(t, length(t) - 3)')} ELSE t END) AS clean_md5 FROM b")
def _preamble(t):
    """Whole lines only: a text that merely begins with such a word keeps it unless its line ends there."""
    return t("documents").select("doc_id", F.md5(preamble_strip(F.expr(_PR))).alias("clean_md5"))


def death_entry(line: Column) -> tuple[Column, Column]:
    """Name and cleaned rest of a list entry; null where a line is none."""
    name = F.nullif(F.regexp_extract(line, P.DEATH_ENTRY, 1), F.lit(""))
    return X.strip(name), F.when(name.isNotNull(), entry_clean(F.regexp_extract(line, P.DEATH_ENTRY, 2)))


_DE = "CASE WHEN doc_id % 4 = 0 THEN 'no entry' ELSE concat('* [[Ann ', cast(doc_id % 50 AS STR), CASE WHEN doc_id % 2 = 0 THEN '|Annie' ELSE '' END, ']], ', cast(doc_id % 90 AS STR), ', [[', lang, ']] poet, {{x}} fall.<ref name=a/>') END"


@query("death_entry", rf"WITH l AS (SELECT doc_id, {_DE.replace('STR', 'VARCHAR')} AS line FROM documents), m AS (SELECT doc_id, nullif(regexp_extract(line, {lit(P.DEATH_ENTRY)}, 1), '') AS name, regexp_extract(line, {lit(P.DEATH_ENTRY)}, 2) AS rest FROM l) SELECT doc_id, name, CASE WHEN name IS NOT NULL THEN regexp_replace({_duck('rest', P.ENTRY)}, '^[ ,.;]+|[ ,.;]+$', '', 'g') END AS rest FROM m")
def _deaths(t):
    name, rest = death_entry(F.expr(_DE.replace("STR", "STRING")))
    return t("documents").select("doc_id", name.alias("name"), rest.alias("rest"))


@query("blank_out", r"WITH l AS (SELECT doc_id, split_part(text, ' ', 3) AS k, list_filter(string_split(text, chr(10)), lambda x: length(x) > 40 AND contains(x, split_part(text, ' ', 3)))[1] AS line FROM documents) SELECT doc_id, k, replace(line, k, '________') AS cloze FROM l WHERE line IS NOT NULL AND k <> ''")
def _blank(t):
    """The first line over 40 characters that names a key, with the key blanked."""
    d = t("documents").select("doc_id", "text", F.split_part("text", F.lit(" "), F.lit(3)).alias("k"))
    d = d.select("doc_id", "k", F.get(F.filter(F.split("text", "\n"), lambda x: (F.length(x) > 40) & F.contains(x, F.col("k"))), F.lit(0)).alias("line"))
    return d.filter("line is not null and k <> ''").select("doc_id", "k", F.replace("line", F.col("k"), F.lit("________")).alias("cloze"))


@query("model_listing", f"WITH {DATED}, m AS (SELECT doc_id, source || '/' || (doc_id % 60) AS id, date, doc_id * 37 % 1000 AS downloads, doc_id * 11 % 40 AS likes FROM d) SELECT doc_id, id, downloads::BIGINT AS downloads FROM m WHERE date BETWEEN '2026-02-01' AND '2026-05-31' AND (downloads >= 500 OR likes >= 20) QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id) = 1")
def _listing(t):
    """Listed in a date window, used or liked enough, the first of an id."""
    m = dated(t("documents")).select("doc_id", F.concat(F.col("source"), F.lit("/"), (F.col("doc_id") % 60).cast("string")).alias("id"), "date", (F.col("doc_id") * 37 % 1000).alias("downloads"), (F.col("doc_id") * 11 % 40).alias("likes"))
    m = m.filter(F.col("date").between("2026-02-01", "2026-05-31") & ((F.col("downloads") >= 500) | (F.col("likes") >= 20)))
    return first_by(m, ["id"], ["doc_id"]).select("doc_id", "id", "downloads")


def month_windows(df: DataFrame, low: str, high: str) -> DataFrame:
    """One row a month between two columns of dates: month, its first day and the day after its last."""
    m = df.select(F.explode(F.expr(f"sequence(trunc({low}, 'month'), trunc({high}, 'month'), interval 1 month)")).alias("start")).distinct()
    return m.select(F.date_format("start", "yyyy-MM").alias("month"), "start", F.add_months("start", 1).alias("stop"))


@query("month_windows", "WITH r AS (SELECT min(ts)::DATE AS lo, max(ts)::DATE AS hi FROM events) SELECT strftime(m, '%Y-%m') AS month, m::DATE AS start, (m + INTERVAL 1 MONTH)::DATE AS stop FROM (SELECT unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) AS m FROM r)")
def _months(t):
    return month_windows(t("events").agg(F.min("ts").cast("date").alias("lo"), F.max("ts").cast("date").alias("hi")), "lo", "hi")


def day_range(df: DataFrame, low: str, high: str) -> DataFrame:
    """One row a day between two columns of dates, both included; none where the first is after the second."""
    return df.filter(F.col(low) <= F.col(high)).select(F.explode(F.sequence(F.to_date(low), F.to_date(high))).alias("day")).distinct()


@query("day_range", "WITH r AS (SELECT min(ts)::DATE AS lo, (min(ts)::DATE + 40) AS hi FROM events) SELECT unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM r")
def _days(t):
    r = t("events").agg(F.min("ts").cast("date").alias("lo"))
    return day_range(r.withColumn("hi", F.date_add("lo", 40)), "lo", "hi")


def split_windows(windows: DataFrame, days: int, low: str = "start", high: str = "stop") -> DataFrame:
    """Windows (dates, the second excluded) cut into windows of at most ``days``, so that each stays under a search's cap of hits."""
    w = windows.withColumn("since", F.explode(F.expr(f"sequence({low}, date_sub({high}, 1), interval {days} days)")))
    return w.withColumn("till", F.least(F.date_add("since", days), F.col(high)))


@query("split_windows", "WITH m AS (SELECT DISTINCT date_trunc('month', ts)::DATE AS start FROM events), s AS (SELECT start, (start + INTERVAL 1 MONTH)::DATE AS stop FROM m), w AS (SELECT start, unnest(generate_series(start::TIMESTAMP, (stop - 1)::TIMESTAMP, INTERVAL 5 DAY))::DATE AS since, stop FROM s), x AS (SELECT since, least(since + 5, stop)::DATE AS till FROM w) SELECT since, till, count(e.event_id)::BIGINT AS hits, count(e.event_id) > 1000 AS capped FROM x LEFT JOIN events e ON e.ts::DATE >= since AND e.ts::DATE < till GROUP BY ALL")
def _split(t):
    """Hits of each window, and whether one exceeds the cap; days are counted first, then joined by the windows' days."""
    e = t("events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    m = e.select(F.trunc("day", "month").alias("start")).distinct().withColumn("stop", F.add_months("start", 1))
    x = split_windows(m, 5).select("since", "till", F.explode(F.expr("sequence(since, date_sub(till, 1))")).alias("day"))
    return x.join(e, "day", "left").groupBy("since", "till").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("hits")).withColumn("capped", F.col("hits") > 1000)


@query("fetch_windows", f"WITH {DATED} SELECT doc_id, (date::DATE - 2)::DATE AS since, (date::DATE + 14)::DATE AS till FROM d")
def _fetch(t):
    d = dated(t("documents")).select("doc_id", F.to_date("date").alias("d"))
    return d.select("doc_id", F.date_sub("d", 2).alias("since"), F.date_add("d", 14).alias("till"))


@query("usage_share", "WITH c AS (SELECT conv_id, turn, length(text) AS n, count(*) OVER (PARTITION BY conv_id) AS kept, sum(length(text)) OVER (PARTITION BY conv_id) AS used FROM conversations) SELECT conv_id, turn, greatest(1, used // kept)::BIGINT AS tokens FROM c")
def _usage(t):
    """A call's real usage dealt over the documents kept from it; calls are aggregated, then joined back."""
    c = t("conversations").select("conv_id", "turn", F.length("text").alias("n"))
    g = c.groupBy(F.col("conv_id").alias("g")).agg(F.expr("greatest(1, sum(n) div count(*))").cast("long").alias("tokens"))
    return c.join(g, F.col("conv_id") == F.col("g")).select("conv_id", "turn", "tokens")


@query("group_lead", f"WITH {DATED} SELECT date, min_by(doc_id, doc_id) FILTER (stream = 'wiki') AS lead_id, count(*)::BIGINT AS n FROM d GROUP BY date")
def _lead(t):
    """A day's lead is its first summary; none where it has none."""
    return dated(t("documents")).groupBy("date").agg(F.min(F.when(F.col("stream") == "wiki", F.col("doc_id"))).alias("lead_id"), F.count("*").alias("n"))


@query("disagreement", f"WITH {DATED} SELECT d.doc_id, date FROM d JOIN labels l USING (doc_id) WHERE quality = 1 AND toxic = 0 AND doc_id * 37 % 101 < 50 AND substr(date, 1, 7) < '2026-04' ORDER BY doc_id LIMIT 6")
def _disagree(t):
    """Right in one mode and wrong in another, early months, the first six by id (a top-k report)."""
    d = dated(t("documents")).join(t("labels"), "doc_id").filter((F.col("quality") == 1) & (F.col("toxic") == 0) & (F.col("doc_id") * 37 % 101 < 50) & (F.substring("date", 1, 7) < "2026-04"))
    return d.orderBy("doc_id").limit(6).select("doc_id", "date")


def queue_size(done: DataFrame, target: int) -> DataFrame:
    """How many more calls reach a token target, from the mean of those done: 1.2 * (target - done) / mean + 1."""
    g = done.agg(F.sum("tokens").alias("s"), F.avg("tokens").alias("m"))
    return g.select(F.greatest(F.lit(0), F.floor(F.lit(1.2) * (F.lit(target) - F.col("s")) / F.col("m")) + 1).cast("long").alias("calls"))


@query("queue_size", "SELECT greatest(0, floor(1.2::DOUBLE * (100000000 - sum(n)) / avg(n)) + 1)::BIGINT AS calls FROM (SELECT length(text) // 4 AS n FROM documents)")
def _queue(t):
    return queue_size(t("documents").select(X.est_tokens(F.col("text")).alias("tokens")), 100_000_000)


@query("health_warning", "WITH c AS (SELECT conv_id % 2 AS arm, count(*) AS turns, count(*) FILTER (role = 'assistant') AS calls, count(*) FILTER (length(text) < 60) AS empty FROM conversations GROUP BY 1), b AS (SELECT max(calls::DOUBLE / turns) FILTER (arm = 0) AS c0, max(empty::DOUBLE / turns) FILTER (arm = 0) AS e0 FROM c) SELECT arm, round(calls::DOUBLE / turns, 6) AS calls_per_turn, round(empty::DOUBLE / turns, 6) AS empty_share, calls::DOUBLE / turns < 0.8 * c0 OR empty::DOUBLE / turns > 2 * e0 AS warns FROM c, b")
def _warning(t):
    """An arm warns when it calls under 0.8 times as often as the base, or its empty turns are over twice as many."""
    c = t("conversations").groupBy((F.col("conv_id") % 2).alias("arm")).agg((F.count_if(F.col("role") == "assistant") / F.count("*")).alias("c"), (F.count_if(F.length("text") < 60) / F.count("*")).alias("e"))
    b = c.agg(F.max(F.when(F.col("arm") == 0, F.col("c"))).alias("c0"), F.max(F.when(F.col("arm") == 0, F.col("e"))).alias("e0"))
    return c.crossJoin(F.broadcast(b)).select("arm", F.round("c", 6).alias("calls_per_turn"), F.round("e", 6).alias("empty_share"), ((F.col("c") < 0.8 * F.col("c0")) | (F.col("e") > 2 * F.col("e0"))).alias("warns"))  # one row


@query("json_slice", r"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS id FROM documents")
def _json(t):
    """The object between the first { and the last } of an answer; null where there is none or it doesn't parse."""
    a = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Sure:\n{\"id\": "), F.col("doc_id").cast("string"), F.lit(", \"x\": {}}\nDone."))).otherwise(F.col("text"))
    return t("documents").select("doc_id", F.from_json(F.regexp_extract(a, r"(?s)\{.*\}", 0), "id bigint")["id"].alias("id"))
