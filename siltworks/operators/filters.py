"""Filters and scalar projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..plans.catalog import lit, query
from ..plans.shared import spread
from ..sources.derived import DATED, URL, dated

FLOORS = {"deaths": 40}


def length_between(c: Column, low: int, high: int | None = None) -> Column:
    """Inclusive bounds in code points."""
    return (F.length(c) >= low) if high is None else F.length(c).between(low, high)


def stream_floor(stream: Column, default: int = 350) -> Column:
    """The least length of a stream's texts."""
    out = F.lit(default)
    for k, v in FLOORS.items():
        out = F.when(stream == k, F.lit(v)).otherwise(out)
    return out


def date_window(docs: DataFrame, low: str, high: str, undated: bool = True, date_col: str = "date") -> DataFrame:
    """Inclusive lexical window; rows without a date stay if ``undated``."""
    d = F.coalesce(F.col(date_col), F.lit(""))
    return docs.filter(((d == "") & F.lit(undated)) | d.between(low, high) & (d != ""))


@query("est_tokens", "SELECT doc_id, (length(text) // 4)::BIGINT AS est, greatest(1, length(text) // 4)::BIGINT AS est_least_1, length(text) / 4.0::DOUBLE AS est_float FROM documents")
def _est(t):
    return t("documents").select("doc_id", X.est_tokens(F.col("text")).alias("est"), F.greatest(X.est_tokens(F.col("text")), F.lit(1).cast("long")).alias("est_least_1"), (F.length("text") / F.lit(4.0)).alias("est_float"))


@query("length_filter", f"WITH {DATED} SELECT doc_id, stream, length(text)::BIGINT AS n FROM d WHERE length(text) BETWEEN (CASE WHEN stream = 'deaths' THEN 40 ELSE 350 END) AND 24000")
def _length(t):
    d = dated(t("documents"))
    return d.filter(length_between(F.col("text"), 0, 24000) & (F.length("text") >= stream_floor(F.col("stream")))).select("doc_id", "stream", F.length("text").cast("long").alias("n"))


@query("lang_filter", "SELECT doc_id, source FROM documents WHERE lang = 'en'")
def _lang(t):
    return t("documents").filter("lang = 'en'").select("doc_id", "source")


def lang_vote(words: Column) -> Column:
    """The language whose frequent words a text has most of, and how many; ties go to the first listed, no vote is `und`. ``words`` must be a plain column."""
    among = lambda listed: F.size(F.filter(words, lambda w: w.isin(*listed)))
    n = [among(v) for v in P.FREQUENT.values()]
    best = F.greatest(*n)
    lang = F.when(best == 0, "und")
    for k, c in zip(P.FREQUENT, n, strict=True):
        lang = lang.when(c == best, k)
    return F.struct(lang.alias("lang"), best.cast("long").alias("votes"))


_VOTES = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(map(lit, v))}))) AS n_{k}" for k, v in P.FREQUENT.items())
_BEST = f"greatest({', '.join(f'n_{k}' for k in P.FREQUENT)})"


@query("lang_vote", rf"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{{L}}+') AS w FROM documents), n AS (SELECT doc_id, {_VOTES} FROM w) SELECT doc_id, CASE WHEN {_BEST} = 0 THEN 'und' {' '.join(f"WHEN n_{k} = {_BEST} THEN '{k}'" for k in P.FREQUENT)} END AS lang, {_BEST}::BIGINT AS votes FROM n")
def _vote(t):
    """A language filter that reads the text: over whole texts, by built-in expressions alone."""
    w = spread(t("documents").select("doc_id", "text")).select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)).alias("w"))
    return w.select("doc_id", lang_vote(F.col("w")).alias("v")).select("doc_id", "v.lang", "v.votes")


@query("url_domain", r"SELECT page_id, CASE WHEN contains(url, '://') THEN split_part(url, '/', 3) ELSE '' END AS domain, lower(replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), 'www.', '')) AS host FROM pages")
def _domain(t):
    return t("pages").select("page_id", X.url_domain(F.col("url")).alias("domain"), X.url_host(F.col("url")).alias("host"))


_U = URL.format(s="VARCHAR")


@query("url_canonical", f"SELECT regexp_replace(split_part({_U}, '?', 1), '/+$', '') AS canonical, count(*)::BIGINT AS n, min(page_id) AS first_id FROM pages GROUP BY 1")
def _canonical(t):
    return t("pages").select("page_id", X.url_canonical(F.expr(URL.format(s="STRING"))).alias("canonical")).groupBy("canonical").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"))


#: The test tables' hosts are made up, so every seventh page stands for a known outlet or spam network.
_SITE = "CASE page_id % 7 WHEN 0 THEN 'https://www.reuters.com/world/a' WHEN 1 THEN 'https://www.marketbeat.com/x' WHEN 2 THEN 'https://youtu.be/abc' ELSE url END"
_TITLE = "CASE page_id % 5 WHEN 0 THEN 'Acme Trims Stock Position' WHEN 1 THEN 'Trading Up 3.5% today' ELSE 'Rain in Spain' END"


@query("domain_block", f"SELECT page_id, {_SITE} AS site FROM pages WHERE NOT regexp_matches({_SITE}, {lit(P.DOMAIN_BLOCK)}) AND NOT regexp_matches({_SITE}, {lit(P.SKIP_URL)}) AND NOT regexp_matches({_TITLE}, {lit(P.TITLE_BLOCK)})")
def _block(t):
    s = t("pages").select("page_id", F.expr(_SITE).alias("site"), F.expr(_TITLE).alias("title"))
    return s.filter(~F.col("site").rlike(P.DOMAIN_BLOCK) & ~F.col("site").rlike(P.SKIP_URL) & ~F.col("title").rlike(P.TITLE_BLOCK)).select("page_id", "site")


@query("source_tier", f"SELECT page_id, CASE WHEN regexp_matches({_SITE}, {lit(P.TIER_A)}) THEN 'A' ELSE 'B' END AS tier FROM pages")
def _tier(t):
    return t("pages").select("page_id", F.when(F.expr(_SITE).rlike(P.TIER_A), "A").otherwise("B").alias("tier"))


@query("tokenize", r"WITH k AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS a, regexp_extract_all(lower(text), '[a-z0-9_]+') AS b FROM documents) SELECT doc_id, len(a)::BIGINT AS n_plain, len(b)::BIGINT AS n_under, len(list_distinct(a))::BIGINT AS n_distinct, a[1] AS first_token FROM k")
def _tokenize(t):
    k = t("documents").select("doc_id", X.tokens(F.col("text")).alias("a"), X.tokens(F.col("text"), "[a-z0-9_]+").alias("b"))
    return k.select("doc_id", F.size("a").cast("long").alias("n_plain"), F.size("b").cast("long").alias("n_under"), F.size(F.array_distinct("a")).cast("long").alias("n_distinct"), F.get("a", F.lit(0)).alias("first_token"))


@query("temporal_split", f"WITH {DATED}, e AS (SELECT *, CASE WHEN doc_id % 10 = 0 THEN '' ELSE date END AS dd FROM d) SELECT doc_id, CASE WHEN dd = '' OR dd <= '2026-04-30' THEN 'train' ELSE 'held-out' END AS part FROM e WHERE dd = '' OR dd BETWEEN '2026-02-01' AND '2026-06-30'")
def _split(t):
    d = dated(t("documents")).withColumn("dd", F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("date")))
    d = date_window(d, "2026-02-01", "2026-06-30", date_col="dd")
    return d.select("doc_id", F.when((F.col("dd") == "") | (F.col("dd") <= "2026-04-30"), "train").otherwise("held-out").alias("part"))


@query("iso_dates", "SELECT event_id, strftime(make_timestamp((1750000000 + event_id % 1000 * 86400) * 1000000), '%Y-%m-%d') AS from_epoch, strftime(date_trunc('month', ts), '%Y-%m') AS month FROM events")
def _iso(t):
    return t("events").select("event_id", iso_date((F.lit(1750000000) + F.col("event_id") % 1000 * 86400).cast("string")).alias("from_epoch"), F.date_format("ts", "yyyy-MM").alias("month"))


def iso_date(c: Column) -> Column:
    """Epoch seconds (within 9.4e8 .. 2.2e9) or a text that starts with an ISO date; null else."""
    n = c.try_cast("double")
    return F.coalesce(F.when((n > 9.4e8) & (n < 2.2e9), F.date_format(F.timestamp_seconds(n), "yyyy-MM-dd")), F.nullif(F.regexp_extract(c, r"^\d{4}-\d{2}-\d{2}", 0), F.lit("")))


def long_enough(text: Column, site: str) -> Column:
    """A text's least length at one of the places that set one (fixed values)."""
    n, included = P.LEAST[site]
    return F.length(text) >= n if included else F.length(text) > n


@query("min_lengths", "SELECT doc_id, " + ", ".join(f"length(text) {'>=' if i else '>'} {n} AS {k}_ok" for k, (n, i) in P.LEAST.items()) + " FROM documents")
def _least(t):
    return t("documents").select("doc_id", *[long_enough(F.col("text"), k).alias(f"{k}_ok") for k in P.LEAST])


@query("temporal_strict", f"WITH {DATED}, e AS (SELECT *, CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 10 = 1 THEN '' ELSE date END AS dd FROM d) SELECT doc_id, dd FROM e WHERE dd BETWEEN '2026-02-01' AND '2026-06-30'")
def _strict(t):
    """The window that drops what has no date."""
    d = dated(t("documents")).withColumn("dd", F.when(F.col("doc_id") % 10 == 0, None).when(F.col("doc_id") % 10 == 1, "").otherwise(F.col("date")))
    return date_window(d, "2026-02-01", "2026-06-30", undated=False, date_col="dd").select("doc_id", "dd")


def dated_rows(docs: DataFrame, date: str, published: str, text: str) -> DataFrame:
    """Rows with a text and a date of the form YYYY-MM-DD, the first ten characters of the date or else of the time of publication."""
    d = F.substring(F.coalesce(F.nullif(F.col(date), F.lit("")), F.col(published), F.lit("")), 1, 10)
    return docs.withColumn(date, d).filter((F.coalesce(F.col(text), F.lit("")) != "") & F.col(date).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"))


_VD = "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '2026-1-5' WHEN 3 THEN concat(date, 'T10:00:00Z') ELSE date END"


@query("valid_dates", rf"WITH {DATED}, e AS (SELECT doc_id, text, substr(coalesce(nullif({_VD}, ''), CASE WHEN doc_id % 2 = 0 THEN date || ' 09:00' END, ''), 1, 10) AS date FROM d) SELECT doc_id, date FROM e WHERE coalesce(text, '') <> '' AND regexp_matches(date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')")
def _valid(t):
    d = dated(t("documents")).withColumn("published", F.when(F.col("doc_id") % 2 == 0, F.concat("date", F.lit(" 09:00")))).withColumn("date", F.expr(_VD))
    return dated_rows(d, "date", "published", "text").select("doc_id", "date")


def preferred(host: Column) -> Column:
    return host.isin(*P.PREFERRED)


@query("preferred_outlet", f"SELECT page_id, lower(replace(regexp_extract({_SITE}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), 'www.', '')) IN ({', '.join(map(lit, P.PREFERRED))}) AS preferred FROM pages")
def _preferred(t):
    return t("pages").select("page_id", preferred(X.url_host(F.expr(_SITE))).alias("preferred"))
