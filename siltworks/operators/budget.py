"""Caps, budgets, orders, samples and job planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.catalog import query
from ..plans.prefix import DIGITS, by_hash, by_id, hashed, prefix_sum, ranked
from ..plans.shared import ship
from ..sources.derived import DATED, dated
from .dedup import priority
from .filters import preferred


def cap_per_group(df: DataFrame, by: list[str], order: list, n: int, exempt=None) -> DataFrame:
    """The first n rows of each group; exempt rows always stay and don't count. Each task passes on n rows a group at most."""
    free = None if exempt is None else F.coalesce(exempt, F.lit(False))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    capped = (df if free is None else df.filter(~free)).withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")
    return capped if free is None else capped.unionByName(df.filter(free))


@query("domain_cap", f"WITH {DATED} SELECT doc_id, substr(date, 1, 7) AS month, source FROM d QUALIFY source = 'src1' OR row_number() OVER (PARTITION BY substr(date, 1, 7), source, source = 'src1' ORDER BY doc_id) <= 3")
def _cap(t):
    d = dated(t("documents")).select("doc_id", F.substring("date", 1, 7).alias("month"), "source")
    return cap_per_group(d, ["month", "source"], ["doc_id"], 3, F.col("source") == "src1")


def capped_pick(pdf, n: int = 40, per: int = 3):
    """The exact greedy pick of one topic: rows in order, unseen titles, at most ``per`` of a domain, ``n`` in all."""
    seen, used, keep = set(), {}, []
    for i, (title, domain) in enumerate(zip(pdf["title"], pdf["domain"], strict=True)):
        if title and title in seen:
            continue
        if used.get(domain, 0) >= per:
            continue
        seen.add(title)
        used[domain] = used.get(domain, 0) + 1
        keep.append(i)
        if len(keep) >= n:
            break
    return pdf.iloc[keep]


_SITES = ("news.example", "apnews.com", "blog.example", "bbc.co.uk", "ft.com")
_PICK = f"""WITH RECURSIVE {DATED}, c AS (SELECT doc_id % 25 AS topic, doc_id, substr(text, 1, 12) AS title, {list(_SITES)}[cast(doc_id % 5 AS INT) + 1] AS domain, date FROM d),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY domain NOT IN ('apnews.com', 'bbc.co.uk', 'ft.com'), date, doc_id) AS i FROM c),
r AS (SELECT topic, 0::BIGINT AS i, []::VARCHAR[] AS titles, []::VARCHAR[] AS domains, false AS picked, -1::BIGINT AS doc_id FROM (SELECT DISTINCT topic FROM o) UNION ALL
  SELECT topic, i, CASE WHEN ok THEN list_append(titles, title) ELSE titles END, CASE WHEN ok THEN list_append(domains, domain) ELSE domains END, ok, doc_id FROM (
    SELECT o.topic, o.i, titles, domains, title, domain, o.doc_id, len(titles) < 40 AND len(list_filter(domains, lambda x: x = domain)) < 3 AND (title = '' OR NOT list_contains(titles, title)) AS ok
    FROM r JOIN o ON o.topic = r.topic AND o.i = r.i + 1))
SELECT topic, doc_id FROM r WHERE picked"""


@query("capped_pick", _PICK)
def _pick(t):
    """Order-dependent: a repeated title doesn't use up its domain's places. A topic's candidates are a search result, so small."""
    site = F.element_at(F.array(*map(F.lit, _SITES)), (F.col("doc_id") % 5 + 1).cast("int"))
    d = dated(t("documents")).select((F.col("doc_id") % 25).alias("topic"), "doc_id", F.substring("text", 1, 12).alias("title"), site.alias("domain"), preferred(site).alias("preferred"), "date")
    schema = d.schema
    ship(d.sparkSession)

    def pick(pdf):
        return capped_pick(pdf.sort_values(["preferred", "date", "doc_id"], ascending=[False, True, True]))

    return d.groupBy("topic").applyInPandas(pick, schema).select("topic", "doc_id")


@query("balanced_pick", "SELECT doc_id, toxic FROM labels QUALIFY row_number() OVER (PARTITION BY toxic ORDER BY doc_id) <= 10")
def _balanced(t):
    return cap_per_group(t("labels").select("doc_id", "toxic"), ["toxic"], ["doc_id"], 10)


_H = "md5('0:' || doc_id)"


@query("budget_take", f"WITH k AS (SELECT doc_id, length(text) // 4 AS tok, {_H} AS h FROM documents), c AS (SELECT *, coalesce(sum(tok) OVER (ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cum FROM k) SELECT doc_id, tok::BIGINT AS tok, cum FROM c WHERE cum < 100000")
def _take(t):
    k = t("documents").select("doc_id", X.est_tokens(F.col("text")).alias("tok"), hashed("0", F.col("doc_id")).alias("h"))
    return prefix_sum(k, "h", "tok", ["h", "doc_id"]).filter("cum < 100000").select("doc_id", "tok", "cum")


def budget_trim(rows: DataFrame, budget: int, token: str = "est_tokens", stream: str = "stream", never: str = "deaths", seed: str = "0") -> DataFrame:
    """Drops whole rows of the least important streams first, in hashed order, until the total is within the budget.

    One prefix sum over (priority descending, hash) equals the loop that takes stream after stream, as a stream is either
    used up or ends it.
    """
    k = rows.withColumn("__h", hashed(seed, F.col("doc_id"))).withColumn("__p", priority(F.col(stream)))
    total = k.agg(F.coalesce(F.sum(token), F.lit(0)).alias("__all"))
    k = k.withColumn("__key", F.concat(F.lpad((9 - F.col("__p")).cast("string"), 1, "0"), F.substring("__h", 1, DIGITS)))
    may = prefix_sum(k.filter(F.col(stream) != never), "__key", token, ["__h", "doc_id"], "__cum", bucket=F.col("__key"))
    may = may.crossJoin(F.broadcast(total)).filter(F.col("__cum") >= F.col("__all") - budget)  # the total is one row
    return k.filter(F.col(stream) == never).select(*rows.columns).unionByName(may.select(*rows.columns))


@query("budget_trim", f"WITH {DATED}, k AS (SELECT *, {_H} AS h, CASE stream WHEN 'deaths' THEN 0 WHEN 'wiki' THEN 1 WHEN 'hn' THEN 2 WHEN 'docs' THEN 3 ELSE 9 END AS p, sum(est_tokens) OVER () AS al FROM d), c AS (SELECT *, CASE WHEN stream <> 'deaths' THEN coalesce(sum(est_tokens) OVER (PARTITION BY stream = 'deaths' ORDER BY p DESC, h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS cum FROM k) SELECT doc_id, stream FROM c WHERE stream = 'deaths' OR cum >= al - 300000")
def _trim(t):
    return budget_trim(dated(t("documents")), 300_000).select("doc_id", "stream")


def cyclic_fill(pool: DataFrame, budget, key: str, value: str, order: list[str], most: int | None = 51) -> DataFrame:
    """The pool repeated in its own order until the running total reaches ``budget`` (a one-row DataFrame with column goal), at most ``most`` times; a pool that adds up to nothing stays empty where there is no such bound."""
    one = prefix_sum(pool, key, value, order, "__cum")
    total = pool.agg(F.coalesce(F.sum(value), F.lit(0)).alias("__one"))
    out = one.crossJoin(F.broadcast(total.crossJoin(budget)))  # one row
    reps = F.ceil(F.col("goal") / F.greatest(F.col("__one"), F.lit(1)))
    if most is None:
        out = out.filter("__one > 0")
    else:
        reps = F.least(F.lit(most), reps)
    out = out.withColumn("rep", F.explode(F.sequence(F.lit(0), F.greatest(reps.cast("int"), F.lit(1)) - 1)))
    return out.filter(F.col("rep") * F.col("__one") + F.col("__cum") < F.col("goal")).drop("__cum", "__one", "goal")


@query("replay_mix", f"WITH k AS (SELECT doc_id, length(text) // 4 AS tok, {_H} AS h FROM documents WHERE source = 'src0'), g AS (SELECT floor(sum(length(text) // 4) * 0.25) AS goal FROM documents), c AS (SELECT *, coalesce(sum(tok) OVER (ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum, sum(tok) OVER () AS one FROM k), r AS (SELECT doc_id, cum, one, goal, unnest(range(0, 51)) AS rep FROM c, g) SELECT doc_id, rep::INT AS rep FROM r WHERE rep * one + cum < goal")
def _replay(t):
    d = t("documents").select("doc_id", "source", X.est_tokens(F.col("text")).alias("tok"), hashed("0", F.col("doc_id")).alias("h"))
    goal = d.agg(F.floor(F.sum("tok") * F.lit(0.25)).alias("goal"))
    return cyclic_fill(d.filter("source = 'src0'"), goal, "h", "tok", ["h", "doc_id"]).select("doc_id", "rep")


@query("curriculum_order", f"WITH {DATED} SELECT doc_id, date, row_number() OVER (PARTITION BY date ORDER BY md5('7:' || doc_id), doc_id) AS place FROM d")
def _curriculum(t):
    """Random within a day: the place within its day; a range-partitioned sort on (date, place) writes it out."""
    d = dated(t("documents")).select("doc_id", "date", hashed("7", F.col("doc_id")).alias("h"))
    return ranked(d, ["date"], ["h", "doc_id"], by_hash(), "place").select("doc_id", "date", F.col("place").cast("long").alias("place"))


@query("seeded_sample", f"SELECT doc_id FROM documents ORDER BY {_H}, doc_id LIMIT 50")
def _sample(t):
    return t("documents").select("doc_id", hashed("0", F.col("doc_id")).alias("h")).orderBy("h", "doc_id").limit(50).select("doc_id")


@query("stratified_sample", f"WITH {DATED}, m AS (SELECT doc_id, substr(date, 1, 7) AS month, md5('3:' || doc_id) AS h FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY h, doc_id) AS r, count(*) OVER (PARTITION BY month) AS n FROM m) SELECT doc_id, month, greatest(1, round_even(25.0::DOUBLE / least(10, n), 0))::BIGINT AS per_row FROM r WHERE r <= 10")
def _strata(t):
    m = dated(t("documents")).select("doc_id", F.substring("date", 1, 7).alias("month"), hashed("3", F.col("doc_id")).alias("h"))
    size = m.groupBy(F.col("month").alias("__m")).agg(F.count("*").alias("n"))
    out = cap_per_group(m, ["month"], ["h", "doc_id"], 10).join(size, F.col("month") == F.col("__m"))
    return out.select("doc_id", "month", F.greatest(F.lit(1), F.bround(F.lit(25.0) / F.least(F.lit(10), F.col("n")))).cast("long").alias("per_row"))


@query("round_robin", "SELECT conv_id, turn, ['news','memo','faq','letter','profile'][cast((conv_id * 7 + turn) % 5 AS INT) + 1] AS kind FROM conversations")
def _robin(t):
    kinds = F.array(*[F.lit(x) for x in ("news", "memo", "faq", "letter", "profile")])
    return t("conversations").select("conv_id", "turn", F.element_at(kinds, F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(5)).cast("int") + 1).alias("kind"))


@query("group_chunk", f"WITH {DATED}, a AS (SELECT doc_id, date, row_number() OVER (PARTITION BY date ORDER BY doc_id) - 1 AS i FROM d WHERE stream <> 'deaths') SELECT date, (i // 2)::BIGINT AS chunk, count(*)::BIGINT AS n, min(doc_id) AS first_id FROM a GROUP BY 1, 2")
def _chunk(t):
    a = ranked(dated(t("documents")).filter("stream <> 'deaths'").select("doc_id", "date"), ["date"], ["doc_id"], by_id())
    return a.withColumn("chunk", F.expr("cast((rank - 1) div 2 as bigint)")).groupBy("date", "chunk").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("group_context", f"WITH {DATED} SELECT date, chunk::BIGINT AS chunk, md5(string_agg(x, chr(10) || '---' || chr(10) ORDER BY o, doc_id)) AS context_md5, count(*)::BIGINT AS n FROM (SELECT date, doc_id, doc_id % 9 <> 0 AS o, (row_number() OVER (PARTITION BY date ORDER BY doc_id % 9 <> 0, doc_id) - 1) // 4 AS chunk, CASE WHEN doc_id % 9 = 0 THEN substr(text, 1, 2500) ELSE substr(text, 1, 2000) END AS x FROM d) GROUP BY date, chunk")
def _context(t):
    """Contexts of a day, four texts each: its summaries first, then its articles, cut and joined in order."""
    d = dated(t("documents")).select("date", (F.col("doc_id") % 9 != 0).alias("o"), "doc_id", F.when(F.col("doc_id") % 9 == 0, F.substring("text", 1, 2500)).otherwise(F.substring("text", 1, 2000)).alias("x"))
    d = ranked(d, ["date"], ["o", "doc_id"], F.struct("o", by_id())).withColumn("chunk", F.expr("cast((rank - 1) div 4 as bigint)"))
    g = d.groupBy("date", "chunk").agg(F.sort_array(F.collect_list(F.struct("o", "doc_id", "x"))).alias("xs"), F.count("*").alias("n"))
    return g.select("date", "chunk", F.md5(F.array_join(F.transform("xs", lambda s: s["x"]), "\n---\n")).alias("context_md5"), "n")


@query("regroup", "WITH r AS (SELECT unnest([0, 1]) AS rd), k AS (SELECT rd, doc_id, source, row_number() OVER (PARTITION BY rd, source ORDER BY md5('5:' || rd || ':' || doc_id), doc_id) - 1 AS i FROM documents, r) SELECT rd::INT AS rd, source, doc_id, (i // 4)::BIGINT AS grp FROM k")
def _regroup(t):
    """Rotating groups: a new shuffle within each category a round, cut by four."""
    d = t("documents").select("doc_id", "source", F.explode(F.array(F.lit(0), F.lit(1))).alias("rd"))
    d = d.withColumn("h", F.md5(F.concat(F.lit("5:"), F.col("rd").cast("string"), F.lit(":"), F.col("doc_id").cast("string"))))
    return ranked(d, ["rd", "source"], ["h", "doc_id"], by_hash()).select("rd", "source", "doc_id", F.expr("cast((rank - 1) div 4 as bigint)").alias("grp"))


@query("oversample_share", "WITH p AS (SELECT doc_id, doc_id % 4 = 0 AS tool, row_number() OVER (PARTITION BY doc_id % 4 = 0 ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY doc_id % 4 = 0) AS n FROM documents), c AS (SELECT unnest(range(0, 200)) AS call) SELECT call, a.doc_id AS lead_id, b.doc_id AS with_id FROM c JOIN p a ON a.tool = (call % 5 < 3) AND a.i = call % a.n JOIN p b ON NOT b.tool AND b.i = (call * 7 + 1) % b.n")
def _oversample(t):
    """Three of five calls lead with a tool page; each is paired with a page that isn't one. Pages get places, and only those called for are fetched."""
    p = ranked(t("documents").select("doc_id", (F.col("doc_id") % 4 == 0).alias("tool")), ["tool"], ["doc_id"], by_id(), "i")
    n = p.groupBy("tool").agg(F.max("i").alias("n"))
    calls = p.sparkSession.range(200).withColumnRenamed("id", "call")
    wanted = lambda c, tool, place: c.withColumn("tool", tool).join(F.broadcast(n), "tool").withColumn("i", place + 1)  # noqa: E731  (two totals)
    fetch = lambda w, name: p.join(F.broadcast(w.select("call", "tool", "i")), ["tool", "i"]).select("call", F.col("doc_id").alias(name))  # noqa: E731  (the calls)
    lead = fetch(wanted(calls, F.col("call") % 5 < 3, F.col("call") % F.col("n")), "lead_id")
    return lead.join(fetch(wanted(calls, F.lit(False), (F.col("call") * 7 + 1) % F.col("n")), "with_id"), "call")


_CRC = """tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)))"""


@query("hash_route", f"WITH {_CRC}, s AS (SELECT doc_id, list_concat([4294967295], list_transform(string_split('call-' || doc_id, ''), lambda x: ord(x)::BIGINT)) AS b FROM documents) SELECT doc_id, (xor(list_reduce(b, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 3)::INT AS model FROM s, tab")
def _route(t):
    """By crc32, which the other engine spells out from its polynomial."""
    return t("documents").select("doc_id", F.pmod(F.crc32(F.concat(F.lit("call-"), F.col("doc_id").cast("string")).cast("binary")), F.lit(3)).cast("int").alias("model"))


def replicate(df: DataFrame, n: int, copy: str = "copy") -> DataFrame:
    """Each row n times, numbered from 0; a narrow pass."""
    return df.withColumn(copy, F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else df.withColumn(copy, F.lit(0)).limit(0)


@query("replicate", "SELECT page_id, c.copy::INT AS copy, url || chr(10) || chr(10) || length(html) AS text FROM pages, (SELECT unnest(range(0, 3)) AS copy) c")
def _replicate(t):
    p = t("pages").select("page_id", F.concat("url", F.lit("\n\n"), F.length("html").cast("string")).alias("text"))
    return replicate(p, 3).select("page_id", "copy", "text")


@query("replay_cycle", f"WITH k AS (SELECT doc_id, length(text) AS q, {_H} AS h FROM documents WHERE source = 'src1'), g AS (SELECT sum(length(text)) * 0.35::DOUBLE AS goal FROM documents), c AS (SELECT *, coalesce(sum(q) OVER (ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum, sum(q) OVER () AS one FROM k), r AS (SELECT doc_id, cum, one, goal, unnest(range(0, 1000)) AS rep FROM c, g) SELECT doc_id, rep::INT AS rep FROM r WHERE rep * one + cum < goal")
def _cycle(t):
    """The pool over and over in its one order until a share of all tokens is reached, however often that takes; quarters of characters add up exactly as characters."""
    d = t("documents").select("doc_id", "source", F.length("text").cast("long").alias("q"), hashed("0", F.col("doc_id")).alias("h"))
    goal = d.agg((F.sum("q") * F.lit(0.35)).alias("goal"))
    return cyclic_fill(d.filter("source = 'src1'"), goal, "h", "q", ["h", "doc_id"], most=None).select("doc_id", "rep")
