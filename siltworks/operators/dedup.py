"""Ordered keep-one deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..plans.catalog import query
from ..plans.components import components
from ..plans.shared import cut, ship
from ..sources.derived import DATED, URL, dated


def prefix_key(text: Column, n: int = 400) -> Column:
    """Key of near copies: the first n characters, then lower-cased with single spaces."""
    return F.md5(X.squeeze(F.lower(F.substring(text, 1, n))))


def title_key(title: Column) -> Column:
    """Letters, digits and spaces of a title, 70 at most; empty where nothing is left."""
    return F.substring(X.strip(F.regexp_replace(F.lower(title), "[^a-z0-9 ]", "")), 1, 70)


def first_by(df: DataFrame, keys: list[str], order: list, mark: str | None = None) -> DataFrame:
    """The first row of each key by ``order``; with ``mark``, all rows and whether they are that row.

    Only keys and order columns go through the least-row aggregate and its join, which combine on the map side and split
    under skew, so a key that holds a third of the rows is no hot task. Needs ``order`` to be unique within a key.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    t = df.withColumn("__o", F.struct(*cols))
    least = t.groupBy(*keys).agg(F.min("__o").alias("__least"))
    right = least.select(*[F.col(k).alias(f"__{k}") for k in keys], "__least")
    on = F.lit(True)
    for k in keys:
        on = on & t[k].eqNullSafe(right[f"__{k}"])
    out = t.join(right, on, "left").withColumn("__first", F.col("__o").eqNullSafe(F.col("__least")))
    drop = ["__o", "__least", *[f"__{k}" for k in keys]]
    return out.drop(*drop).withColumnRenamed("__first", mark) if mark else out.filter("__first").drop(*drop, "__first")


#: Rounds after which small groups of conflicting rows are replayed at once, and how many rows such a group may have.
ROUNDS, AT_ONCE = 5, 50_000


def replayed(left: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows (id, o, keys) that stay of small connected groups, each replayed by the plain loop in one task, and the rows of other groups."""
    links = None
    for k in keys:
        some = left.filter(F.col(k) != "").select(F.col("id").alias("a"), F.col(k).alias("k"))
        own = some.join(some.groupBy("k").agg(F.min("a").alias("b")), "k").select("a", "b")
        links = own if links is None else links.unionByName(own)
    comp = components(links).withColumnRenamed("id", "c_id")
    t = left.join(comp, F.col("id") == F.col("c_id"), "left").withColumn("c", F.coalesce("comp", "id"))
    t = cut(t.select("id", "o", "c", *keys))
    few = t.groupBy("c").agg(F.count("*").alias("n")).filter(F.col("n") <= AT_ONCE).select("c")
    small = t.join(few, "c")
    parts = [f"o{i}" for i in range(len(left.schema["o"].dataType.fields))]
    flat = small.select("id", "c", *keys, *[F.col("o")[f.name].alias(p) for f, p in zip(left.schema["o"].dataType.fields, parts, strict=True)])

    def loop(pdf):
        seen, stays = [set() for _ in keys], []
        for row in pdf.sort_values(parts, na_position="first").itertuples(index=False):
            own = [getattr(row, k) for k in keys]
            if any(k and k in s for k, s in zip(own, seen, strict=True)):
                continue
            for k, s in zip(own, seen, strict=True):
                if k:
                    s.add(k)
            stays.append(row.id)
        return pdf[pdf["id"].isin(stays)][["id"]]

    ship(left.sparkSession)
    now = flat.groupBy("c").applyInPandas(loop, f"id {left.schema['id'].dataType.simpleString()}")
    return cut(left.join(now, "id", "left_semi")), cut(t.join(few, "c", "left_anti").select("id", "o", *keys))


def greedy_priority(rows: DataFrame, order: list[str], keys: list[str]) -> DataFrame:
    """Exact greedy replay: a row stays iff no earlier row that stays shares one of its non-empty keys.

    Each round keeps every undecided row without an earlier undecided conflict, then drops what conflicts with kept rows;
    rounds are cut by checkpoints. After ROUNDS of them long chains of conflicts that lie in small groups are replayed at
    once, so only chains through very large groups take a round a link. Adds ``stays``.
    """
    n, done = len(keys), 0
    left = cut(rows.select("id", F.struct(*order).alias("o"), *keys))
    kept = None
    while left.limit(1).count():
        done += 1
        if done == ROUNDS:
            now, left = replayed(left, keys)
            kept = now if kept is None else kept.unionByName(now)
            continue
        t = left
        for i, k in enumerate(keys):
            least = left.filter(F.col(k).isNotNull() & (F.col(k) != "")).groupBy(F.col(k).alias(f"__k{i}")).agg(F.min("o").alias(f"__o{i}"))
            t = t.join(least, F.col(k) == F.col(f"__k{i}"), "left")
        clear = F.lit(True)
        for i in range(n):
            clear = clear & (F.col(f"__o{i}").isNull() | (F.col(f"__o{i}") == F.col("o")))
        now = cut(t.filter(clear).select("id", "o", *keys))
        kept = now if kept is None else kept.unionByName(now)
        rest = left.join(now.select("id"), "id", "left_anti")
        for k in keys:
            rest = rest.join(now.filter(F.col(k) != "").select(k).distinct(), k, "left_anti")
        left = cut(rest.select("id", "o", *keys))
    kept = kept.select("id") if kept is not None else left.select("id")
    return rows.join(kept.withColumn("stays", F.lit(True)), "id", "left").withColumn("stays", F.coalesce("stays", F.lit(False)))


_K = r"md5(regexp_replace(regexp_replace(lower(substr(text, 1, 400)), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'))"
_PRIO = "CASE stream WHEN 'deaths' THEN 0 WHEN 'wiki' THEN 1 WHEN 'hn' THEN 2 WHEN 'docs' THEN 3 ELSE 9 END"


def priority(stream: Column) -> Column:
    out = F.lit(P.UNKNOWN_PRIORITY)
    for k, v in P.STREAMS.items():
        out = F.when(stream == k, v).otherwise(out)
    return out


@query("dedup_prefix_key", f"SELECT doc_id, {_K} AS k FROM documents")
def _key(t):
    return t("documents").select("doc_id", prefix_key(F.col("text")).alias("k"))


@query("dedup_first", f"SELECT doc_id, {_K} AS k FROM documents QUALIFY row_number() OVER (PARTITION BY {_K} ORDER BY doc_id) = 1")
def _first(t):
    return first_by(t("documents").select("doc_id", prefix_key(F.col("text")).alias("k")), ["k"], ["doc_id"])


@query("dedup_last", "SELECT max(doc_id) AS doc_id, source FROM documents GROUP BY source")
def _last(t):
    return first_by(t("documents").select("doc_id", "source"), ["source"], [-F.col("doc_id")])


_U = URL.format(s="VARCHAR")


@query("dedup_best", f"WITH p AS (SELECT page_id, regexp_replace(split_part({_U}, '?', 1), '/+$', '') AS u, CASE WHEN page_id % 6 = 0 THEN NULL ELSE page_id * 37 % 11 END AS points FROM pages) SELECT page_id, u, coalesce(points, 0)::BIGINT AS points FROM p QUALIFY row_number() OVER (PARTITION BY u ORDER BY coalesce(points, 0) DESC, page_id) = 1")
def _best(t):
    p = t("pages").select("page_id", X.url_canonical(F.expr(URL.format(s="STRING"))).alias("u"), F.coalesce(F.when(F.col("page_id") % 6 != 0, F.col("page_id") * 37 % 11), F.lit(0)).cast("long").alias("points"))
    return first_by(p, ["u"], [-F.col("points"), "page_id"])


def _linked(t):
    d = dated(t("documents"))
    url = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("https://h.example/"), (F.col("doc_id") % 600).cast("string"), F.lit("?utm=1")))
    return d.select(F.col("doc_id").alias("id"), "stream", priority(F.col("stream")).alias("prio"), prefix_key(F.col("text")).alias("tk"), X.url_canonical(url).alias("uk"))


@query("dedup_priority", f"WITH {DATED}, k AS (SELECT doc_id, stream, {_PRIO} AS prio, {_K} AS tk, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'https://h.example/' || (doc_id % 600) END AS uk FROM d), a AS (SELECT *, row_number() OVER (PARTITION BY tk ORDER BY prio, doc_id) AS r FROM k), b AS (SELECT *, CASE WHEN r > 1 THEN 'dup_text' WHEN uk <> '' AND row_number() OVER (PARTITION BY r > 1, uk ORDER BY prio, doc_id) > 1 THEN 'dup_url' ELSE 'kept' END AS reason FROM a) SELECT doc_id, stream, reason FROM b")
def _two_pass(t):
    """The two-pass form: text keys, then URLs of what is left. dedup_priority_exact replays the greedy order."""
    k = first_by(_linked(t), ["tk"], ["prio", "id"], mark="a")
    k = first_by(k, ["a", "uk"], ["prio", "id"], mark="b")
    return k.select(F.col("id").alias("doc_id"), "stream", F.when(~F.col("a"), "dup_text").when((F.col("uk") != "") & ~F.col("b"), "dup_url").otherwise("kept").alias("reason"))


#: The loop itself, a row a step.
_GREEDY = f"""WITH RECURSIVE {DATED}, k AS (SELECT doc_id, stream, {_PRIO} AS prio, {_K} AS tk, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'https://h.example/' || (doc_id % 600) END AS uk FROM d),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY prio, doc_id) AS i FROM k),
r AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS seen, false AS stays, NULL::BIGINT AS doc_id, NULL::VARCHAR AS stream UNION ALL
  SELECT i, CASE WHEN ok THEN list_concat(seen, CASE WHEN uk = '' THEN [tk] ELSE [tk, uk] END) ELSE seen END, ok, doc_id, stream FROM (
    SELECT o.i, seen, tk, uk, o.doc_id, o.stream, NOT list_contains(seen, tk) AND (uk = '' OR NOT list_contains(seen, uk)) AS ok FROM r JOIN o ON o.i = r.i + 1))
SELECT doc_id, stream, stays FROM r WHERE i > 0"""


@query("dedup_priority_exact", _GREEDY)
def _exact(t):
    return greedy_priority(_linked(t), ["prio", "id"], ["tk", "uk"]).select(F.col("id").alias("doc_id"), "stream", "stays")


@query("title_dedup", r"WITH s AS (SELECT page_id, substr(regexp_replace(regexp_replace(lower(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)), '[^a-z0-9 ]', '', 'g'), '^\s+|\s+$', '', 'g'), 1, 70) AS k FROM pages) SELECT page_id, k FROM s QUALIFY k = '' OR row_number() OVER (PARTITION BY k ORDER BY page_id) = 1")
def _title(t):
    s = t("pages").select("page_id", title_key(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title", 1)).alias("k"))
    return first_by(s, ["k"], ["page_id"], mark="f").filter((F.col("k") == "") | F.col("f")).select("page_id", "k")


def news_key(title: Column, text: Column) -> Column:
    """Key of near copies among news: title and first 300 characters, each lower-cased with single spaces."""
    part = lambda c: X.squeeze(F.lower(F.coalesce(c, F.lit(""))))
    return F.md5(F.concat(part(title), F.lit("|"), part(F.substring(text, 1, 300))))


def dedup_then_cap(rows: DataFrame, order: list[str], key: str, group: str, capped: Column, cap: int) -> DataFrame:
    """Exact replay of: drop a row whose key a row that stays has; else, of capped rows, drop one whose group has ``cap`` that stay.

    A dropped row uses up neither a key nor a place. Each round decides, of the undecided rows, those at the head of their
    group as far as they are the first of their key (and the group has room), and the uncapped that are the first of their
    key; then what shares a key with them, and the rest of full groups. Rounds are cut by checkpoints; within a group one round
    takes all rows up to the first that waits for another group. A null key is no key: its row is like no other. Needs ``order``
    to be unique, and raises where a round decides nothing because it isn't; adds ``stays``.
    """
    own = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.concat(F.lit("o"), F.to_json(F.struct(*order))))
    left = cut(rows.select(F.struct(*order).alias("o"), own.alias("k"), F.col(group).alias("g"), F.coalesce(capped, F.lit(False)).alias("b"), F.lit(cap).alias("room")).filter("not b or room > 0"))
    kept = None
    while left.limit(1).count():
        least = left.groupBy("k").agg(F.min("o").alias("least"))
        t = left.join(least, "k").withColumn("clear", F.col("o") == F.col("least")).drop("least")
        waits = t.filter("b and not clear").groupBy(F.col("g").alias("wg")).agg(F.min("o").alias("wait"))
        head = t.filter("b and clear").join(waits, F.col("g").eqNullSafe(F.col("wg")), "left").filter("wait is null or o < wait")
        rank = F.row_number().over(Window.partitionBy("g").orderBy("o"))
        head = head.withColumn("r", rank).filter(F.col("r") <= cap).filter(F.col("r") <= F.col("room"))  # tasks pass on ``cap`` rows a group
        now = cut(head.select("o", "k", "g", "b").unionByName(t.filter("clear and not b").select("o", "k", "g", "b")))
        if not now.limit(1).count():
            raise ValueError("a round that decides nothing")
        kept = now.select("o") if kept is None else kept.unionByName(now.select("o"))
        used = now.filter("b").groupBy(F.col("g").alias("ug")).agg(F.count("*").cast("int").alias("used"))
        left = left.join(now.select("k").distinct(), "k", "left_anti").join(used, F.col("g").eqNullSafe(F.col("ug")), "left")
        left = left.select("o", "k", "g", "b", (F.col("room") - F.when(F.col("b"), F.coalesce("used", F.lit(0))).otherwise(0)).alias("room"))
        left = cut(left.filter("not b or room > 0"))
    done = (left.select("o") if kept is None else kept).select(F.col("o").alias("__o"), F.lit(True).alias("stays"))
    return rows.join(done, F.struct(*order) == F.col("__o"), "left").drop("__o").withColumn("stays", F.coalesce("stays", F.lit(False)))


_NT = "concat('Title ', cast(doc_id % 400 AS STR))"


def _news(t) -> DataFrame:
    d = t("documents").select("doc_id", news_key(F.expr(_NT.replace("STR", "STRING")), F.concat(F.lit("lead "), (F.col("doc_id") % 900).cast("string"))).alias("k"), "source", (F.col("doc_id") % 5 != 0).alias("tier_b"))
    return d.withColumn("domain", F.concat_ws(".", "source", (F.col("doc_id") % 7).cast("string")))


@query("news_key", r"SELECT doc_id, md5(regexp_replace(regexp_replace(lower(concat('  The  Title ', doc_id % 90)), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') || '|' || regexp_replace(regexp_replace(lower(substr(text, 1, 300)), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS k FROM documents")
def _news_key(t):
    return t("documents").select("doc_id", news_key(F.concat(F.lit("  The  Title "), (F.col("doc_id") % 90).cast("string")), F.col("text")).alias("k"))


_CAP = """WITH RECURSIVE k AS (SELECT doc_id, md5(regexp_replace('title ' || (doc_id % 400), ' +', ' ', 'g') || '|lead ' || (doc_id % 900)) AS k, concat_ws('.', source, doc_id % 7) AS domain, doc_id % 5 <> 0 AS b FROM documents),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM k),
r AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS seen, []::VARCHAR[] AS domains, false AS stays, NULL::BIGINT AS doc_id, NULL::VARCHAR AS domain UNION ALL
  SELECT i, CASE WHEN ok THEN list_append(seen, k) ELSE seen END, CASE WHEN ok AND b THEN list_append(domains, domain) ELSE domains END, ok, doc_id, domain FROM (
    SELECT o.i, seen, domains, k, b, o.doc_id, o.domain, NOT list_contains(seen, k) AND (NOT b OR len(list_filter(domains, lambda x: x = o.domain)) < 9) AS ok FROM r JOIN o ON o.i = r.i + 1))
SELECT doc_id, domain, stays FROM r WHERE i > 0"""


@query("news_dedup_cap", _CAP)
def _news_cap(t):
    """A loop over rows in order, distributed; the SQL takes a row a step."""
    return dedup_then_cap(_news(t), ["doc_id"], "k", "domain", F.col("tier_b"), 9).select("doc_id", "domain", "stays")
