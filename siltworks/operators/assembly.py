"""Unions, chat records, formats, arms and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..plans.catalog import lit, query
from ..plans.prefix import hashed, prefix_sum
from ..sources.derived import DATED, TOOL, dated


@query("union_streams", f"WITH {DATED} SELECT 'docs' AS stream, doc_id AS id, date, est_tokens::BIGINT AS est_tokens FROM d UNION ALL SELECT 'pages', page_id, NULL, (length(html) // 4)::BIGINT FROM pages")
def _union(t):
    a = dated(t("documents")).select(F.lit("docs").alias("stream"), F.col("doc_id").alias("id"), "date", F.col("est_tokens").cast("long").alias("est_tokens"))
    b = t("pages").select(F.lit("pages").alias("stream"), F.col("page_id").alias("id"), X.est_tokens(F.col("html")).alias("est_tokens"))
    return a.unionByName(b, allowMissingColumns=True)


def chat_record(text: Column, date: Column) -> Column:
    """messages: array of (role, content) of a dated document."""
    before, _, after = P.DOC_PROMPT.partition("{date}")
    said = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    return F.array(said("user", F.concat(F.lit(before), date, F.lit(after))), said("assistant", text))


@query("chat_format", f"WITH {DATED} SELECT doc_id, 'user' AS role0, 'The following is a document from ' || date || ':' || chr(10) || chr(10) AS content0, 'assistant' AS role1, md5(text) AS content1_md5 FROM d")
def _chat(t):
    m = dated(t("documents")).select("doc_id", chat_record(F.col("text"), F.col("date")).alias("m"))
    g = lambda i, k: F.get("m", F.lit(i))[k]
    return m.select("doc_id", g(0, "role").alias("role0"), g(0, "content").alias("content0"), g(1, "role").alias("role1"), F.md5(g(1, "content")).alias("content1_md5"))


def variant(text: Column, question: Column, kind: str) -> Column:
    """A training text of one format: raw, doctag, qa or think."""
    if kind == "raw":
        return text
    if kind == "doctag":
        return F.concat(F.lit(P.BOS + "<DOCTAG>"), text, F.lit(P.EOS))
    mid = P.ASSISTANT + (P.THINK_OPEN if kind == "think" else P.THINK_CLOSE)
    return F.concat(F.lit(P.BOS + P.USER), question, F.lit(mid), text, F.lit(P.EOS))


_V = {"raw": "text", "doctag": f"{lit(P.BOS + '<DOCTAG>')} || text || {lit(P.EOS)}", "qa": f"{lit(P.BOS + P.USER)} || substr(text, 1, 40) || {lit(P.ASSISTANT + P.THINK_CLOSE)} || text || {lit(P.EOS)}", "think": f"{lit(P.BOS + P.USER)} || substr(text, 1, 40) || {lit(P.ASSISTANT + P.THINK_OPEN)} || text || {lit(P.EOS)}"}


@query("format_variants", " UNION ALL ".join(f"SELECT doc_id, {lit(k)} AS variant, md5({v}) AS text_md5, (length({v}) / 4.0)::DOUBLE AS est FROM documents" for k, v in _V.items()))
def _variants(t):
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), variant(F.col("text"), F.substring("text", 1, 40), k).alias("x")) for k in _V]))
    return t("documents").select("doc_id", each.alias("v")).select("doc_id", "v.variant", F.md5("v.x").alias("text_md5"), (F.length("v.x") / F.lit(4.0)).alias("est"))


def _arm(sql_kind: str, budget: float, seed: str, name: str) -> str:
    return f"SELECT doc_id, {lit(name)} AS arm, {lit(sql_kind)} AS kind FROM (SELECT doc_id, coalesce(sum(q) OVER (ORDER BY md5('{seed}:' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM (SELECT doc_id, length({_V[sql_kind]}) AS q FROM documents)) WHERE cum < {int(budget * 4)}"


_ARMS = {"v0": (("raw", 1.0),), "v1": (("doctag", 1.0),), "v4": (("doctag", 0.75), ("think", 0.25)), "v5": (("doctag", 0.75), ("qa", 0.25))}
_BUDGET = 40_000


@query("format_arms", " UNION ALL ".join(_arm(k, _BUDGET * s, str(11 + i), a) for a, parts in _ARMS.items() for i, (k, s) in enumerate(parts)))
def _arms(t):
    """Arms of one budget: all documents, or documents and question-answer forms by share. Lengths add up exactly in characters."""
    d, out = t("documents"), None
    for arm, parts in _ARMS.items():
        for i, (kind, share) in enumerate(parts):
            k = d.select("doc_id", F.length(variant(F.col("text"), F.substring("text", 1, 40), kind)).cast("long").alias("q"), hashed(str(11 + i), F.col("doc_id")).alias("h"))
            got = prefix_sum(k, "h", "q", ["h", "doc_id"]).filter(F.col("cum") < int(_BUDGET * share * 4)).select("doc_id", F.lit(arm).alias("arm"), F.lit(kind).alias("kind"))
            out = got if out is None else out.unionByName(got)
    return out


def pack_report(tokens: DataFrame, n: str, block: int) -> DataFrame:
    """Packing one document a row: rows, tokens with separators, truncated documents, share of padding."""
    kept = F.least(F.col(n), F.lit(block - 1)) + 1
    return tokens.agg(F.count("*").alias("rows"), F.coalesce(F.sum(kept), F.lit(0)).cast("long").alias("tokens"), F.count_if(F.col(n) > block - 1).alias("truncated"), F.round(1 - F.sum(kept) / (F.count("*") * F.lit(block)), 6).alias("waste"))


@query("pack_per_doc", "WITH k AS (SELECT length(text) // 4 AS n FROM documents) SELECT count(*)::BIGINT AS rows, sum(least(n, 767) + 1)::BIGINT AS tokens, count(*) FILTER (n > 767)::BIGINT AS truncated, round(1 - sum(least(n, 767) + 1)::DOUBLE / (count(*) * 768), 6) AS waste FROM k")
def _per_doc(t):
    return pack_report(t("documents").select(X.est_tokens(F.col("text")).alias("n")), "n", 768)


def pack_stream(tokens: DataFrame, key: str, n: str, order: list[str], block: int, allow_mixing: bool = False) -> DataFrame:
    """Blocks of one concatenated stream: first and last block of each document, and whether its tail is dropped.

    Refuses unless told that documents may share a block.
    """
    if not allow_mixing:
        raise ValueError("stream packing puts several documents into one block; pass allow_mixing=True to accept that")
    t = prefix_sum(tokens.withColumn("__n", F.col(n) + 1), key, "__n", order, "at")
    total = tokens.agg(F.sum(F.col(n) + 1).alias("__all"))
    t = t.crossJoin(F.broadcast(total))  # one row
    whole = F.expr(f"(__all div {block}) * {block}")
    return t.select("*", F.expr(f"at div {block}").alias("first_block"), F.expr(f"(at + __n - 1) div {block}").alias("last_block"), (F.col("at") + F.col("__n") > whole).alias("cut")).drop("__n", "__all")


@query("pack_stream", f"WITH k AS (SELECT doc_id, length(text) // 4 + 1 AS n, md5('0:' || doc_id) AS h FROM documents), c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos, sum(n) OVER () AS al FROM k) SELECT doc_id, (pos // 768)::BIGINT AS first_block, ((pos + n - 1) // 768)::BIGINT AS last_block, pos + n > (al // 768) * 768 AS cut FROM c")
def _stream(t):
    k = t("documents").select("doc_id", X.est_tokens(F.col("text")).alias("n"), hashed("0", F.col("doc_id")).alias("h"))
    return pack_stream(k, "h", "n", ["h", "doc_id"], 768, allow_mixing=True).select("doc_id", F.col("first_block").cast("long").alias("first_block"), F.col("last_block").cast("long").alias("last_block"), "cut")


_TS = TOOL.format(a="array('open','close','freeze')", div="div", one="0", s="STRING")
_TD = TOOL.format(a="['open','close','freeze']", div="//", one="1", s="VARCHAR")


def tool_names(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\b([a-z][a-z_]*_\d{3,4})\b"), F.lit(1))


def stem(tool: Column) -> Column:
    """All but the last part."""
    return F.regexp_replace(tool, "_[^_]*$", "")


@query("stem_collisions", rf"WITH x AS (SELECT DISTINCT unnest(regexp_extract_all('call ' || {_TD} || ' now', '\b([a-z][a-z_]*_\d{{3,4}})\b', 1)) AS tool FROM documents), s AS (SELECT regexp_replace(tool, '_[^_]*$', '') AS stem, tool FROM x) SELECT stem, count(*)::BIGINT AS n, string_agg(tool, ' ' ORDER BY tool) AS tools FROM s GROUP BY stem HAVING count(*) > 1")
def _stems(t):
    x = t("documents").select(F.explode(tool_names(F.concat(F.lit("call "), F.expr(_TS), F.lit(" now")))).alias("tool")).distinct()
    g = x.groupBy(stem(F.col("tool")).alias("stem")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("tool")), " ").alias("tools"))
    return g.filter("n > 1")


@query("suffix_check", rf"WITH d AS (SELECT doc_id, {_TD} AS own, CASE WHEN doc_id % 4 = 0 THEN 'open_account_1001' WHEN doc_id % 4 = 1 THEN 'made_up_0042' ELSE {_TD} END AS named FROM documents), a AS (SELECT DISTINCT own AS tool FROM d), c AS (SELECT regexp_replace(tool, '_[^_]*$', '') AS stem FROM a GROUP BY 1 HAVING count(*) > 1) SELECT doc_id, named, named NOT IN (SELECT tool FROM a) AS invented, named <> own AND named IN (SELECT tool FROM a) AND regexp_replace(named, '_[^_]*$', '') IN (SELECT stem FROM c) AS wrong_suffix FROM d")
def _suffix(t):
    """Named tools against all known ones and against those of the row's own source."""
    d = t("documents").select("doc_id", F.expr(_TS).alias("own"), F.when(F.col("doc_id") % 4 == 0, "open_account_1001").when(F.col("doc_id") % 4 == 1, "made_up_0042").otherwise(F.expr(_TS)).alias("named"))
    known = d.select(F.col("own").alias("tool")).distinct()
    many = known.groupBy(stem(F.col("tool")).alias("stem")).agg(F.count("*").alias("n")).filter("n > 1").select("stem", F.lit(True).alias("many"))
    out = d.join(known.withColumn("known", F.lit(True)), F.col("named") == F.col("tool"), "left").withColumn("st", stem(F.col("named"))).join(many, F.col("st") == F.col("stem"), "left")
    return out.select("doc_id", "named", F.col("known").isNull().alias("invented"), ((F.col("named") != F.col("own")) & F.col("known").isNotNull() & F.col("many").isNotNull()).alias("wrong_suffix"))


def pack_rows(docs: DataFrame, ids: str, block: int, eos: int, pad: int) -> DataFrame:
    """One document a row of ``block`` ids: its ids, cut to leave room for the separator, the separator, padding; labels are the ids, -100 where padded.

    Adds input_ids, labels and truncated; a narrow pass. A null or empty document is a separator and padding.
    """
    own = F.concat(F.slice(F.coalesce(F.col(ids), F.array().cast("array<int>")), 1, block - 1), F.array(F.lit(eos)))
    out = docs.withColumn("__own", own).withColumn("__fill", F.lit(block) - F.size("__own"))
    filled = lambda v: F.concat("__own", F.array_repeat(F.lit(v), F.col("__fill")))
    return out.withColumns({"input_ids": filled(pad), "labels": filled(-100), "truncated": F.coalesce(F.size(F.col(ids)), F.lit(0)) > block - 1}).drop("__own", "__fill")


@query("pack_rows", "WITH k AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) + 2) AS k FROM documents), o AS (SELECT doc_id, len(k) > 63 AS truncated, list_append(k[1:63], 1) AS own FROM k) SELECT doc_id, truncated, array_to_string(list_concat(own, list_transform(range(0, 64 - len(own)), lambda x: 0)), ' ') AS input_ids, array_to_string(list_concat(own, list_transform(range(0, 64 - len(own)), lambda x: -100)), ' ') AS labels FROM o")
def _rows(t):
    """Word lengths stand for token ids."""
    k = t("documents").select("doc_id", F.transform(X.tokens(F.col("text")), lambda x: F.length(x) + 2).alias("k"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return pack_rows(k, "k", 64, 1, 0).select("doc_id", "truncated", joined("input_ids").alias("input_ids"), joined("labels").alias("labels"))


def with_sources(docs: DataFrame, pages: DataFrame, ids: str = "source_ids") -> DataFrame:
    """(doc_id, i, page_id, title, content): a row for every source of a document that is in the knowledge base, in its order."""
    x = docs.select("doc_id", F.posexplode(ids).alias("i", "page_id"))
    return x.join(pages.select("page_id", "title", "content"), "page_id").select("doc_id", "i", "page_id", "title", "content")


@query("kb_sources", rf"WITH s AS (SELECT doc_id, unnest([doc_id % 40, doc_id % 41 + 20, 1000000]) AS page_id, generate_subscripts([1, 2, 3], 1) AS i FROM documents), k AS (SELECT page_id, url AS title, {_TD.replace('doc_id', 'page_id')} AS tool FROM pages), j AS (SELECT doc_id, i, title, tool FROM s JOIN k USING (page_id)), g AS (SELECT doc_id, string_agg('--- page: ' || title || ' ---' || chr(10) || 'call ' || tool, chr(10) || chr(10) ORDER BY i) AS context, array_to_string(list_sort(list(DISTINCT tool)), ' ') AS tools FROM j GROUP BY doc_id) SELECT doc_id, context, tools FROM g")
def _sources(t):
    """What a document may cite: its sources' pages in order, and the tools they name."""
    d = t("documents").select("doc_id", F.array(F.col("doc_id") % 40, F.col("doc_id") % 41 + 20, F.lit(1000000).cast("long")).alias("source_ids"))
    k = t("pages").select("page_id", F.col("url").alias("title"), F.concat(F.lit("call "), F.expr(_TS.replace("doc_id", "page_id"))).alias("content"))
    s = with_sources(d, k)
    page = F.concat(F.lit("--- page: "), "title", F.lit(" ---\n"), "content")
    g = s.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("i", page.alias("x")))).alias("xs"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(tool_names(F.col("content")))))), " ").alias("tools"))  # a document's own few sources
    return g.select("doc_id", F.array_join(F.transform("xs", lambda x: x["x"]), "\n\n").alias("context"), "tools")
