"""Cleaning: scaffolds, boilerplate, task-referring language; counts and reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..plans.catalog import lit, query
from ..plans.shared import spread
from ..sources.derived import BOILER, CONTAMINATED, DATED, METAED, SCAFFOLD, dated


def _peel(n: int) -> str:
    """SQL of one peel over column ls."""
    full = r"list_position(list_transform(ls, lambda x: regexp_matches(x, '\S')), true)"
    return f"""
p{n} AS (SELECT doc_id, CASE WHEN {full} > 0 THEN ls[{full}:] ELSE [] END AS ls FROM q{n - 1}),
q{n} AS (SELECT doc_id, CASE WHEN regexp_matches(coalesce(ls[1], ''), {lit(P.LEAD_HEADER)}) OR (regexp_matches(coalesce(ls[1], ''), {lit(P.LEAD_TITLE)}) AND regexp_matches(coalesce(ls[1], ''), {lit(P.FORMAT_WORDS)})) THEN ls[2:] ELSE ls END AS ls FROM p{n})"""


@query("strip_scaffold", rf"WITH q0 AS (SELECT doc_id, string_split({SCAFFOLD}, chr(10)) AS ls FROM documents), {_peel(1)}, {_peel(2)}, s AS (SELECT doc_id, regexp_replace(array_to_string(ls, chr(10)), '^\s+|\s+$', '', 'g') AS clean FROM q2) SELECT doc_id, md5(clean) AS clean_md5, length(clean)::BIGINT AS n_clean FROM s")
def _scaffold(t):
    c = t("documents").select("doc_id", X.strip_scaffold(F.expr(SCAFFOLD)).alias("clean"))
    return c.select("doc_id", F.md5("clean").alias("clean_md5"), F.length("clean").cast("long").alias("n_clean"))


@query("strip_boilerplate", rf"WITH b AS (SELECT doc_id, {BOILER} AS t, len(regexp_extract_all({BOILER}, {lit('(?m)' + P.BOILERPLATE)}))::BIGINT AS n FROM documents), c AS (SELECT doc_id, n, CASE WHEN n > 0 THEN regexp_replace(regexp_replace(regexp_replace(t, {lit('(?m)' + P.BOILERPLATE)}, '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') ELSE t END AS c FROM b) SELECT doc_id, n, md5(c) AS clean_md5 FROM c")
def _boiler(t):
    out, n = X.strip_boilerplate(F.expr(BOILER))
    return t("documents").select("doc_id", n.alias("n"), F.md5(out).alias("clean_md5"))


@query("meta_drop", f"SELECT doc_id FROM documents WHERE NOT regexp_matches({METAED}, {lit(P.META)})")
def _meta(t):
    return t("documents").filter(~F.expr(METAED).rlike(P.META)).select("doc_id")


_TAGS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, {lit(p)}) THEN {lit(k)} END" for k, p in P.CONTAMINATION.items()) + "], lambda x: x IS NOT NULL)"


@query("contamination_tags", f"SELECT doc_id, array_to_string({_TAGS}, '; ') AS tags FROM (SELECT doc_id, {CONTAMINATED} AS t FROM documents) WHERE len({_TAGS}) > 0")
def _tags(t):
    c = spread(t("documents").select("doc_id", "text")).select("doc_id", F.expr(CONTAMINATED).alias("t")).select("doc_id", X.tags(F.col("t")).alias("g"))
    return c.filter(F.size("g") > 0).select("doc_id", F.array_join("g", "; ").alias("tags"))


_FIRST = rf"min_by(regexp_replace(substr(t, greatest(1, strpos(t, m) - 80), length(m) + 170), '\s+', ' ', 'g'), doc_id) FILTER (m <> '')"
_COUNTS = " UNION ALL ".join(f"SELECT {lit(k)} AS pattern, count(*) FILTER (m <> '')::BIGINT AS n, round(100.0::DOUBLE * count(*) FILTER (m <> '') / greatest(count(*), 1), 6) AS percent, {_FIRST} AS example FROM (SELECT doc_id, t, coalesce(regexp_extract(t, {lit(p)}), '') AS m FROM c)" for k, p in P.CONTAMINATION.items())


@query("contamination_counts", f"WITH c AS (SELECT doc_id, {CONTAMINATED} AS t FROM documents) {_COUNTS}")
def _counts(t):
    """One pass for all patterns: a wide aggregate, then one row each; the example is the first by id."""
    c = t("documents").select("doc_id", F.expr(CONTAMINATED).alias("t")).select("doc_id", "t", *[F.regexp_extract("t", p, 0).alias(f"m{i}") for i, p in enumerate(P.CONTAMINATION.values())])
    aggs = [F.count("*").alias("all")]
    for i in range(len(P.CONTAMINATION)):
        m = F.col(f"m{i}")
        cut = F.regexp_replace(F.substring(F.col("t"), F.greatest(F.lit(1), F.instr(F.col("t"), m) - 80), F.length(m) + 170), r"\s+", " ")
        aggs += [F.count_if(m != "").alias(f"n{i}"), F.min(F.when(m != "", F.struct("doc_id", cut.alias("x"))))["x"].alias(f"x{i}")]
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("pattern"), F.col(f"n{i}").alias("n"), F.round(F.lit(100.0) * F.col(f"n{i}") / F.greatest(F.col("all"), F.lit(1)), 6).alias("percent"), F.col(f"x{i}").alias("example")) for i, k in enumerate(P.CONTAMINATION)]))
    return c.agg(*aggs).select(rows.alias("r")).select("r.*")


_K = r"md5(regexp_replace(regexp_replace(lower(substr(text, 1, 400)), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'))"


@query("drop_reasons", f"WITH {DATED}, k AS (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY doc_id) AS r, length(text) >= CASE WHEN stream = 'deaths' THEN 40 ELSE 350 END AND length(text) <= 24000 AS ok FROM d), l AS (SELECT *, row_number() OVER (PARTITION BY ok, {_K} ORDER BY doc_id) AS s FROM k) SELECT CASE WHEN NOT ok THEN 'length' WHEN s > 1 THEN 'dup_text' ELSE 'kept' END AS reason, count(*)::BIGINT AS n FROM l GROUP BY 1")
def _reasons(t):
    from .dedup import first_by, prefix_key
    from .filters import stream_floor

    d = dated(t("documents")).withColumn("ok", F.length("text").between(0, 24000) & (F.length("text") >= stream_floor(F.col("stream")))).select("doc_id", "ok", prefix_key(F.col("text")).alias("k"))
    return first_by(d, ["ok", "k"], ["doc_id"], mark="first").select(F.when(~F.col("ok"), "length").when(~F.col("first"), "dup_text").otherwise("kept").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


_HY = "CASE WHEN turn % 6 = 1 THEN concat('well, the user has provided notes. ', text) ELSE text END"


@query("hygiene_rate", rf"WITH h AS (SELECT role, {_HY} AS t, coalesce(regexp_extract({_HY}, {lit(P.HYGIENE)}), '') AS m FROM conversations) SELECT role, count(*)::BIGINT AS n, count(*) FILTER (m <> '')::BIGINT AS hits, round(count(*) FILTER (m <> '') / count(*)::DOUBLE, 6) AS rate, max(substr(t, greatest(1, strpos(t, m) - 60), 140)) FILTER (m <> '') AS excerpt FROM h GROUP BY role")
def _hygiene(t):
    h = t("conversations").select("role", F.expr(_HY).alias("t")).withColumn("m", F.regexp_extract("t", P.HYGIENE, 0))
    hit = F.col("m") != ""
    return h.groupBy("role").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.round(F.count_if(hit) / F.count("*"), 6).alias("rate"), F.max(F.when(hit, F.substring(F.col("t"), F.greatest(F.lit(1), F.instr(F.col("t"), F.col("m")) - 60), F.lit(140)))).alias("excerpt"))


_HT = "CASE WHEN turn % 9 = 1 THEN concat(text, ' The Article says so.') ELSE text END"


@query("hygiene_drop", f"SELECT conv_id, turn FROM conversations WHERE NOT regexp_matches({_HT}, {lit(P.HYGIENE_TRAINED)})")
def _hygiene_drop(t):
    """What is trained on: turns without the wording that the hygiene rate counts, by the second, wider pattern."""
    return t("conversations").filter(~F.expr(_HT).rlike(P.HYGIENE_TRAINED)).select("conv_id", "turn")
