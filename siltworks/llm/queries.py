"""The queries op1_ ... op13_ over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.budget import _CRC
from ..plans.shared import scratch, spread
from . import chat, decontam, language, mixing, neardup, negatives, periodic, pii, quality, spans, suffixes, token_files, tokens, words


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns of all documents, over all cores even where one small file holds them."""
    return spread(table(spark, sf_dir, "documents").select(*columns))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.read_back(chat.windows(turns.unionByName(extra)))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    p = language.predict(docs, language.fit(docs))
    return p.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mixing.plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return p.select("doc_id", F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), (F.col("__mix_size") * F.col("__mix_copies")).alias("taken"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir, "doc_id", "text"), k=3, percent=85)


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated(documents(spark, sf_dir, "doc_id", "text"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # its files come with the installation; the path is the operator's parameter

    return tokens.count_tokens(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = quality.judge(table(spark, sf_dir, "documents"))
    names = {"q_words": "n_words", "q_chars": "word_chars", "q_symbols": "n_symbols", "q_dups": "n_dup_lines", "q_repeat": "n_repeat_words"}
    return j.select("doc_id", *[F.col(a).alias(b) for a, b in names.items()], "base_failed", "kept")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup(documents(spark, sf_dir, "doc_id", "text"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pii.redact(documents(spark, sf_dir, "doc_id", "text"), pii.session_key(spark, pii.DEMO_KEY), counts="n")
    return p.select("doc_id", "text", *[F.get("n", F.lit(i)).alias(f"n_{k}") for i, k in enumerate(pii.TYPES)])


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "token_files")
    token_files.write(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return token_files.read(spark, path).select("doc_id", "start", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label").cast("bigint"))
    return negatives.mine(v, F.col("vec_id") % 50 == 0, label)


def made_periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth text by its id's hash with its tail repeated, as the contract of op13 has it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words.word_array(F.col("text"))).alias("w"))
    d = d.select("doc_id", "text", "w", F.expr("h div 10").alias("g"), F.size("w").cast("bigint").alias("n"))
    d = d.select("*", F.expr("if(n > 0, g % n, null)").alias("a"))
    d = d.select("*", F.expr("1 + (n - a) div (3 + g % 8)").alias("p"))
    tail = F.transform(F.expr("sequence(0L, n - 1)"), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p"))).cast("int")))
    return d.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = periodic.collapse(made_periodic(documents(spark, sf_dir, "doc_id", "text")))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))), "")
    top = F.col("top")
    return r.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"), F.expr("(1000 * top.length) div top.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_chat_format, op2_language, op3_mixing, op4_minhash, op5_suffixes, op6_tokens, op7_quality, op8_decontamination, op9_sentence_spans, op10_pii, op11_token_files, op12_hard_negatives, op13_periodic_runs)
}

_WORDS = r"string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+')"
_WORDS = f"list_filter({_WORDS}, lambda w: w <> '')"

_OP1 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e0 AS (
  SELECT *, CASE WHEN role = 'assistant' THEN 7 ELSE 13 END + 1
      + length(replace(regexp_replace(regexp_replace(replace(role, '&', '&amp;'), '<(/?s>)', '&lt;\1', 'g'), '\[(/?INST\])', '&#91;\1', 'g'), chr(10), '&#10;'))
      + length(regexp_replace(regexp_replace(replace(text, '&', '&amp;'), '<(/?s>)', '&lt;\1', 'g'), '\[(/?INST\])', '&#91;\1', 'g')) AS piece
  FROM t
), e AS (SELECT *, piece // 4 + 1 AS tok FROM e0), p AS (
  SELECT *, row_number() OVER w AS i, sum(tok) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS cum,
    sum((role = 'system')::INT) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS nsys
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), v0 AS (
  SELECT *, role = 'system' AND nsys = 1 AS is_sys, max(CASE WHEN role = 'system' AND nsys = 1 THEN piece END) OVER (PARTITION BY conv_id) AS syspiece FROM p
), v1 AS (SELECT *, greatest(1024 - coalesce(syspiece // 4 + 1, 0), 0) AS room FROM v0),
v2 AS (SELECT *, least(256, room // 4) AS past FROM v1), v3 AS (SELECT *, greatest(1, (room - past) // 2) AS stride FROM v2),
v AS (SELECT *, ((cum - 1) // stride) * 2 + CASE WHEN tok > stride THEN 0 ELSE 1 END AS win, CASE WHEN tok > stride THEN room - tok ELSE past END AS lft FROM v3),
s AS (SELECT *, coalesce(lag(win) OVER (PARTITION BY conv_id ORDER BY i) <> win, true) AS starts FROM v), h AS (
  SELECT *, lead(starts, 1) OVER w AS s1, lead(starts, 2) OVER w AS s2, lead(cum - tok, 1) OVER w AS c1, lead(cum - tok, 2) OVER w AS c2,
    lead(lft, 1) OVER w AS l1, lead(lft, 2) OVER w AS l2
  FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY i)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(piece + CASE WHEN starts AND nsys > 0 AND NOT is_sys THEN syspiece ELSE 0 END
    + CASE WHEN s1 AND NOT is_sys AND c1 - (cum - tok) <= least(past, l1) THEN piece ELSE 0 END
    + CASE WHEN s2 AND NOT is_sys AND c2 - (cum - tok) <= least(past, l2) THEN piece ELSE 0 END)::BIGINT AS formatted_chars
FROM h GROUP BY conv_id
"""

_OP3 = rf"""
WITH d AS (SELECT doc_id, source, text, len({_WORDS})::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS sz, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * sz AS c FROM s),
o AS (
  SELECT *, sum(sz) OVER () AS al, sum(w) OVER () AS aw,
    coalesce(sum(c) OVER (ORDER BY c * (10 // w), r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pc,
    coalesce(sum(w) OVER (ORDER BY c * (10 // w), r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pw FROM w
), k AS (SELECT *, c::HUGEINT * (aw - pw) <= w::HUGEINT * (al - pc) AS capped FROM o),
u AS (SELECT *, coalesce(sum(c) FILTER (capped) OVER (), 0) AS uc, coalesce(sum(w) FILTER (capped) OVER (), 0) AS uw FROM k),
g AS (SELECT source, sz, CASE WHEN capped THEN c::DOUBLE ELSE (w * (al - uc))::DOUBLE / nullif(aw - uw, 0)::DOUBLE END AS target FROM u),
x AS (
  SELECT doc_id, size, sz AS source_size, target, coalesce(target / nullif(sz, 0)::DOUBLE, 0) AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM x
"""


def _op7() -> str:
    b = lambda v: f"(({v} >> greatest(length(bin({v})) - 6, 0)) << greatest(length(bin({v})) - 6, 0))"
    slack = quality.SLACK
    fences = []
    for name, keys in (("g", "lang, source, "), ("l", "lang, "), ("a", "")):
        by = f"PARTITION BY {keys}m"
        fences.append(f"""
{name}0 AS (SELECT {keys}m, b, sum(n) AS n FROM sk GROUP BY {keys}m, b),
{name}1 AS (SELECT *, sum(n) OVER ({by} ORDER BY b ROWS UNBOUNDED PRECEDING) AS c, sum(n) OVER ({by}) AS al FROM {name}0),
{name}2 AS (SELECT {keys}m, min(b) FILTER (c * 4 >= al) AS q1, min(b) FILTER (c * 4 >= al * 3) AS q3, max(al) AS al FROM {name}1 GROUP BY {keys}m),
{name} AS (SELECT {keys}max(al) AS n, {', '.join(f"max(q3 + greatest(3 * (q3 - q1), {up})) FILTER (m = '{k}') AS {k}_hi, max(q1 - greatest(3 * (q3 - q1), {up})) FILTER (m = '{k}') AS {k}_lo" for k, (up, _) in slack.items())} FROM {name}2 {'GROUP BY ' + keys[:-2] if keys else ''})""")
    fine = []
    for k, (_, low) in slack.items():
        pick = lambda side: f"CASE WHEN g.n >= {quality.MIN_GROUP} THEN g.{k}_{side} WHEN l.n >= {quality.MIN_GROUP} THEN l.{k}_{side} ELSE a.{k}_{side} END"  # noqa: B023, E731
        fine.append(f"coalesce({k} <= {pick('hi')}, true)")
        if low is not None:
            fine.append(f"coalesce({k} >= {pick('lo')}, true)")
    return rf"""
WITH w0 AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents
), tri AS (
  SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w0)
), dup AS (SELECT doc_id, i FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS p FROM dup, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY doc_id),
m0 AS (
  SELECT w0.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w0 LEFT JOIN cov USING (doc_id)
), m AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 10000 * n_symbols // greatest(word_chars, 1) AS q_sym, 10000 * greatest(n_dup_lines - {quality.DUPS}, 0) // greatest(n_lines, 1) AS q_dup,
    10000 * greatest(n_repeat_words - {quality.REPEATS}, 0) // greatest(n_words, 1) AS q_rep, 100 * word_chars // greatest(n_words, 1) AS q_len FROM m0
), sk AS (
  {' UNION ALL '.join(f"SELECT lang, source, '{k}' AS m, {b(k)} AS b, count(*) AS n FROM m WHERE NOT base_failed GROUP BY ALL" for k in slack)}
), {', '.join(fences)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(fine)} AS kept
FROM m LEFT JOIN g ON m.lang IS NOT DISTINCT FROM g.lang AND m.source IS NOT DISTINCT FROM g.source LEFT JOIN l ON m.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a
"""


_OP4 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{words.UPPER}', '{words.LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2]))) AS g FROM w WHERE len(w) >= 3
  UNION ALL SELECT doc_id, array_to_string(w, chr(10)) FROM w WHERE len(w) BETWEEN 1 AND 2
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT a AS id, b AS to_id FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.to_id),
c AS (SELECT id, min(to_id) AS m FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(c.m, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(c.m, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.id = w.doc_id
"""

_SHINGLES = rf"""
  SELECT id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], chr(10))))) AS g FROM w WHERE len(w) >= 5
  UNION ALL SELECT id, array_to_string(w, chr(10)) FROM w WHERE len(w) BETWEEN 1 AND 4"""
_LOWER = rf"list_filter(string_split_regex(translate(coalesce(text, ''), '{words.UPPER}', '{words.LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w"
_OP8 = f"""
WITH d AS (WITH w AS (SELECT doc_id AS id, {_LOWER} FROM documents) {_SHINGLES}),
b AS (WITH w AS (SELECT item_id AS id, {_LOWER} FROM benchmark) {_SHINGLES}),
n AS (SELECT id, count(*) AS n FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*)::BIGINT AS n_shared, max(n.n)::BIGINT AS n_item FROM d JOIN b ON d.g = b.g JOIN n ON n.id = b.id GROUP BY d.id, b.id HAVING count(*) >= 0.8 * max(n.n)
"""

_OP12 = """
WITH v0 AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS a, a.label = b.label AS alike, b.vec_id AS b, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS s FROM v0 a JOIN v0 b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (SELECT a, b AS p, s AS ps FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
n AS (SELECT a, p, ps, b, s, row_number() OVER (PARTITION BY a, p ORDER BY s DESC, b) AS r FROM p JOIN s USING (a) WHERE NOT alike AND 100 * s BETWEEN 50 * ps AND 95 * ps)
SELECT a AS anchor_id, p AS positive_id, r::INT AS rank, b AS negative_id, ps AS positive_score, s AS negative_score FROM n WHERE r <= 3
"""

_OP13 = rf"""
WITH {_CRC}, d0 AS (
  SELECT doc_id, row_number() OVER () AS u, {_WORDS} AS w, xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM documents, tab
), d1 AS (SELECT doc_id, u, w, len(w) AS n, h // 10 AS g, h % 10 = 0 AND len(w) > 0 AS made FROM d0),
d2 AS (SELECT *, CASE WHEN made THEN g % n ELSE 0 END AS a FROM d1), d3 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS pp FROM d2),
d AS (SELECT doc_id, u, n, CASE WHEN made THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % pp END]) ELSE w END AS w FROM d3),
x AS (SELECT u, n, unnest(range(n)) AS i, unnest(w) AS word FROM d),
m AS (SELECT l.u, r.i - l.i AS p, l.i FROM x l JOIN x r ON l.u = r.u AND l.word = r.word AND r.i > l.i AND 3 * (r.i - l.i) <= l.n),
e AS (SELECT u, p, min(i) AS s, count(*) + p AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY u, p ORDER BY i) AS isle FROM m) GROUP BY u, p, isle HAVING count(*) + p >= greatest(24, 3 * p)),
r AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.u = e.u AND f.p < e.p AND f.s <= e.s AND f.s + f.len >= e.s + e.len)),
c AS (SELECT u, count(*) AS n_runs, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS lines FROM r GROUP BY u),
b AS (SELECT u, s, len, p FROM r QUALIFY row_number() OVER (PARTITION BY u ORDER BY len::DOUBLE / p DESC, s, p) = 1),
g AS (SELECT DISTINCT u, unnest(range(s + p, s + len)) AS i FROM r),
k AS (SELECT u, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN g USING (u, i) GROUP BY u)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.len::BIGINT AS length, b.p::BIGINT AS period, (1000 * b.len // b.p)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN c USING (u) LEFT JOIN b USING (u) LEFT JOIN k USING (u)
"""

ORACLES = {"op12_hard_negatives": _OP12, "op13_periodic_runs": _OP13, "op8_decontamination": _OP8, "op4_minhash": _OP4, "op1_chat_format": _OP1, "op3_mixing": _OP3, "op7_quality": _op7()}
