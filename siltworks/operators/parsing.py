"""Parsing of markup and of generated text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X
from ..plans.catalog import lit, query
from ..plans.shared import BROADCAST_ROWS, cut, spread


def _duck_html() -> str:
    t = "html"
    for p, r in X.HTML:
        t = f"regexp_replace({t}, {lit(p)}, {lit(r)}, 'g')"
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def _duck_title() -> str:
    t = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)"
    for p, r in X.HTML:
        if p.startswith("&"):
            t = f"replace({t}, {lit(p)}, {lit(r)})"
    return rf"regexp_replace(regexp_replace({t}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query("html_text", f"SELECT page_id, {_duck_title()} AS title, {_duck_html()} AS text FROM pages")
def _html(t):
    """An approximation of main-content extraction; what must and must not be left is tested too."""
    return t("pages").select("page_id", X.html_title(F.col("html")).alias("title"), X.html_text(F.col("html")).alias("text"))


_WIKI = "concat('{{Current events|x}}', chr(10), '* [[Foo bar|', text, ']] said ''''''so'''''' {{ship|HMS|Ark|x}} [https://news.example.org/a', CAST(doc_id AS STR), ', (Wire)] <ref>z</ref>', chr(10), '<!-- gone -->', chr(10), '[https://medium.com/p] [https://b.example/', CAST(doc_id % 7 AS STR), ').] [https://b.example/', CAST(doc_id % 7 AS STR), '] {{a{{b}}c}} [[', coalesce(source, ''), ']]')"


def _duck_wiki() -> str:
    t = "w"
    for p, r in P.WIKI:
        t = f"regexp_replace({t}, {lit(p)}, {lit(r.replace('$1', chr(92) + '1'))}, 'g')"
    return t


_WQ = _WIKI.replace("STR", "VARCHAR")


@query("wiki_strip", rf"WITH a AS (SELECT doc_id, {_WQ} AS w FROM documents) SELECT doc_id, array_to_string(list_filter(list_transform(string_split({_duck_wiki()}, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\*+\s*', ''), '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND x <> '}}}}'), chr(10)) AS prose FROM a")
def _wiki(t):
    return spread(t("documents").select("doc_id", "text", "source")).select("doc_id", X.wiki_strip(F.expr(_WIKI.replace("STR", "STRING"))).alias("prose"))


_BLK = "[" + ", ".join(map(lit, P.BLOCKED_SUBSTRINGS)) + "]"


@query("extract_citations", rf"WITH a AS (SELECT doc_id, list_transform(regexp_extract_all({_WQ}, '\[(https?://[^\s\]]+)', 1), lambda u: regexp_replace(u, '[.,);]+$', '')) AS us FROM documents), b AS (SELECT doc_id, list_filter(us, lambda u, i: list_position(us, u) = i AND len(list_filter({_BLK}, lambda b: contains(lower(replace(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), 'www.', '')), b))) = 0) AS us FROM a) SELECT doc_id, array_to_string(us, ' ') AS urls, len(us)::BIGINT AS n FROM b")
def _cite(t):
    c = t("documents").select("doc_id", X.citations(F.expr(_WIKI.replace("STR", "STRING"))).alias("us"))
    return c.select("doc_id", F.array_join("us", " ").alias("urls"), F.size("us").cast("long").alias("n"))


def carry_forward(lines: DataFrame, page: str, order: str, header: Column, value: str = "day") -> DataFrame:
    """Rows after a header line get its value; headers and what stands before the first go. Pages are windows of their own."""
    w = Window.partitionBy(page).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn(value, F.last(header, ignorenulls=True).over(w)).filter(header.isNull() & F.col(value).isNotNull())


_CF = "CASE WHEN doc_id % 13 = 3 THEN concat('=== ', cast(doc_id % 28 + 1 AS STR), ' ===') ELSE concat('* ', text) END"


@query("carry_forward", rf"WITH l AS (SELECT doc_id % 5 AS page, doc_id AS line_no, {_CF.replace('STR', 'VARCHAR')} AS line FROM documents), h AS (SELECT *, nullif(regexp_extract(line, '^===?\s*(\d{{1,2}})\s*===?\s*$', 1), '') AS hd FROM l), w AS (SELECT *, last_value(hd IGNORE NULLS) OVER (PARTITION BY page ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS day FROM h) SELECT page, line_no, day, line FROM w WHERE hd IS NULL AND day IS NOT NULL")
def _carry(t):
    lines = t("documents").select((F.col("doc_id") % 5).alias("page"), F.col("doc_id").alias("line_no"), F.expr(_CF.replace("STR", "STRING")).alias("line"))
    return carry_forward(lines, "page", "line_no", F.nullif(F.regexp_extract("line", r"^===?\s*(\d{1,2})\s*===?\s*$", 1), F.lit(""))).select("page", "line_no", "day", "line")


def split_docs(df: DataFrame, text: str, sep: str = P.DOC_SEP, least: int = 250) -> DataFrame:
    """One row a document of a generator's answer: separators cut, numbering dropped, stubs of ``least`` characters or less too."""
    out = df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(F.col(text), sep)).alias("ix", "doc"))
    out = out.withColumn("doc", F.regexp_replace(X.strip(F.col("doc")), r"(?i)^(?:Document\s*\d+\s*[:.\-]?\s*)", ""))
    return out.filter(F.length("doc") > least)


_SD = "concat('Document 1: ', text, chr(10), '<<<DOC>>>', chr(10), 'document 2. ', text, '<<<DOC>>>stub')"


@query("split_docs", rf"WITH p AS (SELECT doc_id, unnest(string_split({_SD}, '<<<DOC>>>')) AS x, generate_subscripts(string_split({_SD}, '<<<DOC>>>'), 1) - 1 AS ix FROM documents), q AS (SELECT doc_id, ix, regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '(?i)^(?:Document\s*\d+\s*[:.\-]?\s*)', '') AS d FROM p) SELECT doc_id, ix::INT AS ix, length(d)::BIGINT AS n, md5(d) AS doc_md5 FROM q WHERE length(d) > 250")
def _docs(t):
    s = split_docs(t("documents").select("doc_id", F.expr(_SD).alias("t")), "t")
    return s.select("doc_id", "ix", F.length("doc").cast("long").alias("n"), F.md5("doc").alias("doc_md5"))


def parse_qa(df: DataFrame, text: str, sep: str = P.QA_SEP) -> DataFrame:
    """Question-answer pairs: Q: and A: lines, questions over 10 characters, answers of four words or more."""
    out = df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(F.col(text), sep)).alias("ix", "p")).withColumn("p", X.strip(F.col("p")))
    pat = r"(?s)Q:\s*(.+?)\s*\n\s*A:\s*(.+)"
    out = out.withColumn("q", X.strip(F.regexp_extract("p", pat, 1))).withColumn("a", X.strip(F.regexp_extract("p", pat, 2)))
    return out.filter((F.length("q") > 10) & (F.size(F.split("a", r"\s+")) >= 4)).drop("p")


def parse_qa_v2(df: DataFrame, text: str, sep: str = P.QA_SEP) -> DataFrame:
    """Question-answer pairs of the second rule: an answer's line begins with A:, questions are over 10 characters, answers over 15."""
    out = df.select(*[c for c in df.columns if c != text], F.posexplode(F.split(F.col(text), sep)).alias("ix", "p")).withColumn("p", X.strip(F.col("p")))
    pat = r"(?s)Q:\s*(.+?)\n+A:\s*(.+)"
    out = out.withColumn("q", X.strip(F.regexp_extract("p", pat, 1))).withColumn("a", X.strip(F.regexp_extract("p", pat, 2)))
    return out.filter((F.length("q") > 10) & (F.length("a") > 15)).drop("p")


_QA = "concat('Q: what is ', cast(item_id AS STR), ' about?', chr(10), 'A: ', text, '<<<QA>>> Q: short', chr(10), 'A: no', '<<<QA>>>nothing', '<<<QA>>>Q: is this one kept too?', chr(10), ' A: it is four words', chr(10))"
_QS = _QA.replace("STR", "VARCHAR")


@query("parse_qa", rf"WITH p AS (SELECT item_id, regexp_replace(unnest(string_split({_QS}, '<<<QA>>>')), '^\s+|\s+$', '', 'g') AS p, generate_subscripts(string_split({_QS}, '<<<QA>>>'), 1) - 1 AS ix FROM benchmark), q AS (SELECT item_id, ix, regexp_replace(regexp_extract(p, '(?s)Q:\s*(.+?)\s*\n\s*A:\s*(.+)', 1), '^\s+|\s+$', '', 'g') AS q, regexp_replace(regexp_extract(p, '(?s)Q:\s*(.+?)\s*\n\s*A:\s*(.+)', 2), '^\s+|\s+$', '', 'g') AS a FROM p) SELECT item_id, ix::INT AS ix, q, a FROM q WHERE length(q) > 10 AND len(string_split_regex(a, '\s+')) >= 4")
def _qa(t):
    return parse_qa(t("benchmark").select("item_id", F.expr(_QA.replace("STR", "STRING")).alias("t")), "t").select("item_id", "ix", "q", "a")


_N = r"regexp_replace(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query("quote_grounded", f"WITH d AS (SELECT doc_id, {_N.format('text')} AS t FROM documents), b AS (SELECT item_id, substr({_N.format('text')}, 1, 120) AS q FROM benchmark) SELECT item_id, doc_id FROM b JOIN d ON contains(d.t, b.q) WHERE q <> ''")
def _quote(t):
    """Joined by an anchor inside each quote, then held against the whole text."""
    b = t("benchmark").select("item_id", F.substring(X.norm(F.col("text")), 1, 120).alias("q")).filter("q <> ''")
    d = t("documents").select("doc_id", X.norm(F.col("text")).alias("t"))
    return grounded(b, d).select("item_id", "doc_id")


#: Words of an anchor, which must be whole words of a text that holds the quote, so the quote's own first and last word don't count.
ANCHOR = 3


def runs(words: Column) -> Column:
    """Hashes of all runs of ANCHOR words; ``words`` must be a plain column."""
    n = F.greatest(F.size(words) - (ANCHOR - 1), F.lit(0))
    return F.transform(F.arrays_zip(*[F.slice(words, i + 1, n).alias(f"w{i}") for i in range(ANCHOR)]), lambda r: F.xxhash64(*[r[f"w{i}"] for i in range(ANCHOR)]))


def grounded(quotes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs of quotes (item_id, q) and texts (doc_id, t) that hold them, both of words with single spaces.

    A quote's least run hash is its anchor; texts give their distinct run hashes, so quotes and texts meet by an equi-join,
    and only what meets is compared. Quotes too short for an anchor are searched for in a pass of their own.
    """
    q = quotes.select("item_id", "q", F.split("q", " ").alias("w"))
    q = q.select("item_id", "q", F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0))).alias("w")).select("item_id", "q", F.array_min(runs(F.col("w"))).alias("anchor"))
    q = cut(q)
    n = {r["short"]: r["n"] for r in q.groupBy(F.col("anchor").isNull().alias("short")).agg(F.count("*").alias("n")).collect()}  # two rows
    sized = lambda df, rows: F.broadcast(df) if rows <= BROADCAST_ROWS else df
    d = docs.select("doc_id", F.split("t", " ").alias("w")).select("doc_id", F.explode(F.array_distinct(runs(F.col("w")))).alias("anchor"))
    met = d.join(sized(q.filter("anchor is not null"), n.get(False, 0)), "anchor").select("doc_id", "item_id", "q")
    out = docs.join(met, "doc_id").filter(F.contains("t", F.col("q"))).select("item_id", "doc_id")
    if n.get(True):
        out = out.unionByName(docs.join(sized(q.filter("anchor is null").select("item_id", "q"), n[True]), F.contains("t", F.col("q"))).select("item_id", "doc_id"))
    return out


@query("parse_qa_v2", rf"WITH p AS (SELECT item_id, regexp_replace(unnest(string_split({_QS}, '<<<QA>>>')), '^\s+|\s+$', '', 'g') AS p, generate_subscripts(string_split({_QS}, '<<<QA>>>'), 1) - 1 AS ix FROM benchmark), q AS (SELECT item_id, ix, regexp_replace(regexp_extract(p, '(?s)Q:\s*(.+?)\n+A:\s*(.+)', 1), '^\s+|\s+$', '', 'g') AS q, regexp_replace(regexp_extract(p, '(?s)Q:\s*(.+?)\n+A:\s*(.+)', 2), '^\s+|\s+$', '', 'g') AS a FROM p) SELECT item_id, ix::INT AS ix, q, a FROM q WHERE length(q) > 10 AND length(a) > 15")
def _qa2(t):
    return parse_qa_v2(t("benchmark").select("item_id", F.expr(_QA.replace("STR", "STRING")).alias("t")), "t").select("item_id", "ix", "q", "a")


def answers(df: DataFrame, text: str) -> DataFrame:
    """One row a question of a JSON reply {questions: [...]}, with its kind: text, yes_no or invalid.

    A question counts if it and its quote are there; its answer must be a non-empty text or, for yes-no questions, true or
    false as such, not as text. Replies that don't parse have no questions.
    """
    keep, field = [c for c in df.columns if c != text], lambda k: F.get_json_object("x", f"$.{k}")
    x = df.select(*keep, F.posexplode(F.from_json(F.get_json_object(F.col(text), "$.questions"), "array<string>")).alias("ix", "x"))
    x = x.select("*", X.strip(field("question")).alias("question"), X.strip(field("quote")).alias("quote"), field("answer").alias("answer"), F.regexp_extract("x", r'"answer"\s*:\s*(true|false)\b', 1).alias("bare"))
    shaped = (F.coalesce("question", F.lit("")) != "") & (F.coalesce("quote", F.lit("")) != "")
    kind = F.when(shaped & (F.col("bare") != ""), "yes_no").when(shaped & (F.coalesce("answer", F.lit("")) != ""), "text").otherwise("invalid")
    return x.select(*keep, "ix", "question", "answer", kind.alias("kind"))


_AN = """concat('{"questions": [{"question": "Is it ', cast(item_id AS STRING), '?", "answer": true, "quote": "so"}, {"question": "Who?", "answer": "Ann", "quote": "Ann said"}, {"question": "What?", "answer": "", "quote": "q"}, {"question": null, "answer": false, "quote": "q"}, {"question": "Why?", "answer": "because"}]}')"""


@query("answer_shape", "SELECT item_id, k.ix::INT AS ix, CASE k.ix WHEN 0 THEN 'Is it ' || item_id || '?' WHEN 1 THEN 'Who?' WHEN 2 THEN 'What?' WHEN 4 THEN 'Why?' END AS question, ['yes_no', 'text', 'invalid', 'invalid', 'invalid'][k.ix + 1] AS kind FROM benchmark, (SELECT unnest(range(0, 5)) AS ix) k")
def _answers(t):
    return answers(t("benchmark").select("item_id", F.expr(_AN).alias("t")), "t").select("item_id", "ix", "question", "kind")
