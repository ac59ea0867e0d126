"""Inputs derived from the test tables by the same expressions in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dated(docs: DataFrame) -> DataFrame:
    """documents with date, stream and est_tokens."""
    return docs.select("doc_id", "text", "lang", "source", F.expr("date_format(date_add(DATE'2026-01-01', cast(doc_id % 212 as int)), 'yyyy-MM-dd')").alias("date"), F.expr("element_at(array('deaths','wiki','hn','docs'), cast(doc_id % 4 as int) + 1)").alias("stream"), F.expr("length(text) div 4").alias("est_tokens"))


DATED = "d AS (SELECT doc_id, text, lang, source, strftime(DATE '2026-01-01' + cast(doc_id % 212 AS INT), '%Y-%m-%d') AS date, ['deaths','wiki','hn','docs'][cast(doc_id % 4 AS INT) + 1] AS stream, length(text) // 4 AS est_tokens FROM documents)"

SCAFFOLD = "concat(CASE doc_id % 7 WHEN 0 THEN concat('**Document 3: Market Note**', chr(10)) WHEN 1 THEN concat('### 6. Local Newspaper Coverage', chr(10)) WHEN 2 THEN concat(chr(10), chr(10), '**Wire brief**', chr(10)) ELSE '' END, text)"
CONTAMINATED = "concat(text, CASE WHEN doc_id % 11 = 0 THEN ' according to the provided material' WHEN doc_id % 11 = 5 THEN ' the text states research notes' ELSE '' END)"
BOILER = "concat(text, CASE WHEN doc_id % 13 = 0 THEN concat(chr(10), 'Sign up redirectUrl=%2Fworld now', chr(10), chr(10), chr(10), 'tail') ELSE '' END)"
METAED = "concat(text, CASE WHEN doc_id % 17 = 0 THEN ' as mentioned in the provided text.' WHEN doc_id % 17 = 1 THEN ' Her letter provided context on the harvest.' ELSE '' END)"
TOOL = "concat({a}[cast(doc_id % 9 {div} 4 AS INT) + {one}], '_account_', cast(1000 + doc_id % 9 AS {s}))"
URL = "concat('https://h', cast(page_id % 5 AS {s}), '.example/a/', cast(page_id % 40 AS {s}), CASE WHEN page_id % 3 = 0 THEN '/' ELSE '' END, CASE WHEN page_id % 2 = 0 THEN '?utm=x' ELSE '' END)"
