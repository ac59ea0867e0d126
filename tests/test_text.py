"""Column functions on cases that must and must not match."""

import re

import pytest
from pyspark.sql import functions as F

from siltworks.functions import patterns as P
from siltworks.functions import text as X
from siltworks.operators.collect import death_entry, preamble_strip
from siltworks.operators.filters import lang_vote
from siltworks.operators.parsing import grounded


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text", ["Sangiorgi provided context on the drought", "Dear Subscribers, Here is your daily summary", "I read the article in last week's issue", "the government has not specified a duration", "such as an AI giving relationship advice"])
def test_meta_leaves_ordinary_prose(spark, text):
    assert not one(spark, text, lambda c: c.rlike(P.META))


@pytest.mark.parametrize("text", ["facts in the provided material", "as mentioned in the provided", "the user asked for more", "I will write 12 documents", "per the instructions"])
def test_meta_finds_leaks(spark, text):
    assert one(spark, text, lambda c: c.rlike(P.META))


def test_tags_leave_source_words(spark):
    assert one(spark, "supplied weapons; the ministry provided information", X.tags) == []
    assert one(spark, "According to the PROVIDED source material", X.tags) == ["source material", "according to the provided"]


@pytest.mark.parametrize(("text", "want"), [
    ("### 6. Local Newspaper Coverage\nBody", "Body"), ("\n\n**Wire brief**\nBody\n", "Body"), ("Document 2: X\n**News report**\nBody", "Body"),
    ("Body\n1. a list inside\n2. stays", "Body\n1. a list inside\n2. stays"), ("", ""), ("\n \n", ""), ("**A bold line of prose**\nBody", "**A bold line of prose**\nBody"), ("1. a\n2. b\n3. c\nBody", "3. c\nBody"),
])
def test_strip_scaffold(spark, text, want):
    assert one(spark, text, X.strip_scaffold) == want


def test_boilerplate(spark):
    t = "a\n\nx redirectUrl=%2F y\n\n\nb"
    assert one(spark, t, lambda c: X.strip_boilerplate(c)[0]) == "a\n\nb"
    assert one(spark, "sign up now\n\n\n\nb", lambda c: X.strip_boilerplate(c)[0]) == "sign up now\n\n\n\nb"
    assert one(spark, t, lambda c: X.strip_boilerplate(c)[1]) == 1


@pytest.mark.parametrize(("url", "domain", "host"), [("https://www.A.com:80/x?y", "www.A.com:80", "a.com:80"), ("nourl", "", ""), ("http://a.www.b.org#f", "a.www.b.org#f", "a.b.org"), ("", "", "")])
def test_domains(spark, url, domain, host):
    assert one(spark, url, X.url_domain) == domain
    assert one(spark, url, X.url_host) == host


def test_canonical(spark):
    assert one(spark, "https://a/b///?x=1?y", X.url_canonical) == "https://a/b"
    assert one(spark, "https://a/b#f/", X.url_canonical) == "https://a/b#f"


def test_norm_is_unicode(spark):
    assert one(spark, "  Élan -- vital_2 x ", X.norm) == "élan vital_2 x"


def test_html(spark):
    page = "<html><head><title>A &amp;amp; B &lt;3</title><style>p{}</style></head><body><nav>menu</nav><script>var t='</p>';</script><!-- c --><p>One<br>two</p><div>three &amp; four</div></body></html>"
    text = one(spark, page, X.html_text)
    assert text == "One\ntwo\nthree & four"
    assert one(spark, page, X.html_title) == "A &amp; B <3"


def test_pages_keep_articles_and_lose_scripts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html", X.html_text(F.col("html")).alias("t")).collect()
    for r in pages:
        assert "track(" not in r["t"] and "margin:0" not in r["t"]
        words = re.findall(r"\w{4,}", re.sub(r"<[^>]+>", " ", (re.findall(r"(?s)<article>.*?<p>(.*?)</p>", r["html"]) or [""])[0].split("&")[0]))
        assert all(w in r["t"] for w in words[:5])


def test_preambles_are_whole_lines(spark):
    cases = {
        "Surely the price rose.": "Surely the price rose.",
        "Sure, I can write that.\nBody": "Body",
        "Here is an article about rain:\n\nBody": "Body",
        "Here's one:\nBody": "Here's one:\nBody",
        " Certainly!\n```text\nDocument:\nBody\n```": "Body",
        "**Document**:\nSure thing": "Sure thing",
        "Body\nSure thing\nmore ```": "Body\nSure thing\nmore",
        "Certainly, the end": "Certainly, the end",
        "": "",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    for x in df.select("t", "want", preamble_strip(F.col("t")).alias("got")).collect():
        assert x["got"] == x["want"], x["t"]


def test_death_entries(spark):
    lines = ["*[[Ann Lee]], 90, Welsh [[poet|writer]].<ref>x</ref>", "* [[Bo|Bo B.]] 71, {{x}}''painter''", "no entry", "==1=="]
    name, rest = death_entry(F.col("t"))
    got = [(x["n"], x["r"]) for x in spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string").select("i", name.alias("n"), rest.alias("r")).orderBy("i").collect()]
    assert got == [("Ann Lee", "90, Welsh writer"), ("Bo", "71, painter"), (None, None), (None, None)]


def test_quotes_need_whole_words_only_inside(spark):
    quotes = ["cat sat on the mat tod", "he fat cat sat on", "sat on", "cat sat on the rug", "", "x"]
    texts = ["a fat cat sat on the mat today", "the fat cat sat on", "nothing"]
    q = spark.createDataFrame([(i, t) for i, t in enumerate(quotes) if t], "item_id int, q string")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, t string")
    want = {(i, j) for i, a in enumerate(quotes) for j, b in enumerate(texts) if a and a in b}
    assert {(x["item_id"], x["doc_id"]) for x in grounded(q, d).collect()} == want and len(want) == 4


def test_language_votes(spark):
    rows = [("The end of the road is in sight.", "en"), ("Der Hund und die Katze sind nicht im Haus.", "de"), ("Les enfants et le chien dans la rue", "fr"), ("El perro y los gatos en la calle", "es"), ("xyz 123", "und"), ("", "und"), (None, "und"), ("la", "fr")]
    w = spark.createDataFrame(rows, "t string, want string").withColumn("w", F.regexp_extract_all(F.lower(F.coalesce("t", F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)))
    for x in w.select("t", "want", lang_vote(F.col("w"))["lang"].alias("got")).collect():
        assert x["got"] == x["want"], x["t"]
