"""Main text of pages, and many strings in many texts."""

import collections
import html
import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from siltworks.operators import content, needles


class Tree(HTMLParser):
    """The containers of texts by a plain stack of levels, as the prefix sums should have them."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.stack, self.homes, self.n = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.n += 1
        if tag in content.HOLDS:
            self.stack.append(self.n)

    def handle_endtag(self, tag):
        self.n += 1
        if tag in content.HOLDS and self.stack:
            self.stack.pop()

    def handle_data(self, data):
        if data.strip():
            self.homes.append((data, self.stack[-1] if self.stack else 0))


@pytest.mark.parametrize("seed", range(5))
def test_block_tree_equals_a_stack(seed):
    r = random.Random(seed)
    page = ""
    for i in range(300):
        page += r.choice(["<div>", "</div>", "<section>", "</section>", "<p>", "</p>", "<td>", "</ul>", f"w{i} "])
    tree = Tree()
    tree.feed(page)
    texts, _, home, _, _ = content.blocks(page)
    want = {}
    for data, h in tree.homes:
        for w in data.split():
            want[w] = h
    got = {w: h for t, h in zip(texts, home.tolist(), strict=True) for w in t.split()}
    assert got == want


def article(r, n):
    return [" ".join(f"a{r.randrange(10**6)}" for _ in range(r.randrange(15, 60))) + "." for _ in range(n)]


def noise(r, n):
    return " ".join(f"n{r.randrange(10**6)}" for _ in range(n))


def planted(r, kind):
    """A page and the words that are its article's."""
    ps = article(r, r.randrange(4, 12))
    links = "".join(f'<li><a href="/x">{noise(r, 2)}</a></li>' for _ in range(20))
    ad, side = f"<div class=ad>{noise(r, 9)}</div>", f"<aside><p>{noise(r, 30)}</p></aside>"
    body = "".join(f"<p>{p[:40]}<b>{p[40:60]}</b>{p[60:]}</p>" for p in ps)
    if kind == "article":
        inner = f"{ad}<article><h1>a0 title</h1>{body}{side}</article>"
    elif kind == "nested":
        half = len(ps) // 2
        inner = f"<div><div>{''.join(f'<p>{p}' for p in ps[:half])}</div>{ad}<div><div>{''.join(f'<p>{p}</p>' for p in ps[half:])}</div></div></div>{side}"
    elif kind == "table":
        inner = f"<table><tr><td><ul>{links}</ul></td><td>{body}</td><td>{ad}</td></tr></table>"
    else:
        inner = f"{ad}<div>{'<br>'.join(ps)}</div>"
    page = f"<html><head><title>t</title></head><body><nav><ul>{links}</ul></nav>{inner}<div><ul>{links}</ul></div><footer>&copy; {noise(r, 12)}</footer><script>var x = '<p>{noise(r, 40)}</p>'</script></body></html>"
    return page, {w for p in ps for w in p.split()}


@pytest.mark.parametrize("kind", ["article", "nested", "table", "breaks"])
def test_planted_articles_come_out(spark, kind):
    r = random.Random(8)
    pages = [planted(r, kind) for _ in range(40)]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(pages)], "page_id long, html string")
    hit = said = whole = 0
    for x in content.extracted(df).collect():
        got, want = set(x["text"].split()), pages[x["page_id"]][1]
        hit, said, whole = hit + len(got & want), said + len(got - {"a0", "title"}), whole + len(want)
    assert hit >= 0.98 * whole and hit >= 0.98 * said


def test_odd_pages(spark):
    pages = [None, "", "plain words only here", "<p>", "<a href=x>one two</a> <a>three</a>", "</div></div><p>a b c d", "<div" * 50, "<p>x &lt;b&gt; &amp; y</p>", "a < b and c > d", "<nav>menu</nav>"]
    got = {x["page_id"]: x["text"] for x in content.extracted(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).collect()}
    assert [got[i] for i in (0, 1, 2, 3, 4, 5, 7, 8, 9)] == [None, "", "plain words only here", "", "", "a b c d", "x <b> & y", "a < b and c > d", ""]


def test_articles_of_the_test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    hit = said = whole = 0
    for x in content.extracted(pages).join(pages.select("page_id", "html"), "page_id").collect():
        want = collections.Counter(html.unescape(re.sub(r"<[a-zA-Z/!][^>]*>", " ", re.search(r"(?s)<article>(.*?)</article>", x["html"])[1])).split())
        got = collections.Counter(x["text"].split())
        hit, said, whole = hit + (got & want).total(), said + got.total(), whole + want.total()
    assert hit >= 0.97 * whole and hit >= 0.99 * said


def test_places_equal_plain_search(spark, monkeypatch):
    monkeypatch.setattr(needles, "CELLS", 600)
    monkeypatch.setattr(needles, "GROUP", 2)
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abé漢 ") for _ in range(n))
    texts = [word(r.randrange(0, 400)) for _ in range(60)] + [None, "", "a" * 9000 + "b", word(6000)]
    want = [word(r.randrange(0, 7)) for _ in range(150)] + ["a" * 3000, texts[3], "aab", "aab", None, "", texts[-1][1000:1900]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("k", "place", "needle")})
    n = spark.createDataFrame(list(enumerate(want)), "needle_id long, needle string")
    got = sorted(tuple(x) for x in needles.places(d, n).collect())
    plain = [(i, k, p) for i, t in enumerate(texts) for k, w in enumerate(want) if t and w for p in range(len(t) - len(w) + 1) if t.startswith(w, p)]
    assert got == sorted(plain) and len(plain) > 2000
    assert needles.places(d, n.limit(0)).count() == 0 and needles.places(d.limit(0), n).count() == 0


def test_too_many_needles_are_refused(spark, monkeypatch):
    monkeypatch.setattr(needles, "MOST_BYTES", 10)
    with pytest.raises(ValueError, match="needles"):
        needles.places(spark.createDataFrame([(1, "x")], "doc_id long, text string"), spark.createDataFrame([(1, "x" * 11)], "needle_id long, needle string"))
