"""Column functions on text and URLs; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

BLANK = r"^\s+|\s+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, BLANK, "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def norm(c: Column) -> Column:
    """Lower case, runs of anything but letters, digits and _ as one space."""
    return strip(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))


def tokens(c: Column, pattern: str = "[a-z0-9]+") -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def est_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("long")


def url_domain(url: Column) -> Column:
    """What stands between :// and the next slash, port and www. included."""
    return F.when(F.contains(url, F.lit("://")), F.get(F.split(url, "/"), F.lit(2))).otherwise("")


def url_host(url: Column) -> Column:
    """The network location in lower case, without any www."""
    return F.lower(F.replace(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("www."), F.lit("")))


def url_canonical(url: Column) -> Column:
    return F.regexp_replace(F.substring_index(url, "?", 1), "/+$", "")


def let(value: Column, fn) -> Column:
    """fn of a value that is evaluated once, however often fn uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _peeled(lines: Column) -> Column:
    """Without blank lines at the top, and without the first line if that is a scaffold's."""
    full = F.array_position(F.transform(lines, lambda x: x.rlike(r"\S")), True)  # first line with content, 0 if none
    body = let(full, lambda n: F.when(n > 0, F.slice(lines, F.greatest(n, F.lit(1)).cast("int"), F.size(lines))).otherwise(F.array().cast("array<string>")))
    lead = lambda x: x.rlike(P.LEAD_HEADER) | (x.rlike(P.LEAD_TITLE) & x.rlike(P.FORMAT_WORDS))
    return let(body, lambda ls: F.when(let(F.coalesce(F.get(ls, F.lit(0)), F.lit("")), lead), F.slice(ls, 2, F.greatest(F.size(ls), F.lit(1)))).otherwise(ls))


def strip_scaffold(text: Column) -> Column:
    """Peels at most two leading scaffold lines, blank lines before each, and outer white space."""
    return strip(F.array_join(let(let(F.split(text, "\n"), _peeled), _peeled), "\n"))


def strip_boilerplate(text: Column) -> tuple[Column, Column]:
    """The text without boilerplate lines, and how many there were; gaps close only where one was."""
    n = F.regexp_count(text, F.lit("(?md)" + P.BOILERPLATE))
    out = F.regexp_replace(text, "(?md)" + P.BOILERPLATE, "")
    return F.when(n > 0, strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))).otherwise(text), n.cast("long")


def tags(text: Column, named: dict[str, str] = P.CONTAMINATION) -> Column:
    """Names of the patterns that match, in one projection."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in named.items()]), lambda x: x.isNotNull())


def wiki_strip(text: Column) -> Column:
    for p, r in P.WIKI:
        text = F.regexp_replace(text, p, r)
    lines = F.transform(F.split(text, "\n"), lambda x: strip(F.regexp_replace(x, r"^\*+\s*", "")))
    return F.array_join(F.filter(lines, lambda x: (x != "") & (x != "}}")), "\n")


def citations(text: Column) -> Column:
    """Ordered distinct links in brackets, without blocked domains."""
    urls = F.transform(F.regexp_extract_all(text, F.lit(r"\[(https?://[^\s\]]+)"), F.lit(1)), lambda u: F.regexp_replace(u, r"[.,);]+$", ""))
    blocked = lambda u: F.exists(F.array(*[F.lit(b) for b in P.BLOCKED_SUBSTRINGS]), lambda b: F.contains(url_host(u), b))
    return F.array_distinct(F.filter(urls, lambda u: ~blocked(u)))


#: Steps from HTML to text: what is dropped whole, what breaks lines, other tags, entities.
HTML = (
    *((rf"(?is)<{tag}\b.*?</{tag}\s*>", " ") for tag in ("script", "style", "nav", "header", "footer", "aside", "noscript", "form")),
    (r"(?s)<!--.*?-->", " "), (r"(?is)<head\b.*?</head\s*>", " "), (r'(?is)<div class="(?:ad|ads|menu|sidebar|cookie)[^"]*">.*?</div\s*>', " "),
    (r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|blockquote|pre)\b[^>]*>", "\n"), (r"(?s)<[^>]+>", ""),
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"), (r"[ \t]+", " "), (r" ?\n[ \n]*", "\n"),
)


def html_text(html: Column) -> Column:
    """Main text of a page, an approximation by built-in expressions."""
    for p, r in HTML:
        html = F.regexp_replace(html, p, r)
    return strip(html)


def html_title(html: Column) -> Column:
    t = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1)
    for p, r in [x for x in HTML if x[0].startswith("&")]:
        t = F.replace(t, F.lit(p), F.lit(r))
    return squeeze(t)
