"""Main text of web pages by block density, without a parser.

A page is cut at its tags into segments; segments between two block-level tags make a block. Which container a block stands in, and
whether inside a link or inside navigation, follows from prefix sums over opening and closing tags, so unclosed and
stray tags cost nothing but their level. A block counts if its words stand outside navigation and mostly outside links;
how many words it needs follows from the page, a share of the length of the block in which a word of the page stands on average.
A container counts if the words of its blocks that count are a share of the best one's, so that a lone paragraph
of an advertisement goes while the parts of an article that is spread over nested containers stay; within an article or main
element all do. Headings and short lines stay where they stand between blocks that stay, or just before one, in a container that counts.

Scripts, styles, comments and heads are taken out before, by built-in functions. Null pages give null; pages without text, or
with nothing but links, give an empty text; pages of any length are read whole, one at a time.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.catalog import query
from ..plans.shared import ship

UNSEEN = r"(?is)<!--.*?-->|<(script|style|noscript|template|svg|head)\b[^>]*>.*?</\1\s*>"
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*)[^>]*>|<[!?][^>]*>")
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i img ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
HOLDS = frozenset("article aside blockquote body dd div fieldset figure footer form header li main nav ol section table td th tr ul".split())
AWAY = frozenset("aside button dialog footer form menu nav select".split())
BODY = frozenset(("article", "main"))
WORD, ENDS = re.compile(r"\S+"), frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Most share of a block's characters that are links; parts of the mean block and of the best container that a block and a container need; words that are always enough.
LINKS, OF_MEAN, OF_BEST, ENOUGH = 1 / 3, 1 / 8, 1 / 5, 12


def depth(step: np.ndarray) -> np.ndarray:
    """Levels after each step of +1, -1 or 0, where a closing at level 0 counts for nothing."""
    s = np.cumsum(step)
    return s - np.minimum(np.minimum.accumulate(s), 0)


def blocks(page: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, share of links, container, whether away from the text, whether in an article, of each block with words."""
    found = list(TAG.finditer(page))
    names = [(m[2] or "").lower() for m in found]
    sign = np.array([0, *[0 if not n or m[0].endswith("/>") else -1 if m[1] else 1 for m, n in zip(found, names, strict=True)]])
    of = lambda group: np.array([False, *[n in group for n in names]])
    level = lambda group: depth(np.where(of(group), sign, 0))
    holds, inline = of(HOLDS), of(INLINE)
    tree = depth(np.where(holds, sign, 0))
    opens = np.flatnonzero(holds & (sign > 0))
    home, order = np.zeros(tree.size, np.int64), np.lexsort((opens, tree[opens]))
    ranked, base = opens[order], tree.size + 1
    at = np.searchsorted(tree[ranked] * base + ranked, tree * base + np.arange(tree.size), "right") - 1  # the last container opened at this level
    home = np.where(tree > 0, ranked[np.maximum(at, 0)] if ranked.size else 0, 0)
    away, body, link = level(AWAY) > 0, level(BODY) > 0, level(frozenset("a")) > 0
    block = np.cumsum(np.r_[False, ~inline[1:]])
    edges = [0, *[x for m in found for x in m.span()], len(page)]
    texts: dict[int, list[str]] = {}
    chars, linked, first = {}, {}, {}
    for i in range(tree.size):
        part = page[edges[2 * i] : edges[2 * i + 1]]
        if part:
            b, n = int(block[i]), len("".join(part.split()))
            texts.setdefault(b, []).append(part)
            chars[b], linked[b] = chars.get(b, 0) + n, linked.get(b, 0) + n * bool(link[i])
            if n:
                first.setdefault(b, i)
    kept = sorted(first)
    where = np.array([first[b] for b in kept], np.int64)
    return ["".join(texts[b]) for b in kept], np.array([linked[b] / chars[b] for b in kept]), home[where], away[where], body[where]


def main_text(page: str) -> tuple[str, int, int]:
    """The text, its blocks by lines; blocks of the page, and those that stay."""
    texts, links, home, away, body = blocks(page)
    texts = [" ".join(html.unescape(t).split()) for t in texts]
    words = np.array([len(WORD.findall(t)) for t in texts], np.float64)
    if not words.sum():
        return "", len(texts), 0
    near = ~away & (links <= LINKS)
    fine = np.where(near, words, 0)
    need = min(ENOUGH, OF_MEAN * (fine**2).sum() / max(fine.sum(), 1))
    rich = near & (words >= need)
    if (rich & body).any():
        good = body
    else:
        of = np.unique(home, return_inverse=True)[1]
        score = np.bincount(of, np.where(rich, words, 0))
        good = (score >= OF_BEST * score.max())[of] & (score.max() > 0)
    stays = rich & good
    at = np.flatnonzero(stays)
    if at.size:  # short ones between those that stay, and the one just before the first
        inside = np.zeros(words.size, bool)
        inside[max(at[0] - 1, 0) : at[-1] + 1] = True
        stays |= inside & near & good
    return "\n".join(t for t, s in zip(texts, stays, strict=True) if s), len(texts), int(stays.sum())


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, title, text, n_blocks, n_kept); one narrow pass."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), X.html_title(F.col(html_col)).alias("title"), F.regexp_replace(html_col, UNSEEN, " ").alias("page"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [main_text(p) if p is not None else (None, None, None) for p in b.column("page").to_pylist()]
            text, n, kept = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("title"), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(kept, pa.int64())], names=["page_id", "title", "text", "n_blocks", "n_kept"])

    return rows.mapInArrow(run, f"page_id {kind}, title string, text string, n_blocks bigint, n_kept bigint")


@query("main_text")
def _main(t):
    return extracted(t("pages").select("page_id", "html"))
