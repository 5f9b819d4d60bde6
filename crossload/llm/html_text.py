"""Main text of a page: the maximum-scoring run of its words and tags.

Words score WORD, tags a negative weight, and a linear scan finds the contiguous run with the
largest sum. Tag weights are learned from pages that mark their own content: where a page has an
article or main element, each tag's share outside of it, over all such pages, sets its price, so
links and list items of menus end a run and paragraphs hardly do. Only HTML's own tags are learned; a share is
smoothed by PRIOR sightings at the default price, and tags of other names cost that.

A page that has articles is scanned article by article (the outermost ones, one run each, joined in page order), one
that has only a main element within that, any other as a whole. What stands in boilerplate elements
(menus, headers, footers, forms, asides, scripts) never scores and is left out of the run. So is what stands in elements
with a class, id or role of NOISE (compared as a whole: has-sidebar is no sidebar); if nothing on a page scores
then, such names are taken for layout and the page is scanned without them.

Null or empty pages give the empty text. Ties take the earliest run. Repeated rows give the same
text. Very long pages are read whole, in one row's memory; an empty table gives no rows; text and n_chars
replace columns of these names, and all others stay. Quotes in a tag count after an equals sign only, and
one that is never closed ends with the tag. End tags that HTML implies are implied (a paragraph ends with the next
block, a list item with the next one, cells and rows likewise). Malformed markup is read as far as it goes: an element that is
never closed ends with the element around it.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WORD = 1.0
DEFAULT_TAG = -1.0
OUTSIDE = -6.0
PRIOR = 20
# HTML element names, and names of classes, ids and roles, by their role.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select", "math", "canvas"}
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "head", "button", "menu", "dialog"} | RAW
BLOCKS = {
    "address", "article", "blockquote", "body", "br", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure",
    "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table",
    "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
} | BOILERPLATE
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "cite", "code", "data", "del", "dfn", "em", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small",
    "span", "strong", "sub", "sup", "time", "u", "var", "caption", "audio", "video", "picture", "fieldset", "legend", "output", "meter", "progress",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
KNOWN = BLOCKS | INLINE | VOID
CONTENT = {"article", "main"}
NOISE = {
    "ad", "ads", "advert", "advertisement", "advertising", "advertorial", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "cookie-banner",
    "cookie-notice", "consent", "complementary", "contentinfo", "disqus", "disqus_thread", "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notices", "popup", "promo", "promotion", "related", "related-posts", "share", "share-buttons", "sharing", "sidebar", "site-footer", "site-header",
    "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
# what an element of a name ends, if it is open and none of the others is in between
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}),
}
ENDS |= {name: ({"p"}, CONTENT | {"div", "section", "td", "th", "li", "dd", "blockquote", "body", "button", "figure", "aside"}) for name in BLOCKS - VOID - ENDS.keys() - {"body", "html"} | {"hr"}}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>|([^<]+|<)", re.S)
NAMED = re.compile(r"(?i)\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")


def tokens(page: str) -> Iterator[tuple[str, str, bool, bool]]:
    """(kind, value, dead, noise) of a page in order: kind is open, close or text; dead in boilerplate elements, noise
    in elements whose names say so."""
    stack: list[tuple[str, bool, bool]] = []
    dead, noisy, at, n = 0, 0, 0, len(page)

    def drop(held: int) -> Iterator[tuple[str, str, bool, bool]]:
        nonlocal dead, noisy
        while len(stack) > held:
            name, a, b = stack.pop()
            dead, noisy = dead - a, noisy - b
            if len(stack) > held:  # implied ends of what was open within
                yield "close", name, dead > 0, noisy > 0

    while at < n:
        m = TOKEN.match(page, at)
        if not m:
            yield "text", page[at], dead > 0, noisy > 0
            at += 1
            continue
        at = m.end()
        close, name, attributes, text = m.groups()
        if text is not None:
            yield "text", text, dead > 0, noisy > 0
        elif name:
            name = name.lower()
            if close:
                held = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
                if held is not None:
                    yield from drop(held)
                yield "close", name, dead > 0, noisy > 0
            elif name in RAW:
                end = re.compile(rf"(?i)</{re.escape(name)}\s*>").search(page, at)
                at = end.end() if end else n
                yield "open", name, True, noisy > 0
            else:
                ended, border = ENDS.get(name, ((), ()))
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ended:
                        last = stack[k][0]
                        yield from drop(k)
                        yield "close", last, dead > 0, noisy > 0
                        break
                    if stack[k][0] in border:
                        break
                if name in VOID or attributes.rstrip().endswith("/"):
                    yield "open", name, dead > 0, noisy > 0
                    continue
                own = name in BOILERPLATE and not (name == "header" and any(x in CONTENT for x, _, _ in stack))
                names = {w for v in NAMED.findall(attributes) for w in v.strip("\"'").lower().split()}
                loud = name not in {"main", "body", "html"} and not names.isdisjoint(NOISE)
                stack.append((name, own, loud))
                dead, noisy = dead + own, noisy + loud
                yield "open", name, dead > 0, noisy > 0


def learn_weights(pages: DataFrame, column: str = "html") -> dict[str, float]:
    """Tag weights from all pages that mark their content; one row per tag name comes back."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            inside, outside = Counter(), Counter()
            for page in p[column]:
                if not page or not re.search(r"(?i)<(?:article|main)\b", page):
                    continue
                depth = 0
                for kind, name, dead, _ in tokens(page):
                    if kind != "text" and name in KNOWN and not dead:  # what is dead is left out in any case
                        depth += (name in CONTENT) * (1 if kind == "open" else -1)
                        (inside if depth > 0 else outside)[name] += 1
            names = set(inside) | set(outside)
            yield pd.DataFrame([(t, inside[t], outside[t]) for t in names], columns=["tag", "i", "o"])

    rows = (
        pages.select(column).mapInPandas(count, "tag string, i long, o long")
        .groupBy("tag").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).collect()  # as many rows as HTML has tags, at most
    )
    return {r["tag"]: (OUTSIDE * r["o"] + DEFAULT_TAG * PRIOR) / (r["i"] + r["o"] + PRIOR) - 0.01 for r in rows}


def best_run(scores: list[float]) -> tuple[float, int, int]:
    """The largest sum of neighbouring scores, over 0, and from where to where it goes; the earliest of several."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, span = total, (start, k + 1)
    return best, *span


def scan(found: list[tuple[str, str, bool, bool]], weights: dict[str, float], heed: bool) -> list[str]:
    """The text of the best run of some tokens, in pieces; heed: whether names that say noise count."""
    pieces: list[str] = []
    scores: list[float] = []
    for kind, value, dead, noise in found:
        noise = noise and heed
        if kind == "text":
            if not dead:
                text = entities.unescape(value)
                pieces.append("" if noise else text)
                scores.append(0.0 if noise else WORD * len(text.split()))
        elif not (dead or noise) or value in BOILERPLATE:
            pieces.append(" " if value in BLOCKS else "")
            scores.append(0.0 if value in BOILERPLATE or value in CONTENT else weights.get(value, DEFAULT_TAG))
    _, start, end = best_run(scores)
    return pieces[start:end]


def regions(found: list[tuple[str, str, bool, bool]], heed: bool) -> list[list[tuple[str, str, bool, bool]]]:
    """The tokens of the outermost articles that aren't boilerplate, else of the main elements, else all."""
    for name in ("article", "main"):
        out, depth = [], 0
        for t in found:
            kind, value, dead, noise = t
            if kind == "open" and value == name and not dead and not (noise and heed):
                if not depth:
                    out.append([])
                depth += 1
            elif depth and kind == "open" and value == name:
                depth += 1
            elif depth and kind == "close" and value == name:
                depth -= 1
            if depth:
                out[-1].append(t)
        if out:
            return out
    return [found]


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text of one page."""
    found = list(tokens(page or ""))
    for heed in (True, False):
        parts = [x for r in regions(found, heed) for x in [*scan(r, weights, heed), " "]]
        if text := " ".join("".join(parts).split()):
            return text
    return ""


def extract_text(pages: DataFrame, weights: dict[str, float] | None = None, column: str = "html") -> DataFrame:
    """pages with text and n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(learn_weights(pages, column) if weights is None else weights)

    @F.pandas_udf("string")
    def main_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            yield pd.Series([extract(x, shared.value) for x in p], dtype=object)

    return pages.withColumn("text", main_text(column)).withColumn("n_chars", F.char_length("text").cast("long"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
