"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines, one for each block of text. A line's weight is the number of its characters outside
links, and none inside navigation, headers, footers, sidebars, notices, adverts, forms and comments. Weights are summed
over a sliding window of lines. From one dive of the sum to nothing to the next, lines make a stretch; stretches whose sum
surges to a threshold are main text, with all of their lines that have weight, however short, and are joined: only lines
of links lie between them. Marks of an article (article, main, role or itemprop) change weights and nothing else: inside
the mark links count as text, outside it characters count for a fraction. Of several marked blocks, those much smaller
than the largest are teasers and count as outside.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondera.llm.common import table

#: Lines summed at a time; a surge needs so many characters in a window; the window sum must fall to zero for a dive.
WINDOW_LINES, SURGE_CHARS = 3, 80
#: On pages with a mark, so many characters outside it weigh as one; a marked block under this share of the largest is a teaser.
OUTSIDE_CHARS, TEASER_SHARE = 16, 0.3
#: A line with more than this share of its characters in links is a menu line.
LINK_SHARE = 0.5

_RAW = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template|svg|math|iframe|object|textarea|select|title|canvas|audio|video)\b[^>]*>.*?(?:</\1\s*>|$)|<![^>]*>|<\?[^>]*>", re.I | re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>", re.S)
_ATTR = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")
_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*$""")  # not the last / of a bare value
#: Elements that end a line, elements that hold no main text, elements without an end tag.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
_CHROME = frozenset("aside button dialog footer form head header label menu nav".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OWN_END = frozenset("article aside body center dialog div footer form header head html main menu nav section ul ol table fieldset button label".split())
_CHROME_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|sidebar|side-bar|footer|header|masthead|"
    r"cookie\w*|consent|gdpr|notice\w*|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social\w*|"
    r"comments?|comment-\w+|disqus\w*|replies|respond|related|recommend\w*|widget\w*|pagination|pager|toolbar|copyright|disclaimer|legal)(?:$|[\s_-])",
    re.I,
)
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())


def _kind(name: str, attributes: str, in_article: bool) -> str:
    """chrome, article or nothing, for an element that begins."""
    found = {k.lower(): (a or b or c or "") for k, a, b, c in _ATTR.findall(attributes)} if attributes else {}
    role = found.get("role", "").lower()
    if name == "article" or name == "main" or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody":
        return "chrome" if name == "article" and _CHROME_NAMES.search(f"{found.get('class', '')} {found.get('id', '')}") else "article"
    if name in _CHROME and not (name in ("header", "label") and in_article):
        return "chrome"
    if role in _CHROME_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return "chrome"
    if found and name in _OWN_END | {"p", "li", "span"} and (_CHROME_NAMES.search(found.get("class", "")) or _CHROME_NAMES.search(found.get("id", ""))):
        return "chrome"
    return ""


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """(text, weight, marked block) of the lines of a page, in order; blocks count from 1, and 0 is outside of all."""
    page = _RAW.sub(" ", page)
    out: list[tuple[str, int, int]] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, str]] = []  # open elements that matter: (name, kind)
    chrome = article = link = blocks = 0
    at = 0

    def end_line() -> None:
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                own = len(text) - linked
                out.append((text, 0 if linked > LINK_SHARE * len(text) else max(1, own), blocks if article else 0))
            parts, linked = [], 0

    def take(piece: str) -> None:
        nonlocal linked
        if piece and not chrome:
            parts.append(piece)
            if link:
                linked += len(html.unescape(piece).strip())

    for m in _TAG.finditer(page):
        take(page[at : m.start()])
        at = m.end()
        closes, name, attributes = (m.group(1), m.group(2).lower(), m.group(3)) if m.group(2) else (m.group(4), m.group(5).lower(), m.group(6))
        if name == "br":
            if parts:
                parts.append(" ")
            continue
        if name in _BLOCKS:
            end_line()
        if name in _VOID:
            continue
        if name == "a":
            link = 0 if closes else 1
            continue
        if closes:
            names = [s[0] for s in stack]
            if name in names:
                while stack:
                    gone, kind = stack.pop()
                    chrome -= kind == "chrome"
                    article -= kind == "article"
                    if gone == name:
                        break
        elif not _CLOSED.search(attributes):
            kind = _kind(name, attributes, article > 0)
            if kind or name in _OWN_END:
                stack.append((name, kind))
                chrome += kind == "chrome"
                blocks += kind == "article" and not article
                article += kind == "article"
    take(page[at:])
    end_line()
    return out


def sides_of(lines: list[tuple[str, int, int]]) -> list[list[tuple[int, int]]]:
    """(place, weight) of the lines inside the mark and of those outside; on a page without a mark, of all lines."""
    size: dict[int, int] = {}
    for text, weight, block in lines:
        if block and weight:
            size[block] = size.get(block, 0) + len(text)
    if not size:
        return [[(i, weight) for i, (_, weight, _) in enumerate(lines)]]
    main = {block for block, n in size.items() if n >= TEASER_SHARE * max(size.values())}
    inside = [(i, len(text)) for i, (text, _, block) in enumerate(lines) if block in main]
    return [inside, [(i, weight // OUTSIDE_CHARS) for i, (_, weight, block) in enumerate(lines) if block not in main]]


def stretches_of(side: list[tuple[int, int]], window: int) -> list[tuple[int, list[int]]]:
    """(highest window sum, places of lines with weight) of each stretch between two dives."""
    out, high, own = [], 0, []
    for at in range(len(side) + 1):
        total = sum(weight for _, weight in side[at : at + window])
        if total:
            high = max(high, total)
            if side[at][1]:
                own.append(side[at][0])
        elif own:
            out.append((high, own))
            high, own = 0, []
    return out


def main_text(page: str | None, window: int = WINDOW_LINES, surge: int = SURGE_CHARS) -> str:
    """The main text of a page; empty for null, for an empty page and where no line has weight.

    A page without any surge is a short one: its text is all that has weight, inside the mark if there is one.
    """
    lines = lines_of(page or "")
    sides = [stretches_of(side, window) for side in sides_of(lines)]
    kept = [own for side in sides for high, own in side if high >= surge] or [own for _, own in sides[0]]
    return " ".join(lines[i][0] for i in sorted(i for own in kept for i in own))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with text and n_chars (code points). Columns of those names are replaced.

    A null or empty page has an empty text of 0 characters. Rows are independent, so repeated rows get equal answers; an
    empty table gives no rows. Pages are read whole, in time that grows with their length.
    """

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p) for p in batch], dtype="object")

    return pages.withColumn("text", of(html_col)).withColumn("n_chars", F.length("text").cast("long"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
