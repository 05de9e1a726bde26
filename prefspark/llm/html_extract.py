"""Operator 8: main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page. A line's weight is the length of
its text; lines of menus, headers, footers, sidebars, notices, adverts, forms and comments (known
by element, role, class or id; html, body, main and article never by class or id) and text in links outside an article weigh nothing. Weights are
summed over windows of WINDOW lines with text. Going down the page, the sums surge where the main text
begins and dive to nothing where it ends; each stretch between a surge and the next dive whose
highest sum reaches the threshold is kept, from its first to its last weighted line.

If a page has an article or main element with text, only the lines inside weigh, and any
weighted stretch is kept; but if one stretch outside weighs more than CARD_TIMES all of them,
they are cards beside the story, and only the lines outside weigh. There, and without such an
element, the threshold is a share of the page's highest sum. A class or id counts as a name of
surroundings if all its parts do or are words for boxes: related-posts does, related-work doesn't.

Edge cases: null or empty html, or a page without such text, gives an empty text; unclosed
elements end with the page, a page cut off inside a tag loses that tag only; rows repeat as
given; only the id, url and html columns are read, so further columns never clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
SURGE_SHARE = 0.2  # of the highest window sum, on pages without an article element
SURGE_CHARS = 80  # and at most so many characters
CARD_TIMES = 3  # articles are cards beside the story if one stretch outside weighs over so many times all of them

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME_PART = re.compile(r"[a-z]+")

# Elements whose content is no text of the page.
RAW = frozenset("script style title textarea noscript template iframe svg math canvas object audio video head".split())
RAW_TEXT = frozenset("script style title textarea iframe noscript".split())  # ends only at its own end tag
# Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody "
    "tfoot thead tr ul button".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements of the page around the article.
AROUND = frozenset("nav aside footer form menu dialog button select".split())
NEVER_AROUND_ARTICLE = frozenset("nav header menu form".split())
AROUND_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# Parts of class and id names that mark such elements.
AROUND_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs footer comment comments disqus cookie cookies consent gdpr notice newsletter subscribe signup login popup modal "
    "overlay share sharing social related recommended pagination pager widget widgets toolbar masthead".split()
)
# Parts that may stand beside these in a name; any other part makes it the name of something else (related-work, ad-free).
BESIDE_NAMES = frozenset(
    "a after all app area article articles author bar before block body bottom box btn button buttons card center col column "
    "compact component container content contents count dark default desktop element end entries entry feed fixed float "
    "floating footer form full global grid group head header heading holder horizontal icon icons id in inline inner input "
    "item items js layout left light link links list lower main meta middle mobile more nested news outer page panel post "
    "posts primary reader region respond right row secondary section side site sites slot small space spot sticky stories story "
    "target text thread title to top ul unit up upper user vertical view wrap wrapper zone".split()
)
# Beside these a header is the article's own.
ARTICLE_WORDS = frozenset("article articles entry post story".split())
# Parts after which the rest of a class is a state of the element (no-sidebar, has-comments), and elements no name makes surroundings.
STATE_WORDS = frozenset("no not non has have with without hide hides hidden show shows".split())
NEVER_BY_NAME = frozenset("html body main article".split())


def _around_name(parts: set[str], in_article: bool) -> bool:
    """Whether a class or id of these parts names surroundings of the article: all its parts speak of them or of a box."""
    if parts - AROUND_NAMES - BESIDE_NAMES:
        return False
    header = "header" in parts and not in_article and not parts & ARTICLE_WORDS
    return bool(parts & AROUND_NAMES) or "side" in parts and "bar" in parts or header


def _around(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in AROUND or tag == "header" and not in_article:
        return True
    if not attributes or attributes.isspace():
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            for token in value.split() if tag not in NEVER_BY_NAME else ():
                if _around_name(set(takewhile(lambda part: part not in STATE_WORDS, _NAME_PART.findall(token))), in_article):
                    return True
        elif name == "role" and value in AROUND_ROLES:
            return True
        elif name == "hidden" and tag not in ("body", "html") or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def lines_of(html: str) -> list[tuple[str, int, bool]]:
    """(text, weight, inside an article or main element) of every line, in page order."""
    lines: list[tuple[str, int, bool]] = []
    text: list[str] = []
    linked = 0
    open_tags: list[tuple[str, bool]] = []  # (name, whether it begins a part around the article)
    around = articles = links = 0
    raw_until = None

    def end_line() -> None:
        nonlocal linked
        line = " ".join("".join(text).split())
        weight = 0 if around else len(line) - (0 if articles else min(linked, len(line)))
        lines.append((line, weight, articles > 0))
        text.clear()
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked
        if piece and raw_until is None:
            piece = unescape(piece)
            text.append(piece)
            if links:
                linked += len(piece)

    def close(upto: int) -> None:
        """Close the open elements from ``upto`` on."""
        nonlocal around, articles, links
        for name, is_around in open_tags[upto:]:
            around -= is_around
            articles -= name in ("article", "main")
            links -= name == "a"
        del open_tags[upto:]

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() < at:
            continue
        say(html[at : m.start()])
        at = m.end()
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:  # a comment or declaration
            continue
        tag = tag.lower()
        if raw_until is not None:
            if slash and tag == raw_until:
                raw_until = None
            continue
        if slash:
            upto = next((k for k in range(len(open_tags) - 1, -1, -1) if open_tags[k][0] == tag), None)
            if tag in BLOCK:
                end_line()
            if upto is not None:
                close(upto)
            continue
        if tag in BLOCK:
            end_line()
        if tag in ("br", "td", "th"):
            text.append(" ")
        if tag in VOID:
            continue
        if tag in RAW and not attributes.endswith("/"):
            raw_until = tag
            if tag in RAW_TEXT:  # tags inside are text: go on at its end tag
                end = re.compile(rf"</{tag}", re.I).search(html, at)
                at = end.start() if end else len(html)
            continue
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag == "p" or tag == "li":  # the end tag of the one before may be left out
            upto = next((k for k in range(len(open_tags) - 1, -1, -1) if open_tags[k][0] in BLOCK or open_tags[k][0] == "td"), None)
            if upto is not None and open_tags[upto][0] == tag:
                close(upto)
        if around and tag in ("main", "article"):
            first = next(k for k, (_, is_around) in enumerate(open_tags) if is_around)
            if tag == "main" or all(name in NEVER_AROUND_ARTICLE for name, is_around in open_tags if is_around):
                close(first)  # a menu or header that was never closed
        is_around = _around(tag, attributes, articles > 0)
        open_tags.append((tag, is_around))
        around += is_around
        articles += tag in ("article", "main") and not around
        if tag in ("article", "main") and around:
            open_tags[-1] = ("article-around", is_around)
        links += tag == "a"
    say(html[at:])
    end_line()
    return lines


def stretches(weights: list[int]) -> list[tuple[int, int, int]]:
    """(first line, line after the last, highest window sum) between each surge of the window sums and the next dive."""
    sums = [sum(weights[max(0, i - WINDOW + 1) : i + 1]) for i in range(len(weights) + WINDOW - 1)]
    found, i = [], 0
    while i < len(sums):
        if not sums[i]:
            i += 1
            continue
        surge = i  # from nothing to something: the window's last line is the stretch's first
        while i < len(sums) and sums[i]:
            i += 1
        found.append((surge, min(i, len(weights)), max(sums[surge:i])))  # it dived at i: no window up to there has text
    return found


def main_text(html: str | None) -> str:
    """Blocks of the main text, joined by an empty line."""
    lines = [line for line in lines_of(html or "") if line[0]]  # nested blocks leave empty lines
    inside = [weight if within else 0 for _, weight, within in lines]
    outside = [0 if within else weight for _, weight, within in lines]
    parts, threshold = stretches(inside), 1
    beside = stretches(outside)
    if max((sum(outside[first:end]) for first, end, _ in beside), default=0) > CARD_TIMES * sum(inside):
        parts, inside = beside, outside
        threshold = max(1, min(SURGE_CHARS, SURGE_SHARE * max(highest for _, _, highest in beside)))
    kept = [lines[i][0] for first, end, highest in parts if highest >= threshold for i in range(first, end) if inside[i]]
    return "\n\n".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page's main text."""
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    kinds = [f.dataType.simpleString() for f in rows.schema]
    return rows.mapInArrow(_extract, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
