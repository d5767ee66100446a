"""Operator 3, HTML extraction: two-pass block rules.

A page is cut into blocks at block-level tags; what stands in menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments, by element or by the words of its class, id or role, never becomes a block.
Pass one decides blocks: many links are no text; enough stop words, or sheer length, are. Pass two gives each ambiguous (short)
block the label of its nearest decided neighbours, of two at equal distance that differ the bad one. An article or main element
with most of the page's words is one more feature: blocks outside are no text, and inside only short list items of nothing but
links are bad, other blocks with many links are ambiguous. Where nothing is decided, ambiguous blocks are text: what marks
boilerplate by name is gone before, and pages in other languages or without sentences have no stop words.

Defined cases: a null or empty page has empty text; unclosed, misnested and cut-off tags are closed as browsers do;
a `<` that starts no tag is text; pages are read whole; equal rows give equal results; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui se son sont sur un une vous "
    "aber als am an auch auf aus bei das dass dem den der des die ein eine einem einen er es für hat ich im in ist mit nicht noch oder sich sie sind und von war wie zu zum zur "
    "al como con del el ella en entre era es esta este ha la las lo los más muy no o para pero por se ser sin su sus también un una y".split()
)
MIN_STOP_DENSITY, GOOD_WORDS, LONG_WORDS, MAX_LINK_DENSITY, MENU_LINK_DENSITY = 0.15, 10, 40, 0.5, 0.9

# Fixed values of HTML: element names by what they do.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option "
    "optgroup p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg object canvas title annotation annotation-xml".split())
#: Of these, what browsers read to the page's end if they aren't closed; the others are then as if they weren't there.
UNENDING = frozenset("script style textarea iframe title".split())
DROPPED = frozenset("head nav footer aside form button select dialog menu fieldset datalist audio video".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS_AT = frozenset("ul ol dl table div section article main body nav aside footer header".split())
#: Words of class, id and role that mark what is not the article, wherever they stand in a name.
MARKS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense sponsor sponsored promo banner cookie cookies gdpr popup modal overlay sidebar nav navbar navigation "
    "menu breadcrumb breadcrumbs pagination pager footer masthead comments commentlist disqus sharebar newsletter signup searchbox widget toolbar skiplink topbar complementary contentinfo".split()
)
#: Words that do so as a whole class or role, or beside words of form alone: `share-buttons`, but not `share-price`.
WEAK_MARKS = frozenset(
    "promotion consent notice notices alert comment reply replies respond social share sharing related recommended subscribe subscription login search copyright disclaimer skip".split()
)
FORMS = frozenset(
    "area bar block box btn button buttons card cards container content div entries entry footer form group header holder icon icons inner item items link links list module articles news outer panel post posts row "
    "section stories story text title top bottom left right widget wrap wrapper".split()
)
HEADER_MARKS = frozenset(["header", "banner", "masthead", "topbar"])
#: A class of one of these first words speaks of a layout, not of the element itself.
LAYOUTS = frozenset("has no not with without is page layout wrapper container content".split())
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|$))|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)>?", re.S)
#: Letters of scripts that don't part words; two count as a word.
_UNPARTED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW}


class Block:
    __slots__ = ("parts", "links", "inside", "item")

    def __init__(self, inside: bool, item: bool):
        self.parts: list[str] = []
        self.links: list[str] = []
        self.inside, self.item = inside, item


def marks_of(attributes: str) -> set[str]:
    """The marks among the words of an element's classes, id and role, without those of layouts. An id of a single weak word names a section's subject."""
    marks: set[str] = set()
    for m in _NAMED.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
            if not words or words[0] in LAYOUTS:
                continue
            marks.update(w for w in words if w in MARKS or w in HEADER_MARKS)
            if all(w in WEAK_MARKS or w in FORMS for w in words) and (len(words) > 1 or m[1].lower() != "id"):
                marks.update(w for w in words if w in WEAK_MARKS)
    return marks


def dropped(name: str, attributes: str, inside: bool) -> int:
    """2: the element and all below it is no article; 1: only headings below it are; 0: neither."""
    if name in DROPPED:
        return 2
    marks: set[str] = set()
    if attributes and (name not in ("html", "body", "article", "main") or name == "article" and inside):
        marks = marks_of(attributes)
        if name != "article" and _HIDDEN.search(attributes):
            return 2
    if name == "header" or marks & HEADER_MARKS:
        return 1 if inside else 2
    return 2 if marks else 0


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, without those of dropped elements."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    gone = headers = anchors = regions = headings = 0
    block = None
    at, end = 0, len(page)
    unclosed: set[str] = set()

    def pop() -> None:
        nonlocal gone, headers, anchors, regions, headings
        name, kind = stack.pop()
        opened[name] -= 1
        gone -= kind == 2
        headers -= kind == 1
        anchors -= name == "a"
        regions -= name in ("article", "main")
        headings -= name in ("h1", "h2", "h3", "h4", "h5", "h6")

    def close_to(names: set[str] | frozenset[str], scope: frozenset[str]) -> None:
        if not any(opened[name] for name in names):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                while len(stack) > i:
                    pop()
                return
            if stack[i][0] in scope:
                return

    def text(piece: str) -> None:
        nonlocal block
        if gone or headers and not headings or not piece:
            return
        if block is None:
            if piece.isspace():
                return
            out.append(block := Block(regions > 0, opened["li"] > 0))
        (block.links if anchors else block.parts).append(piece)
        if anchors:
            block.parts.append(piece)

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        if lt > at:
            text(page[at:lt])
        m = _TOKEN.match(page, lt)
        if not m:
            text("<")
            at = lt + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name in BLOCK:
            block = None
        elif name == "br":
            text(" ")
        if m[1]:
            close_to({name}, frozenset() if name in BLOCK else STOPS_AT)
            continue
        if name in RAW:
            # only foreign elements close themselves: a script's slash is an attribute's
            if name != "svg" or not m[3].endswith("/"):
                e = None if name in unclosed else _RAW_END[name].search(page, at)
                if e is None:
                    unclosed.add(name)  # nor is any later one
                at = e.end() if e else end if name in UNENDING else at
            continue
        if name in VOID:
            continue
        if name in CLOSES:
            close_to(CLOSES[name], STOPS_AT)
        elif name == "a":
            close_to({"a"}, STOPS_AT)
        if name in BLOCK:
            close_to({"p"}, STOPS_AT)
        kind = dropped(name, m[3], regions > 0)
        stack.append((name, kind))
        opened[name] += 1
        gone += kind == 2
        headers += kind == 1
        anchors += name == "a"
        regions += name in ("article", "main")
        headings += name in ("h1", "h2", "h3", "h4", "h5", "h6")
    return out


def extract(page: str | None) -> str:
    """The article of one page."""
    if not page:
        return ""
    found = []
    for b in blocks_of(page):
        if text := " ".join(html.unescape("".join(b.parts)).split()):
            link = len(" ".join(html.unescape("".join(b.links)).split())) if b.links else 0
            found.append((text, link / len(text), len(text.split()) + len(_UNPARTED.findall(text)) // 2, b.inside, b.item))
    inside = sum(n for _, links, n, own, _ in found if own and links <= MAX_LINK_DENSITY)
    bounded = any(x[3] for x in found) and 2 * inside >= sum(n for _, links, n, *_ in found if links <= MAX_LINK_DENSITY)
    if bounded:
        found = [x for x in found if x[3]]
    labels = [label_of(text, links, n, bounded, item) for text, links, n, _, item in found]
    return "\n".join(x[0] for x, keep in zip(found, settle(labels), strict=True) if keep)


def label_of(text: str, links: float, n: int, inside: bool, item: bool) -> bool | None:
    """Pass one: text, no text, or undecided."""
    if links > MAX_LINK_DENSITY:
        return None if inside and not (item and links > MENU_LINK_DENSITY and n < GOOD_WORDS) else False
    if n >= LONG_WORDS:
        return True
    if n < GOOD_WORDS:
        return None
    words = _WORD.findall(text.lower())
    return True if sum(w in STOP_WORDS for w in words) >= MIN_STOP_DENSITY * len(words) > 0 else None


def settle(labels: list[bool | None]) -> list[bool]:
    """Pass two: an undecided block is as its nearest decided neighbours; of two as near that differ, as the bad one; text without any."""
    n = len(labels)

    def nearest(order: range) -> list[int]:
        at, last = [-1] * n, -1
        for i in order:
            if labels[i] is not None:
                last = i
            at[i] = last
        return at

    out = []
    for i, a, b in zip(range(n), nearest(range(n)), nearest(range(n - 1, -1, -1)), strict=True):
        if a < 0 or b < 0:
            out.append(labels[max(a, b)] if max(a, b) >= 0 else True)
        elif i - a == b - i:
            out.append(bool(labels[a] and labels[b]))
        else:
            out.append(bool(labels[a] if i - a < b - i else labels[b]))
    return out


def main_text(page: str | Column) -> Column:
    """The article of each page; empty where there is none."""

    def texts(pages: pd.Series) -> pd.Series:
        return pd.Series([extract(x) for x in pages], dtype="object")

    return F.pandas_udf(texts, "string")(page)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html").select("page_id", "url", main_text("html").alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))
