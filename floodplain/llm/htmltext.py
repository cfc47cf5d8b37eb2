"""Main text of web pages: two-pass block rules over blocks with structural priors.

A page becomes blocks of text between block tags. Blocks inside elements that
are never part of an article (menus, page headers, footers, sidebars, notices,
adverts, forms, reader comments, hidden parts; by tag, role, class or id) are
left out, as are scripts, styles and comments in the markup. Inside an article
or main element a header stays (it holds the headline), and class names that
needn't mean anything there (legal, share, banner and the like) are only a mark.

First pass: every block that is left gets points. Structure is the prior: three for
the element that holds the article, three less outside it, none on pages without one;
a mark costs three. Evidence is the block's own: hardly more than links costs three (a list entry six), many
links three (one where structure speaks for the block), a long block with many stop words gains two, one with few loses
two, a short one with links loses two where there is no prior. Two points or more are good, less than none is bad,
a short marked block is bad, and the rest is undecided. Second pass: each undecided block takes the label of
its nearest decided neighbour (the one before it on a tie between two of one
label; good if labels differ at the same distance); with none decided on the
whole page, undecided blocks with a sentence's length or a heading are good.

Character references are decoded, white space inside a block (line breaks
too) becomes one space, and blocks are joined by one newline.

Defined cases: a null or empty page has the empty text; markup that ends
early is read as far as it goes; stray `<` is text; any length and depth is read whole, in time that grows with the length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import pieces

# Elements and words that mark what isn't the article.
RAW = "script style noscript template svg iframe object canvas audio video head title textarea select"
LEFT_OUT = set("nav footer aside form button menu dialog fieldset datalist option".split())
#: Left out but inside an article or main element.
PAGE_LEVEL = set("header label".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
MARKS = set(
    "nav navbar navigation menu submenu megamenu topbar header masthead footer sidebar aside rail ad ads advert adverts advertisement advertising adsense adslot "
    "adsbygoogle adbox banner sponsor sponsored sponsors promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog comment comments "
    "commentlist disqus respond reply replies share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager newsletter subscribe "
    "subscription signup login search searchform form toolbar widget widgets copyright legal disclaimer skip paywall outbrain taboola".split()
)
#: Of these, inside an article or main element, only a mark; the rest is left out there too.
SOFT = set("header masthead banner share sharing social legal disclaimer copyright overlay widget widgets rail skip alert respond topbar search dialog pager form".split())
#: What an article or main element itself isn't left out for.
TEASERS = set("ad ads advert advertisement comment comments commentlist reply replies related recommended promo sponsored teaser".split())
CONTENT = set("content maincontent articlebody articletext post postbody entry story storybody bodytext".split())
BLOCKS = set(
    "address article blockquote body caption center col colgroup dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li "
    "main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul aside dialog search".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "col", "colgroup", "option", "optgroup"}
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
STOP = set(
    "a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its just like may me more my no "
    "not of on one only or other our out over she so some than that the their them then there these they this to up was we were what when where which who will with would you your "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die du durch ein eine einem einen einer er es für hat ich ihr im in ist mit nach nicht noch nur oder sich sie "
    "sind so über um und uns von vor war was wenn wie wir zu zum zur "
    "au aux avec ce ces dans de des du elle en est et être eux il ils je la le les leur lui ma mais me même mes mon ne nos nous on ou où par pas pour qu que qui sa se ses son sont sur "
    "ta te tu un une vous "
    "al como con cuando de del desde el ella ellos en entre era es esta este ha hay la las le lo los más me mi muy no nos o para pero por porque que se ser si sin sobre son su sus también "
    "te tiene todo un una y ya".split()
)

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<({'|'.join(RAW.split())})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^<>]*)(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"\w+")

SHORT, LONG, LINKED = 70, 140, 0.33
FEW_STOPS, MANY_STOPS = 0.12, 0.20


#: How sure an element is that it holds the article.
CLASSED, MAIN, ARTICLE = 1, 2, 3


def _opened(tag: str, attrs: str, inside: bool) -> tuple[bool, int, bool]:
    """(left out, how surely the article's own, marked) for an element that opens; `inside` an article or main element."""
    main = {"article": ARTICLE, "main": MAIN}.get(tag, 0)
    out, soft = tag in LEFT_OUT or tag in PAGE_LEVEL and not inside, False
    if attrs and attrs.strip(" /"):
        for name, a, b, c in _ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                words = set(re.split(r"[^a-z]+", _CAMEL.sub(" ", value).lower()))
                if tag not in ("html", "body"):
                    bad = words & (TEASERS if main else MARKS | TEASERS)
                    soft |= inside and bool(bad & SOFT)
                    out |= bool(bad - SOFT if inside else bad)
                    if words & CONTENT or re.sub(r"[^a-z]", "", value.lower()) in CONTENT:
                        main = max(main, CLASSED)
            elif name == "role":
                out |= value.lower() in ROLES
                main = max(main, {"main": MAIN, "article": ARTICLE}.get(value.lower(), 0))
            elif name == "itemprop" and value == "articleBody":
                main = ARTICLE
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
                out |= tag not in ("html", "body")
    return out, main, soft


@dataclass(frozen=True)
class Block:
    text: str
    linked: int  # characters inside links
    kind: str  # innermost block tag
    main: int  # how surely the article's own
    soft: bool  # marked by a class name


@dataclass(frozen=True)
class _Open:
    """An open element with what holds inside it; `fence` is where the search for an open paragraph ends."""

    tag: str
    out: bool = False
    main: int = 0
    soft: bool = False
    kind: str = "body"
    links: int = 0
    fence: int = -1


def blocks(page: str) -> list[Block]:
    """The blocks that aren't left out, in page order. What holds inside an element is kept with it, and open elements are known by tag, so nothing is searched again."""
    found: list[Block] = []
    stack: list[_Open] = []
    places: dict[str, list[int]] = {}
    parts: list[str] = []
    linked = 0
    now = top = _Open("")

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(text, linked, now.kind, now.main, now.soft))
            parts.clear()
        linked = 0

    def last(tag: str) -> int:
        held = places.get(tag)
        return held[-1] if held else -1

    def close(to: int) -> None:
        """Closes all elements from place `to` on."""
        nonlocal now
        if any(x.out or x.tag in BLOCKS for x in stack[to:]):
            flush()
        for x in stack[to:]:
            places[x.tag].pop()
        del stack[to:]
        now = stack[-1] if stack else top

    for m in _TOKEN.finditer(page):
        raw = m[0]
        if raw[0] != "<" or raw == "<":
            if not now.out:
                text = html.unescape(raw)
                parts.append(text)
                if now.links:
                    linked += len(text.strip())
            continue
        tag = m[3] or m[6]
        if not tag:
            continue
        tag, closing, attrs = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        if tag == "br":
            if not now.out:
                parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if closing:
            if last(tag) >= 0:
                close(last(tag))
            continue
        if tag in SAME_CLOSES:
            ends = max(last(x) for x in SAME_CLOSES[tag])
            if ends > max(last(x) for x in FENCES[tag]):
                close(ends)
        elif tag in CLOSES_P and last("p") > now.fence:
            close(last("p"))
        if tag in VOID or attrs.endswith("/") and tag not in BLOCKS:
            continue
        left, main, soft = _opened(tag, attrs, now.main >= MAIN)
        if left and not now.out or soft:
            flush()
        places.setdefault(tag, []).append(len(stack))
        block = tag in BLOCKS
        now = _Open(tag, now.out or left, max(now.main, main), now.soft or soft, tag if block else now.kind, now.links + (tag == "a"), len(stack) if block and tag != "p" else now.fence)
        stack.append(now)
    flush()
    return found


def priors(found: list[Block]) -> list[int]:
    """Each block's points by structure: by the surest element that holds at least half of the text of the next less sure ones.

    An article in a main element is the region only if it isn't a mere teaser there, and a class name counts
    only if most of the page's text stands under it.
    """
    size = lambda level: sum(len(b.text) for b in found if b.main >= level)
    if size(MAIN):
        level = ARTICLE if 2 * size(ARTICLE) >= size(MAIN) else MAIN
    else:
        level = CLASSED if size(CLASSED) and 2 * size(CLASSED) >= size(0) else 0
    return [0 if not level else 3 if b.main >= level else -3 for b in found]


def first_pass(block: Block, prior: int) -> bool | None:
    """True: good, False: bad, None: undecided."""
    text, density = block.text, block.linked / len(block.text)
    points = prior - 3 * block.soft
    if density > 0.9:
        points -= 6 if block.kind == "li" else 3
    elif density > LINKED:
        points -= 1 if prior > 0 else 3
    if len(text) < SHORT:
        if block.soft:
            return False
        points -= 2 * (not prior and block.linked > 0)
    elif len(text) >= LONG:
        words = [w.lower() for w in _WORD.findall(text)]
        stops = sum(w in STOP for w in words) / max(1, len(words))
        points += 2 * (stops >= MANY_STOPS) - 2 * (stops < FEW_STOPS and block.kind != "p")
    return True if points >= 2 else False if points < 0 else None


def second_pass(labels: list[bool | None], found: list[Block]) -> list[bool]:
    """Undecided blocks take the label of their nearest decided neighbour."""
    n = len(labels)
    if all(x is None for x in labels):
        return [len(b.text) >= SHORT or b.kind in ("p", "h1", "h2", "h3", "blockquote", "pre") for b in found]
    before: list[tuple[int, bool]] = []
    near = (n + 1, False)
    for x in labels:
        near = (0, x) if x is not None else (near[0] + 1, near[1])
        before.append(near)
    out, near = [False] * n, (n + 1, False)
    for i in range(n - 1, -1, -1):
        x = labels[i]
        near = (0, x) if x is not None else (near[0] + 1, near[1])
        left = before[i]
        out[i] = left[1] or near[1] if left[0] == near[0] else (left if left[0] < near[0] else near)[1]
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    labels = second_pass([first_pass(*x) for x in zip(found, priors(found), strict=True)], found)
    return "\n".join(b.text for b, good in zip(found, labels, strict=True) if good)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of `pages` (page_id, url, html; more columns are ignored)."""
    source = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    schema = source.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, schema)
