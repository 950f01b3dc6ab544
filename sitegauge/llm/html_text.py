"""Main text of web pages by block rules in two passes.

The page is cut into blocks at block-level tags. The first pass labels each by its length, link density
and stop-word density as good, bad, near-good or short. Structure is one of its inputs: what stands in
menus, headers, footers, sidebars, forms, scripts or styles, or in an element whose class, id or role
names an advert, notice, comment list or the like, is bad; weaker names (``legal``, ``tags``, ..) only
make blocks bad that density does not find good. In the second pass near-good and short blocks take the
label of the nearest decided blocks around them, headings that of what follows.

An ``article`` or ``main`` element is a prior: its blocks ask only each other, without the adverts and
forms among them, and count as good where none is decided. Where the elements' main text is at least as
long as what the same rules find in the rest of the page, the rest goes; else the marks are ignored.

Cases: null html gives the empty text; unclosed and misplaced tags are repaired (a block tag closes
an open paragraph, the end of the page closes all); a page without block tags is one block; every
row gives a row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the languages at hand.
STOP_WORDS = frozenset(
    """a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the
    their they this to was were which will with you
    au aux avec ce ces dans de des du elle en est et il ils la le les leur mais ne nous ou par pas pour qui que sa se
    ses son sur un une vous
    als auch auf aus bei das dem den der des die ein eine einem einen einer er es für hat ich im in ist mit nach nicht
    oder sich sie sind so und von war wie wir zu zum zur
    al como con del el ella en entre es esta este ha la las lo los más mi muy no o para pero por que se sin su sus un
    una y ya""".split()
)
_SCAN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<([!?/]?)([A-Za-z][A-Za-z0-9:-]*)?((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<", re.S)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "object")}
_DROP = frozenset("nav header footer aside form button menu dialog head fieldset datalist".split())
_BLOCK = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section
    summary table tbody td tfoot th thead tr ul""".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ATTR = re.compile(r"\b(class|id|role|aria-label|hidden|style)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent\w*|gdpr|notice\w*|popup|modal|overlay|newsletter|subscribe|"
    r"sidebar\w*|widget\w*|menu\w*|nav\w*|breadcrumb\w*|footer\w*|masthead|topbar|comments?|comment\w*|disqus|respond|replies|reply|"
    r"share|sharing|social\w*|pagination|pager|toolbar|login|signup)(?:$|[\s_-])",
    re.I,
)
_WEAK_NAME = re.compile(r"(?:^|[\s_-])(?:side|toc|header|related|recommended|tags?|search|skip|legal|copyright|disclaimer)(?:$|[\s_-])", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"\w+")
_PLAIN_TAG = re.compile(r"\A\s*/?\s*\Z")


class Block(NamedTuple):
    text: str
    links: float  # share of its characters in links
    bad: int  # 2 in a part that its tag, name or style tells to be boilerplate, 1 in one of a weaker name
    article: bool
    tag: str


def blocks(html: str) -> list[Block]:
    """The blocks of a page in their order."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # tag, starts a bad part (2, 1 or 0), starts an article
    bad = weak = art = links = 0
    text: list[str] = []
    linked = 0
    tag_of = ""

    def close_block() -> None:
        nonlocal text, linked
        joined = _SPACE.sub(" ", unescape("".join(text))).strip()
        if joined:
            out.append(Block(joined, min(1.0, linked / max(1, len(joined))), 2 if bad else 1 if weak else 0, art > 0, tag_of))
        text, linked = [], 0

    def pop() -> str:
        nonlocal bad, weak, art, links
        name, b, a = stack.pop()
        bad -= b == 2
        weak -= b == 1
        art -= a
        links -= name == "a"
        return name

    at, end = 0, len(html)
    while at < end:
        m = _SCAN.search(html, at)
        piece = html[at : m.start()] if m else html[at:]
        if piece:
            text.append(piece)
            if links:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        kind, name = m.group(1), (m.group(2) or "").lower()
        if not name or kind in ("!", "?"):
            if kind is None and m.group(0) == "<" or (kind == "" and not name):
                text.append("&lt;" + m.group(0)[1:])
            continue
        if name == "br":
            text.append(" ")
            continue
        if kind == "/":
            if any(s[0] == name for s in stack):
                if name in _BLOCK:
                    close_block()
                while pop() != name:
                    pass
            elif name in _BLOCK:
                close_block()
            continue
        attrs = m.group(3)
        if name in _RAW and not attrs.rstrip().endswith("/"):
            stop = _RAW[name].search(html, at)
            at = stop.end() if stop else end
            continue
        if name in _BLOCK:
            close_block()
            tag_of = name
            while stack and (stack[-1][0] == "p" or stack[-1][0] == name and name in ("li", "dd", "dt", "tr", "td", "th", "option")):
                pop()
        if name in _VOID or attrs.rstrip().endswith("/"):
            continue
        is_bad, is_weak = name in _DROP and not (name == "header" and art), False
        if not _PLAIN_TAG.match(attrs):
            found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
            names = " ".join(found.get(k, "") for k in ("class", "id", "role"))
            if names.strip() and name not in ("html", "body", "article", "main"):
                is_bad |= bool(_BAD_NAME.search(names))
                is_weak = bool(_WEAK_NAME.search(names))
            is_bad |= bool(_HIDDEN.search(found.get("style", ""))) or found.get("role", "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "alert")
        is_art = name in ("article", "main")
        level = 2 if is_bad else 1 if is_weak else 0
        stack.append((name, level, is_art))
        bad += level == 2
        weak += level == 1
        art += is_art
        links += name == "a"
    close_block()
    return out


def first_pass(b: Block, marked: bool, short: int = 70, long: int = 200, link_share: float = 0.5) -> str:
    """good, bad, near or short by structure, length, links and stop words; ``marked`` blocks stand in an article."""
    if b.bad == 2 or b.links > link_share:
        return "bad"
    if len(b.text) < short:
        return "bad" if b.bad else "short" if marked or b.links == 0 or b.tag[:1] == "h" else "bad"
    words = _WORDS.findall(b.text.lower())
    stop = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stop >= 0.3 and len(b.text) > long:
        return "good"
    if b.bad:
        return "bad"
    if stop >= 0.15 or marked:
        return "near"
    return "bad" if b.links > 0.2 else "near" if len(b.text) > long else "short"


def second_pass(found: list[Block], first: list[str], marked: bool) -> list[tuple[bool, str]]:
    """Whether each block is main text, and what settled it: structure, density or neighbours."""
    n, far = len(found), 1 << 30
    votes = [label in ("good", "bad") and not (marked and b.bad == 2) for b, label in zip(found, first)]
    ahead: list[tuple[int, str]] = [(far, "")] * n
    behind: list[tuple[int, str]] = [(far, "")] * n
    for order, out in ((range(n), behind), (range(n - 1, -1, -1), ahead)):
        last, label = None, ""
        for i in order:
            out[i] = (abs(i - last), label) if last is not None else (far, "")
            if votes[i]:
                last, label = i, first[i]
    none_good = "good" not in first
    out_ = []
    for i, (b, label) in enumerate(zip(found, first)):
        if label in ("good", "bad"):
            out_.append((label == "good", "structure" if b.bad == 2 else "density"))
            continue
        near = {x for _, x in (ahead[i], behind[i]) if x}
        if marked and none_good:  # nothing in the article is longer than these
            good = True
        elif label == "near":
            good = none_good or "good" in near
        elif b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            good = (ahead[i][1] or (behind[i][1] if marked else "bad")) == "good"
        elif marked:
            good = "good" in {x for k, x in (ahead[i], behind[i]) if k == min(ahead[i][0], behind[i][0])}
        else:
            good = near == {"good"}
        out_.append((good, "neighbours"))
    return out_


def labels(found: list[Block]) -> list[tuple[bool, str]]:
    """Whether each block is main text, and what settled it."""
    size = lambda blocks_, made: sum(len(b.text) for b, (good, _) in zip(blocks_, made) if good)
    inside = [b for b in found if b.article]
    rest = [b for b in found if not b.article]
    within = second_pass(inside, [first_pass(b, True) for b in inside], True)
    beyond = second_pass(rest, [first_pass(b, False) for b in rest], False)
    if inside and size(inside, within) >= size(rest, beyond):
        settled = iter(within)
        return [next(settled) if b.article else (False, "structure") for b in found]
    first = [first_pass(b, False) for b in found]
    made = second_pass(found, first, False)
    if not any(good for good, _ in made):  # nothing but short blocks: the page is what is not boilerplate
        made = [(label == "short", "neighbours") for label in first]
    return made


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    return "\n\n".join(b[0] for b, good in zip(found, labels(found)) if good[0])


def extract_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of each row of ``pages(page_id, url, html)``."""

    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for html in batches:
            yield pa.array([main_text(h.as_py()) for h in html], pa.string())

    out = pages.select("page_id", "url", extract("html").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))
