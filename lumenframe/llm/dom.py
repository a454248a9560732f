"""A small, tolerant HTML reader: block elements, text segments and their features."""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

#: A comment, a declaration, or a tag. Quotes count after ``=`` only, as in browsers.
TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>", re.S
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")

#: Elements whose content isn't markup: it ends at the first closing tag of their own name.
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
#: Elements of markup that is never text of the page; they may stand within their like.
HIDDEN = frozenset("template svg math select object canvas video audio datalist".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
#: What an opening tag closes: a paragraph by any block, an item by the next one.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

GOOD = frozenset("article articlebody body content entry main post page story text hentry blog detail".split())
BAD = frozenset(
    "ad ads advert advertisement adbox banner breadcrumb breadcrumbs comment comments comentario consent cookie cookies disqus "
    "footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pagination popup "
    "promo promoted related recommended replies reply respond search share sharing shoutbox sidebar side signup social sponsor "
    "sponsored subscribe tags teaser toolbar widget".split()
)
TAGS = "body div section article main p h1 h2 h3 h4 ul ol li table tr td nav header footer aside form figure figcaption blockquote pre dl dd #text".split()
TAG_NUMBER = {t: k for k, t in enumerate(TAGS)}


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    attrs: str = ""
    text: str = ""
    links: int = 0  # characters of text inside links
    children: list[int] = field(default_factory=list)


class Closers:
    """Where the closing tags of a name stand in a page; each name is searched for once."""

    def __init__(self, page: str):
        self.page, self.found = page, {}

    def after(self, tag: str, at: int) -> re.Match | None:
        if tag not in self.found:
            self.found[tag] = list(re.finditer(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", self.page, re.I))
        k = bisect.bisect_left(self.found[tag], at, key=re.Match.start)
        return self.found[tag][k] if k < len(self.found[tag]) else None


def parse(page: str) -> list[Node]:
    """Block elements in page order under a root; text segments are ``#text`` nodes.

    The content of a raw element is skipped unread up to its own closing tag; an
    unclosed script or style takes the rest of the page, as in browsers, and any
    other unclosed silent element only loses its tag. ``head`` is no element here:
    what may stand in it is silent anyway, so its end tag may be left out.
    """
    nodes = [Node("body", -1, 0)]
    stack = [0]
    open_tags: Counter[str] = Counter()
    pieces: list[str] = []
    in_link, link_chars, at, pos = 0, 0, 0, 0
    # Beyond the last > there are no tags; an unclosed comment takes the rest.
    limit = page.rfind(">") + 1
    comment = page.find("<!--", limit)
    page = page if comment < 0 else page[:comment]
    closers = Closers(page)

    def flush() -> None:
        nonlocal link_chars
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                add("#text", "", text, min(link_chars, len(text)))
        link_chars = 0

    def add(tag: str, attrs: str, text: str = "", links: int = 0) -> int:
        own, k = stack[-1], len(nodes)
        nodes.append(Node(tag, own, nodes[own].depth + 1, attrs, text, links))
        nodes[own].children.append(k)
        return k

    def close(k: int) -> None:
        """Closes the stack's element k and what is open within."""
        for x in stack[k:]:
            open_tags[nodes[x].tag] -= 1
        del stack[k:]

    def after_hidden(tag: str, at: int) -> int | None:
        """Where a hidden element that was opened just before ``at`` has ended."""
        if closers.after(tag, at) is None:
            return None
        depth = 1
        while m := TOKEN.search(page, at, limit):
            at, name = m.end(), (m[2] or "").lower()
            if name in RAW and not m[1]:
                end = closers.after(name, at)
                at = end.end() if end else at
            elif name == tag and not m[3].endswith("/"):
                depth += -1 if m[1] else 1
                if not depth:
                    return at
        return closers.found[tag][-1].end()  # more were opened than closed

    while m := TOKEN.search(page, pos, limit):
        if m.start() > at:
            piece = page[at : m.start()]
            pieces.append(piece)
            if in_link:
                link_chars += len(piece)
        at = pos = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), m[1]
        if tag in RAW:
            if not closing:
                end = closers.after(tag, at)
                if end:
                    at = pos = end.end()
                elif tag in ("script", "style") and not m[3].endswith("/"):
                    at = pos = len(page)
            continue
        if tag in HIDDEN:
            if not closing and not m[3].endswith("/"):
                at = pos = after_hidden(tag, at) or at
            continue
        if tag in VOID:
            if tag in ("br", "hr", "img", "input"):
                pieces.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            continue
        if tag in ("head", "html", "body"):
            flush()
            if tag == "body" and not closing and m[3]:
                nodes[0].attrs = m[3]
            continue
        flush()
        in_link = 0 if tag != "p" or not closing else in_link
        if closing:
            if open_tags[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if nodes[stack[k]].tag == tag))
            continue
        if nodes[stack[-1]].tag == "p":
            close(len(stack) - 1)
        ends, fence = CLOSES.get(tag, ()), FENCES.get(tag, ())
        if any(open_tags[x] for x in ends):
            for k in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[k]].tag
                if open_tag in ends:
                    close(k)
                    if tag != "tr":
                        break
                elif open_tag in fence:
                    break
        k = add(tag, m[3])
        if not m[3].endswith("/"):
            stack.append(k)
            open_tags[tag] += 1
    if at < len(page):
        pieces.append(page[at:])
    flush()
    return nodes


def attribute_counts(attrs: str) -> tuple[int, int]:
    """Good and bad tokens among class, id and role."""
    good = bad = 0
    if "=" in attrs:
        for m in ATTRIBUTE.finditer(attrs):
            for w in WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "").lower()):
                good += w in GOOD
                bad += w in BAD
    return good, bad


FEATURES = (
    "tag parent_tag depth good bad good_above bad_above chars words share_of_page link_share commas_per_word stops_per_word "
    "chars_per_node nodes children place siblings same_tag_siblings paragraph_share mean_segment bad_tag_above before_share"
).split()
BAD_TAGS = frozenset("nav header footer aside form".split())


def features(nodes: list[Node]) -> np.ndarray:
    """A row per node."""
    n = len(nodes)
    total = np.zeros((n, 7))  # chars, words, link chars, commas, stops, nodes, paragraph chars
    segments = np.zeros(n)
    for k in range(n - 1, -1, -1):
        x = nodes[k]
        if x.text:
            t = x.text
            in_p = len(t) if nodes[x.parent].tag in ("p", "blockquote", "pre") else 0
            total[k] += (len(t), t.count(" ") + 1, x.links, t.count(","), t.count(".") + t.count("!") + t.count("?"), 0, in_p)
            segments[k] += 1
        total[k, 5] += 1
        if x.parent >= 0:
            total[x.parent] += total[k]
            segments[x.parent] += segments[k]
    out = np.zeros((n, len(FEATURES)))
    page_chars = max(1.0, total[0, 0])
    good_above, bad_above, tags_above = np.zeros(n), np.zeros(n), np.zeros(n)
    seen = 0.0
    for k, x in enumerate(nodes):
        good, bad = attribute_counts(x.attrs)
        place = siblings = same = 0
        parent_tag = -1
        if x.parent >= 0:
            up = nodes[x.parent]
            parent_tag = TAG_NUMBER.get(up.tag, len(TAGS))
            good_above[k], bad_above[k], tags_above[k] = good_above[x.parent], bad_above[x.parent], tags_above[x.parent]
            siblings = len(up.children)
        chars, words, links, commas, stops, count, in_p = total[k]
        out[k] = (
            TAG_NUMBER.get(x.tag, len(TAGS)), parent_tag, x.depth, good, bad, good_above[k], bad_above[k], np.log1p(chars), np.log1p(words),
            chars / page_chars, links / max(1, chars), commas / max(1, words), stops / max(1, words), chars / count, np.log1p(count), len(x.children),
            place, siblings, same, in_p / max(1, chars), chars / max(1, segments[k]), tags_above[k], seen / page_chars,
        )
        good_above[k] += good
        bad_above[k] += bad
        tags_above[k] += x.tag in BAD_TAGS
        seen += len(x.text)
    for x in nodes:
        counts: dict[str, int] = {}
        for c in x.children:
            counts[nodes[c].tag] = counts.get(nodes[c].tag, 0) + 1
        for place, c in enumerate(x.children):
            out[c, 16] = place / max(1, len(x.children) - 1)
            out[c, 18] = counts[nodes[c].tag]
    return out
