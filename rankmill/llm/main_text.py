"""Main text of web pages by tree scoring.

A page becomes a tree of elements. What by its tag, role or name cannot be the article
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, reader comments)
leaves the tree first. Every paragraph then earns points for its length and its commas
and passes them to its ancestors, halved at the grandparent and thinned out further up;
an element's points are discounted by the share of its text that stands in links. The
element with the most points, or the article that encloses it, is the text, together
with siblings that earned a fair part of its points. Lists and boxes of links inside are
left out. Blocks come in page order, one a line.

Pages are scored one by one inside tasks, without a shuffle.

Defined results: null and empty pages, and pages without text outside the parts named
above, give an empty string; unclosed and wrongly nested tags are closed as browsers
close them; ``<br>`` counts as white space; ties in points go to the element that comes
first; long pages are read whole; repeated rows and further columns do not matter.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW = {t: re.compile(rf"</{t}\b[^>]*>?", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")}

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: Tags that end an open element of these tags, up to the nearest of the others.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
CLOSES_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"}
P_SCOPE = frozenset({"td", "th", "table", "button", "object", "body", "html", "caption"})

NEVER = frozenset(
    "head script style textarea title noscript iframe xmp template nav aside footer form button select option input "
    "dialog svg canvas audio video object embed applet map menu label fieldset".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Parts of class names and ids, as whole words, of what is not the article.
UNLIKELY = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox sponsor sponsored promo promotion "
    "promotions banner banners breadcrumb breadcrumbs comment comments commentlist disqus reply replies respond "
    "discussion cookie cookies consent gdpr notice notices notification notifications popup popups modal overlay lightbox "
    "newsletter subscribe subscription signup signin login register share sharing social related recommended "
    "recommendations recommend sidebar sidebars widget widgets menu menus nav navbar navigation footer footers header "
    "headers masthead topbar toolbar pager pagination skip sitemap tagcloud outbrain taboola paywall feedback survey "
    "dropdown hidden teaser teasers trending popular alert alerts disclaimer".split()
)
#: Words beside which they still mean the same: cookie-bar is unlikely, notice-period is not.
NEUTRAL = frozenset(
    "area bar block body bottom box btn button buttons card cards center col column columns container content count "
    "group heading holder icon icons id in inner item items js label layout left link links list main message module "
    "new off on outer overlay page panel post posts primary right row secondary section sections site slot small sticky "
    "strip tab tabs text title top unit up wrap wrapper zone story stories article articles entry user users form".split()
)
#: Those of them that also hold for an element that calls itself article or main.
UNLIKELY_ARTICLE = frozenset("ad ads advert advertisement sponsor sponsored promo comment comments reply replies related recommended teaser".split())
WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
LIKELY = frozenset("article body content entry main page post text blog story hentry articlebody".split())

PARAGRAPHS = frozenset("p pre td blockquote li dd dt figcaption h1 h2 h3 h4 h5 h6".split())
FAIR = 0.2
MOST_LINKS = 0.5
#: Ancestors that a paragraph passes points to; those further up would get under a hundredth.
REACH = 48


class Element:
    __slots__ = ("tag", "parent", "parts", "names", "role", "hidden", "points", "length", "linked", "commas", "within", "holds", "labels", "paragraphs")

    def __init__(self, tag: str, parent: Element | None, attrs: str = ""):
        self.tag, self.parent = tag, parent
        self.parts: list[Element | str] = []
        self.names: set[str] = set()
        self.labels: list[frozenset[str]] = []
        self.role, self.hidden = "", False
        self.points, self.length, self.linked, self.commas = 0.0, 0, 0, 0
        self.holds, self.paragraphs = False, False
        if attrs and not attrs.isspace():
            for name, *values in ATTRIBUTE.findall(attrs):
                name, value = name.lower(), html.unescape("".join(values))
                if name in ("class", "id"):
                    self.labels += [frozenset(w.lower() for w in WORDS.findall(v)) for v in value.split()]
                    self.names.update(*self.labels)
                elif name in ("role", "itemprop"):
                    self.role = self.role or value.lower()
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                    self.hidden = True
                elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                    self.hidden = True
        #: Whether this is an article or lies in one.
        self.within = self.is_article or (parent is not None and parent.within)

    @property
    def is_article(self) -> bool:
        return self.tag in ("article", "main") or self.role in ("main", "article", "articlebody")


class _Path:
    """The open elements, and for each tag how deep they stand, so that none is looked for by walking up."""

    def __init__(self, root: Element):
        self.nodes = [root]
        self.depths: dict[str, list[int]] = {root.tag: [0]}
        self.blocks = [0]

    @property
    def here(self) -> Element:
        return self.nodes[-1]

    def deepest(self, tags: Iterable[str]) -> int:
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=-1)

    def push(self, node: Element) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCKS:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def close(self, depth: int) -> None:
        """End the element at a depth, not the root, and all inside it."""
        while len(self.nodes) > max(depth, 1):
            tag = self.nodes.pop().tag
            self.depths[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()


def parsed(page: str) -> Element:
    """The tree of a page; text stands decoded between the elements."""
    root = Element("html", None)
    path = _Path(root)
    at = 0
    while match := TOKEN.match(page, at):
        at = match.end()
        if text := match["text"]:
            path.here.parts.append(html.unescape(text) if "&" in text else text)
            continue
        tag = (match["tag"] or match["tag2"] or "").lower()
        if not tag:
            continue
        if match["end"] or match["end2"]:
            depth = path.deepest((tag,))
            # An inline end tag does not reach beyond its block.
            if depth > 0 and (tag in BLOCKS or depth > path.blocks[-1]):
                path.close(depth)
            elif tag == "br":
                path.here.parts.append(" ")
            continue
        attrs = match["attrs"] or match["attrs2"] or ""
        if tag in ("html", "body"):
            if tag == "body":
                path.close(1)
                node = Element(tag, root, attrs)
                root.parts.append(node)
                path.push(node)
            continue
        if tag in CLOSES:
            ends, scope = CLOSES[tag]
            if (depth := path.deepest(ends)) > max(path.deepest(scope), 0):
                path.close(depth)
        if tag in CLOSES_P and (depth := path.deepest(("p",))) > max(path.deepest(P_SCOPE), 0):
            path.close(depth)
        if tag == "br":
            path.here.parts.append(" ")
            continue
        node = Element(tag, path.here, attrs)
        path.here.parts.append(node)
        if tag in RAW:
            end = RAW[tag].search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not (attrs.endswith("/") and tag in ("svg", "path")):
            path.push(node)
    return root


def _named(node: Element, words: frozenset[str]) -> bool:
    """Whether a class or id consists of such words and of words that only say what kind of box it is."""
    return any(not words.isdisjoint(name) and all(w in words or w in NEUTRAL for w in name) for name in node.labels)


def _unlikely(node: Element) -> bool:
    if node.tag in NEVER or node.role in ROLES or node.hidden:
        return True
    if node.tag in ("html", "body"):
        return False
    if node.is_article:
        return _named(node, UNLIKELY_ARTICLE)
    if node.tag == "header":
        return not node.within
    return _named(node, UNLIKELY)


def _ordered(root: Element) -> list[Element]:
    """All elements in page order, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [x for x in reversed(node.parts) if isinstance(x, Element)]
    return order


def _holds_article(node: Element) -> bool:
    """Whether a part that is unlikely by its name encloses the article all the same."""
    if not node.holds or node.tag in NEVER or node.role in ROLES or node.hidden:
        return False
    return not (node.names & {"comment", "comments", "commentlist", "replies", "disqus", "discussion", "related", "recommended"})


def _pruned(root: Element) -> list[Element]:
    """Take the unlikely parts out; the rest in page order, parents first."""
    every = _ordered(root)
    for node in reversed(every):
        if node.parent is not None and (node.holds or node.is_article and not _unlikely(node)):
            node.parent.holds = True
    for node in every:
        node.parts = [x for x in node.parts if isinstance(x, str) or not _unlikely(x) or _holds_article(x)]
    return _ordered(root)


def _measured(order: list[Element]) -> None:
    """Lengths of text and of linked text, commas, and points, all from the leaves up."""
    for node in reversed(order):
        own = [x for x in node.parts if isinstance(x, str)]
        inner = [x for x in node.parts if isinstance(x, Element)]
        node.length = sum(len(" ".join(x.split())) for x in own) + sum(x.length for x in inner)
        node.linked = node.length if node.tag == "a" else sum(x.linked for x in inner)
        node.commas = sum(x.count(",") for x in own) + sum(x.commas for x in inner)
        node.paragraphs = any(x.paragraphs or x.tag == "p" and x.length for x in inner)
    for node in order:
        own = [x for x in node.parts if isinstance(x, str)]
        loose = node.tag in ("div", "section", "article", "main", "body", "center") and any(not x.isspace() for x in own)
        if not node.length or not (node.tag in PARAGRAPHS or loose):
            continue
        if node.tag in ("td", "li", "blockquote", "dd") and any(isinstance(x, Element) and x.tag in BLOCKS for x in node.parts):
            continue
        commas, length = (sum(x.count(",") for x in own), sum(map(len, own))) if loose else (node.commas, node.length)
        earned = (1 + commas + length / 100) * (1 - node.linked / node.length)
        above, depth = (node if loose else node.parent), 0
        while above is not None and depth < REACH:
            above.points += earned / (1, 2)[depth] if depth < 2 else earned / (3 * depth)
            above, depth = above.parent, depth + 1


def _density(node: Element) -> float:
    return node.linked / node.length if node.length else 0.0


def _standing(node: Element) -> float:
    bonus = 25 * (node.is_article or not LIKELY.isdisjoint(node.names))
    return (node.points + bonus) * (1 - _density(node)) if node.points > 0 else 0.0


def _blocks(nodes: list[Element]) -> list[str]:
    """The text of the elements, a string for each block, in page order."""
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(held).split()):
            blocks.append(text)
        held.clear()

    stack: list[Element | str | None] = []
    for node in reversed(nodes):
        stack += [None, *reversed(node.parts), None]
    while stack:
        part = stack.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            held.append(part)
        elif part.tag in ("ul", "ol", "dl", "table", "div", "section") and not part.within and _density(part) > MOST_LINKS:
            flush()
        elif part.tag in BLOCKS:
            stack += [None, *reversed(part.parts), None]
        else:
            stack += reversed(part.parts)
    flush()
    return blocks


def main_text(page: str | None) -> str:
    """The article's blocks, joined by line ends; empty if there are none."""
    if not page:
        return ""
    order = _pruned(parsed(page))
    _measured(order)
    holders = [n for n in order if n.tag in BLOCKS and n.tag not in PARAGRAPHS and n.points > 0] or [n for n in order if n.points > 0]
    if not holders:
        return "\n".join(_blocks([order[0]]))
    best = max(holders, key=_standing)
    above = best.parent
    while above is not None and not best.is_article:
        if above.is_article and _density(above) <= MOST_LINKS:
            best = above
        above = above.parent
    chosen = [best]
    if best.parent is not None:
        least = FAIR * _standing(best)
        chosen = [
            x for x in best.parent.parts
            if x is best or isinstance(x, Element) and (x.tag in BLOCKS) and (_standing(x) >= least and x.points > 0 or _stray(x))
            and _density(x) <= MOST_LINKS
        ]
    return "\n".join(_blocks(chosen))


def _stray(node: Element) -> bool:
    """A paragraph, or a box with paragraphs, beside the container; short ones too, if they hardly link."""
    return node.length > 0 and _density(node) < 0.25 and (node.tag == "p" or node.paragraphs)


def extracted(pages: DataFrame, html_column: str = "html", text: str = "text") -> DataFrame:
    """The rows with their own columns and the main text as ``text``."""

    @F.pandas_udf("string")
    def extract(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in column], dtype=object)

    return pages.withColumn(text, extract(F.col(html_column)))
