"""Main text of web pages by composite text density.

A page becomes a small tree without the elements that never hold article text (menus, headers and footers of the
page, sidebars, notices, adverts, forms, scripts, styles, reader comments; known by element, role, or class and id).
Each remaining node gets its characters per tag, adjusted for the share of link characters and link tags in it and
in the whole body. The subtree whose children's densities sum highest is the article; further parts of the page
count as content if they are at least as dense as the thinnest node between that subtree and the body, and so do the
headings before the article and the paragraphs, lists and the like beside it. Marks (article, main) are evidence: what is
marked, or holds a mark, counts ``MARKED`` times as dense, and a marked element that is chosen stays whole. Of several marked
elements those with a class or role of noise (a reader comment as an article) do not count as marked.

Pages are independent: one pass over the table in Arrow batches, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What opens with "<" and is no element; an element's name; its attributes with closed quotes up to its end.
OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?", re.S)
TAG = re.compile(r"<(/?)([A-Za-z][^\s/<>]*)")
QUOTED = re.compile(r"((?:[^<>\"']+|\"[^\"]*\"|'[^']*')*+)>")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PARTS = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes noembed iframe".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table
caption tbody tfoot thead tr ul""".split())
#: A start tag of the set ends an open element of the key (and what is still open in it).
IMPLIED_END = {
    "p": BLOCK - {"option", "optgroup", "caption", "tbody", "tfoot", "thead", "tr", "body", "html", "legend"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"}, "head": {"head", "body"},
}
#: Implied ends do not reach through these.
SCOPE = frozenset("table ul ol dl article section main div body html blockquote".split())

NOISE_TAGS = frozenset("""head script style noscript template iframe object embed svg canvas audio video nav menu footer aside
form button select textarea input dialog title""".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NOISE_PARTS = frozenset("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner
cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup sidebar sidebars widget
widgets menu menus nav navbar navigation navigations breadcrumb breadcrumbs footer masthead toolbar share sharing social related
recommended recommendations comment comments commentlist disqus reply replies respond pagination pager login""".split())
CORE = frozenset(("article", "main"))
#: What a mark (article, main) is worth: so many times the density.
MARKED = 4.0
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())
FLOW = HEADINGS | frozenset("p ul ol dl table pre blockquote figure address details".split())
CONTAINERS = frozenset("html body div section article main center".split())


class Node:
    __slots__ = ("tag", "parent", "content", "noise", "core", "in_core", "has_core", "chars", "tags", "link_chars",
                 "link_tags", "density", "density_sum")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.content: list[Node | str] = []
        self.noise = ""  # "always", "class": unless it holds the article
        self.core = tag in CORE
        self.in_core = self.core or (parent is not None and parent.in_core)
        self.has_core = False
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.density_sum = 0.0


def _mark(node: Node, attrs: str) -> None:
    if node.tag in NOISE_TAGS:
        node.noise = "always"
        return
    if node.tag == "header" and not node.in_core:
        node.noise = "class"
    if not attrs or node.tag in ("body", "html"):
        return
    for name, *values in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (
                name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            node.noise = "always"
        elif name == "role":
            node.core = node.core or value == "main"
            if value in NOISE_ROLES:
                node.noise = "class"
        elif name == "itemprop" and value == "articlebody":
            node.core = True
        elif name in ("class", "id") and not NOISE_PARTS.isdisjoint(PARTS.findall(value)):
            node.noise = "class"
    node.in_core = node.in_core or node.core


class _Open:
    """The elements that are open, with the places of those that end tags and implied ends look for.

    No step walks over the open elements one by one, so pages that never close their tags are read in linear time.
    """

    def __init__(self, root: Node):
        self.stack = [root]
        self.by_tag: dict[str, list[int]] = {}
        self.marks: list[int] = []

    def push(self, node: Node) -> None:
        if node.tag in SCOPE or node.tag in IMPLIED_END:
            self.marks.append(len(self.stack))
        self.by_tag.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, depth: int) -> None:
        for node in self.stack[depth:]:
            self.by_tag[node.tag].pop()
        del self.stack[depth:]
        while self.marks and self.marks[-1] >= depth:
            self.marks.pop()

    def end(self, name: str) -> None:
        """An end tag: closes the innermost element of the name, but not through a scope unless it ends one."""
        places = self.by_tag.get(name)
        if places and (name in SCOPE or not any(self.stack[mark].tag in SCOPE for mark in self._above(places[-1]))):
            self.cut(places[-1])

    def _above(self, depth: int) -> Iterator[int]:
        for mark in reversed(self.marks):
            if mark <= depth:
                return
            yield mark
            if self.stack[mark].tag in SCOPE:
                return

    def imply(self, name: str) -> None:
        """Ends the outermost element inside the innermost scope that a start tag of the name ends.

        A scope holds one open element of each kind at most, as each is ended by the next of its kind.
        """
        found = None
        for mark in reversed(self.marks):
            tag = self.stack[mark].tag
            if name in IMPLIED_END.get(tag, ()):
                found = mark
            if tag in SCOPE:
                break
        if found is not None:
            self.cut(found)


def parse(html: str) -> list[Node]:
    """The nodes of a page, parents before children; tolerant of missing and stray tags.

    An attribute whose quote is never closed ends with its tag, at the next ">".
    """
    root = Node("html", None)
    nodes, open_ = [root], _Open(root)
    stack = open_.stack
    at, size, end_at = 0, len(html), 0
    while at < size:
        start = html.find("<", at)
        if start < 0:
            start = size
        if start > at:
            stack[-1].content.append(html[at:start])
            at = start
            continue
        tag = TAG.match(html, at)
        if tag is None:
            other = OTHER.match(html, at)
            if other is None:
                stack[-1].content.append("<")
                at += 1
            else:
                if other[0].startswith("<![CDATA["):
                    stack[-1].content.append(other[0][9:].removesuffix("]]>"))
                at = other.end()
            continue
        quoted = QUOTED.match(html, tag.end())
        if quoted is not None:
            attrs, at = quoted[1], quoted.end()
        else:
            # Looked for once, however many tags come before it.
            if 0 <= end_at < tag.end():
                end_at = html.find(">", tag.end())
            if end_at < 0:
                stack[-1].content.append("<")
                at += 1
                continue
            attrs, at = html[tag.end():end_at], end_at + 1
        name = tag[2].lower()
        if tag[1]:
            open_.end(name)
            continue
        if name == "html":
            continue
        open_.imply(name)
        node = Node(name, stack[-1])
        _mark(node, attrs)
        nodes.append(node)
        stack[-1].content.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = end.end() if end else size
        elif name not in VOID:
            open_.push(node)
    return nodes


def _measure(nodes: list[Node]) -> list[Node]:
    """Drop noise and compute densities; returns the nodes that are left, parents first."""
    if any(node.core and not node.noise for node in nodes):
        for node in nodes:
            node.core = node.core and not node.noise
            node.in_core = node.core or (node.parent is not None and node.parent.in_core)
    for node in reversed(nodes):
        node.has_core = node.has_core or node.core
        if node.parent is not None:
            node.parent.has_core |= node.has_core
    gone = set()
    left = []
    for node in nodes:
        if node.parent in gone or node.noise == "always" or (node.noise == "class" and not node.has_core):
            gone.add(node)
        else:
            left.append(node)
    for node in left:
        node.content = [part for part in node.content if isinstance(part, str) or part not in gone]
    for node in reversed(left):
        own = sum(len("".join(part.split())) for part in node.content if isinstance(part, str))
        node.chars += own
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    body = left[0]
    share = body.link_chars / max(body.chars, 1)
    for node in reversed(left):
        if node.chars:
            plain = max(node.chars - node.link_chars, 1)
            base = log(log(node.chars / plain * node.link_chars + share * node.chars + e))
            links = node.chars * max(node.tags, 1) / (max(node.link_chars, 1) * max(node.link_tags, 1))
            node.density = node.chars / max(node.tags, 1) * max(log(links), 0.0) / max(base, 0.1)
            if node.in_core or node.has_core:
                node.density *= MARKED
        if node.parent is not None:
            node.parent.density_sum += node.density
    return left


def _linked(node: Node, share: float) -> bool:
    return node.link_chars > share * node.chars


def _flow_around(best: Node, share: float) -> set[Node]:
    """What belongs to the densest subtree without being as dense: blocks of its flow, and headings before it.

    The flow are the paragraphs, headings, lists and the like that are children of one container with the subtree. Of a
    container directly in the body, and further up, only headings before it count. Blocks with more links than the body
    has are left out.
    """
    found, node = set(), best
    while node.parent is not None and node.tag not in CONTAINERS and node.parent.tag not in CONTAINERS:
        node = node.parent
    if not _linked(node, share):
        found.add(node)
    whole = node.tag not in CONTAINERS or (node.parent is not None and node.parent.parent is not None and node.parent.tag != "body")
    while node.parent is not None:
        before = True
        for part in node.parent.content:
            before = before and part is not node
            if isinstance(part, Node) and part.chars and not _linked(part, share) and (
                    part.tag in FLOW if whole else before and part.tag in HEADINGS):
                found.add(part)
        whole, node = False, node.parent
    return found


def _chosen(left: list[Node]) -> set[Node]:
    """Roots of the content subtrees."""
    body = left[0]
    cores = any(node.core and node.chars for node in left)
    # An element around the marked ones says nothing that they do not say themselves.
    search = [node for node in left if node.in_core or not node.has_core] if cores else left
    best = max(search, key=lambda node: node.density_sum, default=body)
    threshold, node = best.density, best
    while node is not None:
        threshold, node = min(threshold, node.density), node.parent
    if best.in_core:
        # The innermost marked element around the densest subtree is the article.
        while not best.core and best.parent is not None:
            best = best.parent
    # The densest subtree of every node that is dense enough, found from the leaves up; a marked element stays whole.
    top: dict[Node, Node] = {}
    for node in reversed(left):
        own = top.get(node)
        if own is None or node.core or node.density_sum >= own.density_sum:
            top[node] = own = node
        if node.parent is not None and (node.parent not in top or own.density_sum >= top[node.parent].density_sum):
            top[node.parent] = own
    around, node = set(), best.parent
    while node is not None:
        around.add(node)
        node = node.parent
    found, within = {best}, {best}
    for node in left:
        if node.parent in within:
            within.add(node)
        elif node is not body and node.chars and node.density >= threshold and not (cores and node in around):
            found.add(top[node] if top[node].density_sum > 0 else node)
    if not best.core:
        found |= _flow_around(best, body.link_chars / max(body.chars, 1))
    return found


def main_text(html: str | None) -> str:
    """The article text of a page: blocks in page order, joined by an empty line; null or no text: empty."""
    if not html:
        return ""
    left = _measure(parse(html))
    chosen = _chosen(left)
    blocks: list[str] = []
    open_text: list[str] = []

    def close() -> None:
        text = " ".join(unescape("".join(open_text)).split())
        open_text.clear()
        if text:
            blocks.append(text)

    # An explicit stack: pages may nest deeper than Python may recurse.
    stack: list[tuple[Node | str | None, bool]] = [(left[0], False)]
    while stack:
        part, inside = stack.pop()
        if part is None:
            close()
        elif isinstance(part, str):
            if inside:
                open_text.append(part)
        else:
            inside = inside or part in chosen
            if inside and part.tag in ("br", "td", "th", "img", "wbr"):
                open_text.append("" if part.tag == "wbr" else " ")
            if part.tag in BLOCK:
                close()
                stack.append((None, False))
            stack += [(child, inside) for child in reversed(part.content)]
    close()
    return "\n\n".join(blocks)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(``page_id``, ``url``, ``text``, ``n_chars``) of every row.

    * null or empty html, and pages without any text outside menus and the like: empty text
    * repeated rows come back as often as they occur; very long or deeply nested pages are read whole
    * an empty table gives an empty result; other columns, whatever their names, are not read
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": [main_text(h) for h in batch["html"]]})

    types = dict(rows.dtypes)
    texts = rows.mapInPandas(run, f"page_id {types['page_id']}, url {types['url']}, text string")
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
