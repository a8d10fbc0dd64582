"""Operator 6, HTML extraction by composite text density.

A page becomes a tree of elements. For every node the density is its
characters per tag, adjusted for links; a node's sum adds up the densities of
its children. The main text is the subtree with the highest sum, and what
hangs beside its path to the body with a density above the path's lowest.
Inside the page's first article element all stays that is not mostly links.
Elements that are never article text (menus, forms, scripts, adverts, reader
comments and the like) leave the tree before densities are taken.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.batches import map_rows

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
_ATTR = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
#: Elements that are not article text wherever they stand.
DROPPED = frozenset("head nav footer aside form button select option svg math canvas object audio video map dialog menu "
                    "datalist fieldset label output progress meter".split()) | RAW
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rb rp rt s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
#: Blocks that cannot hold an article by themselves.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address figcaption caption tr td th br hr blockquote ul ol dl tbody thead".split())
#: Words of class, id and role that mark a place in the layout: there a whole
#: page may stand ("no-sidebar").
LAYOUT = frozenset("sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer masthead overlay widget toolbar toc "
                   "complementary contentinfo".split())
#: Words that mark what is never the article.
HINTS = LAYOUT | frozenset("ad ads adsbygoogle adslot adunit advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion "
                           "cookie cookies consent gdpr notice notices alert popup modal share sharing social related recommended newsletter "
                           "subscribe subscription signup login search comment comments reply replies respond disqus pagination pager copyright "
                           "disclaimer".split())
#: Words that only say that a block is one; beside hint words they change nothing.
NEUTRAL = frozenset("box list block blocks container wrapper wrap section area item items button buttons link links post posts inner outer content "
                    "unit slot bar form panel group row col thread body title heading main top bottom left right info icon icons widget s".split())
ARTICLES = frozenset(("article", "main"))
HEADERS = frozenset("header topbar".split())
#: Start tags that end an open element of the same row.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
_BOUNDS = frozenset("table ul ol dl article section div body main".split()) | DROPPED
#: Elements whose blocks do not end a paragraph around them.
_CELLS = frozenset("button object svg math select caption td th".split())
#: How an element is left out: by a layout word or another word of its class,
#: or wherever it stands.
BY_LAYOUT, BY_WORD, ALWAYS = 1, 2, 3


class Node:
    __slots__ = ("tag", "parent", "children", "pieces", "chars", "links", "tags", "link_tags", "density", "total", "order", "out", "within")

    def __init__(self, tag: str, parent: Node | None, out: int = 0):
        self.tag, self.parent, self.out = tag, parent, out
        #: the strongest ``out`` of the element and those around it
        self.within: int = max(out, parent.within) if parent is not None else out
        self.children: list[Node] = []
        self.pieces: list[str | Node] = []
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.total = 0.0


class _Open:
    """Open elements, outermost first, with the places of each tag, of elements
    that are left out and of those that bound rows: no look-up walks them."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.out: list[int] = []
        self.bounds: list[int] = []

    def push(self, n: Node) -> None:
        i = len(self.nodes)
        self.nodes.append(n)
        self.places[n.tag].append(i)
        if n.out:
            self.out.append(i)
        if n.tag in _BOUNDS:
            self.bounds.append(i)

    def cut(self, i: int) -> None:
        """Ends the element at a place and all in it."""
        while len(self.nodes) > i:
            n = self.nodes.pop()
            self.places[n.tag].pop()
            if n.out:
                self.out.pop()
            if n.tag in _BOUNDS:
                self.bounds.pop()

    def last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of some tags, 0 if none is."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def close(self, tag: str) -> None:
        """Ends the innermost open element of a tag. An inline end tag does
        not end a dropped element, nor ``</p>`` a cell."""
        i = self.last((tag,))
        if not i or (tag in INLINE and self.out and self.out[-1] > i) or (tag == "p" and self.last(_CELLS) > i):
            return
        self.cut(i)


def _marked(value: str, words: frozenset[str], whole: bool) -> bool:
    """Whether a class, id or role has one of the words; with ``whole`` in a
    name that says nothing else."""
    for name in value.split():
        parts = {w.lower() for w in _PARTS.findall(name)}
        if parts & words and (not whole or all(w in HINTS or w in NEUTRAL or w.isdigit() for w in parts)):
            return True
    return False


def _unwanted(tag: str, attrs: str, stack: _Open, articles: int) -> int:
    """Whether and how an element and all it holds is left out. ``articles``
    counts the articles begun before: the first is the page's own, whatever
    its class; later ones may be comments or links to others. Inside an
    article only a name of hint words alone counts ("related-posts", but not
    "comment-on-law")."""
    if tag in DROPPED:
        return ALWAYS
    inside = stack.last(ARTICLES) > 0
    if tag == "header" and not inside:
        return ALWAYS
    if "=" not in attrs and "hidden" not in attrs.lower():
        return 0
    out = 0
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return ALWAYS
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return ALWAYS
        if name in ("class", "id", "role") and not (tag in ARTICLES and not articles):
            if _marked(value, HINTS - LAYOUT, inside):
                out = BY_WORD
            elif _marked(value, LAYOUT, inside) or (not inside and _marked(value, HEADERS, False)):
                out = max(out, BY_LAYOUT)
    return out


def parse(page: str) -> Node:
    """The tree below the body, without what is never article text. Dropped
    elements stand on the same stack as others, so that they end like them."""
    root = Node("body", None)
    stack = _Open(root)
    articles = 0
    at, size = 0, len(page)
    last = page.rfind(">")

    def add(item: str | Node) -> None:
        if item and stack.nodes[-1].within != ALWAYS:
            stack.nodes[-1].pieces.append(item)

    lower = None
    for_token = _TOKEN.search
    while at < size:
        # behind the last ">" only a comment can still be a token
        m = for_token(page, at) if at <= last or page.find("<!", at) >= 0 else None
        if m is None:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        tag = name.lower()
        if m["close"]:
            if tag == "br":
                add(Node("br", None))
            else:
                stack.close(tag)
            continue
        attrs = m["attrs"]
        if tag in RAW:
            if lower is None:
                lower = page.lower()
                if len(lower) != size:
                    lower = page
            end = lower.find(f"</{tag}", at)
            closing = page.find(">", end) if end >= 0 else -1
            at = size if closing < 0 else closing + 1
            continue
        if tag in ("html", "body"):
            continue
        void = tag in VOID or attrs.endswith("/")
        if stack.nodes[-1].within and tag in ARTICLES and not articles:
            # the page's article does not start inside a menu or advert: that was never closed
            stack.cut(stack.out[0])
        if tag not in INLINE and tag != "br" and tag != "img":
            stack.close("p")
        if tag in CLOSES:
            i = stack.last(CLOSES[tag])
            if i and i >= (stack.bounds[-1] if stack.bounds else 0):
                stack.cut(i)
        within = stack.nodes[-1].within
        node = Node(tag, stack.nodes[-1], _unwanted(tag, attrs, stack, articles) if within != ALWAYS else ALWAYS)
        articles += tag in ARTICLES and not node.within
        if node.within != ALWAYS:
            stack.nodes[-1].children.append(node)
            stack.nodes[-1].pieces.append(node)
        if not void:
            stack.push(node)
    _prune(root, articles == 0)
    return root


def _in_order(root: Node) -> list[Node]:
    nodes, todo = [], [root]
    while todo:
        n = todo.pop()
        nodes.append(n)
        todo.extend(reversed(n.children))
    return nodes


def _own_chars(n: Node) -> int:
    return sum(len(" ".join(html.unescape(p).split())) for p in n.pieces if isinstance(p, str))


def _prune(root: Node, weigh: bool) -> None:
    """Takes out what a word of its class marks. On a page without an article
    a block with most of the text is the page's own, whatever place in the
    layout its class names; comments, adverts and notices go in any case."""
    nodes = _in_order(root)
    if not any(n.out for n in nodes):
        return
    if weigh:
        for n in reversed(nodes):
            n.chars = _own_chars(n) + sum(c.chars for c in n.children)
        for n in nodes:
            if n.out == BY_LAYOUT and 2 * n.chars > root.chars:
                n.out = 0
    for n in nodes:
        if any(c.out for c in n.children):
            n.children = [c for c in n.children if not c.out]
            n.pieces = [p for p in n.pieces if isinstance(p, str) or not p.out]


def _measure(root: Node) -> list[Node]:
    """Counts, densities and sums of all nodes; returns them in page order."""
    nodes = _in_order(root)
    for n in reversed(nodes):
        n.chars = _own_chars(n) + sum(c.chars for c in n.children)
        n.links = n.chars if n.tag == "a" else sum(c.links for c in n.children)
        n.tags = sum(c.tags + 1 for c in n.children)
        n.link_tags = sum(c.link_tags + (c.tag == "a") for c in n.children)
    page_links = root.links / max(root.chars, 1)
    for n in nodes:
        if n.chars:
            c, lc, t, lt = n.chars, max(n.links, 1), max(n.tags, 1), max(n.link_tags, 1)
            base = math.log(c / max(c - n.links, 1) * lc + page_links * c + math.e)
            n.density = c / t * max(math.log(c / lc * t / lt), 0.0) / max(math.log(base), 1e-3)
    for n in nodes:
        n.total = sum(c.density for c in n.children)
    return nodes


def _block_text(node: Node, skip: frozenset[int] = frozenset()) -> list[str]:
    """Texts of the blocks below a node, in page order."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            blocks.append(text)
        line.clear()

    todo: list[str | Node | None] = [node]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            line.append(item)
        elif id(item) not in skip:
            if item.tag not in INLINE:
                flush()
                todo.append(None)
            todo.extend(reversed(item.pieces))
    flush()
    return blocks


def main_text(page: str | None) -> str:
    """The article of a page: blocks in page order, joined by one space. Empty
    for a null or empty page, or one without text."""
    if not page:
        return ""
    root = parse(page)
    nodes = _measure(root)
    if not root.chars:
        return ""
    best = max(nodes, key=lambda n: n.total)  # the first of equal ones
    if not best.total:
        best = root
    while best.parent is not None and (best.tag in LEAVES or best.tag in INLINE):
        best = best.parent
    path = {id(best)}
    lowest, up = best.density, best.parent
    while up is not None:
        path.add(id(up))
        lowest = min(lowest, up.density)
        up = up.parent
    article = next((n for n in nodes if n.tag in ARTICLES), None)
    inside = article is not best and article is not None and id(article) in path
    dropped = set()
    up = best.parent
    while up is not None:
        for c in up.children:
            if id(c) in path or c.tag in INLINE:
                continue
            # in the article, and for a block that cannot hold one, only links count
            if 2 * c.links > c.chars if inside or c.tag in LEAVES else c.density < lowest:
                dropped.add(id(c))
        inside = inside and up is not article
        up = up.parent
    return " ".join(_block_text(root, frozenset(dropped)))


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``key, url, text, n_chars`` of every row; repeated rows are repeated,
    an empty table gives none, other columns are not read. Broken pages of any
    length are read in one pass: no end tag walks the open elements."""
    fields = pages.select(key, url, page).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[key, url, "text", "n_chars"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields.fields[:2])
    return map_rows(pages.select(key, url, F.col(page).alias("_page")), work, f"{types}, text string, n_chars long")
