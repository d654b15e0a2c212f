"""Operator 6: main text of web pages by composite text density.

Every page becomes a small DOM.  Menus, footers, asides, scripts and styles are
cut out by their elements and roles.  Forms, page headers and what class and id
names mark (sidebars, notices, adverts, reader comments) are cut out too, but not
where such a part holds the densest subtree of the page and more text than all
unmarked parts together (reader comments: only where no unmarked text is left).
Then for every node that stays, the characters per tag are adjusted by the share of
link characters and link tags (composite density), child densities are summed,
and the subtree with the largest sum is the article.  Parts outside it are kept
only where their density reaches the threshold, the least density on the path
from that subtree up to the body.

Text: character references decoded, white space inside a block turned into one
space, blocks joined in page order by one newline; nothing else is dropped.

Defined cases: null or empty html, or a page without text, gives ''; markup cut
off at the end of a page is dropped, text before it stays; repeated rows give
repeated rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: element roles
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
                   "search section summary table tbody td tfoot th thead tr ul").split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCK - frozenset("body caption html legend option optgroup tbody td tfoot th thead tr".split())
#: An open element of the value ends where the key starts, up to the nearest list or table around it.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
            "option": ("option",), "thead": ("tr", "td", "th", "tbody"), "tbody": ("tr", "td", "th", "thead", "tbody")}
SCOPES = frozenset("ul ol dl table select body html article section div main aside nav header footer form".split())
#: Elements that can hold an article.
HOLDERS = frozenset("body main article section div td center blockquote details fieldset dd figure form".split())
#: Elements that never hold the article.
DROPPED = frozenset(("head script style noscript template iframe object embed svg canvas nav footer aside button select "
                     "textarea input label dialog menu audio video map").split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Words of class and id names that mark such parts.
MARKS = frozenset(("nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer sidebar side aside widget "
                   "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent "
                   "gdpr notice alert popup modal overlay newsletter subscribe subscription signup login paywall form search "
                   "share sharing social related recommended recommendations pagination pager comment comments commentlist respond "
                   "discussion disqus replies reply skip toolbar").split())

#: Names with one of these words tell the state of a layout ("no-sidebar"), not a role.
STATES = frozenset("no has with without free".split())
#: Marks of reader comments.
REPLIES = frozenset("comment comments commentlist respond disqus replies reply".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[A-Za-z][^>]*(?:>|\Z)", re.S)
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
RAW_END = {tag: re.compile("</" + tag, re.I | re.A) for tag in RAW}


class Node:
    __slots__ = ("tag", "children", "parent", "drop", "chars", "tags", "link_chars", "link_tags", "density", "total", "marks")

    def __init__(self, tag: str, parent: "Node | None", drop: bool = False, marks: frozenset = frozenset()):
        self.tag, self.parent, self.drop, self.children, self.marks = tag, parent, drop, [], marks


def _marked(tag: str, attrs: str, parent: Node) -> tuple[bool, frozenset]:
    """Whether an element never holds the article, and the names by which it seldom does."""
    if tag in DROPPED:
        return True, frozenset()
    article = _inside(parent, ("article", "main"))
    marks = {tag} if tag == "form" or tag == "header" and not article else set()
    if not attrs or tag in ("html", "body", "article", "main"):
        return False, frozenset(marks)
    for name, a, b, c in ATTR.findall(attrs):
        value, name = a or b or c, name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
            return True, frozenset()
        if name in ("class", "id"):
            for one in (value or "").split():
                words = {x.lower() for x in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", one)}
                if STATES.isdisjoint(words):
                    marks |= MARKS & words
    if article:
        # a title block, and a paper's section
        marks -= {"header", "masthead"} | ({"discussion"} if tag == "section" else set())
    return False, frozenset(marks)


def _inside(node: Node | None, tags) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def parse(page: str) -> Node:
    """DOM of the page below ``body``; text children are strings."""
    body = at = Node("body", None)
    pos, n = 0, len(page)
    while pos < n:
        m = TOKEN.search(page, pos)
        text = page[pos:m.start() if m else n]
        if text:
            at.children.append(html.unescape(text))
        if not m:
            break
        pos = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            up = at
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up is not body:
                at = up.parent
            continue
        if tag in ("html", "body"):
            continue
        if tag in ENDS_P:
            at = _leave(at, ("p",))
        if tag in SIBLINGS:
            at = _leave(at, SIBLINGS[tag])
        node = Node(tag, at, *_marked(tag, m[3], at))
        at.children.append(node)
        if tag in RAW:
            end = RAW_END[tag].search(page, pos)
            close = page.find(">", end.end()) if end else -1
            node.drop = True
            pos = close + 1 if close >= 0 else n
        elif tag not in VOID and not (m[3].endswith("/") and tag not in BLOCK):
            at = node
    return body


def _leave(at: Node, tags: tuple[str, ...]) -> Node:
    """The parent of the open element of these tags, if one is open up to the next list, table or section."""
    up, top = at, None
    while up.parent is not None and (up.tag in tags or up.tag not in SCOPES):
        if up.tag in tags:
            top = up
        up = up.parent
    return top.parent if top is not None else at


def _measure(body: Node) -> list[Node]:
    """Characters, tags and links of every kept node, bottom up; returns the nodes in page order."""
    order, stack = [], [body]
    while stack:
        node = stack.pop()
        order.append(node)
        node.children = [c for c in node.children if isinstance(c, str) or not c.drop]
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str))
    for node in reversed(order):
        kids = [c for c in node.children if not isinstance(c, str)]
        node.chars = sum(len("".join(c.split())) for c in node.children if isinstance(c, str)) + sum(c.chars for c in kids)
        node.tags = sum(c.tags + 1 for c in kids)
        link = node.tag == "a"
        node.link_chars = node.chars if link else sum(c.link_chars for c in kids)
        node.link_tags = sum(c.link_tags + (c.tag == "a") for c in kids)
    for node in reversed(order):
        node.density = _density(node, body)
        node.total = sum(c.density for c in node.children if not isinstance(c, str))
    return order


def _density(node: Node, body: Node) -> float:
    """Characters per tag, lowered by a logarithm whose base grows with the share of links."""
    if not node.chars:
        return 0.0
    tags, links = max(node.tags, 1), max(node.link_tags, 1)
    plain = max(node.chars - node.link_chars, 1)
    base = math.log(node.chars / plain * node.link_chars + body.link_chars / max(body.chars, 1) * node.chars + math.e)
    ratio = node.chars / max(node.link_chars, 1) * tags / links
    return node.chars / tags * max(math.log(max(ratio, 1e-9)), 0.0) / base


def _blocks(node: Node, out: list[list[str]], take: set[int] | None) -> None:
    """Text of a subtree, cut into blocks; ``take`` limits it to marked subtrees."""
    stack: list = [(node, take is None or id(node) in take)]
    while stack:
        item, inside = stack.pop()
        if item is None:
            out.append([])
        elif isinstance(item, str):
            if inside:
                out[-1].append(item)
        elif item.tag == "br":
            out[-1].append(" ")
        else:
            inside = inside or take is not None and id(item) in take
            if item.tag in BLOCK:
                out.append([])
                stack.append((None, inside))
            stack.extend((c, inside) for c in reversed(item.children))


def _densest(nodes: list[Node]) -> Node:
    """The subtree with the largest sum."""
    # paragraphs and inline markup are summed but are no subtree of their own: an article is what holds them
    return max((x for x in nodes if x.tag in HOLDERS), key=lambda x: x.total)


def _cut_marked(body: Node, nodes: list[Node]) -> None:
    """Drops the marked parts but those that hold the densest subtree and more text than all unmarked parts."""
    around, up = [], _densest(nodes)
    while up is not None:
        around.append(up)
        up = up.parent
    outer = [x for x in around if x.marks]
    if outer:
        stack, plain = [body], 0
        while stack:
            node = stack.pop()
            plain += sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
            stack.extend(c for c in node.children if not isinstance(c, str) and not c.marks and c.tag != "a")
        top = outer[-1]
        if plain if any(x.marks & REPLIES for x in outer) else plain >= top.chars - top.link_chars:
            outer = []
    for node in nodes:
        if node.marks and not any(node is x for x in outer):
            node.drop = True


def main_text(page: str | None) -> str:
    """The article's text."""
    if not page:
        return ""
    body = parse(page)
    nodes = _measure(body)
    if any(x.marks for x in nodes):
        _cut_marked(body, nodes)
        nodes = _measure(body)
    if not body.chars:
        return ""
    best = _densest(nodes)
    threshold, up = best.density, best
    while up is not None:
        threshold, up = min(threshold, up.density), up.parent
    # top down: in every branch that is dense enough the subtree with the largest sum is content
    take, stack = {id(best)}, [body]
    while stack:
        node = stack.pop()
        if id(node) in take:
            continue
        for c in node.children:
            if not isinstance(c, str) and c.chars:
                if c.density >= threshold and not _holds(c, best):
                    take.add(id(c))
                else:
                    stack.append(c)
    out: list[list[str]] = [[]]
    _blocks(body, out, None if id(body) in take else take)
    return "\n".join(t for t in (" ".join("".join(b).split()) for b in out) if t)


def _holds(node: Node, other: Node | None) -> bool:
    while other is not None:
        if other is node:
            return True
        other = other.parent
    return False


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html)."""

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()),
                                              pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
