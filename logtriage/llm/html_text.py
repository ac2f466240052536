"""Main text of web pages by tree scoring.

Each page becomes a small tree of elements and text blocks. Boilerplate (navigation, headers, footers, adverts,
forms, comments and the like, told by element, role, class and id) is cut off; a form or wrapper around an article is not. Every remaining block gives points for its length
and its commas to its container, half to the one above, and less further up; a container's points are discounted by
the share of its text that is links. The best container is the article, with those siblings that look like parts of it.
A page is handled by itself inside a task; nothing is shuffled.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr del".split())
DROPPED = frozenset("head script style noscript template nav footer aside form button select option textarea input iframe object embed svg canvas audio video map dialog menu title".split())
# An element of the first kind is closed by the begin of one of the second.
_BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CLOSES = {"p": _BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
# Beyond these, an end or begin does not close elements further out.
_SCOPES = frozenset("table ul ol dl article section main aside nav header footer form body html div blockquote td th".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_JUNK = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert
    popup modal overlay newsletter subscribe subscription signup paywall sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead
    topbar comment comments reply replies respond disqus discussion share sharing social related recommended recommendations widget login search pager
    pagination toolbar skip hidden tags""".split()
)
# A name such as "comment-list" is told by its first word if it goes on with one of these.
_PARTS_OF_PAGE = frozenset(
    """area bar block body box button buttons card container content feed footer form group header holder inner item items label link links list module nav
    outer panel row section slot strip text thread title unit widget wrap wrapper zone""".split()
)
# Inside an article these are its own parts; ids of prose are link targets, not kinds of parts.
_FINE_IN_ARTICLE = frozenset("header masthead".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption".split())
_CELLS = frozenset("li dt dd td th tr tbody thead tfoot table ul ol dl".split())
_NEVER_BY_NAME = frozenset("html body article main".split())
_PHRASING = INLINE | {"p", "li"}
# Points reach this many levels up, and the article around, however far.
LEVELS = 10
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SIBLING_SHARE, LONG_TEXT = 0.2, 80


class Node:
    __slots__ = ("tag", "parent", "children", "junk", "points", "chars", "link_chars", "holds_article", "depth", "scope", "open", "near", "block", "article", "kept")

    def __init__(self, tag: str, parent: Node | None, junk: bool):
        self.tag, self.parent, self.junk = tag, parent, junk
        self.children: list[Node | tuple[str, bool]] = []
        self.points = 0.0
        self.chars = self.link_chars = 0
        self.holds_article = self.kept = False
        # What would else be found by climbing, so that deep pages cost no more than flat ones: the element around that
        # bounds implied ends (with the elements open in it), the nearest one that can end by itself, block and article.
        self.depth = parent.depth + 1 if parent else 0
        self.scope = self if parent is None or tag in _SCOPES else parent.scope
        self.open: dict[str, int] = {}
        self.near = self if tag in _CLOSES else None if tag in _SCOPES or parent is None else parent.near
        self.block = parent.block if parent is not None and tag in INLINE else self
        self.article = self if tag in ("article", "main") else parent.article if parent else None


def _junk_name(name: str, inside_article: bool) -> bool:
    """Whether one class or id names boilerplate: by the whole name, its last word, or its first word before a part of a page."""
    words = [word.lower() for word in _TOKENS.findall(name)]
    while len(words) > 1 and words[-1].isdigit():
        words.pop()
    if not words:
        return False
    junk = _JUNK - _FINE_IN_ARTICLE if inside_article else _JUNK
    return words[-1] in junk or words[0] in junk and all(word in _PARTS_OF_PAGE or word in junk or word.isdigit() for word in words[1:])


def _is_junk(tag: str, attributes: list[tuple[str, str | None]], inside_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not inside_article:
        return True
    for name, value in attributes:
        value = value or ""
        if name in ("hidden",) or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
        if name == "class" and tag not in _NEVER_BY_NAME or name == "id" and tag not in _NEVER_BY_NAME | _PROSE:
            if any(_junk_name(word, inside_article) for word in value.split()):
                return True
    return False


class _Tree(HTMLParser):
    """A forgiving tree: elements close by the usual implied ends, text knows whether it is inside a link."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None, False)
        self.nodes = [self.root]
        self.open: dict[str, int] = {}
        self.links = self.articles = 0

    def _up(self, node: Node) -> None:
        while self.at is not node:
            self.links -= self.at.tag == "a"
            self.articles -= self.at.tag in ("article", "main")
            for counts in (self.open, self.at.parent.scope.open):
                counts[self.at.tag] -= 1
            self.at = self.at.parent

    def handle_starttag(self, tag: str, attributes: list) -> None:
        if tag in ("html", "body"):
            return
        closing = self.at.near
        while closing is not None:  # an open element that this one ends
            if tag in _CLOSES[closing.tag]:
                self._up(closing.parent)
                break
            closing = None if closing.tag in _SCOPES else closing.parent.near
        node = Node(tag, self.at, _is_junk(tag, attributes, self.articles > 0))
        self.at.children.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            for counts in (self.open, self.at.scope.open):
                counts[tag] = counts.get(tag, 0) + 1
            self.at = node
            self.links += tag == "a"
            self.articles += tag in ("article", "main")
            if tag in ("article", "main"):
                above = node.parent
                while above is not None and not above.holds_article:
                    above.holds_article = True
                    above = above.parent

    def handle_startendtag(self, tag: str, attributes: list) -> None:
        self.handle_starttag(tag, attributes)

    def handle_endtag(self, tag: str) -> None:
        # an end of text markup ends nothing beyond the element that bounds it
        if not (self.at.scope.open if tag in _PHRASING else self.open).get(tag):
            return
        node = self.at
        while node.tag != tag:
            node = node.parent
        self._up(node.parent)

    def handle_data(self, data: str) -> None:
        self.at.children.append((data, self.links > 0))


def _cut(node: Node) -> bool:
    # a wrapper that holds the article is no boilerplate, whatever it is called
    return node.junk and not (node.holds_article and (node.tag == "form" or node.tag not in DROPPED))


def _blocks(node: Node, out: list[tuple[Node, list[str], int]], open_block: list) -> None:
    """Blocks in page order as (container, pieces, link characters); iterative, as trees can be deep."""
    stack: list[tuple[Node, int]] = [(node, 0)]

    def flush() -> None:
        if open_block[1]:
            out.append((open_block[0], open_block[1], open_block[2]))
        open_block[:] = [None, [], 0]

    while stack:
        current, k = stack.pop()
        if k == 0 and current.tag not in INLINE:
            flush()
        children = current.children
        while k < len(children):
            child = children[k]
            k += 1
            if isinstance(child, tuple):
                if open_block[0] is None:
                    open_block[0] = current.block
                open_block[1].append(child[0])
                open_block[2] += len(child[0].strip()) if child[1] else 0
            elif child.tag == "br":
                open_block[1].append(" ") if open_block[1] else None
            elif not _cut(child):
                stack += [(current, k), (child, 0)]
                break
        else:
            if current.tag not in INLINE:
                flush()
    flush()


def extract(html: str | None) -> str:
    """Main text of one page: its blocks joined by an empty line.

    White space inside a block becomes one blank; character references are decoded. Null, empty and textless
    pages give an empty text. Ties between containers go to the first in page order.
    """
    if not html:
        return ""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    found: list[tuple[Node, list[str], int]] = []
    _blocks(tree.root, found, [None, [], 0])
    blocks = []
    for holder, pieces, links in found:
        text = " ".join("".join(pieces).split())
        if text:
            blocks.append((holder, text, links))
    if not blocks:
        return ""
    candidates: dict[Node, None] = {}
    for holder, text, links in blocks:
        points = (1 + min(text.count(",") + text.count("،") + text.count("、"), 10) + min(len(text) / 100, 3)) * (1 - min(1.0, links / len(text)))
        if holder.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            points *= 0.3
        container = holder if holder.tag not in _PROSE else holder.parent
        # a cell or an entry speaks for what its table or list stands in
        while container.tag in _CELLS and holder.tag in _CELLS and container.parent is not None and container.depth > holder.depth - LEVELS:
            container = container.parent
        first, around = container, holder.article
        share, level = 1.0, 0
        while container is not None and level < LEVELS:
            container.points += points * share
            candidates.setdefault(container)
            level += 1
            share = 0.5 if level == 1 else 1 / (3 * level)
            container = container.parent
        if around is not None and first.depth - around.depth >= LEVELS:
            around.points += points / (3 * (first.depth - around.depth))
            candidates.setdefault(around)
        holder.chars += len(text)
        holder.link_chars += links
    for node in reversed(tree.nodes[1:]):  # children come after their parents
        node.parent.chars += node.chars
        node.parent.link_chars += node.link_chars
    for node in candidates:
        node.points *= 1 - min(1.0, node.link_chars / max(1, node.chars))
        if node.tag in ("article", "main"):
            node.points = node.points * 1.5 + 25
        elif node.tag in ("ul", "ol", "dl", "table", "address"):
            node.points *= 0.7
    best = max(candidates, key=lambda node: node.points)
    chosen = {best}
    if best.parent is not None:
        for sibling in best.parent.children:
            if isinstance(sibling, Node) and sibling is not best and sibling.chars:
                density = sibling.link_chars / sibling.chars
                alike = sibling.points >= SIBLING_SHARE * best.points and density < 0.25 and sibling.tag in (best.tag, "article", "section", "div", "main")
                prose = sibling.tag in ("p", "blockquote", "pre", "h1", "h2") and best.tag not in ("article", "main") and density < 0.25 and (sibling.chars >= LONG_TEXT or density == 0)
                if alike and (best.tag not in ("article", "main") or sibling.tag == best.tag) or prose:
                    chosen.add(sibling)

    for node in tree.nodes:
        node.kept = node in chosen or node.parent is not None and node.parent.kept
    return "\n\n".join(text for holder, text, _ in blocks if holder.kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with text and n_chars (code points); every row is kept, repeated rows too.

    A null page_id or url stays null, a null or empty html gives an empty text, an empty table an empty one. Other
    columns are left out, also those named text or n_chars.
    """

    @F.arrow_udf("string")
    def main_text(html: pa.Array) -> pa.Array:
        return pa.array([extract(page) for page in html.to_pylist()], pa.string())

    found = pages.select("page_id", "url", main_text(F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
