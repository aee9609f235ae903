"""HTML extraction: tree scoring.

Paragraphs pass points for their length and commas to their ancestors, discounted by link density;
the best container and its fitting siblings are kept.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import arrow_pass

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that never hold article text.
DROPPED = frozenset(
    "script style noscript template head title nav footer aside button select textarea input "
    "iframe object svg canvas audio video dialog menu".split())
# A start tag of these ends an open paragraph.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul caption".split())
# An open element of the first kind is ended by a start tag of the others, inside the given holders.
ENDED_BY = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "td": (frozenset("td th tr tbody tfoot".split()), frozenset(["table"])),
    "th": (frozenset("td th tr tbody tfoot".split()), frozenset(["table"])),
    "tr": (frozenset("tr tbody tfoot".split()), frozenset(["table"])),
}
ENDERS = frozenset().union(*(enders for enders, _ in ENDED_BY.values()))
# End tags do not reach beyond these.
WALLS = frozenset("html body article section main div td th table blockquote".split())
P_WALLS = WALLS | {"li", "dd"}
# Words in class, id or role that mark page furniture.
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored promo promotion "
    "sidebar rail nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer footnav "
    "header masthead topbar toolbar banner cookie cookies consent gdpr notice alert popup modal overlay "
    "comment comments commentlist respond disqus discussion reply replies share sharing social related "
    "recommended newsletter subscribe subscription signup login search skip contentinfo complementary "
    "dialog widget teaser".split())
# Furniture that is text by readers, of which there may be more than of the article.
READERS = frozenset("comment comments commentlist respond disqus discussion reply replies".split())
COMMENT = frozenset("comment comments reply replies ad ads advert promo related teaser".split())
# Furniture words that slugs of an article's own sections have as well.
TOPICS = frozenset(
    "advertising promotion navigation cookies consent gdpr notice alert response discussion related "
    "recommended social share sharing search subscription login".split())
# Only containers are furniture by class, id or role, not headings, paragraphs or inline elements.
CONTAINERS = BLOCKS - frozenset(
    "h1 h2 h3 h4 h5 h6 hgroup p pre blockquote address summary caption figcaption legend hr".split())
SCORED = frozenset("p pre blockquote td dd li h1 h2 h3 h4 h5 h6 div section article main body".split())


class Node:
    __slots__ = ("tag", "parts", "parent", "furniture", "suspect", "text", "linked", "score", "level")

    def __init__(self, tag, parent, furniture=False, suspect=None):
        self.tag, self.parent, self.furniture, self.suspect = tag, parent, furniture, suspect
        self.parts = []  # child nodes and texts, in page order
        self.text = self.linked = 0
        self.score = 0.0
        self.level = parent.level + 1 if parent else 0


# Words that say a header is the article's own.
OWN_HEADER = frozenset("article post entry story".split())


def is_furniture(tag: str, attrs, inside_article: bool) -> bool:
    """Whether the element can't hold article text, by its name or because it is hidden."""
    if tag in DROPPED or tag == "header" and not inside_article:
        return True
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def looks_like_furniture(tag: str, attrs) -> str | None:
    """Whether class, id or role name a container as furniture: "firm", "reader" for readers' comments, or
    "topic" if all of the words may as well be the topic of a section. A form is "firm"."""
    if tag in ("html", "body", "main") or tag not in CONTAINERS:
        return None
    kind = "firm" if tag == "form" else None
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
            named = words & (COMMENT if tag == "article" else FURNITURE)
            if named - TOPICS and not (named == {"header"} and words & OWN_HEADER):
                return "reader" if named & READERS - TOPICS else "firm"
            if named & TOPICS and kind is None:
                kind = "topic"
    return kind


def clear_suspects(root: Node) -> list[Node]:
    """A suspect is furniture, unless it holds an article or main part that is not one itself: those
    that are furniture."""
    nodes = preorder(root)
    for node in nodes:
        if node.tag in ("article", "main") and not node.suspect:
            up = node.parent
            while up is not None:
                up.suspect, up = None, up.parent
    found = [node for node in nodes if node.suspect]
    for node in found:
        node.furniture = True
    return found


def restore_topics(suspects: list[Node], scope: Node) -> None:
    """Sections of the article named by their topic: text enough, and little of it linked."""
    for node in reversed(suspects):  # inner ones first
        up = node.parent
        while up is not None and up is not scope:
            up = up.parent
        if node.suspect != "topic" or up is None:
            continue
        node.text = node.linked = 0
        stack = [(node, False)]
        while stack:
            here, linked = stack.pop()
            for x in here.parts:
                if not isinstance(x, str):
                    if not x.furniture:
                        stack.append((x, linked or x.tag == "a"))
                elif length := len(x.strip()):
                    node.text += length
                    node.linked += length * linked
        node.furniture = node.text < 80 or link_share(node) >= 0.25


class Tree(HTMLParser):
    """The element tree without furniture; repairs unclosed paragraphs, items and cells."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("html", None)

    def updatepos(self, i, j):  # nobody asks for line numbers
        return j

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._end_open("p", P_WALLS)
            if tag != "html" and self.here.furniture:  # what belongs to the body ends an open head
                self._end_open("head", frozenset(["body"]))
        if tag in ENDERS:
            for open_tag, (enders, holders) in ENDED_BY.items():
                if tag in enders:
                    self._end_open(open_tag, holders)
        here = self.here
        if tag in VOID:
            if tag in ("br", "hr"):
                here.parts.append(" " if tag == "br" else Node("hr", here))
            return
        if tag in ("html", "body") and any(node.tag == tag for node in self._open()):
            return
        furniture = here.furniture or (tag in DROPPED or tag == "header" or bool(attrs)) and is_furniture(
            tag, attrs, any(x.tag == "article" for x in self._open()))
        node = Node(tag, here, furniture, looks_like_furniture(tag, attrs) if attrs or tag == "form" else None)
        here.parts.append(node)
        self.here = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        for node in self._open():
            if node.tag == tag:
                if node.parent is not None:
                    self.here = node.parent
                return
            if node.tag in WALLS and tag not in BLOCKS:
                return

    def handle_data(self, data):
        if not self.here.furniture:
            self.here.parts.append(data)

    def _open(self):
        node = self.here
        while node is not None:
            yield node
            node = node.parent

    def _end_open(self, tag, walls):
        for node in self._open():
            if node.tag == tag:
                self.here = node.parent
                return
            if node.tag in walls:
                return


def preorder(root: Node) -> list[Node]:
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        found.append(node)
        stack.extend(x for x in reversed(node.parts) if isinstance(x, Node) and not x.furniture)
    return found


def measure(nodes: list[Node]) -> None:
    """Length of text and of linked text of each node, and the points its paragraphs pass on."""
    commas = {}
    for node in nodes:
        node.text = node.linked = 0
        node.score = 0.0
    for node in reversed(nodes):  # children come before their parents
        own = "".join(x for x in node.parts if isinstance(x, str))
        length, count = len(own.strip()), own.count(",")
        node.text += length
        if node.tag == "a":
            node.linked = node.text
        inline = commas.pop(node, 0) + count
        if node.tag in BLOCKS:
            if node.text and (node.tag in SCORED) and (length or inline):
                points = 1 + inline + min(node.text / 100, 3)
                points *= 1 - min(1.0, node.linked / node.text)
                up, step = node.parent, 0
                while up is not None and step < 5:  # parent full, grandparent half, others a third ...
                    up.score += points / (1 if step == 0 else 2 if step == 1 else 3 * step)
                    up, step = up.parent, step + 1
        elif node.parent is not None:
            commas[node.parent] = commas.get(node.parent, 0) + inline
        if node.parent is not None:
            node.parent.text += node.text
            node.parent.linked += node.linked


def link_share(node: Node) -> float:
    return node.linked / node.text if node.text else 0.0


def blocks_of(roots: list[Node]) -> list[str]:
    """Texts of the blocks below the roots in page order, white space collapsed, empty ones left out."""
    found: list[str] = []
    run: list[str] = []

    def flush():
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            found.append(text)

    for root in roots:
        stack: list = [root]
        while stack:
            item = stack.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                run.append(item)
            elif not item.furniture:
                if item.tag in BLOCKS:
                    flush()
                    stack.append(None)
                stack.extend(reversed(item.parts))
        flush()
    return found


def wrapper_among(suspects: list[Node], found: int) -> Node | None:
    """The suspect that holds the article after all, if there is one: a name such as "content sidebar" may
    be that of the element around both. It must hold much more plain text of its own, outside other
    suspects, than was found without it. One named after readers' comments is the last resort, when nothing
    was found, and then the outermost one, as comments may outweigh the article."""
    plain = {node: plain_text(node) for node in suspects if node.furniture}
    likely = [node for node, length in plain.items() if length >= 200 and length >= 3 * found]
    named = [node for node in likely if node.suspect != "reader"]
    if named:
        return max(named, key=plain.get)
    return min(likely, key=lambda node: (node.level, -plain[node]), default=None) if found < 80 else None


def plain_text(node: Node) -> int:
    """Characters of text below an element that are neither linked nor below furniture."""
    total, stack = 0, [node]
    while stack:
        for x in stack.pop().parts:
            if isinstance(x, str):
                total += len(x.strip())
            elif not x.furniture and x.tag != "a":
                stack.append(x)
    return total


def main_text(html: str | None) -> str:
    """The article's text: blocks in page order, joined by one line break; empty if there is none."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(re.sub(r"<[a-zA-Z/!?][^>]*\Z", "", html))
    tree.close()
    suspects = clear_suspects(tree.root)
    while True:
        text = best_text(tree.root, suspects)
        wrapper = wrapper_among(suspects, len(text))
        if wrapper is None:
            return text
        while wrapper is not None:  # nor are the elements around it furniture
            wrapper.furniture, wrapper.suspect, wrapper = False, None, wrapper.parent


def best_text(root: Node, suspects: list[Node]) -> str:
    """The text of the best container and its fitting siblings, without what is furniture by now."""
    nodes = preorder(root)
    measure(nodes)
    best = max(nodes, key=lambda node: (node.score * (1 - link_share(node)), -node.level))
    if best.score <= 0:
        return "\n".join(blocks_of([root]))
    whole = best
    while whole is not None and whole.tag not in ("article", "main"):
        whole = whole.parent
    outer = whole
    while outer is not None:  # an article inside an article or main belongs to it
        if outer.tag == "article":
            whole = outer
        outer = outer.parent
    if whole is not None:
        best = whole
    restore_topics(suspects, best if whole is not None else best.parent or best)
    kept = [best]
    floor = max(10.0, 0.2 * best.score)
    if best.parent is not None:
        kept, between = [], []  # what stands between kept siblings is kept with them
        for other in best.parent.parts:
            if other is best:
                kept += [*between, best]
                between = []
            elif isinstance(other, Node) and not other.furniture and other.text:
                share = link_share(other)
                if (other.score >= floor or other.tag in ("article", "section") and share < 0.25
                        or other.tag in ("p", "h1", "h2", "pre", "blockquote") and share < 0.25):
                    kept += [*between, other]
                    between = []
                elif kept and (other.tag in ("h3", "h4", "h5", "h6", "figure")
                               or other.tag in ("ul", "ol", "dl", "table") and share < 0.9):
                    between.append(other)
    return "\n".join(blocks_of(kept))


def extract_main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"),
                      ) -> DataFrame:
    """Main text of every page: the kept columns, then text and n_chars (code points).

    Markup, scripts, styles, menus, page headers and footers, sidebars, notices, adverts, forms and
    reader comments are left out; character references are decoded; white space inside a block becomes
    one space and blocks are joined by one line break. Nothing else is dropped or cut. An element whose class,
    id or role names furniture, and a form, is furniture unless it holds the article or main element, or
    else the article itself (see `wrapper_among`). A null, empty or
    textless page has empty text and 0 characters. Pages are independent: repeated rows give repeated
    rows, an empty table gives an empty one, other columns are ignored.
    """
    slim = pages.select(*[F.col(c) for c in keep], F.col(html).alias("__html"))
    schema = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep)

    def make():
        def work(batch: pa.RecordBatch):
            texts = [main_text(x) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()),
                 pa.array([len(x) for x in texts], pa.int64())], [*keep, "text", "n_chars"])
        return work

    return arrow_pass(slim, f"{schema}, text string, n_chars bigint", make, rows=500)
