"""Main text of web pages by composite text density.

A page is parsed into its tree of elements. Every node gets its text density (characters for each tag below it) and its
composite density (Sun, Song and Liao, 2011), which lowers the density where links hold much of the text:

    CTD = C / T * log(C / LC * T / LT, base ln(C / (C - LC) * LC + LCb / Cb * C + e))

with C characters, T tags, LC characters and LT tags in links, the body's values marked b. The node whose children have
the largest sum of composite densities is dense text. The article is that node or its outermost ancestor, up to an
<article> or <main>, that has another child with half as much plain text for each tag, so that all sections of an article
count. The least density on the path from it to the body is the threshold: lists of links below it are left out, unless
they follow a heading or are in an <article>.

Elements that are never article text (navigation, scripts, what is hidden) are no part of the tree. A form is none unless
it holds half of the page's text or an <article>, as a form around the whole body does. A header outside of an article
is none, but one with a heading that stands beside the article's text is the article's. The words of a class or id are a
weight on boxes (not on headings, paragraphs and what is in them; sections by class alone): a box that nothing but such
words names (as "sidebar" or "cookie-notice" do, "share-price" does not) counts nothing in its parent's sum, is not
chosen and is left out of the article. So does, outside of an <article>, a list of three or more like entries of several
parts without headings (reader comments) where the page has a heading and text besides. On a page with hardly any text
beside such elements, they count. If a page has one <article> with a heading and some text, the node is chosen in it.

A text is the article's blocks in page order, one line each: character references decoded, white space inside a block
made one space, no empty blocks. Elements of phrasing content and line breaks are inside a block; all others begin one.

Defined results: null and empty pages, and pages without text, give the empty text; unclosed and stray tags are read as
browsers do for paragraphs, list items and table cells, and otherwise end with their parent; repeated rows give repeated
results; columns other than those that are named are not read.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = r"[^\s\"'<>/=]+"
TAG = re.compile(rf"<(?:!--.*?(?:-->|$)|![^>]*>?|\?[^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:\s+|/|{_WORD}\s*=\s*\"[^\"]*\"|{_WORD}\s*=\s*'[^']*'|{_WORD}\s*=\s*[^\s\"'>]*|{_WORD}|[\"'=])*)>?)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.S)
# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
PHRASING = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that are not article text whatever they hold.
OTHER = frozenset("nav footer aside button select option script style noscript template iframe textarea head title svg canvas object embed audio video map dialog menu input noembed noframes xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Boxes whose class or id is a weight.
BOXES = frozenset("div ul ol dl table section details figure center li td".split())
#: Characters without which a page has hardly any text.
LITTLE = 200
#: Elements with headers and titles of their own.
SECTIONS = frozenset("article main section".split())
#: Words of a class or id that name such a part, and words that say nothing beside them.
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside rail widget footer foot header masthead topbar toolbar cookie cookies consent gdpr "
    "notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist disqus reply replies respond form search pagination pager copyright legal disclaimer skip hidden".split()
)
NEUTRAL = frozenset("area bar block box container content inner item items left link links list main outer panel right section text top wrap wrapper".split())
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]),
}
_SCOPE = frozenset("ul ol dl table select body article section main div blockquote td th".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "below", "kind", "named", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, kind: str = ""):
        """kind: "" or "other", "form", "header", "named"; what is in an other element is dropped with it."""
        self.tag, self.parent, self.kind = tag, parent, kind
        above = parent is not None and parent.below
        self.dropped, self.below, self.named = above or kind in ("other", "header"), above or kind == "other", kind == "named"
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0

    def kept(self) -> list[Node]:
        """The children that count."""
        return [c for c in self.children if type(c) is Node and not c.dropped]


def is_named(names: str) -> bool:
    """Whether one of the names of a class or id has words of parts and no others but neutral ones."""
    for name in names.split():
        found = {w.lower() for w in _NAMES.findall(name) if not w.isdigit()}
        if found & PARTS and found <= PARTS | NEUTRAL:
            return True
    return False


def kind_of(tag: str, attributes: str, parent: Node) -> str:
    """What an element is by its name, role, style, class and id."""
    if tag in OTHER:
        return "other"
    kind = "form" if tag in ("form", "fieldset") else ""
    if tag == "header":
        up = parent
        while up is not None and up.tag not in SECTIONS:
            up = up.parent
        kind = "header" if up is None else ""
    if not attributes or tag in ("html", "body", "article", "main"):
        return kind
    named = False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in ROLES:
            return "other"
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "other"
        if name == "role" and value.lower() == "form":
            kind = "form"
        named = named or tag in BOXES and (name == "class" or name == "id" and tag != "section") and is_named(value)
    return "named" if named and not kind else kind


def parse(page: str) -> Node:
    """The tree of a page; texts are strings among the children, character references still in them."""
    root = node = Node("#root", None)
    place, size = 0, len(page)
    while place < size:
        at = page.find("<", place)
        if at < 0:
            at = size
        if at > place:
            node.children.append(page[place:at])
        if at == size:
            break
        m = TAG.match(page, at)
        if not m:
            node.children.append("<")
            place = at + 1
            continue
        place = m.end()
        close, tag, attributes = m.groups()
        if not tag:
            continue
        tag = tag.lower()
        if close:
            open_ = node
            while open_ is not None and open_.tag != tag:
                open_ = open_.parent
            if open_ is not None and open_.parent is not None:
                node = open_.parent
            elif tag == "p" or tag == "br":
                node.children.append(Node(tag, node))
            continue
        if tag in _ENDS_P:
            open_ = node
            while open_ is not None and (open_.tag in PHRASING or open_.tag == "p"):
                if open_.tag == "p":
                    node = open_.parent
                    break
                open_ = open_.parent
        if tag in _CLOSED_BY:
            open_ = node
            while open_ is not None and (open_.tag in _CLOSED_BY[tag] or open_.tag not in _SCOPE):
                if open_.tag in _CLOSED_BY[tag]:
                    node = open_.parent
                    if tag != "tr" or open_.tag == "tr":
                        break
                open_ = open_.parent
        child = Node(tag, node, kind_of(tag, attributes, node))
        node.children.append(child)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, place)
            place = end.end() if end else size
        elif tag not in VOID and not attributes.endswith("/"):
            node = child
    return root


def _bottom_up(root: Node) -> list[Node]:
    """All nodes that count, children before their parents."""
    out, rest = [], [root]
    while rest:
        node = rest.pop()
        out.append(node)
        rest += node.kept()
    return out[::-1]


def measure(root: Node) -> list[Node]:
    """Counts and densities of all nodes that count."""
    nodes = _bottom_up(root)
    for n in nodes:
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        n.density = n.total = 0.0
        for c in n.children:
            if type(c) is str:
                n.chars += len("".join(c.split()))
            elif not c.dropped:
                n.chars += c.chars
                n.tags += c.tags + 1
                n.link_chars += c.link_chars
                n.link_tags += c.link_tags + (c.tag == "a")
        if n.tag == "a":
            n.link_chars = n.chars
    body = next((n for n in reversed(nodes) if n.tag == "body"), root)
    ratio = body.link_chars / body.chars if body.chars else 0.0
    for n in nodes:
        if n.chars:
            tags, links = max(1, n.tags), max(1, n.link_tags)
            linked, plain = max(1, n.link_chars), max(1, n.chars - n.link_chars)
            base = math.log(n.chars / plain * n.link_chars + ratio * n.chars + math.e)
            n.density = n.chars / tags * max(0.0, math.log(max(1.0, n.chars / linked * tags / links)) / base)
        n.total = sum(c.density for c in n.kept() if not c.named)
    return nodes


def holds(node: Node, tags: frozenset[str]) -> bool:
    """Whether an element of one of the names, dropped or not, is below a node."""
    rest = [node]
    while rest:
        for c in rest.pop().children:
            if type(c) is Node:
                if c.tag in tags:
                    return True
                rest.append(c)
    return False


def without_forms(root: Node, nodes: list[Node]) -> list[Node]:
    """The nodes measured again without the forms that are not most of the page."""
    small = [n for n in nodes if n.kind == "form" and 2 * n.chars < root.chars and not holds(n, SECTIONS)]
    for n in small:
        n.dropped = True
    return measure(root) if small else nodes


def _entries(node: Node) -> bool:
    """Whether a node is a list of like entries, each of several parts without a heading, and little else."""
    kept = [c for c in node.kept() if c.chars]
    if len(kept) < 3:
        return False
    like = [c for c in kept if c.tag == kept[-1].tag]
    if len(like) < 3 or kept[-1].tag not in ("div", "li", "article", "section", "blockquote", "dd") or sum(c.chars for c in like) * 5 < node.chars * 4:
        return False
    parts = sum(len([c for c in x.kept() if c.chars]) > 1 for x in like)
    return parts * 5 >= len(like) * 4 and not any(holds(x, HEADINGS) for x in like)


def without_comments(root: Node, nodes: list[Node]) -> None:
    """Names lists of like entries outside of articles as other parts, where a page has a heading and text besides."""
    found, gone, titled, rest = [], 0, False, [root]
    while rest:
        n = rest.pop()
        if n.named or n.tag in ("article", "table"):
            titled = titled or holds(n, HEADINGS)
        elif _entries(n):
            found.append(n)
            gone += n.chars
        else:
            titled = titled or n.tag in HEADINGS
            rest += n.kept()
    if titled and root.chars - gone >= LITTLE:
        for n in found:
            n.named = True
            if n.parent is not None:
                n.parent.total = sum(c.density for c in n.parent.kept() if not c.named)


def _plain(node: Node) -> float:
    """Characters outside links for each tag."""
    return (node.chars - node.link_chars) / max(1, node.tags)


def unnamed(root: Node, nodes: list[Node]) -> list[Node]:
    """The nodes, parents first, outside of elements that their names call another part; all, with their names
    forgotten, if hardly any text would be left."""
    out, rest, gone = [], [root], 0
    while rest:
        node = rest.pop()
        if node.named:
            gone += node.chars
            continue
        out.append(node)
        rest += node.kept()[::-1]
    if gone > 10 * (root.chars - gone) and root.chars - gone < LITTLE:
        for n in nodes:
            n.named = False
            n.total = sum(c.density for c in n.kept())
        return nodes[::-1]
    return out


def _article(best: Node) -> Node:
    """The subtree that holds all sections of the article of which best is dense text."""
    least, found, up = _plain(best) / 2, best, best
    while up.parent is not None and up.tag not in ("body", "article", "main"):
        beside = (c for c in up.parent.kept() if c is not up and not c.named and c.tag not in PHRASING)
        if any(c.chars and c.link_chars * 2 <= c.chars and _plain(c) >= least for c in beside):
            found = up.parent
        up = up.parent
    return up if up.tag == "article" and not _apart(up, found) else found


def _apart(whole: Node, found: Node) -> bool:
    """Whether an <article> holds other articles: it is then a list of them."""
    rest = [whole]
    while rest:
        for c in rest.pop().kept():
            if not c.named and c is not found:
                if c.tag == "article":
                    return True
                rest.append(c)
    return False


def _content(node: Node, threshold: float) -> bool:
    """Whether a child of the article belongs to it by its links: no list of links below the threshold."""
    return node.density >= threshold or node.link_chars * 2 <= node.chars or node.link_tags < 3


def _own_header(node: Node) -> bool:
    """Whether a header outside of articles stands beside the text that it heads: with a heading, without menus."""
    return node.kind == "header" and not node.below and node.parent.tag not in ("body", "html", "#root") and holds(node, HEADINGS) and not holds(node, frozenset(("nav", "form", "ul", "ol")))


def _shown(node: Node, threshold: float, lists: bool) -> list[Node | str]:
    """The children of the article, or of a part of it, that belong to it."""
    out, before = [], ""
    for c in node.children:
        if type(c) is str:
            out.append(c)
            continue
        if c.dropped:
            if _own_header(c):
                out.append(c)
            continue
        if not c.named and (node.tag in PHRASING or c.tag in PHRASING or not c.chars or lists or before in HEADINGS or _content(c, threshold)):
            out.append(c)
        before = c.tag if c.chars else before
    return out


def blocks(node: Node, threshold: float, lists: bool = False) -> list[str]:
    """The texts of the blocks of a subtree in page order. lists: whether lists of links belong to it."""
    out: list[str] = []
    line: list[str] = []

    def flush():
        text = " ".join(entities.unescape("".join(line)).split())
        line.clear()
        if text:
            out.append(text)

    rest: list[Node | str | None] = [node]
    while rest:
        x = rest.pop()
        if x is None:
            flush()
        elif type(x) is str:
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif x.tag in PHRASING:
            rest += _shown(x, threshold, lists)[::-1]
        else:
            flush()
            rest.append(None)
            rest += _shown(x, threshold, lists)[::-1]
    flush()
    return out


def chosen(root: Node) -> tuple[Node | None, float]:
    """The article's subtree, and the threshold of its path to the body."""
    nodes = without_forms(root, measure(root))
    without_comments(root, nodes)
    found = [n for n in unnamed(root, nodes) if n.chars and n.tag not in PHRASING]  # parents first
    articles = [n for n in found if n.tag == "article"]
    if len(articles) == 1 and articles[0].chars >= LITTLE and holds(articles[0], HEADINGS):
        inside = {id(n) for n in _bottom_up(articles[0])}
        found = [n for n in found if id(n) in inside]
    best = None
    for n in found:  # of equal sums the outermost
        if best is None or n.total > best.total:
            best = n
    if best is None:
        return None, 0.0
    best = _article(best)
    threshold, up = best.density, best
    while up is not None and up.tag not in ("body", "#root"):
        threshold = min(threshold, up.density)
        up = up.parent
    return best, threshold


def main_text(page: str | None) -> str:
    """The article's text."""
    best, threshold = chosen(parse(page)) if page else (None, 0.0)
    return "\n".join(blocks(best, threshold, best.tag == "article")) if best is not None else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars of every page."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches):
        for b in batches:
            for k in range(0, len(b), 500):
                part = b.slice(k, 500)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return rows.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint").withColumnsRenamed({"id": id_col, "url": url_col})
