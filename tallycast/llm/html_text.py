"""Main text of HTML pages by tree scoring: paragraphs pass points to ancestors, the best container is kept."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallycast.llm.queries import query, table

TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")  # a name, and its value with it
HINT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

RAW = frozenset("script style noscript template iframe textarea xmp noembed noframes svg math title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
DROPPED = frozenset("nav header footer aside button select option dialog menu head object embed canvas audio video input datalist".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
HINTS = {  # words of a class or id that speak against an element, by what it then is
    word: kind
    for kind, words in {
        "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion sidebar aside widget",
        "notice": "notice notices cookie cookies consent gdpr popup modal overlay",
        "comment": "comment comments commentlist disqus respond reply replies",
        "form": "newsletter subscribe signup login form",
        "menu": "nav navbar navigation menu breadcrumb breadcrumbs share sharing social related recommended pagination pager toolbar",
        "frame": "header masthead footer banner",
    }.items()
    for word in words.split()
}
STRENGTH = ("advert", "notice", "comment", "form", "menu", "frame")
# words that may stand beside those in one class without changing what the element is
NEUTRAL = frozenset(
    "container wrapper wrap box block list area section inner outer item items bar button buttons links link panel top bottom left right main site page "
    "global primary secondary slot unit module group row col column".split()
)
MAIN = frozenset(("article", "main"))
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre section summary table ul li dd dt td th tr tbody thead".split()
)
CLOSES = {  # start tag: open elements it ends, and elements beyond which none is looked for
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
PARAGRAPHS = frozenset("p pre li dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
LEAST_LENGTH = 25  # of a paragraph that earns points
LEVELS = (1.0, 2.0, 6.0, 9.0, 12.0)  # divisors of the points for the parent, the grandparent and so on
MAIN_POINTS = 25.0
SIBLING_SHARE = 0.2
WRAPPER_SHARE = 0.5  # of a page's text outside links: a hinted element or form that holds so much is not dropped
HINTED = 0.75  # of its points that such an element keeps
PASSED = {"menu": 0.25, "frame": 0.25}  # of points that leave any other hinted element for those around it; else none
LINKED = 1 / 3  # link density from which an element hinted as a menu is one
PASSAGE = 80  # characters outside links of a block that makes a hinted menu or frame part of the text
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("tag", "parent", "items", "drop", "hint", "main", "block", "link", "length", "linked", "own", "longest", "commas", "points")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.items = tag, parent, []
        self.drop = self.main = False
        self.hint = ""
        self.block = self if parent is None or tag not in INLINE else parent.block
        self.link = tag == "a" or (parent is not None and parent.link and tag in INLINE)
        self.length = self.linked = self.own = self.longest = self.commas = 0
        self.points = 0.0


def kind_of(names: str) -> str:
    """What the classes or the id of an element make it: a menu, an advert and so on, or nothing.

    A name counts only as a whole: each of its words has to be a hint or neutral, so ``ad``, ``cookie-banner`` and
    ``siteFooter`` count, ``has-sidebar``, ``market-share`` and ``header2text`` do not.
    """
    found = set()
    for name in names.split():
        words = [w.lower() for w in HINT.findall(name)]
        if all(w in HINTS or w in NEUTRAL or w.isdigit() for w in words):
            found.update(HINTS[w] for w in words if w in HINTS)
    return next((kind for kind in STRENGTH if kind in found), "")


def _hints(node: Node, attributes: str) -> None:
    seen = set()
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), unescape(value.strip("\"'") if value[:1] in "\"'" else value).strip()
        if name in seen:  # the first of equal names counts
            continue
        seen.add(name)
        if name in ("class", "id"):
            if node.tag not in ("html", "body", "article", "main") or name == "class" and node.tag == "article":
                kind = kind_of(value)
                if node.tag != "article" or kind == "comment":
                    node.hint = min((k for k in (node.hint, kind) if k), key=STRENGTH.index, default="")
        elif name == "role":
            node.drop |= value.lower() in DROPPED_ROLES
            node.hint = node.hint or ("form" if value.lower() == "form" else "")
            node.main |= value.lower() in ("main", "article")
        elif name == "itemprop":
            node.main |= value.lower() == "articlebody"
        elif name == "hidden":
            node.drop = True
        elif name == "aria-hidden":
            node.drop |= value.lower() == "true"
        elif name == "style":
            node.drop |= "display:none" in "".join(value.split()).lower()


def parse(html: str) -> list[Node]:
    """All elements in page order, the root first; unclosed and wrongly nested tags are mended, raw text is left out."""
    root = Node("html", None)
    nodes, here, at = [root], root, 0
    while True:
        match = TOKEN.search(html, at)
        text = html[at : match.start()] if match else html[at:]
        if text:
            here.items.append(unescape(text) if "&" in text else text)
        if not match:
            return nodes
        at = match.end()
        tag = match[2] or match[5]
        if not tag:
            if match[0].startswith("<![CDATA["):
                here.items.append(match[0][9:-3])
            continue
        tag = tag.lower()
        if match[1] or match[4]:
            up = here
            while up is not None and up.tag != tag:
                if tag in INLINE and up.tag not in INLINE:  # a stray inline end tag ends no block
                    up = None
                    break
                up = up.parent
            if up is not None and up.parent is not None:
                here = up.parent
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag == "html":
            continue
        ends, stops = CLOSES.get(tag, (None, None))
        if ends:
            up, last = here, None
            while up is not None and up.tag not in stops:
                if up.tag in ends:
                    last = up
                up = up.parent
            if last is not None:
                here = last.parent
        if tag in CLOSES_P:
            up = here
            while up is not None and up.tag in INLINE:
                up = up.parent
            if up is not None and up.tag == "p":
                here = up.parent
        node = Node(tag, here)
        node.drop, node.hint, node.main = tag in DROPPED, "form" if tag == "form" else "", tag in MAIN
        attributes = match[3] or match[6]
        if attributes and not attributes.isspace():
            _hints(node, attributes)
        here.items.append(node)
        nodes.append(node)
        if tag not in VOID and not (attributes or "").endswith("/"):
            here = node


def _wrappers(nodes: list[Node], holds: set[Node]) -> set[Node]:
    """Hinted elements that hold at least ``WRAPPER_SHARE`` of the text outside links and dropped parts."""
    if not any(node.hint for node in nodes):
        return set()
    gone, sizes = set(), {}
    for node in nodes:
        if node.parent in gone or node.drop and node not in holds:
            gone.add(node)
        elif not node.link:
            sizes[node] = sum(len(item.strip()) for item in node.items if isinstance(item, str))
    for node in reversed(nodes):
        if node.parent is not None and node in sizes:
            sizes[node.parent] = sizes.get(node.parent, 0) + sizes[node]
    least = max(1, WRAPPER_SHARE * sizes.get(nodes[0], 0))
    return {node for node in nodes if node.hint and sizes.get(node, 0) >= least}


def _measure(nodes: list[Node]) -> None:
    """Settle which parts cannot be text and add up lengths: of all text, of link text, and of each block's own text.

    Hints of wrappers and of elements that hold an article are cleared to a lesser weight (``"wrapper"``) or to none.
    """
    holds = set()
    for node in reversed(nodes):  # children before parents
        if node.parent is not None and (node in holds or node.main and not node.drop and not node.hint):
            holds.add(node.parent)
    wrappers = _wrappers(nodes, holds)
    for node in nodes:
        node.drop = node.parent is not None and (node.parent.drop or node.drop and node not in holds)
        if node in holds or node in wrappers:
            node.hint = "wrapper" if node.hint else ""
        elif node.tag in HEADINGS and node.hint == "frame" or node.hint in ("frame", "menu") and node.tag in ("p", "li", "blockquote", "pre"):
            node.hint = ""
        if node.drop:
            continue
        for item in node.items:
            if isinstance(item, str) and not item.isspace():
                size = len(item.strip())
                node.length += size
                node.linked += size if node.link else 0
                node.block.own += 0 if node.link else size
                node.block.commas += item.count(",") + item.count("、") + item.count("，") + item.count("،")
    for node in reversed(nodes):
        node.longest = max(node.longest, node.own)
        if node.parent is not None and not node.drop:
            node.parent.length += node.length
            node.parent.linked += node.linked
            node.parent.longest = max(node.parent.longest, node.longest)


def _is_apart(node: Node) -> bool:
    """Whether a hinted element, once the text is found, turns out to be a menu, advert, form, notice, frame or comment."""
    if node.hint in ("", "wrapper"):
        return False
    if node.hint in PASSED and node.longest >= PASSAGE:
        return node.hint == "menu" and node.linked >= LINKED * node.length
    return True


def _worth(node: Node) -> float:
    return node.points * (1.0 - node.linked / node.length) if node.length else 0.0


def _kept(nodes: list[Node]) -> list[Node]:
    for node in nodes:
        if node.drop or node.own < LEAST_LENGTH or node.block is not node:
            continue
        points = 1.0 + node.commas + min(node.own // 100, 3)
        up = node.parent if node.tag in PARAGRAPHS and node.parent is not None else node
        inside, weight = node, 1.0
        for divisor in LEVELS:
            while inside is not up:
                weight *= PASSED.get(inside.hint, 0.0) if inside.hint not in ("", "wrapper") else 1.0
                inside = inside.parent
            up.points += weight * points / divisor
            up = up.parent
            if up is None:
                break
    alive = [n for n in nodes if not n.drop and n.length and n.tag not in INLINE and n.tag not in PARAGRAPHS]
    for node in alive:
        if node.main:
            node.points += MAIN_POINTS
        if node.hint:
            node.points *= HINTED if node.hint == "wrapper" else PASSED.get(node.hint, 0.0)
    if not alive:
        return []
    best = max(alive, key=_worth)  # of equals the first in the page
    if not _worth(best):
        return [nodes[0]]
    up = best
    while up is not None and not up.main:
        up = up.parent
    best = up or best
    if best.parent is None:
        return [best]
    least = max(10.0, SIBLING_SHARE * _worth(best))

    def joins(node: Node) -> bool:
        if node is best:
            return True
        if node.drop or node.tag in INLINE or not node.length or _is_apart(node):
            return False
        if node.tag == "p":
            density = node.linked / node.length
            return density < 0.25 if node.length > 80 else density == 0 and node.length >= LEAST_LENGTH
        return _worth(node) >= least

    return [item for item in best.parent.items if isinstance(item, Node) and joins(item)]


def _text(kept: list[Node]) -> str:
    blocks, line, stack, best = [], [], list(reversed(kept)), set(kept)

    def flush() -> None:
        words = "".join(line).split()
        line.clear()
        if words:
            blocks.append(" ".join(words))

    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            line.append(item)
        elif item.tag == "br":
            line.append(" ")
        elif not item.drop and (item in best or not _is_apart(item)):
            if item.block is item:
                flush()
                stack.append(None)
            stack.extend(reversed(item.items))
    flush()
    return "\n".join(blocks)


def main_text(html: str | None) -> str:
    """Blocks of the main text in page order, joined by a newline; white space inside a block is one space.

    A class, an id or a form speaks against an element (:func:`kind_of`): fewer of its points, or none, reach the elements
    around it, and it is left out of the text that is found, unless it holds half of the page's text or, where it is
    said to be a menu or a header, a passage outside links.  If nothing is left, the page is scored without these
    hints.  Null and empty pages, and pages without text outside dropped parts (menus, footers, hidden elements and the
    like, by tag, role or attribute), give the empty string.
    """
    if not html or html.isspace():
        return ""
    nodes = parse(html)
    hinted = any(node.hint for node in nodes)
    _measure(nodes)
    text = _text(_kept(nodes))
    if not text and hinted:
        nodes = parse(html)
        for node in nodes:
            node.hint = ""
        _measure(nodes)
        text = _text(_kept(nodes))
    return text


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per row of ``pages`` (page_id, url, html), without a shuffle.

    Equal pages give equal texts, whole texts are read and kept whole, null ids and addresses are passed on, repeated
    rows stay repeated, other columns are not read, and no rows give no rows.
    """
    chosen = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            counts = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), counts], ["page_id", "url", "text", "n_chars"])

    kind = chosen.schema["page_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")


@query("op8_html_main_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
