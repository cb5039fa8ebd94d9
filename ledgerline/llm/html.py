"""Main text of web pages by scoring the element tree."""

from __future__ import annotations

import html as entities
import re
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm.base import case, map_rows, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the functions travel with the tasks

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'<>]|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
END_OF_RAW = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in ("script", "style", "textarea", "title", "xmp", "noframes")}

# Names of HTML elements and of common page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong"
    " sub sup time tt u var wbr".split()
)
DROPPED = frozenset(
    "script style noscript template head title nav footer aside form button select option input textarea iframe object embed svg"
    " canvas audio video map menu dialog noframes".split()
)
CLOSES = {  # a start tag of the first kind ends an open element of the second, up to one of the third
    "li": (frozenset(["li"]), frozenset(["ul", "ol"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
P_ENDERS = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main"
    " menu nav ol p pre section table ul center dir".split()
)
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot banner banners breadcrumb breadcrumbs combx comment"
    " comments commentlist community consent cookie cookies cookiebar copyright disqus disclaimer feedback foot footer gdpr header"
    " login masthead menu menus menubar modal nav navbar navigation newsletter notice notices notification outbrain overlay pager"
    " pagination paywall popup promo promotion promoted recommended recommendations related remark replies reply respond responses rss"
    " share sharing shoutbox sidebar sidebars signup skip social sponsor sponsored subscribe subscription taboola tags toolbar"
    " topbar widget widgets alert discussion thread guestbook search searchform form warning".split()
)
DOUBTFUL = frozenset(  # of these, inside an article only parts that are mostly links go
    "alert comment community consent copyright disclaimer discussion feedback foot header notice notices notification overlay promotion"
    " promoted recommended related remark replies reply respond responses search skip social subscription thread warning".split()
)
SIDE_CLASSES = frozenset(  # of these, as classes of a block they are no title and name a side part
    "comment comments consent copyright notice notices notification overlay promoted promotion related replies reply respond responses"
    " social subscription".split()
)
READERS = frozenset("comment comments commentlist replies reply respond responses".split())  # what readers say
CODED = frozenset(  # no title of a section gives an id such a word
    "adsense adslot breadcrumbs combx commentlist cookiebar disqus menubar navbar outbrain searchform shoutbox sidebar sidebars taboola"
    " topbar".split()
)
ABSENT = frozenset("has with no without js".split())  # a name with one of these speaks of another part
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
LIKELY = frozenset("article body content entry hentry main page post story text blog".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl table figure".split())
UNNAMED = HEADINGS | {"html", "body", "main", "article", "p", "pre", "blockquote"}  # their names say nothing about their text

SHORT = 25  # a paragraph with fewer letters passes no points up
DEPTH_SHARE = (1.0, 0.5, 1 / 3)  # of its points for the parent and the next ancestors


class Node:
    __slots__ = ("tag", "parent", "words", "skip", "named", "doubt", "items", "points", "score", "length", "linked")

    def __init__(self, tag: str, parent: Node | None, words: frozenset = frozenset(), skip: bool = False, named: bool = False) -> None:
        self.tag, self.parent, self.words = tag, parent, words
        self.skip, self.named = skip, named  # named: skipped only for its class or id, or as a form
        self.doubt = False  # goes if it is mostly links
        self.items: list = []  # texts and nodes in page order
        self.points = 0.0  # that it passes up as a paragraph
        self.score, self.length, self.linked = 0.0, 0, 0


def _start(tag: str, attributes: str, parent: Node) -> Node:
    skip, named, doubt = tag in DROPPED and tag != "form", tag == "form", False
    tokens: list[tuple[str, str]] = []
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            skip = True
        elif key == "role":
            skip = skip or value in ROLES
        elif key in ("class", "id"):
            tokens += [(key, t) for t in value.split()]
    parts = [(key, frozenset(WORDS.findall(t))) for key, t in tokens]
    if tag not in UNNAMED:
        unlikely = [(key, p & UNLIKELY) for key, p in parts if p & UNLIKELY and not p & ABSENT]
        if unlikely and _inside(parent, ("article", "main")):  # ids are often made of titles there
            sure = any(u & CODED or key == "class" and (u - DOUBTFUL or tag not in INLINE and u & SIDE_CLASSES) for key, u in unlikely)
            sure = sure or tag not in INLINE and any(key == "id" and t in READERS for key, t in tokens)
            named = named or sure
            doubt = not sure and any(u != {"header"} for _, u in unlikely)  # an article's own header holds its title
        else:
            named = named or bool(unlikely)
    if tag == "header" and not _inside(parent, ("article", "main")):
        skip = True
    if tag == "article" and any(p & READERS and not p & ABSENT for _, p in parts):
        named = True  # what a reader says, marked up as an article
    elif tag in ("article", "main") and not _inside(parent, ("article",)):  # what holds the article is no side part, whatever its name
        above: Node | None = parent
        while above is not None:
            above.skip = above.skip and not above.named
            above = above.parent
    node = Node(tag, parent, frozenset().union(*(p for _, p in parts)), skip or named, named and not skip)
    node.doubt = doubt
    return node


def _inside(node: Node | None, tags: tuple[str, ...]) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def parse(page: str) -> Node:
    """Element tree of a page. Wrongly nested or unclosed elements are closed as browsers do, without rebuilding inline ones."""
    root = Node("#root", None)
    node, at, size = root, 0, len(page)
    open_count: dict[str, int] = {}
    while at < size:
        m = MARKUP.search(page, at)
        if m is None:
            node.items.append(page[at:])
            break
        if m.start() > at:
            node.items.append(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0].startswith("<![CDATA["):
                node.items.append(m[0][9:].removesuffix("]]>"))
            continue
        tag, closing = name.lower(), (m[1] or m[4]) == "/"
        if closing:
            if open_count.get(tag):
                while node.tag != tag:
                    open_count[node.tag] -= 1
                    node = node.parent
                open_count[tag] -= 1
                node = node.parent
            elif tag == "p":
                node.items.append(Node("p", node))
            continue
        if tag in P_ENDERS and open_count.get("p"):
            node = _close(node, frozenset(["p"]), frozenset(["table", "td", "th", "button", "object"]), open_count)
        if tag in CLOSES:
            node = _close(node, *CLOSES[tag], open_count)
        child = _start(tag, m[3] if m[2] else m[6], node)
        node.items.append(child)
        if tag in END_OF_RAW:
            end = END_OF_RAW[tag].search(page, at)
            at = end.end() if end else size
        elif tag not in VOID and not ((m[3] or m[6] or "").endswith("/") and tag not in P_ENDERS and tag not in INLINE):
            open_count[tag] = open_count.get(tag, 0) + 1
            node = child
    return root


def _close(node: Node, ends: frozenset, up_to: frozenset, open_count: dict[str, int]) -> Node:
    """Close the nearest open element of ``ends`` unless one of ``up_to`` is nearer."""
    n = node
    while n.parent is not None and n.tag not in up_to:
        if n.tag in ends:
            while node is not n:
                open_count[node.tag] -= 1
                node = node.parent
            open_count[n.tag] -= 1
            return n.parent
        n = n.parent
    return node


def _measure(root: Node) -> list[Node]:
    """Text and link lengths of every node, bottom up; returns the nodes in page order (parents first)."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(x for x in reversed(node.items) if type(x) is Node and not x.skip)
    for node in reversed(order):
        for x in node.items:
            if type(x) is str:
                node.length += len(x) if not x.isspace() else 0
            elif not x.skip:
                node.length += x.length
                node.linked += x.linked
        if node.tag == "a":
            node.linked = node.length
    return order


def _settle(root: Node) -> None:
    """Drop doubtful parts that are mostly links; keep a form that holds most of the text."""
    order, stack = [], [(root, False)]
    forms, doubtful = [], False
    while stack:
        node, hidden = stack.pop()
        order.append(node)
        doubtful = doubtful or node.doubt
        if node.skip and node.named and node.tag == "form" and not hidden:
            forms.append(node)
        stack.extend((x, hidden or node.skip) for x in node.items if type(x) is Node)
    if doubtful:
        _measure(root)
        for node in reversed(order):
            node.skip = node.skip or node.doubt and link_density(node) > 0.5
        _clear(order)
    if forms:
        _measure(root)
        kept = root.length
        for form in forms:
            _measure(form)
        most = max(forms, key=lambda n: n.length)
        if most.length >= SHORT and most.length > kept and link_density(most) <= 0.5:
            most.skip = False
        _clear(order)


def _clear(nodes: list[Node]) -> None:
    for node in nodes:
        node.length = node.linked = 0


def _plain(node: Node) -> str:
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if type(n) is str:
            out.append(n)
        elif not n.skip:
            stack.extend(reversed(n.items))
    return "".join(out)


def link_density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def best_containers(root: Node) -> list[Node]:
    """Score the tree: paragraphs pass points up; the best container and the siblings that belong to it."""
    order = _measure(root)
    candidates: dict[int, Node] = {}
    for node in order:
        direct = node.tag in ("div", "section", "article", "main", "body") and any(type(x) is str and len(x.strip()) >= SHORT for x in node.items)
        if not (node.tag in PARAGRAPHS or direct) or node.length < SHORT:
            continue
        text = "".join(x for x in node.items if type(x) is str) if direct and node.tag not in PARAGRAPHS else _plain(node)
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - link_density(node))
        node.points = points
        up = node if direct and node.tag not in PARAGRAPHS else node.parent
        for share in DEPTH_SHARE:
            while up is not None and up.tag in INLINE:
                up = up.parent
            if up is None or up.tag in ("#root", "html"):
                break
            up.score += points * share
            candidates[id(up)] = up
            up = up.parent
    for node in order:  # what an element's name says about it
        bonus = {"article": 10.0, "main": 10.0, "section": 0.0, "div": 1.0, "body": 0.0}.get(node.tag)
        if bonus is not None and (id(node) in candidates or node.tag in ("article", "main")):
            node.score += bonus + (5.0 if node.words & LIKELY else 0.0)
            candidates[id(node)] = node
    if not candidates:
        body = next((n for n in order if n.tag == "body"), root)
        return [body]
    position = {id(n): i for i, n in enumerate(order)}
    best = max(candidates.values(), key=lambda n: (n.score * (1 - link_density(n)), -position[id(n)]))
    while best.parent is not None and best.tag in PARAGRAPHS | {"tr", "tbody", "ul", "ol", "dl", "table"} and best.parent.tag not in ("#root", "html"):
        best = best.parent  # a cell or list item is part of a container
    points = sum(n.points for n in order)
    while True:
        chosen = _with_siblings(best)
        if _points_below(chosen) > 0.5 * points or best.parent is None or best.parent.tag in ("#root", "html"):
            return chosen
        best = best.parent  # most of what was scored lies outside: the container of the parts


def _points_below(nodes: list[Node]) -> float:
    total, stack = 0.0, [n for n in nodes if type(n) is Node]
    while stack:
        n = stack.pop()
        total += n.points
        stack.extend(x for x in n.items if type(x) is Node and not x.skip)
    return total


def _with_siblings(best: Node) -> list[Node]:
    """The container and the siblings that belong to it, with all that lies between them, as one part of the page."""
    if best.parent is None or best.tag == "body":
        return [best]
    least = 0.2 * best.score * (1 - link_density(best))
    around, kept = best.parent.items, []
    for i, x in enumerate(around):
        if type(x) is not Node or x.skip:
            continue
        own = x.tag == best.tag and x.words == best.words and x.length and link_density(x) < 0.25
        plain = x.tag in PARAGRAPHS | HEADINGS | LISTS and x.length and link_density(x) < 0.25
        if x is best or x.score > 0 and x.score * (1 - link_density(x)) >= least or own or plain:
            kept.append(i)
    part = Node("div", None)
    wanted = set(kept)
    for i in range(kept[0], kept[-1] + 1):  # an unscored block between kept ones goes only if it is mostly links
        x = around[i]
        if i in wanted or type(x) is str or not x.skip and link_density(x) <= 0.5:
            part.items.append(x)
    return [part]


def blocks_of(node: Node) -> list[str]:
    """Texts of the blocks below a node in page order, references decoded, white space as one space."""
    blocks, parts = [], []

    def flush():
        text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if text:
            blocks.append(text)

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif type(x) is str:
            parts.append(x)
        elif x.skip:
            if x.tag not in INLINE:
                flush()
        elif x.tag == "br":
            parts.append(" ")
        elif x.tag in INLINE:
            stack.extend(reversed(x.items))
        else:
            flush()
            stack.append(None)
            stack.extend(reversed(x.items))
    flush()
    return blocks


def main_text(page: str | None) -> str:
    """The article of a page, blocks joined by a blank line; '' for a null or empty page."""
    if not page:
        return ""
    root = parse(page)
    _settle(root)
    return "\n\n".join(b for node in best_containers(root) for b in blocks_of(node))


def extract_main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row. Null and empty pages give an empty text; repeated rows repeat."""

    def extract():
        def work(batch):
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    kinds = [pages.schema[c].dataType.simpleString() for c in (page_id, url)]
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("_html"))
    return map_rows(rows, extract, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")


@case("op8_html_extraction")
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages"))
