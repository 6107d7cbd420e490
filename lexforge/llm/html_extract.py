"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Every paragraph gives points to its ancestors, one
for being there, one for each comma and up to three for its length, whole to the parent,
half to the next ancestor and a third of that onwards; a container's points are then
discounted by the share of its text that stands in links. The container with the most
points is kept with its siblings and those of its ancestors: titles, leads, sections,
lists, tables and captions in page order, all but what is mostly links, and short bare
elements at the ends that hold no paragraph. An article or main element is kept as it is.
Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
are left out wherever they stand, by element, role, class or id; a class or id alone
does not remove an element that holds most of the text (a wrapper named after its layout),
nor does a form that holds it, nor the class of an article's own title block, nor, inside an
article, that of a single paragraph unless it names an advert. An article's own header is
part of it. A malformed
declaration is read over; a comment that never ends goes to the end of the page.

Text: character references are decoded, white space inside a block is one space, blocks
are trimmed and joined in page order by one newline; nothing else is dropped or capped.
A page with null or empty html, or without text, has an empty text. Trees are walked
without recursion, so depth has no limit. Repeated rows give repeated results, extra
columns are ignored, and null page_id or url stay null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose content is never text of the article.
DROPPED = {"script", "style", "noscript", "template", "head", "title", "nav", "header", "footer", "aside", "button", "select", "option", "textarea", "input", "label", "iframe", "object", "embed", "svg", "canvas", "menu", "dialog"}
#: Elements that begin and end a block of text.
BLOCK = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "legend", "li", "main", "ol", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "header", "footer", "nav", "aside", "form", "hgroup",
}
#: An opening tag of the key's kind closes an open element of these kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: An implied end tag does not look beyond these.
FENCE = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "td", "th", "select", "blockquote"}
CHROME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner\w*|promo\w*|sponsor\w*|nav|navbar|navigation|menu\w*|breadcrumb\w*|header|masthead|footer|sidebar\w*|side|rail|widget\w*|cookie\w*|consent|gdpr|notice\w*|alert\w*|popup|modal|overlay|newsletter|subscribe|signup|login"
    r"|share|sharing|social|related|recommend\w*|comment\w*|disqus|respond|replies|reply|pagination|pager|skip|toolbar|copyright|legal|disclaimer)(?=$|[\s_-])",
    re.I,
)
#: Words of CHROME that a wrapper's class may hold to say how the page is laid out.
LAYOUT = re.compile(r"nav|navbar|navigation|menu\w*|breadcrumb\w*|header|masthead|footer|sidebar\w*|side|rail|widget\w*|banner\w*|toolbar", re.I)
#: Class names of the block that holds an article's own title.
TITLE_BLOCK = re.compile(r"(?:article|content|entry|post|story)[_-]+(?:header|heading|title)(?=$|[\s_-])", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
FAVOURED = re.compile(r"article|body|content|entry|main|post|story|text", re.I)
#: A tag that the end of the page cuts off.
CUT_OFF = re.compile(r"<[A-Za-z/!?][^<>]*\Z")
#: A numeric reference of more digits than int() takes.
LONG_NUMBER = re.compile(r"&#(\d{20,});?")
#: Class names that remove a single paragraph inside an article too.
ADVERT = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|promo\w*|sponsor\w*|newsletter|subscribe|signup|cookie\w*|consent|gdpr|share|sharing)(?=$|[\s_-])", re.I)
PARAGRAPH = {"p", "pre", "td", "blockquote", "h1", "h2", "h3", "li", "dd"}
#: What shows that an element holds text to be read, whatever its length.
PROSE = PARAGRAPH | {"h4", "h5", "h6", "dt", "th", "figcaption", "caption", "summary", "address"}
#: What is a menu within the container where it holds nothing but links.
LISTS = {"ul", "ol", "dl", "div", "section", "table"}
#: Share of its text in links from which a sibling is a menu.
MENU_SHARE = 0.5


class Node:
    __slots__ = ("tag", "parent", "children", "chrome", "score", "chars", "link_chars", "favour", "named")

    def __init__(self, tag: str, parent: Node | None, chrome: bool = False, favour: bool = False):
        self.tag, self.parent, self.chrome, self.favour = tag, parent, chrome, favour
        self.children: list[Node | str] = []
        self.named = 0  # chrome by class or id: 1 by words that layouts bear too, 2 by others
        self.score = 0.0
        self.chars = self.link_chars = 0


class TreeBuilder(HTMLParser):
    """Nested elements from tags that may be unclosed, misplaced or cut off."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None)
        self.ending = False
        self.depth: dict[str, int] = {}

    def _open(self, node: Node) -> None:
        self.at.children.append(node)
        self.at = node
        self.depth[node.tag] = self.depth.get(node.tag, 0) + 1

    def _close_to(self, node: Node) -> None:
        """Close `node` and all that is open inside it."""
        while True:
            self.depth[self.at.tag] -= 1
            done = self.at is node
            self.at = self.at.parent
            if done:
                return

    def _implied_end(self, kinds: set[str]) -> None:
        if not any(self.depth.get(k) for k in kinds):
            return
        node = self.at
        while node.parent is not None and node.tag not in kinds:
            if node.tag in FENCE:
                return
            node = node.parent
        if node.parent is not None:
            self._close_to(node)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK and self.depth.get("p"):
            self._implied_end({"p"})
        if tag in CLOSES:
            self._implied_end(CLOSES[tag])
        inside = bool(self.depth.get("article") or self.depth.get("main"))
        chrome, favour = tag in DROPPED and not (tag == "header" and inside), tag in ("article", "main")
        # a form may wrap the whole page, so it is judged by what it holds, as layout names are
        named = 1 if tag == "form" else 0
        for name, value in attrs:
            if not value:
                chrome = chrome or name == "hidden"
            elif name in ("class", "id"):
                if tag not in ("html", "body", "article", "main") and (not inside or tag not in PROSE or ADVERT.search(value)):
                    named = max([named, *(1 if LAYOUT.fullmatch(m.strip(" \t\r\n_-")) else 2 for m in CHROME.findall(TITLE_BLOCK.sub(" ", value)))])
                favour = favour or bool(FAVOURED.search(value))
            elif name == "role":
                chrome, favour = chrome or value.lower() in ROLES, favour or value.lower() in ("main", "article")
            elif name == "aria-hidden":
                chrome = chrome or value.lower() == "true"
            elif name == "style":
                chrome = chrome or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        node = Node(tag, self.at, chrome or named > 0, favour)
        node.named = 0 if chrome else named
        if tag in VOID:
            self.at.children.append(node)
        else:
            self._open(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.at.children.append(Node(tag, self.at))
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.depth.get(tag) and tag not in VOID:
            node = self.at
            while node.tag != tag:
                node = node.parent
            self._close_to(node)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def parse_comment(self, i: int, report: bool = True) -> int:
        end = super().parse_comment(i, report)
        return len(self.rawdata) if end < 0 and self.ending else end  # one that never ends goes to the end of the page

    def parse_html_declaration(self, i: int) -> int:
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # a malformed marked section is a bogus comment, as in browsers
            return self.parse_bogus_comment(i)

    def unknown_decl(self, data: str) -> None:
        if data.startswith("CDATA["):
            self.at.children.append(data[6:])


def _parse(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(LONG_NUMBER.sub(lambda m: f"&#{(m[1].lstrip('0') or '0')[:20]};", CUT_OFF.sub("", html)))
    builder.ending = True
    builder.close()
    keep_wrappers(builder.root)
    return builder.root


def keep_wrappers(root: Node) -> None:
    """Let elements that are chrome by name only stand where they hold most of the text outside links (all of it, if the name is no layout's)."""
    order, stack, wanted = [], [root], False
    while stack:
        node = stack.pop()
        order.append(node)
        wanted = wanted or node.named > 0
        stack.extend(x for x in node.children if isinstance(x, Node) and (not x.chrome or x.named))
    if not wanted:
        return
    held: dict[int, int] = {}
    for node in reversed(order):
        own = 0 if node.tag == "a" else sum(len("".join(x.split())) for x in node.children if isinstance(x, str))
        held[id(node)] = own + (0 if node.tag == "a" else sum(held.get(id(x), 0) for x in node.children if isinstance(x, Node)))
    scopes = [(root, held[id(root)])]
    while scopes:
        node, total = scopes.pop()
        for x in node.children:
            if isinstance(x, Node) and id(x) in held:
                if x.named:
                    most = held[id(x)]
                    x.chrome = not (most * 2 > total if x.named == 1 else most == total > 0)
                if not x.chrome:
                    scopes.append((x, held[id(x)] if x.named else total))


def _in_order(root: Node) -> list[Node]:
    """Elements outside page chrome, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(x for x in reversed(node.children) if isinstance(x, Node) and not x.chrome)
    return out


def best_containers(root: Node) -> list[Node]:
    """The container with the most points, with siblings that belong to it, in page order."""
    nodes = _in_order(root)
    commas: dict[int, int] = {}
    for node in reversed(nodes):
        text = "".join(x for x in node.children if isinstance(x, str))
        node.chars += len(" ".join(text.split()))
        commas[id(node)] = commas.get(id(node), 0) + text.count(",") + text.count("、") + text.count("，")
        if node.tag == "a":
            node.link_chars = node.chars
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.link_chars += node.link_chars
            commas[id(up)] = commas.get(id(up), 0) + commas[id(node)]
    for node in nodes:
        loose = node.tag in ("div", "section", "article", "main", "body", "#root") and sum(len(x.strip()) for x in node.children if isinstance(x, str)) >= 25
        if (node.tag in PARAGRAPH and node.chars >= 25) or loose:
            points = (1 + commas[id(node)] + min(node.chars / 100, 3)) * (1 - node.link_chars / max(node.chars, 1))
            up, share = (node, 1.0) if loose and node.tag not in PARAGRAPH else (node.parent, 1.0)
            level = 1
            while up is not None and points * share > 1e-6:
                up.score += points * share
                level += 1
                share = 1 / 2 if level == 2 else 1 / (3 * level)
                up = up.parent
    best, most = None, 0.0
    for node in nodes:
        if node.tag in ("p", "a", "b", "span", "html", "#root") and node.parent is not None and node.tag != "html":
            continue
        value = node.score * (1 - node.link_chars / max(node.chars, 1)) * (1.25 if node.favour else 1)
        if value > most:
            best, most = node, value
    if best is None:  # too little text for a paragraph: the page's article, else all of it
        return [next((n for n in nodes if n.tag in ("article", "main")), root)]
    return [with_siblings(best)]


def belongs(x: Node) -> bool:
    """Is an element beside the container one to be read: a paragraph, a heading, or holding one or enough text, and no menu?"""
    if not x.chars or x.link_chars >= MENU_SHARE * x.chars:
        return False
    return x.tag in PROSE or x.chars >= 25 or any(n.tag in PROSE and n.chars for n in _in_order(x))


def cut_down(up: Node, node: Node | None) -> None:
    """Keep of an element's children the node and what belongs beside it, and all between the first and the last of these but menus."""
    part = [isinstance(x, str) or x is node or (not x.chrome and belongs(x)) for x in up.children]
    if not any(part):
        return
    first, last = part.index(True), len(part) - part[::-1].index(True) - 1
    for i, x in enumerate(up.children):
        if not part[i] and not x.chrome:
            part[i] = (first < i < last or x.tag not in BLOCK) and x.link_chars < max(1, MENU_SHARE * x.chars)
    up.children = [x for x, ok in zip(up.children, part, strict=True) if ok]


def with_siblings(best: Node) -> Node:
    """The container's topmost ancestor, cut down at each level; an article or main element is all of it, and so is a page that is no more than the container."""
    node = best
    if node.tag in ("body", "html"):
        cut_down(node, None)
    elif node.tag not in ("article", "main"):
        node.children = [x for x in node.children if isinstance(x, str) or x.tag not in LISTS or not x.chars or x.link_chars < 0.9 * x.chars]
    while node.parent is not None and node.tag not in ("article", "main", "body", "html"):
        cut_down(node.parent, node)
        node = node.parent
    return node


def text_of(nodes: list[Node]) -> str:
    """The blocks below the nodes, in page order."""
    blocks: list[str] = []
    piece: list[str] = []

    def end() -> None:
        joined = " ".join("".join(piece).split())
        piece.clear()
        if joined:
            blocks.append(joined)

    for top in nodes:
        end()
        stack: list[Node | str | None] = [top]
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                piece.append(x)
            elif not x.chrome:
                if x.tag == "br":
                    piece.append(" ")
                if x.tag in BLOCK:
                    end()
                    stack.append(None)
                stack.extend(reversed(x.children))
        end()
    return "\n".join(blocks)


def main_text(html: str | None) -> str:
    return text_of(best_containers(_parse(html))) if html else ""


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            b = batch.slice(at, 256)
            texts = [main_text(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def html_extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages(page_id, url, html). No shuffle."""
    rows = pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "cast(html as string) as html")
    return rows.mapInArrow(_map, "page_id long, url string, text string, n_chars long")
