"""Main text of web pages by composite text density.

A page is parsed into a tree (tags that HTML lets authors leave open are closed, scripts, styles and comments go). Every
node gets its number of characters, of characters in links, of tags and of tags of links below it; its composite density is

    c / t * log(c / l * t / l_t) to the base ln(l * c / (c - l) + body ratio * c + e)

with c characters, l link characters, t tags, l_t link tags (each at least 1): characters per tag, adjusted for links (Sun,
Song and Liao, 2011). A node's density sum adds its children's densities. The threshold is the least density on the path
from the node of the largest density sum up to the body. Where that node lies in an article element, the extraction takes
the whole outermost such element; else, in the main element or the body around it, it takes in page order the maximum-sum
subtree of every node whose density reaches the threshold (where that is a single block of text, with the blocks of text
beside it). What the page names as menus, headers, footers, sidebars, notices,
adverts, forms or reader comments (by tag, role, class or id) counts in the densities but is never chosen and goes from
inside what is chosen; so does a list of links ahead of all dense text. All other text of the chosen subtrees stays. Of a form
in or around an article, or with most of the page's text, only the controls go.

Blocks are what block-level tags delimit. White space inside a block is one space; blocks are joined by an empty line.

Defined results: null, empty and textless pages give an empty text. Broken markup never fails: what does not parse as a tag
is text, and a quote that never closes is an ordinary character. Repeated rows are extracted each; extra columns are ignored.
Every page is handled by itself, whole, in time and memory in proportion to its size, whatever its tags and their nesting.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup. An unclosed script or style takes the rest of the page, as in browsers; of the others only the tag goes.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CODE = frozenset("script style".split())
#: What browsers do not show of elements that are whole: hidden at their own end tag, so that a missing one hides nothing.
HIDE = frozenset("noscript template canvas audio video object annotation annotation-xml desc metadata defs symbol".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
#: A start tag in the key's set closes an open element of the key, if no element of BARRIER is between.
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption li dd dt legend summary figcaption".split()) | {"li", "dd", "dt"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
P_SCOPE = ("table", "td", "th", "button", "caption", "object")
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}

# What is not the article, by tag, by role, and by words of class and id.
DROP_TAGS = frozenset("nav footer aside button select datalist textarea dialog menu input".split())
#: Dropped or kept by what they hold, see settle().
FORMS = frozenset("form fieldset".split())
CONTROLS = frozenset("input select textarea button".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion promoted"
    " nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager"
    " masthead topbar footer colophon"
    " sidebar aside widget widgets related recommended recommendations"
    " comment comments commentlist respond replies disqus"
    " cookie cookies consent gdpr notice notices popup modal overlay paywall alert"
    " share sharing social newsletter subscribe subscription signup login form skip".split()
)
#: Blocks of an article's text, of which one alone is not yet the article.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
#: Of these tags a class says less: a page's body may well be of class "has-sidebar".
ROOT_TAGS = frozenset("html body".split())
ARTICLE_TAGS = frozenset("main article".split())
ARTICLE_DROP = frozenset("comment comments reply replies ad ads advert advertisement related promo promoted sponsored widget".split())
#: A header is the page's own if it is called no more than that or by one of these words; else it may hold the headline.
PAGE_HEADER = frozenset("header site page main top global".split())

#: What opens markup: a comment, a character data section, a declaration or a tag's name.
_OPEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|[!?]|(/?)([a-zA-Z][^\s/>]*+))", re.S)
#: From a tag's name on: up to its end, to a quote that never closes, or to the end of the page.
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.S)
_SPLIT = re.compile(r"[^a-z0-9]+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "drop", "out", "c", "l", "t", "lt", "density", "total", "top", "holds", "inside")

    def __init__(self, tag, parent, drop=False):
        self.tag, self.parent, self.children, self.drop = tag, parent, [], drop
        self.out = self.holds = self.inside = False
        self.c = self.l = self.t = self.lt = 0
        self.density = self.total = 0.0
        self.top = self


def boilerplate(tag: str, attrs: str) -> bool:
    """Whether the tag or its attributes say that this is not the article."""
    if tag in ROOT_TAGS:
        return False
    if tag in DROP_TAGS:
        return True
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            said = {w for w in _SPLIT.split(_HUMP.sub(" ", value).lower()) if w}
            if tag in FORMS:
                said -= FORMS  # the id of a page's one form may well be "aspnetForm"
            if not said.isdisjoint(ARTICLE_DROP if tag in ARTICLE_TAGS else DROP_WORDS) or "header" in said and said <= PAGE_HEADER:
                return True
        elif name == "role" and value.lower() in DROP_ROLES and not (tag in FORMS and value.lower() == "form"):
            return True
        elif name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?=\s|/|$)", _ATTR.sub(" ", attrs)))


class Stack:
    """The open elements, with the depths at which each tag is open."""

    def __init__(self, root: Node):
        self.nodes, self.depths = [root], {}

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def close(self, depth: int) -> None:
        """Leaves the element at depth and all that is open in it."""
        while len(self.nodes) > depth:
            self.depths[self.nodes.pop().tag].pop()

    def last(self, tag: str) -> int:
        """The depth of the innermost open element of the tag; 0 if there is none."""
        at = self.depths.get(tag)
        return at[-1] if at else 0

    def outermost(self, tags, stop) -> int:
        """The depth of the outermost open element with a tag in tags, below the nearest of stop; 0 if there is none."""
        floor = max(map(self.last, stop))
        found = [at[i] for t in tags if (at := self.depths.get(t)) and (i := bisect_right(at, floor)) < len(at)]
        return min(found, default=0)


def tag_end(page: str, at: int) -> tuple[int, str]:
    """Where the tag whose name ends at ``at`` ends, and its attributes; -1 if it does not end."""
    i = at
    while True:
        i = _REST.match(page, i).end()
        if i >= len(page):
            return -1, ""
        if page[i] == ">":
            return i + 1, page[at:i]
        i += 1  # the equals sign before a quote that never closes: read on behind it
        while page[i].isspace():
            i += 1
        i += 1


def parse(page: str) -> Node:
    """The tree of a page; text nodes are strings, with character references decoded."""
    root = Node("#root", None)
    stack = Stack(root)
    at, n, plain = 0, len(page), False
    endless: set[str] = set()

    def text(s: str) -> None:
        if s:
            stack.nodes[-1].children.append(html.unescape(s) if "&" in s else s)

    def past(mark: str, start: int) -> int:
        end = page.find(mark, start)
        return n if end < 0 else end + len(mark)

    while at < n:
        m = _OPEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        if m[4] is None:
            at = past("-->" if m[1] else "]]>" if m[2] else ">", m.end())
            continue
        at, attrs = (-1, "") if plain else tag_end(page, m.end())
        if at < 0:
            # No end that respects quotes, here or later: from now on a tag ends at the next sign.
            plain = True
            end = page.find(">", m.end())
            if end < 0:
                text(page[m.start() :])
                break
            at, attrs = end + 1, page[m.end() : end]
        tag = m[4].lower()
        if m[3]:
            if depth := stack.last(tag):
                node = stack.nodes[depth]
                node.drop = node.drop or tag in HIDE
                stack.close(depth)
            elif tag == "br":
                stack.nodes[-1].children.append(" ")
            continue
        if tag in RAW:
            if not attrs.rstrip().endswith("/"):
                end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(page, at)
                if not end:
                    endless.add(tag)
                at = end.end() if end else n if tag in CODE else at
            continue
        if tag in ("html", "head", "body") and stack.last(tag):
            continue
        if tag == "body" and (depth := stack.last("head")):
            stack.close(depth)
        if tag in CLOSES_P and stack.last("p") and (depth := stack.outermost(("p",), P_SCOPE)):
            stack.close(depth)
        if tag in SIBLINGS and (depth := stack.outermost(SIBLINGS[tag], SCOPE[tag])):
            stack.close(depth)
        here = stack.nodes[-1]
        if tag in VOID:
            here.children.append(Node(tag, here))
            continue
        node = Node(tag, here, boilerplate(tag, attrs))
        here.children.append(node)
        if not (attrs.endswith("/") and tag not in BLOCK and tag not in ("a", "b", "i", "span")):
            stack.push(node)
    return root


def below(x: Node) -> list[Node]:
    return [y for y in x.children if not isinstance(y, str)]


def walk(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo.extend(reversed(below(x)))
    return out


def settle(nodes: list[Node]) -> None:
    """Drops labels that hold a control, and forms but those in or around an article or with most of the page's text."""
    if not any(x.tag in FORMS or x.tag == "label" for x in nodes):
        return
    inside, chars, holds = {id(nodes[0]): False}, {}, {}
    for x in nodes:
        for y in below(x):
            inside[id(y)] = inside[id(x)] or y.tag in ARTICLE_TAGS and not y.drop
    for x in reversed(nodes):
        parts = [y for y in below(x) if not y.drop and y.tag != "head"]
        chars[id(x)] = sum(len(_SPACE.sub("", y)) for y in x.children if isinstance(y, str)) + sum(chars[id(y)] for y in parts)
        holds[id(x)] = any(y.tag in ARTICLE_TAGS or holds[id(y)] for y in parts)
        if x.tag == "label":
            x.drop = x.drop or any(y.tag in CONTROLS for y in below(x))
    for x in nodes:
        if x.tag in FORMS:
            x.drop = x.drop or not (inside[id(x)] or holds[id(x)] or 2 * chars[id(x)] > chars[id(nodes[0])])


def density(c: int, l: int, t: int, lt: int, ratio: float) -> float:  # noqa: E741
    """Composite text density of a node; ratio: the share of link characters in the body."""
    if not c:
        return 0.0
    t, lt, links = max(t, 1), max(lt, 1), max(l, 1)
    base = math.log(links * c / max(c - links, 1) + ratio * c + math.e)
    return c / t * math.log(max(c / links * t / lt, 1.0)) / math.log(base)


def weigh(nodes: list[Node]) -> None:
    """Counts, densities and density sums of all nodes (parents first); marks what boilerplate holds (out) and what holds or
    lies in articles, and finds the node of the largest sum (top) of each subtree outside boilerplate."""
    for x in nodes:
        x.out = x.out or x.drop or x.tag == "head" or x.tag == "header" and not x.inside
        for y in below(x):
            y.out = x.out
            y.inside = x.inside or x.tag in ARTICLE_TAGS
    for x in reversed(nodes):
        for y in x.children:
            if isinstance(y, str):
                x.c += len(_SPACE.sub("", y))
            elif y.tag != "head":
                x.c, x.l, x.t, x.lt = x.c + y.c, x.l + y.l, x.t + y.t + 1, x.lt + y.lt + (y.tag == "a")
                x.holds = x.holds or y.holds
        x.l = x.c if x.tag == "a" else x.l
        x.holds = x.holds or x.tag in ("h1", "h2")
    ratio = nodes[0].l / max(nodes[0].c, 1)
    for x in reversed(nodes):
        x.density = density(x.c, x.l, x.t, x.lt, ratio)
        inner = [y for y in below(x) if not y.out]
        # A node without children is its own sum.
        x.total = sum(y.density for y in inner) if inner else x.density
        for y in inner:
            if y.top.total > x.top.total:
                x.top = y.top


def chosen(root: Node) -> tuple[list[Node], float]:
    """The subtrees that hold the article, in page order, and the threshold."""
    nodes = walk(root)
    settle(nodes)
    weigh(nodes)
    bodies = [x for x in nodes if x.tag == "body" and x.c]
    scope = bodies[0] if len(bodies) == 1 else root
    best = scope.top
    if best.out or not best.c:
        return [], 0.0
    path = [best]
    while path[-1] is not scope:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    for tag in ("article", "main"):
        if marked := [x for x in path if x.tag == tag]:
            scope = marked[-1]
            break
    if scope.tag == "article":
        return [scope], threshold
    picked: dict[int, Node] = {}
    seen: set = set()
    todo = [scope]
    while todo:
        x = todo.pop()
        if x.out or id(x) in picked:
            continue
        if x.density >= threshold and x.top.c and id(x.top) not in seen:
            seen.add(id(x.top))
            for y in companions(x.top, scope, seen):
                picked[id(y)] = y
        if id(x) not in picked:
            todo.extend(below(x))
    return covering(scope, picked), threshold


def companions(x: Node, scope: Node, seen: set) -> list[Node]:
    """x, or where it is a block of running text or less, that block and the blocks of text beside it (once for a parent)."""
    while x.tag not in BLOCK and x is not scope:
        x = x.parent
    if x.tag not in RUNNING or x is scope or ("beside", id(x.parent)) in seen:
        return [x]
    seen.add(("beside", id(x.parent)))
    return [y for y in below(x.parent) if y is x or y.tag in RUNNING and y.c and not y.out and y.l <= 0.7 * y.c]


def covering(scope: Node, picked: dict[int, Node]) -> list[Node]:
    """The picked nodes that lie in no other one, in page order."""
    out, todo = [], [scope]
    while todo:
        x = todo.pop()
        if id(x) in picked:
            out.append(x)
        else:
            todo.extend(reversed(below(x)))
    return out


def link_list(x: Node) -> bool:
    """Whether a list or a block is little but links."""
    return x.tag in ("ul", "ol", "dl", "div", "section", "table") and x.lt >= 2 and x.l > 0.7 * x.c


def blocks(tops: list[Node], threshold: float) -> list[str]:
    """The text of the subtrees' blocks in page order."""
    out: list[str] = []
    parts: list[str] = []
    begun = any(x.tag == "article" for x in tops)

    def flush() -> None:
        s = _SPACE.sub(" ", "".join(parts)).strip()
        if s:
            out.append(s)
        parts.clear()

    todo: list = [(x, False) for x in reversed(tops)]
    while todo:
        x, end = todo.pop()
        if end:
            flush()
            continue
        if isinstance(x, str):
            parts.append(x)
            continue
        # What comes before all dense text and is little but links is a menu.
        begun = begun or x.tag == "p" and x.density >= threshold and not link_list(x)
        if x.drop or x.tag == "head" or not begun and link_list(x) or x.tag == "header" and not (x.inside and x.holds):
            if x.tag in BLOCK:
                flush()
            continue
        if x.tag in ("br", "wbr", "img"):
            parts.append(" " if x.tag == "br" else "")
            continue
        if x.tag in BLOCK:
            flush()
            todo.append((x, True))
        todo.extend((y, False) for y in reversed(x.children))
    flush()
    return out


def extract(page: str | None) -> str:
    if not page or not page.strip():
        return ""
    return "\n\n".join(blocks(*chosen(parse(page))))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    kind = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(_run, f"page_id {kind['page_id']}, url string, text string, n_chars long")
