"""Main text of a web page by tree scoring.

The markup becomes a tree; menus, notices, adverts, forms, comments and the like are cut off it. Paragraphs then
pass points for their length and their commas to their ancestors, less with each level and none beyond FADED of them;
an ancestor's points are discounted by the share of its text that is in links. The container with most points is kept, widened to the
article around it if there is one, together with siblings that have enough points or a whole paragraph.

Words of a class or id only suggest what is to be cut. A class such as with-sidebar tells what an element has, not what
it is, and marks nothing. On a page without an article or main, an element marked by such words stays if it holds over
half of the page's unlinked paragraph text and hardly any of it (LEAST_SEEN) would be left without it; if none at all
would be left, all such elements stay.

Defined results: null, empty or text-free html gives ''; markup that never closes is closed where the page ends;
rows with a null id or repeated rows are each extracted; an empty table gives an empty result; very long pages are
read whole, in time in proportion to their length; other columns are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lucerna.llm.common import slices

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea select title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
#: An element that ends an open one of the first set, unless one of the second set stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "body": ({"head"}, set()),
}
#: Tags that change what an ENDS tag ends.
SCOPED = frozenset().union(*(ended | border for ended, border in ENDS.values()))
CUT_TAGS = frozenset("head nav footer aside form button menu dialog label fieldset".split())
CUT_ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog menu menubar form".split())
#: Words in a class or id that mark what isn't the article.
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside widget comment comments "
    "commentlist reply replies respond disqus cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended breadcrumb breadcrumbs pagination pager menu nav navbar navigation "
    "footer masthead toolbar skip disclaimer paywall toc".split()
)
HEADER_WORDS = frozenset("header topbar".split())
#: A class or id that begins with one of these tells what an element has or lacks.
HAS_WORDS = frozenset("with has have no without hide show".split())
KEEP_TAGS = frozenset("html body article main".split())
CONTAINER_POINTS = {"article": 30.0, "main": 20.0, "section": 5.0, "div": 5.0, "td": 3.0, "blockquote": 3.0, "pre": 3.0, "ol": -3.0, "ul": -3.0, "dl": -3.0}
CONTENT_WORDS = frozenset("article articlebody body content entry main page post story text blog".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd div section article main body figcaption".split())
LEAST_PARAGRAPH, SIBLING_SHARE, SIBLING_LEAST, LONG_PARAGRAPH = 25, 0.2, 10.0, 80
#: The least share of the unlinked paragraph text that cuts by class or id should leave.
LEAST_SEEN = 0.1
#: Levels above which a paragraph's points have faded.
FADED = 50

_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>""")
_HEAD = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)")
_LONG_NUMBER = re.compile(r"&#([0-9]{1000,});?")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    __slots__ = ("tag", "parent", "children", "words", "marks", "cut", "points", "text", "link", "holds_main", "order", "block", "scope", "inside")

    def __init__(self, tag: str, parent: "Node | None", attributes: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        self.points, self.text, self.link, self.holds_main, self.order = 0.0, 0, 0, False, 0
        self.words, self.marks, self.cut = frozenset(), frozenset(), tag in CUT_TAGS
        # what would take a climb to find: the nearest block, what an ENDS tag ends here, the article or main around
        self.block = self if tag in BLOCK or parent is None else parent.block
        self.scope = {} if parent is None else _scope(self, parent.scope) if tag in SCOPED else parent.scope
        self.inside = None if parent is None else parent if parent.tag in ("article", "main") else parent.inside
        if attributes:
            self._read(attributes)

    def _read(self, attributes: str) -> None:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                names = [_SPLIT.split(v) for v in value.split()]
                self.words |= frozenset(w for n in names for w in n)
                self.marks |= frozenset(w for n in names if n[0] not in HAS_WORDS for w in n)
            elif name == "role":
                self.cut |= value in CUT_ROLES
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                self.cut = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                self.cut = True


def _scope(node: Node, outer: dict[str, Node]) -> dict[str, Node]:
    """For each tag of ENDS the outermost element that it ends within node, up to what stands between."""
    out = {}
    for tag, (ended, border) in ENDS.items():
        if node.tag not in border:
            found = outer.get(tag) or (node if node.tag in ended else None)
            if found:
                out[tag] = found
    return out


class Tags:
    """The tags of a page, found in time in proportion to its length, also where quotes or tags never close."""

    def __init__(self, page: str):
        self.page = page
        self.stops: list[int] | None = None

    def at(self, start: int) -> tuple[str, str, str, int] | None:
        """Slash, name, attributes and end of the tag that starts there, if one does."""
        if self.stops is None:
            m = _TAG.match(self.page, start)
            if m:
                return m[1], m[2], m[3], m.end()
            if not _HEAD.match(self.page, start):
                return None
            # a tag that doesn't close: from here on places of quotes and > are looked up, never searched for again
            self.stops = [m.start() for m in re.finditer("[\"'>]", self.page[start:])]
            self.stops = [start + k for k in self.stops]
            self.again, last = [0] * len(self.stops), {}
            for k in range(len(self.stops) - 1, -1, -1):
                quote = self.page[self.stops[k]]
                self.again[k] = last.get(quote, -1)
                last[quote] = k
            self.lost: set[int] = set()
        head = _HEAD.match(self.page, start)
        if not head:
            return None
        k, opened = bisect_left(self.stops, head.end()), []
        while 0 <= k < len(self.stops) and k not in self.lost:
            if self.page[self.stops[k]] == ">":
                end = self.stops[k]
                return head[1], head[2], self.page[head.end() : end], end + 1
            opened.append(k)
            k = self.again[k] + 1 if self.again[k] >= 0 else -1
        self.lost.update(opened)
        return None


def _raw_end(page: str, tag: str, here: int) -> int:
    """Behind the end tag of an element whose content is no markup."""
    close = re.compile(rf"</{tag}\b", re.I).search(page, here)
    end = page.find(">", close.end()) if close else -1
    return end + 1 if end >= 0 else len(page)


def parse(page: str) -> Node:
    at = root = Node("html", None)
    here = text = 0
    tags, open_ = Tags(page), Counter()

    def close(upto: Node) -> Node:
        """Leaves all elements up to this one, too."""
        node = at
        while node is not upto:
            open_[node.tag] -= 1
            node = node.parent
        open_[upto.tag] -= 1
        return upto.parent

    while (here := page.find("<", here)) >= 0:
        second = page[here + 1 : here + 2]
        if second == "!" or second == "?":
            mark = "-->" if page.startswith("<!--", here) else ">"
            end = page.find(mark, here + (4 if mark == "-->" else 2))
            found, end = ("", "", "", 0), len(page) if end < 0 else end + len(mark)
        else:
            found = tags.at(here) if second == "/" or second.isalpha() else None
            end = found[3] if found else 0
        if not found:
            here += 1
            continue
        if here > text:
            at.children.append(page[text:here])
        here = text = end
        slash, tag, attributes = found[0], found[1].lower(), found[2]
        if not tag or (tag == "html" and not slash):
            continue
        if slash:
            if open_[tag] > 0:
                node = at
                while node.tag != tag:
                    node = node.parent
                at = close(node)
            elif tag == "p":
                at.children.append(Node("p", at))
            continue
        closed = attributes.rstrip().endswith("/")
        if tag in RAW:
            if not closed:
                here = text = _raw_end(page, tag, here)
            continue
        if tag in CLOSES_P and at.block.tag == "p":
            at = close(at.block)
        if tag in ENDS and tag in at.scope:
            at = close(at.scope[tag])
        child = Node(tag, at, attributes)
        at.children.append(child)
        if tag not in VOID and not (closed and tag not in BLOCK and tag != "a"):
            at = child
            open_[tag] += 1
    if text < len(page):
        at.children.append(page[text:])
    return root


def _walk(root: Node) -> list[Node]:
    """All nodes not cut off, parents first, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        node.order = len(out)
        out.append(node)
        stack += [c for c in reversed(node.children) if not isinstance(c, str) and not c.cut]
    return out


def _cut(root: Node) -> None:
    every, stack = [], [root]
    while stack:
        node = stack.pop()
        every.append(node)
        stack += [c for c in node.children if not isinstance(c, str)]
    for node in reversed(every):
        if node.parent and (node.holds_main or node.tag in ("article", "main")):
            node.parent.holds_main = True
    marked = []
    for node in every:
        inside = node.inside
        if node.tag == "header" and not inside:
            node.cut = True
        if not node.cut and (node.marks & CUT_WORDS or (not inside and node.marks & HEADER_WORDS)):
            node.cut = True
            marked.append(node)
        if node.tag in KEEP_TAGS or node.holds_main:
            node.cut = False
    if marked and not root.holds_main:
        _spare(every, {id(n) for n in marked if n.cut})


def _spare(every: list[Node], marked: set[int]) -> None:
    """Takes back cuts by class or id, outermost first, that would leave hardly any of the unlinked paragraph text.
    every: all nodes, parents first; marked: which of them are cut by their class or id only."""
    inside: dict[int, int] = {}
    seen: dict[int, bool] = {}
    for node in every:
        up = node.parent
        gone = bool(up and not seen[id(up)]) or node.tag == "a" or (node.cut and id(node) not in marked)
        seen[id(node)] = not gone
        inside[id(node)] = len(t) if not gone and node.tag in PARAGRAPHS and len(t := _own_text(node, False)) >= LEAST_PARAGRAPH else 0
    for node in reversed(every):
        if node.parent:
            inside[id(node.parent)] += inside[id(node)]
    total = inside[id(every[0])]
    outer = [every[0]]
    while outer:
        at = outer.pop()
        cut, stack = [], [c for c in at.children if not isinstance(c, str)]
        while stack:
            node = stack.pop()
            if id(node) in marked:
                cut.append(node)
            elif not node.cut:
                stack += [c for c in node.children if not isinstance(c, str)]
        lost = sum(inside[id(n)] for n in cut)
        most = max(cut, key=lambda n: inside[id(n)], default=None)
        spared = []
        if most and inside[id(at)] - lost < LEAST_SEEN * total and inside[id(most)] * 2 > total:
            spared = [most]
        elif at is every[0] and 0 < lost == total:
            spared = cut
        for node in spared:
            node.cut = False
        outer += spared


def _own_text(node: Node, links: bool = True) -> str:
    """Text of a node outside of blocks within it; links: also that of links."""
    out, stack = [], list(reversed(node.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            out.append(c)
        elif not c.cut and c.tag not in BLOCK and (links or c.tag != "a"):
            stack += reversed(c.children)
    return " ".join("".join(out).split())


def choose(root: Node) -> list[Node]:
    """The nodes whose text is the article, in page order."""
    _cut(root)
    nodes = _walk(root)
    for node in reversed(nodes):
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        node.text += own
        node.link += own if node.tag == "a" and not node.link else 0
        if node.parent:
            node.parent.text += node.text
            node.parent.link += node.text if node.tag == "a" else node.link
    scored: dict[int, Node] = {}
    for node in nodes:
        if node.tag not in PARAGRAPHS:
            continue
        text = _own_text(node)
        if len(text) < LEAST_PARAGRAPH:
            continue
        points = 1.0 + text.count(",") + text.count("，") + min(len(text) / 100, 3.0)
        up, level = (node.parent if node.tag in ("p", "pre", "td", "blockquote", "li", "dd", "figcaption") else node), 0
        while up and level <= FADED:
            up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            scored[up.order] = up
            up, level = up.parent, level + 1
    if not scored:
        return [next((n for tag in ("article", "main", "body") for n in nodes if n.tag == tag), root)]
    for node in scored.values():
        node.points += CONTAINER_POINTS.get(node.tag, 0.0) + 10.0 * bool(node.words & CONTENT_WORDS)
        node.points *= 1.0 - node.link / max(node.text, 1)
    best = max(scored.values(), key=lambda n: (n.points, -n.order))
    up = best
    while up:
        if up.tag in ("article", "main"):
            best = up
            break
        up = up.parent
    if not best.parent:
        return [best]
    limit = max(SIBLING_LEAST, SIBLING_SHARE * best.points)
    kept = []
    for node in best.parent.children:
        if node is best:
            kept.append(node)
        elif not isinstance(node, str) and not node.cut:
            loose = node.link / max(node.text, 1)
            if (node.order in scored and node.points >= limit) or (node.tag == "p" and node.text > LONG_PARAGRAPH and loose < 0.25):
                kept.append(node)
    return kept


def _number(m: re.Match) -> str:
    """A character reference of very many digits in few: without leading zeros, or as one that is no character."""
    digits = m[1].lstrip("0")
    return f"&#{digits or 0};" if len(digits) < 9 else "\ufffd"


def blocks(nodes: list[Node]) -> list[str]:
    """Text of each block, white space as one space, empty ones left out."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        if text := " ".join(html.unescape(_LONG_NUMBER.sub(_number, "".join(parts))).split()):
            out.append(text)
        parts.clear()

    stack: list = []
    for node in reversed(nodes):
        stack.append(node)
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            parts.append(item)
        elif not item.cut:
            if item.tag in BLOCK:
                flush()
                stack.append(None)
            elif item.tag == "br":
                parts.append(" ")
            stack += reversed(item.children)
    flush()
    return out


def main_text(page: str | None) -> str:
    return "\n".join(blocks(choose(parse(page)))) if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: its id, url, text and n_chars. No shuffle."""
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [id_col, url_col, "text", "n_chars"]
            )

    source = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    return source.mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
