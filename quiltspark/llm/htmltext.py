"""Operator 9: main text of a page by composite text density.

Every node of the page's tree gets a density: characters per tag, adjusted by
the share of linked characters and tags, so a list of links is thin however
long it is.  A node's density sum is the sum of its children's densities.  The
subtree with the greatest sum is the main one (all of the article or main
element that it is in).  The least density on the path from the body down to it
is the threshold: parts beside the path reach it or are left out, save a first
heading; parts of the subtree that don't reach it are left out if they are
mostly links.  Inline elements count as tags, not as nodes.  Parts that say
what they are by their element or by a word of their class or id (menus,
adverts, comments and so on) count for nothing; so does a header outside an
article.  A word of a class or id may say something else (``has-sidebar``) and
a form may be around the whole page, so such a part is kept if it holds the
article itself, or more than ``MOST`` times the characters outside links that
are there without it; the largest first, those named for readers' texts or other
pages last.  Inside an article a name that says something else besides
(``related-work``) only counts against its part: it stays if its own composite
density reaches the threshold and at most a quarter of its characters are links.

Text comes out in page order: character references decoded, inline elements
joined, blocks separated by a space, white space runs made one space.  A null,
empty or text-less page gives the empty string.  Broken markup never fails:
unknown end tags are ignored and open elements end with their parent; after
``RETRIES`` tags whose quotes never close, tags end at the next ``>``.  Reading
takes time in proportion to the page, however broken or deeply nested.  Repeated
rows and pages get a result each, an empty table an empty one; other columns are
kept, and a column ``text`` that is there already is refused.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"""((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s>"']++))?+""")
_NONE = re.compile(r"display\s*:\s*none", re.I)
#: Tags with open quotes that are tried before quotes count for nothing.
RETRIES = 8
_WORD = re.compile(r"[a-z]+")

_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: An element that starts ends an open one of the second set, up to the third.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
_NEVER = frozenset("head nav footer aside form button select input dialog svg math canvas audio video object menu script style".split()) | _RAW
_SAYS = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs
    sidebar footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup
    login register paywall comment comments disqus respond reply replies share sharing social related recommended recommendations popular trending
    pagination pager widget copyright skip search""".split()
)
#: Words that go with those in a name and change nothing.
_PLAIN = frozenset(
    """area articles bar block body bottom box button buttons bottom center col column container content feed footer form group header icons inline inner
    item items js label left link links list main media module more news outer page panel posts right row section site slot stories strip tag tags text
    title top unit user view wrap wrapper""".split()
)
_OTHERS = frozenset("comment comments disqus respond reply replies related recommended recommendations popular trending".split())
_MAIN = frozenset("html body main article".split())
_RAW_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
MOST = 9
#: Why a part is dropped: by its element or as hidden; by its name; by a name for texts of others;
#: inside an article, by a name that says something else besides.
_SURE, _NAMED, _OTHER, _HINT = 1, 2, 3, 4


class Node:
    __slots__ = ("name", "items", "drop", "up", "chars", "tags", "link_chars", "link_tags", "density", "total", "plain")

    def __init__(self, name: str, up: Node | None, drop: int = 0):
        self.name, self.up, self.drop, self.items = name, up, drop, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.plain = 0


def _attributes(rest: str) -> dict[str, str]:
    """Lower-case names to values, without quotes; of a repeated name the first."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(rest):
        out.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') else value)
    return out


def _dropped(name: str, rest: str, inside: bool) -> int:
    if (name in _NEVER and name != "form") or (name == "header" and not inside):
        return _SURE
    if rest and name not in _MAIN:
        has = _attributes(rest)
        if "hidden" in has or has.get("aria-hidden", "").lower() == "true" or _NONE.search(has.get("style", "")):
            return _SURE
        names = [_WORD.findall(x) for key in ("class", "id", "role") for x in has.get(key, "").lower().split()]
        said = {w for words in names for w in words}
        known = _OTHERS | _SAYS
        if not known.isdisjoint(said):
            if inside and all(any(w not in known and w not in _PLAIN for w in words) for words in names if not known.isdisjoint(words)):
                return _HINT
            return _NAMED if _OTHERS.isdisjoint(said) else _OTHER
        if not inside and "header" in said:
            return _NAMED
    return _NAMED if name == "form" else 0


def _tags(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Start, end, "/" of an end tag, name and the rest of each tag; comments and the
    like have no name.  The caller may send a place to go on from."""
    at, retries = 0, RETRIES
    while (start := html.find("<", at)) >= 0:
        at = start + 1
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            found = (start, len(html) if end < 0 else end + 3, "", "", "")
        else:
            head = _NAME.match(html, at)
            if not head and html[at : at + 1] not in ("!", "?"):
                continue
            whole = _REST.match(html, head.end()) if head and retries else None
            if whole:
                found = (start, whole.end(), head[1], head[2].lower(), whole[1])
            else:
                end = html.find(">", at)
                if end < 0:  # nor is there one for a later tag
                    return
                if head:
                    retries = max(0, retries - 1)
                    found = (start, end + 1, head[1], head[2].lower(), html[head.end() : end])
                else:
                    found = (start, end + 1, "", "", "")
        at = found[1]
        onward = yield found
        if onward is not None:
            at = onward
            yield found


class _Opened:
    """The open elements; where the last of a name, block or element other than inline is, at once."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.solid: list[int] = []

    def last(self, *names: str) -> int:
        return max((at[-1] for x in names if (at := self.places.get(x))), default=-1)

    def push(self, node: Node) -> None:
        k = len(self.nodes)
        self.nodes.append(node)
        self.places.setdefault(node.name, []).append(k)
        if node.name in _ENDS_P:
            self.blocks.append(k)
        if node.name not in _INLINE:
            self.solid.append(k)

    def end(self, k: int) -> Node:
        """Close the element at ``k`` and all in it; what is around it."""
        up = self.nodes[k].up
        for i in range(len(self.nodes) - 1, k - 1, -1):
            self.places[self.nodes[i].name].pop()
            for kind in (self.blocks, self.solid):
                if kind and kind[-1] == i:
                    kind.pop()
        del self.nodes[k:]
        return up


def parse(html: str) -> Node:
    """The page's tree; strings and nodes are in ``items`` in page order."""
    root = Node("html", None)
    at, here, opened = 0, root, _Opened()
    tags = _tags(html)
    for start, end, slash, name, rest in tags:
        if start > at:
            here.items.append(html[at:start])
        at = end
        if not name:
            continue
        if slash:
            k = opened.last(name)
            if k >= 0 and not (name in _INLINE and opened.blocks and opened.blocks[-1] > k):
                here = opened.end(k)
            continue
        if name in ("html", "body"):
            if name == "body":  # a body ends whatever of the head was left open
                opened, here = _Opened(), root
            continue
        if name in _ENDS_P:
            k = opened.last("p")
            if k >= 0 and opened.solid[-1] == k:
                here = opened.end(k)
        elif name in _CLOSES:
            ended, bounds = _CLOSES[name]
            k = opened.last(*ended)
            if k > opened.last(*bounds):
                here = opened.end(k)
        node = Node(name, here, _dropped(name, rest, opened.last("article", "main") >= 0))
        here.items.append(node)
        if name in _RAW:
            close = _RAW_ENDS[name].search(html, at)
            at = close.end() if close else len(html)
            tags.send(at)
        elif name not in _VOID and not rest.endswith("/"):
            opened.push(node)
            here = node
    if at < len(html):
        here.items.append(html[at:])
    return root


def _order(root: Node) -> list[Node]:
    """Kept nodes, parents first."""
    out = [root]
    for node in out:
        out.extend(x for x in node.items if x.__class__ is Node and not x.drop)
    return out


def _undrop(root: Node) -> None:
    """A part that says it is something else but holds the article is kept."""
    todo: list[tuple[Node, tuple | None]] = [(root, None)]
    while todo:
        node, above = todo.pop()
        if node.drop:  # (part, those around it, whether all of them may be kept)
            above = (node, above, (node.name == "form" or node.name not in _NEVER) and (above is None or above[2]))
        if above and node.name in ("article", "main") and above[2]:
            while above and above[0].drop:  # those further out are kept already
                above[0].drop = 0
                above = above[1]
            above = None
        todo += [(x, above) for x in node.items if x.__class__ is Node]


def _undrop_most(root: Node) -> None:
    """Parts dropped by their name without which next to no text is left are kept."""
    nodes = [root]
    for node in nodes:
        nodes.extend(x for x in node.items if x.__class__ is Node and x.drop != _SURE)
    if not any(x.drop for x in nodes):
        return
    for node in reversed(nodes):
        if node.name != "a":
            node.plain += sum(len(x.strip()) for x in node.items if x.__class__ is str)
            if node.up:
                node.up.plain += node.plain
    parts: list[tuple[int, int, int, Node]] = []

    def opened(part: Node) -> int:
        """What is there of a part's unlinked characters; the parts dropped in it are noted."""
        there, todo = part.plain, [part]
        while todo:
            for x in todo.pop().items:
                if x.__class__ is Node and x.drop in (_NAMED, _OTHER, _HINT):
                    there -= x.plain
                    heapq.heappush(parts, (x.drop, -x.plain, len(seen), x))
                    seen.append(x)
                elif x.__class__ is Node and not x.drop and x.name != "a":
                    todo.append(x)
        return there

    seen: list[Node] = []
    kept = opened(root)
    while parts:
        part = heapq.heappop(parts)[-1]
        if part.plain > MOST * kept:
            part.drop = 0
            kept += opened(part)


def measure(root: Node) -> list[Node]:
    """Counts, densities and density sums of the kept nodes; parents first."""
    nodes = _order(root)
    around, root.up = root.up, None  # what is around a part is not changed by it
    for node in reversed(nodes):
        node.chars += sum(len(x.strip()) for x in node.items if x.__class__ is str)
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if node.up:
            node.up.chars += node.chars
            node.up.tags += node.tags + 1
            node.up.link_chars += node.link_chars
            node.up.link_tags += node.link_tags
    share = root.link_chars / max(1, root.chars)
    for node in nodes:
        if not node.chars:
            continue
        tags, links, linked = max(1, node.tags), max(1, node.link_tags), max(1, node.link_chars)
        plain = max(1, node.chars - node.link_chars)
        base = math.log(node.chars / plain * node.link_chars + share * node.chars + math.e)
        node.density = node.chars / tags * math.log(max(1.0, node.chars / linked * tags / links) + 1e-9, max(base, 2.0))
    for node in reversed(nodes):
        if node.up and node.name not in _INLINE:
            node.up.total += node.density
    root.up = around
    return nodes


def _stays(part: Node, threshold: float) -> bool:
    """Whether a part with a hint of a name is as dense as the article and holds few links."""
    part.drop = 0
    measure(part)
    return part.chars > 0 and part.density >= threshold and 4 * part.link_chars <= part.chars


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    _undrop(root)
    _undrop_most(root)
    nodes = measure(root)
    best = max((n for n in nodes if n.name not in _INLINE), key=lambda n: n.total)
    path, threshold = [best], best.density
    while path[-1].up:
        path.append(path[-1].up)
        threshold = min(threshold, path[-1].density)
    whole = next((n for n in path if n.name in ("article", "main")), best)
    if best.total <= 0:
        whole = root
    above = set(path[path.index(whole) + 1 :]) if whole in path else set()
    out: list[str] = []
    todo: list[tuple[Node | str, bool]] = [(root, whole is root)]
    while todo:
        x, inside = todo.pop()
        if x.__class__ is str:
            if inside:
                out.append(x)
        elif x.drop and not (inside and x.drop == _HINT and _stays(x, threshold)):
            out.append(" ")
        elif inside:
            inline = x.name in _INLINE
            if not inline:
                out.append(" ")
                todo.append((" ", True))
            if inline or x is whole or x.density >= threshold or 2 * x.link_chars <= x.chars:
                todo.extend((y, True) for y in reversed(x.items))
        elif x is whole or x in above:
            todo.extend((y, x is whole) for y in reversed(x.items))
            out.append(" ")
        elif x.up in above and (x.name == "h1" or (x.name not in _INLINE and x.density >= threshold and 2 * x.link_chars <= x.chars)):
            todo.extend([(" ", True)] + [(y, True) for y in reversed(x.items)])
            out.append(" ")
    return " ".join(unescape("".join(out)).split())


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of every whole page, in place of ``column``."""
    kept = [c for c in pages.columns if c != column]
    if "text" in kept:
        raise ValueError("a column text is there already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "text"])

    fields = [f for f in pages.schema.fields if f.name != column]
    return pages.mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType())]))
