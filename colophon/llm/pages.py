"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks at block-level tags.  A linear classifier over a block's ancestors, the words of class and
id names, tag, links, length and punctuation gives log-odds, bounded at BOUND, which are the capacities of edges to the
two terminals; its weights were fitted on the synthetic pages of ``pagefit`` (a test fits them again).  Blocks next to
each other, and blocks that follow each other under one parent, are joined by smoothness edges, which are weaker the
further apart they stand in the tree.  The minimum cut, found by maximum flow, is the labelling of least total cost: a
short or odd block that the classifier would misjudge takes the side of what surrounds it.

A block whose own cost exceeds all its smoothness edges keeps its label in every minimum cut; such blocks are settled
first and the flow runs over the others only.

A page is read once from start to end: tags are found by bounded scans, open elements by name, and the tree is kept as
parents and depths, so that time and memory grow with the page's length, whatever it holds.

Defined results: null and empty pages, and pages without content, give the empty text; broken nesting is read as
browsers read it (a new paragraph ends the last one, an unmatched end tag does nothing, a tag that never ends takes the
rest of the page with it); character references are decoded once; a page whose blocks are all boilerplate gives the empty
text; repeated rows are judged each; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_END = re.compile(r"""=\s*["']|>""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD = re.compile(r"\w+")
_STOP = re.compile(r"[.!?…。](?=\s|$|[\"'»”)])|,(?=\s)")

# Element names and words of class and id names.
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead title tr ul caption optgroup select".split()
)
RAW = frozenset("script style noscript template textarea iframe object svg math canvas title head select button noframes audio video".split())
OPAQUE = frozenset("script style textarea title iframe noframes noscript template svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK - frozenset("body html head title option optgroup select tr td th tbody thead tfoot caption".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner billboard breadcrumb breadcrumbs byline-links "
    "captcha cart comment comments commentlist consent cookie cookies copyright credits disqus dropdown feedback follow "
    "footer form gdpr header hidden legal login masthead menu menubar modal nav navbar navigation newsletter notice notices "
    "notification outbrain overlay pager pagination paywall popular popup privacy promo promoted promotion recommended "
    "related reply replies respond review reviews search share sharing shopping sidebar sidenav signup skip social sponsor "
    "sponsored subscribe subscription taboola tags toolbar topbar trending widget widgets complementary contentinfo alert "
    "discussion teaser toc rail".split()
)
CONTENT_NAMES = frozenset("article articlebody body-text content entry-content main maincontent post post-body story story-body text entry".split())


#: What an element says of all blocks inside it.
BOILER_TAG, HEADER, BOILER_NAME, HIDDEN, CONTENT_TAG, CONTENT_NAME = (1 << k for k in range(6))
_BOILER = BOILER_TAG | HEADER | BOILER_NAME | HIDDEN
_INSIDE = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_LISTS = ("ul", "ol", "dl", "table", "select", "menu")
_BOXES = ("div", "article", "section", "td", "li", "body", "blockquote", "main")


class Block:
    """A text with its tag, its element (number, see ``Tree``), the length of its links and the signs of its ancestors."""

    __slots__ = ("text", "tag", "node", "links", "signs")

    def __init__(self, text: str, tag: str, node: int, links: int, signs: int):
        self.text, self.tag, self.node, self.links, self.signs = text, tag, node, links, signs


class Tree:
    """Parents and depths of a page's elements by number; 0 is the root."""

    def __init__(self):
        self.parent, self.depth = [0], [0]

    def add(self, above: int) -> int:
        self.parent.append(above)
        self.depth.append(self.depth[above] + 1)
        return len(self.parent) - 1

    def distance(self, a: int, b: int) -> int:
        """Steps from one element to the other; over a page's blocks in turn it walks the tree once."""
        steps, parent, depth = 0, self.parent, self.depth
        while a != b:
            if depth[a] >= depth[b]:
                a = parent[a]
            else:
                b = parent[b]
            steps += 1
        return steps


def _signs(tag: str, attrs: str, above: int) -> int:
    """Signs of an element beside those of the elements around it."""
    out = BOILER_TAG if tag in BOILER_TAGS else CONTENT_TAG if tag in CONTENT_TAGS else 0
    if tag == "header" and not above & (CONTENT_TAG | CONTENT_NAME):  # not the heading of an article
        out |= HEADER
    if "=" in attrs or "hidden" in attrs:
        for m in _NAMES.finditer(attrs):
            for word in (m[1] or m[2] or m[3] or "").lower().replace("_", "-").split():
                parts = {word, *word.split("-")}
                if parts & BOILER_NAMES and not (tag == "header" and parts & BOILER_NAMES == {"header"} and above & (CONTENT_TAG | CONTENT_NAME)):
                    out |= BOILER_NAME
                elif parts & CONTENT_NAMES:
                    out |= CONTENT_NAME
        if _HIDDEN.search(attrs):
            out |= HIDDEN
    return out


class _Reader:
    """Reads a page into blocks."""

    def __init__(self, page: str):
        self.page, self.tree, self.blocks = page, Tree(), []
        # open elements: name, number, signs, nearest block tag; where each name is open; where block elements are
        self.stack: list[tuple[str, int, int, str]] = [("", 0, 0, "")]
        self.at: dict[str, list[int]] = {}
        self.boxes: list[int] = [0]
        self.parts: list[str] = []
        self.linked = self.in_link = self.in_raw = 0
        self.no_end: set[str] = set()

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                _, node, signs, tag = self.stack[-1]
                self.blocks.append(Block(text, tag, node, min(self.linked, len(text)), signs))
            self.parts.clear()
        self.linked = 0

    def add(self, piece: str) -> None:
        if not self.in_raw:
            self.parts.append(piece)
            if self.in_link:
                self.linked += len(piece)

    def open(self, name: str, attrs: str) -> None:
        _, above, signs, tag = self.stack[-1]
        self.at.setdefault(name, []).append(len(self.stack))
        if name in BLOCK:
            self.boxes.append(len(self.stack))
            tag = name
        self.stack.append((name, self.tree.add(above), signs | _signs(name, attrs, signs), tag))
        self.in_link += name == "a"
        self.in_raw += name in RAW

    def close(self, k: int) -> None:
        """Closes the open element at place k and all inside it."""
        while len(self.stack) > k:
            name = self.stack.pop()[0]
            self.at[name].pop()
            if name in BLOCK:
                self.boxes.pop()
            self.in_link -= name == "a"
            self.in_raw -= name in RAW

    def last(self, names) -> int:
        """Place of the innermost open element of these names, 0 if none is open."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def tag_end(self, at: int) -> int:
        """Place of the > that ends a tag, values in quotes aside; -1 if there is none."""
        page = self.page
        while True:
            m = _END.search(page, at)
            if m is None:
                return -1
            at = m.end()
            if m[0] == ">":
                return at - 1
            quote = m[0][-1]
            end = -1 if quote in self.no_end else page.find(quote, at)
            if end < 0:
                self.no_end.add(quote)  # a lone quote is a character like others
            else:
                at = end + 1

    def read(self) -> tuple[list[Block], Tree]:
        page, n, at = self.page, len(self.page), 0
        while at < n:
            lt = page.find("<", at)
            stop = lt if lt >= 0 else n
            if stop > at:
                self.add(page[at:stop])
            if lt < 0:
                break
            head = page[lt + 1 : lt + 2]
            if head in ("!", "?"):
                at = self.skip(lt, n)
                continue
            end_tag = head == "/"
            m = _NAME.match(page, lt + 1 + end_tag)
            if m is None:
                if end_tag and page.find(">", lt) >= 0 and page[lt + 2 : lt + 3] not in ("", " ", "\n", "\t"):
                    at = page.find(">", lt) + 1  # an end tag of nothing
                else:
                    self.add("<")
                    at = lt + 1
                continue
            end = self.tag_end(m.end())
            if end < 0:
                break
            name, attrs, at = m[0].lower(), page[m.end() : end], end + 1
            if end_tag:
                self.ended(name)
            else:
                at = self.started(name, attrs, at, n)
        self.flush()
        return self.blocks, self.tree

    def skip(self, lt: int, n: int) -> int:
        """Beyond a comment, a declaration or a section of character data, whose text is kept."""
        page = self.page
        for start, stop in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
            if page.startswith(start, lt):
                end = page.find(stop, lt + len(start))
                if start == "<![CDATA[":
                    self.add(html.escape(page[lt + 9 : end if end >= 0 else n]))
                return end + len(stop) if end >= 0 else n
        return lt + 1

    def ended(self, name: str) -> None:
        if name in BLOCK and not self.in_raw:
            self.flush()
        k = self.last((name,))
        # an inline end tag does not close a block
        if k and (name in BLOCK or k > self.boxes[-1]):
            self.close(k)

    def started(self, name: str, attrs: str, at: int, n: int) -> int:
        if name in OPAQUE:
            # everything up to the end tag is the element's own
            if name == "title":
                self.flush()
            if attrs.endswith("/") and name not in ("script", "style"):
                return at
            m = re.compile(rf"</{re.escape(name)}(?![^\s/>])[^>]*>", re.I).search(self.page, at)
            return m.end() if m else n
        if name == "br":
            self.add(" ")
            return at
        if name in BLOCK:
            if not self.in_raw:
                self.flush()
            inside = _INSIDE.get(name)
            k = self.last(inside or (("p",) if name in CLOSES_P else ()))
            if k and k > self.last(_LISTS if inside else _BOXES):
                self.close(k)
        if not (name in VOID or attrs.endswith("/") and name not in BLOCK):
            self.open(name, attrs)
        return at


def read(page: str) -> tuple[list[Block], Tree]:
    """The text blocks of a page in order, and the tree that they stand in."""
    return _Reader(page).read()


def blocks(page: str) -> list[Block]:
    return read(page)[0]


FEATURES = (
    "bias", "boiler tag", "header", "boiler name", "hidden", "content tag", "content name", "links", "20 words", "8 words", "sentence", "paragraph", "heading", "item",
)
#: Fitted by ``pagefit.fit`` on its synthetic pages; a test fits them again.
WEIGHTS = (-1.74, -3.05, -1.41, -4.61, -1.37, 3.22, 3.62, -2.42, 2.01, 0.52, 1.08, -0.02, 1.73, 0.63)
#: Log-odds of a block at most.
BOUND = 6.0
#: Strength of the edge between neighbours in the page, and between followers under one parent.
NEAR, SIBLING = 2.0, 0.5


def features(b: Block) -> tuple[float, ...]:
    """FEATURES of a block.  What an article's tag or name says counts only outside boilerplate."""
    words, good = sum(1 for _ in islice(_WORD.finditer(b.text), 20)), not b.signs & _BOILER
    s = b.signs
    return (
        1.0, float(s & BOILER_TAG > 0), float(s & HEADER > 0), float(s & BOILER_NAME > 0), float(s & HIDDEN > 0), float(good and s & CONTENT_TAG > 0), float(good and s & CONTENT_NAME > 0),
        b.links / len(b.text), float(words >= 20), float(8 <= words < 20), float(_STOP.search(b.text) is not None), float(b.tag in ("p", "blockquote", "pre")),
        float(b.tag in ("h1", "h2", "h3", "h4", "h5", "h6")), float(b.tag in ("li", "td", "th", "option", "label", "legend", "dd", "dt")),
    )


def cost(b: Block, weights: tuple[float, ...] = WEIGHTS) -> float:
    """Evidence that a block is content (positive) or boilerplate, the classifier's log-odds."""
    return max(-BOUND, min(BOUND, sum(w * x for w, x in zip(weights, features(b), strict=True))))


def smoothness(found: list[Block], tree: Tree) -> list[tuple[int, int, float]]:
    """Edges between neighbours in the page and between followers under one parent."""
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, NEAR / (1 + 0.5 * tree.distance(found[i - 1].node, b.node))))
        parent = tree.parent[b.node]
        if parent in last and last[parent] != i - 1:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    return edges


def minimum_cut(z: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the content side of a minimum cut with terminal capacities max(z, 0) and max(-z, 0)."""
    n = len(z)
    z, label = list(z), [None] * n
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, c in edges:
        near[i].append((j, c))
        near[j].append((i, c))
    free = [sum(c for _, c in x) for x in near]
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(z[i]) > free[i]:
            label[i] = z[i] > 0
            for j, c in near[i]:
                if label[j] is None:
                    z[j] += c if label[i] else -c
                    free[j] -= c
                    todo.append(j)
    left = [i for i in range(n) if label[i] is None]
    if left:
        for i, side in zip(left, _max_flow(left, z, [e for e in edges if label[e[0]] is None and label[e[1]] is None]), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def _max_flow(nodes: list[int], z: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Dinic's algorithm; the side of each node in the cut next to the source."""
    number = {x: k for k, x in enumerate(nodes)}
    s, t = len(nodes), len(nodes) + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(t + 1)]

    def join(a: int, b: int, forth: float, back: float) -> None:
        for x, y, c in ((a, b, forth), (b, a, back)):
            out[x].append(len(to))
            to.append(y)
            room.append(c)

    for x in nodes:
        if z[x] > 0:
            join(s, number[x], z[x], 0.0)
        elif z[x] < 0:
            join(number[x], t, -z[x], 0.0)
    for i, j, c in edges:
        join(number[i], number[j], c, c)
    while True:
        level = {s: 0}
        queue = deque([s])
        while queue:
            x = queue.popleft()
            for e in out[x]:
                if room[e] > 1e-12 and to[e] not in level:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if t not in level:
            return [k in level for k in range(len(nodes))]
        turn = [0] * (t + 1)
        path: list[int] = []
        x = s
        while True:
            if x == t:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                path, x = [], s
                continue
            while turn[x] < len(out[x]):
                e = out[x][turn[x]]
                if room[e] > 1e-12 and level.get(to[e]) == level[x] + 1:
                    break
                turn[x] += 1
            else:
                if x == s:
                    break
                e = path.pop()
                x = to[e ^ 1]
                turn[x] += 1
                continue
            path.append(e)
            x = to[e]


def labelled(page: str | None, near: float = 1.0) -> list[tuple[Block, bool]]:
    """Blocks of a page and whether they are content; ``near`` scales the smoothness edges (0: the classifier alone)."""
    found, tree = read(page or "")
    edges = [(i, j, near * c) for i, j, c in smoothness(found, tree)] if near else []
    return list(zip(found, minimum_cut([cost(b) for b in found], edges), strict=True))


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b, kept in labelled(page) if kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.transform(arrow, run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
