"""Main text of web pages by minimum-cut labelling of text blocks.

A page becomes a list of blocks: runs of text between block-level tags. Each
block gets a classifier cost for either label; the costs are the capacities to
the two terminals. Neighbouring blocks, and blocks that are close in the DOM,
are joined by smoothness edges. The minimum cut separates content from
boilerplate; it is found by augmenting paths from blocks that lean to content.
"""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S
)
#: Where a quote in a tag is never closed, the tag ends at the next ">".
UNCLOSED = re.compile(r"<()(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NAME_PART = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

# Names of HTML elements and of their usual classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav object ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
BOILER_TAG = frozenset("nav footer aside button select option optgroup head menu dialog fieldset legend search label input".split())
CONTENT_TAG = frozenset("article main".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_NAME = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot banner bottombar breadcrumb breadcrumbs byline comment comments commentlist "
    "consent contentinfo cookie cookies copyright cta dialog disclaimer disqus dropdown feedback footer footnav form gdpr header hidden legal "
    "login masthead menu menubar meta modal nav navbar navbox navigation navlinks newsletter notice notices notification pager pagination "
    "paywall popup popular promo promoted promotion rail recommend recommended recommendations related reply replies respond rss search "
    "share sharing sidebar sidebars side signup skip social sponsor sponsored sponsors subscribe subscription tagcloud tags teaser teasers "
    "toc toolbar topbar tracking trending warning widget widgets alert banners comentarios kommentare commentaires discussion".split()
)
COMMENT_NAME = frozenset("comment comments commentlist reply replies respond disqus comentarios kommentare commentaires discussion".split())
#: A name of two parts counts by its last part, or by its first before one of these.
PLACE_NAME = frozenset(
    "area bar block body box button buttons card cards column container content form group holder inner item items left link links list main menu "
    "module outer panel post posts right row section sections text thread title widget widgets wrap wrapper zone".split()
)
#: What stands before a part that only tells what the page looks like.
LAYOUT_NAME = frozenset("with without no non not has have is show hide hides two three one full".split())
#: Elements that end by a tag of their own only.
ENDED = frozenset("svg math noscript template".split())
CONTENT_NAME = frozenset("article articlebody body content entry main maintext post postbody story storybody text prose".split())
BOILER_ROLE = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
STOP_MARK = re.compile(r"[.!?…。！？](?:[\"')\]]*)(?:\s|$)")

#: Classifier weights and smoothness.
W_BIAS, W_CONTENT_TAG, W_CONTENT_NAME, W_BOILER, W_HEADER = -0.6, 3.0, 1.2, -4.5, -3.0
W_SENTENCE, W_LONG, W_LINK, W_PARAGRAPH, W_HEADING, W_LIST = 1.0, 1.2, -3.5, 0.8, 0.2, -0.3
NEXT_EDGE, SIBLING_EDGE, COUSIN_EDGE = 0.5, 0.6, 0.25


@dataclass
class Block:
    text: str
    linked: int
    node: Node
    parent: int
    grand: int
    lean: float = 0.0


def name_kinds(word: str) -> set[str]:
    """What a class token or id says: boiler, comment, content, header."""
    parts = NAME_PART.findall(CAMEL.sub(" ", word).lower())
    if not parts or parts[0] in LAYOUT_NAME:
        return set()
    whole = "".join(parts)
    names = {whole}
    if len(parts) == 1 or len(parts) == 2 or parts[-1] in PLACE_NAME:
        names.add(parts[-1])
        if len(parts) > 1 and parts[-1] in PLACE_NAME:
            names.add(parts[0])
            names.discard(parts[-1])
            if parts[-1] in BOILER_NAME:
                names.add(parts[-1])
    found = set()
    if names & COMMENT_NAME:
        found.add("comment")
    if names & {"header"}:
        found.add("header")
    if names & (BOILER_NAME - {"header"}):
        found.add("boiler")
    if names & CONTENT_NAME and not found:
        found.add("content")
    return found


class Node:
    """An element: what it and those around it say of its text. ``wrapper`` is
    the outermost named element or form that alone makes it boilerplate, which
    is taken back if it holds most of the page's prose."""

    __slots__ = ("tag", "key", "boiler", "content", "parent", "header", "wrapper", "block")

    def __init__(self, tag: str, key: int, parent: Node | None, attrs: str):
        self.tag, self.key, self.parent = tag, key, parent
        self.boiler = (parent.boiler if parent else False) or tag in BOILER_TAG
        self.wrapper = parent.wrapper if parent else 0
        self.header = (parent.header if parent else False) or tag == "header"
        self.content = parent.content if parent else 0.0
        self.block = self if parent is None or tag in BLOCK else parent.block
        if tag in CONTENT_TAG:
            self.content = max(self.content, W_CONTENT_TAG)
        if tag == "main":
            self.wrapper = 0
        if tag == "form" and not self.wrapper:
            self.wrapper = key
        if attrs:
            self.read(attrs)

    def read(self, attrs: str) -> None:
        kinds: set[str] = set()
        for m in ATTRIBUTE.finditer(attrs):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name in ("class", "id"):
                for w in value.split():
                    kinds |= name_kinds(w)
            elif name == "role":
                if value.lower() in BOILER_ROLE:
                    self.boiler = True
                elif value.lower() in ("main", "article"):
                    self.content, self.wrapper = max(self.content, W_CONTENT_TAG), 0
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                self.boiler = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                self.boiler = True
        if self.tag in ("body", "html", "main"):
            return
        if "comment" in kinds:
            self.boiler = True
        elif "boiler" in kinds and "content" not in kinds:
            self.wrapper = self.wrapper or self.key
        elif "header" in kinds:
            self.header = True
        elif "content" in kinds:
            self.content = max(self.content, W_CONTENT_NAME)


def prose(b: Block) -> int:
    """Length of a paragraph of sentences that is not mostly links."""
    good = len(b.text) > 60 and b.linked < len(b.text) / 3 and STOP_MARK.search(b.text)
    return len(b.text) if good and not b.node.boiler else 0


def lean(text: str, linked: int, node: Node, layout: bool = False) -> float:
    """Classifier cost difference: positive leans to content. layout: the
    wrapper around it is the page's layout."""
    s = W_BIAS + node.content
    if node.boiler or (node.wrapper and not layout):
        s += W_BOILER
    if node.header:
        s += W_HEADER if node.content < W_CONTENT_TAG else (0.0 if node.tag in HEADING else W_HEADER / 2)
    s += W_LINK * linked / max(len(text), 1)
    if STOP_MARK.search(text[-3:]) or STOP_MARK.search(text):
        s += W_SENTENCE
    if len(text) > 120:
        s += W_LONG
    if node.tag in ("p", "pre", "blockquote"):
        s += W_PARAGRAPH
    elif node.tag in HEADING:
        s += W_HEADING
    elif node.tag in ("li", "td", "th", "dt", "dd"):
        s += W_LIST
    return s


def weigh(found: list[Block]) -> None:
    """Gives each block its lean. A wrapper that holds over half of the prose
    in three paragraphs or more is the page's layout, not boilerplate."""
    held: dict[int, list[int]] = {}
    for b in found:
        n = prose(b)
        if n:
            held.setdefault(b.node.wrapper, []).append(n)
    total = sum(map(sum, held.values()))
    layout = {k for k, n in held.items() if len(n) >= 3 and 2 * sum(n) > total}
    for b in found:
        b.lean = lean(b.text, b.linked, b.node, b.node.wrapper in layout)


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order with their lean. Unclosed and crossed tags are
    taken as a browser would roughly take them; raw elements are left out.
    Takes time in proportion to the page's length, whatever stands in it."""
    found: list[Block] = []
    root = Node("", 0, None, "")
    stack = [root]
    open_links = linked = 0
    parts: list[str] = []
    keys = 0
    pos, size, last = 0, len(page), page.rfind(">")
    endless: set[str] = set()
    opened: dict[str, int] = {}

    def close(i: int) -> None:
        for node in stack[i:]:
            opened[node.tag] -= 1
        del stack[i:]

    def flush(node: Node) -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                up = node.block
                above = up.parent or up
                found.append(Block(text, min(linked, len(text)), up, above.key, (above.parent or above).key))
            parts.clear()
        linked = 0

    while pos < size:
        m, start = None, page.find("<", pos)
        while 0 <= start <= last:
            m = TOKEN.match(page, start) or UNCLOSED.match(page, start)
            if m:
                break
            start = page.find("<", start + 1)
        if not m:
            start = page.find("<!--", pos)  # an open comment takes the rest
            start = size if start < 0 else start
        if start > pos:
            piece = page[pos:start]
            parts.append(piece)
            if open_links:
                linked += len(piece.strip())
        if not m:
            break
        pos = m.end()
        if m[1]:
            parts.append(html.escape(m[1], quote=False))
            continue
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:  # end tag
            if tag in BLOCK:
                flush(stack[-1])
            if tag == "a":
                open_links = max(0, open_links - 1)
            for i in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK and stack[i].tag != "p":
                    break
            continue
        if tag in RAW and not m[4].rstrip().endswith("/"):
            end = None if tag in endless else re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
            if end:
                pos = end.end()
            else:
                endless.add(tag)
                pos = pos if tag in ENDED else size
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush(stack[-1])
            if tag in ("p", "li", "dd", "dt", "option", "tr", "td", "th") or stack[-1].tag == "p":
                for i in range(len(stack) - 1, 0, -1):
                    t = stack[i].tag
                    if t == tag or t == "p" or {t, tag} == {"dd", "dt"} or {t, tag} == {"td", "th"}:
                        close(i)
                        open_links = 0
                        break
                    if t in BLOCK:
                        break
        if tag in VOID:
            continue
        if tag == "a":
            open_links += 1
        keys += 1
        stack.append(Node(tag, keys, stack[-1], m[4]))
        opened[tag] = opened.get(tag, 0) + 1
    flush(stack[-1])
    weigh(found)
    return found


def minimum_cut(leans: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source side of the minimum cut. A positive lean is
    the capacity from the source, a negative one that to the sink; edges are
    undirected. Paths are found breadth first from each node with excess; nodes
    that can reach no sink any more are final and not looked at again."""
    n = len(leans)
    rest = list(leans)
    adjacent: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in edges:
        adjacent[i][j] = adjacent[i].get(j, 0.0) + c
        adjacent[j][i] = adjacent[j].get(i, 0.0) + c
    final = [False] * n
    for s in range(n):
        while rest[s] > 1e-12 and not final[s]:
            came = {s: s}
            queue = deque([s])
            hit = -1
            while queue and hit < 0:
                i = queue.popleft()
                for j, c in adjacent[i].items():
                    if c > 1e-12 and j not in came and not final[j]:
                        came[j] = i
                        if rest[j] < -1e-12:
                            hit = j
                            break
                        queue.append(j)
            if hit < 0:
                for i in came:
                    final[i] = True
                break
            flow, j = min(rest[s], -rest[hit]), hit
            while j != s:
                flow = min(flow, adjacent[came[j]][j])
                j = came[j]
            rest[s] -= flow
            rest[hit] += flow
            j = hit
            while j != s:
                i = came[j]
                adjacent[i][j] -= flow
                adjacent[j][i] += flow
                j = i
    return final


def edges_of(found: list[Block]) -> list[tuple[int, int, float]]:
    """Adjacency, and DOM proximity: the last block with the same parent or
    the same grandparent."""
    edges, parents, grands = [], {}, {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, NEXT_EDGE if found[i - 1].grand == b.grand or found[i - 1].parent == b.parent else NEXT_EDGE / 4))
        if b.parent in parents:
            edges.append((parents[b.parent], i, SIBLING_EDGE))
        elif b.grand in grands:
            edges.append((grands[b.grand], i, COUSIN_EDGE))
        parents[b.parent] = grands[b.grand] = i
    return edges


def main_text(page: str | None) -> str:
    """Content blocks in page order, joined by line ends. Null, empty and
    contentless pages give the empty text."""
    if not page:
        return ""
    found = blocks_of(page)
    keep = minimum_cut([b.lean for b in found], edges_of(found))
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, *, html_column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row; other columns are not
    read. Repeated rows give repeated results, an empty table an empty one.
    A null page has the empty text. A page of any length is read whole, in time
    about in proportion to it. Where two cuts are equally small, that with
    fewer content blocks is taken."""

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)

    return pages.select("page_id", "url", text(F.col(html_column)).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
