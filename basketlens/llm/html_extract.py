"""Main-text extraction from web pages by minimum-cut labelling of text blocks.

A page is cut into text blocks at its block-level tags. A block's own evidence
(the elements it stands in, its share of link text, its length, whether the
page has a content element that it stands outside of) becomes a capacity to the
source (content) or to the sink (boilerplate). Neighbouring blocks, and blocks
with the same parent element, are joined by smoothness edges. The minimum cut,
found by maximum flow, is the labelling with the least total cost; blocks on
the source side are the main text.

The tags and names that mark boilerplate are evidence like the rest: they are
weighed against what the page has outside the marked element, so that a form or
a ``menu-open`` wrapper around a whole page does not cost its article.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML, as its standard names them. Without an end tag, those that hold
# raw text run to the end of the page; the other ones without text of their own are left at their tag.
RAW = {"script", "style", "textarea", "title"}
APART = {"noscript", "template", "svg", "iframe", "object", "canvas", "select", "button", "audio", "video", "datalist"}
NESTS = {"svg", "object", "template"}
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption".split())
VOID = {"hr"}
ENDS_P = BLOCK - {"html", "body", "head"}
LEAF = set("p h1 h2 h3 h4 h5 h6 li dt dd tr figcaption caption legend summary pre address".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
GAP = {"br", "td", "th", "img", "option"}
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "head", "search"}
CONTENT = {"article", "main"}

#: Words in class, id and role that mark boilerplate, and that mark content.
BOILERPLATE_WORDS = set("""ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr
notice notices notification alert comment comments disqus reply replies respond sidebar aside share sharing social follow newsletter subscribe
subscription signup login popup modal overlay related recommended recommendations breadcrumb breadcrumbs menu nav navbar navigation toolbar
footer masthead pager pagination widget widgets toc tags skip search form complementary contentinfo""".split())
CONTENT_WORDS = set("article content post entry story main body text prose".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?](?!--)[^>]*>?"
    r"|<(?P<raw>" + "|".join(sorted(RAW)) + r")(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<apart>" + "|".join(sorted(APART)) + r")(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?(?P<odd>[a-z][a-z0-9:-]*)[^>]*(?:>|\Z)", re.I | re.S)
#: Lower case letter by letter, so that places in a page stay as they are.
_LOWER = {c: c + 32 for c in range(65, 91)}
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)

#: Strength of evidence (log-odds) and of smoothness.
STRUCTURE, MARK, IN_CONTENT, LINKS, LENGTH, SENTENCE, HEADING, BASE = 12.0, 9.0, 3.0, 4.0, 1.0, 0.8, 0.7, -1.7
#: Length counts up to this; what standing outside of the page's content element costs.
LONGEST, OUTSIDE = 5.0, 4.0
ADJACENT, SIBLING, HEADS, ACROSS = 0.9, 0.6, 1.8, 0.2
#: A mark is in doubt if the text outside is below this share of the text inside; characters that every page is taken to
#: have outside; what a title or content element on one side alone adds.
DOUBT, SOME, TITLE = 0.05, 20, 3.0


class Mark:
    """An element that its tag or names mark as boilerplate, with what lies in it."""
    __slots__ = ("parent", "strength", "children", "own", "inside", "titles", "own_titles", "weight")

    def __init__(self, parent: Mark | None, strength: float):
        self.parent, self.strength, self.children = parent, strength, []
        self.own = self.inside = self.titles = self.own_titles = 0  # unlinked characters, titles: outside inner marks, and all
        self.weight = 1.0


class Block:
    __slots__ = ("text", "links", "parent", "content", "mark", "heading")

    def __init__(self, text: str, links: int, parent: int, content: float, mark: Mark | None, heading: bool):
        self.text, self.links, self.parent, self.content, self.mark, self.heading = text, links, parent, content, mark, heading

    @property
    def unlinked(self) -> int:
        return max(0, len(self.text) - self.links)


def element_evidence(tag: str, attrs: str, content: float) -> tuple[float, float]:
    """What an element says of the blocks inside it: log-odds for content, and the strength of a boilerplate mark (0: none)."""
    if tag in BOILERPLATE or tag == "header" and content <= 0:
        return content, STRUCTURE
    if tag in CONTENT:
        return IN_CONTENT, 0.0
    if attrs and tag not in ("body", "html"):
        words = set()
        for name in " ".join(m.strip("\"'") for m in MARKS.findall(attrs)).split():
            parts = re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
            if parts[0] not in ("with", "has", "no", "is", "without"):  # says something about a whole page
                words.update(parts)
        if words & BOILERPLATE_WORDS or "header" in words and content <= 0:
            return content, MARK
        if words & CONTENT_WORDS:
            return IN_CONTENT, 0.0
    return content, 0.0


def _ends(low: str, tag: str) -> dict[int, int]:
    """Where the elements apart of one kind end: place behind the start tag -> place behind its end tag, if it has one."""
    out, open_tags = {}, []
    for m in re.finditer(rf"<(/?){tag}(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>", low):
        if m[1]:
            if open_tags:
                out[open_tags.pop()] = m.end()
        elif tag != "svg" or not m[0].endswith("/>"):
            if tag not in NESTS:
                open_tags.clear()  # another one starts: the one before has no end tag
            open_tags.append(m.end())
    return out


def blocks_of(page: str) -> tuple[list[Block], list[Mark], int]:
    """The non-empty text blocks of a page, in order; its marks, outer ones first; and its titles outside all marks."""
    out: list[Block] = []
    marks: list[Mark] = []
    stack: list[tuple[str, int, float, Mark | None]] = [("", 0, 0.0, None)]  # tag, element number, content, mark
    elements, parts, links, linked, titles = 0, [], 0, False, 0
    low, ends = "", {}  # the page in lower case, and the ends of its elements apart: once they are needed

    def flush():
        nonlocal links
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = html.unescape(text)
            text = " ".join(text.split())
            if text:
                out.append(Block(text, links, stack[-2][1] if stack[-1][0] in LEAF else stack[-1][1], stack[-1][2], stack[-1][3], stack[-1][0] in HEADINGS))
            parts.clear()
        links = 0

    at = 0
    m = TOKEN.search(page)
    while m:
        if m.start() > at:
            piece = page[at:m.start()]
            parts.append(piece)
            if linked:
                links += len(piece)
        at = m.end()
        tag = m["tag"] or m["odd"]
        if not tag:
            if m["apart"]:
                low, kind = low or page.translate(_LOWER), m["apart"].lower()
                if kind not in ends:
                    ends[kind] = _ends(low, kind)
                at = ends[kind].get(at, at)
            if m["raw"] or m["apart"]:
                parts.append(" ")
            m = TOKEN.search(page, at)
            continue
        tag = tag.lower()
        if tag == "a":
            linked = not (m["end"] or m[0].startswith("</"))
        elif tag in GAP:
            parts.append(" ")
        elif tag in BLOCK:
            flush()
            if m["end"] or m[0].startswith("</"):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                linked = False
            else:
                if tag in ENDS_P and stack[-1][0] == "p" or tag == "li" and stack[-1][0] == "li":
                    stack.pop()
                if tag not in VOID:
                    elements += 1
                    _, _, content, mark = stack[-1]
                    content, strength = element_evidence(tag, m["attrs"] or "", content)
                    if strength:
                        mark = Mark(mark, strength)
                        marks.append(mark)
                    elif tag == "h1" or tag in CONTENT:
                        if mark is None:
                            titles += 1
                        else:
                            mark.own_titles += 1
                    stack.append((tag, elements, content, mark))
        m = TOKEN.search(page, at)
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out, marks, titles


def weigh_marks(blocks: list[Block], marks: list[Mark], titles: int) -> None:
    """How far each mark is believed (``weight``, 0 to 1).

    A mark around nearly all text of a page, or around its only title, says little.
    Marks are weighed from the largest to the smallest, inner ones after outer ones;
    the text of a mark in doubt counts as text of the page for those that follow.
    """
    free = 0
    for b in blocks:
        if b.mark is None:
            free += b.unlinked
        else:
            b.mark.own += b.unlinked
    for mark in reversed(marks):
        mark.inside += mark.own
        mark.titles += mark.own_titles
        if mark.parent is not None:
            mark.parent.inside += mark.inside
            mark.parent.titles += mark.titles
            mark.parent.children.append(mark)
    ready = [(-m.inside, k, m) for k, m in enumerate(marks) if m.parent is None]
    heapq.heapify(ready)
    order = len(marks)
    while ready:
        _, _, mark = heapq.heappop(ready)
        odds = 2 * math.log((free + SOME) / (DOUBT * mark.inside + 1e-9)) + TITLE * ((titles > 0) - (mark.titles > 0))
        mark.weight = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        if mark.weight < 0.5:
            free, titles = free + mark.own, titles + mark.own_titles
            for inner in mark.children:
                order += 1
                heapq.heappush(ready, (-inner.inside, order, inner))
    for mark in marks:  # inside a believed mark nothing is weighed anew; outer doubts add to inner marks
        if mark.parent is not None and mark.parent.weight >= 0.5:
            mark.weight, mark.strength = mark.parent.weight, max(mark.strength, mark.parent.strength)


def block_odds(block: Block, outside: float) -> float:
    """Log-odds that a block is content; ``outside``: the share of the page's text that stands in content elements."""
    share = min(1.0, block.links / max(1, len(block.text)))
    sentence = SENTENCE if block.text[-1] in ".!?…:;\"”»" else 0.0
    odds = BASE + min(LONGEST, LENGTH * math.log1p(len(block.text) / 10)) + sentence + HEADING * block.heading - LINKS * share
    believed, strength = (0.0, 0.0) if block.mark is None else (block.mark.weight, block.mark.strength)
    place = block.content if block.content else -OUTSIDE * outside
    return odds + (1 - believed) * place - max(0.0, 2 * believed - 1) * strength


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source side of the minimum cut (Dinic's maximum flow).

    Positive odds are capacities from the source, negative ones to the sink;
    ``edges`` have the same capacity both ways.
    """
    n = len(odds)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a, b, forth, back):
        out[a].append(len(to))
        to.append(b)
        cap.append(forth)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for k, w in enumerate(odds):
        link(s, k, w, 0.0) if w >= 0 else link(k, t, -w, 0.0)
    for a, b, w in edges:
        link(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, [s]
        for u in queue:
            for e in out[u]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[k] >= 0 for k in range(n)]
        nxt, path, u = [0] * (n + 2), [], s
        while True:  # blocking flow: walk forward on the level graph, step back at dead ends
            if u == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if cap[e] <= 1e-9)
                u = to[path[first] ^ 1]
                del path[first:]
                continue
            while nxt[u] < len(out[u]):
                e = out[u][nxt[u]]
                if cap[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            else:
                if u == s:
                    break
                e = path.pop()
                u = to[e ^ 1]
                nxt[u] += 1
                continue
            path.append(e)
            u = to[e]


def labelled(page: str) -> list[tuple[Block, float, bool]]:
    """Every text block of a page with its own odds and the label that the cut gives it."""
    blocks, marks, titles = blocks_of(page)
    if not blocks:
        return []
    weigh_marks(blocks, marks, titles)
    doubted = lambda b: b.mark is None or b.mark.weight < 0.5
    text = sum(b.unlinked for b in blocks if doubted(b))
    outside = sum(b.unlinked for b in blocks if doubted(b) and b.content) / text if text else 0.0
    edges, last = [], {}
    for k, b in enumerate(blocks):
        if k:
            before = blocks[k - 1]
            alike = doubted(b) and doubted(before) or b.mark is before.mark
            if before.heading and alike and b.parent == before.parent:
                edges.append((k - 1, k, HEADS))  # a heading goes with what it heads
            else:
                edges.append((k - 1, k, ADJACENT if alike and b.parent == before.parent else ACROSS))
        if b.parent in last and last[b.parent] != k - 1:
            edges.append((last[b.parent], k, SIBLING))
        last[b.parent] = k
    odds = [block_odds(b, outside) for b in blocks]
    return list(zip(blocks, odds, min_cut(odds, edges)))


def main_blocks(page: str) -> list[str]:
    """The blocks of the main text of a page, in page order."""
    return [b.text for b, _, kept in labelled(page) if kept]


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """``(page_id, url, text, n_chars, n_blocks)`` for every page.

    Blocks of the main text in page order, white space made one blank, joined
    by a blank line; ``n_chars`` counts code points. A null or empty page, or
    one without main text, has the empty text. Null ids and repeated rows come
    back as they are; other columns are ignored; an empty table gives an empty
    result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_blocks(p or "") for p in batch.column(2).to_pylist()]
            texts = ["\n\n".join(b) for b in found]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()), pa.array([len(b) for b in found], pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_blocks"])
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long, n_blocks long")
