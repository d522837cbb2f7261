"""Operator 8, HTML extraction: a small tree builder and a layout-aware renderer.

The builder closes tags that HTML implies (p, li, dt, dd, option, tr, td, th, table sections),
knows void and raw-text elements, and decodes character references.  The renderer emits all
visible text (`visibility`): what style sheets and attributes hide, elements that never show,
closed dialogs and details, and options of a closed list but the chosen one are left out; blocks
stand on lines of their own, paragraphs, headings and tables between blank lines; list items
carry their mark and indent; table cells stand in the columns that colspan and rowspan give
them, padded to their column's width; pre keeps its white space.

Neither part recurses, and each character is read once, so pages may be nested or broken in any
way.  Layout, never text, is bounded: indents stop at MAX_INDENT, padding at MAX_PAD
and the empty cells before a cell at MAX_EMPTY.

Pages are rendered one by one inside tasks that Spark deals out.  Defined results: null pages
give null text, empty ones ""; unknown or unclosed tags do no harm, a tag that the page's end
cuts is dropped; each row is rendered, repeated or not; extra columns are passed through (one
named as the output is replaced); an empty table gives an empty one.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.visibility import attributes, prune

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center details dialog dd dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table ul".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
CLOSES_P = BLOCK - frozenset("body html option optgroup legend".split())
# tag -> (tags that it closes, tags that stop the search for them)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
}
# Quotes count only after an equals sign, as in HTML; every alternative matches to the page's end if need be.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?)*+)(?:>|\Z)|<(?:[!?]|/(?=[^a-zA-Z]))[^>]*(?:>|\Z)", re.S
)
# Parts of a table that hold its rows; a form between them leaves them in the table.
SECTIONS = frozenset("tbody thead tfoot colgroup form".split())
START = re.compile(r"\s*(-?\d{1,9})")
RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
SPAN = re.compile(r"\s*\+?(\d{1,9})")
SPACES = re.compile(r"[ \t\n\f\r]+")
MAX_INDENT = 80
MAX_PAD = 100
MAX_EMPTY = 40
P_STOPS = BLOCK | {"td", "th", "button"}


class Node:
    __slots__ = ("attrs", "kids", "tag", "up")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], None


class Stack:
    """The open elements, with the places of each tag and of what bounds an open paragraph."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.places, self.bounds = [root], {}, []

    def push(self, node: Node) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag in P_STOPS:
            self.bounds.append(at)

    def cut(self, at: int) -> None:
        """Close the element at that place and all inside it."""
        while len(self.nodes) > at:
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag in P_STOPS:
                self.bounds.pop()

    def last(self, *tags: str) -> int:
        """Place of the innermost element with one of the tags; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)


def build(page: str) -> Node:
    """The page's tree: nodes with a tag, raw attributes and children (nodes or strings)."""
    root = Node("html")
    stack, at, n = Stack(root), 0, len(page)
    while at < n:
        m = MARKUP.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            stack.nodes[-1].kids.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = m[2].lower() if m[2] else None
        if tag is None or page[at - 1] != ">":  # comments and the like, and a tag that the page's end cuts
            continue
        if m[1]:
            open_ = stack.last(tag)
            if open_ and (tag in ("table", "tr", "tbody", "thead", "tfoot", "td", "th") or open_ > stack.last("td", "th", "table")):
                if tag not in ("td", "th") or open_ > stack.last("table"):
                    stack.cut(open_)
            elif not open_ and tag == "br":
                stack.nodes[-1].kids.append(Node("br"))
            continue
        if tag == "html" or tag == "body" and stack.last("body"):
            continue
        if tag in CLOSES_P:
            open_ = stack.last("p")
            # A paragraph is a block too: it is found unless something after it bounds the search.
            if open_ and stack.bounds[-1] == open_:
                stack.cut(open_)
        if tag == "body":
            stack.cut(1)
        if tag in IMPLIED:
            closed, stops = IMPLIED[tag]
            open_ = stack.last(*closed)
            if open_ > stack.last(*stops):
                stack.cut(open_)
        if tag in ("td", "th") and stack.nodes[-1].tag in ("table", "tbody", "thead", "tfoot", "form"):
            if stack.nodes[-1].tag != "form" or stack.last("table"):
                row = Node("tr")
                stack.nodes[-1].kids.append(row)
                stack.push(row)
        node = Node(tag, m[3])
        stack.nodes[-1].kids.append(node)
        if tag in RAW and not (tag in ("title", "style") and stack.last("svg")):
            end = RAW_END[tag].search(page, at)
            end = end.start() if end else n
            node.kids.append(page[at:end] if tag not in ("textarea", "title") else html.unescape(page[at:end]))
            close = page.find(">", end)
            at = n if close < 0 else close + 1
        elif tag not in VOID and not (m[3].endswith("/") and stack.last("svg", "math")):
            stack.push(node)
    return root


class Page:
    """Lines of text under way: inline text gathers in a buffer until a block breaks it."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.buffer: list[str] = []
        self.first, self.rest = "", ""
        self.blank = False

    def flush(self) -> None:
        text = SPACES.sub(" ", "".join(self.buffer))
        self.buffer = []
        for part in text.split("\x00"):
            part = part.strip(" ").replace("\x01", " ").replace("\x02", "\n")
            if part.strip():
                if self.blank and self.lines:
                    self.lines.append("")
                self.blank = False
                for line in part.split("\n"):
                    self.lines.append(f"{self.first}{line}".rstrip())
                    self.first = self.rest

    def gap(self, spaced: bool) -> None:
        self.flush()
        self.blank = self.blank or spaced


Steps = Iterator["Steps"]


def run(steps: Steps) -> None:
    """Run a generator that yields the generators it waits for: recursion without Python's stack."""
    stack = [steps]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


def render(kids: list, page: Page, pre: bool = False) -> Steps:
    for kid in kids:
        if isinstance(kid, str):
            kid = kid.replace("\x00", "").replace("\x01", "").replace("\x02", "")
            page.buffer.append(kid.replace(" ", "\x01").replace("\t", "\x01" * 4).replace("\r\n", "\x02").replace("\n", "\x02") if pre else kid)
        elif kid.tag == "br":
            page.buffer.append("\x00")
        elif kid.tag == "img":
            continue
        elif kid.tag == "table":
            page.gap(True)
            yield table(kid, page)
            page.gap(True)
        elif kid.tag in ("ul", "ol", "menu"):
            page.gap(not page.rest)
            yield items(kid, page)
            page.gap(not page.rest)
        elif kid.tag in BLOCK:
            page.gap(kid.tag in SPACED)
            yield render(kid.kids, page, pre or kid.tag == "pre")
            page.gap(kid.tag in SPACED)
        else:
            yield render(kid.kids, page, pre)


def items(node: Node, page: Page) -> Steps:
    named, outer = attributes(node.attrs) if node.tag == "ol" else {}, page.rest
    step = -1 if "reversed" in named else 1
    start = START.match(named.get("start", ""))
    number = int(start[1]) if start else 1 if step > 0 else sum(isinstance(k, Node) and k.tag == "li" for k in node.kids)
    for kid in node.kids:
        if isinstance(kid, Node) and kid.tag == "li":
            own = START.match(attributes(kid.attrs).get("value", "")) if node.tag == "ol" and kid.attrs else None
            number = int(own[1]) if own else number
            page.flush()
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += step
            page.first, page.rest = outer + mark, (outer + " " * len(mark))[:MAX_INDENT]
            yield render(kid.kids, page)
            page.flush()
            page.first = page.rest = outer
            page.blank = False
        else:
            yield render([kid], page)


def parts_of(node: Node) -> tuple[list[Node], list]:
    """The rows of a table, and what stands in it or its sections and is no row."""
    rows, strays, todo = [], [], [iter(node.kids)]
    while todo:
        kid = next(todo[-1], None)
        if kid is None:
            todo.pop()
        elif isinstance(kid, str):
            strays.append(kid)
        elif kid.tag == "tr":
            rows.append(kid)
        elif kid.tag in SECTIONS:
            todo.append(iter(kid.kids))
        else:
            strays.append(kid)
    return rows, strays


def span_of(cell: Node, name: str, most: int) -> int:
    """A cell's colspan or rowspan; rowspan 0 goes on to the table's end."""
    if name not in cell.attrs.lower():
        return 1
    m = SPAN.match(attributes(cell.attrs).get(name, ""))
    n = int(m[1]) if m else 1
    return most if n > most or n == 0 and name == "rowspan" else max(1, n)


def merged(busy: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Columns that are taken, in order; neighbours that get free together are one."""
    out: list[tuple[int, int, int]] = []
    for start, end, free_at in sorted(busy):
        if out and out[-1][1] >= start and out[-1][2] == free_at:
            out[-1] = (out[-1][0], max(end, out[-1][1]), free_at)
        else:
            out.append((start, end, free_at))
    return out


def table(node: Node, page: Page) -> Steps:
    rows, strays = parts_of(node)
    for kid in strays:  # captions and stray text come before the rows
        yield render([kid], page)
        page.gap(False)
    page.gap(False)
    placed: list[list[tuple[int, int, str]]] = []  # per row: first column, columns, text
    busy: list[tuple[int, int, int]] = []  # first column, end, row at which it is free again
    for number, tr in enumerate(rows):
        at, k, line, fresh = 0, 0, [], []
        busy = [x for x in busy if x[2] > number]
        for cell in tr.kids:
            if isinstance(cell, Node):
                inner = Page()
                yield render(cell.kids if cell.tag in ("td", "th") else [cell], inner)
                inner.flush()
                text = " ".join(x.strip() for x in inner.lines if x.strip())
                wide, tall = span_of(cell, "colspan", 1000), span_of(cell, "rowspan", 65534)
            elif cell.strip():
                text, wide, tall = SPACES.sub(" ", cell).strip(), 1, 1
            else:
                continue
            while k < len(busy) and busy[k][0] <= at:
                at, k = max(at, busy[k][1]), k + 1
            line.append((at, wide, text))
            if tall > 1:
                fresh.append((at, at + wide, number + tall))
            at += wide
        busy = merged(busy + fresh) if fresh else busy
        if any(text for *_, text in line):
            placed.append(line)
    # Only columns at which some cell begins are columns of the text.
    starts = sorted({c for line in placed for c, *_ in line})
    index = {c: i for i, c in enumerate(starts)}
    widths, lines = [0] * len(starts), []
    for line in placed:
        cells = [(index[c], min(bisect_left(starts, c + wide), len(starts)), text) for c, wide, text in line]
        lines.append(cells)
        for first, end, text in cells:
            if end <= first + 1:
                widths[first] = max(widths[first], min(len(text), MAX_PAD))
    for cells in lines:
        out, at = [], 0
        for first, end, text in cells:
            out += [" " * widths[i] for i in range(max(at, first - MAX_EMPTY), first)]
            at = max(end, first + 1)
            out.append(text.ljust(min(sum(widths[first:at]) + 3 * (at - first - 1), MAX_PAD * 2)))
        if page.blank and page.lines:
            page.lines.append("")
        page.blank = False
        page.lines.append(f"{page.first}{' | '.join(out)}".rstrip())
        page.first = page.rest


def free(tree: Node) -> None:
    """Take the tree apart from above, as letting go of deeply nested nodes would recurse."""
    todo = [tree]
    while todo:
        node = todo.pop()
        todo += [kid for kid in node.kids if isinstance(kid, Node)]
        node.kids, node.up = [], None


def text_of(page: str | None) -> str | None:
    if page is None:
        return None
    out = Page()
    tree = build(page)
    prune(tree)
    run(render(tree.kids, out))
    out.flush()
    free(tree)
    return "\n".join(out.lines)


def extracted(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """pages with one more column, the visible text."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([text_of(p) for p in batch], dtype=object)

    return pages.withColumn(out, texts(F.col(html_col)))


def op8_layout(pages: DataFrame) -> DataFrame:
    return extracted(pages.select("page_id", "html"), out="__text").select("page_id", F.col("__text").alias("text"), F.char_length("__text").cast("long").alias("n_chars"))
