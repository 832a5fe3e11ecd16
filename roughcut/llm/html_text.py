"""Layout-aware page text: a tree builder with implied tags, and a renderer of what is visible."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed facts of HTML: elements without content, with raw content, of block
# layout, and never shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre section summary table tbody td tfoot th thead tr ul xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure article section".split())
HIDDEN = frozenset("head script style template title iframe noembed noframes datalist audio video "
                   "canvas object meta link".split())
#: Never shown inside SVG and inside MathML, and the start tags that end both.
HIDDEN_IN = {"svg": frozenset({"title", "desc", "defs", "metadata"}),
             "math": frozenset({"annotation", "annotation-xml"})}
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing "
    "menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Elements of SVG and MathML that stand apart from what is beside them.
APART = frozenset("text foreignobject mfrac mtr mtd".split())
CLOSES_P = BLOCK - {"html", "body", "caption", "dd", "dt", "legend", "li", "optgroup", "option",
                    "tbody", "td", "tfoot", "th", "thead", "tr"} | {"li", "dd", "dt"}
#: An open element of the first set is closed by the start of the named one, unless
#: an element of the second set lies between.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
SCOPE = frozenset({"table", "td", "th", "caption", "template", "html"})
#: A column is padded to its widest cell, but no further than this many characters
#: (wider cells keep their whole text), and a colspan counts for so many columns at most.
#: Columns are aligned up to this width: a longer cell is shown whole, and what follows it
#: in its row moves to the right. A cell spans at most so many columns.
PAD_LIMIT = 40
SPAN_LIMIT = 100
#: Lists and quotes nested deeper are shown at this depth's indent (two blanks a level).
INDENT_LIMIT = 16

_TOKEN = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)|<[!?/]")
_ATTR = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_NOT_SHOWN = re.compile(r"(?<![\w-])display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(visible|initial|hidden|collapse)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")
_RAW_END = {name: re.compile(f"</{name}(?=[\\s/>]|$)", re.I | re.A) for name in RAW}


def tokens(page: str) -> Iterator[tuple]:
    """``("text", s)``, ``("start", name, attributes, closed)`` and ``("end", name)`` in page order.

    Comments, doctypes and processing instructions give nothing; an unclosed
    comment runs to the end. Raw elements give their content as one text token
    (entities stay as they are, but for textarea and title). ``closed`` says that a start
    tag inside SVG or MathML closes itself; elsewhere the slash means nothing.
    """
    at, n = 0, len(page)
    foreign = 0  # open svg and math elements
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            yield "text", unescape(page[at:])
            return
        if m.start() > at:
            yield "text", unescape(page[at:m.start()])
        at = m.end()
        if m[0] == "<!--":
            if page.startswith((">", "->"), at):
                end = page.index(">", at) + 1
            else:
                stop = page.find("-->", at)
                end = n if stop < 0 else stop + 3
            at = end
            continue
        if m[2] is None:
            stop = page.find(">", at)
            at = n if stop < 0 else stop + 1
            continue
        name, attributes, slash = m[2].lower(), {}, False
        while at < n and page[at] != ">":
            a = _ATTR.match(page, at)
            if a and a.end() > at:
                attributes.setdefault(a[1].lower(), next((v for v in a.groups()[1:] if v is not None), ""))
                at, slash = a.end(), False
            else:
                slash = page[at] == "/"
                at += 1
        if at >= n:
            return  # a tag that the page ends in
        at += 1
        if m[1]:
            foreign -= name in HIDDEN_IN and foreign > 0
            yield "end", name
            continue
        closed = slash and (foreign > 0 or name in HIDDEN_IN)
        foreign += name in HIDDEN_IN and not closed
        yield "start", name, attributes, closed
        if name in RAW and not closed:
            end = None if name == "plaintext" else _RAW_END[name].search(page, at)
            stop = end.start() if end else n
            raw = page[at:stop]
            yield "text", unescape(raw) if name in ("textarea", "title") else raw
            at = stop


def _hidden(name: str, attributes: dict[str, str]) -> bool:
    if name in HIDDEN or "hidden" in attributes:
        return True
    style = attributes.get("style")
    return bool(style and _NOT_SHOWN.search(style))


def _visible(attributes: dict[str, str], inherited: bool) -> bool:
    """The visibility that an element sets, or else inherits."""
    said = _VISIBILITY.findall(attributes.get("style") or "")
    return said[-1].lower() in ("visible", "initial") if said else inherited


class _Flow:
    """Lines of text being laid out: collapses white space, keeps block distances."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.breaks = 0  # line ends owed before the next text
        self.empty = True  # nothing on this line yet
        self.space = False  # a collapsed space is owed
        self.level = 0
        self.marker = ""

    def shift(self, by: int) -> None:
        self.level = max(self.level + by, 0)

    def block(self, lines: int) -> None:
        if self.parts:
            self.breaks = max(self.breaks, lines)
        self.empty, self.space = True, False

    def line(self) -> None:
        if self.parts:
            self.breaks = self.breaks + 1 if self.empty and self.breaks else max(self.breaks, 1)
        self.empty, self.space = True, False

    def _start(self) -> None:
        if self.breaks:
            self.parts.append("\n" * self.breaks)
            self.breaks = 0
        if self.empty:
            self.parts.append("  " * min(self.level, INDENT_LIMIT))
            if self.marker:
                self.parts.append(self.marker)
                self.marker = ""
        elif self.space:
            self.parts.append(" ")
        self.empty = self.space = False

    def text(self, s: str) -> None:
        words = _SPACE.sub(" ", s)
        core = words.strip(" ")
        if words[:1] == " " and not self.empty:
            self.space = True
        if core:
            self._start()
            self.parts.append(core)
            self.space = words[-1] == " "

    def verbatim(self, s: str) -> None:
        for i, part in enumerate(s.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if i:
                self.breaks += 1 if self.parts else 0
                self.empty, self.space = True, False
            if part:
                self._start()
                self.parts.append(part)

    def lines(self, rows: list[str]) -> None:
        for row in rows:
            self._start()
            self.parts.append(row)
            self.breaks, self.empty = 1, True

    def done(self) -> str:
        return "".join(self.parts).rstrip(" \n")


class _Table:
    def __init__(self, outer: _Flow, aligned: bool = True) -> None:
        self.outer = outer
        self.aligned = aligned
        self.rows: list[list[tuple[str, int]]] = []
        self.span = 1
        self.cell: _Flow | None = None

    def close_cell(self) -> None:
        if self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append((self.cell.done(), self.span))
            self.cell = None

    def render(self) -> list[str]:
        widths: dict[int, int] = {}
        grid = []
        for row in self.rows:
            cells, column = [], 0
            for text, span in row:
                lines = text.split("\n")
                if span == 1:
                    widest = max(map(len, lines))
                    widths[column] = max(widths.get(column, 0), min(widest, PAD_LIMIT))
                cells.append((column, lines))
                column += span
            if cells:
                grid.append(cells)
        starts, at = {}, 0
        for column in range(max((c for row in grid for c, _ in row), default=-1) + 1):
            starts[column] = at if self.aligned else 0
            at += widths.get(column, 0) + 2 if column in widths else 0
        out = []
        for row in grid:
            for k in range(max(len(lines) for _, lines in row)):
                line = ""
                for column, lines in row:
                    if k < len(lines) and lines[k]:
                        gap = starts[column] - len(line)
                        line += " " * (gap if gap > 0 else 2 if line else 0) + lines[k]
                out.append(line.rstrip())
            while len(out) > 1 and not out[-1]:
                out.pop()
        return [r for i, r in enumerate(out) if r or 0 < i < len(out) - 1]


def render(page: str | None) -> str:
    """All visible text of a page.

    Start tags close what they imply (paragraphs, items, cells, rows); end tags
    close what is open inside them and are ignored when nothing matches. Hidden
    are the head, scripts, styles, templates, embedded documents, and elements
    with the ``hidden`` attribute or an inline ``display:none``, each with all it
    holds; an inline ``visibility`` holds for what is inside until it is set again.
    Formulas (MathML) and the ``text`` and ``foreignObject`` elements of SVG show
    their text; titles, descriptions, definitions, metadata and annotations in them
    do not. Paragraphs, headings, lists and
    tables stand apart by an empty line, other blocks begin lines, items are
    marked and indented, preformatted text keeps its white space, and the cells
    of a table are aligned in columns. All visible text is shown; only white space is
    bounded: columns align up to :data:`PAD_LIMIT` characters, a cell spans up to
    :data:`SPAN_LIMIT` columns, lists and quotes indent and tables in tables align up
    to :data:`INDENT_LIMIT` levels, so the text grows no faster than the page. A null or empty page gives the
    empty string.
    """
    if not page:
        return ""
    flow = _Flow()
    # open elements, whether each hides its content, and what was visible and in force around it
    stack: list[tuple[str, bool, bool, str]] = []
    tables: list[_Table] = []
    counters: list[int | None] = []  # open lists: next number, None if without
    hidden = pre = 0
    visible = True
    inside = ""  # "svg", "text" (of it) or "math"; empty in HTML
    where: dict[str, int] = {}  # how many of each name are open

    def pop() -> None:
        nonlocal flow, hidden, pre, visible, inside
        name, hides, visible, inside = stack.pop()
        if inside and name in APART and not hidden:
            flow.text(" ")
        where[name] -= 1
        hidden -= hides
        if name == "pre":
            pre -= 1
        if name in ("ul", "ol", "menu", "dir"):
            counters.pop()
            flow.shift(-1)
        elif name in ("dd", "blockquote"):
            flow.shift(-1)
        if name in ("td", "th") and tables and tables[-1].cell is flow:
            tables[-1].close_cell()
            flow = tables[-1].outer
        elif name == "table" and tables:
            t = tables.pop()
            t.close_cell()
            flow = t.outer
            flow.block(2)
            flow.lines(t.render())
            flow.block(2)
        elif name in BLOCK:
            flow.block(2 if name in SPACED and not (name in ("ul", "ol") and counters) else 1)
            if name == "li":
                flow.marker = ""

    def close(names: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> None:
        if not any(where.get(x) for x in names):
            return
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in until:
                return
            if stack[depth][0] in names:
                del_to = depth
                while len(stack) > del_to:
                    pop()

    for token in tokens(page):
        if token[0] == "text":
            if not hidden and visible and inside != "svg":
                if pre:
                    flow.verbatim(token[1])
                else:
                    flow.text(token[1])
            continue
        name = token[1]
        if token[0] == "end":
            if name == "br":
                flow.line()
            elif name == "p" and not where.get("p"):
                flow.block(2)
            elif where.get(name):
                stop = SCOPE - {name} if name not in ("table", "body", "html") else frozenset()
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == name:
                        while len(stack) > depth:
                            pop()
                        break
                    if stack[depth][0] in stop:
                        break
            continue
        if inside and (name in BREAKS_OUT or name == "font" and not token[2].keys().isdisjoint(
                ("color", "face", "size"))):
            while inside:
                pop()
        if name in IMPLIED_END:
            close(*IMPLIED_END[name])
        if name in CLOSES_P:
            close({"p"}, SCOPE | {"button"})
        if name in BLOCK and where.get("head") and not where.get("body") and name != "html":
            close({"head"}, frozenset())
        if name in VOID:
            if not hidden and visible and not _hidden(name, token[2]):
                if name == "br":
                    flow.line()
                elif name == "hr":
                    flow.block(1)
                elif name == "wbr":
                    pass
            continue
        if name == "tr" and tables and not hidden:
            tables[-1].close_cell()
            flow = tables[-1].outer
            tables[-1].rows.append([])
        elif name in BLOCK and name not in ("td", "th", "html", "body"):
            flow.block(2 if name in SPACED and not (name in ("ul", "ol") and counters) else 1)
        if inside and not hidden and (name in APART or stack[-1][0] == "mfrac"):
            flow.text(" ")
        if token[3]:
            continue
        kind = "svg" if inside == "text" else inside
        hides = _hidden(name, token[2]) or name in HIDDEN_IN.get(kind, ())
        stack.append((name, hides, visible, inside))
        visible = _visible(token[2], visible)
        if name in HIDDEN_IN:
            inside = name
        elif inside == "svg" and name == "text":
            inside = "text"
        elif (kind, name) in (("svg", "foreignobject"), ("svg", "desc"), ("math", "annotation-xml")):
            inside = ""  # HTML again
        where[name] = where.get(name, 0) + 1
        hidden += hides
        if name == "table":
            tables.append(_Table(flow, len(tables) < INDENT_LIMIT))
        elif name in ("td", "th") and tables:
            t = tables[-1]
            t.close_cell()
            span = token[2].get("colspan", "1").strip()
            t.span = min(max(int(span), 1), SPAN_LIMIT) if span.isascii() and span.isdigit() and len(span) < 9 else 1
            t.cell = flow = _Flow()
        elif name in ("ul", "ol", "menu", "dir"):
            start = token[2].get("start", "1").strip()
            counters.append(None if name != "ol" else
                            int(start) if start.isascii() and start.isdigit() and len(start) < 9 else 1)
            flow.shift(1)
        elif name in ("dd", "blockquote"):
            flow.shift(1)
        elif name == "li" and not hidden:
            if counters and counters[-1] is not None:
                flow.marker = f"{counters[-1]}. "
                counters[-1] += 1
            else:
                flow.marker = "- "
            if not visible:
                flow.marker = ""
        elif name == "pre":
            pre += 1
    while stack:
        pop()
    return flow.done()


def page_text(html: Column) -> Column:
    """Visible text of a column of pages."""
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([render(p) for p in batch], dtype=object)
    return run(html)


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``page_id, text, n_chars``.

    The whole page is parsed, each on its own; there is no shuffle. A null or
    empty page gives the empty text. Repeated rows give equal rows, a null id
    stays null, an empty table gives an empty result; other columns are not read.
    """
    got = pages.select(F.col(id_col).alias("page_id"), page_text(F.col(html_col)).alias("text"))
    return got.withColumn("n_chars", F.length("text").cast("long"))
