"""Layout-aware text of HTML pages.

A tokenizer feeds a tree builder that closes implied tags (a paragraph before a
block, a list item before the next one, cells and rows), and a renderer walks the
tree: hidden elements give nothing, every other text is emitted once, blocks are
set apart (a blank line around paragraphs, headings, lists and tables), list items
are marked and indented, preformatted text is kept, and table cells, spanning ones too,
stand in columns.  A table that holds another is taken as layout: its cells follow one
another as blocks.

Parsing and rendering keep their own stacks, so elements nest to any depth, and take
time in proportion to the page.  Layout may add to a line no more than ``MAX_INDENT``
characters of indent and ``MAX_PAD`` before a cell (cells wider than ``MAX_WIDTH`` don't
widen their column), so a text is never many times its page; no text is lost to that.

Defined results: null and empty pages give an empty text; unclosed comments, tags
and raw elements reach to the end of the page; repeated rows are each rendered; an
empty table of pages gives an empty result; a column named like the result is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import schema_with

MAX_INDENT, MAX_WIDTH, MAX_PAD = 64, 60, 240

# Fixed sets of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes object audio video canvas svg math datalist".split())
BLOCK = frozenset("address article aside body center dd details dialog div dl dt fieldset figcaption figure footer form header hgroup html legend li main menu nav option optgroup search section select summary tbody td tfoot th thead tr".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul xmp".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = BLOCK - frozenset("option optgroup select td th tr tbody thead tfoot html body".split()) | SPACED

#: A start tag of the key closes open elements of the first set, up to one of the second.
IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "table"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "tr": (frozenset({"tr", "td", "th", "caption"}), frozenset({"table"})),
    "td": (frozenset({"td", "th", "caption"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th", "caption"}), frozenset({"tr", "table"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}), frozenset({"table"})),
    "thead": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}), frozenset({"table"})),
    "tfoot": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}), frozenset({"table"})),
    "body": (frozenset({"head"}), frozenset()),
}
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_QUOTE_OR_END = re.compile(r"""["'>]""")


_CELL = frozenset({"td", "th", "caption"})
_TABLE_PART = frozenset("table tr tbody thead tfoot td th caption body html".split())
_STOPS_P = frozenset("table td th button caption".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "layout")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []
        self.layout = False  # a table that holds a table


class _Open:
    """Open elements, root first, and where those of each name are.

    What is open is asked by name, so no end tag walks the whole stack.  An element
    taken out from the middle leaves a gap (None); only formatting ones are."""

    def __init__(self, root: Node):
        self.stack: list[Node | None] = [root]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    @property
    def top(self) -> Node:
        return self.stack[-1]

    def last(self, tag: str) -> int:
        found = self.at.get(tag)
        return found[-1] if found else 0

    def push(self, node: Node) -> None:
        if node.tag == "table" and (outer := self.last("table")):
            self.stack[outer].layout = True
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK or node.tag in SPACED:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def cut(self, i: int) -> None:
        """Close the element at ``i`` and all above it."""
        while len(self.stack) > i or self.stack[-1] is None:
            node = self.stack.pop()
            if node is not None:
                self.at[node.tag].pop()
                if node.tag in BLOCK or node.tag in SPACED:
                    self.blocks.pop()

    def take(self, i: int) -> None:
        """Close the last element of its name, at ``i``, and leave those above it open."""
        self.at[self.stack[i].tag].pop()
        self.stack[i] = None

    def imply(self, tag: str) -> None:
        """Close what a start tag ends."""
        if tag in CLOSES_P:
            p = self.last("p")
            if p > max(map(self.last, _STOPS_P)):
                self.cut(p)
        if tag in IMPLIED:
            closes, scope = IMPLIED[tag]
            limit = max(map(self.last, scope), default=0)
            first = [found[i] for x in closes if (found := self.at.get(x)) and (i := bisect_right(found, limit)) < len(found)]
            if first:
                self.cut(min(first))

    def close(self, tag: str) -> None:
        i = self.last(tag)
        if not i:
            if tag == "p":
                self.top.children.append(Node("p"))
            return
        block = tag in BLOCK or tag in SPACED
        crossed = bool(self.blocks) and self.blocks[-1] > i
        if crossed and not block and tag not in FORMATTING:
            return
        # a cell keeps what is closed inside it from closing what is around the table
        if tag not in _TABLE_PART and max(map(self.last, _CELL)) > i:
            return
        if crossed and not block:
            # blocks opened inside a formatting element outlive it
            self.take(i)
        else:
            self.cut(i)


def _tag_end(html: str, at: int, missing: set[str]) -> int:
    """Position of the ``>`` that ends the tag at ``at``; quoted ones don't count."""
    first = -1
    while m := _QUOTE_OR_END.search(html, at):
        if m[0] == ">":
            return m.start()
        if first < 0:
            first = m.start()
        close = -1 if m[0] in missing else html.find(m[0], m.end())
        if close < 0:  # an unclosed quote is an ordinary character
            missing.add(m[0])
            return html.find(">", first)
        at = close + 1
    return -1


def parse(html: str) -> Node:
    root = Node("#root")
    stack = _Open(root)
    at, n = 0, len(html)
    missing: set[str] = set()
    lower = None
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            stack.top.children.append(html[at:lt])
            at = lt
            continue
        if html.startswith("<!--", at):
            end = html.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), at):
            end = html.find(">", at)
            at = n if end < 0 else end + 1
            continue
        closing = html.startswith("</", at)
        m = _NAME.match(html, at + 1 + closing)
        if not m:
            if closing:  # a bogus comment
                end = html.find(">", at)
                at = n if end < 0 else end + 1
            else:
                stack.top.children.append("<")
                at += 1
            continue
        end = _tag_end(html, m.end(), missing)
        tag = m[0].lower()
        rest = html[m.end() : n if end < 0 else end]
        at = n if end < 0 else end + 1
        if closing:
            stack.close(tag)
            continue
        attrs = {a[1].lower(): unescape(a[2] or a[3] or a[4] or "") for a in reversed(list(_ATTR.finditer(rest)))} if rest.strip(" /\n\t") else {}
        stack.imply(tag)
        node = Node(tag, attrs)
        stack.top.children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            if lower is None:
                lower = html.lower() if len(html.lower()) == len(html) else html
            stop = lower.find(f"</{tag}", at)
            node.children.append(html[at : n if stop < 0 else stop])
            if stop < 0:
                break
            end = html.find(">", stop)
            at = n if end < 0 else end + 1
            continue
        stack.push(node)
    return root


def _hidden(node: Node) -> bool:
    a = node.attrs
    if node.tag in HIDDEN or "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden") or (node.tag == "dialog" and "open" not in a):
        return True
    return "style" in a and bool(re.search(r"(?:^|;)\s*display\s*:\s*none", a["style"], re.IGNORECASE))


class _Out:
    """Lines of text with collapsed spaces; breaks are pending until text follows.

    Containers (list items, quotes) indent what is inside them; the mark of an item stands
    before its first line.  Breaks at the very begin or end of a container add nothing."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.fresh = self.pre = False
        self.gap = 0
        self.indent = ""
        self.mark: str | None = None
        self.blank: list[str] = []  # blank lines of preformatted text, kept if text follows

    def _put(self, s: str) -> None:
        if self.gap and self.lines:
            self.lines += [""] * (self.gap - 1)
        self.gap = 0
        if self.blank:
            if not self.fresh:
                self.lines += self.blank
            self.blank = []
        self.lines.append((self.indent if self.mark is None else self.mark) + s)
        self.mark, self.fresh = None, False

    def _end(self) -> None:
        if self.line:
            s = "".join(self.line)
            self.line = []
            if self.pre and not s.strip():
                self.blank.append(s)
            else:
                self._put(s)

    def text(self, s: str) -> None:
        if self.pre:
            parts = s.replace("\r\n", "\n").split("\n")
            for i, part in enumerate(parts):
                if i:
                    if self.line:
                        self._end()
                    else:
                        self.blank.append("")
                if part:
                    self.line.append(part)
            return
        s = _SPACE.sub(" ", s)
        if not s:
            return
        if s == " ":
            self.space = True
            return
        if self.line and (self.space or s[0] == " "):
            self.line.append(" ")
        self.line.append(s.strip(" "))
        self.space = s[-1] == " "

    def brk(self, n: int = 1) -> None:
        self._end()
        self.space = False
        if not self.fresh:
            self.gap = max(self.gap, n)

    def hard(self) -> None:
        if self.line:
            self._end()
            self.gap = max(self.gap, 1)
        elif self.lines and not self.fresh:
            self.gap = min(2, self.gap + 1)
        self.space = False

    def enter(self, gap: int, mark: str, pad: str) -> tuple:
        """Open a container whose first line begins with ``mark``, the others with ``pad``."""
        self.brk(gap)
        before = (self.indent, self.mark, self.fresh, len(self.lines), gap)
        if len(self.indent) < MAX_INDENT:
            if mark:
                self.mark = (self.indent if self.mark is None else self.mark) + mark if len(self.mark or "") < MAX_INDENT else self.mark
            elif self.mark is not None:
                self.mark += pad
            self.indent += pad
        self.fresh = True
        return before

    def leave(self, before: tuple) -> None:
        self._end()
        self.space = False
        self.indent, mark, fresh, n, gap = before
        if len(self.lines) > n:
            self.gap, self.mark, self.fresh = gap, None, False
        else:
            self.mark, self.fresh = mark, fresh

    def block(self, lines: list[str], gap: int) -> None:
        if lines:
            self.brk(gap)
            for line in lines:
                if line:
                    self._put(line)
                else:
                    self.lines.append("")
            self.gap = gap

    def done(self) -> list[str]:
        self._end()
        return self.lines


_START = re.compile("-?[0-9]{1,9}")
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(\w+)", re.IGNORECASE)
_SHOWN_INPUTS = frozenset("text submit button reset search email tel url number".split())


def _walk(root: Node, out: _Out, shown: bool) -> None:
    """Render what is inside ``root``; a frame is [node, its children, shown, number of the
    next list item, what is to be done at its end]."""
    def frame(node: Node, visible: bool, finish=None) -> list:
        number = None
        if node.tag == "ol":
            start = node.attrs.get("start", "1").strip()
            number = int(start) if _START.fullmatch(start) else 1
        return [node, iter(node.children), visible, number, finish]

    frames = [frame(root, shown)]
    while frames:
        at = frames[-1]
        node, children, shown, number, finish = at
        child = next(children, None)
        if child is None:
            frames.pop()
            if finish is not None:
                finish()
            continue
        if isinstance(child, str):
            if shown:
                out.text(unescape(child) if "&" in child else child)
            continue
        if _hidden(child):
            continue
        tag, visible = child.tag, shown
        if "style" in child.attrs and (m := _VISIBILITY.search(child.attrs["style"])):
            visible = m[1].lower() == "visible"
        if tag == "br":
            out.hard()
            continue
        if tag == "table" and not child.layout:
            out.block(_table(child, visible), 2)
            continue
        if tag == "input":
            if visible and child.attrs.get("value") and child.attrs.get("type", "text").lower() in _SHOWN_INPUTS:
                out.text(child.attrs["value"])
            continue
        end = None
        if tag in ("pre", "xmp") and not out.pre:
            before = out.enter(1 if node.tag == "li" else 2, "", "")
            out.pre = True

            def end(before=before):
                out._end()
                out.pre, out.blank = False, []
                out.leave(before)
        elif tag in ("ul", "ol", "menu", "dl", "blockquote", "li", "dd"):
            mark, pad, gap = "", "", 1 if node.tag == "li" or tag in ("li", "dd") else 2
            if tag == "li":
                mark = "- "
                if number is not None:
                    mark = f"{number}. "
                    at[3] += 1
                pad = " " * len(mark)
            elif tag in ("blockquote", "dd"):
                pad = "  "
            before = out.enter(gap, mark, pad)

            def end(before=before):
                out.leave(before)
        elif tag in SPACED or tag in BLOCK:
            gap = 2 if tag in SPACED else 1
            out.brk(gap)

            def end(gap=gap):
                out.brk(gap)
        frames.append(frame(child, visible, end))


def _span(cell: Node, name: str, most: int) -> int:
    value = cell.attrs.get(name, "1").strip()
    return min(most, int(value)) if re.fullmatch("[0-9]{1,9}", value) else 1


def _cells(node: Node, rows: list, shown: bool, group: int) -> list[str]:
    """Rows, as (group, [(lines, columns, rows spanned)]), of a table; returns lines of what is not in a cell."""
    odd: list[str] = []
    loose = Node("#loose")
    for child in node.children:
        if isinstance(child, str):
            loose.children.append(child)
        elif _hidden(child):
            continue
        elif child.tag in ("thead", "tbody", "tfoot", "tr"):
            if child.tag == "tr":
                rows.append((group, []))
                odd += _cells(child, rows, shown, group)
            else:
                odd += _cells(child, rows, shown, id(child))
        elif child.tag in ("td", "th"):
            if not rows or rows[-1][0] != group:
                rows.append((group, []))
            visible = shown
            if "style" in child.attrs and (m := _VISIBILITY.search(child.attrs["style"])):
                visible = m[1].lower() == "visible"
            inner = _Out()
            _walk(child, inner, visible)
            rows[-1][1].append((inner.done(), max(1, _span(child, "colspan", 1000)), _span(child, "rowspan", 65534)))
        else:
            loose.children.append(child)
    if loose.children:
        inner = _Out()
        _walk(loose, inner, shown)
        odd += inner.done()
    return odd


def _placed(rows: list) -> list[list[tuple[int, int, list[str]]]]:
    """(column, columns, lines) of the cells of each row: a cell that spans rows keeps its
    columns from those below, up to the end of its group; 0 rows are all."""
    out, taken, group = [], [], None  # taken: (from, to, last row)
    for y, (of, cells) in enumerate(rows):
        if of != group:
            taken, group = [], of
        taken = [t for t in taken if t[2] >= y]
        x, k, row, more = 0, 0, [], []
        for lines, wide, high in cells:
            while k < len(taken) and taken[k][0] <= x:
                x = max(x, taken[k][1])
                k += 1
            row.append((x, wide, lines))
            if high != 1:
                end = y + high - 1 if high else len(rows)
                if more and more[-1][1:] == (x, end):  # side by side, and ending together
                    more[-1] = (more[-1][0], x + wide, end)
                else:
                    more.append((x, x + wide, end))
            x += wide
        taken = sorted(taken + more) if more else taken
        out.append(row)
    return out


def _table(node: Node, shown: bool) -> list[str]:
    rows: list[tuple[int, list[tuple[list[str], int, int]]]] = []
    out = _cells(node, rows, shown, 0)
    placed = _placed(rows)
    width: dict[int, int] = {}
    for row in placed:
        for x, wide, lines in row:
            if wide == 1:
                width[x] = max([width.get(x, 0), *(n for n in map(len, lines) if n <= MAX_WIDTH)])
    columns = sorted(width)
    upto = [0, *accumulate(width[x] for x in columns)]
    for row in placed:
        high = max((len(lines) for _, _, lines in row), default=0)
        parts: list[list[str]] = [[] for _ in range(high)]
        size = [0] * high
        for x, _, lines in row:
            start = upto[bisect_left(columns, x)] + 3 * x
            for i in range(max(len(lines), min(1, high))):
                s = lines[i] if i < len(lines) else ""
                if x:
                    pad = min(MAX_PAD, max(0, start - 3 - size[i]))
                    parts[i] += [" " * pad, " | "]
                    size[i] += pad + 3
                parts[i].append(s)
                size[i] += len(s)
        out += ["".join(p).rstrip() for p in parts]
    return out


def render(html: str | None) -> str:
    """The visible text of a page."""
    if not html:
        return ""
    out = _Out()
    _walk(parse(html.replace("\x00", "")), out, True)
    return "\n".join(out.done()).strip("\n")


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with ``out_col``, the visible text, in place of ``html_col``."""
    keep = [c for c in pages.columns if c not in (html_col, out_col)]
    given = pages.select(*keep, F.col(html_col).cast("string").alias("_tm_html"))

    def run(batches):
        for batch in batches:
            got = [render(x.as_py()) for x in batch.column("_tm_html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(got, pa.string())], [*keep, out_col])

    return given.mapInArrow(run, schema_with(given, keep, f"`{out_col}` string"))
