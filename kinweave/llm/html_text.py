"""Visible text of HTML pages, laid out: tree building with implied tags, visibility rules, blocks, lists and tables."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A comment, a declaration, or a tag; quoted attribute values may hold >. Atomic, so no text makes it backtrack.
_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]++|=\s*+(?>"[^"]*+"|'[^']*+')?)*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_NO_SHOW = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*([a-z]+)", re.I)

_words = lambda s: frozenset(s.split())
_VOID = _words("area base br col embed hr img input link meta param source track wbr")
#: Their content is raw text up to the end tag.
_RAW = _words("script style textarea title xmp iframe noembed noframes noscript plaintext")
_HIDDEN = _words("head script style title template noscript iframe noembed noframes object video audio canvas datalist map")
#: Hidden inside svg and math only: what browsers don't display, or not in its place.
_UNSEEN = _words("defs metadata desc annotation annotation-xml symbol clippath mask pattern marker")
_HEAD = _words("base basefont bgsound head html link meta noframes noscript script style template title")
#: Blocks with a blank line around them, and blocks that only start and end a line.
_SPACED = _words("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure menu dir xmp hr fieldset listing")
_BLOCK = _SPACED | _words("address article aside body center details dialog dd div dt figcaption footer form header hgroup html legend li main nav optgroup option search section summary caption")
_ENDS_P = _BLOCK - _words("body html option optgroup legend caption")
_HEADINGS = _words("h1 h2 h3 h4 h5 h6")
#: What an element closes when it starts, and the elements beyond which it looks no further.
_CLOSES = {
    "li": (_words("li"), _words("ul ol menu dir")),
    "dt": (_words("dt dd"), _words("dl")),
    "dd": (_words("dt dd"), _words("dl")),
    "option": (_words("option"), _words("select datalist")),
    "optgroup": (_words("option optgroup"), _words("select")),
    "tr": (_words("tr td th caption colgroup"), _words("table")),
    "td": (_words("td th caption colgroup"), _words("tr table")),
    "th": (_words("td th caption colgroup"), _words("tr table")),
    "thead": (_words("thead tbody tfoot tr td th caption colgroup"), _words("table")),
    "tbody": (_words("thead tbody tfoot tr td th caption colgroup"), _words("table")),
    "tfoot": (_words("thead tbody tfoot tr td th caption colgroup"), _words("table")),
    "caption": (_words("caption colgroup"), _words("table")),
    "colgroup": (_words("caption colgroup"), _words("table")),
}
_TABLE_PARTS = _words("table thead tbody tfoot tr colgroup")
_SCOPE = _words("table td th caption html template button object")
_LISTS = _words("ol ul menu dir")
#: Greatest spans of a cell, as HTML has them.
_COLUMNS, _ROWS = 1000, 65534
#: Lines aren't indented further than this, so that deep lists don't take the square of their depth.
_INDENT = 200
#: Blanks that a table may be padded with: so many, and so many times its own text.
_BLANKS, _BLANKS_SHARE = 1 << 16, 16


class _Box:
    """Lines of finished text, and the line being written. A list item is one entry of lines: its marker and its own lines."""

    __slots__ = ("lines", "inline", "gap")

    def __init__(self) -> None:
        self.lines: list[str | tuple[str, list]] = []
        self.inline: list[str] = []
        self.gap = 0

    def flush(self) -> None:
        if not self.inline:
            return
        text = "".join(self.inline)
        self.inline = []
        # \1 stands for a line break, \2 to \3 for what keeps its white space.
        if "\2" not in text:
            lines = [_SPACE.sub(" ", x).strip(" ") for x in text.split("\1")]
            if not any(lines):
                return
        else:
            lines = [x.rstrip() for x in text.replace("\2", "").replace("\3", "").replace("\1", "\n").split("\n")]
            if not any(lines):
                return
            while lines and not lines[0]:
                lines.pop(0)
        while lines and not lines[-1]:
            lines.pop()
        self.add(lines)

    def edge(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)

    def add(self, lines: list) -> None:
        if self.lines and self.gap:
            self.lines.append("")
        self.gap = 0
        self.lines += lines

    def done(self) -> list:
        self.flush()
        return self.lines


def _flat(lines: list) -> list[str]:
    """Lines with the markers and indentation of list items."""
    out: list[str] = []
    # Iterators over lines, the prefix of the next line and that of the lines after it.
    stack = [[iter(lines), "", ""]]
    while stack:
        top = stack[-1]
        line = next(top[0], None)
        if line is None:
            stack.pop()
        elif isinstance(line, str):
            out.append(top[1] + line if line else "")
            top[1] = top[2]
        else:
            marker, own = line
            stack.append([iter(own), top[1] + marker, (top[2] + " " * len(marker))[:_INDENT]])
            top[1] = top[2]
    return out


#: A table cell: its lines, and how many columns and rows it takes (0 rows: all that follow).
_Cell = tuple[list[str], int, int]


class _Open:
    """An open element: its name and number, whether it hides its content, whether that is visible, and what it builds."""

    __slots__ = ("name", "no", "hides", "visible", "gone", "box", "rows", "cells", "count", "span", "down")

    def __init__(self, name: str, no: int, hides: bool, visible: bool):
        self.name, self.no, self.hides, self.visible, self.gone = name, no, hides, visible, False
        self.box: _Box | None = None
        self.rows: list[list[_Cell]] | None = None
        self.cells: list[_Cell] | None = None
        self.count, self.span, self.down = 0, 1, 1


def _number(text: str | None, other: int, most: int = 1000) -> int:
    try:
        return min(most, max(-most, int(text or other)))
    except ValueError:
        return other


class _Page:
    def __init__(self) -> None:
        root = _Open("html", 0, False, True)
        root.box = _Box()
        self.open = [root]
        self.boxes = [root.box]
        self.hidden = self.number = 0
        #: The open elements of each name, innermost last: nothing is sought in the whole stack.
        self.named: defaultdict[str, list[_Open]] = defaultdict(list)

    # -- tree building ------------------------------------------------------------------------------------------
    def start(self, name: str, attrs: dict[str, str]) -> None:
        if name == "html":
            return
        if name == "body" or name not in _HEAD:
            self._leave_head()
        if name == "body":
            return
        if name in _ENDS_P:
            self._end_in_scope("p")
        if name in _HEADINGS and self.open[-1].name in _HEADINGS:
            self._pop()
        if name in _CLOSES:
            self._close(*_CLOSES[name])
            if name in ("td", "th"):
                if self.open[-1].name not in ("tr",) and self.named["table"]:
                    self._push("tr", {})
            elif name in ("tr", "thead", "tbody", "tfoot", "caption", "colgroup") and not self.named["table"]:
                return
            if name in ("td", "th") and self.open[-1].name != "tr":
                return
        if name == "br":
            self._text("\1")
        elif name == "hr":
            self._edge(1)
        elif name == "input" and attrs.get("type", "").lower() in ("submit", "button", "reset") and attrs.get("value"):
            self.text(" " + attrs["value"] + " ")
        elif name not in _VOID:
            if name == "text" and self.named["svg"]:
                # Labels stand apart.
                self._text(" ")
            self._push(name, attrs)

    def end(self, name: str) -> None:
        if name == "br":
            self._text("\1")
        elif not self.named[name] and name not in _HEADINGS:
            return
        elif name in ("html", "body"):
            return
        elif name == "p":
            self._end_in_scope("p")
        elif name in _HEADINGS:
            self._end_in_scope(*_HEADINGS)
        elif name in _BLOCK or name in _TABLE_PARTS or name in ("td", "th", "head", "select", "button", "template", "svg", "math"):
            stop = _words("table") if name in ("tr", "td", "th", "thead", "tbody", "tfoot", "caption") else frozenset() if name in ("table", "template", "head") else _SCOPE - {name}
            self._pop_within((name,), stop)
        else:
            # Inline: ends alone, whatever blocks opened inside it stay open.
            own, stop = self._innermost((name,)), self._innermost(("td", "th", "table", "caption"))
            if own is None or stop is not None and stop.no > own.no:
                return
            own.gone = True
            self.named[name].pop()
            self.hidden -= own.hides
            while self.open[-1].gone:
                self.open.pop()

    def _foreign(self) -> bool:
        return bool(self.named["svg"] or self.named["math"])

    def _leave_head(self) -> None:
        if len(self.open) > 1 and self.open[1].name == "head":
            while len(self.open) > 1:
                self._pop()

    def _innermost(self, names: Iterable[str]) -> _Open | None:
        return max((self.named[x][-1] for x in names if self.named.get(x)), key=lambda x: x.no, default=None)

    def _pop_within(self, names: Iterable[str], stop: Iterable[str]) -> bool:
        """End the innermost element of names, and all inside it, unless one of stop is between."""
        own = self._innermost(names)
        if own is None:
            return False
        bar = self._innermost(stop)
        if bar is not None and bar.no > own.no:
            return False
        while not own.gone:
            self._pop()
        return True

    def _close(self, names: frozenset[str], stop: frozenset[str]) -> None:
        while self._pop_within(names, stop):
            pass

    def _end_in_scope(self, *names: str) -> None:
        self._pop_within(names, _SCOPE)

    # -- layout -------------------------------------------------------------------------------------------------
    def _push(self, name: str, attrs: dict[str, str]) -> None:
        style = attrs.get("style", "")
        hides = (
            name in _HIDDEN or self._foreign() and (name in _UNSEEN or attrs.get("display") == "none") or "hidden" in attrs and attrs["hidden"].lower() != "until-found" or bool(_NO_SHOW.search(style))
            or name == "dialog" and "open" not in attrs or bool(self.open[-1].name == "details" and self.open[-1].count and name != "summary")
        )
        # Visibility is inherited: what is visible again inside something invisible is seen.
        told = _VISIBILITY.findall(style) or [attrs.get("visibility", "") if self._foreign() else ""]
        visible = {"hidden": False, "collapse": False, "visible": True, "initial": True}.get(told[-1].lower(), self.open[-1].visible)
        self.number += 1
        own = _Open(name, self.number, hides, visible)
        if name == "details":
            own.count = int("open" not in attrs)
        if name in _SPACED and not (name in ("ul", "ol", "menu", "dir") and self.named["li"]):
            self._edge(1)
        elif name in _BLOCK:
            self._edge(0)
        if name in ("li", "td", "th", "caption"):
            own.box = _Box()
            self.boxes.append(own.box)
            own.span = max(1, _number(attrs.get("colspan"), 1, _COLUMNS))
            own.down = max(0, _number(attrs.get("rowspan"), 1, _ROWS))
        elif name == "table":
            own.rows = []
        elif name == "tr":
            own.cells = []
        elif name == "ol":
            own.count = _number(attrs.get("start"), 1, 10**9) - 1
        self.open.append(own)
        self.named[name].append(own)
        self.hidden += hides
        if name in ("pre", "textarea", "listing", "xmp"):
            self._text("\2")

    def _pop(self) -> None:
        own = self.open[-1]
        name = own.name
        if own.gone:
            self.open.pop()
            return
        if name in ("pre", "textarea", "listing", "xmp"):
            self._text("\3")
            self._edge(name != "textarea")
        self.open.pop()
        own.gone = True
        self.named[name].pop()
        while self.open[-1].gone:
            self.open.pop()
        hidden = self.hidden
        self.hidden -= own.hides
        if own.box is not None:
            lines = own.box.done()
            self.boxes.pop()
            if hidden:
                lines = []
            if name == "li":
                self._item(lines)
            elif name == "caption":
                if lines:
                    self.boxes[-1].add(lines)
            else:
                row = self._innermost(("tr", "table"))
                if row is not None and row.cells is not None:
                    row.cells.append((_flat(lines), own.span, own.down))
        elif name == "tr":
            table = self._innermost(("table",))
            if table is not None:
                table.rows.append(own.cells)
        elif name == "table":
            lines = _aligned(own.rows)
            self._edge(1)
            if lines:
                self.boxes[-1].add(lines)
            self._edge(1)
        elif name in _SPACED and not (name in _LISTS and self.named["li"]):
            self._edge(1)
        elif name in _BLOCK:
            self._edge(0)

    def _item(self, lines: list) -> None:
        parent = self._innermost(_LISTS)
        marker = "- "
        if parent is not None and parent.name == "ol":
            parent.count += 1
            marker = f"{parent.count}. "
        if lines:
            self.boxes[-1].add([(marker, lines)])

    def _edge(self, gap: int) -> None:
        if not self.hidden:
            self.boxes[-1].edge(gap)

    def _text(self, text: str) -> None:
        if not self.hidden and (self.open[-1].visible or text in ("\2", "\3")):
            self.boxes[-1].inline.append(text)

    def text(self, raw: str) -> None:
        if not raw:
            return
        blank = not raw.strip(" \t\n\f\r")
        if not blank:
            self._leave_head()
        top = self.open[-1]
        if self.hidden or not top.visible:
            return
        if blank and (top.name in _TABLE_PARTS or top.name == "html" and not self.boxes[-1].inline):
            return
        if top.name == "details" and top.count:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if "\1" in text or "\2" in text or "\3" in text:
            text = text.translate({1: None, 2: None, 3: None})
        # Text in a table but in none of its cells comes before the table.
        self.boxes[-1].inline.append(text)

    def result(self) -> str:
        while len(self.open) > 1:
            self._pop()
        return "\n".join(_flat(self.boxes[0].done()))


def _placed(rows: list[list[_Cell]]) -> tuple[list[list[tuple[int, int, list[str]]]], list[int]]:
    """Each row's cells as (first column, column after the last, lines), and the columns at which cells begin.

    A cell goes to the next columns that no cell from a row above still takes.
    """
    placed, taken, starts = [], [], set()
    for row in rows:
        # taken: (first column, column after the last, rows left or 0 for all), in order and apart.
        here, new, at, k = [], [], 0, 0
        for lines, span, down in row:
            while k < len(taken) and taken[k][0] < at + 1:
                at = max(at, taken[k][1])
                k += 1
            end = min(at + span, taken[k][0]) if k < len(taken) else at + span
            here.append((at, end, lines))
            starts.add(at)
            if down != 1:
                new.append((at, end, down and down))
            at = end
        placed.append(here)
        left = sorted([(a, b, n and n - 1) for a, b, n in taken if n != 1] + [(a, b, n and n - 1) for a, b, n in new])
        taken = []
        for a, b, n in left:
            if taken and taken[-1][1] == a and taken[-1][2] == n:
                taken[-1] = (taken[-1][0], b, n)
            else:
                taken.append((a, b, n))
    return placed, sorted(starts)


def _aligned(rows: list[list[_Cell]]) -> list[str]:
    """Rows with each column's cells starting at one place; cells of several lines take several lines.

    A column starts after the widest cell that ends there, of one column or of several. Where that takes more blanks
    than _BLANKS and _BLANKS_SHARE allow (a very long cell beside very many others), only the widest cells are let
    stick out, and what follows them in their own lines moves; with thousands of empty columns, none is aligned.
    """
    placed, starts = _placed(rows)
    if not starts:
        return []
    number = {c: k for k, c in enumerate(starts)}
    cells = [[(number[at], bisect_left(starts, end), lines) for at, end, lines in row] for row in placed]
    ends: list[list[tuple[int, int]]] = [[] for _ in range(len(starts) + 1)]
    text = 0
    for row in cells:
        for first, after, lines in row:
            ends[after].append((first, max(map(len, lines), default=0)))
            text += sum(map(len, lines))
    for widest in (None, 4096, 1024, 256, 64, 0):
        at = [0] * (len(starts) + 1)
        for k in range(1, len(at)):
            at[k] = max([at[k - 1] + 3, *(at[first] + 3 + (width if widest is None else min(width, widest)) for first, width in ends[k])])
        blanks = sum(at[max((first for first, _, lines in row if lines), default=0)] * max((len(lines) for *_, lines in row), default=0) for row in cells)
        if blanks <= _BLANKS + _BLANKS_SHARE * text:
            break
    else:
        at = [0] * (len(starts) + 1)
    out = []
    for row in cells:
        for k in range(max((len(lines) for *_, lines in row), default=0)):
            line, last, column = [], 0, 0
            for first, after, lines in row:
                # Columns that a row above still takes are empty here.
                for c in range(max(1, column), first + 1) if at[-1] else [first][: first > 0]:
                    line.append(" " * (at[c] - 3 - last) + " | ")
                    last = max(last + 3, at[c])
                column = after
                if k < len(lines):
                    line.append(lines[k])
                    last += len(lines[k])
            out.append("".join(line).rstrip(" |"))
    return out if any(out) else []


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        out.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return out


def visible_text(page: str | None) -> str:
    """The page's visible text as laid out; '' for null. Malformed markup never fails.

    Time grows with the length of the page and of the text laid out; tables within tables are laid out once a level.
    """
    if not page:
        return ""
    tree, at, n = _Page(), 0, len(page)
    while at < n:
        tag = page.find("<", at)
        if tag < 0:
            tree.text(page[at:])
            break
        m = _TOKEN.match(page, tag)
        if m is None:
            # A lone < is text, up to the next one.
            after = page.find("<", tag + 1)
            after = n if after < 0 else after
            tree.text(page[at:after])
            at = after
            continue
        tree.text(page[at:tag])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            tree.end(name)
            continue
        if m[3].endswith("/") and name not in _VOID and (name in ("svg", "math") or tree._foreign() and not tree.named["foreignobject"]):
            # An empty element: only svg and math have such.
            continue
        tree.start(name, _attributes(m[3]) if m[3] and m[3].strip() else {})
        if name in _RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at) if name != "plaintext" else None
            body = page[at : stop.start() if stop else n]
            if name in ("textarea", "xmp", "plaintext"):
                tree.text(body if name == "textarea" else body.replace("&", "&amp;"))
            tree.end(name)
            at = stop.end() if stop else n
    return tree.result()


def extract_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Visible text of every whole page; one row per input row: page_id, text, n_lines (long), n_chars (long).

    A tree builder closes what HTML leaves open (paragraphs before blocks, list items, table cells and rows, headings,
    the head) and adds missing rows. Not visible: scripts, styles, templates, the head, embedded media (of svg and math
    only definitions, descriptions and annotations; labels and formulas are text), elements with `hidden` or a style of display:none or (until one inside it is visible again) visibility:hidden, closed dialogs and details. White space collapses as in
    a browser except in pre and textarea; paragraphs, headings, lists and tables stand between blank lines, other
    blocks on lines of their own; list items have markers and indentation (of up to 200 characters), table cells start
    at the same column, also those of several columns or rows.
    Null and empty pages give '' with 0 lines. Repeated rows each get a result; an empty table gives an empty result;
    other columns are ignored.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(x.as_py()) for x in batch.column(1)]
            lines = [x.count("\n") + 1 if x else 0 for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "text", "n_lines", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    return rows.mapInArrow(extract, f"page_id {dict(rows.dtypes)['page_id']}, text string, n_lines long, n_chars long")
