"""Text of web pages as a reader sees it: a tree builder with implied tags, visibility rules, and a layout of blocks, lists and tables.

The builder reads tags in one forward scan. It closes what the next tag implies (p before a block, li before li, cells and rows of tables,
options, terms), adds the sections and rows that cells imply, puts what is misplaced in a table before it, ignores stray end tags, and
keeps script and style as raw text. A quote that is never closed ends with its tag at the next ">"; a tag without any ">" ahead is
dropped with what follows it, as browsers do. Open elements are found by their places in the stack, so depth costs nothing.

What is not shown is dropped: head, scripts, styles, templates, comments, closed dialogs, and elements with a hidden attribute or
with display:none. visibility is inherited and may be set back to visible inside. The layout puts blocks on lines of their own, a blank
line around paragraphs, headings, lists and tables, marks list items with bullets or numbers indented by depth, keeps preformatted
text, and pads table cells so that columns line up, with colspan and rowspan; wide characters count as two columns.

Bounds of the layout, so that its size stays in proportion to the page (text is never dropped): indents end at INDENT columns, padding of one
cell at CELL and of a line at WIDE, rowspan holds in the first SPANS columns, and tables nested beyond NEST are laid out row by row.

Defined cases: null or empty html gives an empty text; broken markup gives all its visible text; repeated rows keep a result each; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as _html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import ship

INDENT, CELL, WIDE, SPANS, NEST = 64, 80, 400, 200, 16
_NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes object video audio canvas datalist".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
CLOSES_P = BLOCK - frozenset("body dd dt html legend li optgroup option tbody td tfoot th thead tr summary".split())
SCOPE = frozenset("table td th caption html button".split())
SECTIONS = frozenset("thead tbody tfoot".split())
#: elements that hold only parts of a table
STRUCTURE = SECTIONS | {"table", "tr", "colgroup"}
PARTS = SECTIONS | {"tr", "td", "th", "caption", "col", "colgroup"}
#: start tag: (elements that it ends, elements beyond which it doesn't look)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"} | SCOPE), "dt": ({"dt", "dd"}, {"dl"} | SCOPE), "dd": ({"dt", "dd"}, {"dl"} | SCOPE), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"td", "th", "tr"}, {"table"}), "body": ({"head"}, set()),
}
_DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*([\w-]+)", re.I)
_VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(visible|hidden|collapse)", re.I)


class Node:
    """An element: gone if it isn't laid out, seen if it sets its visibility, number as its start or value says, its spans."""

    __slots__ = ("children", "columns", "gone", "number", "rows", "seen", "tag")

    def __init__(self, tag: str, gone: bool = False):
        self.tag, self.gone, self.children = tag, gone, []
        self.seen: bool | None = None
        self.number: int | None = None
        self.columns = self.rows = 1


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        out.setdefault(m[1].lower(), _html.unescape((m[2] or "").strip("\"'")))
    return out


def whole_number(text: str) -> int | None:
    text = text.strip()
    digits = text[1:] if text[:1] in ("-", "+") else text
    return int(text) if digits.isascii() and digits.isdigit() and len(digits) < 10 else None


def describe(node: Node, a: dict[str, str]) -> None:
    """Sets what the attributes say of visibility, numbers and spans."""
    style, tag = a.get("style", ""), node.tag
    display, visibility = _DISPLAY.findall(style), _VISIBILITY.findall(style)
    node.gone |= "hidden" in a or bool(display) and display[-1].lower() == "none" or tag == "input" and a.get("type", "").lower() == "hidden"
    if visibility:
        node.seen = visibility[-1].lower() == "visible"
    if tag in ("ol", "li"):
        node.number = whole_number(a.get("start" if tag == "ol" else "value", ""))
    elif tag in ("td", "th"):
        columns, rows = whole_number(a.get("colspan", "")), whole_number(a.get("rowspan", ""))
        node.columns = min(columns, 1000) if columns and columns > 0 else 1
        node.rows = 65534 if rows == 0 else min(rows, 65534) if rows and rows > 0 else 1
    elif tag == "img" and a.get("alt"):
        node.children.append(a["alt"])


class Scanner:
    """Finds the ends of tags going forward only; what isn't ahead any more is looked for once."""

    def __init__(self, source: str):
        self.source = source
        self.none: set[str] = set()

    def find(self, what: str, at: int) -> int:
        if what in self.none:
            return -1
        k = self.source.find(what, at)
        if k < 0:
            self.none.add(what)
        return k

    def tag_end(self, at: int) -> int:
        """The place of the ">" of the tag whose attributes start at `at`, or -1."""
        k = _PLAIN.match(self.source, at).end()
        while k < len(self.source):
            if self.source[k] == ">":
                return k
            close = self.find(self.source[k], k + 1)
            if close < 0:
                break
            k = _PLAIN.match(self.source, close + 1).end()
        return self.find(">", at)


class Builder:
    """The tree and its open elements, with the places of each tag in the stack."""

    def __init__(self):
        self.root = Node("html")
        self.stack = [self.root]
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.scopes: list[int] = [0]
        self.begun = False

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def cut(self, k: int) -> None:
        while len(self.stack) > k:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
            if tag in SCOPE:
                self.scopes.pop()

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        if node.tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(node)

    def add(self, child: Node | str, foster: bool) -> None:
        if foster and self.stack[-1].tag in STRUCTURE and (k := self.last(("table",))):
            around = self.stack[k - 1].children
            around.insert(len(around) - 1, child)  # an open table is the last child of its parent
        else:
            self.stack[-1].children.append(child)

    def close(self, tags, until) -> None:
        """Closes elements up to the outermost of `tags` that is open inside `until`."""
        limit = self.last(until)
        found = [p[k] for t in tags if (p := self.places[t]) and (k := bisect_right(p, limit)) < len(p)]
        if found:
            self.cut(min(found))

    def text(self, words: str) -> None:
        words = _html.unescape(words)
        shown = not words.isspace()
        if shown and self.stack[-1].tag == "head":
            self.cut(len(self.stack) - 1)
        self.begun |= shown
        self.add(words, shown)

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        k = self.places[tag][-1] if self.places[tag] else 0
        limit = 0 if tag == "table" else self.last(("table",)) if tag in PARTS else self.scopes[-1]
        if not k or k < limit:
            if tag == "p":
                self.add(Node("p"), True)
        elif tag in BLOCK or tag in PARTS or not self.blocks or self.blocks[-1] < k or self.stack[k].gone or self.stack[k].seen is not None:
            self.cut(k)

    def implied(self, tag: str) -> None:
        """Closes and opens what a part of a table implies; without an open table it only closes."""
        table = self.last(("table",))
        if not table:
            if tag in IMPLIED:
                self.close(*IMPLIED[tag])
            return
        section, row = self.last(SECTIONS), self.last(("tr",))
        if tag in ("td", "th") and row > table:
            self.cut(row + 1)
        elif tag in ("td", "th", "tr"):
            self.cut(max(section, table) + 1)
            for t in (() if section > table else ("tbody",)) + (("tr",) if tag != "tr" else ()):
                node = Node(t)
                self.stack[-1].children.append(node)
                self.push(node)
        elif tag != "col" or self.stack[-1].tag != "colgroup":
            self.cut(table + 1)

    def start(self, tag: str, source: str) -> Node | None:
        """The element of a start tag, put into the tree; None where the tag is ignored."""
        if tag == "html" or tag == "head" and (self.begun or len(self.stack) > 1):
            return None
        if tag not in HIDDEN and self.stack[-1].tag == "head" and tag not in ("meta", "link", "base"):
            self.cut(len(self.stack) - 1)
        if tag == "body" and self.places["body"]:
            return None
        if tag == "table" and self.stack[-1].tag in STRUCTURE:
            self.cut(self.last(("table",)) or len(self.stack))
        if tag in CLOSES_P and self.places["p"] and self.places["p"][-1] > self.scopes[-1]:
            self.close({"p"}, SCOPE)
        if tag in PARTS:
            self.implied(tag)
        elif tag in IMPLIED:
            self.close(*IMPLIED[tag])
        node = Node(tag, tag in HIDDEN)
        a = attributes(source) if source else {}
        if a:
            describe(node, a)
        if tag == "dialog" and "open" not in a:
            node.gone = True
        inside = self.stack[-1].tag
        form = tag == "form" and inside in STRUCTURE
        self.add(node, tag not in PARTS and tag not in HIDDEN and not form)
        self.begun |= tag not in HIDDEN
        if not (form or tag in VOID or tag in RAW or source.endswith("/") and tag not in BLOCK):
            self.push(node)
        return node


def parse(source: str) -> Node:
    tree, scan = Builder(), Scanner(source)
    at = done = 0  # what lies before done is in the tree
    while (at := source.find("<", at)) >= 0:
        name = _NAME.match(source, at)
        follows = source[at + 1 : at + 2]
        if name is None and follows not in ("!", "?") and not (follows == "/" and at + 2 < len(source)):
            at += 1
            continue
        if at > done:
            tree.text(source[done:at])
        if name is None:
            comment = source.startswith("<!--", at)
            stop = scan.find("-->", at + 2) + 2 if comment else scan.find(">", at + 2)
            if stop < (at + 4 if comment else 0):
                return tree.root
            at = done = stop + 1
            continue
        stop = scan.tag_end(name.end())
        if stop < 0:
            return tree.root
        begin, at = at, stop + 1
        done = at
        tag = name[1].lower()
        if source[begin + 1] == "/":
            tree.end(tag)
            continue
        node = tree.start(tag, source[name.end() : stop])
        if node is not None and tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            end = close.start() if close else len(source)
            if tag in ("textarea", "xmp"):
                node.children.append(_html.unescape(source[at:end]))
            stop = scan.find(">", end) if close else -1
            at = done = stop + 1 if stop >= 0 else len(source)
    if done < len(source):
        tree.text(source[done:])
    return tree.root


_SPACE = re.compile(r"[ \t\n\r\f]+")


class Page:
    """Lines under construction: one open line, and how many line ends are due before the next text."""

    def __init__(self, depth: int = 0):
        self.lines: list[str] = []
        self.open: list[str] = []
        self.space = self.blank = False
        self.indent, self.mark, self.depth = "", "", depth

    def text(self, words: str) -> None:
        flat = _SPACE.sub(" ", words)
        if not flat:
            return
        if flat[0] == " ":
            self.space = True
            flat = flat[1:]
        if not flat:
            return
        trail = flat[-1] == " "
        self.put(flat.rstrip(" "))
        self.space = trail

    def put(self, words: str) -> None:
        if not words:
            return
        if not self.open:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.open.append(self.indent + self.mark)
            if self.mark:
                self.deeper(len(self.mark))
                self.mark = ""
        elif self.space:
            self.open.append(" ")
        self.space = False
        self.open.append(words)

    def deeper(self, columns: int) -> None:
        self.indent = (self.indent + " " * columns)[:INDENT]

    def newline(self, spaced: bool = False) -> None:
        if self.open:
            self.lines.append("".join(self.open))
            self.open = []
        self.space = False
        self.blank |= spaced

    def whole(self, lines: list[str]) -> None:
        for line in lines:
            if line:
                self.put(line)
                self.newline()
            elif self.lines:
                self.lines.append("")


def columns_of(text: str) -> int:
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def rows_of(table: Node, seen: bool) -> Iterator[tuple[Node, Node, bool]]:
    """(section, row, whether it is seen) of a table's own rows."""
    for n in table.children:
        if isinstance(n, Node) and not n.gone:
            inside = seen if n.seen is None else n.seen
            if n.tag == "tr":
                yield table, n, inside
            elif n.tag in SECTIONS:
                yield from rows_of(n, inside)


class Grid:
    """Cells at their columns: (column, lines) for each row, below the cells that reach down from rows above."""

    def __init__(self):
        self.rows: list[list[tuple[int, list[str]]]] = []
        self.reach: list[tuple[int, int, int]] = []  # (first column, end, row after its last) in order
        self.section: Node | None = None

    def row(self, section: Node, cells: list[tuple[Node, list[str]]]) -> None:
        at = len(self.rows)
        if section is not self.section:
            self.section, self.reach = section, []
        taken = [r for r in self.reach if r[2] > at]
        column, k, out, down = 0, 0, [], []
        for n, lines in cells:
            while k < len(taken) and taken[k][0] <= column:
                column = max(column, taken[k][1])
                k += 1
            out.append((column, lines))
            if n.rows > 1 and column < SPANS:
                down.append((column, column + n.columns, at + n.rows))
            column += n.columns
        self.rows.append(out)
        self.reach = sorted(taken + down) if down else taken

    def lines(self) -> Iterator[str]:
        used = sorted({c for row in self.rows for c, _ in row})
        width = [0] * len(used)
        where = {c: k for k, c in enumerate(used)}
        for row in self.rows:
            for k, (c, lines) in enumerate(row):
                last = where[c] + 1 if k + 1 == len(row) else bisect_left(used, row[k + 1][0])
                if last - where[c] == 1:  # a cell over several columns makes none of them wider
                    width[where[c]] = max(width[where[c]], *map(columns_of, lines))
        place = [0]
        for w in width:
            place.append(min(place[-1] + min(w, CELL) + 2 * (w > 0), WIDE))
        for row in self.rows:
            out: list[list[str]] = [[] for _ in range(max((len(lines) for _, lines in row), default=0))]
            filled = [0] * len(out)
            for c, lines in row:
                for r, line in enumerate(lines):
                    if line:
                        gap = max(place[where[c]] - filled[r], 2 if filled[r] else 0)
                        out[r] += (" " * gap, line)
                        filled[r] += gap + columns_of(line)
            while out and not out[-1]:
                out.pop()
            yield from ("".join(parts).rstrip() for parts in out)


def layout_table(table: Node, page: Page, seen: bool) -> Iterator[Iterator]:
    for n in table.children:
        if isinstance(n, Node) and n.tag == "caption" and not n.gone:
            yield render(n, page, seen)
            page.newline()
    grid = Grid()
    for section, tr, shown in rows_of(table, seen):
        cells = []
        for n in tr.children:
            if not isinstance(n, Node) or n.gone:
                continue
            if page.depth >= NEST:
                yield render(n, page, shown)
                page.space = True
            else:
                inner = Page(page.depth + 1)
                yield render(n, inner, shown)
                inner.newline()
                cells.append((n, inner.lines or [""]))
        if page.depth >= NEST:
            page.newline()
        else:
            grid.row(section, cells)
    page.newline(True)
    page.whole(list(grid.lines()))


def render_block(n: Node, page: Page, seen: bool) -> Iterator[Iterator]:
    tag = n.tag
    page.newline(tag in SPACED)
    if tag == "table":
        yield layout_table(n, page, seen)
    elif tag == "hr":
        if seen:
            page.put("---")
    elif tag == "pre":
        page.whole([line.rstrip() for line in source_text(n, seen).strip("\n").split("\n")])
    elif tag in ("ul", "ol", "menu", "dir"):
        number, before = 1 if n.number is None else n.number, page.indent
        for c in n.children:
            if isinstance(c, str):
                if seen:
                    page.text(c)
            elif c.gone:
                continue
            elif c.tag == "li":
                page.newline()
                number = number if c.number is None else c.number
                page.mark = f"{number}. " if tag == "ol" else "- "
                number += 1
                yield render(c, page, seen)
                page.newline()
                page.indent, page.mark, page.blank = before, "", False
            else:
                yield render_one(c, page, seen)
    elif tag == "dd":
        before = page.indent
        page.deeper(2)
        yield render(n, page, seen)
        page.newline()
        page.indent = before
    else:
        yield render(n, page, seen)
    page.newline(tag in SPACED)


def render_one(n: Node, page: Page, seen: bool) -> Iterator[Iterator]:
    if n.tag == "br":
        if page.open:
            page.newline()
    elif n.tag in ("td", "th"):
        page.space = True
        yield render(n, page, seen)
        page.space = True
    elif n.tag in BLOCK:
        yield render_block(n, page, seen if n.seen is None else n.seen)
    else:
        yield render(n, page, seen)


def render(n: Node, page: Page, seen: bool) -> Iterator[Iterator]:
    """Steps of laying out what an element holds; a step that is yielded is taken before the rest."""
    if n.seen is not None:
        seen = n.seen
    for c in n.children:
        if isinstance(c, str):
            if seen:
                page.text(c)
        elif not c.gone:
            yield render_one(c, page, seen)


def take(steps: Iterator[Iterator]) -> None:
    """Runs steps within steps without recursion."""
    open_ = [steps]
    while open_:
        inner = next(open_[-1], None)
        if inner is None:
            open_.pop()
        else:
            open_.append(inner)


def source_text(n: Node, seen: bool) -> str:
    """The seen text of an element with its own spaces and line ends; blocks inside are on lines of their own."""
    out: list[str] = []

    def line_end() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    open_ = [(iter(n.children), seen, False)]
    while open_:
        children, shown, block = open_[-1]
        c = next(children, None)
        if c is None:
            open_.pop()
            if block:
                line_end()
        elif isinstance(c, str):
            if shown and c:
                out.append(c)
        elif c.tag == "br":
            out.append("\n")
        elif not c.gone:
            inside = c.tag in BLOCK
            if inside:
                line_end()
            open_.append((iter(c.children), shown if c.seen is None else c.seen, inside))
    return "".join(out)


def visible_text(source: str | None) -> str:
    if not source:
        return ""
    page = Page()
    take(render(parse(source), page, True))
    page.newline()
    return "\n".join(line.rstrip() for line in page.lines).strip("\n")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text, n_lines of every row."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = [visible_text(s) for s in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], names=["page_id", "text", "n_lines"])

    return pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{html_col}`").cast("string").alias("html")).mapInArrow(run, "page_id long, text string, n_lines long")
