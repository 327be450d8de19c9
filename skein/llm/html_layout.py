"""Layout-aware HTML rendering: a tree builder with implied tags, visibility rules, text with layout.

``parse`` builds a tree from any markup: omitted end tags are implied (paragraphs, list and
definition items, table parts, options), unknown and misnested end tags are passed over, raw
text elements end at their own end tag only. ``render`` emits all text that a reader would
see: blocks on lines of their own, paragraphs and headings with a blank line around them,
lists with markers and indents, tables with aligned cells, preformatted text as it is. Both
are iterative, so nesting depth is no limit but memory.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.arrays import lean
from skein.session import ship_package

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe object video audio canvas datalist noembed noframes title meta link base param source track area map".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset".split())
BLOCK = SPACED | frozenset("html body div section article aside header footer nav main address form li dt dd tr caption details summary figcaption legend hr center dir menu hgroup search optgroup option".split())
#: what SVG and MathML hold for machines
DRAWN_UNSEEN = frozenset("defs desc metadata symbol clippath lineargradient radialgradient pattern mask marker filter annotation annotation-xml".split())
#: elements of theirs whose text stands apart
DRAWN_APART = frozenset("text foreignobject mtd".split())
#: a start tag of the key ends an open element of the value, up to the border
CLOSES: dict[str, frozenset[str]] = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option"]),
    "optgroup": frozenset(["option", "optgroup"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "tr": frozenset(["td", "th", "tr", "caption", "colgroup"]),
    "tbody": frozenset(["td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"]),
    "body": frozenset(["head"]),
}
CLOSES["thead"] = CLOSES["tfoot"] = CLOSES["tbody"]
BORDER: dict[str, frozenset[str]] = {
    "li": frozenset(["ul", "ol", "menu", "dir"]),
    "dt": frozenset(["dl"]),
    "dd": frozenset(["dl"]),
    "option": frozenset(["select", "datalist"]),
    "optgroup": frozenset(["select", "datalist"]),
}
IN_HEAD = frozenset("title meta link base style script noscript template".split())
TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<(?:!|\?)[^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|<([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
MARK = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[{};]")
AT_RULE = re.compile(r"@([\w-]+)\s*(.*)", re.S)
HIDES = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
COMMENT = re.compile(r"/\*.*?\*/", re.S)
BLANKS = re.compile(r"[ \t\n\r\f]+")
WIDEST = 60


class Node:
    """An element: its tag, attributes and children (elements and strings)."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        out.setdefault(m[1].lower(), html.unescape(next((x for x in m.groups()[1:] if x is not None), "")))
    return out


def parse(source: str) -> Node:
    """The tree under one ``html`` element, with ``head`` and ``body`` implied. Where each tag is open
    is known, so that a tag takes no search through the open elements, however deep they are.
    """
    root = Node("html")
    stack = [root]
    opened: defaultdict[str, list[int]] = defaultdict(list)
    body: Node | None = None

    def push(tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        opened[tag].append(len(stack))
        stack.append(node)
        return node

    def cut(k: int) -> None:
        for n in stack[k:]:
            opened[n.tag].pop()
        del stack[k:]

    def innermost(tags: frozenset[str]) -> int:
        """The place of the innermost open element with one of the tags, 0 if there is none."""
        return max((opened[t][-1] for t in tags if opened[t]), default=0)

    def into_body() -> None:
        nonlocal body
        if body is None:
            cut(1)
            body = push("body", {})

    def close(tags: frozenset[str], border: frozenset[str]) -> None:
        while (k := innermost(tags)) > innermost(border - tags):
            cut(k)

    def text(s: str) -> None:
        if not s:
            return
        if body is None and not (len(stack) > 1 and stack[-1].tag != "head"):
            if not s.strip():
                return
            into_body()
        if stack[-1].tag in ("table", "thead", "tbody", "tfoot", "tr") and s.strip():  # misplaced text stands in a cell of its own
            if stack[-1].tag != "tr":
                push("tr", {})
            push("td", {})
        stack[-1].children.append(s)

    at = 0
    while True:
        m = TOKEN.search(source, at)
        if m is None:
            text(html.unescape(source[at:]))
            return root
        text(html.unescape(source[at : m.start()]))
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                into_body()
                stack[-1].children.append(Node("br"))
            elif tag == "p" and not opened["p"]:
                into_body()
                stack[-1].children.append(Node("p"))
            elif tag not in ("html", "body") and opened[tag]:
                limit = frozenset() if tag in ("table", "tr", "tbody", "thead", "tfoot", "td", "th") else frozenset(["table", "td", "th"])
                if opened[tag][-1] > innermost(limit):
                    cut(opened[tag][-1])
        elif m[2]:
            tag, attrs = m[2].lower(), attributes(m[3] or "") if m[3] and m[3].strip(" /\n\t\r") else {}
            if tag == "html":
                root.attrs = attrs | root.attrs
                continue
            if tag == "head":
                if body is None and len(stack) == 1:
                    push("head", attrs)
                continue
            if tag == "body":
                if body is None:
                    cut(1)
                    body = push("body", attrs)
                continue
            if body is None and tag not in IN_HEAD and not (len(stack) > 1 and stack[-1].tag in ("noscript", "template")):
                into_body()
            if tag in CLOSES:
                close(CLOSES[tag], BORDER.get(tag, frozenset(["table"])))
            elif tag in BLOCK and opened["p"]:
                close(frozenset(["p"]), frozenset(["td", "th", "table", "button"]))
            if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
                push("tr", {})
            drawn = opened["svg"] or opened["math"]
            if drawn and tag in DRAWN_UNSEEN:
                attrs = attrs | {"hidden": ""}
            if tag in VOID or drawn and (m[3] or "").endswith("/"):
                stack[-1].children.append(Node(tag, attrs))
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
                node = Node(tag, attrs)
                inside = source[at : end.start() if end else len(source)]
                node.children.append(html.unescape(inside) if tag in ("title", "textarea") else inside)
                stack[-1].children.append(node)
                at = end.end() if end else len(source)
            else:
                push(tag, attrs)


def on_screen(condition: str) -> bool:
    """Whether media queries hold on any screen; sizes and other features aren't known."""
    return not condition.strip() or any(" ".join(q.lower().split()) in ("all", "screen", "only all", "only screen", "not print") for q in condition.split(","))


def rules(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules that hold on any screen: not those inside other media's blocks."""
    css = COMMENT.sub("", css)
    stack: list[tuple[bool, str, list[str]]] = [(True, "", [])]
    at = 0
    for m in MARK.finditer(css):
        if m[0] not in "{};":
            continue
        piece, at = css[at : m.start()], m.end()
        holds, selectors, said = stack[-1]
        if m[0] == ";":
            said.append(piece + ";")
        elif m[0] == "}":
            if len(stack) > 1:
                stack.pop()
                if holds and selectors:
                    yield selectors, "".join(said) + piece
        elif a := AT_RULE.match(piece.strip()):
            stack.append((holds and not selectors and (a[1].lower() in ("layer", "supports") or a[1].lower() == "media" and on_screen(a[2])), "", []))
        else:
            stack.append((holds and not selectors, piece.strip(), []))


class Visibility:
    """Which elements are seen: by tag, attributes, inline style and simple rules of style elements."""

    def __init__(self, root: Node):
        self.tags: set[str] = set()
        self.classes: set[tuple[str, str]] = set()
        self.ids: set[tuple[str, str]] = set()
        todo: list[Node] = [root]
        while todo:
            node = todo.pop()
            if node.tag == "style" and on_screen(node.attrs.get("media", "")):
                for selectors, said in rules("".join(c for c in node.children if isinstance(c, str))):
                    if HIDES.search(said):
                        for selector in selectors.split(","):
                            self._add(selector.strip())
            todo += [c for c in node.children if isinstance(c, Node)]

    def _add(self, selector: str) -> None:
        if m := re.fullmatch(r"([A-Za-z][\w-]*)?(?:([.#])([\w-]+))?", selector):
            tag = (m[1] or "").lower()
            if m[2]:
                (self.classes if m[2] == "." else self.ids).add((tag, m[3]))
            elif tag:
                self.tags.add(tag)

    def hidden(self, node: Node) -> bool:
        a = node.attrs
        if node.tag in UNSEEN or node.tag in self.tags or "hidden" in a:
            return True
        if node.tag == "input" and a.get("type", "").lower() not in ("submit", "button", "reset"):
            return True
        if "style" in a and HIDES.search(a["style"]):
            return True
        if self.ids and "id" in a and ((node.tag, a["id"]) in self.ids or ("", a["id"]) in self.ids):
            return True
        return bool(self.classes) and any((node.tag, c) in self.classes or ("", c) in self.classes for c in a.get("class", "").split())


class Flow:
    """Lines of a block being filled: collapses blanks, keeps lines and gaps, and indents."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = False
        self.indent: list[str] = []
        self.marker: str | None = None

    def text(self, s: str) -> None:
        self.inline.append(s)

    def end_line(self) -> None:
        line = BLANKS.sub(" ", "".join(self.inline)).strip(" ")
        self.inline = []
        if line:
            self.put(line)

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        lead = "".join(self.indent)
        if self.marker is not None:
            lead = lead[: len(lead) - len(self.marker)] + self.marker
            self.marker = None
        self.lines.append((lead + line).rstrip())

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap = self.gap or spaced


def carriers(table: Node) -> set[int]:
    """Elements of a table (not of those inside it) that hold rows, cells or captions somewhere below."""
    out: set[int] = set()
    todo: list[tuple[Node, tuple | None]] = [(table, None)]
    while todo:
        node, above = todo.pop()
        if node is not table and node.tag in ("tr", "td", "th", "caption"):
            way = above
            while way is not None and id(way[0]) not in out:
                out.add(id(way[0]))
                way = way[1]
        if node is table or node.tag not in ("table", "td", "th", "caption"):
            todo += [(c, (node, above)) for c in node.children if isinstance(c, Node)]
    return out


def cells_of(table: Node, seen: Visibility) -> tuple[list[Node], list[list[tuple[Node, int]]], list[Node]]:
    """Captions, the rows of a table (each cell with the columns that it spans), and what stands in the table
    outside of both, which is seen before it.
    """
    captions, rows, stray = [], [], []
    within = carriers(table)
    todo: list[tuple[Node | str, Node, list | None]] = [(c, table, None) for c in reversed(table.children)]
    last: Node | None = None  # whose stray content the last piece is
    while todo:
        node, above, row = todo.pop()
        if isinstance(node, Node) and seen.hidden(node):
            continue
        if isinstance(node, str) or node.tag not in ("caption", "tr", "td", "th") and id(node) not in within:
            if isinstance(node, str) and not node.strip() and last is not above:
                continue
            if last is not above:
                stray.append(Node("div"))
            stray[-1].children.append(node)
            last = above
            continue
        last = None
        if node.tag == "caption":
            captions.append(node)
        elif node.tag in ("td", "th"):
            if row is None:  # a cell without a row has one of its own
                rows.append(row := [])
            span = node.attrs.get("colspan", "1")
            row.append((node, min(max(int(span), 1), 1000) if span.isascii() and span.isdigit() and len(span) < 5 else 1))
        else:
            if node.tag == "tr":
                rows.append(row := [])
            todo += [(c, node, row) for c in reversed(node.children)]
    return captions, rows, stray


def layout(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Lines of a table. Each cell begins where its column does: columns are as wide as their widest cell,
    two blanks apart, but not wider than ``WIDEST``. Where a longer cell reaches into the next
    column, the rest of the row goes on in a line of its own, so that nothing is cut or out of place.
    """
    widths: dict[int, int] = {}
    spans: list[tuple[int, int, int]] = []
    for row in rows:
        at = 0
        for lines, span in row:
            width = min(WIDEST, max(map(len, lines), default=0))
            if span == 1:
                widths[at] = max(widths.get(at, 0), width)
            else:
                spans.append((at, span, width))
            at += span
    own = set(widths)
    for at, span, width in spans:  # a column without cells of its own takes what the cells that begin there need
        if at not in own:
            widths[at] = max(widths.get(at, 0), width - sum(widths[c] + 2 for c in range(at + 1, at + span) if c in own))
    columns = sorted(widths)
    begin = dict(zip(columns, accumulate((widths[c] + 2 for c in columns), initial=0), strict=False))
    out = []
    for row in rows:
        for k in range(max((len(lines) for lines, _ in row), default=0)):
            line, at = "", 0
            for lines, span in row:
                if k < len(lines) and lines[k]:
                    if line and len(line) + 2 > begin[at]:
                        out.append(line)
                        line = ""
                    line = line.ljust(begin[at]) + lines[k]
                at += span
            out.append(line.rstrip())
    return out


def render(root: Node) -> str:
    """All visible text of a tree, with its layout."""
    seen = Visibility(root)
    done: dict[int, list[str]] = {}

    def flow(top: Node) -> list[str]:
        f = Flow()
        counters: list[int | None] = []
        pre = 0
        todo: list[tuple[str, Node | str]] = [("open", top)]
        while todo:
            what, node = todo.pop()
            if isinstance(node, str):
                if pre:
                    first, *rest = node.replace("\r\n", "\n").replace("\r", "\n").split("\n")
                    f.text(first)
                    for line in rest:
                        raw = "".join(f.inline)
                        f.inline = []
                        f.put(raw.rstrip()) if raw.strip() or f.lines else None
                        f.text(line)
                else:
                    f.text(node)
                continue
            tag = node.tag
            if what == "open":
                if node is not top and seen.hidden(node):
                    continue
                if tag == "br":
                    f.end_line()
                    continue
                if tag == "hr":
                    f.block(True)
                    continue
                if tag == "input":
                    f.text(f" {node.attrs.get('value', '')} ")
                    continue
                if tag == "table" and node is not top:
                    f.block(True)
                    for line in done.pop(id(node)):
                        f.put(line)
                    f.block(True)
                    continue
                if tag in DRAWN_APART:
                    f.text(" ")
                if tag in BLOCK and node is not top:
                    f.block(tag in SPACED and not (tag in ("ul", "ol") and counters))
                if tag in ("ul", "ol", "menu", "dir"):
                    start = node.attrs.get("start", "1")
                    counters.append((int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1) if tag == "ol" else None)
                elif tag == "li":
                    number = counters[-1] if counters else None
                    f.marker = "- " if number is None else f"{number}. "
                    if number is not None:
                        counters[-1] = number + 1
                    f.indent.append(" " * len(f.marker))
                elif tag in ("dd", "blockquote"):
                    f.indent.append("  ")
                elif tag == "pre":
                    pre += 1
                todo.append(("close", node))
                todo += [("open", c) for c in reversed(node.children)]
                continue
            if tag == "pre":
                raw = "".join(f.inline)
                f.inline = []
                pre -= 1
                if raw.strip():
                    f.put(raw.rstrip())
            if tag in DRAWN_APART:
                f.text(" ")
            if tag in BLOCK and node is not top:
                f.block(tag in SPACED and not (tag in ("ul", "ol") and len(counters) > 1))
            if tag in ("ul", "ol", "menu", "dir"):
                counters.pop()
            elif tag == "li":
                f.indent.pop()
                f.marker = None
            elif tag in ("dd", "blockquote"):
                f.indent.pop()
        f.end_line()
        while f.lines and not f.lines[-1]:
            f.lines.pop()
        return f.lines

    for table in reversed(visible_tables(root, seen)):  # inner ones first
        captions, rows, stray = cells_of(table, seen)
        lines = [line for c in stray + captions for line in flow(c)]
        done[id(table)] = lines + layout([[(flow(cell), span) for cell, span in row] for row in rows])
    return "\n".join(flow(root))


def visible_tables(root: Node, seen: Visibility) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node is not root and seen.hidden(node):
            continue
        if node.tag == "table":
            out.append(node)
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def extract(source: str | None) -> tuple[str, int, int, int]:
    """The visible text, and how many lines, list items and tables it has."""
    root = parse(source or "")
    text = render(root)
    seen = Visibility(root)
    items, todo = 0, [root]
    while todo:
        node = todo.pop()
        if node is root or not seen.hidden(node):
            items += node.tag == "li"
            todo += [c for c in node.children if isinstance(c, Node)]
    return text, text.count("\n") + 1 if text else 0, items, len(visible_tables(root, seen))


def visible_text(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """key, text, n_chars, n_lines, n_items, n_tables, text_sha256 of each page.

    Null and empty markup give an empty text; repeated keys give repeated rows. One pass,
    no shuffle; memory is one page's tree.
    """
    ship_package(pages.sparkSession)
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [extract(x.as_py()) for x in part.column(1)]
                columns = [[r[0] for r in rows], [len(r[0]) for r in rows], *([r[i] for r in rows] for i in (1, 2, 3)), [hashlib.sha256(r[0].encode()).hexdigest() for r in rows]]
                types = [pa.string(), *[pa.int64()] * 4, pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [key, "text", "n_chars", "n_lines", "n_items", "n_tables", "text_sha256"])

    return pages.selectExpr(f"`{key}`", f"`{source}`").mapInArrow(lean(run), f"`{key}` {kind}, text string, n_chars long, n_lines long, n_items long, n_tables long, text_sha256 string")
