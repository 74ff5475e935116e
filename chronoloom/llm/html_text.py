"""HTML to text as a reader sees it.

A tokenizer and a tree builder with implied tags give a tree; a renderer walks
it, leaves out what visibility rules hide, and lays out blocks, lists and
tables as lines of plain text with aligned cells.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import table

#: Fixed values of HTML: elements without content, and elements whose content is text only.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER_SHOWN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas annotation annotation-xml datalist meta link area param".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr menu".split())
BLOCK = SPACED | frozenset("html body div section article header footer nav main aside address form li dt dd tr td th caption thead tbody tfoot figcaption details summary center dir hgroup legend optgroup option search".split())
CLOSES_P = BLOCK - frozenset("html body td th tr thead tbody tfoot caption option optgroup legend".split())
#: An opening tag ends these open elements, up to the nearest of the stops.
_CELL, _ROW, _BODY = frozenset(("td", "th")), frozenset(("tr", "td", "th")), frozenset(("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"))
IMPLIED = {
    "li": (frozenset(("li",)), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "td": (_CELL, frozenset(("tr", "table"))),
    "th": (_CELL, frozenset(("tr", "table"))),
    "tr": (_ROW, frozenset(("table",))),
    "thead": (_BODY, frozenset(("table",))),
    "tbody": (_BODY, frozenset(("table",))),
    "tfoot": (_BODY, frozenset(("table",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "rt": (frozenset(("rt", "rp")), frozenset(("ruby",))),
    "rp": (frozenset(("rt", "rp")), frozenset(("ruby",))),
    "body": (frozenset(("head",)), frozenset(("html",))),
}
SCOPE = frozenset("html table td th caption template button".split())
TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([A-Za-z][^\s/>]*)[^>]*(?:>|\Z)|<([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'){0,2000}+)>|<([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
HIDES = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!important\s*)?(?:;|$)", re.I)
BLANKS = re.compile(r"[ \t\n\r\f]+")
#: Tables nested deeper than this are laid out as plain blocks; a line of a cell that is longer than WIDE is not padded for.
MAX_TABLES, WIDE = 8, 80


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def parse(html: str) -> Node:
    """The document's tree; tags the source leaves out are implied, stray end tags are passed over."""
    root = Node("html")
    stack, at, n = [root], 0, len(html)
    # places of the open elements by tag, so that no tag has to search the open elements
    places: dict[str, list[int]] = {"html": [0]}

    def nearest(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def cut(i: int) -> None:
        while len(stack) > i:
            places[stack.pop().tag].pop()

    def close(tags: frozenset[str], stops: frozenset[str]) -> None:
        stop = nearest(stops)
        while (i := nearest(tags)) > max(stop, 0):
            cut(i)
            if len(tags) == 1:
                return

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            stack[-1].children.append(html[at:])
            break
        m = TOKEN.match(html, lt)
        if lt > at:
            stack[-1].children.append(html[at:lt])
        if m is None:
            stack[-1].children.append("<")
            at = lt + 1
            continue
        at = m.end()
        if end := m[1]:
            tag = end.lower()
            if tag in VOID:
                if tag == "br":
                    stack[-1].children.append(Node("br"))
                continue
            free = tag in ("table", "html", "body", "tr", "thead", "tbody", "tfoot") or tag in SCOPE
            if (i := nearest((tag,))) > 0 and (free or i > nearest(SCOPE)):
                cut(i)
            continue
        if not (name := m[2] or m[4]):
            continue
        tag, source = name.lower(), m[3] or m[5] or ""
        if tag in ("html", "body") and (tag == "html" or places.get("body")):
            continue
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in CLOSES_P:
            close(frozenset(("p",)), SCOPE)
            if len(tag) == 2 and tag[0] == "h" and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6") and tag != "hr":
                cut(len(stack) - 1)
            if stack[-1].tag == "head":
                cut(len(stack) - 1)
        node = Node(tag, attributes(source) if "=" in source or source.strip(" /\n\t\r") else None)
        stack[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at)
            node.children.append(html[at : stop.start() if stop else n])
            at = html.find(">", stop.end()) + 1 or n if stop else n
        elif tag not in VOID and not (source.endswith("/") and tag in ("path", "circle", "rect", "g")):
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    return root


def hidden_selectors(root: Node) -> frozenset[str]:
    """Selectors of one tag, class or id that style sheets hide."""
    out, todo = set(), [root]
    while todo:
        node = todo.pop()
        for c in node.children:
            if not isinstance(c, str):
                if c.tag == "style":
                    for selectors, body in RULE.findall(re.sub(r"/\*.*?\*/", "", "".join(c.children), flags=re.S)):
                        if HIDES.search(body):
                            out.update(s for s in (x.strip() for x in selectors.split(",")) if re.fullmatch(r"[.#]?[\w-]+", s))
                else:
                    todo.append(c)
    return frozenset(out)


def visible(node: Node, hidden: frozenset[str]) -> bool:
    a = node.attrs
    if node.tag in NEVER_SHOWN:
        return False
    if not a and not hidden:
        return True
    if "hidden" in a or node.tag == "input" or "style" in a and HIDES.search(a["style"]):
        return False
    return not hidden or not (node.tag in hidden or "#" + a.get("id", "") in hidden or any("." + c in hidden for c in a.get("class", "").split()))


class Page:
    """Lines of laid-out text; at most one blank line between blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now, self.space, self.indent, self.mark, self.gap = "", False, "", "", False

    def newline(self) -> None:
        if self.now:
            if self.gap and self.lines:
                self.lines.append("")
            self.lines.append(self.indent[: len(self.indent) - len(self.mark)] + self.mark + self.now if self.mark else self.indent + self.now)
            self.now, self.mark, self.gap = "", "", False
        self.space = False

    def blank(self) -> None:
        self.newline()
        self.gap = True

    def text(self, s: str) -> None:
        parts = BLANKS.split(s)
        if len(parts) == 1:
            self.now += " " + s if self.space and self.now and s else s
            self.space = self.space and not s
            return
        lead, tail = parts[0] == "", parts[-1] == ""
        words = " ".join(p for p in parts if p)
        if not words:
            self.space = True
            return
        self.now += " " + words if (self.space or lead) and self.now else words
        self.space = tail

    def verbatim(self, s: str) -> None:
        first, *rest = s.split("\n")
        self.now += first
        for x in rest:
            self.lines_add()
            self.now = x

    def lines_add(self) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append((self.indent + self.now).rstrip())
        self.now = ""


def span(node: Node) -> int:
    raw = node.attrs.get("colspan", "1")
    return min(100, max(1, int(raw))) if raw.isdigit() else 1


def table_lines(node: Node, hidden: frozenset[str], depth: int) -> list[str]:
    """A table's rows as lines with cells aligned in columns, two blanks apart.

    Captions, and text or elements that stand in a table outside its cells, come
    first. An element around cells or rows, as a form, is passed through.
    """
    above: list[str] = []
    rows: list[list[tuple[list[str], int]]] = []
    # (element, the row it stands in)
    todo: list[tuple] = [(c, None) for c in reversed(node.children)]
    while todo:
        x, row = todo.pop()
        if isinstance(x, str):
            above += [s] if (s := " ".join(BLANKS.split(unescape(x))).strip()) else []
        elif not visible(x, hidden) or x.tag == "col":
            continue
        elif x.tag in _CELL:
            if row is None:
                rows.append(row := [])
            row.append((render_lines(x, hidden, depth + 1), span(x)))
        elif x.tag == "tr":
            rows.append(own := [])
            todo += ((c, own) for c in reversed(x.children))
        elif x.tag in ("thead", "tbody", "tfoot", "colgroup") or any(not isinstance(c, str) and c.tag in _BODY for c in x.children) and x.tag not in ("caption", "table"):
            todo += ((c, row) for c in reversed(x.children))
        else:
            holder = Node("div")
            holder.children = x.children if x.tag == "caption" else [x]
            above += render_lines(holder, hidden, depth + 1)
    widths: list[int] = []
    for row in rows:
        col = 0
        for lines, wide in row:
            widths += [0] * (col + wide - len(widths))
            if wide == 1:
                widths[col] = max(widths[col], max((len(s) for s in lines if len(s) <= WIDE), default=0))
            col += wide
    out = []
    for row in rows:
        height = max((len(lines) for lines, _ in row), default=0)
        for i in range(height):
            parts, col = [], 0
            for lines, wide in row:
                room = sum(widths[col : col + wide]) + 2 * (wide - 1)
                parts.append((lines[i] if i < len(lines) else "").ljust(room))
                col += wide
            out.append("  ".join(parts).rstrip())
    return above + out


def render_lines(root: Node, hidden: frozenset[str], depth: int = 0) -> list[str]:
    """Lines of one element's content; the walk keeps its own stack, so nesting is bounded by memory alone."""
    page = Page()
    # entries: a child to enter, or a function to run after an element's children
    todo: list = list(reversed(root.children))
    lists: list[list] = []
    pre = 0
    while todo:
        x = todo.pop()
        if callable(x):
            x()
            continue
        if isinstance(x, str):
            s = unescape(x) if "&" in x else x
            page.verbatim(s) if pre else page.text(s)
            continue
        if isinstance(x, tuple):
            pre += x[0]
            continue
        tag = x.tag
        if not visible(x, hidden):
            continue
        if tag == "br":
            page.newline() if page.now else page.lines_add() if pre else page.newline()
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag == "wbr":
            continue
        if tag not in BLOCK:
            if x.children:
                todo += reversed(x.children)
            if tag in ("textarea", "button", "select"):
                page.text(" ")
            continue
        after = page.blank if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists) else page.newline
        after()
        if tag == "hr":
            continue
        if tag == "table" and depth < MAX_TABLES:
            for line in table_lines(x, hidden, depth):
                page.now = line
                page.newline()
            page.gap = True
            continue
        todo.append(after)
        if tag in ("ul", "ol", "menu"):
            start = x.attrs.get("start", "1")
            lists.append([tag == "ol", int(start) if start.lstrip("-").isdigit() and len(start) < 10 else 1])
            todo.append(lambda: lists.pop())
        elif tag == "li":
            inner = lists[-1] if lists else [False, 1]
            mark = f"{inner[1]}. " if inner[0] else "- "
            inner[1] += 1
            before, outer = page.indent, page.mark
            page.mark, page.indent = mark, before + " " * len(mark)

            def leave(before=before, outer=outer) -> None:
                page.newline()
                page.indent, page.mark = before, outer

            todo.append(leave)
        elif tag in ("blockquote", "dd"):
            before = page.indent
            page.indent = before + "  "

            def restore(before=before) -> None:
                page.newline()
                page.indent = before

            todo.append(restore)
        elif tag == "pre":
            pre += 1
            todo.append((-1,))
            if x.children and isinstance(x.children[0], str) and x.children[0].startswith("\n"):
                x.children[0] = x.children[0][1:]
        elif tag in ("td", "th"):
            todo.append(lambda: page.text(" "))
        todo += reversed(x.children)
    page.newline()
    return page.lines


def title_of(root: Node) -> str:
    todo = [root]
    while todo:
        x = todo.pop()
        if x.tag == "title":
            return " ".join(unescape("".join(c for c in x.children if isinstance(c, str))).split())
        todo += [c for c in reversed(x.children) if not isinstance(c, str)]
    return ""


def html_to_text(html: str) -> tuple[str, str]:
    """(title, visible text)."""
    root = parse(html.replace("\r\n", "\n").replace("\0", ""))
    return title_of(root), "\n".join(render_lines(root, hidden_selectors(root) if "<style" in html.lower() else frozenset()))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, title, text, n_chars, n_lines.

    Null and empty pages give empty strings. Repeated rows each get their row.
    Other columns are not read; an empty table gives an empty result.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [html_to_text(h.as_py() or "") for h in batch.column(1)]
            texts = [t for _, t in done]
            arrays = [pa.array([t for t, _ in done], pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            lines = pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, lines], names=[id_col, "title", "text", "n_chars", "n_lines"])

    rows = pages.select(F.col(id_col), F.col(html_col).cast("string").alias("_html"))
    return rows.mapInArrow(kernel, f"`{id_col}` {kind}, title string, text string, n_chars bigint, n_lines bigint")


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
