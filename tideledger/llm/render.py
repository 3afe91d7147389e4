"""Visible text of web pages, laid out as a reader sees it.

A page is built into a tree (void elements, implied ends of paragraphs, list items, rows and cells,
stray end tags ignored), what is hidden is left out, and the rest is rendered: inline text is
collapsed, blocks stand on lines of their own with the spacing of their kind, lists are marked and
indented, preformatted text is kept, and the cells of a table are aligned in columns.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript noframes iframe xmp".split())
HIDDEN = frozenset("head script style template title noscript noframes iframe object svg math datalist audio video canvas "
                   "map meta link".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset hr menu".split())
BLOCK = SPACED | frozenset("html body div section article aside nav header footer main address form li dt dd details summary "
                           "figcaption caption legend center tr thead tbody tfoot td th option optgroup select dialog".split())
CLOSES_P = SPACED | frozenset("div section article aside nav header footer main address form details figcaption li dt dd".split())
#: Tag -> open tags that its start ends, and tags that stop the search.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}), "dt": ({"dt", "dd"}, {"dl", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "caption": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
}
#: Start tags that leave a head open; any other one and text end it, as its own end tag may be left out.
IN_HEAD = frozenset("base link meta script style template title noscript noframes".split())
#: An end tag reaches no further out than these.
SCOPE = frozenset("table td th caption html template".split())
TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|[^<]++|<""", re.S)
#: A tag up to a quote that is never closed, and tags before such a quote, where quotes are letters like others.
UNFINISHED = re.compile(r"""</?[A-Za-z][^\s/>]*+(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
UNQUOTED = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
BLANK = re.compile(r"[ \t\n\r\f]+")
UNSEEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)")
#: Cells are padded to their column's width up to this many characters; longer cells stay whole.
MAX_PAD = 40
INDENT = "  "


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(text: str) -> dict[str, str]:
    if not text or text.isspace() or text == "/":
        return {}
    out: dict[str, str] = {}
    for name, a, b, c in ATTR.findall(text):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def build(page: str) -> Node:
    """Tree of a page; text is a str child, entities decoded.

    A quote that is never closed ends no tag: tags before it end at their next `>`. A tag without one
    is text, with all that follows. Each is found once, so the work grows with the page only.
    """
    root = Node("#root", {})
    stack = [root]
    at, n, quote = 0, len(page), 0
    opened = {"tbody", "tr"}  # tags seen so far, and those that are implied
    while at < n:
        m = at < quote and UNQUOTED.match(page, at) or TOKEN.match(page, at)
        start, at = at, m.end()
        tag = m.group(2) if m.re.groups else None
        if tag is None:
            word = m.group()
            if word == "<" and (open_tag := UNFINISHED.match(page, start)):
                if page.find(">", start) < 0:
                    word, at = page[start:], n
                elif start >= quote:
                    at, quote = start, open_tag.end() + 1
                    continue
            if word[0] != "<" or word[1:2] not in ("!", "?"):
                if stack[-1].tag == "head" and BLANK.sub("", word):
                    stack.pop()
                stack[-1].children.append(html.unescape(word) if "&" in word else word)
            continue
        tag = tag.lower()
        if m.group(1):
            if tag in opened:
                _close(stack, tag)
            continue
        opened.add(tag)
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            if tag == "head":
                continue
            stack.pop()
        if tag in CLOSES_P and any(x.tag == "p" for x in stack[-8:]):
            _close(stack, "p")
        if tag in IMPLIED:
            ended, stop = IMPLIED[tag]
            k = len(stack) - 1
            cut = None
            while k > 0 and stack[k].tag not in stop:
                if stack[k].tag in ended:
                    cut = k
                k -= 1
            if cut is not None:
                del stack[cut:]
        if tag == "tr" and stack[-1].tag == "table" or tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            for implied in (("tbody", "tr") if stack[-1].tag == "table" else ("tr",)) if tag != "tr" else ("tbody",):
                inner = Node(implied, {})
                stack[-1].children.append(inner)
                stack.append(inner)
        node = Node(tag, _attributes(m.group(3)))
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(page, at)
            body, at = (page[at:end.start()], end.end()) if end else (page[at:], n)
            if tag in ("textarea", "xmp"):
                node.children.append(html.unescape(body) if tag == "textarea" else body)
        elif tag not in VOID:
            stack.append(node)
    return root


def _close(stack: list[Node], tag: str) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if stack[k].tag in SCOPE and tag not in ("table", "html", "body", "tr", "tbody", "thead", "tfoot"):
            return


def visible(node: Node) -> bool:
    a = node.attrs
    return not (node.tag in HIDDEN or a and ("hidden" in a or UNSEEN.search(a.get("style", "")) or (
        node.tag == "input" and a.get("type", "").lower() == "hidden")) or node.tag == "dialog" and "open" not in a)


class _Page:
    """Lines so far, the open line and the blank lines that the next one needs."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.open: list[str] = []
        self.gap = 0
        self.prefix, self.mark = "", None

    def text(self, words: str) -> None:
        collapsed = BLANK.sub(" ", words)
        if self.open and self.open[-1].endswith(" ") or not self.open:
            collapsed = collapsed.lstrip(" ")
        if collapsed:
            self.open.append(collapsed)

    def line(self) -> None:
        words = "".join(self.open).rstrip(" ")
        self.open = []
        if words:
            self.raw(words)

    def raw(self, words: str) -> None:
        if self.lines and self.gap:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        lead = self.prefix
        if self.mark is not None:
            lead, self.mark = self.mark, None
        self.lines.append(lead + words)

    def block(self, gap: int) -> None:
        self.line()
        self.gap = max(self.gap, gap) if self.lines else 0


def inline(node: Node) -> str:
    """All visible text of a subtree on one line."""
    out: list[str] = []
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is node or visible(x):
            if x.tag == "br" or x.tag in BLOCK:
                out.append(" ")
                todo.append(" ")
            todo.extend(reversed(x.children))
            if x.tag == "input":
                out.append(x.attrs.get("value", ""))
    return BLANK.sub(" ", "".join(out)).strip(" ")


def _table(page: _Page, table: Node) -> list[Node]:
    """Renders the rows of a table; its captions come back to be rendered before."""
    rows: list[list[tuple[str, int]]] = []
    todo: list[Node] = [table]
    while todo:
        x = todo.pop()
        if x.tag == "tr":
            cells = []
            for c in x.children:
                if isinstance(c, Node) and visible(c) and c.tag in ("td", "th"):
                    span = c.attrs.get("colspan", "1")
                    cells.append((inline(c), min(int(span), 1000) if span.isdecimal() and int(span) else 1))
                elif isinstance(c, str) and c.strip() or isinstance(c, Node) and visible(c) and inline(c):
                    cells.append((BLANK.sub(" ", c).strip() if isinstance(c, str) else inline(c), 1))
            rows.append(cells)
        elif x.tag in ("table", "thead", "tbody", "tfoot"):
            for c in reversed(x.children):
                if isinstance(c, str):
                    if c.strip():
                        loose = Node("tr", {})
                        loose.children.append(c)
                        todo.append(loose)
                elif visible(c) and c.tag not in ("caption", "colgroup"):
                    todo.append(c)
        else:
            loose = Node("tr", {})
            loose.children.append(x)
            todo.append(loose)
    widths: dict[int, int] = {}
    for cells in rows:
        at = 0
        for words, span in cells:
            if span == 1 and len(words) <= MAX_PAD:
                widths[at] = max(widths.get(at, 0), len(words))
            at += span
    for cells in rows:
        at, parts = 0, []
        for k, (words, span) in enumerate(cells):
            width = sum(widths.get(c, 0) for c in range(at, at + span)) + 3 * (span - 1) if span <= 64 else 0
            parts.append(words.ljust(min(width, MAX_PAD)) if k + 1 < len(cells) else words)
            at += span
        row = " | ".join(parts).rstrip(" ")
        if any(words for words, _ in cells):
            page.raw(row)
    return [c for c in table.children if isinstance(c, Node) and c.tag == "caption" and visible(c)]


def render(text: str | None) -> str:
    """Visible text of a page; empty for a null or empty one. Lines carry no trailing blanks."""
    if not text:
        return ""
    page = _Page()
    todo: list[tuple] = [("node", build(text), False)]
    lists: list[list] = []
    while todo:
        what, x, pre = todo.pop()
        if what == "end":
            page.block(1 if x.tag in SPACED and not (x.tag in ("ul", "ol", "menu") and lists[1:]) else 0)
            if x.tag in ("ul", "ol", "menu"):
                lists.pop()
            if x.tag in ("li", "dd", "blockquote"):
                page.prefix = page.prefix[:-len(INDENT)]
                page.mark = None
            continue
        if isinstance(x, str):
            if pre:
                first, *rest = x.split("\n")
                page.open.append(first)
                for line in rest:
                    words = "".join(page.open).rstrip(" ")
                    page.open = [line]
                    page.raw(words) if words or page.lines else None
            else:
                page.text(x)
            continue
        if x.tag != "#root" and not visible(x):
            continue
        if x.tag == "br":
            page.line()
            continue
        if x.tag == "input":
            page.text(x.attrs.get("value", ""))
            continue
        if x.tag == "table":
            page.block(1)
            for c in x.children:
                if isinstance(c, Node) and c.tag == "caption" and visible(c):
                    words = inline(c)
                    page.raw(words) if words else None
            _table(page, x)
            page.block(1)
            continue
        if x.tag in BLOCK:
            nested = x.tag in ("ul", "ol", "menu") and bool(lists)
            page.block(1 if x.tag in SPACED and not nested else 0)
            if x.tag in ("ul", "ol", "menu"):
                start = x.attrs.get("start", "1")
                lists.append([x.tag, int(start) if start.isdecimal() else 1])
            if x.tag == "li":
                mark = "- "
                if lists and lists[-1][0] == "ol":
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                page.mark = page.prefix + mark
            if x.tag in ("li", "dd", "blockquote"):
                page.prefix += INDENT
            todo.append(("end", x, pre))
        inside = pre or x.tag in ("pre", "textarea", "xmp")
        todo.extend(("node", c, inside) for c in reversed(x.children))
    page.line()
    return "\n".join(x.rstrip(" ") for x in page.lines)


def visible_text(pages: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """pages with the visible text of `column` in `out`, in place of `column`; every row comes back."""
    names = [c for c in pages.columns if c not in (column, out)]
    fields = ", ".join([f"`{n.replace('`', '``')}` {pages.schema[n].dataType.simpleString()}" for n in names] + [f"`{out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(x.as_py()) for x in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(names)], pa.array(texts, pa.string())], [*names, out])

    return pages.select(*names, F.col(column).alias("__html")).mapInArrow(run, fields)
