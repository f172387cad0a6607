"""The visible text of HTML pages, laid out as a browser would: a tree with implied tags, visibility rules, and rendering
that keeps blocks apart, marks list items and aligns the cells of tables."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import ship
from .lean import lean

# Element names by the role that the HTML standard gives them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes xmp plaintext title textarea".split())
HIDDEN = frozenset("head script style noscript template iframe noembed noframes title datalist audio video canvas svg math object param area map select".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul caption tr td th thead tbody tfoot".split())
PARAGRAPH = frozenset("p blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 ol pre table ul menu".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: An opening tag ends these open elements, looked for up to the nearest of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
#: An end tag does not reach past these.
SCOPE = frozenset("table td th caption html body template object marquee".split())
CELLS = frozenset(("td", "th"))
# The most columns and rows that the HTML standard lets a cell span.
COLSPAN, ROWSPAN = 1000, 65534
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)|content-visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("name", "attrs", "kids")

    def __init__(self, name: str, attrs: str = ""):
        self.name, self.attrs, self.kids = name, attrs, []

    def attributes(self) -> dict[str, str]:
        if not self.attrs:
            return {}
        return {k.lower(): unescape(a or b or c or "") for k, a, b, c in reversed(_ATTR.findall(self.attrs))}


def parse(html: str) -> Node:
    """The tree of a page; any text is accepted, nested to any depth."""
    root, at, n = Node("html"), 0, len(html)
    stack, lower, open_ = [root], None, Counter()

    def push(node: Node) -> None:
        stack.append(node)
        open_[node.name] += 1

    def pop(k: int) -> None:
        """Closes element k and all within it."""
        for x in stack[k:]:
            open_[x.name] -= 1
        del stack[k:]

    def close(names, stop) -> None:
        while any(open_[x] for x in names):  # more than one of them may be open, as a cell in a row
            k = len(stack) - 1
            while stack[k].name not in names and stack[k].name not in stop:
                k -= 1
            if stack[k].name not in names:
                return
            pop(k)

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            stack[-1].kids.append(unescape(html[at:]))
            break
        if m.start() > at:
            stack[-1].kids.append(unescape(html[at : m.start()]))
        at = m.end()
        if m["cdata"] is not None:
            stack[-1].kids.append(m["cdata"])
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            if name == "br":
                stack[-1].kids.append(Node("br"))
            elif name == "p" and not open_["p"]:
                stack[-1].kids.append(Node("p"))
            elif open_[name] or name in HEADINGS and any(open_[x] for x in HEADINGS):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name or name in HEADINGS and stack[k].name in HEADINGS:
                        pop(k)
                        break
                    if stack[k].name in SCOPE and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") and name not in CELLS:
                        break
            continue
        if name in ("html", "body"):
            if name == "body" and m["attrs"].strip() and not open_["body"]:
                body = Node(name, m["attrs"])
                stack[-1].kids.append(body)
                push(body)
            continue
        if name in IMPLIED:
            close(*IMPLIED[name])
        elif name in CLOSES_P and open_["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    pop(k)
                    break
                if stack[k].name in SCOPE or stack[k].name == "button":
                    break
        if name in CELLS and stack[-1].name in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr")
            stack[-1].kids.append(row)
            push(row)
        node = Node(name, m["attrs"])
        stack[-1].kids.append(node)
        if name in RAW:
            lower = html.lower() if lower is None or len(lower) != n else lower
            if len(lower) == n:
                end = lower.find(f"</{name}", at)
            else:  # lower-casing changed places
                e = re.compile(re.escape(f"</{name}"), re.I).search(html, at)
                end = e.start() if e else -1
            end = n if end < 0 or name == "plaintext" else end
            node.kids.append(unescape(html[at:end]) if name in ("title", "textarea") else html[at:end])
            at = end
            close_ = html.find(">", end)
            at = n if close_ < 0 else close_ + 1
        elif name not in VOID:
            push(node)
    return root


def hidden(node: Node) -> bool:
    if node.name in HIDDEN:
        return True
    if not node.attrs:
        return node.name == "dialog"
    a = node.attributes()
    return "hidden" in a and a["hidden"].lower() != "until-found" or bool(_HIDES.search(a.get("style", ""))) or a.get("aria-hidden", "").strip().lower() == "true" or (node.name == "input" and a.get("type", "").lower() == "hidden") or (node.name == "dialog" and "open" not in a)


class Page:
    """Lines under construction: inline text is collapsed, blocks start lines, paragraphs leave an empty line between."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = self.gap = False
        self.mark = ""
        self.indent = ""

    def text(self, x: str, kept: bool = False) -> None:
        if kept:
            for k, part in enumerate(x.split("\n")):
                if k:
                    self.end()
                    if not part:
                        self.gap = True
                if part:
                    self._put(part)
            return
        x = _SPACE.sub(" ", x)
        if not x:
            return
        if x[0] == " ":
            self.space, x = True, x[1:]
        if x:
            if x[-1] == " ":
                self._put(x[:-1])
                self.space = True
            else:
                self._put(x)

    def _put(self, x: str) -> None:
        if not self.now:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.now.append(self.indent + self.mark)
            self.mark = ""
        elif self.space:
            self.now.append(" ")
        self.space = False
        self.now.append(x)

    def end(self) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        self.space = False

    def result(self) -> str:
        self.end()
        return "\n".join(self.lines)


def _span(a: dict, key: str, most: int) -> int:
    x = a.get(key, "1").strip()
    return max(1, min(most, int(x.lstrip("0")[:9] or "0"))) if x.isascii() and x.isdigit() else 1


def _rows(table: Node):
    """Visible rows of a table, its own and not those of tables within."""
    for kid in table.kids:
        if isinstance(kid, Node) and not hidden(kid):
            if kid.name == "tr":
                yield [x for x in kid.kids if isinstance(x, Node) and x.name in CELLS and not hidden(x)]
            elif kid.name in ("thead", "tbody", "tfoot"):
                yield from _rows(kid)


def _table(node: Node, out: Page) -> None:
    for kid in node.kids:  # captions, and what stands in a table without being part of one, come first
        if isinstance(kid, str) and kid.strip() or isinstance(kid, Node) and kid.name not in ("tr", "thead", "tbody", "tfoot", "col", "colgroup"):
            _render(kid, out)
            out.end()
        elif isinstance(kid, Node) and kid.name in ("thead", "tbody", "tfoot", "tr") and not hidden(kid):
            for x in kid.kids:
                if isinstance(x, str) and x.strip() or isinstance(x, Node) and x.name not in ("tr", "td", "th"):
                    _render(x, out)
                    out.end()
                elif isinstance(x, Node) and x.name == "tr" and not hidden(x):
                    for y in x.kids:
                        if isinstance(y, str) and y.strip() or isinstance(y, Node) and y.name not in CELLS:
                            _render(y, out)
                            out.end()
    grid, taken = [], {}  # taken: of each column, the last row that a cell above reaches
    for r, cells in enumerate(_rows(node)):
        row, c = {}, 0
        for cell in cells:
            while taken.get(c, -1) >= r:
                c += 1
            a = cell.attributes()
            wide, high = _span(a, "colspan", COLSPAN), _span(a, "rowspan", ROWSPAN)
            inner = Page()
            for kid in cell.kids:
                _render(kid, inner)
            row[c] = inner.result().split("\n")
            for j in range(c, c + wide):
                taken[j] = r + high - 1
            c += wide
        grid.append(row)
    columns = sorted({c for row in grid for c, x in row.items() if x != [""]})
    width = {c: max(len(line) for row in grid for line in row.get(c, [""])) for c in columns}
    for row in grid:
        for k in range(max((len(row[c]) for c in columns if c in row), default=0)):
            parts = [(row[c][k] if c in row and k < len(row[c]) else "").ljust(width[c]) for c in columns]
            line = " | ".join(parts).rstrip() if len(columns) > 1 else parts[0].rstrip()
            if line.strip(" |"):
                out.end()
                out.text(line, True)
                out.end()


def _render(node, out: Page, kept: bool = False, items: list | None = None) -> None:
    if isinstance(node, str):
        out.text(node, kept)
        return
    if hidden(node):
        return
    name = node.name
    if name == "br":
        if not out.now:
            out.gap = bool(out.lines)
        out.end()
        return
    if name in ("img", "input"):
        a = node.attributes()
        shown = a.get("alt", "") if name == "img" else a.get("value", "") if a.get("type", "").lower() in ("submit", "button", "reset") else ""
        out.text(shown)
        return
    block, paragraph = name in BLOCK, name in PARAGRAPH
    if paragraph and name in ("ul", "ol", "menu") and items is not None:
        paragraph = False  # lists within lists leave no empty line
    if block:
        out.end()
        out.gap = out.gap or paragraph
    before = out.indent
    if name == "li":
        items = items if items is not None else [None]
        if items[0] is None:
            out.mark = "- "
        else:
            value = node.attributes().get("value", "").strip()
            items[0] = int(value) if re.fullmatch(r"-?[0-9]{1,9}", value) else items[0]
            out.mark = f"{items[0]}. "
            items[0] += 1
    elif name in ("ul", "menu", "dir", "ol"):
        if items is not None:
            out.indent += "  "
        start = node.attributes().get("start", "1").strip() if name == "ol" else ""
        items = [None] if name != "ol" else [int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1]
    elif name == "dd":
        out.indent += "  "
    elif name == "table":
        _table(node, out)
        out.end()
        out.gap = True
        return
    kept = kept or name in ("pre", "textarea", "listing")
    for kid in node.kids:
        _render(kid, out, kept, items)
        if name in ("q",):
            continue
    if name in CELLS:
        out.space = True
    if block:
        out.end()
        out.gap = out.gap or paragraph
        if name == "li":
            out.mark = ""
        out.indent = before


def text_of(html: str | None) -> str:
    """All visible text of a page; '' for null, empty or wholly hidden pages."""
    out = Page()
    _render(parse(html or ""), out)
    return out.result()


def _extracted(batches):
    import sys

    sys.setrecursionlimit(10_000_000)  # as deep as a page nests; frames are on the heap
    for batch in batches:
        texts = [text_of(x) for x in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_lines) for every row of ``pages`` (page_id, url, html; other columns are ignored).

    Null and empty pages give ''. Malformed markup is read as browsers read it; nothing is ever an error. An empty table
    gives no rows. Repeated rows have equal texts.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    out = rows.mapInArrow(lean(_extracted), "page_id long, url string, text string")
    lines = F.when(F.col("text") == "", 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"))
