"""Visible text of HTML pages, laid out as a browser would.

A tokenizer cuts the page into tags, text and comments; a tree builder keeps the open elements,
closes those whose end tags may be left out (p before a block, li before li, td before tr, ...)
and ignores stray end tags; the renderer walks the tree. Invisible are head, scripts, styles,
templates and the like, elements with the attribute `hidden`, or a style of display:none or
visibility:hidden, closed details but for their summary, hidden inputs, what SVG keeps for reference (title, desc,
defs, metadata, ...) and annotations of MathML. All other text is kept, menus, footers, formulas and labels
of drawings included. Blocks stand on lines of their own, paragraphs, headings, lists
and tables between blank lines; list items get "- " or their number, and are indented by depth;
table cells are aligned in columns, two spaces apart; pre keeps its white space, elsewhere white
space collapses.

A null page gives a null text, an empty one an empty text. Nesting of any depth is walked without
recursion; from MAX_TABLES nested tables on, cells are laid out as blocks. Rows are independent,
so repeated ids are rendered one by one; columns of the input are not changed.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MAX_TABLES = 8
MAX_COLUMNS = 1000

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[^<]++|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"[ \t\r\n\f]+")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
UNSEEN = frozenset("head script style template noembed noframes iframe title datalist object audio video canvas".split())
#: Not shown inside svg and math; their tags may close themselves, but for those that hold HTML, and these tags of HTML end them.
UNSEEN_FOREIGN = frozenset("title desc defs metadata symbol clippath mask pattern marker annotation annotation-xml".split())
HOLDS_HTML = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
ENDS_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong "
    "strike sub sup table tt u ul var".split()
)
UNQUOTED = re.compile(r"=\s*[^\s\"'=]+\Z")
BLOCKS = frozenset(
    "html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr legend li main menu nav ol p pre search section summary table ul option optgroup caption tr td th thead tbody tfoot".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl table pre blockquote figure hr".split())
CLOSE_P = BLOCKS - frozenset("html body td th tr caption thead tbody tfoot option optgroup legend".split())
#: An opening tag closes these open elements, up to the nearest of the limits.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "body": ({"head"}, {"html"}),
}


class Node:
    __slots__ = ("name", "attributes", "children", "foreign")

    def __init__(self, name: str, attributes: str = "", foreign: bool = False):
        self.name, self.attributes, self.children, self.foreign = name, attributes, [], foreign

    def holds_foreign(self) -> bool:
        return self.foreign and self.name not in HOLDS_HTML

    def attribute(self, name: str) -> str | None:
        if name not in self.attributes.lower():
            return None
        for m in ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return html.unescape(next((g for g in m.groups()[1:] if g is not None), ""))
        return None

    def visible(self) -> bool:
        if self.name in UNSEEN or (self.foreign and self.name in UNSEEN_FOREIGN):
            return False
        if self.attributes:
            if self.attribute("hidden") is not None or HIDING.search(self.attribute("style") or ""):
                return False
            if self.name == "input" and (self.attribute("type") or "").lower() == "hidden":
                return False
        return True


def parse(page: str) -> Node:
    """The tree of a page: nodes with texts and nodes as children."""
    root = Node("html")
    open_nodes, depth = [root], {"html": 1}

    def pop():
        depth[open_nodes.pop().name] -= 1

    def close(names, limits) -> None:
        """Close the outermost element of `names` that no limit shields."""
        cut = None
        for i in range(len(open_nodes) - 1, 0, -1):
            if open_nodes[i].name in limits:
                break
            if open_nodes[i].name in names:
                cut = i
        if cut is not None:
            while len(open_nodes) > cut:
                pop()

    at, raw = 0, None
    while at < len(page):
        if raw:
            end = re.compile(rf"</{re.escape(raw)}(?=[\s/>]|\Z)", re.I).search(page, at)
            stop = end.start() if end else len(page)
            if stop > at:
                text = page[at:stop]
                open_nodes[-1].children.append(html.unescape(text) if raw in ("textarea", "title") else text)
            at, raw = stop, None
            if at >= len(page):
                break
        m = TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            text = m[0]
            if text.startswith("<![CDATA[") and open_nodes[-1].holds_foreign():
                stop = page.find("]]>", m.start())
                open_nodes[-1].children.append(page[m.start() + 9 : stop if stop >= 0 else len(page)])
                at = stop + 3 if stop >= 0 else len(page)
                continue
            if open_nodes[-1].name == "head" and not (text[0] == "<" and len(text) > 1) and text.strip(" \t\r\n\f"):
                pop()
            if not (text[0] == "<" and len(text) > 1):
                open_nodes[-1].children.append(html.unescape(text) if "&" in text else text)
            continue
        name = name.lower()
        if m[1]:
            if name == "br":
                open_nodes[-1].children.append(Node("br"))
            elif name == "p" and not depth.get("p"):
                open_nodes[-1].children.append(Node("p"))
            elif depth.get(name) and name != "html":
                limits = {"table"} if name not in ("table", "body") else set()
                for i in range(len(open_nodes) - 1, 0, -1):
                    if open_nodes[i].name == name:
                        while len(open_nodes) > i:
                            pop()
                        break
                    if open_nodes[i].name in limits or (name not in BLOCKS and open_nodes[i].name in ("td", "th", "li")):
                        break
            continue
        if name == "html":
            continue
        if name in ENDS_FOREIGN:
            while open_nodes[-1].holds_foreign():
                pop()
        if name in ("svg", "math") or open_nodes[-1].holds_foreign():
            if open_nodes[-1].name == "head":
                pop()
            node = Node(name, m[3] or "", True)
            open_nodes[-1].children.append(node)
            if not node.attributes.endswith("/") or UNQUOTED.search(node.attributes):
                open_nodes.append(node)
                depth[name] = depth.get(name, 0) + 1
            continue
        if name in CLOSE_P and depth.get("p"):
            close({"p"}, {"table", "td", "th", "button", "caption"})
        if name in IMPLIED:
            close(*IMPLIED[name])
        elif name not in ("meta", "link", "title", "style", "script", "base", "noscript", "template") and open_nodes[-1].name == "head":
            pop()
        node = Node(name, m[3] or "")
        open_nodes[-1].children.append(node)
        if name not in VOID:
            open_nodes.append(node)
            depth[name] = depth.get(name, 0) + 1
            if name in RAW:
                raw = name
    return root


class Page:
    """Lines under construction: inline text gathers, blocks end lines."""

    def __init__(self):
        self.lines: list[str] = []
        self.text: list[str] = []
        self.gap = False
        self.prefix, self.marker = "", ""

    def put(self, text: str) -> None:
        self.text.append(text)

    def end(self) -> None:
        if not self.text:
            return
        text = "".join(self.text)
        self.text.clear()
        for part in SPACE.sub(" ", text).strip(" ").split("\x00") if "\x00" in text else [SPACE.sub(" ", text).strip(" ")]:
            if part.strip(" ") or "\x00" in text:
                self.line(part.strip(" "))

    def line(self, text: str) -> None:
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        lead = self.prefix + self.marker
        self.lines.append((lead + text).rstrip())
        self.marker = " " * len(self.marker)

    def space(self) -> None:
        self.end()
        self.gap = True


def _int(text: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return int(m[1]) if m else default


def render(root: Node, tables: int = 0) -> list[str]:
    """Lines of visible text."""
    page = Page()
    stack: list[tuple] = [("node", root)]
    lists: list[list] = []  # per open list: ordered, next number, its prefix
    while stack:
        what = stack.pop()
        if what[0] == "text":
            page.put(what[1].replace("\x00", ""))
            continue
        if what[0] == "close":
            page.end()
            if what[1] in SPACED and not (what[1] in ("ul", "ol", "menu") and len(lists) > 1):
                page.space()
            if what[2] is not None:
                page.prefix, page.marker = what[2]
            if what[1] in ("ul", "ol", "menu"):
                lists.pop()
            continue
        node = what[1]
        name = node.name
        if not node.visible():
            continue
        if name == "br":
            page.put("\x00")
        elif name == "hr":
            page.space()
        elif name == "img":
            pass
        elif name == "input":
            page.put(f" {node.attribute('value') or ''} ")
        elif name == "pre" or name == "textarea":
            page.space()
            text = "".join(_all_text(node)).replace("\r\n", "\n")
            for line in text.removeprefix("\n").rstrip("\n").split("\n"):
                page.line(line)
            page.space()
        elif name == "table" and tables < MAX_TABLES:
            page.space()
            for line in table_lines(node, tables):
                page.line(line)
            page.space()
        elif name in BLOCKS:
            page.end()
            if name in SPACED and not (name in ("ul", "ol", "menu") and lists):
                page.gap = True
            kept = None
            if name in ("ul", "ol", "menu"):
                lists.append([name == "ol", _int(node.attribute("start"), 1)])
            elif name == "li":
                kept = (page.prefix, "")
                page.prefix += page.marker if not page.marker.strip() else ""
                marker = "- "
                if lists and lists[-1][0]:
                    number = _int(node.attribute("value"), lists[-1][1])
                    lists[-1][1] = number + 1
                    marker = f"{number}. "
                page.marker = marker
            elif name == "dd" or name == "blockquote":
                kept = (page.prefix, page.marker)
                page.prefix += "    " if name == "dd" else "> "
            stack.append(("close", name, kept))
            children = node.children
            if name == "details" and node.attribute("open") is None:
                children = [c for c in children if isinstance(c, Node) and c.name == "summary"][:1]
            stack += [("text", c) if isinstance(c, str) else ("node", c) for c in reversed(children)]
        else:
            apart = [("text", " ")] if node.foreign and name == "text" else []  # labels of a drawing stand apart
            stack += [*apart, *(("text", c) if isinstance(c, str) else ("node", c) for c in reversed(node.children)), *apart]
    page.end()
    while page.lines and not page.lines[-1]:
        page.lines.pop()
    return page.lines


def _all_text(node: Node):
    stack = list(reversed(node.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            yield c
        elif c.name == "br":
            yield "\n"
        elif c.visible():
            stack += reversed(c.children)


def table_lines(table: Node, tables: int) -> list[str]:
    """A caption, then the rows with cells padded to the width of their column."""
    rows, caption, stray = [], [], Node("div")
    stack = list(reversed(table.children))
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            if c.strip():
                stray.children.append(c)
        elif not c.visible():
            continue
        elif c.name in ("thead", "tbody", "tfoot"):
            stack += reversed(c.children)
        elif c.name == "tr":
            cells = []
            for d in c.children:
                if isinstance(d, Node) and d.name in ("td", "th") and d.visible():
                    cell = Node("div")
                    cell.children = d.children
                    cells.append(render(cell, tables + 1) or [""])
                    cells += [[""]] * (min(MAX_COLUMNS, max(1, _int(d.attribute("colspan"), 1))) - 1)
                elif isinstance(d, Node) or d.strip():
                    stray.children.append(d)
            rows.append(cells)
        elif c.name == "caption":
            caption += render(c, tables)
        elif c.name not in ("colgroup", "col"):
            stray.children.append(c)
    widths: list[int] = []
    for cells in rows:
        widths += [0] * (len(cells) - len(widths))
        for i, cell in enumerate(cells):
            widths[i] = max(widths[i], max(map(len, cell)))
    out = render(stray, tables + 1) + caption
    for cells in rows:
        for k in range(max((len(c) for c in cells), default=0)):
            line = "  ".join((c[k] if k < len(c) else "").ljust(w) for c, w in zip(cells, widths, strict=False)).rstrip()
            if line:
                out.append(line)
    return out


def text_of(page: str | None) -> str | None:
    return None if page is None else "\n".join(render(parse(page)))


def extract(pages: DataFrame, column: str = "html", name: str = "text") -> DataFrame:
    """pages with the visible text of `column` as column `name` (which replaces one of that name)."""
    kept = [c for c in pages.columns if c.lower() != name.lower()]
    schema = T.StructType([*(pages.schema[c] for c in kept), T.StructField(name, T.StringType())])

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = [text_of(p) for p in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, name])

    return pages.mapInArrow(run, schema)
