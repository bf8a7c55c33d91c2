"""HTML to text as it would be laid out: all visible text, blocks apart, lists marked, table cells aligned.

A tokenizer splits tags from text. A tree builder opens and closes elements,
implying end tags where HTML allows leaving them out (p, li, dt, dd, option, table parts,
ruby). A renderer walks the tree: hidden elements are left out, blocks start
lines, paragraphs and headings stand apart by a blank line, list items are marked and
indented, preformatted text keeps its white space, and the cells of a table are padded so
that columns line up.

Not visible, and so left out: head, scripts, styles, templates, fallback content of
embedded media, ``hidden`` and ``display:none`` elements, ``visibility:hidden`` text, closed
details but for their summary, closed dialogs, comments.

Edge cases: null gives null, empty gives empty. A tag or comment that never ends takes the rest of
the page with it, as in browsers. Control characters other than white space are
dropped. Pages are processed whole; nesting of any depth is walked without recursion,
only tables within tables recurse, and beyond 20 levels they are laid out as plain blocks.
Repeated rows, null ids and extra columns pass through as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?|["'])*+)>""")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPACES = re.compile(r"[ \t\n\r\f]+")
_CONTROL = re.compile(r"[\x00-\x08\x0B\x0E-\x1F\x7F]+")
#: Stand-ins inside the renderer for what must survive the collapsing of white space.
_BREAK, _KEPT_SPACE, _KEPT_TAB = "\x00", "\x01", "\x02"
_PRE = str.maketrans({"\n": _BREAK, " ": _KEPT_SPACE, "\t": _KEPT_TAB, "\r": None})
_UNPRE = str.maketrans({_KEPT_SPACE: " ", _KEPT_TAB: "\t"})


def _names(names: str) -> frozenset[str]:
    return frozenset(names.split())


# Fixed values of the HTML standard, by role.
VOID = _names("area base br col embed hr img input link meta param source track wbr")
RAW = _names("script style textarea title xmp iframe noembed noframes noscript")
HIDDEN = _names("head script style template title noscript iframe noembed noframes datalist audio video object canvas area base link meta param source track rp")
BLOCK = _names("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table ul xmp caption tbody thead tfoot tr td th")
APART = _names("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr menu")
CLOSES_P = _names("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt")
HEADINGS = _names("h1 h2 h3 h4 h5 h6")
SCOPE_ENDS = _names("table td th caption template button object html body")
#: Start tag: the open elements that it ends, and where to stop looking for them.
IMPLIED = {
    "li": (_names("li"), _names("ul ol menu dir table td th")),
    "dt": (_names("dt dd"), _names("dl table td th")),
    "dd": (_names("dt dd"), _names("dl table td th")),
    "option": (_names("option"), _names("select datalist optgroup table td th")),
    "optgroup": (_names("option optgroup"), _names("select datalist table td th")),
    "rt": (_names("rt rp"), _names("ruby table td th")),
    "rp": (_names("rt rp"), _names("ruby table td th")),
    "tr": (_names("tr td th caption colgroup"), _names("table")),
    "td": (_names("td th"), _names("tr table")),
    "th": (_names("td th"), _names("tr table")),
    "tbody": (_names("tbody thead tfoot tr td th caption colgroup"), _names("table")),
    "thead": (_names("tbody thead tfoot tr td th caption colgroup"), _names("table")),
    "tfoot": (_names("tbody thead tfoot tr td th caption colgroup"), _names("table")),
    "caption": (_names("caption colgroup"), _names("table")),
    "body": (_names("head"), _names("html")),
}


#: Nesting that is kept apart, as browsers limit it.
MAX_DEPTH = 512
#: Attributes that the layout depends on.
_MATTERS = re.compile("hidden|style|open|start|span", re.I)


class Node:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: str = "") -> None:
        self.name, self.attrs, self.children = name, attrs, []


def build(page: str) -> Node:
    """The tree of a page; children are nodes and strings."""
    if _CONTROL.search(page):
        page = _CONTROL.sub("", page)
    root = Node("html")
    stack = [root]
    names = ["html"]
    at, n = 0, len(page)
    lower = ""
    find, match = page.find, _TAG.match

    def pop_to(wanted: frozenset[str], stop: frozenset[str]) -> None:
        cut = 0
        for i in range(len(names) - 1, 0, -1):
            if names[i] in wanted:
                cut = i
            elif names[i] in stop:
                break
        if cut:
            del stack[cut:], names[cut:]

    def text(piece: str) -> None:
        if names[-1] == "head" and not piece.isspace():
            del stack[-1:], names[-1:]
        if "&" in piece:
            piece = _CONTROL.sub("", unescape(piece))
        stack[-1].children.append(piece)

    while at < n:
        start = find("<", at)
        if start < 0:
            text(page[at:])
            break
        if start > at:
            text(page[at:start])
        after = page[start + 1 : start + 2]
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 2 if page.startswith("<!-->", start) else start + 4)
            at = stop + 3 if stop >= 0 else n
            continue
        if after and after in "!?" or after == "/" and not page[start + 2 : start + 3].isalpha():
            if page.startswith("</", start) and start + 2 >= n:
                text("</")
            stop = page.find(">", start)
            at = stop + 1 if stop >= 0 else n
            continue
        if not (after == "/" or after.isascii() and after.isalpha()):
            text("<")
            at = start + 1
            continue
        m = match(page, start)
        if not m:
            if after == "/" and not page[start + 2].isascii():
                at = max(page.find(">", start) + 1, 0) or n
                continue
            break  # the tag never ends
        at = m.end()
        name = m[2].lower()
        if m[1]:
            if name == "br":
                stack[-1].children.append(Node("br"))
            elif name == "p" and "p" not in names:
                stack[-1].children.append(Node("p"))
            elif name in names and name not in ("html", "body"):
                for i in range(len(names) - 1, 0, -1):
                    if names[i] == name or name in HEADINGS and names[i] in HEADINGS:
                        del stack[i:], names[i:]
                        break
                    if names[i] in SCOPE_ENDS and name not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "caption", "template"):
                        break
            continue
        if name == "html":
            continue
        if name in IMPLIED:
            pop_to(*IMPLIED[name])
        if name in CLOSES_P and "p" in names:
            for i in range(len(names) - 1, 0, -1):
                if names[i] == "p":
                    del stack[i:], names[i:]
                    break
                if names[i] in SCOPE_ENDS:
                    break
        if name in HEADINGS and names[-1] in HEADINGS:
            del stack[-1:], names[-1:]
        if names[-1] == "head" and name in BLOCK:
            del stack[-1:], names[-1:]
        node = Node(name, m[3])
        stack[-1].children.append(node)
        if name in VOID:
            continue
        if name in RAW:
            lower = lower or page.lower()
            if len(lower) != n:  # lower-casing changed the length: search letter by letter
                found = re.compile(re.escape("</" + name), re.I).search(page, at)
                stop = found.start() if found else -1
            else:
                stop = lower.find("</" + name, at)
            body = page[at : stop if stop >= 0 else n]
            if name == "textarea":
                node.children.append(unescape(body))
            elif name == "xmp":
                node.children.append(body)
            close = page.find(">", stop) if stop >= 0 else -1
            at = close + 1 if close >= 0 else n
            continue
        if name == "plaintext":
            node.children.append(page[at:])
            break
        if len(stack) < MAX_DEPTH:  # deeper elements hold nothing, so their content is their parent's
            stack.append(node)
            names.append(name)
    return root


def _attributes(node: Node) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(node.attrs):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def _shown(node: Node, attrs: dict[str, str]) -> tuple[bool, str | None]:
    """Whether the element takes part in the layout, and its visibility if it sets one."""
    if node.name in HIDDEN or "hidden" in attrs or node.name == "dialog" and "open" not in attrs or node.name == "input":
        return False, None
    style = attrs.get("style", "").lower().replace(" ", "")
    if "display:none" in style:
        return False, None
    found = re.search(r"(?:^|;)visibility:(\w+)", style)
    return True, found[1] if found else None


class _Writer:
    """Lines of text; inline pieces gather until a block begins or ends."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.indent: list[str] = []
        self.marker = ""
        self.gap = False

    def flush(self) -> None:
        if not self.inline:
            return
        joined = "".join(self.inline)
        self.inline = []
        for i, line in enumerate(joined.split(_BREAK)):
            line = _SPACES.sub(" ", line).strip(" ")
            if _KEPT_SPACE in line or _KEPT_TAB in line:
                line = line.translate(_UNPRE).rstrip()
            if line:
                self.put(line)
            elif i and self.lines and not self.gap and i < joined.count(_BREAK):
                self.lines.append("")

    def put(self, line: str) -> None:
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        lead = "".join(self.indent)
        if self.marker:
            lead = lead[: -len(self.marker)] + self.marker
            self.marker = ""
        self.lines.append(lead + line)

    def text(self) -> str:
        self.flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines)


def render(root: Node, depth: int = 0) -> str:
    """Visible text of a tree."""
    w = _Writer()
    lists: list[list] = []  # [ordered, next number]
    # Entries: (node or string, entering, preformatted, visible)
    todo: list[tuple] = [(c, True, False, True) for c in reversed(root.children)]
    while todo:
        x, entering, pre, visible = todo.pop()
        if isinstance(x, str):
            if visible:
                w.inline.append(x.translate(_PRE) if pre else x)
            continue
        name = x.name
        if not entering:
            w.flush()
            if name in ("ul", "ol", "menu", "dir"):
                lists.pop()
                w.indent.pop()
            elif name in ("li", "dd", "blockquote"):
                if name == "li":
                    w.marker = ""
                w.indent.pop()
            w.gap = w.gap or name in APART and not (name in ("ul", "ol", "menu") and lists)
            continue
        attrs = _attributes(x) if x.attrs and _MATTERS.search(x.attrs) else {}
        takes_part, sets = _shown(x, attrs)
        if not takes_part:
            continue
        if sets:
            visible = sets not in ("hidden", "collapse")
        if name == "br":
            w.inline.append(_BREAK)
            continue
        if name == "wbr":
            continue
        block = name in BLOCK
        if block:
            w.flush()
            w.gap = w.gap or name in APART and not (name in ("ul", "ol", "menu") and lists)
        if name == "table" and depth < 20:
            if visible:
                for line in _table(x, depth):
                    w.put(line)
            w.gap = True
            continue
        children = x.children
        if name == "details" and "open" not in attrs:
            first = next((c for c in children if isinstance(c, Node) and c.name == "summary"), None)
            children = [first] if first else []
        if block:
            if name in ("ul", "ol", "menu", "dir"):
                start = attrs.get("start", "").strip()
                lists.append([name == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
                w.indent.append("")
            elif name == "li":
                ordered = bool(lists) and lists[-1][0]
                w.marker = f"{lists[-1][1]}. " if ordered else "- "
                if ordered:
                    lists[-1][1] += 1
                w.indent.append(" " * len(w.marker))
            elif name in ("dd", "blockquote"):
                w.indent.append("  ")
            todo.append((x, False, pre, visible))
        pre = pre or name in ("pre", "textarea", "listing", "xmp", "plaintext")
        if name in ("pre", "listing") and children and isinstance(children[0], str) and children[0].startswith("\n"):
            children = [children[0][1:], *children[1:]]
        todo.extend((c, True, pre, visible) for c in reversed(children))
    return w.text()


def _span(text: str, most: int) -> int:
    return min(int(text), most) if re.fullmatch(r"[1-9]\d{0,5}", text.strip()) else 1


def _table(table: Node, depth: int) -> Iterator[str]:
    """Lines of a table: captions, then rows whose cells are padded to the width of their columns."""
    rows: list[tuple[str, list]] = []
    todo = list(reversed(table.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if not x.isspace() and (line := _SPACES.sub(" ", x).strip()):
                rows.append(("text", [line]))
            continue
        attrs = _attributes(x) if x.attrs and _MATTERS.search(x.attrs) else {}
        if not _shown(x, attrs)[0]:
            continue
        if x.name in ("tbody", "thead", "tfoot", "colgroup"):
            todo.extend(reversed(x.children))
        elif x.name == "tr":
            rows.append(("row", x.children))
        elif x.name in ("td", "th"):
            if rows and rows[-1][0] == "loose":
                rows[-1][1].append(x)
            else:
                rows.append(("loose", [x]))
        elif x.name != "col":
            if text := render(_wrap(x), depth + 1):
                rows.append(("text", text.split("\n")))
    grid: list[tuple[str, list]] = []
    held: dict[int, int] = {}  # column: rows that a cell above still covers
    for kind, content in rows:
        if kind == "text":
            grid.append((kind, content))
            continue
        cells: list[tuple[int, int, list[str]]] = []
        column, covered = 0, {c for c, k in held.items() if k > 0}
        for c in covered:
            held[c] -= 1
        for x in content:
            if isinstance(x, str):
                if x.isspace():
                    continue
                x = _wrap(x)
            attrs = _attributes(x) if x.attrs and _MATTERS.search(x.attrs) else {}
            shown, sets = _shown(x, attrs)
            if not shown:
                continue
            while column in covered:
                column += 1
            wide, tall = _span(attrs.get("colspan", ""), 1000), _span(attrs.get("rowspan", ""), 65534)
            lines = [] if sets in ("hidden", "collapse") else render(x if x.name in ("td", "th", "#") else _wrap(x), depth + 1).split("\n")
            cells.append((column, wide, lines))
            if tall > 1:
                held.update((c, tall - 1) for c in range(column, column + wide))
            column += wide
        grid.append(("row", cells))
    widths: dict[int, int] = {}
    for kind, cells in grid:
        if kind == "row":
            for column, wide, lines in cells:
                if wide == 1:
                    widths[column] = max(widths.get(column, 0), *map(len, lines), 0)
    gap = 2
    for kind, cells in grid:
        if kind == "text":
            yield from cells
            continue
        for i in range(max((len(lines) for _, _, lines in cells), default=0)):
            out = ""
            for column, _, lines in cells:
                if i < len(lines) and lines[i]:
                    want = sum(widths.get(c, 0) + gap for c in range(column) if c in widths)
                    out = out.ljust(want) if len(out) < want or not out else out.rstrip() + " " * gap
                    out += lines[i]
            if out.strip():
                yield out.rstrip()


def _wrap(x: Node | str) -> Node:
    out = Node("#")
    out.children.append(x)
    return out


def extract(page: str) -> str:
    return render(build(page))


def extract_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``df`` without ``html`` and with ``out``, its visible text."""
    keep = [f for f in df.schema.fields if f.name not in (html, out)]
    schema = T.StructType([*keep, T.StructField(out, T.StringType())])
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pages = b.column(b.schema.get_field_index(html)).to_pylist()
            texts = pa.array([None if p is None else extract(p) for p in pages], pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(n)) for n in names], texts], names=[*names, out])

    return df.mapInArrow(run, schema)
