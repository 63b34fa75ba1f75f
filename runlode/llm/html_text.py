"""Visible text of HTML pages, laid out: a tree builder with implied tags, then a renderer."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Generator, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Steps = Generator  #: yields the steps that go deeper, see ``run``

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is raw text; their end tag alone ends them.
RAW = frozenset("script style noscript template iframe noembed noframes xmp textarea title".split())
HIDDEN = frozenset("head script style noscript template iframe noembed noframes object audio video canvas datalist title".split())
#: What is not shown within these.
UNSEEN = {"svg": {"desc", "metadata"}, "math": {"annotation", "annotation-xml"}}
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
#: Blocks with a blank line around them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure".split())
#: What the start of an element closes if it is open, and where the search for it stops.
_P_ENDS = BLOCK - frozenset("body html td th tr tbody thead tfoot caption dd dt li option optgroup legend summary".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
#: An end tag does not reach past these for its start tag.
SCOPE = {"li": {"ul", "ol", "table"}, "p": {"table", "td", "th"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}}
_NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
_STOP = re.compile("[>\"']")
_HIDING = re.compile(r"hidden|style", re.I)  # only then are the attributes read
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
#: The most columns and rows that a cell spans, as browsers have it.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


class Node:
    __slots__ = ("attrs", "cells", "children", "name", "up")

    def __init__(self, name: str, attrs: str = "", up: Node | None = None):
        self.name, self.attrs, self.children, self.up, self.cells = name, attrs, [], up, False


def attributes(attrs: str) -> dict[str, str]:
    """The attributes of a tag by lower-case name; of one that repeats the first counts."""
    values: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attrs):
        values.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return values


def _number(attrs: str, name: str, default: int) -> int:
    if name not in attrs.lower():
        return default
    m = re.match(r"\s*(-?\d{1,9})", attributes(attrs).get(name, ""))
    return int(m[1]) if m else default


class _Stack:
    """The open elements, and for each name where it is open, so that no search walks all of them."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.at: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.name, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, i: int) -> None:
        for node in self.nodes[i:]:
            self.at[node.name].pop()
        del self.nodes[i:]

    def last(self, names: Iterable[str]) -> int:
        """The innermost open element of these names, or 0."""
        return max((self.at[x][-1] for x in names if self.at.get(x)), default=0)

    def shut(self, names: Iterable[str], stop: Iterable[str], once: bool = False) -> None:
        limit = self.last(stop)
        while (i := self.last(names)) > limit:
            self.cut(i)
            if once:
                break


def _tags(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(what, text or name, attributes, end) of all parts in order: "text", "raw", "open" or "close".

    The caller may send the place from which to go on. A quote counts only in an attribute's value. Of
    tags that never end the first is text up to the next one; from there on an angle bracket alone
    ends a tag, so that no part of the page is looked through again and again.
    """
    at, n, quotes = 0, len(page), True
    while at < n:
        i = page.find("<", at)
        if i < 0:
            yield "text", page[at:], "", n
            return
        kind, name, attrs, end = "", "", "", -1
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            end = n if end < 0 else end + 3
        elif page.startswith("<![CDATA[", i):
            stop = page.find("]]>", i + 9)
            kind, name, end = "raw", page[i + 9 : stop if stop >= 0 else n], n if stop < 0 else stop + 3
        elif page[i + 1 : i + 2] in ("!", "?"):
            end = page.find(">", i)
            end = n if end < 0 else end + 1
        elif m := _NAME.match(page, i + 1):
            stop = _tag_end(page, m.end(), quotes)
            if stop < 0 and quotes:
                quotes = False
                stop = _tag_end(page, m.end(), False) if page.find("<", m.end(), max(0, page.find(">", m.end()))) < 0 else -1
            if stop >= 0:
                kind, name, attrs, end = ("close", m[0][1:], "", stop + 1) if m[0][0] == "/" else ("open", m[0], page[m.end() : stop], stop + 1)
        if end < 0:  # no tag
            j = page.find("<", i + 1)
            yield "text", page[at : j if j >= 0 else n], "", j if j >= 0 else n
            at = j if j >= 0 else n
            continue
        if i > at:
            yield "text", page[at:i], "", i
        at = end
        if kind:
            at = (yield kind, name, attrs, end) or end


def _tag_end(page: str, at: int, quotes: bool) -> int:
    """Where the tag's closing bracket is, or -1."""
    if not quotes:
        return page.find(">", at)
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        k = m.start() - 1
        while k >= at and page[k].isspace():
            k -= 1
        at = m.end()
        if k >= 0 and page[k] == "=":
            at = page.find(m[0], at) + 1
            if not at:
                return -1
    return -1


def parse(page: str) -> Node:
    """The page as a tree. Unclosed elements end where a browser would end the common ones; stray end
    tags are ignored; a tag that never closes its angle bracket is text."""
    root = Node("html")
    stack = _Stack(root)
    nodes = stack.nodes
    parts = _tags(page)
    go_on = None
    while True:
        try:
            what, name, attrs, at = parts.send(go_on)
        except StopIteration:
            return root
        go_on = None
        if what == "text":
            nodes[-1].children.append(html.unescape(name))
            continue
        if what == "raw":
            nodes[-1].children.append(name)
            continue
        name = name.lower()
        if what == "close":
            i = stack.last((name,))
            if i > stack.last(SCOPE.get(name, ())):
                stack.cut(i)
            continue
        if name == "html":
            continue
        if name in CLOSES:
            stack.shut(*CLOSES[name])
        if name in _P_ENDS:
            stack.shut(("p",), ("td", "th", "table", "button", "object"), once=True)
        if name in BLOCK:
            stack.shut(("head",), ())
        unseen = any(name in names and stack.at.get(outer) for outer, names in UNSEEN.items())
        node = Node(name, attrs + " hidden" * unseen, nodes[-1])
        nodes[-1].children.append(node)
        if name in ("td", "th"):
            x = node.up
            while x is not None and not x.cells:
                x.cells = True
                x = x.up if x.name != "table" else None
        if name in VOID or attrs.endswith("/") and name not in BLOCK | RAW:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            body = page[at : end.start() if end else len(page)]
            node.children.append(html.unescape(body) if name == "textarea" else body)
            go_on = end.end() if end else len(page)
            continue
        stack.push(node)


def width(text: str) -> int:
    """Columns of the text on a terminal: wide characters take two, combining ones none."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def visible(node: Node) -> bool:
    return node.name not in HIDDEN and not (node.attrs and _HIDING.search(node.attrs) and hides(node.attrs))


def hides(attrs: str) -> bool:
    """Whether a hidden attribute, aria-hidden=true or the style hides the element."""
    values = attributes(attrs)
    if "hidden" in values or values.get("aria-hidden", "").strip().lower() == "true":
        return True
    style = {k.strip(): v.replace("!important", "").strip() for k, _, v in (x.partition(":") for x in values.get("style", "").lower().split(";"))}
    return style.get("display") == "none" or style.get("visibility") in ("hidden", "collapse")


class _Out:
    """Lines in the making; ``gap`` is the number of line feeds due before the next text."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.gap = 0
        self.space = False
        self.raw = ""  # blanks of preformatted text that await what follows them

    def need(self, feeds: int) -> None:
        self.gap = max(self.gap, feeds)
        self.space, self.raw = False, ""

    def write(self, text: str) -> None:
        if self.gap and self.parts:
            self.parts.append("\n" * self.gap)
        elif self.space and self.parts:
            self.parts.append(" ")
        self.parts.append(self.raw + text)
        self.gap, self.space, self.raw = 0, False, ""

    def flow(self, text: str) -> None:
        """Text in which runs of white space are one space."""
        words = _SPACE.sub(" ", text)
        if words.startswith(" ") and not self.gap:
            self.space = True
        words, tail = words.strip(" "), words.endswith(" ") and len(words) > 1
        if words:
            self.write(words)
            self.space = tail

    def keep(self, text: str) -> None:
        """Text in which white space stays."""
        if self.space:
            self.raw, self.space = " ", False
        for k, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if k:
                self.gap, self.raw = self.gap + 1, ""
            said = line.rstrip()
            if said:
                self.write(said)
                self.raw = line[len(said) :]
            else:
                self.raw += line

    def text(self) -> str:
        return "".join(self.parts)


def _line(out: _Out) -> str:
    return _SPACE.sub(" ", out.text()).strip()


def _cells(row: Node, only: bool = False) -> Steps:
    """(text, columns, rows) of the cells of a row, those in wrappers too; other text between them is a
    cell of its own.

    only: cells that are children, and nothing else.
    """
    out: list[tuple[str, int, int]] = []
    loose = _Out()
    todo: list = list(reversed(row.children))
    while todo:
        x = todo.pop()
        if isinstance(x, Node) and x.name in ("td", "th"):
            if not visible(x):
                continue
            if loose.parts:
                out.append((_line(loose), 1, 1))
            loose, inner = _Out(), _Out()
            yield _walk(x, inner)
            rows = _number(x.attrs, "rowspan", 1)
            out.append((_line(inner), min(MOST_COLUMNS, max(1, _number(x.attrs, "colspan", 1))), MOST_ROWS if rows == 0 else min(MOST_ROWS, max(1, rows))))
        elif only:
            continue
        elif not isinstance(x, Node):
            loose.flow(x)
        elif visible(x):
            if x.name != "table" and x.cells:
                todo += reversed(x.children)
            else:
                alone = Node("tr")
                alone.children.append(x)
                yield _walk(alone, loose)
    if loose.parts:
        out.append((_line(loose), 1, 1))
    return out


def _table(node: Node, out: _Out) -> Steps:
    """The rows, each in a line of its own, cells of more than one row or column in their places.

    Rows of a table's sections are one grid. Text outside rows is a line of its own.
    """
    rows: list[list[tuple[str, int, int]]] = []
    captions: list[Node] = []
    todo: list = [(node, list(reversed(node.children)), [True])]  # bare: cells outside any row make one row
    while todo:
        part, rest, bare = todo[-1]
        if not rest:
            todo.pop()
            continue
        x = rest.pop()
        if not isinstance(x, Node):
            if x.strip():
                rows.append([(_SPACE.sub(" ", x).strip(), 1, 1)])
        elif visible(x):
            if x.name == "tr":
                rows.append((yield _cells(x)))
            elif x.name in ("tbody", "thead", "tfoot"):
                todo.append((x, list(reversed(x.children)), [True]))
            elif x.name == "caption":
                captions.append(x)
            elif x.name in ("td", "th"):
                if bare[0]:
                    rows.append((yield _cells(part, True)))
                bare[0] = False
            else:
                loose = _Out()
                alone = Node("tr")
                alone.children.append(x)
                yield _walk(alone, loose)
                if loose.parts:
                    rows.append([(_line(loose), 1, 1)])
    for x in captions:
        yield _walk(x, out)
        out.need(1)
    grid: list[dict[int, str]] = []
    taken: dict[int, int] = {}  # by column the rows that a cell above still reaches into
    for r in rows:
        if not any(c for c, _, _ in r):
            taken = {c: k - 1 for c, k in taken.items() if k > 1}
            continue
        line: dict[int, str] = {}
        ahead: dict[int, int] = {}
        column = 0
        for text, columns, high in r:
            while column in taken:
                column += 1
            line[column] = text
            if high > 1:
                ahead.update(dict.fromkeys(range(column, column + columns), high - 1))
            column += columns
        taken = {c: k - 1 for c, k in taken.items() if k > 1} | ahead
        grid.append(line)
    widths: dict[int, int] = {}
    for line in grid:
        if len(line) > 1 or 0 not in line:
            for c, text in line.items():
                widths[c] = max(widths.get(c, 0), width(text))
    places, begin = {}, 0
    for c in sorted(widths):  # a column that only wide cells cover has no width
        places[c] = begin
        begin += widths[c] + 2
    for line in grid:
        out.need(1)
        if len(line) == 1 and 0 in line:
            out.write(line[0])
        else:
            shown, at = [], 0
            for c, text in sorted(line.items()):
                if text:
                    shown += (" " * (places[c] - at), text)
                    at = places[c] + width(text)
            out.write("".join(shown))
        out.need(1)


def _walk(node: Node, out: _Out, pre: bool = False) -> Steps:
    """Writes what the node holds. A step that goes deeper is handed to ``run``, so depth costs no stack."""
    todo: list = [(node, list(reversed(node.children)), pre, 0, [_number(node.attrs, "start", 1) if node.name == "ol" else 1])]
    while todo:
        part, rest, pre, feeds, number = todo[-1]
        if not rest:
            todo.pop()
            if feeds:
                out.need(feeds)
            continue
        x = rest.pop()
        if not isinstance(x, Node):
            if pre:
                out.keep(x)
            else:
                out.flow(x)
        elif not visible(x):
            continue
        elif x.name == "br":
            out.gap, out.space, out.raw = out.gap + 1 if out.parts else 0, False, ""
        elif x.name == "hr":
            out.need(1)
        elif x.name == "img":
            continue
        elif x.name == "table":
            out.need(2)
            yield _table(x, out)
            out.need(2)
        elif x.name == "li":
            out.need(1)
            mark = f"{number[0]}. " if part.name == "ol" else "- "
            number[0] += 1
            inner = _Out()
            yield _walk(x, inner, pre)
            if inner.parts:
                out.write(mark + inner.text().replace("\n", "\n" + " " * len(mark)))
            out.need(1)
        else:
            block = x.name in BLOCK or x.name == "text"  # a label of a drawing
            feeds = 0 if not block else 2 if x.name in SPACED and not (x.name in ("ul", "ol") and part.name == "li") else 1
            if feeds:
                out.need(feeds)
            inside = list(reversed(x.children))
            if x.name == "pre" and inside and isinstance(inside[-1], str):
                inside[-1] = inside[-1].removeprefix("\n")  # the line feed after the tag
            todo.append((x, inside, pre or x.name == "pre", feeds, [_number(x.attrs, "start", 1) if x.name == "ol" else 1]))


def run(steps: Steps) -> object:
    """Runs steps to their end, those that they hand out first; what one returns goes to its caller."""
    open_, value = [steps], None
    while open_:
        try:
            open_.append(open_[-1].send(value))
            value = None
        except StopIteration as e:
            open_.pop()
            value = e.value
    return value


def text_of(page: str | None) -> str:
    """All visible text of a page; null and empty pages give the empty text."""
    if not page:
        return ""
    out = _Out()
    run(_walk(parse(page), out))
    return re.sub(r"[ \t]+\n", "\n", out.text()).strip("\n")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) for each row of pages, whole, however deep or broken; rows that repeat are each rendered."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("_html"))
    kind = rows.schema["page_id"].dataType.simpleString()

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([text_of(x) for x in batch.column(1).to_pylist()], pa.string())], names=["page_id", "text"])

    return rows.mapInArrow(render, f"page_id {kind}, text string")
