"""Visible text of web pages, laid out: blocks, lists and table cells keep their place.

A tree builder reads the page's tags, opens and closes the elements that HTML implies, and a renderer walks the tree
without recursion, skips what isn't shown, and writes blocks on lines of their own, list items with their marker and
depth, and table rows with their cells in columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from unicodedata import east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist title desc defs metadata symbol clippath mask marker annotation annotation-xml".split())
#: Fields whose value isn't shown as text.
UNSHOWN = frozenset("hidden password checkbox radio file range color image".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl table pre figure select".split())
BLOCKS = PARAGRAPHS | frozenset("address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup hr html legend li main menu nav section summary caption tr thead tbody tfoot option optgroup".split())
#: A start tag closes these if open, up to the elements that bound the search.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "body": ({"head"}, set()),
}
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: An attribute; a value whose quote isn't closed ends at white space or the tag's end, as one without quotes.
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]+|=)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
TAG_END = re.compile(r"[\s/]*>")
GONE = re.compile(r"display\s*:\s*none", re.IGNORECASE)
SHOWN = re.compile(r"visibility\s*:\s*(\w+)", re.IGNORECASE)
#: Depths beyond which lists are indented no more and tables are read as blocks; widths up to which cells are aligned.
INDENT, TABLES, WIDE = 20, 8, 60
SPACE = re.compile(r"[ \t\n\r\f\x0b ]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


def tag_at(html: str, at: int) -> tuple[dict[str, str], bool, int]:
    """The attributes from ``at`` on, whether the tag closes itself, and where it ends; -1 if it never does."""
    out: dict[str, str] = {}
    while True:
        end = TAG_END.match(html, at)
        if end:
            return out, "/" in end[0], end.end()
        m = ATTRIBUTE.match(html, at)
        if not m:
            return out, False, -1
        v = next((x for x in m.groups()[1:] if x is not None), "")
        out.setdefault(m[1].lower(), unescape(v))
        at = m.end()


class Open:
    """The open elements, with the places of each tag, so that the innermost one is found without a walk."""

    def __init__(self, root: Node) -> None:
        self.stack, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.stack[-1].children.append(node)
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def innermost(self, tags: set[str] | frozenset[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            self.places[self.stack.pop().tag].pop()

    def close(self, tags: set[str] | frozenset[str], bounds: set[str] | frozenset[str]) -> None:
        """Close all of ``tags`` that are open inside the innermost of ``bounds``; of a single tag the innermost."""
        while (at := self.innermost(tags)) > self.innermost(bounds):
            self.cut(at)
            if len(tags) == 1:
                break


CELLS = frozenset(("td", "th", "table"))
REACHES = frozenset("table tr tbody thead tfoot td th body html".split())
AROUND_P = frozenset("td th table button object".split())


def build(html: str) -> Node:
    """The page's tree, in one pass: each character is read a bounded number of times."""
    root = Node("#root", {})
    now, at, size = Open(root), 0, len(html)
    kept: list[str] = []

    def told() -> None:
        if kept:
            now.stack[-1].children.append(unescape("".join(kept)))
            kept.clear()

    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            kept.append(html[at:])
            break
        kept.append(html[at:lt])
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), lt):
            end = html.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        closing = html.startswith("/", lt + 1)
        name = NAME.match(html, lt + 1 + closing)
        if not name:
            kept.append("<")
            at = lt + 1
            continue
        attrs, alone, at = tag_at(html, name.end())
        if at < 0:
            break  # a tag that the page's end cuts off
        told()
        tag = name[0].lower()
        if closing:
            place = now.innermost({tag})
            if place and (tag in REACHES or place > now.innermost(CELLS)):  # else it would reach out of a cell
                now.cut(place)
            continue
        if tag in BLOCKS and tag != "html":
            now.close({"p"}, AROUND_P)
        if tag in CLOSES:
            now.close(*CLOSES[tag])
        if tag in ("td", "th") and now.stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            now.push(Node("tr", {}))
        node = Node(tag, attrs)
        if tag in VOID or alone and tag not in RAW:
            now.stack[-1].children.append(node)
        elif tag in RAW:
            now.stack[-1].children.append(node)
            stop = ENDS[tag].search(html, at)
            raw = html[at : stop.start() if stop else size]
            node.children.append(unescape(raw) if tag in ("textarea", "title") else raw)
            at = html.find(">", stop.start()) + 1 if stop else size
            at = at or size
        else:
            now.push(node)
    told()
    return root


ENDS = {tag: re.compile(f"</{tag}[\\s/>]", re.IGNORECASE) for tag in RAW}


class Page:
    """Lines of text; a block asks for the line breaks before it, which collapse with those asked for after the last one."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.breaks, self.space, self.prefix = 0, False, ""

    def block(self, breaks: int) -> None:
        self.breaks = max(self.breaks, breaks) if self.parts else 0
        self.space = False

    def write(self, text: str) -> None:
        if self.breaks:
            self.parts.append("\n" * self.breaks)
            self.breaks = 0
            self.space = False
        if self.prefix:
            self.parts.append(self.prefix)
            self.prefix = ""
        self.parts.append((" " if self.space else "") + text)
        self.space = False

    def inline(self, text: str) -> None:
        words = SPACE.sub(" ", text)
        if words.startswith(" ") and self.parts and not self.breaks and not self.prefix:
            self.space = True
        if words.strip(" "):
            self.write(words.strip(" "))
            self.space = words.endswith(" ")

    def text(self) -> str:
        return "\n".join(x.rstrip() for x in "".join(self.parts).split("\n")).strip("\n")


def width(text: str) -> int:
    return len(text) if text.isascii() else sum(2 if east_asian_width(c) in "WF" else 1 for c in text)


Cell = tuple[str, int, int]  # text, columns, rows; no rows: all that follow


def aligned(rows: list[list[Cell]]) -> list[str]:
    """Cells in columns, two spaces apart; a cell of more lines takes more lines of its row, and one of more rows or columns keeps the others' place.

    Columns are as wide as their widest cell, of those of WIDE characters or less; where that would fill a table with
    many times as many blanks as it has text, cells are only set two spaces apart.
    """
    grid: list[dict[int, list[str]]] = []
    held: dict[int, int] = {}  # columns that a cell above takes, and for how many more rows
    for r in rows:
        line: dict[int, list[str]] = {}
        after: dict[int, int] = {j: n - 1 for j, n in held.items() if n > 1}
        j = 0
        for text, across, down in r:
            while j in held:
                j += 1
            line[j] = text.split("\n")
            if down != 1:
                after |= dict.fromkeys(range(j, j + across), down - 1 if down else 65534)
            j += across
        held = after
        if line:
            grid.append(line)
    used = sorted({j for line in grid for j, c in line.items() if c != [""]})
    wide = {j: max((w for line in grid for x in line.get(j, []) if (w := width(x)) <= WIDE), default=0) for j in used}
    text = sum(len(x) for line in grid for c in line.values() for x in c)
    padded = sum(sum(wide[j] + 2 for j in used if j <= max(line)) * max(len(c) for c in line.values()) for line in grid)
    even = padded <= 8 * text + 2000
    out = []
    for line in grid:
        for k in range(max(len(c) for c in line.values())):
            if even:
                cells = [(line[j][k] if j in line and k < len(line[j]) else "", wide[j]) for j in used if j <= max(line)]
                out.append("  ".join(x + " " * (w - width(x)) for x, w in cells).rstrip())
            else:
                out.append("  ".join(c[k] for _, c in sorted(line.items()) if k < len(c) and c[k]))
    return out


def span(node: Node, name: str, most: int) -> int:
    n = node.attrs.get(name, "")
    return min(int(n), most) if n.isascii() and n.isdigit() and len(n) < 9 else 1


def render(root: Node) -> str:
    page = Page()
    pages: list[Page] = []
    tables: list[list[list[Cell]]] = []
    lists: list[list] = []  # [kind, next number]
    pre, flat = 0, 0
    stack: list[tuple[str, Node | str, bool]] = [("in", root, True)]
    while stack:
        what, node, shown = stack.pop()
        if isinstance(node, str):
            if not shown:
                continue
            if pre:
                for i, line in enumerate(node.split("\n")):
                    if i:
                        page.block(1) if not page.breaks else page.block(page.breaks + 1)
                    if line:
                        page.write(line)
            else:
                page.inline(node)
            continue
        tag = node.tag
        if what == "in":
            a = node.attrs
            style = a.get("style", "")
            if tag in HIDDEN or "hidden" in a or GONE.search(style):
                continue
            if say := SHOWN.search(style):  # inherited, but a child may be visible again
                shown = say[1].lower() not in ("hidden", "collapse")
            if tag == "input":
                if shown and a.get("type", "text").lower() not in UNSHOWN and a.get("value", "").strip():
                    page.inline(f" {a['value']} ")
                continue
            if tag == "br":
                page.breaks += 1 if page.parts else 0
                page.space = False
                continue
            if tag == "hr":
                if shown:
                    page.block(1)
                    page.write("---")
                    page.block(1)
                continue
            if tag == "img":
                if shown and a.get("alt", "").strip():
                    page.inline(f" {a['alt']} ")
                continue
            stack.append(("out", node, shown))
            stack.extend(("in", c, shown) for c in reversed(node.children))
            if tag == "table" and len(tables) >= TABLES:
                flat += 1
            if tag in ("td", "th") and tables and not flat:
                pages.append(page)
                page = Page()
            elif tag == "tr" and tables and not flat:
                tables[-1].append([])
            elif tag in BLOCKS:
                page.block(2 if tag in PARAGRAPHS and not (lists and tag in ("ul", "ol")) else 1)
            if tag == "table" and not flat:
                tables.append([])
            elif tag in ("ul", "ol", "menu"):
                start = node.attrs.get("start", "")
                lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1]
                page.prefix = "  " * min(INDENT, max(0, len(lists) - 1)) + (f"{kind[1]}. " if kind[0] == "ol" else "- ")
                kind[1] += 1
            elif tag == "pre":
                pre += 1
            continue
        if tag in ("td", "th") and pages and tables and not flat:
            text, page = page.text(), pages.pop()
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((text, max(1, span(node, "colspan", 1000)), span(node, "rowspan", 65534)))
        elif tag in ("td", "th"):
            page.inline(" ")  # a cell without a table
        elif tag == "table" and flat:
            flat -= 1
            page.block(2)
        elif tag == "table":
            for line in aligned(tables.pop()):
                page.write(line)
                page.block(1)
            page.block(2)
        elif tag in BLOCKS and not (tag == "tr" and tables and not flat):
            page.prefix = "" if tag == "li" else page.prefix
            page.block(2 if tag in PARAGRAPHS and not (len(lists) > 1 and tag in ("ul", "ol")) else 1)
        if tag in ("ul", "ol", "menu") and lists:
            lists.pop()
        elif tag == "pre":
            pre -= 1
    return page.text()


def text_of(html: str | None) -> str:
    return render(build(html)) if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, text and n_chars.

    Null and empty pages give the empty text; broken markup is read as browsers do, as far as the implied tags go, but
    that a quote which is never closed ends with its tag. Very long and deep pages take time in proportion to their
    length, and alignment adds blanks in proportion to the text. Repeated rows are extracted each. Other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "text", "n_chars"])

    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(read, f"id {kind}, text string, n_chars long").withColumnRenamed("id", id_col)
