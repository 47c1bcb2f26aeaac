"""HTML extraction: a tree builder with implied tags and visibility rules, rendered with layout.

The tokeniser yields tags, text and comments; the builder keeps a stack of open elements,
closes what HTML says is closed by the next tag, and writes text as it goes: blocks on lines of
their own, paragraphs apart by an empty line, lists with markers, table cells in aligned columns
(over the columns and rows that they span), preformatted text as it stands. Everything visible is
kept, navigation and footers included. Time and memory follow the source's length: open elements
are found by their names' positions, and layout has bounds beyond which text goes on unaligned.
"""

from __future__ import annotations

import html
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Quotes delimit a value directly after "=" alone; elsewhere they are characters like others.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?)*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)?))?""")
#: Where quotes don't balance, a tag ends at the next ">".
BLIND = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
TAG_START = re.compile(r"</?[A-Za-z]")
SELF_CLOSED = re.compile(r"""(?:\A|[\s"'/]|(?:\A|\s)[^\s=]+)/\Z""")
SPACE = re.compile(r"[ \t\n\r\f]+")

#: Fixed values of the HTML standard: kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes audio video canvas datalist meta link base".split())
#: Not displayed inside <svg> or <math>; HTML elements that end open ones of these; elements whose text stands apart.
FOREIGN = frozenset("svg math".split())
FOREIGN_UNSEEN = frozenset("defs desc metadata symbol clippath mask marker pattern annotation annotation-xml".split())
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
SPACED = frozenset("select optgroup option text".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr caption ul".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr".split())
#: What may stand in <head>; anything else, and text, ends an open one.
IN_HEAD = frozenset("head base link meta title noscript noframes style script template".split())
#: An open <p> ends where one of these begins.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: A tag ends these open elements, up to the given boundaries.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "body": (("head",), ()),
}
SCOPE = frozenset("table td th caption button object".split())
#: Bounds of layout: columns of indentation, of a table cell, tables within tables, a table's columns. Text beyond them is kept, unaligned.
MOST_INDENT, MOST_WIDTH, MOST_NESTED, MOST_COLUMNS = 80, 120, 16, 200
#: Fixed values of the HTML standard: a cell spans at most so many columns and rows.
MOST_COLSPAN, MOST_ROWSPAN = 1000, 65534
HIDING = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)


def width(text: str) -> int:
    """Columns of a text in a fixed-width font: wide characters take two, combining marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Lines of a block context; text collapses white space, breaks ask for lines or empty lines."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.gap = False
        self.indent = 0
        self.marker = ""

    def text(self, s: str) -> None:
        words = SPACE.sub(" ", s)
        if not words:
            return
        if words[0] == " ":
            self.space = True
            words = words[1:]
            if not words:
                return
        if self.space and self.parts:
            self.parts.append(" ")
        self.space = words[-1] == " "
        self.parts.append(words[:-1] if self.space else words)

    def end_line(self, even_empty: bool = False) -> None:
        if self.parts or even_empty:
            if self.gap and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = False
            lead = " " * min(self.indent, MOST_INDENT)
            if self.marker:
                cut = len(lead) - width(self.marker)
                lead, self.marker = lead[: max(0, cut)] + self.marker, ""
            self.lines.append((lead + "".join(self.parts)).rstrip())
            self.parts = []
        self.space = False

    def block(self, apart: bool) -> None:
        self.end_line()
        self.gap |= apart

    def pre(self, s: str) -> None:
        first, *rest = s.replace("\r\n", "\n").split("\n")
        self.parts.append(first)
        for line in rest:
            self.end_line(True)
            self.parts.append(line)


class Table:
    """Rows of cells; rendered with columns as wide as their widest cell of one column, up to MOST_WIDTH."""

    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []  # (lines, columns, rows; 0: all that follow)
        self.caption: list[str] = []

    def placed(self) -> list[list[tuple[int, int, list[str]]]]:
        """Per row (first column, end, lines) of its cells, past the columns that cells above span."""
        out, above = [], {}  # column: rows that it is still taken in
        for row in self.rows:
            at, cells, begun = 0, [], {}
            for lines, columns, rows in row:
                while above.get(at):
                    at += 1
                cells.append((at, at + columns, lines))
                if rows != 1:
                    begun |= dict.fromkeys(range(at, min(at + columns, MOST_COLUMNS)), rows - 1 if rows else MOST_ROWSPAN)
                at += columns
            above = {c: n - 1 for c, n in above.items() if n > 1} | begun
            out.append(cells)
        return out

    def lines(self) -> list[str]:
        rows = [r for r in self.placed() if any(x for _, _, x in r)]
        edges = sorted({x for r in rows for a, b, _ in r for x in (a, b)} | {0})[: MOST_COLUMNS + 1]
        of = {e: k for k, e in enumerate(edges)}
        widths = [0] * len(edges)
        for single in (True, False):
            for r in rows:
                for a, b, lines in r:
                    if b in of and (of[b] - of[a] == 1) == single:
                        room = sum(widths[of[a] : of[b]]) + 2 * (of[b] - of[a] - 1)
                        widths[of[b] - 1] += max(0, min(MOST_WIDTH, max(map(width, lines), default=0)) - room)
        starts = [0]
        for w in widths:
            starts.append(starts[-1] + w + 2 * (w > 0))
        out = list(self.caption)
        for r in rows:
            for i in range(max(len(x) for _, _, x in r)):
                parts, at = [], 0
                for a, _, lines in r:
                    if i < len(lines) and lines[i]:
                        begin = max(starts[of[a]] if a in of else 0, at + 2 if parts else 0)
                        parts += [" " * (begin - at), lines[i]]
                        at = begin + width(lines[i])
                out.append("".join(parts).rstrip())
        return out


class Renderer:
    def __init__(self):
        self.stack: list[tuple[str, object]] = []
        self.at: dict[str, list[int]] = {}  # positions in the stack by name
        self.flows = [Flow()]
        self.tables: list[Table | None] = []  # None: too deep, plain text
        self.spans: list[tuple[int, int]] = []  # of the open cells
        self.lists: list[list] = []
        self.hidden = 0
        self.foreign = 0
        self.pre = 0

    def last(self, *names: str) -> int:
        """The highest position of an open element of these names, -1 for none."""
        at = self.at
        return max([at[n][-1] for n in names if at.get(n)], default=-1)

    def cut(self, height: int) -> None:
        while len(self.stack) > height:
            self.pop()

    def text(self, s: str) -> None:
        if self.hidden and self.stack[-1][0] == "head" and s.strip(" \t\n\r\f"):
            self.pop()
        if self.hidden or not s:
            return
        if "&" in s:
            s = html.unescape(s)
        if self.tables and self.stack and self.stack[-1][0] in ("table", "tbody", "thead", "tfoot", "tr"):
            if not s.strip():
                return
        if self.pre:
            self.flows[-1].pre(s)
        else:
            self.flows[-1].text(s)

    def start(self, tag: str, attributes: str) -> None:
        if tag == "head" and len(self.stack) > len(self.at.get("html", ())):
            return
        if self.stack and self.stack[-1][0] == "head" and tag not in IN_HEAD:
            self.pop()
        if self.foreign and tag in BREAKS_OUT and self.in_foreign():
            while self.in_foreign():
                self.pop()
        rule = IMPLIED.get(tag)
        if rule:
            self.close_implied(*rule)
        if tag in ENDS_P and self.at.get("p"):
            self.close_to("p", SCOPE)
        if tag in ("td", "th") and self.tables and self.last("tr") <= self.last("table"):
            self.start("tr", "")
        if tag in VOID:
            if self.hidden:
                return
            flow = self.flows[-1]
            if tag == "br":
                flow.end_line(not flow.parts and bool(flow.lines))
            elif tag == "hr":
                flow.block(True)
            elif tag in ("img", "area"):
                alt = self.attribute(attributes, "alt")
                if alt and not self.is_hidden(attributes):
                    flow.text(html.unescape(alt))
            elif tag == "wbr":
                pass
            return
        hides = tag in UNSEEN or bool(attributes) and self.is_hidden(attributes)
        if self.foreign or tag in FOREIGN:
            inside = tag in FOREIGN or self.in_foreign()
            if inside and SELF_CLOSED.search(attributes):
                return
            hides = hides or inside and tag in FOREIGN_UNSEEN
            self.foreign += tag in FOREIGN
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, hides))
        if hides:
            self.hidden += 1
        if self.hidden:
            return
        flow = self.flows[-1]
        if tag in SPACED:
            flow.text(" ")
            if tag in ("optgroup", "option") and (label := self.attribute(attributes, "label")):
                flow.text(html.unescape(label) + " ")
        if tag in BLOCK:
            flow.block(tag in APART and not (tag in ("ul", "ol") and self.lists))
        if tag in ("ul", "ol", "menu", "dir"):
            start = self.attribute(attributes, "start") if tag == "ol" else None
            self.lists.append([tag, int(start) if start and re.fullmatch(r"-?\d{1,9}", start) else 1])
            flow.indent += 3 if tag == "ol" else 2
        elif tag == "li":
            if self.lists:
                kind, n = self.lists[-1]
                flow.marker = f"{n}. " if kind == "ol" else "- "
                self.lists[-1][1] += 1
            else:
                flow.marker = ""
        elif tag in ("blockquote", "dd"):
            flow.indent += 2
        elif tag == "pre":
            self.pre += 1
        elif tag == "table":
            self.tables.append(Table() if len(self.tables) < MOST_NESTED else None)
        elif tag in ("tr", "td", "th", "caption") and self.tables:
            table = self.tables[-1]
            if table is None:
                flow.text(" ")
            elif tag == "tr":
                table.rows.append([])
            else:
                self.flows.append(Flow())
                self.spans.append((self.span(attributes, "colspan", MOST_COLSPAN) or 1, self.span(attributes, "rowspan", MOST_ROWSPAN)) if "span" in attributes.lower() else (1, 1))

    def end(self, tag: str) -> None:
        if tag == "p" and not self.at.get("p"):
            self.flows[-1].block(True) if not self.hidden else None
            return
        if tag == "br":
            self.start("br", "")
            return
        bound = () if tag in ("table", "body", "html") else ("table",) if tag in ("tr", "tbody", "thead", "tfoot", "caption") else ("td", "th", "caption", "table") if tag not in ("td", "th") else ("table",)
        self.close_to(tag, frozenset(bound) - {tag})

    def close_to(self, tag: str, bounds) -> None:
        at = self.last(tag)
        if at > self.last(*bounds):
            self.cut(at)

    def close_implied(self, tags, bounds) -> None:
        while (at := self.last(*tags)) > self.last(*bounds):
            self.cut(at)

    def in_foreign(self) -> bool:
        """Whether the open element is foreign, rather than HTML inside or outside of it."""
        return self.last(*FOREIGN) > self.last("foreignobject", "annotation-xml", "desc")

    def pop(self) -> None:
        tag, hides = self.stack.pop()
        self.at[tag].pop()
        self.foreign -= tag in FOREIGN
        if self.hidden:
            self.hidden -= bool(hides)
            return
        flow = self.flows[-1]
        if tag in SPACED:
            flow.text(" ")
        if tag in ("td", "th", "caption") and self.tables and self.tables[-1]:
            flow.end_line()
            self.flows.pop()
            table, spans = self.tables[-1], self.spans.pop()
            if tag == "caption":
                table.caption += flow.lines
            else:
                if not table.rows:
                    table.rows.append([])
                table.rows[-1].append((flow.lines, *spans))
            return
        if tag in BLOCK:
            flow.block(tag in APART and not (tag in ("ul", "ol") and len(self.lists) > 1))
        if tag in ("ul", "ol", "menu", "dir"):
            kind, _ = self.lists.pop()
            flow.indent -= 3 if tag == "ol" else 2
        elif tag == "li":
            flow.marker = ""
        elif tag in ("blockquote", "dd"):
            flow.indent -= 2
        elif tag == "pre":
            self.pre -= 1
        elif tag == "table":
            table = self.tables.pop()
            for line in table.lines() if table else ():
                flow.parts = [line] if line else []
                flow.end_line()
            flow.block(True)

    def is_hidden(self, attributes: str) -> bool:
        low = attributes.lower()
        if "hidden" not in low and "style" not in low:
            return False
        found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
        return "hidden" in found or bool(HIDING.search(found.get("style", ""))) or found.get("aria-hidden", "").lower() == "true"

    def span(self, attributes: str, name: str, most: int) -> int:
        value = self.attribute(attributes, name)
        return min(int(value), most) if value and re.fullmatch(r"\s*\d{1,9}\s*", value) else 1

    @staticmethod
    def attribute(attributes: str, name: str) -> str | None:
        for m in ATTRIBUTE.finditer(attributes):
            if m[1].lower() == name:
                return m[2] or m[3] or m[4] or ""
        return None


def render(source: str) -> str:
    """The visible text of an HTML document; every character reference decoded."""
    r = Renderer()
    at = begin = 0
    tags = TAG
    while (at := source.find("<", at)) >= 0:
        m = TAG.match(source, at) if tags is TAG or source.startswith(("<!", "<?"), at) else BLIND.match(source, at)
        if not m:
            if not TAG_START.match(source, at):
                at += 1
            elif tags is TAG:  # a quote that never ends: from here on, quotes don't count
                tags = BLIND
            else:  # no ">" follows
                break
            continue
        if at > begin:
            r.text(source[begin:at])
        begin = at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                r.text(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            r.end(tag)
            continue
        depth = len(r.stack)
        r.start(tag, m[3])
        if tag in RAW and not (r.foreign and len(r.stack) == depth):
            close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(source, at)
            end = source.find(">", close.end()) if close else -1
            inside, at = (source[at : close.start()], end + 1) if end >= 0 else (source[at:], len(source))
            begin = at
            if tag in ("textarea", "xmp"):
                r.text(inside)
            r.end(tag)
    r.text(source[begin:])
    r.cut(0)
    r.flows[0].end_line()
    return "\n".join(r.flows[0].lines).strip("\n")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars, n_lines per row of pages (page_id, html; others are ignored).

    Null html is empty: an empty text. Text outside all tags is visible; unclosed tags end with
    the document. Repeated rows and null ids give a row each; an empty table gives none.
    """

    def make():
        def work(batch):
            texts = [render(x) for x in batch.column("html").to_pylist()]
            return {"page_id": batch.column("page_id"), "text": texts, "n_chars": [len(t) for t in texts], "n_lines": [t.count("\n") + 1 if t else 0 for t in texts]}

        return work

    return map_rows(pages.select("page_id", F.coalesce("html", F.lit("")).alias("html")), "page_id long, text string, n_chars long, n_lines long", make)
