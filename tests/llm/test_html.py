"""Rendering against a brute-force renderer over the pages, spanning cells, and time in proportion to length."""

import re
import time
from html.parser import HTMLParser

import pytest

pytest.importorskip("clickloom.llm.queries")
from clickloom.llm import html_text, queries  # noqa: E402


class Tree(HTMLParser):
    """Nested (tag, children) by the standard library's tokeniser, for pages of plain blocks, lists and paragraphs."""

    BLOCKS = {"p", "ul", "li", "div", "nav", "article", "footer", "h1", "body", "html"}

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.open = [("root", [])]
        self.feed(source)
        self.close()

    def shut(self, tag):
        while self.open[-1][0] != tag:
            self.open.pop()
        self.open.pop()

    def handle_starttag(self, tag, attrs):
        names = [t for t, _ in self.open]
        if tag in self.BLOCKS and "p" in names:
            self.shut("p")
        if tag == "li" and "li" in names:
            self.shut("li")
        node = (tag, [])
        self.open[-1][1].append(node)
        if tag not in ("br", "meta"):
            self.open.append(node)

    def handle_endtag(self, tag):
        if tag in [t for t, _ in self.open]:
            self.shut(tag)

    def handle_data(self, data):
        self.open[-1][1].append(data)


def brute(source):
    lines, state = [], {"text": "", "gap": False, "mark": ""}

    def flush(even_empty=False):
        text = re.sub("[ \\t\\n\\r\\f]+", " ", state["text"]).strip(" ")
        if text or even_empty:
            if state["gap"] and lines and lines[-1]:
                lines.append("")
            lines.append(state["mark"] + text)
            state.update(gap=False, mark="")
        state["text"] = ""
        return bool(text)

    def walk(node):
        if isinstance(node, str):
            state["text"] += node
            return
        tag, children = node
        if tag in ("head", "script", "style"):
            return
        if tag == "br":
            if not flush() and lines:
                flush(True)
            return
        apart = tag in ("p", "ul", "h1")
        if tag in Tree.BLOCKS:
            flush()
            state["gap"] |= apart
        if tag == "li":
            state["mark"] = "- "
        for child in children:
            walk(child)
        if tag in Tree.BLOCKS:
            flush()
            state["gap"] |= apart
            state["mark"] = ""

    for child in Tree(source).open[0][1]:
        walk(child)
    flush()
    return "\n".join(lines).strip("\n")


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_pages_against_brute_force(spark, sf):
    """The query's whole texts, page by page."""
    source = {r.page_id: r.html or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op7_html_text(spark, sf).collect()
    assert len(got) == len(source)
    for r in got:
        want = brute(source[r.page_id])
        assert (r.text, r.n_chars, r.n_lines) == (want, len(want), want.count("\n") + 1 if want else 0)


def test_spanning_cells():
    r = html_text.render
    assert r("<table><tr><th colspan=2>heading<th>z<tr><td>a<td>b<td>c</table>") == "heading  z\na  b     c"
    assert r("<table><tr><td colspan=2>x<td>y<tr><td>aaa<td>bbb<td>c</table>") == "x         y\naaa  bbb  c"
    assert r("<table><tr><td rowspan=2>A<td>1<tr><td>2<tr><td>B<td>3</table>") == "A  1\n   2\nB  3"
    assert r("<table><tr><td>p<td rowspan=0>q<td>r<tr><td>s<td>t<tr><td>u<td>v</table>") == "p  q  r\ns     t\nu     v"
    assert r("<table><tr><td rowspan=2 colspan=2>A<td>1<tr><td>2</table>") == "A  1\n   2"
    assert r("<table><tr><td colspan=x>a<td rowspan='-1'>b<td colspan=99999999999>c</table>") == "a  b  c"
    assert r("<table><tr><td>a<p>b<td>c<tr><td>d<td>e</table>") == "a  c\nb\nd  e"


@pytest.mark.parametrize("source, kept", [
    ("<div>" * 20_000 + "x", 1),
    ("<div>x" * 20_000, 20_000),
    ('<a title="x ' * 20_000, 20_000),
    ("<p><table><td>" + "<div>x" * 20_000, 20_000),
    ("<blockquote>x" * 20_000, 20_000),
    ("<ul><li>x" * 20_000, 20_000),
    ("<table><td>x" * 20_000, 20_000),
    ("<b><i>" * 20_000 + "<p>x" * 20_000, 20_000),
    ("<table><tr>" + "<td rowspan=9999>x" * 5000 + "<tr><td>x" * 15_000, 20_000),
    ("<table><tr><td>" + "x" * 10_000 + "<td>" + "<tr><td>x<td>" * 10_000, 20_000),
    ("<svg>" + "<g>" * 20_000 + "<p>x", 1),
    ("<select>" + "<option>x" * 20_000, 20_000),
    ("x<script>" + "</script " * 20_000, 1),
], ids=range(13))
def test_time_follows_length(source, kept):
    """Nothing is lost, however deep or broken; the work does not grow with the square of the length."""
    began = time.process_time()
    assert html_text.render(source).count("x") == kept
    assert time.process_time() - began < 5
