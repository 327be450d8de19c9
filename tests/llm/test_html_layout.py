import html.parser
import re
import time

import pyarrow.parquet as pq
import pytest
from skein.llm import html_layout, queries

CASES = {
    "<p>a<p>b": "a\n\nb",
    "<div>a</div><div>b <b>c</b>d</div>e": "a\nb cd\ne",
    "a<br>b<br/>c": "a\nb\nc",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e": "- a\n- b\n  - c\n- d\n\ne",
    "<ol start=9><li>a</li><li>b<br>c</li></ol>": "9. a\n10. b\n    c",
    "<table><tr><th>n<th>long head<tr><td>value<td>1</table>": "n      long head\nvalue  1",
    "<table><caption>C</caption><tr><td colspan=2>wide<td>z</tr><tr><td>aaa<td>bb<td>c</table>": "C\nwide     z\naaa  bb  c",
    "<table><tr><td>x<table><tr><td>in<td>ner</table><td>y</table>": "x        y\n\nin  ner",
    "<pre>a  b\n  c</pre>x": "a  b\n  c\n\nx",
    "<script>var t='</p>'; a<b</script>ok<style>p{}</style>": "ok",
    "<p hidden>no</p><p style='color:red; display: none'>no</p><p style='visibility:hidden'>no</p>yes": "yes",
    "<head><title>T</title><style>.ad, p.x {display:none} #q{visibility:hidden}</style></head><div class='b ad'>no</div><p class=x>no</p><div class=x>yes</div><i id=q>no</i>": "yes",
    "&lt;b&gt; &amp; &eacute; &#233; a&nbsp;b": "<b> & é é a\xa0b",
    "<!-- <p>no --><!DOCTYPE html><p>a<!-- x": "a",
    "<dl><dt>a<dd>b<dt>c<dd>d</dl>": "a\n  b\nc\n  d",
    "<select><option>a<option>b</select>": "a\nb",
    "</div></p></b>x</i>": "x",
    "a < b <c": "a < b",
    "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "<input type=hidden value=h><input type=submit value=Go><textarea>t <b></textarea>": "Go t <b>",
    "<h1>T</h1>x<hr>y": "T\n\nx\n\ny",
    "": "",
    "   ": "",
    "<td>x": "x",
}


@pytest.mark.parametrize("source", CASES)
def test_cases(source):
    assert html_layout.render(html_layout.parse(source)) == CASES[source]


WHOLE = {
    "<table><tr><form><td>x</td><td>y</td></form></tr></table>": "x  y",
    "<table><form><tr><td>x<tr><td>y</form></table>": "x\ny",
    "<table><p>x</p><tr><td>y</table>z": "x\ny\n\nz",
    "<table><tr><div>x <b>b</b></div><td>y</tr></table>": "x b\ny",
    "<table><tr><form>say: <i>x</i><td>y<td><input type=submit value=Go></form></tr></table>": "say: x\ny  Go",
    "<table><tr><table><tr><td>in</table><td>y</table>": "in\ny",
    "<table><tr><td>x</td><script>no</script><p hidden>no</p></table>": "x",
    "<style>@media print{.a{display:none}} @media (max-width:9em){.a{display:none} p{color:red}} .b{display:none}</style><p class=a>x<p class=b>no": "x",
    "<style>@media screen, print{.a{display:none}} @font-face{font-family:f} @import url(x); .b{content:'}';display:none}</style><p class=a>no<p class=b>no<p>x": "x",
    "<style media=print>.a{display:none}</style><p class=a>x": "x",
    "a <math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>no</annotation></math> b": "a E=m b",
    "<p>p <svg viewBox='0'><title>no</title><defs><text>no</text></defs><defs/><path d='M0'/><text x=1>two</text><text>words</text></svg> q</p>": "p two words q",
}


@pytest.mark.parametrize("source", WHOLE)
def test_all_visible_text_is_kept(source):
    assert html_layout.render(html_layout.parse(source)) == WHOLE[source]


class Plain(html.parser.HTMLParser):
    """Text outside elements that are never seen, in order; an independent reading of the same markup."""

    def __init__(self):
        super().__init__()
        self.words, self.off = [], 0

    def handle_starttag(self, tag, attrs):
        self.off += tag in ("head", "script", "style")

    def handle_endtag(self, tag):
        self.off -= tag in ("head", "script", "style")

    def handle_data(self, data):
        if not self.off:
            self.words += data.split()


def test_pages_keep_all_visible_words(spark):
    rows = {r.page_id: r for r in queries.op5_layout_text(spark, "/root/testdata/sf0.01").collect()}
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["page_id", "html"]).to_pylist()
    assert len(rows) == len(pages)
    for page in pages:
        p = Plain()
        p.feed(page["html"])
        p.close()
        got = re.sub(r"(?m)^( *)(- |\d+\. )", " ", rows[page["page_id"]].text)
        assert sorted("".join(got.split())) == sorted("".join(w for w in p.words)) or sorted("".join(rows[page["page_id"]].text.split())) == sorted("".join(p.words) + "-" * rows[page["page_id"]].n_items), page["page_id"]


def test_hostile_markup():
    assert html_layout.extract("<div>" * 50_000 + "x")[0] == "x"
    assert html_layout.extract("<ul><li>" * 2_000 + "x")[0].strip("- ") == "x"
    assert html_layout.extract("<table><tr><td>" * 300 + "x")[0] == "x"
    assert html_layout.extract("<" * 200_000)[1] == 1
    wide = "<table><tr><td>" + "w" * 100_000 + "<td>a" + "<tr><td>b<td>c" * 500 + "</table>"
    assert len(html_layout.extract(wide)[0]) < 200_000


def test_cells_are_aligned_at_any_size():
    long = "x" * 100
    got = html_layout.extract(f"<table><tr><td>{long}<td>b<td>c<tr><td>d<td>e<td>f</table>")[0].split("\n")
    assert got == [long, " " * 62 + "b  c", "d" + " " * 61 + "e  f"]
    assert html_layout.extract("<table><tr><td colspan=2>ab<td colspan=2>cd<tr><td colspan=2>abcd<td colspan=2>e</table>")[0] == "ab    cd\nabcd  e"


def test_time_and_size_follow_the_markup():
    wide = "<table>" + "<tr><td colspan=1000>a<td>b" * 3000 + "</table>"
    assert len(html_layout.extract(wide)[0]) < 3000 * 8
    began = time.perf_counter()
    html_layout.parse("<b><table><tr><td>" + "<div>" * 40_000 + "</b>" * 40_000 + "x")
    html_layout.parse("<p><button>" + "<div>" * 40_000 + "<li>x")
    html_layout.extract("<table><tr><td>a<td>b" * 1 + "<tr><td>c<td>d" * 40_000)
    assert time.perf_counter() - began < 15


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "<p>a", "x"), (3, "<p>a", None)], "page_id long, html string, text string")
    rows = sorted((r.page_id, r.text) for r in html_layout.visible_text(df).collect())
    assert rows == [(1, ""), (2, ""), (2, "a"), (3, "a")]
    assert html_layout.visible_text(df.limit(0)).count() == 0
