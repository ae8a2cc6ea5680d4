"""HTML pages as blocks: headings, nesting, what is left out, and elements that aren't closed."""

import pytest

from quillstone.library import Library
from quillstone.operators.html import blocks_of
from quillstone.plans import registry

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("html,want", [
    (None, []), ("", []), ("plain &amp; simple", [("text", "", "plain & simple")]),
    ("<title> A  b</title><h1>One</h1><p>x<h2>Two</h2>y<h3>Three</h3><p>z</p><h2>Four</h2>w<h1>Five</h1><p>v", [("title", "", "A b"), ("text", "One", "x"), ("text", "One > Two", "y"), ("text", "One > Two > Three", "z"), ("text", "One > Four", "w"), ("text", "Five", "v")]),
    ("<h3>Deep</h3>a<h2>Less</h2>b", [("text", "Deep", "a"), ("text", "Less", "b")]),
    ("<p>a<p>b<br>c<ul><li>d<li>e<ul><li>f</ul><li>g</ul>h", [("text", "", t) for t in ("a", "b c", "d", "e", "f", "g", "h")]),
    ("<p>a <b>bold <i>both</b> x</i> y</p>", [("text", "", "a bold both x y")]),
    ("a</div></p>b</span>c", [("text", "", "abc")]),
    ("<p>x<script>var t = '</p><p>no';</script>y<style>p{}</style> z<!-- no --></p>", [("text", "", "xy z")]),
    ("<nav><ul><li>no<nav>no</nav>no</ul></nav>yes<div><footer>no</div>again", [("text", "", "yes"), ("text", "", "again")]),
    ("<form><p>no<h1>no</h1></form><h1>yes", []),
    ("<table><tr><td>a<td>b<tr><th>c</table>", [("text", "", t) for t in "abc"]),
    ("<h1>H</h1><figure><img alt='pic'><figcaption>Cap <b>tion</b></figcaption></figure><figure><img alt='alone'></figure><figure></figure>t", [("figure", "H", "Cap tion"), ("figure", "H", "alone"), ("text", "H", "t")]),
    ("<h2>not closed<p>text", [("text", "not closed", "text")]),
    ("<html><head><title>T</title><meta x><body>b", [("title", "", "T"), ("text", "", "b")]),
    ("<svg><title>no</title><p>no</p></svg>yes<p/>no paragraph", [("text", "", "yes"), ("text", "", "no paragraph")]),
    ("a<", [("text", "", "a<")]), ("a < b <3 &nbsp;&bogus; c", [("text", "", "a < b <3 &bogus; c")]),
    ("<div>" * 5000 + "deep", [("text", "", "deep")]),
])
def test_blocks(html, want):
    assert blocks_of(html) == want


def test_time_is_linear_in_a_page():
    for html in ("<div>" * 100_000 + "<p>x" * 20_000, "<ul>" + "<div>" * 100_000 + "<li>x</li>" * 20_000, "<b>" * 100_000 + "</i>" * 100_000 + "x", "<p>" + "<b>" * 100_000 + "x<div>y"):
        assert blocks_of(html)[0][2] == "x"  # minutes if each tag went through all that are open


def test_pages_to_the_library(spark, tmp_path):
    pages = spark.createDataFrame([
        ("p1", "<title>Zinc</title><h1>Zinc heals</h1><p>Zinc heals wounds.</p><p>It does.</p><h2>References</h2><p>none</p><figure><figcaption>A wound</figcaption></figure>", ["web"]),
        ("p2", "<h1>Untitled</h1><p>gold</p>", None), ("p3", None, None), ("p1", "<p>again", None)], "doc_key string, html string, tags array<string>")
    lib = Library(spark, f"file://{tmp_path}/h", parts=2)
    assert lib.ingest_pages(pages.limit(3)) == {"rows": 3, "papers": 2}
    got = {r["id"]: (r["title"], r["type"], r["section"], r["text"], r["tags"]) for r in lib.rows().collect()}
    assert got == {
        "p1::text::0": ("Zinc", "text", "Zinc heals", "Zinc heals\nZinc heals wounds.\nIt does.", ["web"]), "p1::fig::0": ("Zinc", "figure", "Zinc heals > References", "A wound", ["web"]),
        "p2::text::0": ("Untitled", "text", "Untitled", "Untitled\ngold", None)}
    assert {r["doc_key"]: r["has_fulltext"] for r in lib.papers().collect()} == {"p1": True, "p2": True, "p3": False}
    assert lib.lexical("gold", 1).first()["id"] == "p2::text::0"
    assert lib.ingest_pages(pages.where("doc_key = 'p2'")) == {"rows": 0, "papers": 0}
    assert lib.ingest_pages(pages.limit(0)) == {"rows": 0, "papers": 0}


def test_chunks_of_all_pages(spark):
    got = registry.queries()["page_chunks"](spark, D)
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{D}/pages.parquet").collect()}
    with_text = {str(k) for k, h in pages.items() if any(b[0] == "text" for b in blocks_of(h))}
    assert {r["doc_key"] for r in got.collect()} == with_text and len(with_text) > len(pages) / 2
    for h in pages.values():
        for kind, _, text in blocks_of(h):
            assert "track(" not in text and (kind == "title" or "margin:0" not in text)
