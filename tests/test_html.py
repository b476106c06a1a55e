"""Elements of odd pages: what stands in the page, and what should be found."""

import pytest

from pagemill.operators import linking
from pagemill.sources.html import scan, tokens

LINKS = [
    ("<a href='/x'>", [("/x", "")]),
    ("<a href='/x'>one</a><a href=/y>two<a href=\"/z\"><b>Bold</b> label</a>", [("/x", "one"), ("/y", "two"), ("/z", "Bold label")]),
    ("<A HREF = '/up' data-x=\"<a href='/no'>\">Up &amp; &eacute;\n\t down</A>", [("/up", "Up & é down")]),
    ("<!-- <a href='/no'>x</a> --><a href=/yes/?a=1&amp;b=2>y", [("/yes/?a=1&b=2", "y")]),
    ("<script>'<a href=/no>'</script><style>a{}</style><a href=''>empty</a><a name=n>no href</a>", [("", "empty")]),
    ("<div><a href=/1>in <div>deep</div></div> outside <a href=/2>two</p></a> after", [("/1", "in deep"), ("/2", "two")]),
    ("<a href=/1 href=/2>twice</a>", [("/2", "twice")]),
    ("<a href='/1'>x<script>var t='<b>';</script>y</a>", [("/1", "xy")]),
    ("1 < 2 <3 <a href=/1>a<br>b<img src=x>c</a> <a href='/open", [("/1", "abc")]),
    ("<a/href=/slash>s</a><a\nhref\n=\n'/lines'>l</a><!doctype html><?php ?><a href=/last", [("/slash", "s"), ("/lines", "l")]),
    ("", []),
    (None, []),
    ("<" * 5000 + "<a href=/deep>" + "<b>" * 20000 + "t", [("/deep", "t")]),
    ("</a></a><a href=/1>x</b></i>y</a></a>", [("/1", "xy")]),
]


def test_links(spark):
    got = {}
    for r in linking.links(spark.createDataFrame([(i, h) for i, (h, _) in enumerate(LINKS)], "k int, html string"), "k", "html").collect():
        got.setdefault(r.k, []).append((r.pos, r.href, r.label))
    for i, (_, want) in enumerate(LINKS):
        assert [x[1:] for x in sorted(got.get(i, []))] == want, i


@pytest.mark.parametrize("base, href, url", [("https://h.example/a/b", "c.pdf", "https://h.example/a/c.pdf"), ("https://h.example/a/b", "/c", "https://h.example/c"), ("https://h.example/a/b", "//o.example/d", "https://o.example/d"), ("https://h.example/a/b/", "../c?x=1#y", "https://h.example/a/c?x=1#y"), ("https://h.example", " e ", "https://h.example/e"), ("http://[bad", "x", None), (None, "x", None)])
def test_addresses_are_joined(spark, base, href, url):
    page = spark.createDataFrame([(1, base, f'<a href="{href}">x</a>')], "k int, base string, html string")
    assert [r.url for r in linking.links(page, "k", "html", "base").collect()] == [url]


def test_options(spark):
    page = "<select name=other><option value=9>no</select><SELECT NAME='emetteur'><option value=All>Tous<option value='1' selected>One &lt;1&gt;<option value=\"2\"> Two </option><option value=3></option><option>no value</select><option value=5>outside"
    rows = linking.options(spark.createDataFrame([("p", page)], "k string, html string"), "k", "html", select="emetteur").orderBy("pos").collect()
    assert [(r.value, r.label) for r in rows] == [("1", "One <1>"), ("2", "Two")]
    every = linking.options(spark.createDataFrame([("p", page)], "k string, html string"), "k", "html").collect()
    assert {r.value for r in every} == {"9", "1", "2", "5"}


def test_table_rows(spark):
    page = """<table><tr><th>a<th>b<th>c<th>d
    <tr><td>1<td>x<td><time datetime='2021-06-30'>juin</time><td><a href=/no>n</a> <a class=f href='/fin/7'>Annuel <b>S1</b></a> <a href=/fin/8>second</a>
    <tr><td>1<td>x<td><time>2019</time> <time>2018</time><td>none</tr>
    <tr><td>1<td><table><tr><td>in<td>in<td>in<td><a href=/fin/inner>inner</a></table><td><time>x</time><td><a href=/fin/9>nine</a></table>"""
    rows = linking.table_row_links(spark.createDataFrame([(1, page)], "k int, html string"), "k", "html", "/fin/").orderBy("row").collect()
    assert [(r.href, r.year, r.label) for r in rows] == [(None, None, ""), ("/fin/7", 2021, "Annuel S1"), (None, 2019, ""), ("/fin/9", None, "nine"), ("/fin/inner", None, "inner")]


def test_listed_issuers(spark):
    rows = [(0, 1, "/liste/12/", " Alpha  SA"), (0, 2, "/liste/", "Menu"), (0, 3, "/liste/x", "Name"), (0, 4, "/liste/7", "B"), (0, 5, "/other/7", "Other"), (1, 1, "/liste/99", "alpha sa"), (1, 2, "/liste/3", "Beta"), (2, 1, "/liste/4", "beta"), (3, 1, "/liste/5", "Gamma"), (0, 6, "/liste/8?page=1", "Query")]
    got = linking.listed_issuers(spark.createDataFrame(rows, "page int, pos int, href string, label string"), "/liste/").collect()
    assert [(r.code, r.label) for r in got] == [("alpha sa", "Alpha  SA"), ("beta", "Beta")]


def test_texts_are_whole():
    """Texts and tags put together again say what the page says."""
    page = "<p>a &amp; b<br/>c</p><b x=1>d</b>"
    assert [t[:2] for t in tokens(page)] == [("start", "p"), ("text", "a & b"), ("start", "br"), ("text", "c"), ("end", "p"), ("start", "b"), ("text", "d"), ("end", "b")]
    assert scan("<td>alone</td>", frozenset(["td"]))[0].row == -1
