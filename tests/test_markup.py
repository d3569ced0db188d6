"""Element scope: what a conforming parser makes of sloppy markup, case by case."""

import pytest

from ledgerloom.sources import documents

#: Markup and the text of its blocks in document order.
CASES = [
    ("<p>a<div>b</div>", [("p", "a"), ("div", "b")]),
    ("<p>a<p>b", [("p", "a"), ("p", "b")]),
    ("<p>a<h2>b</h2>c", [("p", "a"), ("h2", "b")]),
    ("<p>a<span>b</span>c</p>d", [("p", "a b c"), ("span", "b")]),
    ("<div>a<p>b</div>c", [("div", "a b"), ("p", "b")]),
    ("<h2>a<h3>b</h3>", [("h2", "a"), ("h3", "b")]),
    ("<h2>a</h3>b", [("h2", "a")]),
    ("<ul><li>a<li>b</ul>c", [("li", "a"), ("li", "b")]),
    ("<ul><li>a<ul><li>b</ul>c</ul>", [("li", "a b c"), ("li", "b")]),
    ("<ul><li><div>a<li>b</ul>", [("li", "a"), ("div", "a"), ("li", "b")]),
    ("<li>a<p>b<li>c", [("li", "a b"), ("p", "b"), ("li", "c")]),
    ("<p>a<table><tr><td>b</table>c", [("p", "a")]),
    ("<p>a<ul><li>b</ul>c", [("p", "a"), ("li", "b")]),
    ("a</p>b", [("p", "")]),
    ("<div>a</span>b</div>", [("div", "a b")]),
    ("<div><table><tr><td></div>a</table>b</div>c", [("div", "a b")]),
    ("<p>a<hr>b", [("p", "a")]),
    ("<p>a<br>b<img>c</p>", [("p", "a b c")]),
    ("<div>a<script>if (x) {}</script>b<style>p {}</style></div>", [("div", "a b")]),
    ("<p>a &amp; b&nbsp;c &#8364;</p>", [("p", "a & b c €")]),
    ("<p>a<!-- b -->c</p>", [("p", "a c")]),
    ("<P>a</P><DIV>b</DIV>", [("p", "a"), ("div", "b")]),
    ("<blockquote><p>a</blockquote>b<p>c", [("p", "a"), ("p", "c")]),
    ("<p>a<section>b</section>", [("p", "a")]),
]
TABLES = [
    ("<table><tr><td>a<td>b<tr><td>c</table>", [[["a", "b"], ["c"]]]),
    ("<table><tr><th>a<td>b</table>", [[["a", "b"]]]),
    ("<table><tr><td>a<p>b<td>c</table>", [[["a b", "c"]]]),
    ("<table><tr><td>a</td></tr></table><td>stray", [[["a"]]]),
    ("<table><caption>x</caption><tbody><tr><td>a</tbody></table>", [[["a"]]]),
]


@pytest.mark.parametrize("html,blocks", CASES)
def test_blocks(html, blocks):
    assert [(r["tag"], r["text"]) for r in documents.page_rows(html) if r["kind"] == "block"] == blocks


@pytest.mark.parametrize("html,tables", TABLES)
def test_tables(html, tables):
    assert [[[c["text"] for c in row["cells"]] for row in r["rows"]] for r in documents.page_rows(html) if r["kind"] == "table"] == tables


def test_scanners_are_linear():
    import time

    began = time.time()
    page = "<ix:nonFraction name='x' " * 200_000 + '<xbrli:context id="c">' * 100_000 + "undrawn credit facility " + "<script>" * 50_000
    assert list(documents.page_facts(page)) == [] and documents.page_contexts(page) == {} and documents.facility_mention(page) is not None
    assert time.time() - began < 20


def test_facts_contexts_and_mentions():
    page = """<ix:nonFraction unitRef="usd" contextRef="c" name="us-gaap:Revenues" scale="6"><b>1</b>&nbsp;2</ix:nonFraction><ix:nonFraction name="" contextRef="c">3</ix:nonFraction><ix:nonFraction name="a:B">4</ix:nonFraction>
    <xbrli:context id="c"><xbrli:instant> 2024-01-31 </xbrli:instant></xbrli:context><xbrli:context id="d"><xbrldi:explicitMember dimension="x:Axis"> x:M </xbrldi:explicitMember><xbrli:startDate>2024-01-01</xbrli:startDate><xbrli:endDate>2024-12-31</xbrli:endDate></xbrli:context>
    <xbrli:context id="c"><xbrli:instant>2024-02-29</xbrli:instant></xbrli:context><p>On March 3, 2024 the Credit&#45;Facility; our CREDIT <b>facility</b> was undrawn (2024-03-03).</p>"""
    assert list(documents.page_facts(page)) == [(0, "us-gaap:Revenues", "c", "usd", "6", "1 2")]
    assert documents.page_contexts(page) == {"c": ("instant", None, "2024-02-29", []), "d": ("duration", "2024-01-01", "2024-12-31", [{"dimension": "x:Axis", "member": "x:M"}])}
    mention = documents.facility_mention(page)
    assert "march 3 2024" in mention and "2024 03 03" in mention and "credit facility" in mention
    assert documents.facility_mention("<script>undrawn credit facility</script>") is None


def test_plain_pages_are_cut_at_their_tags(monkeypatch):
    """Pages of plain tags give what HTMLParser gives of them, without it; others still go through it."""
    pages = [
        "<table><caption>Net &amp; gross</caption><tr><td colspan=2>a > b&nbsp;c</td><TD Colspan='3'>5<b>6</b><br/>7</td><td>8<tr><th>x</table><p>tail &amp",
        "<html><body><h1>A<h2>B</h2><ul><li>1<li>2<p>3</ul></p><ix:nonFraction name=\"a:b\" contextRef=\"c\"><b>4</b></ix:nonFraction><div/>5</body>",
    ]
    other = ["<p>a < b</p>", "<p><!-- <b> -->x</p>", "<script>if (a<b) {}</script><p>x", "<td colspan='&#50;'>x", "<a b='>'>x</a>", "<p>x<"]
    assert all(documents.plain_tags(p.split("<")) is not None for p in pages) and all(documents.plain_tags(p.split("<")) is None for p in other)
    got = [documents.page_rows(p) for p in pages]
    with monkeypatch.context() as m:
        m.setattr(documents, "plain_tags", lambda pieces: None)
        assert got == [documents.page_rows(p) for p in pages]
    monkeypatch.setattr(documents._Document, "feed", lambda self, page: 1 / 0)
    assert got == [documents.page_rows(p) for p in pages] and documents.page_rows(other[0])[0]["kind"] == "error"
