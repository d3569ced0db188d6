"""Embedded facts are read without the parser, except where it would fail."""

from ledgerloom.sources import documents

FACT = '<xbrli:context id="c"><xbrli:period><xbrli:instant>2024-12-31</xbrli:instant></xbrli:period></xbrli:context><ix:nonFraction name="us-gaap:Revenues" contextRef="c" unitRef="usd">5</ix:nonFraction>'
PAGES = [FACT, f"<table><tr><td colspan=2>1</td></tr></table>{FACT}", f"<!DOCTYPE html>{FACT}", f"<p>&#65;</p>{FACT}", f"<![bad[{FACT}", f"<p>&#{'9' * 5000};</p>{FACT}", f"<td colspan={'9' * 5000}>x</td>{FACT}", "", "<"]


def test_embedded_rows_are_those_of_whole_pages():
    for page in PAGES:
        whole = [r for r in documents.page_rows(page) if r["kind"] in ("fact", "context", "error")]
        assert documents.page_rows(page, embedded=True) == whole


def test_tables_are_not_built(spark, monkeypatch):
    read = []
    monkeypatch.setattr(documents._Document, "read", lambda self, page: read.append(page))
    assert {r["kind"] for r in documents.page_rows(PAGES[1], embedded=True)} == {"fact", "context"} and not read
