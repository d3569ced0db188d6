"""Document tables, embedded facts and prose on small pages."""

import datetime as d

from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import inline, narrative, tables
from ledgerloom.sources import documents


def filing(spark, form="10-K", end="2024-12-31", key="a"):
    return spark.sql(f"select '{key}' accession, '0000000001' cik, '{form}' form_type, date'2025-02-01' filing_date, cast('{end}' as date) period_end")


def page(spark, html, key="a"):
    return spark.createDataFrame([(key, html)], "accession string, html string")


def cells_of(spark, html):
    return documents.table_cells(documents.parse_documents(page(spark, html)))


def grid_of(spark, html):
    return documents.document_tables(documents.parse_documents(page(spark, html)))


def test_colspans_and_bad_spans(spark):
    got = cells_of(spark, "<table><tr><td>left</td><td colspan=3>wide</td><td colspan='0'>none</td><td colspan='many'>odd</td></tr></table>").orderBy("cell_no").collect()
    assert [(r.col_start, r.col_end) for r in got] == [(0, 0), (1, 3), (4, 4), (5, 5)]


def test_two_periods_from_headers(spark):
    html = "<table><caption>Condensed balance sheet of the group</caption><tr><td>As of</td><td>March 31, 2022</td><td>September 30, 2021</td></tr><tr><td>Total liabilities</td><td>7,208</td><td>(61)</td></tr></table>"
    rows = tables.extract_table_values(grid_of(spark, html), filing(spark)).orderBy(F.desc("period_end")).collect()
    assert [(r.metric_id, r.amount, r.period_end) for r in rows] == [("balance_sheet.total_liabilities", 7208.0, d.date(2022, 3, 31)), ("balance_sheet.total_liabilities", -61.0, d.date(2021, 9, 30))]


def test_bare_years_in_annual_statement(spark):
    html = "<table><tr><td>Statements of operations of the group</td></tr><tr><td>Item</td><td>2024</td><td>|</td><td>2022</td></tr><tr><td>Cost of sales</td><td>$ 615</td><td>|</td><td>$ 1,204</td></tr></table>"
    rows = tables.extract_table_values(grid_of(spark, html), filing(spark)).orderBy("period_end").collect()
    assert [(r.amount, r.period_end) for r in rows] == [(1204.0, d.date(2022, 12, 31)), (615.0, d.date(2024, 12, 31))]


def test_debt_table(spark):
    html = """<table><caption>Borrowings at year end (in millions)</caption><tr><td>Line</td><td>Effective interest rate</td><td>Carrying value of the line</td></tr>
    <tr><td>Senior note A</td><td>3.25%</td><td>81</td></tr><tr><td>Bond of 2041</td><td>2.5%</td><td>19</td></tr><tr><td>Group revolver</td><td>7%</td><td>33</td></tr><tr><td>Weighted average of all</td><td>3.75%</td><td></td></tr></table>"""
    got = {r.metric_id.split(".")[1]: r.amount for r in tables.debt_note_values(grid_of(spark, html)).collect()}
    assert got == {"notes_and_bonds": 100.0, "detail_senior_notes": 81.0, "revolver_balance": 33.0, "interest_rate": 3.75}


def test_secured_flow_and_balance(spark):
    html = "<table><caption>Long-term secured funding</caption><tr><td></td><td>Issuance in the year</td><td>Redemptions</td></tr><tr><td>Asset backed paper</td><td>208</td><td>77</td></tr></table><table><caption>Short-term unsecured funding</caption><tr><td>Other borrowings of the bank</td><td>n/a</td><td>12</td></tr></table>"
    grid = grid_of(spark, html)
    assert sorted((r.metric_id.split("_")[-1], r.amount) for r in tables.secured_funding_flow_values(grid).collect()) == [("issuance", 208.0), ("maturities", 77.0)]
    assert [r.amount for r in tables.funding_balance_values(grid).collect()] == [12.0]


def test_undrawn_revolver(spark):
    docs = spark.createDataFrame([("a", "At December 31, 2024 our credit facility stayed undrawn.")], "accession string, text string")
    none = spark.createDataFrame([], "accession string, metric_id string")
    assert [r.amount for r in tables.undrawn_revolver(docs, filing(spark), none).collect()] == [0.0]
    some = spark.createDataFrame([("a", "debt_and_credit.revolver_balance")], "accession string, metric_id string")
    assert tables.undrawn_revolver(docs, filing(spark), some).count() == 0


def context(key, members):
    inner = "".join(f'<xbrldi:explicitMember dimension="{a}">{m}</xbrldi:explicitMember>' for a, m in members)
    return f'<xbrli:context id="{key}">{inner}<xbrli:startDate>2024-01-01</xbrli:startDate><xbrli:endDate>2024-12-31</xbrli:endDate></xbrli:context>'


def fact(key, name, value, scale="6"):
    return f'<ix:nonFraction name="us-gaap:{name}" contextRef="{key}" unitRef="usd" scale="{scale}">{value}</ix:nonFraction>'


def test_embedded_facts_by_context(spark):
    seg, hedge = "us-gaap:StatementBusinessSegmentsAxis", "us-gaap:HedgingDesignationAxis"
    html = context("s", [(seg, "x:HarbourSegmentMember")]) + context("p", [(seg, "x:HarbourSegmentMember"), ("srt:ProductOrServiceAxis", "x:PMember")]) + context("h", [(hedge, "x:AMember")]) + context("o", [(hedge, "x:AMember"), ("x:OtherAxis", "x:BMember")]) + context("c", [])
    tag = "DerivativeGainLossOnDerivativeNet"
    html += fact("s", "Revenues", "1,360") + fact("p", "Revenues", "1") + fact("h", tag, "15") + fact("h", tag, "<b>70</b>&nbsp;") + fact("o", tag, "404") + fact("c", "Revenues", "58")
    parsed = documents.parse_documents(page(spark, html))
    facts, contexts, f = documents.inline_facts(parsed), documents.inline_contexts(parsed), filing(spark)
    assert [(r.segment_name, r.amount, r.scale) for r in inline.segment_values(facts, contexts, f).collect()] == [("Harbour Segment", 1360.0, "millions")]
    assert [(r.amount, r.scale) for r in inline.derivative_gain_loss(facts, contexts, f).collect()] == [(85.0, "millions")]
    assert [r.amount for r in inline.core_revenue_values(facts, contexts, f).collect()] == [58.0]
    assert inline.core_revenue_values(facts, contexts, filing(spark, "10-Q")).count() == 0


def test_sections(spark):
    html = "<h3>Note 9. Leases</h3><p>first part</p><li>second part</li><h4>Nothing here</h4><p>Item 2 Management's Discussion</p><p>sales grew</p>"
    blocks = documents.heading_blocks(documents.parse_documents(page(spark, html)))
    got = narrative.classify_sections(narrative.sections(blocks)).orderBy("section_no").collect()
    assert [(r.title, r.content, r.metric_id.split(".")[0]) for r in got] == [("Note 9. Leases", "first part\n\nsecond part", "footnotes"), ("Item 2 Management's Discussion", "sales grew", "mda")]


def test_null_empty_and_odd_pages(spark):
    pages = spark.createDataFrame([("a", None), ("b", ""), ("c", "<table><tr></tr></table>"), ("d", "plain <b>"), ("e", "<td>stray</td>")], "accession string, html string")
    parsed = documents.parse_documents(pages)
    assert documents.table_cells(parsed).count() == 0
    assert documents.inline_facts(parsed).count() == 0


def test_truncate_at_character(spark):
    row = spark.range(1).select(X.truncate_bytes(F.lit("ab" + "é" * 5), 5).alias("x"), X.truncate_bytes(F.lit("abc"), 5).alias("y")).first()
    assert (row.x, row.y) == ("abé", "abc")


def test_header_dates(spark):
    words = ["Year ended December 31, 2024", "Three months ended June 30, 2024", "three months ended June 29, 2024", "may be 2024", "Feb 30, 2024 March 1 2024", "June 30"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, h string")
    p = X.header_period(F.col("h"), F.lit("10-K"), F.lit(None).cast("date"), F.lit(False))
    got = {r.i: r.p and (r.p.start, r.p.end) for r in df.select("i", p.alias("p")).collect()}
    assert got == {0: (d.date(2024, 1, 1), d.date(2024, 12, 31)), 1: (d.date(2024, 4, 1), d.date(2024, 6, 30)), 2: None, 3: None, 4: (None, d.date(2024, 3, 1)), 5: None}


def test_a_page_that_fails_is_a_row(spark, monkeypatch):
    parsed = documents.parse_documents(page(spark, "<![broken]>")).collect()
    assert all(r.kind in ("error", "block", "table") for r in parsed)
    from ledgerloom.operators import review

    bad = spark.createDataFrame([("a", "error", "ValueError: odd"), ("b", "table", None)], "accession string, kind string, text string")
    got = review.documents_skipped(bad, filing(spark)).collect()
    assert [(r.code, r.period_key, r.message) for r in got] == [("html_fallback_skipped", "a", "the document could not be read: ValueError: odd (a)")]


def test_document_folder(spark, tmp_path):
    folder = tmp_path / "17" / "000000001725000003"
    folder.mkdir(parents=True)
    (folder / "report.htm").write_text("<p>one</p>\n<p>two</p>")
    (tmp_path / "0000000018-25-000004.htm").write_text("<p>three</p>")
    (tmp_path / "readme.htm").write_text("x")
    got = {(r.accession, r.html) for r in documents.scan_documents(spark, f"{tmp_path}/*.htm").unionByName(documents.scan_documents(spark, f"{tmp_path}/*/*/*.htm")).collect()}
    assert got == {("0000000017-25-000003", "<p>one</p>\n<p>two</p>"), ("0000000018-25-000004", "<p>three</p>"), (None, "x")}


def test_report_from_documents(spark):
    from ledgerloom.plans.filing_report import FilingReport

    html = """<h2>Note 3. Inventory</h2><p>kept at cost</p><table><caption>Balance sheet</caption><tr><td>At</td><td>December 31, 2024</td></tr><tr><td>Total assets</td><td>910</td></tr></table>
    <table><caption>Statement of income</caption><tr><td>For</td><td>December 31, 2024</td></tr><tr><td>Revenues</td><td>300</td></tr><tr><td>Cost of sales</td><td>180</td></tr></table>"""
    issuers = spark.createDataFrame([("0000000001", "T", "Name", "X", "USD")], "cik string, ticker string, issuer_name string, exchange string, reported_currency string")
    filings = spark.sql("select '0000000001' cik, 'a' accession, '10-K' form_type, date'2025-02-01' filing_date, date'2024-12-31' period_end, 2024 fiscal_year, 'Q4' fiscal_quarter, false is_amendment, 'u/' url_directory, 'u/x.htm' url_primary, 'x.htm' primary_document")
    from ledgerloom.sources import payloads

    none = payloads.scan_company_facts(spark.createDataFrame([], "payload string"))
    run = FilingReport(issuers, filings, none, documents=page(spark, html))
    sheets = run.tables(["2024-12-31"])
    income = {r.row_id: r["2024-12-31"] for r in sheets["income_statement"].collect()}
    assert income == {"income_statement.revenue": "300.0", "income_statement.cost_of_goods_sold": "180.0", "income_statement.gross_profit": "120.0"}  # the last one is derived
    assert [r["2024-12-31"] for r in sheets["footnotes"].collect()] == ["kept at cost"]
    status = {r.metric_id: r.status for r in sheets["coverage_summary"].collect()}
    assert status["income_statement.gross_profit"] == status["balance_sheet.total_assets"] == status["footnotes.disclosure_text"] == "found"
    url = {r.filing_url for r in sheets["provenance"].collect()}
    assert url == {"u/x.htm"}
    assert sheets["review_warnings"].where("code = 'analyst_critical_metric_html_only'").count() == 2
