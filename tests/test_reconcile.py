"""Reconciliation, derivation, formulas and reports on values written by hand."""

import datetime as d

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import derive, discovery, facts, reconcile, report, review
from ledgerloom.sources import payloads
from ledgerloom.streaming.ingest import append_facts, stream_company_facts

DDL = "cik string, metric_id string, segment_name string, period_start date, period_end date, accession string, form_type string, amount double, unit_kind string, unit_code string, scale string, row_label string, table_name string, section_name string, xbrl_tag string, source string, pos string"
END = d.date(2024, 12, 31)


def value(metric, amount, source="html", accession="0000000001-25-000001", label="x", table="", segment=None, start=None, end=END, tag=None, pos=[0]):
    pos[0] += 1
    return ("1", metric, segment, start, end, accession, "10-K", float(amount), "currency", "USD", "raw", label, table, table, tag, source, f"{pos[0]:06d}")


def run(spark, rows):
    return reconcile.choose_primary(reconcile.ranked_values(spark.createDataFrame(rows, DDL)))


def amounts(spark, rows):
    return sorted(r.amount for r in run(spark, rows).collect())


def primary(spark, rows):
    return reconcile.primary_values(run(spark, rows)).first()


def test_fact_preferred_and_document_kept(spark):
    rows = [value("income_statement.revenue", 645, "xbrl"), value("income_statement.revenue", 640)]
    p = primary(spark, rows)
    assert (p.amount, p.alternative_amount, p.decision) == (645.0, 640.0, "prefer_xbrl_keep_html_alternative")
    assert review.value_conflicts(reconcile.ranked_values(spark.createDataFrame(rows, DDL))).count() == 1


def test_small_values_beside_large(spark):
    m = "cash_flow.capital_expenditures"
    assert amounts(spark, [value(m, 2750), value(m, 33.5), value(m, 61)]) == [2750.0]
    assert amounts(spark, [value(m, 1450), value(m, 1450, accession="0000000001-24-000001"), value(m, 6)]) == [1450.0, 1450.0]


def test_year_beats_quarters(spark):
    m = "income_statement.cost_of_goods_sold"
    assert amounts(spark, [value(m, 8230), value(m, 2010), value(m, 2080), value(m, 2040)]) == [8230.0]


def test_debt_from_balance_sheet(spark):
    m = "balance_sheet.long_term_debt"
    rows = [value(m, 181500, table="Average balance sheets by line"), value(m, 177340, table="Balance sheet of the group"), value(m, 250, table="Fair value hierarchy")]
    assert primary(spark, rows).amount == 177340.0


def test_segment_total_promoted(spark):
    m, t = "segment_data.segment_revenue", "inline_xbrl_segment"
    rows = [value(m, x, table=t, segment="Harbour Segment") for x in (1200, 2310, 3510)]
    ranked = reconcile.ranked_values(spark.createDataFrame(rows, DDL))
    assert reconcile.primary_values(reconcile.choose_primary(ranked)).first().amount == 3510.0
    assert review.duplicate_values(ranked).count() == 0


def test_segments_share_a_group(spark):
    m = "segment_data.segment_assets"
    got = run(spark, [value(m, 1, segment="Harbour Reportable Segment"), value(m, 2, segment="Harbour Segment"), value(m, 3, segment=None)]).collect()
    assert {r.segment_name for r in got} == {"Harbour Segment"} and len(got) == 2


def test_html_dropped_only_for_same_period(spark):
    m, a, b = "cash_flow.stock_repurchases", d.date(2025, 1, 1), d.date(2025, 4, 1)
    x = spark.createDataFrame([value(m, 5, "xbrl", start=b, end=d.date(2025, 6, 30))], DDL)
    h = spark.createDataFrame([value(m, 5, start=b, end=d.date(2025, 6, 30)), value(m, 9, start=a, end=d.date(2025, 6, 30))], DDL)
    assert [r.amount for r in reconcile.drop_covered_html(x, h).collect()] == [9.0]


def test_empty_candidates(spark):
    assert run(spark, []).count() == 0


def metric(metric_id, key, amount, cik="1"):
    return (cik, metric_id, key, None, d.date.fromisoformat(key[-10:]), float(amount))


def metrics(spark, rows):
    return spark.createDataFrame(rows, "cik string, metric_id string, period_key string, period_start date, period_end date, amount double")


def test_derived(spark):
    rows = [metric("income_statement.revenue", "2024-12-31", 840), metric("income_statement.cost_of_goods_sold", "2024-01-01_to_2024-12-31", 515), metric("shareholders_equity.shares_outstanding", "2023-12-31", 72), metric("shareholders_equity.shares_outstanding", "2024-12-31", 69)]
    m = metrics(spark, rows)
    assert [r.amount for r in derive.derive_gross_profit(m).collect()] == [325.0]
    assert [r.amount for r in derive.derive_share_change(m).collect()] == [-3.0]


NAMES = derive.REQUIRED_OWNERS | derive.REQUIRED_RATIO | derive.OPTIONAL_RATIO
INPUTS = {"net_income": 200, "depreciation": 30, "capex": 50, "stock_comp": 12, "tax_effects": 4, "repurchases": 16, "shares_repurchased": 8, "share_change": 2}


def test_formulas(spark):
    m = metrics(spark, [metric(NAMES[k], "2024-12-31", v) for k, v in INPUTS.items()])
    got = {r.metric_id: (r.status, r.amount) for r in derive.compute_formulas(m).collect()}
    assert got[derive.OWNERS] == ("ok", 4500.0)
    assert got[derive.RATIO] == ("ok", pytest.approx((200 + 12 - 4 - 16 * 10 / 8) / 200))
    assert {r.status for r in derive.compute_formulas(m, treasury_yield=0.0).collect()} == {"invalid_input", "ok"}
    zero = metrics(spark, [metric(NAMES[k], "2024-12-31", 0 if k == "net_income" else v) for k, v in INPUTS.items()])
    assert {r.metric_id: r.status for r in derive.compute_formulas(zero).collect()} == {derive.OWNERS: "ok", derive.RATIO: "invalid_input"}
    assert {r.status for r in derive.compute_formulas(zero, strict=True).collect()} == {"invalid_input"}


FACTS = """{"cik": 55021, "entityName": "E", "facts": {"us-gaap": {"NetIncomeLoss": {"label": "n", "units": {"USD": [
 {"start": "2024-01-01", "end": "2024-12-31", "val": 41250, "accn": "x-25-1", "fy": 2024, "fp": "FY", "form": "10-K", "filed": "2025-02-01"}]}},
 "Assets": {"units": {"USD": [{"end": "2024-12-31", "val": 2351815000, "accn": "other", "fp": "FY", "form": "8-K"}]}}}}}"""


def test_facts_payload_and_match(spark, tmp_path):
    f = payloads.scan_company_facts(spark.createDataFrame([(FACTS,), ("not json",), (None,)], "payload string"))
    assert sorted((r.cik, r.tag, r.val) for r in f.collect()) == [("0000055021", "Assets", 2351815000.0), ("0000055021", "NetIncomeLoss", 41250.0)]
    filings = spark.sql("select '0000055021' cik, 'x-25-1' accession, '10-K' form_type, date'2025-02-01' filing_date, date'2024-12-31' period_end")
    got = {r.xbrl_tag: (r.amount, r.score) for r in facts.extract_facts(f, filings).collect()}
    assert got == {"NetIncomeLoss": (41250.0, 0), "Assets": (2351815000.0, 2)}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(FACTS)
    q = append_facts(stream_company_facts(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_history_plan(spark):
    rows = [("1", "a", "10-K", d.date(2025, 2, 1), d.date(2024, 12, 31), "x.htm"), ("1", "b", "10-K/A", d.date(2025, 3, 1), d.date(2024, 12, 31), "x.htm"), ("1", "c", "8-K", d.date(2025, 3, 1), None, "x.htm")]
    f = discovery.describe_filings(spark.createDataFrame(rows, "cik string, accession string, form_text string, filing_date date, period_end date, primary_document string"))
    kept = discovery.original_filings(f)
    assert [r.accession for r in kept.collect()] == ["a"]
    files = spark.createDataFrame([("1", "old.json")], "cik string, name string")
    assert discovery.historical_files_to_fetch(discovery.history_coverage(kept, 10), files).count() == 1
    assert discovery.historical_files_to_fetch(discovery.history_coverage(kept, 1), files).count() == 0


def test_report_roundtrip(spark, tmp_path):
    sv = run(spark, [value("balance_sheet.total_assets", 100, "xbrl"), value("balance_sheet.total_assets", 95), value("segment_data.segment_revenue", 5, segment="A & B"), value("segment_data.segment_revenue", 6, segment="C")])
    records = report.provenance_records(sv)
    assert [r.amount for r in report.duplicate_candidates(records).collect()] == [95.0]
    rows = report.metric_rows(sv.where("selected_as_primary"))
    assert {r.row_id for r in rows.where("domain = 'segment_data'").collect()} == {"segment_data.segment_revenue::a___b", "segment_data.segment_revenue::c"}
    path = str(tmp_path / "report")
    sheets = report.write_report({"schema": report.schema_sheet(spark, 1), "balance_sheet": report.domain_pivot(rows, "balance_sheet", ["2024-12-31"]), "provenance": records}, path)
    back = report.import_report(spark, path)
    assert sheets == list(back) == ["schema", "balance_sheet", "provenance"]
    assert back["balance_sheet"].first()["2024-12-31"] == "100.0"
    spark.createDataFrame([("schema_version", "9")], "key string, value string").write.mode("overwrite").parquet(f"{path}/schema")
    with pytest.raises(ValueError, match="version"):
        report.import_report(spark, path)


def test_last_value_of_a_row_wins(spark):
    rows = [value("segment_data.segment_revenue", 1000, segment="A&B"), value("segment_data.segment_revenue", 9, segment="A/B")]
    chosen = run(spark, rows).where("selected_as_primary")
    wide = report.domain_pivot(report.metric_rows(chosen.withColumn("segment_name", F.regexp_replace("segment_name", " ", ""))), "segment_data", ["2024-12-31"])
    keys = {r.segment_key: r.amount for r in chosen.collect()}
    got = {r.row_id: r["2024-12-31"] for r in wide.collect()}
    assert len(keys) == 2 and str(keys[max(keys)]) in got.values()


def test_period_labels(spark):
    rows = [("1", "a", "FY", 2024, "Q4"), ("1", "b", "Q1", 2025, "Q1"), ("1", "c", "FY", 2024, None), ("1", "d", " ", None, None)]
    got = {r.period_key: r.column_label for r in report.period_columns(spark.createDataFrame(rows, "cik string, period_key string, period_label string, fiscal_year int, fiscal_quarter string")).collect()}
    assert got == {"a": "FY2024 (a)", "b": "Q1 2025", "c": "FY2024 (c)", "d": "d"}


def test_slowest(spark):
    t = spark.createDataFrame([(x, float(i)) for i, x in enumerate("abcdef")], "document_id string, total_ms double")
    assert sorted(r.document_id for r in report.slowest_documents(t).collect()) == list("bcdef")
    assert report.slowest_documents(t.where(F.lit(False))).count() == 0
