"""Positional period columns, duplicate rules on large groups, messages, and filings that arrive out of order."""

import json

from pyspark.sql import functions as F

from ledgerloom.operators import derive, discovery, report, review
from ledgerloom.sources import payloads
from ledgerloom.streaming import ingest


def test_every_period_has_a_column(spark):
    values = spark.createDataFrame([("1", "2022-12-31", "FY", 2022, "Q4"), ("1", "2024-12-31", "FY", 2024, "Q4"), ("1", "odd", None, None, None), ("2", "2019-03-31", "Q1", 2019, "Q1"), ("2", "2019-03-31", None, None, None)], "cik string, period_key string, period_label string, fiscal_year int, fiscal_quarter string")
    heads = report.period_headers(values)
    assert sorted(tuple(r) for r in heads.collect()) == [("1", 1, "2022-12-31", "FY2022"), ("1", 2, "2024-12-31", "FY2024"), ("1", 3, "odd", "odd"), ("2", 1, "2019-03-31", "Q1 2019")]
    rows = spark.createDataFrame([("1", "m", "M", "d", "2022-12-31", "5", 1), ("1", "m", "M", "d", "odd", "6", 1), ("1", "m", "M", "d", "odd", "7", 2), ("2", "m", "M", "d", "2019-03-31", "8", 1), ("2", "n", "N", "e", "2019-03-31", "9", 1)], "cik string, row_id string, row_label string, domain string, period_key string, value string, seq int")
    wide = report.domain_positions(rows, "d", heads, 3)
    assert wide.columns == ["cik", "row_id", "row_label", "p_1", "p_2", "p_3"]
    assert sorted(tuple(r) for r in wide.collect()) == [("1", "m", "M", "5", None, "7"), ("2", "m", "M", "8", None, None)]
    assert report.domain_positions(rows, "none", heads, 0).columns == ["cik", "row_id", "row_label"]


def ranked(spark, rows):
    """(accession, amount) of one segment metric, ranked in order."""
    made = [("1", "segment_data.segment_revenue", "2024-12-31", "s", "html", acc, float(a), "currency", "USD", "raw", k + 1, 0, False, None, f"row {k}", "Segment S") for k, (acc, a) in enumerate(rows)]
    return spark.createDataFrame(made, "cik string, metric_id string, period_key string, segment_key string, source string, accession string, amount double, unit_kind string, unit_code string, scale string, value_rank int, history_delta int, segment_total boolean, xbrl_tag string, row_label string, segment_name string").withColumns({"period_end": F.lit("2024-12-31").cast("date"), "form_type": F.lit("10-K"), "fiscal_year": F.lit(2024)})


def test_repeated_multisets(spark):
    same = [("a", 1), ("a", 2), ("a", 2), ("b", 2), ("b", 1), ("b", 2.00005)]
    flags = review.duplicate_flags(ranked(spark, same)).first()
    assert flags.sets == 1 and flags.rule_segment_repeated_sets  # amounts within the tolerance are one amount
    other = [("a", 1), ("a", 2), ("a", 2), ("b", 2), ("b", 1), ("b", 1)]
    assert review.duplicate_flags(ranked(spark, other)).first().sets == 2
    found = review.duplicate_values(ranked(spark, other)).drop("source").collect()
    assert all(r.segment_name == "Segment S" and " 6 values " in r.message for r in found)


def test_a_group_of_many_values_holds_no_list(spark):
    many = spark.range(50_000).select(F.lit("1").alias("cik"), F.lit("segment_data.segment_revenue").alias("metric_id"), F.lit("2024-12-31").alias("period_key"), F.lit("s").alias("segment_key"), F.lit("html").alias("source"), F.concat(F.lit("acc"), F.col("id") % 2).alias("accession"), F.floor(F.col("id") / 2).cast("double").alias("amount"), F.lit("currency").alias("unit_kind"), F.lit("USD").alias("unit_code"), F.lit("raw").alias("scale"), (F.col("id") + 1).cast("int").alias("value_rank"), F.lit(0).alias("history_delta"), F.lit(False).alias("segment_total"), F.lit(None).cast("string").alias("xbrl_tag"), F.lit("r").alias("row_label"), F.lit("2024-12-31").cast("date").alias("period_end"), F.lit("10-K").alias("form_type"), F.lit(2024).alias("fiscal_year"))
    df = review.duplicate_flags(many)
    assert "collect_list" not in df._jdf.queryExecution().optimizedPlan().toString()
    r = df.first()
    assert r.n == 50_000 and r.sets == 1 and r.largest == r.next_largest == 24_999.0


def test_first_missing_input(spark):
    metrics = spark.createDataFrame([("1", "income_statement.net_income", "p", 5.0), ("1", "cash_flow.capital_expenditures", "p", 1.0), ("2", "cash_flow.capital_expenditures", "p", 1.0)], "cik string, metric_id string, period_key string, amount double").withColumns({"period_start": F.lit(None).cast("date"), "period_end": F.lit(None).cast("date")})
    out = derive.compute_formulas(metrics)
    got = {(r.cik, r.metric_id.split(".")[1][:6]): r.missing_input for r in out.collect()}
    assert got == {("1", "owners"): "cash_flow.depreciation_and_amortization", ("1", "adjust"): "equity_compensation.stock_based_comp_expense", ("2", "owners"): "income_statement.net_income", ("2", "adjust"): "income_statement.net_income"}
    companies = spark.createDataFrame([("1",), ("2",), ("3",)], "cik string")
    said = {r.cik: r.message for r in review.formulas_skipped(companies, out).collect()}
    assert said["2"].endswith("lack income_statement.net_income") and said["3"].endswith("no inputs") and len(said) == 3


def lists(rows):
    of = {"accessionNumber": 0, "filingDate": 1, "reportDate": 2, "form": 3, "primaryDocument": 4}
    return {k: [r[i] for r in rows] for k, i in of.items()}


def test_filings_in_three_batches_equal_the_batch_merge(spark, tmp_path):
    recent, older = tmp_path / "recent", tmp_path / "older"
    recent.mkdir()
    older.mkdir()
    row = lambda n, form, day="2024-02-01": (f"acc-{n}", day, "2023-12-31", form, "x.htm")
    files = [
        [(older / "CIK7-001.json", lists([row(1, "old"), row(2, "old"), row(3, "old")]))],
        [(recent / "CIK7.json", {"cik": "7", "filings": {"recent": lists([row(2, "new"), row(4, "new")])}}), (older / "CIK7-002.json", lists([row(3, "older", "2023-01-01"), row(5, "old")]))],
        [(recent / "CIK8.json", {"cik": "8", "filings": {"recent": lists([row(5, "late"), row(6, "late")])}}), (older / "CIK8-001.json", lists([row(4, "never")]))],
    ]
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for batch in files:
        for path, content in batch:
            path.write_text(json.dumps(content))
        ingest.write_filings(ingest.stream_filings(spark, str(recent), str(older)), out, checkpoint).awaitTermination()
    columns = ["accession", "cik", "form_text", "filing_date"]
    got = sorted(tuple(r) for r in ingest.current_filings(spark, out).select(*columns).collect())
    first = payloads.scan_submissions(payloads.read_payloads(spark, str(recent))).drop("status")
    named = payloads.read_payloads(spark, str(older)).withColumn("cik", F.lpad(F.regexp_extract("path", "CIK0*([0-9]+)", 1), 10, "0"))
    want = discovery.merge_filings(first, payloads.scan_historical_submissions(named).drop("status"))
    assert got == sorted(tuple(r) for r in want.select(*columns).collect())
    assert {r[0]: r[2] for r in got} == {"acc-1": "old", "acc-2": "new", "acc-3": "older", "acc-4": "new", "acc-5": "late", "acc-6": "late"}


def test_files_do_not_grow_in_number_with_companies(spark, tmp_path):
    """3,000 companies are at most 64 folders a sheet; some are rewritten, all others stay, also ones that share a folder with them."""
    path = f"file://{tmp_path}/report"
    cik = F.lpad(F.col("id").cast("string"), 10, "0").alias("cik")
    made = lambda ids, word: {"schema": report.schema_sheet(spark, 1), "company_overview": ids.select(cik, F.lit("ticker").alias("field"), F.lit(word).alias("value")), "filing_index": ids.where("id % 2 = 0").select(cik, F.lit(word).alias("accession"))}
    report.write_report(made(spark.range(3000), "a"), path)
    report.write_report(made(spark.range(10), "b") | {"filing_index": spark.range(1).select(cik, F.lit("b").alias("accession"))}, path)
    files = list((tmp_path / "report").rglob("*.parquet"))
    assert len(files) <= 2 * report.BUCKETS + 10
    back = report.import_report(spark, path)
    assert {(r.value, r.n) for r in back["company_overview"].groupBy("value").agg(F.count(F.lit(1)).alias("n")).collect()} == {("a", 2990), ("b", 10)}
    assert {(r.accession, r.n) for r in back["filing_index"].groupBy("accession").agg(F.count(F.lit(1)).alias("n")).collect()} == {("a", 1495), ("b", 1)}
    old = f"file://{tmp_path}/report/company_overview/cik=0000009999"
    spark.createDataFrame([("ticker", "old")], "field string, value string").write.parquet(old)
    report.write_report(made(spark.range(1), "c"), path)  # a company folder of an older report is taken along
    assert {(r.value, r.n) for r in report.import_report(spark, path)["company_overview"].groupBy("value").agg(F.count(F.lit(1)).alias("n")).collect()} == {("a", 2990), ("b", 9), ("c", 1), ("old", 1)}
