"""The whole program from files: payloads, history and documents in folders, and reports rewritten by company."""

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import report
from ledgerloom.plans.filing_report import FilingReport
from ledgerloom.sources import documents, payloads


def submission(cik, filings, files=()):
    of = {"accessionNumber": 0, "filingDate": 1, "reportDate": 2, "form": 3, "primaryDocument": 4}
    return json.dumps({"cik": cik, "name": f"Company {cik}", "tickers": [f"T{cik}"], "exchanges": ["X"], "filings": {"recent": {k: [f[i] for f in filings] for k, i in of.items()}, "files": [{"name": n} for n in files]}})


def history(filings):
    of = {"accessionNumber": 0, "filingDate": 1, "reportDate": 2, "form": 3, "primaryDocument": 4}
    return json.dumps({k: [f[i] for f in filings] for k, i in of.items()})


def annual(cik, year):
    return (f"{cik:010d}-{(year + 1) % 100:02d}-000001", f"{year + 1}-02-01", f"{year}-12-31", "10-K", "main.htm")


def fact_payload(cik, values):
    rows = [{"end": f"{y}-12-31", "val": v, "accn": annual(cik, y)[0], "fy": y, "fp": "FY", "form": "10-K", "filed": f"{y + 1}-02-01"} for y, v in values.items()]
    return json.dumps({"cik": cik, "entityName": f"Company {cik}", "facts": {"us-gaap": {"Assets": {"label": "Assets", "description": "d", "units": {"USD": rows}}, "Unknown": {"label": "u", "description": "d", "units": {"USD": rows}}}}})


def page(year, revenue):
    return f"<html><body><h2>Note 1. Basis</h2><p>of {year}</p><table><caption>Statement of income</caption><tr><td>For</td><td>December 31, {year}</td></tr><tr><td>Revenues</td><td>{revenue}</td></tr></table></body></html>"


@pytest.fixture
def folders(tmp_path):
    """Company 1 has all its years in the recent list, company 2 the older ones in a history file; company 3 has nothing."""
    at = {name: tmp_path / name for name in ("submissions", "history", "facts", "documents")}
    for folder in at.values():
        folder.mkdir()
    (at["submissions"] / "one.json").write_text(submission(1, [annual(1, y) for y in (2024, 2023, 2022)], ["CIK1-old.json"]))
    (at["submissions"] / "two.json").write_text(submission(2, [annual(2, 2024)], ["CIK2-old.json"]))
    (at["submissions"] / "three.json").write_text(submission(3, []))
    (at["history"] / "CIK1-old.json").write_text("not to be opened")
    (at["history"] / "CIK2-old.json").write_text(history([annual(2, 2023), annual(2, 2024)[:3] + ("8-K", "other.htm"), annual(2, 2022), annual(2, 2015)]))
    for cik in (1, 2):
        (at["facts"] / f"{cik}.json").write_text(fact_payload(cik, {y: 1000 * cik + y for y in (2022, 2023, 2024)}))
        for y in (2022, 2024):
            folder = at["documents"] / str(cik) / annual(cik, y)[0].replace("-", "")
            folder.mkdir(parents=True)
            (folder / "main.htm").write_text(page(y, 10 * cik + y - 2000))
    stray = at["documents"] / "9" / "000000000924000001"
    stray.mkdir(parents=True)
    (stray / "main.htm").write_text(page(2024, 5) + "x" * 1_000_000)
    return {name: str(folder) for name, folder in at.items()}


def run_of(spark, folders, **how):
    return FilingReport.from_folders(spark, folders["submissions"], folders["facts"], folders["documents"], folders["history"], years=3, **how)


def test_report_from_folders(spark, folders):
    with run_of(spark, folders) as run:
        assert [p.rsplit("/", 1)[1] for p in run.history_opened] == ["CIK2-old.json"]  # company 1 spans its years
        got = sorted((r.cik[-1], r.accession, r.form_type) for r in run.filings.collect())
        assert got == sorted((str(c), annual(c, y)[0], "10-K") for c in (1, 2) for y in (2022, 2023, 2024))
        values = {(r.cik[-1], r.metric_id, r.period_key, r.amount, r.source) for r in run.primary.collect()}
        assert values == {(str(c), "balance_sheet.total_assets", f"{y}-12-31", 1000.0 * c + y, "xbrl") for c in (1, 2) for y in (2022, 2023, 2024)} | {(str(c), "income_statement.revenue", f"{y}-12-31", 10.0 * c + y - 2000, "html") for c in (1, 2) for y in (2022, 2024)}
        sheets = run.tables([f"{y}-12-31" for y in (2022, 2023, 2024)])
        assert list(sheets) == report.SHEETS
        assert {r.cik[-1] for r in sheets["company_overview"].collect()} == {"1", "2", "3"}
        assert sheets["review_warnings"].where("code = 'analyst_critical_metric_missing'").where(F.col("cik").endswith("3")).count() == 12
        wide = run.tables()
        assert list(wide) == [*report.SHEETS, report.HEADERS]
        heads = {(r.cik[-1], r.position): r.period_key for r in wide[report.HEADERS].collect()}
        assert heads == {(c, k + 1): f"{y}-12-31" for c in "12" for k, y in enumerate((2022, 2023, 2024))}
        assert {(r.cik[-1], r.p_1, r.p_2, r.p_3) for r in wide["balance_sheet"].collect()} == {("1", "3022.0", "3023.0", "3024.0"), ("2", "4022.0", "4023.0", "4024.0")}
        held = [p.removeprefix("file://") for p in run.held]
    assert held and not any(os.path.exists(p) for p in held)


def test_archives_give_what_files_give(spark, folders, tmp_path):
    """The same payloads as archives, many a file: the same run, and no list of files in the driver."""
    packed = {}
    for kind, folder in folders.items():
        files = [(os.path.relpath(os.path.join(at, n), folder), open(os.path.join(at, n)).read()) for at, _, names in os.walk(folder) for n in names if not n.endswith(".crc")]
        packed[kind] = f"file://{tmp_path}/packed-{kind}"
        payloads.write_archive(spark.createDataFrame(files, "name string, payload string"), packed[kind])
    with run_of(spark, folders) as one, run_of(spark, packed, archived=True) as other:
        for found in (lambda run: run.filings, lambda run: run.parsed.where("kind = 'table'").select("accession", "no", "text", "rows")):
            assert sorted(map(str, found(one).collect())) == sorted(map(str, found(other).collect()))
        assert other.history_opened == [] and other.filings.count() == 6 and other.fact_rows.count() == 6


def test_without_history_and_without_documents(spark, folders, tmp_path):
    (tmp_path / "none").mkdir()
    with FilingReport.from_folders(spark, folders["submissions"], folders["facts"], str(tmp_path / "none"), years=3) as run:
        assert run.filings.count() == 4 and run.primary.count() == 4
        assert {r.source for r in run.primary.collect()} == {"xbrl"}


def test_only_wanted_documents_are_opened(spark, folders):
    listed = documents.list_documents(spark, folders["documents"])
    assert {(r.accession[9], r.length > 1_000_000) for r in listed.collect()} == {("1", False), ("2", False), ("9", True)}
    filings = spark.createDataFrame([(annual(1, 2024)[0],), ("0000000009-24-000009",)], "accession string")
    pages = documents.scan_listed(listed.join(filings, "accession", "left_semi"))
    assert len(pages.inputFiles()) == 1 and [r.accession for r in pages.collect()] == [annual(1, 2024)[0]]
    parsed = documents.parsed_files(spark, folders["documents"], filings)
    assert parsed.where("kind = 'table'").count() == 1
    assert documents.parsed_files(spark, folders["documents"], filings.where("false")).count() == 0


def test_large_documents_have_tasks_of_their_own(spark, tmp_path):
    for k in range(40):
        (tmp_path / f"0000000001-25-{k:06d}.htm").write_text("x" * (3_000_000 if k == 7 else 30_000))
    from ledgerloom.sources.scratch import settings

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    with settings(spark, spark__sql__files__maxPartitionBytes="1000000", spark__sql__files__openCostInBytes="1000"):
        pages = documents.scan_listed(documents.list_documents(spark, str(tmp_path)))
        sizes = sorted(r.n for r in pages.select(F.spark_partition_id().alias("p"), F.length("html").alias("l")).groupBy("p").agg(F.sum("l").alias("n")).collect())
    assert sizes[-1] == 3_000_000 and all(n <= 1_000_000 for n in sizes[:-1]) and len(sizes) <= 4
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_nothing_after_the_parse_reads_pages(spark, folders):
    """No operator of the optimised plan names the pages, and none shuffles them."""
    from ledgerloom.operators import document_values

    filings = spark.sql("select 'a' accession, '1' cik, '10-K' form_type, date'2025-02-01' filing_date, date'2024-12-31' period_end")
    parsed = documents.parsed_once(spark.createDataFrame([("a", page(2024, 7))], "accession string, html string"))
    for df in (document_values.extract_document_values(parsed, filings), document_values.document_narratives(parsed, filings)):
        assert "html#" not in df._jdf.queryExecution().optimizedPlan().toString()


def sheets(spark, rows, warned):
    overview = spark.createDataFrame([(c, "ticker", v) for c, v in rows], "cik string, field string, value string")
    warnings = spark.createDataFrame([(c, "w", n) for c, n in warned], "cik string, code string, n int")
    return {"schema": report.schema_sheet(spark, 1), "company_overview": overview, "review_warnings": warnings}


def content(spark, path, sheet):
    return sorted((tuple(r) for r in report.import_report(spark, path)[sheet].collect()), key=str)


def test_one_company_is_rewritten(spark, tmp_path):
    path = f"file://{tmp_path}/report"
    first = sheets(spark, [("0001", "a"), ("0002", "b"), (None, "n")], [("0001", 1), ("0001", 2), ("0002", 3)])
    assert report.write_report(first, path) == ["schema", "company_overview", "review_warnings"]
    assert content(spark, path, "review_warnings") == [("0001", "w", 1), ("0001", "w", 2), ("0002", "w", 3)]
    report.write_report(sheets(spark, [("0001", "c")], []), path)
    assert content(spark, path, "company_overview") == [("0001", "ticker", "c"), ("0002", "ticker", "b"), (None, "ticker", "n")]
    assert content(spark, path, "review_warnings") == [("0002", "w", 3)]  # company 1 has none any more
    assert report.import_report(spark, path)["company_overview"].columns == ["cik", "field", "value"]
    report.write_report({"filing_index": spark.createDataFrame([("0001", "x")], "cik string, accession string")}, path)
    assert list(report.import_report(spark, path)) == ["schema", "company_overview", "filing_index", "review_warnings"]


def test_half_written_report_is_refused(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/report"
    report.write_report(sheets(spark, [("0001", "a")], [("0001", 1)]), path)
    broken = sheets(spark, [("0001", "b")], [])
    broken["review_warnings"] = broken["review_warnings"].withColumn("n", F.raise_error(F.lit("stop")).cast("int")).unionByName(spark.sql("select '0001' cik, 'w' code, cast(raise_error('stop') as int) n"))
    with pytest.raises(Exception, match="stop"):
        report.write_report(broken, path)
    with pytest.raises(ValueError, match="manifest"):
        report.import_report(spark, path)
    report.write_report(sheets(spark, [("0001", "b")], [("0001", 5)]), path)
    assert content(spark, path, "review_warnings") == [("0001", "w", 5)]
    spark.createDataFrame([("w", 6)], "code string, n int").write.mode("append").parquet(f"{path}/review_warnings/cik=0001")
    with pytest.raises(ValueError, match="manifest says 1"):
        report.import_report(spark, path)
