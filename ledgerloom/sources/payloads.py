"""Sources: JSON payloads, document text, exchange rates and written reports as DataFrames.

Every scan takes a DataFrame with one payload a row (from spark.read.text(wholetext=True), a table, or a stream), so the same
expressions serve batch and Structured Streaming.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACTS_DDL = "cik STRING, entityName STRING, facts MAP<STRING, MAP<STRING, STRUCT<label: STRING, description: STRING, units: MAP<STRING, ARRAY<STRUCT<end: STRING, start: STRING, val: DOUBLE, accn: STRING, fy: INT, fp: STRING, form: STRING, filed: STRING, frame: STRING>>>>>>"
LISTS_DDL = "accessionNumber ARRAY<STRING>, filingDate ARRAY<STRING>, reportDate ARRAY<STRING>, form ARRAY<STRING>, primaryDocument ARRAY<STRING>"
SUBMISSIONS_DDL = f"cik STRING, name STRING, tickers ARRAY<STRING>, exchanges ARRAY<STRING>, fiscalYearEnd STRING, filings STRUCT<recent: STRUCT<{LISTS_DDL.replace(' ARRAY', ': ARRAY')}>, files: ARRAY<STRUCT<name: STRING, filingCount: INT, filingFrom: STRING, filingTo: STRING>>>"
REPORT_VERSION = "0.1.0"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: payload, path."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("payload"), F.input_file_name().alias("path"))


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """As read_payloads, of a list of files; no rows for an empty list."""
    if not paths:
        return spark.createDataFrame([], "payload string, path string")
    return spark.read.text(paths, wholetext=True).select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("path"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """As read_payloads, of an archive: a Parquet dataset of name and payload, many payloads a file, as bulk data come. path is a name."""
    return spark.read.parquet(path).select("payload", F.col("name").alias("path"))


def write_archive(payloads: DataFrame, path: str) -> None:
    """payloads(name, payload) as an archive."""
    payloads.select("name", "payload").write.parquet(path)


def _date(x):
    return F.try_to_date(x, "yyyy-MM-dd")


def scan_company_facts(payloads: DataFrame, payload: str = "payload", tags: list[str] | None = None) -> DataFrame:
    """One row per fact, with pos its place in the payload's list. Missing fields are null; cik may be a string or a number. With
    tags, a list of fixed size, others (whatever their case) are dropped inside the payload and never become rows."""
    from ledgerloom.functions.text import normalize_cik

    facts = F.col("j.facts")
    if tags is not None:
        wanted = sorted({t.lower() for t in tags})
        facts = F.transform_values(facts, lambda _, t: F.map_filter(t, lambda tag, __: F.lower(tag).isin(*wanted)))
    j = payloads.select(F.from_json(payload, FACTS_DDL).alias("j")).select("j.cik", "j.entityName", F.explode(facts).alias("taxonomy", "tags"))
    j = j.select("cik", "entityName", "taxonomy", F.explode("tags").alias("tag", "t")).select("cik", "entityName", "taxonomy", "tag", "t.label", F.explode("t.units").alias("unit", "list"))
    j = j.select("cik", "entityName", "taxonomy", "tag", "label", "unit", F.posexplode("list").alias("pos", "f"))
    return j.select(normalize_cik(F.col("cik")).alias("cik"), F.col("entityName").alias("entity_name"), "taxonomy", "tag", "label", "unit", _date(F.col("f.start")).alias("period_start"), _date(F.col("f.end")).alias("period_end"), "f.val", "f.accn", "f.fy", "f.fp", "f.form", _date(F.col("f.filed")).alias("filed"), "f.frame", "pos")


def filing_lists(parsed: DataFrame, lists: str) -> DataFrame:
    """Rows of a struct of parallel arrays; a payload whose arrays differ in length gives one row of status 'arrays_not_aligned'."""
    fields = ["accessionNumber", "filingDate", "reportDate", "form", "primaryDocument"]
    sizes = F.array(*[F.size(F.coalesce(F.col(f"{lists}.{f}"), F.expr("cast(array() as array<string>)"))) for f in fields])
    zipped = F.arrays_zip(*[F.col(f"{lists}.{f}").alias(f) for f in fields])
    empty = F.array(F.struct(*[F.lit(None).cast("string").alias(f) for f in fields]))
    even = F.array_min(sizes) == F.array_max(sizes)
    rows = parsed.select("cik", F.when(even, "ok").otherwise("arrays_not_aligned").alias("status"), F.explode(F.when(even, zipped).otherwise(empty)).alias("r"))
    return rows.select("cik", "status", F.col("r.accessionNumber").alias("accession"), F.col("r.form").alias("form_text"), _date(F.col("r.filingDate")).alias("filing_date"), _date(F.col("r.reportDate")).alias("period_end"), F.col("r.primaryDocument").alias("primary_document"))


def scan_submissions(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Recent filings of submission payloads."""
    from ledgerloom.functions.text import normalize_cik

    parsed = payloads.select(F.from_json(payload, SUBMISSIONS_DDL).alias("j")).select(normalize_cik(F.col("j.cik")).alias("cik"), F.col("j.filings.recent").alias("recent"))
    return filing_lists(parsed, "recent")


def scan_historical_submissions(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Filings of history payloads: the bare lists; payloads has the cik in a column."""
    return filing_lists(payloads.select("cik", F.from_json(payload, LISTS_DDL).alias("lists")), "lists")


def submission_headers(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Company fields of submission payloads, and the history files they list."""
    return payloads.select(F.from_json(payload, SUBMISSIONS_DDL).alias("j")).select("j.cik", "j.name", "j.tickers", "j.exchanges", "j.fiscalYearEnd", F.col("j.filings.files").alias("files"))


def history_files(headers: DataFrame) -> DataFrame:
    """cik, name of the history files that submission headers list."""
    from ledgerloom.functions.text import normalize_cik

    return headers.select(normalize_cik(F.col("cik")).alias("cik"), F.explode("files").alias("f")).select("cik", "f.name").where("name is not null")


def scan_ticker_index(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """position (text key), cik, ticker, title."""
    j = payloads.select(F.explode(F.from_json(payload, "MAP<STRING, STRUCT<cik_str: STRING, ticker: STRING, title: STRING>>")).alias("position", "r"))
    return j.select("position", F.col("r.cik_str").alias("cik"), "r.ticker", "r.title")


def scan_fx_rates(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """from_currency, to_currency, date, rate, provider_name."""
    ddl = "from_currency STRING, to_currency STRING, date DATE, rate DOUBLE, provider_name STRING"
    return spark.read.schema(ddl).option("header", True).format(form).load(path)
