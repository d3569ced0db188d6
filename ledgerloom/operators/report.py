"""Report tables: periods, wide and long rows, provenance, coverage, and the datasets they are written to."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions import text as X
from ledgerloom.functions.registry import metric_registry
from ledgerloom.operators.derive import OWNERS, RATIO
from ledgerloom.sources.payloads import REPORT_VERSION
from ledgerloom.sources.scratch import delete

#: Report sheets in order.
DOMAIN_SHEETS = ["balance_sheet", "income_statement", "cash_flow", "shareholders_equity", "segment_data", "debt_and_credit", "derivatives_and_securities", "equity_compensation", "footnotes", "mda", "valuation", "risk_factors"]
MANIFEST, NO_COMPANY = "manifest", "__HIVE_DEFAULT_PARTITION__"
HEADERS = "period_headers"  # written beside the sheets, where these have positional columns
SHEETS = ["schema", "company_overview", "filing_index", *DOMAIN_SHEETS, "provenance", "duplicate_candidates", "review_warnings", "coverage_summary", "missing_metrics", "formula_inputs"]


def period_columns(values: DataFrame) -> DataFrame:
    """cik, period_key, column_label of values(cik, period_key, period_label, fiscal_year, fiscal_quarter); a label that two
    periods of a company share is followed by the key."""
    year = F.col("fiscal_year").cast("string")
    label = (
        F.when(F.col("fiscal_year").isNotNull() & (F.upper("period_label") == "FY"), F.concat(F.lit("FY"), year))
        .when(F.col("fiscal_year").isNotNull() & F.col("fiscal_quarter").isNotNull(), F.concat_ws(" ", "fiscal_quarter", year))
        .when(F.col("fiscal_year").isNotNull(), F.concat(F.lit("FY"), year))
        .when(F.trim("period_label") != "", F.col("period_label"))
        .otherwise(F.col("period_key"))
    )
    one = values.groupBy("cik", "period_key").agg(F.min(label).alias("label"))
    n = F.count(F.lit(1)).over(Window.partitionBy("cik", "label"))
    return one.select("cik", "period_key", F.when(n > 1, F.concat(F.col("label"), F.lit(" ("), F.col("period_key"), F.lit(")"))).otherwise(F.col("label")).alias("column_label"))


def metric_rows(primary: DataFrame, formulas: DataFrame | None = None, narratives: DataFrame | None = None) -> DataFrame:
    """Long rows of all domains: cik, domain, row_id, row_label, subdomain, period_key, seq, value. seq orders rows of one id and
    period (segments whose names make one id; sections of one kind): the last one is the one a sheet shows."""
    names = metric_registry(primary.sparkSession).select("metric_id", F.col("metric_name").alias("label"), "domain", "subdomain")
    key = F.regexp_replace(X.ascii_lower(F.col("segment_name")), "[^a-z0-9]", "_")
    named = F.col("metric_id").startswith("segment_data.") & F.col("segment_name").isNotNull()

    def rows(of: DataFrame, row_id, row_label, seq, value) -> DataFrame:
        own = of.drop("metric_name", "domain", "subdomain", "position").join(F.broadcast(names), "metric_id")
        return own.select("cik", "domain", row_id.alias("row_id"), row_label.alias("row_label"), "subdomain", "period_key", seq.alias("seq"), value.cast("string").alias("value"))

    plain = F.col("metric_id"), F.col("label")
    segments = primary if "segment_name" in primary.columns else primary.withColumn("segment_name", F.lit(None).cast("string"))
    seq = F.coalesce("segment_key", F.lit("")) if "segment_key" in primary.columns else F.lit("")
    out = rows(segments, F.when(named, F.concat_ws("::", "metric_id", key)).otherwise(plain[0]), F.when(named, F.concat_ws(" | ", "segment_name", "label")).otherwise(plain[1]), seq, F.col("amount"))
    if formulas is not None:
        out = out.unionByName(rows(formulas.where("status = 'ok'"), *plain, F.lit(""), F.col("amount")))
    if narratives is not None:
        place = F.concat_ws("/", "accession", F.lpad(F.col("section_no").cast("string"), 6, "0"))
        out = out.unionByName(rows(narratives, *plain, place, F.col("content")))
    return out


def period_headers(values: DataFrame) -> DataFrame:
    """cik, position, period_key, column_label: a company's periods in order from 1, as column heads of its wide sheets. values may
    lack the fiscal columns, or have them in some rows only; a period without any is labelled by its key."""
    v = _with(values, "period_label", "fiscal_quarter")
    v = v if "fiscal_year" in v.columns else v.withColumn("fiscal_year", F.lit(None).cast("int"))
    known = period_columns(v.where("fiscal_year is not null or trim(period_label) <> ''"))
    keys = v.where("period_key is not null").select("cik", "period_key").distinct()
    position = F.row_number().over(Window.partitionBy("cik").orderBy("period_key"))
    return keys.join(known, ["cik", "period_key"], "left").select("cik", position.alias("position"), "period_key", F.coalesce("column_label", "period_key").alias("column_label"))


def domain_positions(rows: DataFrame, domain: str, headers: DataFrame, width: int) -> DataFrame:
    """Wide rows of a domain with columns p_1 to p_<width>: each company's own periods by position in headers. With the largest
    position there is as width, every period of every company has its column and none is dropped."""
    placed = rows.where(F.col("domain") == domain).join(headers.select("cik", "period_key", "position"), ["cik", "period_key"])
    wide = placed.groupBy("cik", "row_id", "row_label").pivot("position", list(range(1, width + 1))).agg(F.max_by("value", "seq"))
    return wide.select("cik", "row_id", "row_label", *[F.col(f"`{k}`").alias(f"p_{k}") for k in range(1, width + 1)])


def domain_pivot(rows: DataFrame, domain: str, periods: list[str]) -> DataFrame:
    """Wide rows of a domain with a column for each of `periods`, a list fixed for the run; of rows with one id and period the
    last one (by seq) wins."""
    return rows.where(F.col("domain") == domain).groupBy("cik", "row_id", "row_label").pivot("period_key", periods).agg(F.max_by("value", "seq"))


def domain_long(rows: DataFrame, domain: str) -> DataFrame:
    """A domain's values of every period there is, a row for each: what domain_pivot shows for the periods it is given."""
    return rows.where(F.col("domain") == domain).groupBy("cik", "row_id", "row_label", "period_key").agg(F.max_by("value", "seq").alias("value"))


def _with(df: DataFrame, *names: str) -> DataFrame:
    """df with text columns of nulls for those of names that it lacks."""
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})


def provenance_records(source_values: DataFrame, filings: DataFrame | None = None) -> DataFrame:
    """Every source value with where it comes from; filing_url is the primary document's if filings(accession, url_primary) are given."""
    v = _with(source_values, "segment_name", "source_method", "filing_label", "section_name", "table_name", "decision", "xbrl_tag", "row_label")
    names = metric_registry(v.sparkSession).select("metric_id", F.col("metric_name").alias("metric_label"), F.col("domain").alias("metric_domain"))
    v = v.join(F.broadcast(names), "metric_id", "left")
    if filings is not None:
        v = v.join(filings.select("accession", F.col("url_primary").alias("filing_url")).dropDuplicates(["accession"]), "accession", "left")
    method = F.coalesce("source_method", F.when(F.col("source") == "xbrl", "api_xbrl_facts").otherwise("filing_html"))
    return _with(v, "filing_url").select(
        "cik", "metric_id", "metric_label", F.col("metric_domain").alias("domain"), "period_key", "segment_key", "segment_name", "selected_as_primary", "source", "decision", "amount", "unit_kind", "scale",
        "accession", "form_type", method.alias("source_method"), "xbrl_tag", "filing_url", F.coalesce("filing_label", "row_label").alias("filing_label"), "section_name", "table_name", "row_label", "review_note",
    )


def duplicate_candidates(records: DataFrame) -> DataFrame:
    """Records that were not selected; their order is the sink's affair."""
    return records.where(~F.col("selected_as_primary") & F.col("review_note").isNotNull())


def expected_source(domain) -> F.Column:
    return F.when(domain.isin("footnotes", "mda", "risk_factors"), "html_narrative").when(domain == "valuation", "valuation_formula").otherwise("xbrl_primary_html_fallback")


#: What an analyst is told about each coverage status.
STATUS_NOTES = {
    "found": "At least one primary value was found.",
    "computed_placeholder": "A placeholder formula gave this value.",
    "placeholder_not_extracted": "Risk factors are not extracted.",
    "formula_not_computed": "No formula output: a required input is missing; see formula_inputs and the coverage of critical metrics.",
    "narrative_placeholder": "No section of this kind was found in the filing documents.",
    "missing_extraction": "Neither structured facts nor filing documents gave a primary value.",
}


def with_notes(covered: DataFrame) -> DataFrame:
    """covered with expected_source and status_note."""
    notes = F.create_map(*[F.lit(x) for pair in STATUS_NOTES.items() for x in pair])
    return covered.withColumns({"expected_source": expected_source(F.col("domain")), "status_note": notes[F.col("status")]})


def coverage(companies: DataFrame, source_values: DataFrame, formulas: DataFrame | None = None) -> DataFrame:
    """For each company and registry metric: primary values, source values by kind, periods and status; one row more for each
    formula output. source_values are values, or groups of n values each. The registry is a fixed number of rows, attached as an
    array in which a company looks its own numbers up, so companies aren't cross-joined and no shuffle carries a row for each metric."""
    registry = metric_registry(companies.sparkSession).agg(F.collect_list(F.struct("metric_id", "metric_name", "domain")).alias("all"))
    n = F.coalesce("n", F.lit(1)) if "n" in source_values.columns else F.lit(1)
    of = lambda source: F.coalesce(F.sum(F.when(F.col("source") == source, n)), F.lit(0))
    total = lambda c: F.sum(c).alias(c)
    periods = source_values.where("metric_id is not null").repartition("cik").groupBy("cik", "metric_id", "period_key").agg(F.count_if("selected_as_primary").alias("found_primary_values"), F.sum(n).alias("found_source_values"), of("xbrl").alias("xbrl_source_values"), of("html").alias("html_source_values"))
    numbers = ["found_primary_values", "found_source_values", "xbrl_source_values", "html_source_values", "period_count"]
    metrics = periods.groupBy("cik", "metric_id").agg(*[total(c) for c in numbers[:-1]], F.count_if((F.col("found_primary_values") > 0) & F.col("period_key").isNotNull()).alias("period_count"))
    counted = metrics.groupBy("cik").agg(F.map_from_entries(F.collect_list(F.struct("metric_id", F.struct(*numbers)))).alias("own"))
    each = F.transform("all", lambda r: F.struct(*[r[c].alias(c) for c in ("metric_id", "metric_name", "domain")], F.try_element_at("own", r["metric_id"]).alias("found")))
    wanted = companies.select("cik").distinct().join(counted, "cik", "left").join(F.broadcast(registry)).select("cik", F.inline(each))
    status = F.when(F.col("found_primary_values") > 0, "found").when(F.col("domain") == "risk_factors", "placeholder_not_extracted").when(F.col("domain") == "valuation", "formula_not_computed").when(F.col("domain").isin("footnotes", "mda"), "narrative_placeholder").otherwise("missing_extraction")
    out = wanted.select("cik", "metric_id", "metric_name", "domain", *[F.coalesce(F.col(f"found.{c}"), F.lit(0).cast("long")).alias(c) for c in numbers]).withColumn("status", status).select("cik", "domain", "metric_id", "metric_name", *numbers, "status")
    if formulas is None:
        return out
    done = formulas.where("status = 'ok'").select("cik", F.lit("valuation").alias("domain"), "metric_id", F.when(F.col("metric_id") == OWNERS, "Owner's Earnings Placeholder").otherwise("Adjusted Earnings Ratio Placeholder").alias("metric_name"), F.lit(1).cast("long").alias("found_primary_values"), F.size("inputs").cast("long").alias("found_source_values"), F.size("inputs").cast("long").alias("xbrl_source_values"), F.lit(0).cast("long").alias("html_source_values"), F.lit(1).cast("long").alias("period_count"), F.lit("computed_placeholder").alias("status"))
    return out.unionByName(done)


def missing_metrics(covered: DataFrame) -> DataFrame:
    return covered.where(~F.col("status").isin("found", "computed_placeholder"))


def formula_input_records(outputs: DataFrame, primary: DataFrame | None = None) -> DataFrame:
    """A row for each input of each computed formula, with names and, if primary values are given, where the input comes from
    (nulls for derived ones)."""
    each = outputs.where("status = 'ok'").select("cik", "period_key", F.col("metric_id").alias("formula"), F.posexplode("inputs").alias("input_no", "i")).select("cik", "period_key", "formula", "input_no", "i.*")
    names = metric_registry(outputs.sparkSession).select("metric_id", F.col("metric_name").alias("metric_name"))
    each = each.join(F.broadcast(names), "metric_id", "left").join(F.broadcast(names.select(F.col("metric_id").alias("formula"), F.col("metric_name").alias("formula_name"))), "formula", "left")
    if primary is not None:
        own = _with(primary, "source_method", "xbrl_tag").where("segment_key = ''").groupBy("cik", "metric_id", "period_key").agg(*[F.max(c).alias(c) for c in ("accession", "source", "source_method", "xbrl_tag")])
        each = each.join(own, ["cik", "metric_id", "period_key"], "left")
    return each


def run_summary(filings: DataFrame, candidates: DataFrame, source_values: DataFrame, issues: DataFrame, outputs: DataFrame) -> DataFrame:
    """Counts per company and stage, one row a company. Candidates are rows, or companies with a number of them, n_given."""
    stages = {"filings": filings, "candidates": candidates, "primary_values": source_values.where("selected_as_primary"), "issues": issues, "formulas": outputs.where("status = 'ok'")}
    counted = None
    for name, df in stages.items():
        one = df.select("cik", F.lit(name).alias("stage"), (F.col("n_given") if name == "candidates" and "n_given" in df.columns else F.lit(1)).cast("long").alias("k"))
        counted = one if counted is None else counted.unionByName(one)
    return counted.groupBy("cik").agg(*[F.coalesce(F.sum(F.when(F.col("stage") == n, F.col("k"))), F.lit(0)).alias(f"n_{n}") for n in stages])


def slowest_documents(timings: DataFrame, k: int = 5) -> DataFrame:
    """The k documents of largest total time, ties by id."""
    return timings.orderBy(F.desc("total_ms"), "document_id").limit(k)


def provenance_lookup(records: DataFrame, metric_id: str, period_key: str | None = None, cik: str | None = None) -> DataFrame:
    """Records of one metric, and of one period or company if given; see write_provenance for a table that is made for this."""
    out = records.where(F.col("metric_id") == metric_id)
    out = out if period_key is None else out.where(F.col("period_key") == period_key)
    return out if cik is None else out.where(F.col("cik") == cik)


def write_provenance(records: DataFrame, path: str, rows_per_file: int = 1_000_000) -> DataFrame:
    """Records laid out for lookups, in place of what path held, and the written table.

    A folder for each metric (their number is the registry's) holds files of consecutive companies and periods, so a lookup opens
    its metric's files only and reads the row groups in which its company may stand. Ranges are of (metric, company, period): a
    metric with a third of all rows becomes many ranges, one of few rows a part of one. Records are read twice, first for the
    bounds of the ranges. Records without a metric (null or empty) stand in a folder of their own and come back with a null.
    """
    order = ["metric_id", "cik", "period_key"]
    laid = records.repartitionByRange(*order).sortWithinPartitions(*order)
    laid.write.mode("overwrite").option("partitionOverwriteMode", "static").option("maxRecordsPerFile", rows_per_file).partitionBy("metric_id").parquet(path)
    return records.sparkSession.read.schema(records.schema).parquet(path).select(*records.columns)


def company_overview(issuers: DataFrame) -> DataFrame:
    """field / value rows."""
    fields = ["ticker", "issuer_name", "exchange", "reported_currency"]
    return issuers.unpivot("cik", fields, "field", "value")


def company_summary(issuers: DataFrame) -> DataFrame:
    return issuers.select("cik", "issuer_name", "ticker")


def filing_summary(filings: DataFrame) -> DataFrame:
    return filings.select("cik", F.col("accession").alias("accession_number"), "form_type")


def filing_index(filings: DataFrame) -> DataFrame:
    """One row per filing, with whether it amends another, the folder that indexes its files, and its primary document."""
    return filings.select("cik", "accession", "form_type", "is_amendment", "filing_date", "period_end", "fiscal_year", "fiscal_quarter", F.col("url_directory").alias("url_index"), "url_primary")


def schema_sheet(spark: SparkSession, n_periods: int) -> DataFrame:
    return spark.createDataFrame([("schema_version", REPORT_VERSION), ("period_column_count", str(n_periods)), ("layout", "one_row_per_metric_periods_as_columns")], "key string, value string").coalesce(1)


#: Folders that a sheet's companies are dealt to, however many there are: files don't grow in number with the companies.
BUCKETS = 64


def write_report(tables: dict[str, DataFrame], path: str) -> list[str]:
    """Writes each sheet as its own Parquet dataset under path, those with a cik in a fixed number of folders; returns the sheets
    in order.

    With an overview among the sheets, its companies replace what the report holds of them, in every sheet given, also where they
    have no rows any more; other companies' rows stay. Without one, the sheets given are replaced as a whole. A null cik is a
    company of its own. Folders that hold none of these companies aren't touched; the others are written anew as a next generation
    (g=<n>/bucket=<k>), and the ones they replace are deleted once it is whole. The manifest (rows and columns of each sheet) is
    deleted first and written last, so a report that was left half-written can't be imported, and writing it again mends it.
    """
    done = [s for s in [*SHEETS, HEADERS] if s in tables]
    spark = tables[done[0]].sparkSession
    known = {s: schema for s, (_, schema) in manifest(spark, path).items()}
    delete(spark, f"{path}/{MANIFEST}")
    companies, touched = None, set(range(BUCKETS))
    if "company_overview" in tables:
        companies = tables["company_overview"].select(F.col("cik").alias("_company")).distinct()
        touched = {r.bucket for r in companies.select(_bucket("_company").alias("bucket")).distinct().collect()}  # BUCKETS rows at most
    for sheet in done:
        df, folder = tables[sheet], f"{path}/{sheet}"
        columns = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
        if "cik" not in df.columns:
            df.write.mode("overwrite").parquet(folder)
        else:
            stale, generation = _replaced(spark, folder, touched)
            kept = None
            if companies is not None and stale:
                kept = _read(spark, folder, stale, columns)
                kept = kept.join(companies, kept["cik"].eqNullSafe(companies["_company"]), "left_anti")
            rows = df if kept is None else df.unionByName(kept)
            rows.withColumn("bucket", _bucket("cik")).repartition(BUCKETS, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").option("maxRecordsPerFile", 2_000_000).partitionBy("bucket").parquet(f"{folder}/g={generation:06d}")
            for old in stale:
                delete(spark, f"{folder}/{old}")
        known[sheet] = columns
    rows = [(s, place, _sheet(spark, path, s, known[s]).count(), known[s].json()) for place, s in enumerate([*SHEETS, HEADERS]) if s in known]
    spark.createDataFrame(rows, "sheet string, place int, n_rows long, columns string").coalesce(1).write.parquet(f"{path}/{MANIFEST}")
    return done


def _bucket(cik: str) -> F.Column:
    return F.pmod(F.xxhash64(F.coalesce(cik, F.lit(NO_COMPANY))), F.lit(BUCKETS)).cast("int")


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder that aren't hidden; none if there is no such folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []
    return sorted(n for n in names if n[0] not in "._")


def _live(spark: SparkSession, folder: str) -> list[str]:
    """Folders with the rows of a sheet: of each bucket that of the newest whole generation, and whatever else stands in the sheet
    (company folders of older reports)."""
    newest, rest = {}, []
    for name in _names(spark, folder):
        if not name.startswith("g="):
            rest.append(name)
            continue
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS")
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            newest |= {b: name for b in _names(spark, f"{folder}/{name}")}
    return [*rest, *[f"{g}/{b}" for b, g in newest.items()]]


def _replaced(spark: SparkSession, folder: str, touched: set[int]) -> tuple[list[str], int]:
    """Live folders that a write to the touched buckets replaces (all, if not all are buckets), and the number of its generation."""
    live = _live(spark, folder)
    last = max([int(n[2:]) for n in _names(spark, folder) if n.startswith("g=")], default=0)
    number = {x: int(x.rsplit("bucket=", 1)[1]) for x in live if x.startswith("g=")}
    return (live if len(number) < len(live) else [x for x in live if number[x] in touched]), last + 1


def _read(spark: SparkSession, folder: str, live: list[str], columns: T.StructType) -> DataFrame:
    """Rows of a sheet's folders, with columns in order; the cik of company folders is in their names and stays text."""
    buckets, rest = [x for x in live if x.startswith("g=")], [x for x in live if not x.startswith("g=")]
    out = spark.createDataFrame([], columns)
    if buckets:
        out = out.unionByName(spark.read.schema(columns).option("recursiveFileLookup", True).parquet(*[f"{folder}/{x}" for x in buckets]).select(*columns.names))
    if rest:
        out = out.unionByName(spark.read.schema(columns).option("basePath", folder).parquet(*[f"{folder}/{x}" for x in rest]).select(*columns.names))
    return out


def _sheet(spark: SparkSession, path: str, sheet: str, columns: T.StructType) -> DataFrame:
    """A written sheet with its columns in order."""
    if "cik" not in columns.names:
        return spark.read.schema(columns).parquet(f"{path}/{sheet}").select(*columns.names)
    return _read(spark, f"{path}/{sheet}", _live(spark, f"{path}/{sheet}"), columns)


def manifest(spark: SparkSession, path: str) -> dict[str, tuple[int, T.StructType]]:
    """Rows and columns of each sheet of a written report; empty if there is no manifest."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return {}
    return {r.sheet: (r.n_rows, T.StructType.fromJson(json.loads(r["columns"]))) for r in spark.read.parquet(f"{path}/{MANIFEST}").orderBy("place").collect()}


def import_report(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sheets of a written report; fails if its manifest is missing (it was not written to its end), if a sheet has other numbers
    of rows than the manifest says, or if the schema sheet is missing or of another version."""
    listed = manifest(spark, path)
    if not listed:
        raise ValueError(f"no manifest in {path}: the report was not written to its end")
    out = {s: _sheet(spark, path, s, columns) for s, (_, columns) in listed.items()}
    version = out["schema"].where("key = 'schema_version'").select("value").first() if "schema" in out else None
    if version is None or version.value != REPORT_VERSION:
        raise ValueError(f"report schema version must be {REPORT_VERSION}, found {version and version.value}")
    for sheet, df in out.items():
        if df.count() != listed[sheet][0]:
            raise ValueError(f"{sheet} has {df.count()} rows, the manifest says {listed[sheet][0]}")
    return out
