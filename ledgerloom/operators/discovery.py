"""Filing discovery: resolve companies, select and merge filings, plan history and assets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as X


def resolve_ticker(requests: DataFrame, tickers: DataFrame) -> DataFrame:
    """requests(ticker) with cik and status; the ticker index row of smallest text key wins; an unknown ticker stays, marked."""
    first = tickers.groupBy(X.normalize_ticker(F.col("ticker")).alias("known")).agg(F.min_by("cik", "position").alias("cik"))
    joined = requests.join(first, X.normalize_ticker(F.col("ticker")) == F.col("known"), "left")
    return joined.select("ticker", X.normalize_cik(F.col("cik").cast("string")).alias("cik"), F.when(F.col("cik").isNull(), "unknown_ticker").otherwise("ok").alias("status"))


def company_identity(submissions: DataFrame) -> DataFrame:
    """First ticker and exchange of parsed submissions."""
    return submissions.select("cik", F.col("name").alias("issuer_name"), F.get("tickers", 0).alias("ticker"), F.get("exchanges", 0).alias("exchange"), F.col("fiscalYearEnd").alias("fiscal_year_end"))


def describe_filings(filings: DataFrame) -> DataFrame:
    """Adds form_type, is_amendment, fiscal period and URLs to filings(cik, accession, form_text, ..., primary_document)."""
    form, end = X.classify_form(F.col("form_text")), F.col("period_end")
    folder = X.directory_url(F.col("cik"), F.col("accession"))
    return filings.withColumns({
        "form_type": form,
        "is_amendment": X.is_amendment(F.col("form_text")),
        "fiscal_year": X.fiscal_year(end),
        "fiscal_quarter": X.fiscal_quarter(form, end),
        "url_directory": folder,
        "url_primary": F.concat(folder, F.col("primary_document")),
    })


def original_filings(filings: DataFrame) -> DataFrame:
    return filings.where(~F.col("is_amendment") & F.col("form_type").isin("10-K", "10-Q"))


def newest_first(filings: DataFrame) -> DataFrame:
    return filings.orderBy("cik", F.desc_nulls_last("period_end"), F.desc_nulls_last("filing_date"), "accession")


def limit_years(filings: DataFrame, years: int) -> DataFrame:
    """Report years within `years` of the company's latest; filings without a report date stay, as do companies without any."""
    latest = F.max(F.year("period_end")).over(Window.partitionBy("cik"))
    keep = F.col("latest").isNull() | F.col("period_end").isNull() | (F.year("period_end") >= F.col("latest") - max(years, 1) + 1)
    return filings.withColumn("latest", latest).where(keep).drop("latest")


def merge_filings(recent: DataFrame, historical: DataFrame) -> DataFrame:
    """One row per accession; the recent list's wins."""
    both = recent.withColumn("source_priority", F.lit(0)).unionByName(historical.withColumn("source_priority", F.lit(1)))
    first = F.row_number().over(Window.partitionBy("accession").orderBy("source_priority", "filing_date", "cik"))
    return both.withColumn("rn", first).where("rn = 1").drop("rn", "source_priority")


def history_coverage(filings: DataFrame, years: int) -> DataFrame:
    """Per company: earliest and latest selected report year, the year that `years` require, and whether they are spanned."""
    by = filings.groupBy("cik").agg(F.min(F.year("period_end")).alias("earliest_year"), F.max(F.year("period_end")).alias("latest_year"), F.count(F.lit(1)).alias("n_filings"))
    required = F.col("latest_year") - max(years, 1) + 1
    return by.withColumns({"requested_years": F.lit(max(years, 1)), "required_year": required, "covers_span": F.coalesce(F.col("earliest_year") <= required, F.lit(False))})


def historical_files_to_fetch(coverage: DataFrame, files: DataFrame) -> DataFrame:
    """Files of companies whose span isn't covered."""
    return files.join(coverage.where("covers_span"), "cik", "left_anti")


def asset_manifest(filings: DataFrame) -> DataFrame:
    """One row per planned file of a filing: index, primary document, and the instance if its URL is known."""
    instance = F.col("url_instance") if "url_instance" in filings.columns else F.lit(None).cast("string")

    def asset(kind, source, priority, url, name, form):
        return F.when(url.isNotNull(), F.struct(F.lit(kind).alias("kind"), F.lit(source).alias("source_type"), F.lit("filing_html").alias("source_method"), form.alias("format"), F.lit(priority).alias("priority"), url.alias("url"), name.alias("file_name")))

    folder, primary = F.col("url_directory"), F.col("url_primary")
    assets = F.array(
        asset("filing_index", "html", "required", folder, F.lit(None).cast("string"), F.lit("html")),
        asset("primary_document", "html", "required", primary, X.file_name_from_url(primary), X.document_format(primary)),
        asset("xbrl_instance", "xbrl", "preferred", instance, X.file_name_from_url(instance), X.document_format(instance)),
    )
    return filings.select("accession", "filing_date", F.explode(F.array_compact(assets)).alias("a")).select("accession", "filing_date", "a.*")


def classify_directory_entries(entries: DataFrame) -> DataFrame:
    """entries(accession, name, url, pos) as assets."""
    return entries.select("accession", X.directory_entry_kind(F.col("name")).alias("a"), "url", F.col("name").alias("file_name"), "pos").select("accession", "a.*", X.document_format(F.col("url")).alias("format"), "url", "file_name", "pos")


def extend_manifest(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """The manifest and those classified entries whose URL it doesn't list; the first of equal entries."""
    known = manifest.withColumns({"pos": F.lit(-1).cast("long"), "from_manifest": F.lit(True)})
    more = classify_directory_entries(entries).withColumns({"pos": F.col("pos").cast("long"), "from_manifest": F.lit(False), "filing_date": F.lit(None).cast("date")})
    first = F.row_number().over(Window.partitionBy("accession", "url").orderBy("pos", "file_name"))
    return known.unionByName(more).withColumn("rn", first).where("from_manifest or rn = 1").drop("rn", "pos", "from_manifest")
