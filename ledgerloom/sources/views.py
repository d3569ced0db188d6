"""Filing-shaped tables made from the driver's star schema, so that operators run on tables that grow with it.

The rules are repeated in SQL in ledgerloom.oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tags of the facts view, by (line number + part key) modulo their number.
TAGS = ["Assets", "Liabilities", "RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "CostOfGoodsSold", "NetIncomeLoss", "DepreciationDepletionAndAmortization", "PaymentsToAcquirePropertyPlantAndEquipment", "ShareBasedCompensation", "CommonStockSharesOutstanding"]
BALANCE_TAGS = ["Assets", "Liabilities", "CommonStockSharesOutstanding"]
HTML_METRICS = ["income_statement.cost_of_goods_sold", "balance_sheet.long_term_debt", "debt_and_credit.interest_rate", "debt_and_credit.notes_and_bonds", "segment_data.segment_revenue", "derivatives_and_securities.derivative_gain_loss", "income_statement.revenue", "debt_and_credit.detail_senior_notes", "debt_and_credit.detail_other_borrowed_funds", "income_statement.net_income"]
DURATION_METRICS = ["derivatives_and_securities.derivative_gain_loss", "income_statement.revenue", "income_statement.net_income"]
HTML_LABELS = ["Total revenue", "Net sales", "Weighted average rate", "Senior notes", "Fixed rate debt", "Cost of sales", "Total senior notes"]
HTML_CONTEXTS = ["Consolidated balance sheet", "Three months ended", "Six months ended", "Percent of net sales", "Fair value hierarchy", "Statement of income", "Statement of income (continued)", "Average balance sheets", "Year quarter", "inline_xbrl_segment", "Notes"]
SEGMENTS = ["Consumer Reportable Segment", "Consumer Segment", "Industrial & Energy Segment Member", "Boeing Defense Segment", "Healthc Care"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], key) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(key, F.lit(len(values))).cast("int"))


def issuers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cik, ticker, issuer_name, exchange, reported_currency."""
    nation = read(spark, sf_dir, "nation")
    return read(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"),
        F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("ticker"),
        F.col("c_name").alias("issuer_name"),
        F.col("c_mktsegment").alias("exchange"),
        pick(["USD", "EUR", "GBP", "JPY", "CHF"], F.col("n_regionkey")).alias("reported_currency"),
    )


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cik, accession, form_text, filing_date, period_end, primary_document, o_orderkey."""
    o = read(spark, sf_dir, "orders").withColumn("filing_date", F.add_months(F.col("o_orderdate").cast("date"), 240))
    form = pick(["10-K", "10-Q", "10-K/A", "8-K", "10-Q"], F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    end = F.when(F.col("form_text").startswith("10-K"), F.make_date(F.year("filing_date") - 1, F.lit(12), F.lit(31))).otherwise(F.date_sub(F.trunc("filing_date", "quarter"), 1))
    cik = F.lpad(F.col("o_custkey").cast("string"), 10, "0")
    return o.withColumn("form_text", form).select(
        cik.alias("cik"),
        F.concat_ws("-", cik, F.lpad((F.year("filing_date") % 100).cast("string"), 2, "0"), F.lpad(F.col("o_orderkey").cast("string"), 6, "0")).alias("accession"),
        "form_text",
        "filing_date",
        F.when(F.col("o_orderkey") % 37 != 0, end).alias("period_end"),
        F.concat(F.lit("doc"), F.col("o_orderkey").cast("string"), F.lit(".htm")).alias("primary_document"),
        "o_orderkey",
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cik, taxonomy, tag, unit, period_start, period_end, val, accn, fy, fp, form, filed, frame, pos, and the line's keys."""
    from ledgerloom.functions.text import classify_form

    f = filings(spark, sf_dir)
    line = read(spark, sf_dir, "lineitem").join(f, F.col("l_orderkey") == F.col("o_orderkey"))
    tag = pick(TAGS, F.col("l_linenumber") + F.col("l_partkey"))
    end = F.coalesce("period_end", "filing_date")
    annual = F.col("form_text").startswith("10-K")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("int")
    start = F.when(~F.col("tag").isin(*BALANCE_TAGS), F.when(annual, F.trunc("end", "year")).otherwise(F.trunc("end", "quarter")))
    return line.withColumns({"tag": tag, "end": end, "pos": pos}).select(
        "cik",
        F.lit("us-gaap").alias("taxonomy"),
        "tag",
        F.when(F.col("tag") == "CommonStockSharesOutstanding", "shares").otherwise("USD").alias("unit"),
        start.alias("period_start"),
        F.col("end").alias("period_end"),
        F.col("l_extendedprice").alias("val"),
        F.when(F.col("l_linestatus") == "O", F.col("accession")).otherwise(F.concat(F.col("accession"), F.lit("x"))).alias("accn"),
        F.year("end").alias("fy"),
        F.when(annual, "FY").otherwise(F.concat(F.lit("Q"), F.quarter("end").cast("string"))).alias("fp"),
        classify_form(F.col("form_text")).alias("form"),
        F.col("filing_date").alias("filed"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("CY_StatementBusinessSegmentsAxis_"), pick(["ConsumerSegment", "IndustrialSegment", "OtherGoods"], F.col("l_suppkey")), F.lit("Member"))).alias("frame"),
        "pos",
    )


def html_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document-side candidate values in groups of a few dozen, however large the tables: 10 customers make a company; ten metrics,
    year-end periods."""
    f = filings(spark, sf_dir)
    line = read(spark, sf_dir, "lineitem").join(f, F.col("l_orderkey") == F.col("o_orderkey"))
    metric, segment = pick(HTML_METRICS, F.col("l_partkey")), pick(SEGMENTS, F.col("l_suppkey"))
    cik = F.lpad(F.floor(F.substring("cik", 1, 10).cast("long") / 10).cast("string"), 10, "0")
    end = F.make_date(F.year("filing_date") - 1, F.lit(12), F.lit(31))
    small = F.when(F.col("l_quantity") < 10, F.col("l_quantity")).otherwise(F.round(F.col("l_extendedprice") / 1000) * 100)
    amount = F.when(metric == "debt_and_credit.interest_rate", F.col("l_quantity")).otherwise(small)
    return line.select(
        cik.alias("cik"),
        metric.alias("metric_id"),
        F.when(metric.startswith("segment_data"), segment).alias("segment_name"),
        F.when(metric.isin(*DURATION_METRICS), F.trunc(end, "year")).alias("period_start"),
        end.alias("period_end"),
        "accession",
        F.when(F.col("form_text").startswith("10-K"), "10-K").when(F.col("form_text").startswith("10-Q"), "10-Q").otherwise(F.col("form_text")).alias("form_type"),
        amount.alias("amount"),
        F.lit("currency").alias("unit_kind"),
        F.lit("raw").alias("scale"),
        pick(HTML_LABELS, F.col("l_linenumber")).alias("row_label"),
        pick(HTML_CONTEXTS, F.col("l_suppkey") + F.col("l_linenumber")).alias("table_name"),
        F.when(F.col("l_linenumber") % 2 == 0, "Revenues").alias("xbrl_tag"),
        F.lit("html").alias("source"),
        F.concat_ws("/", F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("pos"),
    )


def fx_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """from_currency, to_currency, date, rate."""
    e = read(spark, sf_dir, "events")
    currency = pick(["EUR", "GBP", "JPY", "CHF"], F.col("user_id"))
    return e.groupBy(currency.alias("from_currency"), F.col("ts").cast("date").alias("date")).agg(F.avg(F.col("value").cast("decimal(18,2)")).cast("decimal(18,4)").cast("double").alias("rate")).withColumn("to_currency", F.lit("USD"))
