"""Values of embedded facts, by what the dimensions of their contexts allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.sources.documents import period_from_context_id

#: Axes and tags of embedded facts that are read.
SEGMENT_AXIS = "StatementBusinessSegmentsAxis"
HEDGE_AXES = ("DerivativeInstrumentRiskAxis", "DerivativeInstrumentsGainLossByHedgingRelationshipAxis", "HedgingDesignationAxis")
REVENUE_TAGS = ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet", "SalesRevenueServicesNet"]
SEGMENT_METRICS = {"RevenueFromContractWithCustomerExcludingAssessedTax": "segment_data.segment_revenue", "Revenues": "segment_data.segment_revenue", "OperatingIncomeLoss": "segment_data.segment_profit_or_loss", "Assets": "segment_data.segment_assets"}
GAIN_LOSS_TAGS = ["DerivativeGainLossOnDerivativeNet", "DerivativeInstrumentsNotDesignatedAsHedgingInstrumentsGainLossNet"]


def _axis(*names: str):
    return lambda m: X.has_any(m["dimension"], *names)


def core_contexts(contexts: DataFrame) -> DataFrame:
    return contexts.where(F.size("members") == 0)


def segment_contexts(contexts: DataFrame) -> DataFrame:
    """A segment axis with a ...SegmentMember and no other axis but consolidation items."""
    member = F.get(F.filter("members", _axis(SEGMENT_AXIS)), 0)["member"]
    allowed = F.forall("members", _axis(SEGMENT_AXIS, "ConsolidationItemsAxis")) & ~F.exists("members", _axis("ProductOrServiceAxis"))
    name = F.regexp_replace(F.element_at(F.split("member", ":"), -1), "Member$", "")
    return contexts.withColumn("member", member).where(F.contains("member", F.lit("SegmentMember")) & allowed).withColumn("segment_name", X.humanize_member(name))


def derivative_contexts(contexts: DataFrame) -> DataFrame:
    return contexts.where(F.exists("members", _axis(*HEDGE_AXES)) & F.forall("members", _axis(*HEDGE_AXES, "IncomeStatementLocationAxis")))


def award_contexts(contexts: DataFrame) -> DataFrame:
    return contexts.where((F.size("members") > 0) & F.forall("members", _axis("AwardTypeAxis")))


def _values(facts: DataFrame, contexts: DataFrame, filings: DataFrame, metric: Column, section: str) -> DataFrame:
    """Facts of a context kind with their metric, amount, period (context, else its id, else the filing's date) and scale."""
    known = facts.withColumn("metric_id", metric).where("metric_id is not null").withColumn("amount", X.parse_number(F.col("value"))).where("amount is not null")
    at = contexts.withColumnRenamed("context_id", "context_ref")
    joined = known.join(at, ["accession", "context_ref"]).join(filings.select("accession", "cik", "form_type", "filing_date", F.col("period_end").alias("report_end")), "accession")
    end = F.coalesce("period_end", period_from_context_id(F.col("context_ref")), "report_end", "filing_date")
    return joined.withColumns({"period_end": end, "unit_kind": X.inline_unit(F.col("unit_ref")), "scale": X.inline_scale(F.col("scale_attr")), "source": F.lit("html"), "section_name": F.lit(section), "table_name": F.lit(section), "row_label": F.col("name"), "xbrl_tag": F.col("name")})


def core_revenue_values(facts: DataFrame, contexts: DataFrame, filings: DataFrame) -> DataFrame:
    """Revenue of contexts without dimensions whose period is the filing's: the same end, at most 100 days for a 10-Q, at least
    300 for a 10-K."""
    v = _values(facts, core_contexts(contexts), filings, F.when(F.col("local_name").isin(*REVENUE_TAGS), "income_statement.revenue"), "inline_xbrl_core")
    days = F.datediff("period_end", "period_start")
    span = F.when(F.col("period_start").isNull(), F.lit(True)).when(F.col("form_type") == "10-Q", days <= 100).when(F.col("form_type") == "10-K", days >= 300).otherwise(F.lit(True))
    fits = F.col("report_end").isNull() | ((F.col("period_end") == F.col("report_end")) & span)
    return v.where(fits).withColumn("source_type", F.lit("xbrl"))


def segment_values(facts: DataFrame, contexts: DataFrame, filings: DataFrame) -> DataFrame:
    tags = F.create_map(*[F.lit(x) for pair in SEGMENT_METRICS.items() for x in pair])
    return _values(facts, segment_contexts(contexts), filings, tags[F.col("local_name")], "inline_xbrl_segment")


def derivative_gain_loss(facts: DataFrame, contexts: DataFrame, filings: DataFrame) -> DataFrame:
    """Sum per document and period over allowed contexts; the scale of the first fact."""
    v = _values(facts, derivative_contexts(contexts), filings, F.when(F.col("local_name").isin(*GAIN_LOSS_TAGS), "derivatives_and_securities.derivative_gain_loss"), "inline_xbrl_derivative")
    return v.groupBy("cik", "accession", "form_type", "metric_id", "period_start", "period_end").agg(F.sum("amount").alias("amount"), F.min_by("scale", "pos").alias("scale"), F.count(F.lit(1)).alias("n_facts"))


def share_issuance_values(facts: DataFrame, contexts: DataFrame, filings: DataFrame) -> DataFrame:
    return _values(facts, award_contexts(contexts), filings, F.when(F.col("local_name") == "ProceedsFromStockOptionsExercised", "cash_flow.share_issuance_proceeds"), "inline_xbrl_equity_comp")
