"""Review issues: conflicts, duplicates and gaps, as rows of issues(cik, severity, code, metric_id, period_key, segment_key,
segment_name, message)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.reconcile import COGS, DEBT, GROUP, NOTES, OTHER_FUNDS, REVENUE, TOLERANCE, is_detail, is_segment, metric_is, over_group, with_selected, year_delta

#: Metrics whose absence an analyst must see.
CRITICAL = ["balance_sheet.cash_and_equivalents", "balance_sheet.total_assets", "balance_sheet.total_liabilities", "balance_sheet.total_equity", "income_statement.revenue", "income_statement.operating_income", "income_statement.net_income", "cash_flow.net_cash_from_operations", "cash_flow.capital_expenditures", "cash_flow.stock_repurchases", "shareholders_equity.shares_outstanding", "equity_compensation.stock_based_comp_expense"]


#: How sources are named in messages.
SOURCE_NAMES = {"xbrl": "structured facts", "html": "documents", "derived": "derived values"}


def issue(code: str, message: Column, severity: str = "warning", segment_name: str | None = None) -> list[Column]:
    name = F.col(segment_name) if segment_name else F.lit(None).cast("string")
    return ["cik", F.lit(severity).alias("severity"), F.lit(code).alias("code"), "metric_id", "period_key", "segment_key", name.alias("segment_name"), message.alias("message")]


def _segment_names(df: DataFrame) -> DataFrame:
    """df with a segment_name, null where it has none."""
    return df if "segment_name" in df.columns else df.withColumn("segment_name", F.lit(None).cast("string"))


def value_conflicts(ranked: DataFrame) -> DataFrame:
    """Groups whose best structured fact and best document value differ."""
    first = lambda s: F.min_by(F.when(F.col("source") == s, F.col("amount")), F.when(F.col("source") == s, F.col("value_rank")))
    both = _segment_names(ranked).groupBy(*GROUP).agg(first("xbrl").alias("x"), first("html").alias("h"), F.min("segment_name").alias("segment_name"))
    message = F.lit("structured facts and documents give different values; the fact was taken")
    return both.where(F.abs(F.col("x") - F.col("h")) > TOLERANCE).select(*issue("xbrl_html_value_conflict", message, segment_name="segment_name"))


def duplicate_flags(ranked: DataFrame, best: list[str] | None = None) -> DataFrame:
    """For each group and source: how many values, whether they are all alike, and which rules excuse them. With best, also the best
    value's columns of these names, n_given, how many values were given before equal ones were collapsed (of ranked with n_alike), and
    selected_as_primary.

    One aggregation: each rule is a boolean over a group's counts and extremes. Amounts within TOLERANCE of their neighbour in order
    count as one amount. Whether filings repeat one another's amounts is told by fingerprints of their multisets, the number of
    amounts and two sums of hashes, so no row holds a list, however many values a group has.
    """
    w, own = over_group("source"), Window.partitionBy(*GROUP, "source", "accession")
    v = ranked.withColumns({"size": F.abs("amount"), "delta": F.when(is_segment() | metric_is(NOTES, DEBT), year_delta()).otherwise(0), "gap": F.col("amount") - F.lag("amount").over(Window.partitionBy(*GROUP, "source").orderBy("amount"))})
    v = _segment_names(v).withColumn("alike", F.sum((F.coalesce("gap", F.lit(0.0)) > TOLERANCE).cast("int")).over(Window.partitionBy(*GROUP, "source").orderBy("amount").rowsBetween(Window.unboundedPreceding, 0)))
    part = lambda seed: F.sum(F.pmod(F.xxhash64("alike", F.lit(seed)), F.lit(1 << 40))).over(own)
    v = v.withColumns({
        "same_amount": F.count(F.lit(1)).over(Window.partitionBy(*GROUP, "source", "alike")),
        "set": F.struct(F.count(F.lit(1)).over(own).alias("n"), part(1).alias("a"), part(2).alias("b")),
        "history": F.struct("delta", "accession"),
        "total": F.col("segment_total") & (F.col("value_rank") == F.min(F.when(F.col("segment_total"), F.col("value_rank"))).over(own)),
    })
    v = v.withColumns({"top_amount": F.max("same_amount").over(w), "best": F.min("history").over(w), "best_total": F.min(F.when(F.col("total"), F.col("history"))).over(w), "top_size": F.max("size").over(w)})
    total, top = F.col("total"), F.col("size") == F.col("top_size")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    one_of = lambda c: F.coalesce(F.min(c) == F.max(c), F.lit(False))  # noqa: E731  # a second distinct count would copy each row
    unit = F.when(F.col("unit_kind").isNotNull() & F.col("scale").isNotNull(), F.struct("unit_kind", F.coalesce("unit_code", F.lit("")).alias("code"), "scale"))
    g = v.groupBy(*GROUP, "source").agg(
        F.count(F.lit(1)).alias("n"),
        (F.max("amount") - F.min("amount")).alias("spread"),
        one_of(unit).alias("one_unit"),
        one_of(F.col("accession")).alias("one_accession"),
        F.max("accession").isNotNull().alias("any_accession"),
        F.count_distinct("set").alias("sets"),
        F.max("top_amount").alias("top"),
        count(F.col("same_amount") == F.col("top_amount")).alias("at_top"),
        F.count("xbrl_tag").alias("tagged"),
        F.max("size").alias("largest"),
        F.when(count(top) >= 2, F.max("size")).otherwise(F.max(F.when(~top, F.col("size")))).alias("next_largest"),
        F.min("segment_name").alias("segment_name"),
        F.max(F.lower(F.coalesce("row_label", F.lit(""))).startswith("total ").cast("int")).alias("has_total"),
        count(F.col("history") == F.col("best")).alias("at_best"),
        count(total).alias("totals"),
        (F.max(F.when(total, F.col("amount"))) - F.min(F.when(total, F.col("amount")))).alias("total_spread"),
        count(total & (F.col("history") == F.col("best_total"))).alias("totals_at_best"),
        *[] if best is None else [F.min(F.struct("value_rank", *best)).alias("b"), F.sum("n_alike").alias("n_given")],
    )
    if best is not None:
        g = with_selected(g.withColumns({c: F.col(f"b.{c}") for c in best}).drop("b"))
    n, one, first, second = F.col("n"), F.col("one_accession"), F.col("largest"), F.col("next_largest")
    rules = {
        "segment_total": is_segment() & (F.col("totals") > 0) & ((F.col("totals") == 1) | (F.col("total_spread") <= TOLERANCE) | (F.col("totals_at_best") == 1)),
        "segment_one_filing": is_segment() & (n >= 2) & one,
        "segment_repeated_sets": is_segment() & (n >= 4) & F.col("any_accession") & ~one & (F.col("sets") == 1),
        "debt_repeated": metric_is(DEBT) & (n >= 3) & (F.col("top") >= 3) & ((F.col("at_top") == n) | ((F.col("at_top") + 1 == n) & (n >= 4))),
        "revenue_pair": metric_is(REVENUE) & (n == 2) & one & (F.col("tagged") == 1),
        "cogs_pair": metric_is(COGS) & (n == 2) & one & (first >= 1000) & (second <= first * 0.5),
        "notes_pair": metric_is(NOTES) & (n == 2) & one,
        "debt_cluster": metric_is(DEBT) & (n >= 2) & one & ((second == 0) | (first <= second * 1.02) | ((first >= 250_000) & (first >= second * 1.10))),
        "detail_total": is_detail() & (n >= 2) & one & (F.col("has_total") == 1),
        "other_funds_pair": metric_is(OTHER_FUNDS) & (n == 2) & one,
        "history": (is_segment() | metric_is(NOTES, DEBT)) & (n >= 2) & (F.col("at_best") == 1),
    }
    alike = (F.col("spread") <= TOLERANCE) & F.col("one_unit")
    return g.withColumns({"identical": alike, **{f"rule_{k}": F.coalesce(c, F.lit(False)) for k, c in rules.items()}}).withColumn("suppressed", reduce(or_, [F.col(f"rule_{k}") for k in rules]))


def duplicate_values(ranked: DataFrame) -> DataFrame:
    return duplicate_issues(duplicate_flags(ranked))


def duplicate_issues(flags: DataFrame) -> DataFrame:
    """An issue for each row of duplicate_flags whose values differ and are not excused."""
    named = F.create_map(*[F.lit(x) for pair in SOURCE_NAMES.items() for x in pair])[F.col("source")]
    message = F.concat(named, F.lit(" give "), F.col("n").cast("string"), F.lit(" values for one metric and period; the first was taken, the others are in provenance"))
    return flags.where("n > 1 and not identical and not suppressed").select(*issue("duplicate_source_values", message, segment_name="segment_name"), "source")


def critical_metric_missing(companies: DataFrame, primary: DataFrame) -> DataFrame:
    """Of each company the critical metrics without a primary value; the list is a column literal, so no join makes the pairs."""
    wanted = companies.select("cik").distinct().select("cik", F.explode(F.array(*[F.lit(m) for m in CRITICAL])).alias("metric_id"))
    gaps = wanted.join(primary.select("cik", "metric_id").distinct(), ["cik", "metric_id"], "left_anti")
    return gaps.withColumns({"period_key": F.lit(None).cast("string"), "segment_key": F.lit(None).cast("string")}).select(*issue("analyst_critical_metric_missing", F.lit("no value of this metric in any period")))


def critical_metric_html_only(primary: DataFrame) -> DataFrame:
    """Critical primary values that come from document tables (embedded facts, typed xbrl, don't count as such)."""
    typed = F.coalesce(F.col("source_type"), F.lit("html")) if "source_type" in primary.columns else F.lit("html")
    return primary.where(F.col("metric_id").isin(*CRITICAL) & (F.col("source") == "html") & (typed != "xbrl")).select(*issue("analyst_critical_metric_html_only", F.lit("only documents give this value")))


def formulas_skipped(companies: DataFrame, outputs: DataFrame) -> DataFrame:
    """Companies without any computed formula; the message names the input that is missing in most of their periods (ties: the
    first by name), or says that there is none of any."""
    lacking = outputs.where("missing_input is not null").groupBy("cik", "missing_input").agg(F.count(F.lit(1)).alias("k"))
    most = lacking.groupBy("cik").agg(F.min(F.struct((-F.col("k")).alias("k"), "missing_input")).alias("m")).select("cik", "m.missing_input")
    none = companies.select("cik").distinct().join(outputs.where("status = 'ok'").select("cik").distinct(), "cik", "left_anti")
    none = none.join(most, "cik", "left")
    message = F.coalesce(F.concat(F.lit("no formula could be computed: most periods lack "), F.col("missing_input")), F.lit("no formula could be computed: there are no inputs"))
    return none.withColumns({"metric_id": F.lit(None).cast("string"), "period_key": F.lit(None).cast("string"), "segment_key": F.lit(None).cast("string")}).select(*issue("valuation_placeholder_skipped", message))


def documents_skipped(parsed: DataFrame, filings: DataFrame) -> DataFrame:
    """One issue for each document that could not be parsed (kind 'error' of parse_documents)."""
    bad = parsed.where("kind = 'error'").select("accession", "text").join(filings.select("accession", "cik"), "accession")
    message = F.concat(F.lit("the document could not be read: "), F.coalesce("text", F.lit("no reason given")), F.lit(" ("), F.col("accession"), F.lit(")"))
    return bad.withColumns({"metric_id": F.lit(None).cast("string"), "period_key": F.col("accession"), "segment_key": F.lit(None).cast("string")}).select(*issue("html_fallback_skipped", message))
