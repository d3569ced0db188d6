"""Derived metrics, formulas and currency conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REVENUE, COGS, PROFIT = "income_statement.revenue", "income_statement.cost_of_goods_sold", "income_statement.gross_profit"
SHARES, CHANGE = "shareholders_equity.shares_outstanding", "equity_compensation.net_change_shares_outstanding"

REQUIRED_OWNERS = {"net_income": "income_statement.net_income", "depreciation": "cash_flow.depreciation_and_amortization", "capex": "cash_flow.capital_expenditures"}
REQUIRED_RATIO = {"net_income": "income_statement.net_income", "stock_comp": "equity_compensation.stock_based_comp_expense"}
OPTIONAL_RATIO = {"tax_effects": "equity_compensation.tax_effects", "repurchases": "cash_flow.stock_repurchases", "shares_repurchased": "equity_compensation.shares_repurchased", "share_change": CHANGE}
#: What formulas read, and what their inputs are derived from.
FORMULA_METRICS = sorted({*REQUIRED_OWNERS.values(), *REQUIRED_RATIO.values(), *OPTIONAL_RATIO.values(), SHARES, CHANGE})
OWNERS, RATIO = "valuation.owners_earnings_placeholder", "valuation.adjusted_earnings_ratio_placeholder"


def derive_gross_profit(primary: DataFrame) -> DataFrame:
    """Revenue less cost of goods by period key, or else by end date (the largest key's cost), for companies without any
    reported gross profit."""
    without = primary.join(primary.where(F.col("metric_id") == PROFIT).select("cik").distinct(), "cik", "left_anti")
    cost = without.where(F.col("metric_id") == COGS)
    by_key = cost.groupBy("cik", "period_key").agg(F.max("amount").alias("cost"))
    by_end = cost.groupBy("cik", "period_end").agg(F.max_by("amount", "period_key").alias("end_cost"))
    out = without.where(F.col("metric_id") == REVENUE).join(by_key, ["cik", "period_key"], "left").join(by_end, ["cik", "period_end"], "left")
    return out.withColumn("cost", F.coalesce("cost", "end_cost")).where("cost is not null").select("cik", F.lit(PROFIT).alias("metric_id"), "period_key", "period_start", "period_end", (F.col("amount") - F.col("cost")).alias("amount"))


def derive_share_change(primary: DataFrame) -> DataFrame:
    """Difference of consecutive instant share counts, for companies without any reported change."""
    without = primary.join(primary.where(F.col("metric_id") == CHANGE).select("cik").distinct(), "cik", "left_anti")
    w = Window.partitionBy("cik").orderBy("period_end", "period_key")
    counts = without.where((F.col("metric_id") == SHARES) & F.col("period_start").isNull()).withColumn("before", F.lag("amount").over(w))
    return counts.where("before is not null").select("cik", F.lit(CHANGE).alias("metric_id"), "period_key", "period_start", "period_end", (F.col("amount") - F.col("before")).alias("amount"))


def formula_inputs(metrics: DataFrame, period_join: str = "period_key") -> DataFrame:
    """One row per company and period with a column for each formula input; null where missing. period_join='end_date' lets
    instants and durations with one end meet."""
    key = F.col("period_key") if period_join == "period_key" else F.col("period_end").cast("string")
    wanted = REQUIRED_OWNERS | REQUIRED_RATIO | OPTIONAL_RATIO
    return metrics.where(F.col("metric_id").isin(*wanted.values())).groupBy("cik", key.alias("period_key")).agg(*[F.max(F.when(F.col("metric_id") == m, F.col("amount"))).alias(n) for n, m in wanted.items()])


def owners_earnings(inputs: DataFrame, treasury_yield: float = 0.04, working_capital: float = 0.0) -> DataFrame:
    """Adds owners_earnings and owners_status: ok, missing_input, or invalid_input for a yield that isn't positive."""
    missing = F.col("net_income").isNull() | F.col("depreciation").isNull() | F.col("capex").isNull()
    status = F.when(F.lit(treasury_yield) <= 0, "invalid_input").when(missing, "missing_input").otherwise("ok")
    value = (F.col("net_income") + F.col("depreciation") - F.col("capex") - working_capital) / F.lit(treasury_yield if treasury_yield else 1.0)
    return inputs.withColumn("owners_status", status).withColumn("owners_earnings", F.when(F.col("owners_status") == "ok", value))


def adjusted_earnings_ratio(inputs: DataFrame) -> DataFrame:
    """Adds earnings_ratio and ratio_status: ok, missing_input, or invalid_input for a net income of zero."""
    status = F.when(F.col("net_income").isNull() | F.col("stock_comp").isNull(), "missing_input").when(F.col("net_income") == 0, "invalid_input").otherwise("ok")
    shares = F.col("shares_repurchased")
    buyback = F.coalesce(F.when(shares == 0, 0.0).when(shares != 0, F.col("repurchases") * ((shares + F.col("share_change")) / F.nullif(shares, F.lit(0.0)))), F.lit(0.0))
    value = (F.col("net_income") + F.col("stock_comp") - F.coalesce("tax_effects", F.lit(0.0)) - F.when(F.col("repurchases").isNotNull() & F.col("share_change").isNotNull(), buyback).otherwise(0.0)) / F.nullif(F.col("net_income"), F.lit(0.0))
    return inputs.withColumn("ratio_status", status).withColumn("earnings_ratio", F.when(F.col("ratio_status") == "ok", value))


def compute_formulas(metrics: DataFrame, treasury_yield: float = 0.04, working_capital: float = 0.0, strict: bool = False) -> DataFrame:
    """(cik, period_key, metric_id, amount, status, inputs, missing_input) for both formulas; missing_input is the first required
    input, in the formula's order, that a period lacks. strict: an invalid input anywhere voids all of a
    company's outputs."""
    wide = adjusted_earnings_ratio(owners_earnings(formula_inputs(metrics), treasury_yield, working_capital))
    of = lambda names: F.filter(F.array(*[F.struct(F.lit(m).alias("metric_id"), F.col(n).alias("amount")) for n, m in names.items()]), lambda x: x["amount"].isNotNull())
    lacking = lambda required: F.coalesce(*[F.when(F.col(n).isNull(), F.lit(m)) for n, m in required.items()])
    one = lambda metric, value, status, names, required: F.struct(F.lit(metric).alias("metric_id"), F.col(value).alias("amount"), F.col(status).alias("status"), of(names).alias("inputs"), lacking(required).alias("missing_input"))
    rows = F.array(one(OWNERS, "owners_earnings", "owners_status", REQUIRED_OWNERS, REQUIRED_OWNERS), one(RATIO, "earnings_ratio", "ratio_status", REQUIRED_RATIO | OPTIONAL_RATIO, REQUIRED_RATIO))
    out = wide.select("cik", "period_key", F.explode(rows).alias("r")).select("cik", "period_key", "r.*")
    if strict:
        bad = F.max((F.col("status") == "invalid_input").cast("int")).over(Window.partitionBy("cik")) == 1
        out = out.withColumn("bad", bad).withColumn("amount", F.when(~F.col("bad"), F.col("amount"))).withColumn("status", F.when(F.col("bad"), "invalid_input").otherwise(F.col("status"))).drop("bad")
    return out


def convert_currency(amounts: DataFrame, rates: DataFrame) -> DataFrame:
    """amounts(from_currency, to_currency, date, amount) with rate, converted_amount and status; the original stays."""
    joined = amounts.join(rates.select("from_currency", "to_currency", "date", "rate"), ["from_currency", "to_currency", "date"], "left")
    return joined.withColumn("converted_amount", F.col("amount") * F.col("rate")).withColumn("status", F.when(F.col("rate").isNull(), "rate_unavailable").otherwise("ok"))
