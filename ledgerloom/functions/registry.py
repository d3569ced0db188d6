"""The metric registry: definitions, tags and label aliases as small static tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Metric id | display name | statement | subdomain | sort order | preferred tags | alternate tags | unit hint.
METRICS = """
balance_sheet.cash_and_equivalents | Cash and Cash Equivalents | balance_sheet | current_assets | 10 | CashAndCashEquivalentsAtCarryingValue | CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents CashAndCashEquivalentsAtCarryingValueIncludingDiscontinuedOperations CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalentsIncludingDisposalGroupAndDiscontinuedOperations | USD
balance_sheet.accounts_receivable | Accounts Receivable | balance_sheet | current_assets | 20 | AccountsReceivableNetCurrent | ReceivablesNetCurrent | USD
balance_sheet.inventory | Inventory | balance_sheet | current_assets | 30 | InventoryNet | | USD
balance_sheet.property_plant_equipment | Property Plant and Equipment | balance_sheet | non_current_assets | 40 | PropertyPlantAndEquipmentNet | | USD
balance_sheet.goodwill_and_intangibles | Goodwill and Intangibles | balance_sheet | non_current_assets | 50 | FiniteLivedIntangibleAssetsNet Goodwill | OtherThanGoodwillIntangibleAssetsNet | USD
balance_sheet.total_assets | Total Assets | balance_sheet | totals | 60 | Assets | | USD
balance_sheet.current_assets | Current Assets | balance_sheet | current_assets | 65 | AssetsCurrent | | USD
balance_sheet.current_debt | Current Debt | balance_sheet | current_liabilities | 70 | LongTermDebtCurrent | ShortTermBorrowings ShortTermBorrowingsCurrent LongTermDebtAndFinanceLeaseObligationsCurrent | USD
balance_sheet.long_term_debt | Long-Term Debt | balance_sheet | non_current_liabilities | 80 | LongTermDebtNoncurrent | LongTermDebt LongTermDebtAndFinanceLeaseObligationsNoncurrent | USD
balance_sheet.total_liabilities | Total Liabilities | balance_sheet | totals | 90 | Liabilities | | USD
balance_sheet.current_liabilities | Current Liabilities | balance_sheet | current_liabilities | 95 | LiabilitiesCurrent | | USD
balance_sheet.accounts_payable | Accounts Payable | balance_sheet | current_liabilities | 97 | AccountsPayableCurrent | AccountsPayableAndAccruedLiabilitiesCurrent | USD
balance_sheet.total_equity | Total Equity | balance_sheet | totals | 100 | StockholdersEquity | StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest | USD
income_statement.revenue | Revenue | income_statement | operating_results | 110 | RevenueFromContractWithCustomerExcludingAssessedTax | SalesRevenueNet Revenues SalesRevenueServicesNet | USD
income_statement.cost_of_goods_sold | Cost of Goods Sold | income_statement | operating_results | 120 | CostOfGoodsSold | CostOfSales | USD
income_statement.gross_profit | Gross Profit | income_statement | operating_results | 130 | GrossProfit | | USD
income_statement.operating_expenses | Operating Expenses | income_statement | operating_results | 140 | OperatingExpenses | | USD
income_statement.operating_income | Operating Income | income_statement | operating_results | 150 | OperatingIncomeLoss | | USD
income_statement.interest_expense | Interest Expense | income_statement | below_operating | 160 | InterestExpense | | USD
income_statement.tax_expense | Income Tax Expense | income_statement | below_operating | 170 | IncomeTaxExpenseBenefit | | USD
income_statement.net_income | Net Income | income_statement | totals | 180 | NetIncomeLoss | | USD
income_statement.diluted_eps | Diluted EPS | income_statement | per_share | 190 | EarningsPerShareDiluted | | ratio
cash_flow.net_cash_from_operations | Net Cash From Operating Activities | cash_flow | operating_cash_flow | 200 | NetCashProvidedByUsedInOperatingActivities | NetCashProvidedByUsedInOperatingActivitiesContinuingOperations | USD
cash_flow.depreciation_and_amortization | Depreciation and Amortization | cash_flow | operating_cash_flow | 210 | DepreciationDepletionAndAmortization | DepreciationAmortizationAndAccretionNet | USD
cash_flow.capital_expenditures | Capital Expenditures | cash_flow | investing_cash_flow | 220 | PaymentsToAcquirePropertyPlantAndEquipment | CapitalExpendituresIncurredButNotYetPaid | USD
cash_flow.net_cash_from_investing | Net Cash From Investing Activities | cash_flow | investing_cash_flow | 230 | NetCashProvidedByUsedInInvestingActivities | | USD
cash_flow.net_cash_from_financing | Net Cash From Financing Activities | cash_flow | financing_cash_flow | 240 | NetCashProvidedByUsedInFinancingActivities | | USD
cash_flow.stock_repurchases | Stock Repurchases | cash_flow | financing_cash_flow | 250 | PaymentsForRepurchaseOfCommonStock | PaymentsForRepurchaseOfEquity PaymentsForRepurchaseOfCommonStocks | USD
cash_flow.share_issuance_proceeds | Share Issuance Proceeds | cash_flow | financing_cash_flow | 260 | ProceedsFromStockOptionsExercised | ProceedsFromIssuanceOfCommonStock | USD
shareholders_equity.common_stock | Common Stock | shareholders_equity | capital_accounts | 270 | CommonStocksIncludingAdditionalPaidInCapital | CommonStockValue | USD
shareholders_equity.additional_paid_in_capital | Additional Paid In Capital | shareholders_equity | capital_accounts | 280 | AdditionalPaidInCapital | | USD
shareholders_equity.retained_earnings | Retained Earnings | shareholders_equity | retained_earnings | 290 | RetainedEarningsAccumulatedDeficit | | USD
shareholders_equity.treasury_stock | Treasury Stock | shareholders_equity | capital_accounts | 300 | TreasuryStockValue | | USD
shareholders_equity.accumulated_oci | Accumulated OCI | shareholders_equity | capital_accounts | 310 | AccumulatedOtherComprehensiveIncomeLossNetOfTax | | USD
shareholders_equity.shares_outstanding | Shares Outstanding | shareholders_equity | share_counts | 320 | CommonStocksIncludingAdditionalPaidInCapitalSharesOutstanding | CommonStockSharesOutstanding EntityCommonStockSharesOutstanding | shares
segment_data.segment_revenue | Segment Revenue | segment_footnote | segment_results | 330 | RevenueFromExternalCustomersByReportableSegment | RevenuesFromExternalCustomers | USD
segment_data.segment_profit_or_loss | Segment Profit or Loss | segment_footnote | segment_results | 340 | ProfitLossByReportableSegment | OperatingIncomeLossBySegment | USD
segment_data.segment_assets | Segment Assets | segment_footnote | segment_assets | 350 | AssetsByReportableSegment | | USD
debt_and_credit.revolver_balance | Revolver Balance | debt_footnote | credit_facilities | 360 | LineOfCreditFacilityAmountOutstanding | ShortTermBorrowings | USD
debt_and_credit.term_loan_balance | Term Loan Balance | debt_footnote | term_loans | 370 | LongTermDebtAndCapitalLeaseObligations | LongTermDebtNoncurrent | USD
debt_and_credit.notes_and_bonds | Notes and Bonds | debt_footnote | notes_and_bonds | 380 | UnsecuredDebt | LongTermDebtFairValue | USD
debt_and_credit.debt_maturities | Debt Maturities | debt_footnote | maturities | 390 | LongTermDebtMaturitiesRepaymentsOfPrincipalInNextTwelveMonths | | USD
debt_and_credit.interest_rate | Debt Interest Rate | debt_footnote | rates | 400 | InterestRate | LongtermDebtWeightedAverageInterestRate ShortTermDebtWeightedAverageInterestRate | percentage
debt_and_credit.detail_senior_notes | Senior Notes | debt_footnote | funding_detail | 410 | | | USD
debt_and_credit.detail_subordinated_debt | Subordinated Debt | debt_footnote | funding_detail | 420 | | | USD
debt_and_credit.detail_other_borrowed_funds | Other Borrowed Funds | debt_footnote | funding_detail | 430 | | | USD
debt_and_credit.detail_secured_borrowings | Secured Borrowings | debt_footnote | funding_detail | 440 | | | USD
debt_and_credit.detail_structured_notes | Structured Notes | debt_footnote | funding_detail | 450 | | | USD
debt_and_credit.detail_senior_notes_issuance | Senior Notes Issuance | debt_footnote | funding_flow_detail | 460 | | | USD
debt_and_credit.detail_senior_notes_maturities | Senior Notes Maturities | debt_footnote | funding_flow_detail | 470 | | | USD
debt_and_credit.detail_subordinated_debt_issuance | Subordinated Debt Issuance | debt_footnote | funding_flow_detail | 480 | | | USD
debt_and_credit.detail_subordinated_debt_maturities | Subordinated Debt Maturities | debt_footnote | funding_flow_detail | 490 | | | USD
debt_and_credit.detail_other_borrowed_funds_issuance | Other Borrowed Funds Issuance | debt_footnote | funding_flow_detail | 500 | | | USD
debt_and_credit.detail_other_borrowed_funds_maturities | Other Borrowed Funds Maturities | debt_footnote | funding_flow_detail | 510 | | | USD
debt_and_credit.detail_secured_borrowings_issuance | Secured Borrowings Issuance | debt_footnote | funding_flow_detail | 520 | | | USD
debt_and_credit.detail_secured_borrowings_maturities | Secured Borrowings Maturities | debt_footnote | funding_flow_detail | 530 | | | USD
debt_and_credit.detail_structured_notes_issuance | Structured Notes Issuance | debt_footnote | funding_flow_detail | 540 | | | USD
debt_and_credit.detail_structured_notes_maturities | Structured Notes Maturities | debt_footnote | funding_flow_detail | 550 | | | USD
derivatives_and_securities.derivative_fair_value | Derivative Fair Value | derivative_footnote | derivatives | 410 | DerivativeAssets | DerivativeLiabilities DerivativeAssetsCurrent DerivativeAssetsNoncurrent DerivativeLiabilitiesCurrent DerivativeLiabilitiesNoncurrent | USD
derivatives_and_securities.derivative_gain_loss | Derivative Gain or Loss | derivative_footnote | derivatives | 420 | DerivativeGainLossRecognizedInIncome | DerivativeGainLossOnDerivativeNet DerivativeInstrumentsNotDesignatedAsHedgingInstrumentsGainLossNet | USD
derivatives_and_securities.debt_securities_value | Debt Securities Value | derivative_footnote | debt_securities | 430 | AvailableForSaleDebtSecurities | DebtSecuritiesAvailableForSaleAmortizedCost DebtSecuritiesAvailableForSaleExcludingAccruedInterest DebtSecuritiesAvailableForSaleExcludingAccruedInterestCurrent DebtSecuritiesAvailableForSaleExcludingAccruedInterestNoncurrent | USD
equity_compensation.stock_based_comp_expense | Stock-Based Compensation Expense | equity_comp_footnote | expense | 440 | ShareBasedCompensation | AllocatedShareBasedCompensationExpense | USD
equity_compensation.rsu_activity | RSU Activity | equity_comp_footnote | rsu | 450 | ShareBasedCompensationArrangementByShareBasedPaymentAwardNumberOfSharesAvailableForGrant | ShareBasedCompensationArrangementByShareBasedPaymentAwardEquityInstrumentsOtherThanOptionsGrantsInPeriodTotal ShareBasedCompensationArrangementByShareBasedPaymentAwardEquityInstrumentsOtherThanOptionsVestedInPeriodTotal | shares
equity_compensation.option_activity | Option Activity | equity_comp_footnote | options | 460 | EmployeeServiceShareBasedCompensationNonvestedAwardsTotalCompensationCostNotYetRecognized | ShareBasedCompensationArrangementByShareBasedPaymentAwardOptionsExercisableWeightedAverageExercisePrice | USD
equity_compensation.tax_effects | Stock Compensation Tax Effects | equity_comp_footnote | tax_effects | 470 | ShareBasedCompensationArrangementByShareBasedPaymentAwardTaxBenefitRealized | EmployeeServiceShareBasedCompensationTaxBenefitFromCompensationExpense | USD
equity_compensation.shares_repurchased | Shares Repurchased | equity_comp_footnote | share_counts | 480 | PaymentsForRepurchaseOfCommonStockShares | TreasuryStockSharesAcquired StockRepurchasedDuringPeriodSharesSplitOffTransaction | shares
equity_compensation.net_change_shares_outstanding | Net Change in Shares Outstanding | equity_comp_footnote | share_counts | 490 | IncreaseDecreaseInCommonSharesOutstanding | | shares
footnotes.disclosure_text | Footnote Disclosure Text | notes | narrative | 500 | | | text
mda.management_discussion_text | MD&A Text | mda | narrative | 510 | | | text
valuation.owners_earnings_placeholder | Owner's Earnings Placeholder | | formula_output | 520 | | | USD
valuation.adjusted_earnings_ratio_placeholder | Adjusted Earnings Ratio Placeholder | | formula_output | 530 | | | ratio
risk_factors.placeholder | Risk Factors Placeholder | | future_extension | 540 | | | text
"""

# Metric id: label aliases.
ALIASES = """
balance_sheet.cash_and_equivalents: cash and cash equivalents, cash cash equivalents, cash and equivalents
balance_sheet.accounts_receivable: accounts receivable, accounts receivable net, trade accounts receivable, receivables net
balance_sheet.inventory: inventory, inventories
balance_sheet.property_plant_equipment: property and equipment net, property plant and equipment net, property plant and equipment
balance_sheet.goodwill_and_intangibles: goodwill and intangible assets, goodwill and other intangible assets, intangible assets net, goodwill
balance_sheet.total_assets: total assets
balance_sheet.current_debt: current maturities of long term debt, current portion of long term debt, short term borrowings
balance_sheet.long_term_debt: long term debt, long term debt less current maturities, long term debt excluding current maturities
balance_sheet.total_liabilities: total liabilities
balance_sheet.total_equity: total equity, total shareholders equity, total stockholders equity
income_statement.revenue: revenue, total revenue, revenues, total revenues
income_statement.cost_of_goods_sold: cost of goods sold, cost of sales, cost of revenues, cost of revenue
income_statement.gross_profit: gross profit
income_statement.operating_expenses: operating expenses, total operating expenses
income_statement.operating_income: operating income, operating income loss, income from operations
income_statement.interest_expense: interest expense
income_statement.tax_expense: income tax expense, provision for income taxes, income tax provision
income_statement.net_income: net income, net earnings, net income loss
income_statement.diluted_eps: diluted earnings per share, earnings per share diluted, diluted net income per share
cash_flow.net_cash_from_operations: net cash provided by operating activities, net cash provided by used in operating activities, net cash from operating activities
cash_flow.depreciation_and_amortization: depreciation and amortization, depreciation depletion and amortization
cash_flow.capital_expenditures: capital expenditures, capital expenditures including capitalization of software costs, payments to acquire property and equipment
cash_flow.net_cash_from_investing: net cash used in investing activities, net cash provided by used in investing activities, net cash from investing activities
cash_flow.net_cash_from_financing: net cash provided by financing activities, net cash used in financing activities, net cash provided by used in financing activities, net cash from financing activities
cash_flow.stock_repurchases: repurchases of common stock, common stock repurchased, treasury stock purchases
cash_flow.share_issuance_proceeds: proceeds from stock options exercised, proceeds from issuance of common stock
shareholders_equity.common_stock: common stock
shareholders_equity.additional_paid_in_capital: additional paid in capital
shareholders_equity.retained_earnings: retained earnings, retained earnings accumulated deficit
shareholders_equity.treasury_stock: treasury stock
shareholders_equity.accumulated_oci: accumulated other comprehensive income, accumulated other comprehensive loss
shareholders_equity.shares_outstanding: shares outstanding
debt_and_credit.revolver_balance: revolver balance, revolving credit facility, revolving credit borrowings, borrowings under the revolving credit facility, revolving credit agreement borrowings
debt_and_credit.term_loan_balance: term loan, term loan balance
debt_and_credit.notes_and_bonds: notes and bonds, senior notes, senior unsecured notes, medium term notes, notes payable, bonds payable
debt_and_credit.debt_maturities: current maturities of long term debt, long term debt maturities
debt_and_credit.interest_rate: interest rate, weighted average interest rate, weighted average debt interest rate, weighted average rate
derivatives_and_securities.derivative_fair_value: derivative assets, derivative liabilities, fair value of derivatives
derivatives_and_securities.derivative_gain_loss: derivative gain loss, gain loss on derivatives, gain loss recognized in income on derivatives, gain loss recognized in income on derivative instruments
derivatives_and_securities.debt_securities_value: available for sale debt securities, debt securities available for sale, available for sale debt securities at fair value, debt securities available for sale at fair value
equity_compensation.stock_based_comp_expense: stock based compensation expense, share based compensation expense, stock compensation expense
equity_compensation.rsu_activity: restricted stock units, rsu activity
equity_compensation.option_activity: stock options, option activity
equity_compensation.tax_effects: tax benefit realized, excess tax benefits
equity_compensation.shares_repurchased: shares repurchased
equity_compensation.net_change_shares_outstanding: net change in shares outstanding, increase decrease in common shares outstanding
"""


def rows() -> list[tuple]:
    """(metric_id, metric_name, domain, statement, subdomain, sort_order, position, tags, unit_hint); tags preferred first."""
    out = []
    for k, line in enumerate(METRICS.strip().splitlines()):
        metric, name, statement, sub, order, preferred, alternate, unit = (x.strip() for x in line.split("|"))
        out.append((metric, name, metric.split(".")[0], statement or None, sub, int(order), k, preferred.split() + alternate.split(), unit))
    return out


def alias_rows() -> list[tuple[str, str, int]]:
    """(alias, metric_id, position of the metric in the registry)."""
    at = {r[0]: r[6] for r in rows()}
    split = (line.split(":") for line in ALIASES.strip().splitlines())
    return [(a.strip(), metric, at[metric]) for metric, names in split for a in names.split(",")]


def metric_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "metric_id string, metric_name string, domain string, statement string, subdomain string, sort_order int, position int, tags array<string>, unit_hint string")


def known_tags(metrics: list[str] | None = None) -> list[str]:
    """All tags of the registry, or those of the metrics given."""
    return sorted({t for r in rows() if metrics is None or r[0] in metrics for t in r[7]})


def metric_tags(spark: SparkSession) -> DataFrame:
    """One row per (metric, tag); tag_priority 0 is the first preferred tag."""
    return metric_registry(spark).select("metric_id", "metric_name", "domain", "subdomain", "position", F.posexplode("tags").alias("tag_priority", "tag"))


def metric_aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(alias_rows(), "alias string, metric_id string, position int")


def metrics_of_aliases(spark: SparkSession) -> DataFrame:
    """alias, metrics: what each alias may name, in the registry's order; a table of fixed size that is made without a job."""
    known = {r[0]: r for r in rows()}
    named: dict[str, list] = {}
    for alias, metric, position in sorted(alias_rows(), key=lambda r: r[2]):
        r = known[metric]
        named.setdefault(alias, []).append((position, r[0], r[1], r[2], r[4], r[8]))
    return spark.createDataFrame(list(named.items()), "alias string, metrics array<struct<position: int, metric_id: string, metric_name: string, domain: string, subdomain: string, unit_hint: string>>")


def domain_metrics(domain: str) -> list[str]:
    """The metrics of a domain, known without a job."""
    return [r[0] for r in rows() if r[2] == domain]


def metrics_by_domain(spark: SparkSession, domain: str) -> DataFrame:
    return metric_registry(spark).where(F.col("domain") == domain)


def metric_by_id(spark: SparkSession, metric_id: str) -> DataFrame:
    return metric_registry(spark).where(F.col("metric_id") == metric_id)


#: Labels of the statements.
STATEMENT_LABELS = ["balance_sheet", "income_statement", "cash_flow", "shareholders_equity", "segment_footnote", "debt_footnote", "derivative_footnote", "equity_comp_footnote", "notes", "mda", "other"]


def sheet_name(domain: Column) -> Column:
    """The report sheet of a domain: its own name; risk factors are a skeleton with that name."""
    return F.when(domain == "risk_factors_skeleton", "risk_factors").otherwise(domain)


def statement_label(statement: Column) -> Column:
    """The label of a statement; 'other' for one that is unknown or null."""
    return F.when(statement.isin(*STATEMENT_LABELS), statement).otherwise("other")


def match_tag(tags: DataFrame, tag_col: str = "tag") -> DataFrame:
    """tags and the metrics each names, ignoring case; a tag may name several. The registry side is a fixed 140 rows or so."""
    spark = tags.sparkSession
    known = metric_tags(spark).select(F.lower("tag").alias("known_tag"), "metric_id", "tag_priority")
    return tags.join(F.broadcast(known), F.lower(tag_col) == F.col("known_tag")).drop("known_tag")
