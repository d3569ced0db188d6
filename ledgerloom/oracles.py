"""The same queries in SQL that DuckDB runs on the driver's tables: one chain of named subqueries, and a select for each query."""

from __future__ import annotations

from ledgerloom.functions import registry
from ledgerloom.operators.reconcile import AVERAGES, FAIR, PARTIAL_YEAR, STATEMENT_STYLE
from ledgerloom.operators.review import CRITICAL
from ledgerloom.queries import DEBT_LABELS, DOCUMENT_ROWS, FLOW_LABELS, LABELS
from ledgerloom.sources.views import BALANCE_TAGS, DURATION_METRICS, HTML_CONTEXTS, HTML_LABELS, HTML_METRICS, SEGMENTS, TAGS

ARCHIVE = "https://www.sec.gov/Archives/edgar/data/"


def q(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def among(values, key: str) -> str:
    return f"([{', '.join(map(q, values))}])[(({key}) % {len(values)} + 1)::INT]"


def any_in(x: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def ctx(*words: str) -> str:
    return any_in("ctx", *words)


def values(rows) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else q(v) for v in r) + ")" for r in rows)


def lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def label(x: str) -> str:
    return f"trim(regexp_replace({lower(x)}, '[^a-z0-9]+', ' ', 'g'))"


def canonical(x: str) -> str:
    fixed = f"replace(replace(replace({x}, 'Healthc Care', 'Healthcare'), 'healthc care', 'healthcare'), '&', ' and ')"
    return f"array_to_string(list_filter(string_split({label(fixed)}, ' '), lambda w: w NOT IN ('reportable', 'member', 'segment', '')), ' ')"


def humanize(x: str) -> str:
    return f"ltrim(regexp_replace(regexp_replace({x}, 'Member$', ''), '([A-Z])', ' \\1', 'g'))"


COGS, DEBT, RATE, NOTES = "metric_id = 'income_statement.cost_of_goods_sold'", "metric_id = 'balance_sheet.long_term_debt'", "metric_id = 'debt_and_credit.interest_rate'", "metric_id = 'debt_and_credit.notes_and_bonds'"
SEG, DETAIL, OTHER = "metric_id LIKE 'segment_data.%'", "metric_id LIKE 'debt_and_credit.detail_%'", "metric_id = 'debt_and_credit.detail_other_borrowed_funds'"
GAIN = "metric_id = 'derivatives_and_securities.derivative_gain_loss'"
G = "cik, metric_id, period_key, segment_key"
SEGMENT_FROM_FRAME = f"CASE WHEN frame IS NOT NULL THEN {humanize('string_split(frame, chr(95))[3]')} END"

BASE = f"""
registry(metric_id, metric_name, domain, statement, subdomain, sort_order, position, unit_hint) AS (VALUES {values((r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[8]) for r in registry.rows())}),
tags(metric_id, tag, tag_priority) AS (VALUES {values((r[0], t, k) for r in registry.rows() for k, t in enumerate(r[7]))}),
issuers AS (
  SELECT lpad(c_custkey::VARCHAR, 10, '0') AS cik, 'T' || c_custkey AS ticker, c_name AS issuer_name, c_mktsegment AS exchange, {among(['USD', 'EUR', 'GBP', 'JPY', 'CHF'], 'n_regionkey')} AS reported_currency
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
filings0 AS (
  SELECT *, (o_orderdate + INTERVAL 20 YEAR)::DATE AS filing_date, {among(['10-K', '10-Q', '10-K/A', '8-K', '10-Q'], "substr(o_orderpriority, 1, 1)::INT - 1")} AS form_text, lpad(o_custkey::VARCHAR, 10, '0') AS cik FROM orders),
filings AS (
  SELECT cik, cik || '-' || lpad((year(filing_date) % 100)::VARCHAR, 2, '0') || '-' || lpad(o_orderkey::VARCHAR, 6, '0') AS accession, form_text, filing_date,
    CASE WHEN o_orderkey % 37 <> 0 THEN CASE WHEN form_text LIKE '10-K%' THEN make_date(year(filing_date) - 1, 12, 31) ELSE (date_trunc('quarter', filing_date) - INTERVAL 1 DAY)::DATE END END AS period_end,
    'doc' || o_orderkey || '.htm' AS primary_document, o_orderkey,
    CASE WHEN form_text LIKE '10-K%' THEN '10-K' WHEN form_text LIKE '10-Q%' THEN '10-Q' ELSE form_text END AS form_type, form_text LIKE '%/A' AS is_amendment
  FROM filings0),
described AS (
  SELECT *, year(period_end)::INT AS fiscal_year, CASE WHEN period_end IS NULL THEN NULL WHEN form_type = '10-K' THEN 'Q4' WHEN form_type = '10-Q' THEN 'Q' || quarter(period_end) END AS fiscal_quarter,
    '{ARCHIVE}' || ltrim(cik, '0') || '/' || replace(accession, '-', '') || '/' AS url_directory, '{ARCHIVE}' || ltrim(cik, '0') || '/' || replace(accession, '-', '') || '/' || primary_document AS url_primary
  FROM filings),
selected AS (SELECT * FROM described WHERE NOT is_amendment AND form_type IN ('10-K', '10-Q')),
facts0 AS (
  SELECT f.*, l.*, {among(TAGS, 'l_linenumber + l_partkey')} AS tag, coalesce(period_end, filing_date) AS "end", row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT AS pos
  FROM lineitem l JOIN filings f ON l_orderkey = o_orderkey),
facts AS (
  SELECT cik, 'us-gaap' AS taxonomy, tag, CASE WHEN tag = 'CommonStockSharesOutstanding' THEN 'shares' ELSE 'USD' END AS unit,
    CASE WHEN tag NOT IN ({', '.join(map(q, BALANCE_TAGS))}) THEN date_trunc(CASE WHEN form_text LIKE '10-K%' THEN 'year' ELSE 'quarter' END, "end")::DATE END AS period_start, "end" AS period_end, l_extendedprice AS val,
    CASE WHEN l_linestatus = 'O' THEN accession ELSE accession || 'x' END AS accn, year("end")::INT AS fy, CASE WHEN form_text LIKE '10-K%' THEN 'FY' ELSE 'Q' || quarter("end") END AS fp,
    form_type AS form, filing_date AS filed, CASE WHEN l_returnflag = 'R' THEN 'CY_StatementBusinessSegmentsAxis_' || {among(['ConsumerSegment', 'IndustrialSegment', 'OtherGoods'], 'l_suppkey')} || 'Member' END AS frame, pos
  FROM facts0),
html0 AS (
  SELECT f.*, l.*, {among(HTML_METRICS, 'l_partkey')} AS metric_id, make_date(year(filing_date) - 1, 12, 31) AS "end" FROM lineitem l JOIN filings f ON l_orderkey = o_orderkey),
html AS (
  SELECT lpad((cik::BIGINT // 10)::VARCHAR, 10, '0') AS cik, metric_id, CASE WHEN {SEG} THEN {among(SEGMENTS, 'l_suppkey')} END AS segment_name,
    CASE WHEN metric_id IN ({', '.join(map(q, DURATION_METRICS))}) THEN date_trunc('year', "end")::DATE END AS period_start, "end" AS period_end, accession, form_type,
    CASE WHEN {RATE} OR l_quantity < 10 THEN l_quantity ELSE round(l_extendedprice / 1000) * 100 END AS amount, 'currency' AS unit_kind, 'raw' AS scale,
    {among(HTML_LABELS, 'l_linenumber')} AS row_label, {among(HTML_CONTEXTS, 'l_suppkey + l_linenumber')} AS table_name, CASE WHEN l_linenumber % 2 = 0 THEN 'Revenues' END AS xbrl_tag, 'html' AS source,
    lpad(l_orderkey::VARCHAR, 9, '0') || '/' || lpad(l_linenumber::VARCHAR, 3, '0') || '/' || lpad(l_partkey::VARCHAR, 9, '0') || '/' || lpad(l_suppkey::VARCHAR, 9, '0') AS pos
  FROM html0)"""


#: Filings by the recent list of 2016 on, and by all where that doesn't span four report years; each company's latest filing.
FROM_FILES = """
spanned AS (SELECT cik, min(year(period_end)) <= max(year(period_end)) - 3 AS ok FROM selected WHERE year(filing_date) >= 2016 GROUP BY cik),
pool AS (SELECT s.* FROM selected s LEFT JOIN spanned c ON s.cik = c.cik WHERE year(s.filing_date) >= 2016 OR NOT coalesce(c.ok, false)),
picked AS (SELECT * FROM pool QUALIFY max(year(period_end)) OVER (PARTITION BY cik) IS NULL OR period_end IS NULL OR year(period_end) >= max(year(period_end)) OVER (PARTITION BY cik) - 3),
latest AS (SELECT * FROM described QUALIFY row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, accession DESC) = 1),
"""


def matched(known: str) -> str:
    """Facts matched to selected filings, with scores."""
    return f"""
  SELECT x.*, f.accession, f.form_type, CASE WHEN x.accn = f.accession THEN 0 WHEN x.form = f.form_type THEN 1 WHEN x.period_start IS NULL THEN 2 END AS score
  FROM {known} x JOIN selected f ON x.cik = f.cik AND x.period_end = f.period_end WHERE x.accn = f.accession OR x.form = f.form_type OR x.period_start IS NULL
  UNION ALL
  SELECT x.*, f.accession, f.form_type, 3 FROM {known} x JOIN selected f ON x.cik = f.cik AND x.accn = f.accession WHERE f.period_end IS NULL"""


EXTRACT = f"""
known AS (SELECT f.*, t.metric_id, t.tag_priority FROM facts f JOIN tags t ON lower(f.tag) = lower(t.tag)),
scored AS ({matched('known')}),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY accession, metric_id, tag, taxonomy, unit ORDER BY score DESC, filed DESC, period_end DESC, accn, pos) = 1),
fallback AS (SELECT * FROM best QUALIFY tag_priority = min(tag_priority) OVER (PARTITION BY accession, metric_id)),
candidates AS (
  SELECT cik, metric_id, accession, form_type, period_start, period_end, coalesce(period_start || '_to_' || period_end, period_end::VARCHAR) AS period_key, fp AS period_label, fy AS fiscal_year,
    CASE WHEN fp = 'FY' THEN 'Q4' ELSE fp END AS fiscal_quarter, NULL::VARCHAR AS segment_name, val AS amount, CASE WHEN unit = 'USD' THEN 'currency' ELSE unit END AS unit_kind, unit AS unit_code, 'raw' AS scale, tag AS xbrl_tag, score,
    accn || '/' || lpad(pos::VARCHAR, 6, '0') AS pos
  FROM fallback)"""

KEYED_COLUMNS = "cik, metric_id, segment_name, period_start, period_end, accession, form_type, amount, unit_kind, unit_code, scale, row_label, table_name, xbrl_tag, source, pos"


def reconciled(source: str) -> str:
    """From candidates of both sides (columns as in KEYED_COLUMNS) to ranked values and source values."""
    stmt, odd = ctx(*STATEMENT_STYLE), f"({ctx(*AVERAGES)} OR {ctx(*PARTIAL_YEAR)})"
    fair, cont = ctx(*FAIR), ctx("(continued)")
    low = "lower(coalesce(row_label, ''))"
    size = "abs(amount)"
    return f"""
keyed0 AS (
  SELECT *, coalesce(period_start || '_to_' || period_end, period_end::VARCHAR) AS period_key, lower(coalesce(table_name, '')) AS ctx,
    CASE WHEN {SEG} THEN CASE WHEN segment_name IS NULL THEN 'unassigned_segment' ELSE {canonical('segment_name')} END ELSE '' END AS segment_key,
    trim(regexp_replace(replace(replace(replace(segment_name, 'Healthc Care', 'Healthcare'), 'healthc care', 'Healthcare'), 'Reportable Segment', 'Segment'), '\\s+', ' ', 'g')) AS shown
  FROM ({source}) WHERE NOT ({SEG} AND source = 'html' AND segment_name IS NULL)),
keyed AS (
  SELECT * REPLACE (coalesce(min(CASE WHEN {SEG} AND shown IS NOT NULL THEN {{'rank': contains(lower(shown), 'reportable')::INT + (lower(shown) LIKE 'boeing %' OR lower(shown) LIKE 'g e %')::INT, 'size': length(shown), 'name': shown}} END) OVER (PARTITION BY {G}).name, segment_name) AS segment_name) FROM keyed0),
h1 AS (SELECT *, max(({ctx('three months ended')} AND NOT {cont})::INT) OVER w = 1 AND count(*) OVER w >= 2 AS quarter_ FROM keyed WHERE source = 'html' AND NOT ({COGS} AND {ctx('percent of net sales')}) WINDOW w AS (PARTITION BY {G})),
h2 AS (SELECT *, max(({stmt} AND NOT {cont})::INT) OVER w = 1 AND count(*) OVER w >= 2 AS stmt_ FROM h1 WHERE NOT ({COGS} AND quarter_ AND ({ctx('six months ended', 'nine months ended')} OR {cont})) WINDOW w AS (PARTITION BY {G})),
h3 AS (SELECT *, max((NOT ({odd} OR {fair}))::INT) OVER w = 1 AS balance_, max((NOT {fair})::INT) OVER w = 1 AS unfair_ FROM h2 WHERE NOT ({COGS} AND stmt_ AND {cont}) WINDOW w AS (PARTITION BY {G})),
h4 AS (SELECT *, count(*) OVER w AS n_, max({size}) OVER w AS max_ FROM h3 WHERE NOT ({DEBT} AND balance_ AND {odd}) AND NOT (({DEBT} OR {RATE}) AND unfair_ AND {fair}) WINDOW w AS (PARTITION BY {G})),
h5 AS (SELECT *, coalesce(amount - lag(amount) OVER (PARTITION BY {G} ORDER BY amount, accession, pos) > 1e-4, false)::INT AS step_ FROM h4 WHERE NOT (n_ >= 3 AND max_ >= 1000 AND {size} < 1000 AND {size} < max_ * 0.25)),
h6 AS (SELECT *, sum(step_) OVER (PARTITION BY {G} ORDER BY amount, accession, pos ROWS UNBOUNDED PRECEDING) AS cluster_ FROM h5),
h7 AS (SELECT *, count(*) OVER (PARTITION BY {G}, cluster_, unit_kind, unit_code, scale) > 1 AND {size} >= 10 AS same_, n_ >= 3 AS three_ FROM h6),
h8 AS (SELECT *, three_ AND count(*) OVER w >= 3 AS checked_, max(same_::INT) OVER w = 1 AS pair_, min((form_type = '10-K' AND period_start IS NULL)::INT) OVER w = 1 AS annual_, max({size}) OVER w AS top_ FROM h7 WINDOW w AS (PARTITION BY {G})),
h9 AS (SELECT *, max(CASE WHEN {size} < top_ THEN {size} END) OVER (PARTITION BY {G}) AS rest_ FROM h8),
pruned AS (
  SELECT {KEYED_COLUMNS}, period_key, segment_key, ctx FROM h9
  WHERE NOT coalesce(checked_ AND {COGS} AND annual_ AND top_ >= 1000 AND rest_ <= top_ * 0.4 AND {size} < top_, false) AND NOT (checked_ AND pair_ AND {size} < 10)),
r0 AS (
  SELECT *, coalesce({SEG} AND table_name = 'inline_xbrl_segment', false) AS inline_,
    CASE WHEN source = 'xbrl' THEN 0 WHEN {COGS} AND {ctx('percent of net sales')} THEN 5
      WHEN {RATE} THEN CASE WHEN contains({low}, 'weighted average') THEN 1 WHEN {any_in(low, 'fixed rate debt', 'fixed-rate debt', 'floating rate debt', 'floating-rate debt', 'current portion of long term debt', 'short term borrowings')} THEN 2 WHEN {any_in(low, 'note', 'bond', 'debenture')} THEN 3 ELSE 4 END
      WHEN {DEBT} THEN CASE WHEN {ctx('balance sheet')} THEN 1 WHEN {ctx(*PARTIAL_YEAR)} THEN 4 WHEN {ctx(*AVERAGES)} THEN 5 WHEN {fair} THEN 6 ELSE 3 END
      WHEN {low} LIKE 'total %' OR {low} LIKE 'net cash %' OR ({COGS} AND {stmt}) THEN 1 ELSE 2 END AS source_rank,
    abs(coalesce(2000 + try_cast(string_split(accession, '-')[2] AS INT), year(period_end)) - year(period_end))::INT AS delta_
  FROM (SELECT * FROM pruned UNION ALL SELECT {KEYED_COLUMNS}, period_key, segment_key, ctx FROM keyed WHERE source <> 'html')),
r1 AS (
  SELECT *, CASE WHEN {SEG} OR {NOTES} OR {DEBT} THEN delta_ ELSE 0 END AS history_delta, count(*) OVER p AS n_, min(accession) OVER p = max(accession) OVER p AS one_,
    inline_ AND count(*) OVER o >= 3 AND amount = max(amount) OVER o AND abs((sum(amount::DECIMAL(24, 4)) OVER o)::DOUBLE - 2 * amount) <= 1e-4 AS segment_total
  FROM r0 WINDOW p AS (PARTITION BY {G}, source), o AS (PARTITION BY {G}, source, accession, inline_)),
r2 AS (
  SELECT *, row_number() OVER (PARTITION BY {G}, source ORDER BY
      (NOT (source = 'html' AND segment_total))::INT,
      CASE WHEN source = 'html' AND n_ >= 2 AND one_ AND {DETAIL} THEN (NOT ({low} LIKE 'total %'))::INT ELSE 0 END,
      CASE WHEN source = 'html' AND one_ AND ((n_ >= 2 AND ({DEBT} OR {DETAIL})) OR ({OTHER} AND n_ = 2)) THEN -{size} ELSE 0 END,
      CASE WHEN source = 'html' AND {NOTES} AND n_ >= 2 THEN 0 ELSE source_rank END,
      CASE WHEN {SEG} OR {NOTES} THEN history_delta ELSE 0 END, accession,
      CASE WHEN source = 'html' AND {NOTES} AND n_ >= 2 THEN -{size} ELSE 0 END, coalesce(row_label, ''), pos)::INT AS value_rank,
    {{'delta': delta_, 'misfit': CASE WHEN period_start IS NOT NULL AND ((form_type = '10-K' AND strftime(period_start, '%m%d') = '0101' AND strftime(period_end, '%m%d') = '1231') OR (form_type = '10-Q' AND NOT (strftime(period_start, '%m%d') = '0101' AND strftime(period_end, '%m%d') = '1231'))) THEN 0 ELSE 1 END, 'accession': accession}} AS key_
  FROM r1),
r3 AS (SELECT * FROM r2 QUALIFY NOT ({GAIN}) OR source <> 'html' OR key_ = min(key_) OVER (PARTITION BY {G}, source)),
r4 AS (SELECT *, coalesce(amount - lag(amount) OVER (PARTITION BY {G}, source, accession ORDER BY amount, accession, pos) > 1e-4, false)::INT AS step_ FROM r3),
r5 AS (SELECT *, sum(step_) OVER (PARTITION BY {G}, source, accession ORDER BY amount, accession, pos ROWS UNBOUNDED PRECEDING) AS cluster_ FROM r4),
ranked AS (SELECT * FROM r5 QUALIFY row_number() OVER (PARTITION BY {G}, source, accession, cluster_, unit_kind, unit_code, scale, segment_name ORDER BY value_rank) = 1),
s0 AS (
  SELECT *, row_number() OVER (PARTITION BY {G} ORDER BY source DESC, value_rank, accession, pos) AS place_, row_number() OVER (PARTITION BY {G}, source ORDER BY value_rank, accession, pos) AS first_,
    min(source) OVER g <> max(source) OVER g AS both_, max(source) OVER g = 'xbrl' AS any_
  FROM ranked WINDOW g AS (PARTITION BY {G})),
source_values AS (
  SELECT *, place_ = 1 AS selected_as_primary, CASE WHEN both_ THEN 'prefer_xbrl_keep_html_alternative' WHEN any_ THEN 'xbrl_only' ELSE 'html_only' END AS decision,
    CASE WHEN place_ = 1 THEN 'selected primary value' WHEN first_ = 1 AND both_ THEN 'retained alternative source value' ELSE 'retained duplicate source value for review' END AS review_note
  FROM s0),
primary_values AS (SELECT * FROM source_values WHERE selected_as_primary)"""


HTML_SIDE = f"SELECT {KEYED_COLUMNS.replace('unit_code', chr(39) + 'USD' + chr(39) + ' AS unit_code')} FROM html"
XBRL_SIDE = f"SELECT {KEYED_COLUMNS.replace('row_label', 'NULL AS row_label').replace('table_name', 'NULL AS table_name').replace('source', chr(39) + 'xbrl' + chr(39) + ' AS source')} FROM candidates"
UNCOVERED = "html h WHERE NOT EXISTS (SELECT 1 FROM candidates c WHERE c.cik = h.cik AND c.metric_id = h.metric_id AND c.period_start IS NOT DISTINCT FROM h.period_start AND c.period_end = h.period_end)"
NULL_UNIT = KEYED_COLUMNS.replace("unit_code", "NULL AS unit_code")
FALLBACK = f"{XBRL_SIDE} UNION ALL SELECT {NULL_UNIT} FROM {UNCOVERED}"
BOTH = f"{XBRL_SIDE} UNION ALL SELECT {NULL_UNIT} FROM html"

#: FilingReport runs on filings of ten years; the driver's tables span fewer.
RUN = f"{BASE},{EXTRACT},{reconciled(FALLBACK)}"
RUN_BOTH = f"{BASE},{EXTRACT},{reconciled(BOTH)}"
HTML_RUN = f"{BASE},{reconciled(HTML_SIDE)}"

FORMULAS = """
gross AS (
  SELECT r.cik, 'income_statement.gross_profit' AS metric_id, r.period_key, r.period_start, r.period_end, r.amount - coalesce(k.cost, e.cost) AS amount
  FROM primary_values r
  LEFT JOIN (SELECT cik, period_key, max(amount) AS cost FROM primary_values WHERE metric_id = 'income_statement.cost_of_goods_sold' GROUP BY ALL) k ON r.cik = k.cik AND r.period_key = k.period_key
  LEFT JOIN (SELECT cik, period_end, arg_max(amount, period_key) AS cost FROM primary_values WHERE metric_id = 'income_statement.cost_of_goods_sold' GROUP BY ALL) e ON r.cik = e.cik AND r.period_end = e.period_end
  WHERE r.metric_id = 'income_statement.revenue' AND coalesce(k.cost, e.cost) IS NOT NULL AND r.cik NOT IN (SELECT cik FROM primary_values WHERE metric_id = 'income_statement.gross_profit')),
shares AS (
  SELECT cik, 'equity_compensation.net_change_shares_outstanding' AS metric_id, period_key, period_start, period_end, amount - lag(amount) OVER (PARTITION BY cik ORDER BY period_end, period_key) AS amount
  FROM primary_values WHERE metric_id = 'shareholders_equity.shares_outstanding' AND period_start IS NULL AND cik NOT IN (SELECT cik FROM primary_values WHERE metric_id = 'equity_compensation.net_change_shares_outstanding')
  QUALIFY lag(amount) OVER (PARTITION BY cik ORDER BY period_end, period_key) IS NOT NULL),
metrics AS (
  SELECT cik, metric_id, period_key, amount FROM primary_values UNION ALL SELECT cik, metric_id, period_key, amount FROM gross UNION ALL SELECT cik, metric_id, period_key, amount FROM shares),
inputs AS (
  SELECT cik, period_key, max(amount) FILTER (metric_id = 'income_statement.net_income') AS net_income, max(amount) FILTER (metric_id = 'cash_flow.depreciation_and_amortization') AS depreciation,
    max(amount) FILTER (metric_id = 'cash_flow.capital_expenditures') AS capex, max(amount) FILTER (metric_id = 'equity_compensation.stock_based_comp_expense') AS stock_comp,
    max(amount) FILTER (metric_id = 'equity_compensation.net_change_shares_outstanding') AS share_change
  FROM metrics WHERE metric_id IN ('income_statement.net_income', 'cash_flow.depreciation_and_amortization', 'cash_flow.capital_expenditures', 'equity_compensation.stock_based_comp_expense', 'equity_compensation.tax_effects', 'cash_flow.stock_repurchases', 'equity_compensation.shares_repurchased', 'equity_compensation.net_change_shares_outstanding') GROUP BY ALL),
formulas AS (
  SELECT cik, period_key, net_income, CASE WHEN net_income IS NULL OR depreciation IS NULL OR capex IS NULL THEN 'missing_input' ELSE 'ok' END AS owners_status, (net_income + depreciation - capex) / 0.04 AS owners_earnings,
    CASE WHEN net_income IS NULL OR stock_comp IS NULL THEN 'missing_input' WHEN net_income = 0 THEN 'invalid_input' ELSE 'ok' END AS ratio_status, (net_income + stock_comp) / nullif(net_income, 0) AS earnings_ratio,
    depreciation, capex, stock_comp, share_change
  FROM inputs)"""

#: The first required input, in each formula's order, that a period lacks.
LACKS_OWNERS = "CASE WHEN net_income IS NULL THEN 'income_statement.net_income' WHEN depreciation IS NULL THEN 'cash_flow.depreciation_and_amortization' WHEN capex IS NULL THEN 'cash_flow.capital_expenditures' END"
LACKS_RATIO = "CASE WHEN net_income IS NULL THEN 'income_statement.net_income' WHEN stock_comp IS NULL THEN 'equity_compensation.stock_based_comp_expense' END"

RENDERED = f"""
docs0 AS (SELECT f.*, l.* FROM lineitem l JOIN described f ON l_orderkey = o_orderkey WHERE period_end IS NOT NULL),
doc_lines AS (SELECT *, l_quantity::INT AS q, row_number() OVER (PARTITION BY accession ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity::INT)::INT AS row_no FROM docs0)"""


def debt_lines(labels) -> str:
    return f"debt_lines AS (SELECT f.accession, l_quantity::INT AS q, l_suppkey, {among(labels, 'l_partkey')} AS row_label, row_number() OVER (PARTITION BY accession ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity::INT)::INT AS row_no FROM lineitem l JOIN described f ON l_orderkey = o_orderkey)"


def fact_amount(where: str) -> str:
    return f"q::DOUBLE AS amount, 'millions' AS scale, date_trunc('year', period_end)::DATE AS period_start, period_end, (row_no - 1)::INT AS pos FROM doc_lines WHERE {where}"


CRITICALS = ", ".join(map(q, CRITICAL))
NO_KEYS = "NULL::VARCHAR AS period_key, NULL::VARCHAR AS segment_key"


def rules() -> str:
    one = "accessions = 1"
    r = {
        "segment_total": f"{SEG} AND totals > 0 AND (totals = 1 OR total_spread <= 1e-4 OR totals_at_best = 1)",
        "segment_one_filing": f"{SEG} AND n >= 2 AND {one}",
        "segment_repeated_sets": f"{SEG} AND n >= 4 AND accessions >= 2 AND sets = 1",
        "debt_repeated": f"{DEBT} AND n >= 3 AND top >= 3 AND (at_top = n OR (at_top + 1 = n AND n >= 4))",
        "revenue_pair": f"metric_id = 'income_statement.revenue' AND n = 2 AND {one} AND tagged = 1",
        "cogs_pair": f"{COGS} AND n = 2 AND {one} AND sizes[1] >= 1000 AND sizes[2] <= sizes[1] * 0.5",
        "notes_pair": f"{NOTES} AND n = 2 AND {one}",
        "debt_cluster": f"{DEBT} AND n >= 2 AND {one} AND (sizes[2] = 0 OR sizes[1] <= sizes[2] * 1.02 OR (sizes[1] >= 250000 AND sizes[1] >= sizes[2] * 1.10))",
        "detail_total": f"{DETAIL} AND n >= 2 AND {one} AND has_total",
        "other_funds_pair": f"{OTHER} AND n = 2 AND {one}",
        "history": f"({SEG} OR {NOTES} OR {DEBT}) AND n >= 2 AND at_best = 1",
    }
    columns = ", ".join(f"coalesce({c}, false) AS rule_{k}" for k, c in r.items())
    return f"""
d0 AS (SELECT *, abs(amount) AS size, round(amount, 6) AS amount6, {{'delta': history_delta, 'accession': accession}} AS history FROM ranked),
d1 AS (SELECT *, count(*) OVER (PARTITION BY {G}, source, amount6) AS same_amount, list_sort(list(amount6) OVER (PARTITION BY {G}, source, accession)) AS set_, CASE WHEN segment_total THEN row_number() OVER (PARTITION BY {G}, source, accession, segment_total ORDER BY value_rank) END AS total_no FROM d0),
d2 AS (SELECT *, max(same_amount) OVER w AS top_amount, min(history) OVER w AS best, min(CASE WHEN total_no = 1 THEN history END) OVER w AS best_total FROM d1 WINDOW w AS (PARTITION BY {G}, source)),
d3 AS (
  SELECT {G}, source, count(*) AS n, max(amount) - min(amount) AS spread, count(DISTINCT (unit_kind, coalesce(unit_code, ''), scale)) AS units, count(DISTINCT accession) AS accessions, count(DISTINCT set_) AS sets, max(top_amount) AS top,
    count(*) FILTER (same_amount = top_amount) AS at_top, count(xbrl_tag) AS tagged, list_reverse_sort(list(size)) AS sizes, bool_or(lower(coalesce(row_label, '')) LIKE 'total %') AS has_total, count(*) FILTER (history = best) AS at_best,
    count(*) FILTER (total_no = 1) AS totals, max(amount) FILTER (total_no = 1) - min(amount) FILTER (total_no = 1) AS total_spread, count(*) FILTER (total_no = 1 AND history = best_total) AS totals_at_best
  FROM d2 GROUP BY {G}, source),
flags AS (SELECT *, spread <= 1e-4 AND units = 1 AS identical, {columns} FROM d3)"""


RULES = rules()
RULE_NAMES = ["segment_total", "segment_one_filing", "segment_repeated_sets", "debt_repeated", "revenue_pair", "cogs_pair", "notes_pair", "debt_cluster", "detail_total", "other_funds_pair", "history"]
SUPPRESSED = " OR ".join(f"rule_{k}" for k in RULE_NAMES)
FORMULA_INPUTS = [("owners_earnings", "owners_status", "valuation.owners_earnings_placeholder", [("net_income", "income_statement.net_income"), ("depreciation", "cash_flow.depreciation_and_amortization"), ("capex", "cash_flow.capital_expenditures")]), ("earnings_ratio", "ratio_status", "valuation.adjusted_earnings_ratio_placeholder", [("net_income", "income_statement.net_income"), ("stock_comp", "equity_compensation.stock_based_comp_expense"), ("share_change", "equity_compensation.net_change_shares_outstanding")])]
ISSUES_CRITICAL = f"""
  SELECT i.cik, 'warning' AS severity, 'analyst_critical_metric_missing' AS code, m.metric_id, {NO_KEYS} FROM issuers i, (SELECT unnest([{CRITICALS}]) AS metric_id) m WHERE NOT EXISTS (SELECT 1 FROM primary_values p WHERE p.cik = i.cik AND p.metric_id = m.metric_id)
  UNION ALL SELECT cik, 'warning', 'analyst_critical_metric_html_only', metric_id, period_key, segment_key FROM primary_values WHERE source = 'html' AND metric_id IN ({CRITICALS})"""
COVERAGE = """
counted AS (SELECT cik, metric_id, count(*) FILTER (selected_as_primary) AS p, count(*) AS s, count(*) FILTER (source = 'xbrl') AS x, count(*) FILTER (source = 'html') AS h, count(DISTINCT period_key) FILTER (selected_as_primary) AS k FROM source_values GROUP BY ALL),
covered AS (
  SELECT i.cik, r.metric_id, coalesce(p, 0) AS found_primary_values, coalesce(s, 0) AS found_source_values, coalesce(x, 0) AS xbrl_source_values, coalesce(h, 0) AS html_source_values, coalesce(k, 0) AS period_count,
    CASE WHEN coalesce(p, 0) > 0 THEN 'found' WHEN domain = 'risk_factors' THEN 'placeholder_not_extracted' WHEN domain = 'valuation' THEN 'formula_not_computed' WHEN domain IN ('footnotes', 'mda') THEN 'narrative_placeholder' ELSE 'missing_extraction' END AS status
  FROM issuers i CROSS JOIN registry r LEFT JOIN counted c ON c.cik = i.cik AND c.metric_id = r.metric_id)"""
CONFLICTS = f"SELECT cik, 'warning' AS severity, 'xbrl_html_value_conflict' AS code, metric_id, period_key, segment_key FROM ranked GROUP BY {G} HAVING abs(arg_min(amount, value_rank) FILTER (source = 'xbrl') - arg_min(amount, value_rank) FILTER (source = 'html')) > 1e-4"
ENTRIES = ["r.xml", "r_pre.xml", "r_cal.xml", "r_lab.xml", "r.xsd", "full.txt", "Ex99.HTM", "logo.gif"]
KINDS = [("xbrl_instance", "xbrl", "filing_html", "preferred", "xml"), ("xbrl_presentation", "xbrl", "filing_html", "preferred", "xml"), ("xbrl_calculation", "xbrl", "filing_html", "preferred", "xml"), ("xbrl_label", "xbrl", "filing_html", "preferred", "xml"), ("xbrl_schema", "xbrl", "filing_html", "optional", "xml"), ("filing_text", "text", "filing_text", "preferred", "text"), ("exhibit", "html", "filing_html", "optional", "html"), ("unknown", "html", "filing_html", "optional", "unknown")]
MANIFEST = """
  SELECT accession, filing_date, 'filing_index' AS kind, 'html' AS source_type, 'filing_html' AS source_method, 'html' AS format, 'required' AS priority, url_directory AS url, NULL::VARCHAR AS file_name FROM described
  UNION ALL SELECT accession, filing_date, 'primary_document', 'html', 'filing_html', 'html', 'required', url_primary, primary_document FROM described"""
HEADER_DAY = "CASE WHEN o_orderkey % 2 = 0 THEN last_day(d) ELSE d END"
MONTHS_BACK = "CASE o_orderkey % 6 WHEN 0 THEN 12 WHEN 1 THEN 3 WHEN 2 THEN 6 END"
SHOWN = "strftime(e, '%B ') || day(e) || ', ' || year(e)"


def w(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body}"


def page_text(x: str) -> str:
    """Text of a piece of a page: no tags, entities as characters (HTML lets these four end without a semicolon), single spaces."""
    out = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for entity, char in (("&quot;?", '"'), ("&lt;?", "<"), ("&gt;?", ">"), ("&amp;?", "&")):
        out = f"regexp_replace({out}, '{entity}', '{char}', 'g')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


ORACLE_SQL = {
    "ticker_resolve": w(BASE, "SELECT a.ticker, i.cik, CASE WHEN i.cik IS NULL THEN 'unknown_ticker' ELSE 'ok' END AS status FROM (SELECT DISTINCT ' t' || (o_custkey * 2) AS ticker FROM orders) a LEFT JOIN issuers i ON upper(trim(a.ticker)) = i.ticker"),
    "filings_selected": w(BASE, "SELECT cik, accession, form_type, filing_date, period_end, fiscal_year, fiscal_quarter, url_directory, url_primary FROM selected QUALIFY max(year(period_end)) OVER (PARTITION BY cik) IS NULL OR period_end IS NULL OR year(period_end) >= max(year(period_end)) OVER (PARTITION BY cik) - 3"),
    "filings_merged": w(BASE, "SELECT cik, accession, CASE WHEN year(filing_date) >= 2016 THEN form_type || '*' ELSE form_type END AS form_type, filing_date FROM described"),
    "history_coverage": w(BASE, "SELECT cik, min(year(period_end))::INT AS earliest_year, max(year(period_end))::INT AS latest_year, count(*) AS n_filings, 4 AS requested_years, (max(year(period_end)) - 3)::INT AS required_year, coalesce(min(year(period_end)) <= max(year(period_end)) - 3, false) AS covers_span FROM selected GROUP BY cik"),
    "history_files": w(BASE, "SELECT cik, 'CIK' || cik || '-submissions-001.json' AS name FROM issuers WHERE cik NOT IN (SELECT cik FROM selected GROUP BY cik HAVING coalesce(min(year(period_end)) <= max(year(period_end)) - 3, false))"),
    "asset_manifest": w(BASE, MANIFEST),
    "manifest_extended": w(BASE, f"SELECT accession, kind, source_type, source_method, format, priority, url, file_name FROM ({MANIFEST}) UNION ALL SELECT accession, kind, source_type, source_method, format, priority, url_directory || name, name FROM described, (VALUES {values((n, *k) for n, k in zip(ENTRIES, KINDS, strict=True))}) e(name, kind, source_type, source_method, priority, format)"),
    "tag_lookup": w(BASE, "SELECT u.tag, u.n, t.metric_id, t.tag_priority, r.domain, r.statement FROM (SELECT upper(tag) AS tag, count(*) AS n FROM facts GROUP BY 1) u JOIN tags t ON u.tag = upper(t.tag) JOIN registry r ON r.metric_id = t.metric_id"),
    "registry_metrics": w(BASE, "SELECT r.metric_id, metric_name, domain, statement, subdomain, sort_order, (SELECT count(*) FROM tags t WHERE t.metric_id = r.metric_id)::INT AS n_tags, unit_hint, (SELECT count(*) FROM facts f JOIN tags t ON lower(f.tag) = lower(t.tag) WHERE t.metric_id = r.metric_id) AS n_facts FROM registry r"),
    "company_facts_json": w(BASE, "SELECT cik, tag, unit, period_start, period_end, val, accn, fy, fp, form, filed, frame, (row_number() OVER (PARTITION BY cik, tag, unit ORDER BY accn, pos) - 1)::INT AS pos FROM facts"),
    "submissions_arrays": w(BASE, "SELECT cik, 'ok' AS status, accession, form_text, filing_date, period_end, primary_document FROM filings WHERE cik::BIGINT % 50 <> 7 UNION ALL SELECT DISTINCT cik, 'arrays_not_aligned', NULL, NULL, NULL, NULL, NULL FROM filings WHERE cik::BIGINT % 50 = 7"),
    "fact_match": w(f"{BASE}, scored AS ({matched('facts')})", "SELECT cik, accession, tag, accn, pos, val, score::INT AS score FROM scored"),
    "extract_facts": w(f"{BASE},{EXTRACT}", "SELECT * REPLACE (score::INT AS score) FROM candidates"),
    "best_segment_fact": w(f"{BASE}, known AS (SELECT *, 'segment_data.' || tag AS metric_id, coalesce({SEGMENT_FROM_FRAME}, '__default__') AS segment_key FROM facts), scored AS ({matched('known')})", "SELECT accession, metric_id, segment_key, accn, pos, val, score::INT AS score FROM scored QUALIFY row_number() OVER (PARTITION BY accession, metric_id, tag, unit, segment_key ORDER BY score DESC, filed DESC, period_end DESC, accn, pos) = 1"),
    "label_functions": f"SELECT p_partkey, {label(chr(39) + 'Total ' + chr(39) + ' || p_name || ' + chr(39) + ' - (In Millions) & ' + chr(39) + ' || p_type')} AS label, -(p_size * 1000)::DOUBLE AS number, 'millions' AS scale, {humanize('regexp_replace(p_brand, ' + chr(39) + '[^A-Za-z0-9]' + chr(39) + ', ' + chr(39) + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ') || ' + chr(39) + 'Segment' + chr(39))} AS segment, {canonical('p_brand || ' + chr(39) + ' & ' + chr(39) + ' || p_type || ' + chr(39) + ' & Reportable Segment' + chr(39))} AS canonical, length({label('p_type')}) BETWEEN 4 AND 140 AND NOT regexp_matches({label('p_type')}, '^[0-9]+$') AS usable, 'xml' AS format, p_size * 1000.0::DOUBLE AS scaled FROM part",
    "header_periods": f"WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders), e AS (SELECT o_orderkey, {HEADER_DAY} AS e, {MONTHS_BACK} AS m, {among(['Year ended ', 'Three months ended ', 'Six months ended ', '', 'Maybe ', 'May be '], 'o_orderkey')} AS words FROM o) SELECT o_orderkey, words || {SHOWN} AS header, CASE WHEN o_orderkey % 6 <> 5 AND e = last_day(e) AND m IS NOT NULL THEN date_trunc('month', e - to_months(m - 1))::DATE END AS period_start, CASE WHEN o_orderkey % 6 <> 5 AND (m IS NULL OR e = last_day(e)) THEN e END AS period_end FROM e",
    "table_cells": w(f"{BASE},{RENDERED}", f"SELECT accession, 0 AS row_no, unnest([0, 1, 2]) AS cell_no, unnest(['', strftime(period_end, '%B ') || day(period_end) || ', ' || year(period_end), 'Ref']) AS text, unnest([0, 1, 3]) AS col_start, unnest([0, 2, 3]) AS col_end FROM (SELECT DISTINCT accession, period_end FROM doc_lines) UNION ALL SELECT accession, row_no, 0 AS cell_no, {among(LABELS, 'l_partkey')} AS text, 0 AS col_start, 0 AS col_end FROM doc_lines UNION ALL SELECT accession, row_no, 1, '$ (' || format('{{:,}}', q * 1000) || ')', 1, 2 FROM doc_lines UNION ALL SELECT accession, row_no, 2, l_linenumber::VARCHAR, 3, 3 FROM doc_lines"),
    "inline_segment_values": w(f"{BASE},{RENDERED}", f"SELECT cik, accession, CASE l_partkey % 3 WHEN 0 THEN 'segment_data.segment_revenue' ELSE 'segment_data.segment_assets' END AS metric_id, 'Consumer Segment' AS segment_name, {fact_amount('l_suppkey % 4 = 1 AND l_partkey % 3 <> 1')}"),
    "inline_core_revenue": w(f"{BASE},{RENDERED}", f"SELECT cik, accession, 'income_statement.revenue' AS metric_id, {fact_amount('l_suppkey % 4 = 0 AND l_partkey % 3 = 0 AND CASE form_type WHEN ' + q('10-Q') + ' THEN period_end - date_trunc(' + q('year') + ', period_end)::DATE <= 100 WHEN ' + q('10-K') + ' THEN period_end - date_trunc(' + q('year') + ', period_end)::DATE >= 300 ELSE true END')}"),
    "derivative_sum": w(f"{BASE},{RENDERED}", "SELECT cik, accession, 'derivatives_and_securities.derivative_gain_loss' AS metric_id, date_trunc('year', period_end)::DATE AS period_start, period_end, sum(q)::DOUBLE AS amount, 'millions' AS scale, count(*) AS n_facts FROM doc_lines WHERE l_suppkey % 4 = 2 AND l_partkey % 3 = 1 GROUP BY cik, accession, period_end"),
    "narrative_sections": "SELECT page_id, 1 AS section_no, CASE page_id % 3 WHEN 0 THEN 'Note ' ELSE 'Management''s Discussion ' END || page_id AS title, url || chr(10) || chr(10) || 'second' AS content, CASE page_id % 3 WHEN 0 THEN 'footnotes.disclosure_text' ELSE 'mda.management_discussion_text' END AS metric_id FROM pages WHERE page_id % 3 < 2",
    "funding_flow": w(f"{BASE}, {debt_lines(FLOW_LABELS)}, flows AS (SELECT *, last_value(CASE row_label WHEN 'Issuance' THEN 'issuance' WHEN 'Maturities and redemptions' THEN 'maturities' END IGNORE NULLS) OVER (PARTITION BY accession ORDER BY row_no) AS flow FROM debt_lines)", "SELECT accession, 'debt_and_credit.detail_' || CASE row_label WHEN 'Senior notes' THEN 'senior_notes_' ELSE 'subordinated_debt_' END || flow AS metric_id, q::DOUBLE AS amount, row_label, (row_no - 1)::INT AS row_no FROM flows WHERE flow IS NOT NULL AND row_label IN ('Senior notes', 'Subordinated debt')"),
    "debt_note_values": w(f"{BASE}, {debt_lines(DEBT_LABELS)}", """
SELECT accession, 'debt_and_credit.notes_and_bonds' AS metric_id, sum(q)::DOUBLE AS amount, 'aggregated debt note instruments' AS row_label, -1 AS row_no FROM debt_lines WHERE row_label IN ('Senior notes', 'Bonds due') GROUP BY accession
UNION ALL SELECT accession, 'debt_and_credit.detail_' || CASE row_label WHEN 'Senior notes' THEN 'senior_notes' WHEN 'Subordinated debt' THEN 'subordinated_debt' ELSE 'secured_borrowings' END, q::DOUBLE, row_label, row_no FROM debt_lines WHERE row_label IN ('Senior notes', 'Subordinated debt', 'FHLB advances')
UNION ALL SELECT accession, 'debt_and_credit.revolver_balance', arg_max(q, row_no)::DOUBLE, 'Revolving credit facility', max(row_no) FROM debt_lines WHERE row_label = 'Revolving credit facility' GROUP BY accession
UNION ALL SELECT accession, 'debt_and_credit.interest_rate', (l_suppkey % 10)::DOUBLE, row_label, row_no FROM debt_lines WHERE row_label IN ('Senior notes', 'Bonds due', 'Revolving credit facility', 'Weighted average rate')
  QUALIFY row_number() OVER (PARTITION BY accession ORDER BY CASE row_label WHEN 'Weighted average rate' THEN 0 WHEN 'Revolving credit facility' THEN 3 ELSE 4 END, row_no) = 1"""),
    "table_values": w(f"{BASE},{RENDERED}", f"SELECT cik, accession, CASE lab WHEN 'Net income' THEN 'income_statement.net_income' WHEN 'Revenues' THEN 'income_statement.revenue' WHEN 'Cost of sales' THEN 'income_statement.cost_of_goods_sold' ELSE 'income_statement.gross_profit' END AS metric_id, NULL::DATE AS period_start, period_end, l_linenumber::DOUBLE AS amount, 'thousands' AS scale, lab AS row_label, row_no FROM (SELECT *, {among(LABELS, 'l_partkey')} AS lab FROM doc_lines) WHERE lab <> 'Not a metric'"),
    "html_not_covered": w(f"{BASE},{EXTRACT}", f"SELECT cik, metric_id, period_start, period_end, accession, amount, pos FROM {UNCOVERED}"),
    "segment_names": w(HTML_RUN, f"SELECT {G}, min(segment_name) AS segment_name, count(*) AS n FROM keyed WHERE {SEG} GROUP BY {G}"),
    "prune_outliers": w(HTML_RUN, f"SELECT {G}, amount, pos FROM pruned"),
    "rank_sources": w(HTML_RUN, f"SELECT {G}, amount, pos, source_rank::INT AS source_rank, history_delta::INT AS history_delta, value_rank FROM ranked"),
    "primary_values": w(RUN, f"SELECT {G}, source, accession, amount, decision FROM primary_values"),
    "source_values": w(RUN_BOTH, f"SELECT {G}, source, accession, amount, pos, selected_as_primary, decision, review_note FROM source_values"),
    "issues_duplicates": w(f"{HTML_RUN},{RULES}", f"SELECT {G}, n, identical, {', '.join('rule_' + k for k in RULE_NAMES)}, ({SUPPRESSED}) AS suppressed FROM flags"),
    "issues_conflicts": w(RUN_BOTH, CONFLICTS),
    "issues_critical": w(RUN, ISSUES_CRITICAL),
    "issues_formulas": w(f"{RUN},{FORMULAS}", "SELECT cik, 'valuation_placeholder_skipped' AS code FROM issuers WHERE cik NOT IN (SELECT cik FROM formulas WHERE owners_status = 'ok' OR ratio_status = 'ok')"),
    "gross_profit": w(f"{RUN},{FORMULAS}", "SELECT cik, metric_id, period_key, round(amount, 2) AS amount FROM gross"),
    "share_change": w(f"{RUN},{FORMULAS}", "SELECT cik, metric_id, period_key, round(amount, 2) AS amount FROM shares"),
    "owners_earnings": w(f"{RUN},{FORMULAS}", "SELECT cik, period_key, net_income, owners_status, CASE WHEN owners_status = 'ok' THEN round(owners_earnings, 2) END AS owners_earnings, ratio_status, CASE WHEN ratio_status = 'ok' THEN round(earnings_ratio, 6) END AS earnings_ratio FROM formulas"),
    "fx_convert": f"WITH rates AS (SELECT {among(['EUR', 'GBP', 'JPY', 'CHF'], 'user_id')} AS from_currency, ts::DATE AS date, avg(value::DECIMAL(18, 2))::DECIMAL(18, 4)::DOUBLE AS rate FROM events GROUP BY ALL), a AS (SELECT o_orderkey, {among(['EUR', 'GBP', 'JPY', 'CHF', 'SEK'], 'o_custkey')} AS from_currency, o_totalprice AS amount, (SELECT min(ts::DATE) FROM events) + (o_orderkey % 40)::INT AS date FROM orders) SELECT o_orderkey, a.from_currency, a.date, amount, rate, amount * rate AS converted_amount, CASE WHEN rate IS NULL THEN 'rate_unavailable' ELSE 'ok' END AS status FROM a LEFT JOIN rates r ON a.from_currency = r.from_currency AND a.date = r.date",
    "period_columns": w(f"{BASE},{EXTRACT}, labels AS (SELECT cik, period_key, min(CASE WHEN period_label = 'FY' THEN 'FY' || fiscal_year ELSE fiscal_quarter || ' ' || fiscal_year END) AS l FROM candidates GROUP BY ALL)", "SELECT cik, period_key, CASE WHEN count(*) OVER (PARTITION BY cik, l) > 1 THEN l || ' (' || period_key || ')' ELSE l END AS column_label FROM labels"),
    "domain_pivot": w(RUN, "SELECT p.cik, p.metric_id AS row_id, r.metric_name AS row_label, " + ", ".join(f"max(amount) FILTER (period_key = '{y}-12-31') AS p_{y}_12_31" for y in range(2012, 2019)) + " FROM primary_values p JOIN registry r ON r.metric_id = p.metric_id WHERE r.domain = 'balance_sheet' GROUP BY ALL"),
    "domain_periods": w(RUN, "SELECT p.cik, p.metric_id AS row_id, r.metric_name AS row_label, period_key, max(amount) AS amount FROM primary_values p JOIN registry r ON r.metric_id = p.metric_id WHERE r.domain = 'balance_sheet' GROUP BY ALL"),
    "duplicate_candidates": w(RUN_BOTH, f"SELECT {G}, source, accession, amount, review_note FROM source_values WHERE NOT selected_as_primary"),
    "coverage": w(f"{RUN},{FORMULAS},{COVERAGE}", "SELECT * FROM covered UNION ALL " + " UNION ALL ".join(f"SELECT cik, '{metric}', 1, n, n, 0, 1, 'computed_placeholder' FROM (SELECT cik, {' + '.join(f'({c} IS NOT NULL)::INT' for c, _ in names)} AS n FROM formulas WHERE {status} = 'ok')" for _, status, metric, names in FORMULA_INPUTS)),
    "missing_metrics": w(f"{RUN},{COVERAGE}", "SELECT cik, metric_id, status FROM covered WHERE status <> 'found'"),
    "formula_inputs": w(f"{RUN},{FORMULAS}", " UNION ALL ".join(f"SELECT cik, period_key, '{metric}' AS formula, {k} AS input_no, '{m}' AS metric_id, round({c}, 2) AS amount FROM formulas WHERE {status} = 'ok' AND {c} IS NOT NULL" for _, status, metric, names in FORMULA_INPUTS for k, (c, m) in enumerate(names))),
    "run_summary": w(f"{RUN},{FORMULAS},{RULES}, stages AS (SELECT cik, 'f' AS s FROM selected UNION ALL SELECT cik, 'c' FROM candidates UNION ALL SELECT cik, 'p' FROM primary_values UNION ALL SELECT cik, 'i' FROM ({CONFLICTS}) UNION ALL SELECT cik, 'i' FROM ({ISSUES_CRITICAL}) UNION ALL SELECT cik, 'i' FROM flags WHERE n > 1 AND NOT identical AND NOT ({SUPPRESSED}) UNION ALL SELECT cik, 'i' FROM issuers WHERE cik NOT IN (SELECT cik FROM formulas WHERE owners_status = 'ok' OR ratio_status = 'ok') UNION ALL SELECT cik, 'o' FROM formulas WHERE owners_status = 'ok' UNION ALL SELECT cik, 'o' FROM formulas WHERE ratio_status = 'ok')", "SELECT cik, " + ", ".join(f"count(*) FILTER (s = '{s}') AS n_{n}" for s, n in (("f", "filings"), ("c", "candidates"), ("p", "primary_values"), ("i", "issues"), ("o", "formulas"))) + " FROM stages GROUP BY cik"),
    "slowest_documents": "SELECT user_id AS document_id, sum(value::DECIMAL(18, 2))::DOUBLE AS total_ms FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "company_overview": w(BASE, " UNION ALL ".join(f"SELECT cik, '{c}' AS field, {c} AS value FROM issuers" for c in ("ticker", "issuer_name", "exchange", "reported_currency"))),
}

# documents of five kinds, and what every extractor finds in them
STATEMENT = {"Net income": "income_statement.net_income", "Revenues": "income_statement.revenue", "Cost of sales": "income_statement.cost_of_goods_sold", "Gross profit": "income_statement.gross_profit"}
DOCUMENT_LINES = "dl AS (SELECT f.*, l_quantity::INT AS q, l_linenumber, l_suppkey, o_orderkey % 5 AS kind, CASE o_orderkey % 5 " + " ".join(f"WHEN {k} THEN {among(v, 'l_partkey')}" for k, v in DOCUMENT_ROWS.items()) + " END AS lab, coalesce(period_end, filing_date) AS own_end, row_number() OVER (PARTITION BY accession ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity::INT) AS row_no FROM lineitem JOIN described f ON l_orderkey = o_orderkey WHERE period_end IS NOT NULL OR o_orderkey % 5 <> 0)"
FLOWS = "fl AS (SELECT *, last_value(CASE lab WHEN 'Issuance' THEN 'issuance' WHEN 'Maturities and redemptions' THEN 'maturities' END IGNORE NULLS) OVER (PARTITION BY accession ORDER BY row_no) AS flow FROM dl WHERE kind = 2)"


def found(metric: str, amount: str, source: str, row_label: str = "lab", start: str = "NULL::DATE", end: str = "own_end", unit: str = "currency", scale: str = "raw", kind: str = "NULL", method: str = "filing_html", distinct: str = "") -> str:
    return f"SELECT {distinct} cik, accession, form_type, {metric} AS metric_id, {start} AS period_start, {end} AS period_end, ({amount})::DOUBLE AS amount, {q(unit)} AS unit_kind, {q(scale)} AS scale, {row_label} AS row_label, {kind}::VARCHAR AS source_type, {q(method)} AS source_method FROM {source}"


def _metric_of(labels: dict) -> str:
    return "CASE lab " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in labels.items()) + " END"


YEAR_START = "date_trunc('year', period_end)::DATE"
NOTE_ROWS, DUE = "lab IN ('Senior notes series', 'Bonds due later')", "'debt_and_credit."
DETAILS = "CASE lab WHEN 'Senior notes series' THEN 'debt_and_credit.detail_senior_notes' ELSE 'debt_and_credit.detail_subordinated_debt' END"
DOCUMENT_VALUES = " UNION ALL ".join([
    found(_metric_of(STATEMENT), "q * 1000", "dl WHERE kind = 0 AND lab <> 'Not a metric'", end="period_end", scale="thousands"),
    found("'income_statement.revenue'", "o_orderkey", f"dl WHERE kind = 0 AND CASE form_type WHEN '10-Q' THEN period_end - {YEAR_START} <= 100 WHEN '10-K' THEN period_end - {YEAR_START} >= 300 ELSE true END", "'us-gaap:Revenues'", YEAR_START, "period_end", scale="thousands", kind="'xbrl'", distinct="DISTINCT"),
    found("'cash_flow.share_issuance_proceeds'", "o_orderkey % 1000", "dl WHERE kind = 0", "'us-gaap:ProceedsFromStockOptionsExercised'", YEAR_START, "period_end", scale="thousands", kind="'xbrl'", distinct="DISTINCT"),
    found(f"{DUE}notes_and_bonds'", "notes", f"(SELECT cik, accession, form_type, own_end, sum(q) AS notes FROM dl WHERE kind = 1 AND {NOTE_ROWS} GROUP BY ALL)", "'aggregated debt note instruments'", scale="millions"),
    found(DETAILS, "q", "dl WHERE kind = 1 AND lab IN ('Senior notes series', 'Subordinated debt tranche')", scale="millions"),
    found(f"{DUE}revolver_balance'", "q", "(SELECT * FROM dl WHERE kind = 1 AND lab = 'Revolving credit facility drawn' QUALIFY row_number() OVER (PARTITION BY accession ORDER BY row_no DESC) = 1)", scale="millions"),
    found(f"{DUE}interest_rate'", "l_suppkey % 10", f"(SELECT * FROM dl WHERE kind = 1 AND ({NOTE_ROWS} OR lab LIKE 'Revolving%' OR lab LIKE 'Weighted%') QUALIFY row_number() OVER (PARTITION BY accession ORDER BY CASE WHEN lab LIKE 'Weighted%' THEN 0 WHEN lab LIKE 'Revolving%' THEN 3 ELSE 4 END, row_no) = 1)", unit="percentage"),
    found(f"{DETAILS} || '_' || flow", "q", "fl WHERE flow IS NOT NULL AND lab IN ('Senior notes series', 'Subordinated debt tranche')"),
    found(f"{DUE}detail_secured_borrowings_issuance'", "q", "dl WHERE kind = 3 AND lab LIKE 'Federal%'"),
    found(f"{DUE}detail_secured_borrowings_maturities'", "l_linenumber", "dl WHERE kind = 3 AND lab LIKE 'Federal%'"),
    found(f"{DUE}detail_other_borrowed_funds'", "q", "dl WHERE kind = 3 AND lab LIKE 'Other%'"),
    found(f"{DUE}revolver_balance'", "0", "dl WHERE kind = 3 AND o_orderkey % 2 = 0 AND period_end IS NOT NULL", "NULL::VARCHAR", end="period_end", method="filing_text", distinct="DISTINCT"),
    found(_metric_of(STATEMENT), "q", "dl WHERE kind = 4"),
])
DOCUMENTS = f"{BASE},{DOCUMENT_LINES},{FLOWS}"
CELL_TEXT = "CASE l_linenumber % 5 WHEN 0 THEN format('{:,}', q * 1000) WHEN 1 THEN '(' || q || ')' WHEN 2 THEN q || '%' WHEN 3 THEN '$ ' || q || '.5' ELSE 'n/a' END"
CELL_NUMBER = "CASE l_linenumber % 5 WHEN 0 THEN q * 1000.0 WHEN 1 THEN -q WHEN 2 THEN q WHEN 3 THEN q + 0.5 END"
SOURCE_OF = "CASE WHEN domain IN ('footnotes', 'mda', 'risk_factors') THEN 'html_narrative' WHEN domain = 'valuation' THEN 'valuation_formula' ELSE 'xbrl_primary_html_fallback' END"

ORACLE_SQL |= {
    "historical_submissions": w(BASE, "SELECT cik, 'ok' AS status, accession, form_text, filing_date, period_end, primary_document FROM filings"),
    "ticker_index": w(BASE, "SELECT cik::BIGINT::VARCHAR AS position, cik::BIGINT::VARCHAR AS cik, ticker, issuer_name AS title FROM issuers"),
    "company_identity": w(BASE, "SELECT cik, issuer_name, CASE WHEN cik::BIGINT % 3 <> 0 THEN ticker END AS ticker, CASE WHEN cik::BIGINT % 3 <> 0 THEN exchange END AS exchange, '1231' AS fiscal_year_end FROM issuers"),
    "company_summary": w(BASE, "SELECT cik, issuer_name, ticker FROM issuers"),
    "filing_summary": w(BASE, "SELECT cik, accession AS accession_number, form_type FROM selected"),
    "filing_index": w(BASE, "SELECT cik, accession, form_type, form_text LIKE '%/A' AS is_amendment, filing_date, period_end, fiscal_year, fiscal_quarter, '{ARCHIVE}' || ltrim(cik, '0') || '/' || replace(accession, '-', '') || '/' AS url_index, url_primary FROM selected".replace("{ARCHIVE}", ARCHIVE)),
    "report_from_files": w(f"{BASE},{EXTRACT}".replace("JOIN selected f", "JOIN picked f").replace("facts0 AS (", FROM_FILES + "facts0 AS (", 1), "SELECT p.cik, p.accession, p.form_type, p.filing_date, p.period_end, CASE WHEN p.accession = l.accession THEN l.o_orderkey::DOUBLE END AS revenue, coalesce(n, 0) AS n_facts FROM picked p LEFT JOIN latest l ON p.cik = l.cik LEFT JOIN (SELECT accession, count(*) AS n FROM candidates GROUP BY accession) c ON p.accession = c.accession"),
    "report_by_company": w(BASE, "SELECT cik, 4::BIGINT AS n, 'company_overview' AS sheet FROM issuers UNION ALL SELECT f.cik, count(*), 'filing_index' FROM described f LEFT JOIN issuers i ON f.cik = i.cik WHERE i.exchange IS DISTINCT FROM 'BUILDING' OR (f.form_text NOT LIKE '%/A' AND f.form_type IN ('10-K', '10-Q')) GROUP BY f.cik"),
    "registry_labels": w(BASE, "SELECT r.metric_id, coalesce(statement, 'other') AS statement_label, domain AS sheet, (SELECT count(*) FROM facts f JOIN tags t ON lower(f.tag) = lower(t.tag) WHERE t.metric_id = r.metric_id) AS n_facts FROM registry r WHERE domain = 'balance_sheet' OR r.metric_id = 'income_statement.net_income'"),
    "extract_facts_exact": w(f"{BASE},{EXTRACT.replace('score DESC', 'score')}", "SELECT cik, metric_id, accession, period_key, amount, xbrl_tag, score::INT AS score, pos FROM candidates"),
    "numeric_cells": f"WITH l AS (SELECT *, l_quantity::INT AS q, {among(['balance_sheet.long_term_debt', 'debt_and_credit.interest_rate', 'income_statement.revenue'], 'l_partkey')} AS metric_id, {among(['currency', 'percentage', 'ratio', 'shares', 'text', 'per_share'], 'l_suppkey')} AS hint FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {CELL_TEXT} AS text, ({CELL_NUMBER})::DOUBLE AS number, l_linenumber % 5 = 2 AS percentage, CASE WHEN hint IN ('percentage', 'ratio', 'shares', 'text') THEN hint ELSE 'other' END AS unit, hint, metric_id <> 'debt_and_credit.interest_rate' OR abs({CELL_NUMBER}) <= 100 AS plausible, metric_id FROM l",
    "bare_years": w(BASE, "SELECT accession, CASE WHEN o_orderkey % 5 = 0 THEN 'Reference 2011' WHEN o_orderkey % 7 = 0 THEN 'Year' ELSE year(filing_date)::VARCHAR END AS header, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND form_type = '10-K' AND o_orderkey % 3 <> 1 AND period_end IS NOT NULL THEN make_date(year(filing_date), month(period_end), day(period_end)) END AS period_end, o_orderkey % 5 = 0 AS reference FROM described"),
    "truncated_texts": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'x' || repeat(chr(233), least(p_size, 19)) ELSE repeat(chr(233), least(p_size, 20)) END AS text FROM part",
    "fx_scan": f"SELECT {among(['EUR', 'GBP', 'JPY', 'CHF'], 'user_id')} AS from_currency, 'USD' AS to_currency, ts::DATE AS date, (avg(value::DECIMAL(18, 2)))::DECIMAL(18, 4)::DOUBLE AS rate, 'given' AS provider_name FROM events GROUP BY 1, 3",
    "document_values": w(DOCUMENTS, DOCUMENT_VALUES),
    "domain_positions": w(f"{RUN}, places AS (SELECT cik, period_key, row_number() OVER (PARTITION BY cik ORDER BY period_key)::INT AS place FROM (SELECT DISTINCT cik, period_key FROM primary_values))", "SELECT p.cik, p.metric_id AS row_id, k.place AS \"position\", max(amount) AS amount FROM primary_values p JOIN registry r ON r.metric_id = p.metric_id JOIN places k ON p.cik = k.cik AND p.period_key = k.period_key WHERE r.domain = 'balance_sheet' GROUP BY ALL"),
    "formula_failures": w(f"{RUN},{FORMULAS}", f"SELECT cik, period_key, 'valuation.owners_earnings_placeholder' AS formula, {LACKS_OWNERS} AS missing_input FROM formulas WHERE owners_status = 'missing_input' UNION ALL SELECT cik, period_key, 'valuation.adjusted_earnings_ratio_placeholder', {LACKS_RATIO} FROM formulas WHERE ratio_status = 'missing_input'"),
    "issue_messages": w(f"{RUN},{FORMULAS},{RULES}", f"""SELECT cik, 'duplicate_source_values' AS code, metric_id, period_key, segment_key, CASE source WHEN 'xbrl' THEN 'structured facts' ELSE 'documents' END || ' give ' || n || ' values for one metric and period; the first was taken, the others are in provenance' AS message FROM flags WHERE n > 1 AND NOT identical AND NOT ({SUPPRESSED})
UNION ALL SELECT i.cik, 'valuation_placeholder_skipped', NULL, NULL, NULL, coalesce('no formula could be computed: most periods lack ' || m.missing, 'no formula could be computed: there are no inputs') FROM issuers i
LEFT JOIN (SELECT cik, missing FROM (SELECT cik, missing, count(*) AS k FROM (SELECT cik, {LACKS_OWNERS} AS missing FROM formulas UNION ALL SELECT cik, {LACKS_RATIO} FROM formulas) WHERE missing IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cik ORDER BY k DESC, missing) = 1) m ON i.cik = m.cik
WHERE i.cik NOT IN (SELECT cik FROM formulas WHERE owners_status = 'ok' OR ratio_status = 'ok')"""),
    "issue_counts": w(f"{RUN},{FORMULAS},{RULES}", f"SELECT cik, code, count(*) AS n FROM (SELECT cik, code FROM ({CONFLICTS}) UNION ALL SELECT cik, code FROM ({ISSUES_CRITICAL}) UNION ALL SELECT cik, 'valuation_placeholder_skipped' FROM issuers WHERE cik NOT IN (SELECT cik FROM formulas WHERE owners_status = 'ok' OR ratio_status = 'ok') UNION ALL SELECT cik, 'duplicate_source_values' FROM flags WHERE n > 1 AND NOT identical AND NOT ({SUPPRESSED})) GROUP BY ALL"),
    "provenance_sheet": w(RUN, "SELECT s.cik, s.metric_id, r.metric_name AS metric_label, r.domain, period_key, segment_key, selected_as_primary, source, decision, amount, s.accession, CASE source WHEN 'xbrl' THEN 'api_xbrl_facts' ELSE 'filing_html' END AS source_method, xbrl_tag, f.url_primary AS filing_url, review_note FROM source_values s LEFT JOIN registry r ON r.metric_id = s.metric_id LEFT JOIN (SELECT accession, url_primary FROM selected QUALIFY max(year(period_end)) OVER (PARTITION BY cik) IS NULL OR period_end IS NULL OR year(period_end) > max(year(period_end)) OVER (PARTITION BY cik) - 10) f ON f.accession = s.accession"),
    "provenance_of_assets": w(RUN, "SELECT cik, period_key, source, accession, amount FROM source_values WHERE metric_id = 'balance_sheet.total_assets'"),
    "provenance_lookups": w(RUN, "SELECT cik, metric_id, period_key, segment_key, source, CASE source WHEN 'xbrl' THEN 'api_xbrl_facts' ELSE 'filing_html' END AS source_method, accession, amount, selected_as_primary FROM source_values WHERE metric_id IN ('income_statement.revenue', 'income_statement.net_income', 'cash_flow.capital_expenditures')"),
    "page_sections": f"WITH cut AS (SELECT page_id, split_part(split_part(html, '<h1>', 2), '</h1>', 1) AS h, split_part(split_part(html, '</h1>', 2), '</article>', 1) AS body FROM pages), parts AS (SELECT page_id, {page_text('h')} AS title, [t for t in [{page_text('x')} for x in string_split(body, '<p>')] if t <> ''] AS texts FROM cut) SELECT page_id, 1::INT AS section_no, title, length(array_to_string(texts, chr(10) || chr(10)))::INT AS n_chars FROM parts WHERE title <> '' AND len(texts) > 0",
    "coverage_sheet": w(f"{RUN},{COVERAGE}", f"SELECT c.cik, r.domain, c.metric_id, r.metric_name, {SOURCE_OF} AS expected_source, status, found_primary_values, period_count FROM covered c JOIN registry r ON r.metric_id = c.metric_id"),
    "formula_inputs_sheet": w(f"{RUN},{FORMULAS}", "SELECT i.*, r.metric_name, n.metric_name AS formula_name, p.source FROM (" + " UNION ALL ".join(f"SELECT cik, period_key, '{metric}' AS formula, {k} AS input_no, '{m}' AS metric_id, round({c}, 2) AS amount FROM formulas WHERE {status} = 'ok' AND {c} IS NOT NULL" for _, status, metric, names in FORMULA_INPUTS for k, (c, m) in enumerate(names)) + ") i LEFT JOIN registry r ON r.metric_id = i.metric_id LEFT JOIN registry n ON n.metric_id = i.formula LEFT JOIN primary_values p ON p.cik = i.cik AND p.metric_id = i.metric_id AND p.period_key = i.period_key AND p.segment_key = ''"),
    "report_roundtrip": w(BASE, "SELECT * FROM (VALUES (0, 'schema', 3::BIGINT)) t(place, sheet, n) UNION ALL SELECT 1, 'company_overview', 4 * count(*) FROM issuers UNION ALL SELECT 2, 'filing_index', count(*) FROM selected"),
}
