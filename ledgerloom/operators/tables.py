"""Values read from document tables: grid(accession, table_no, caption, rows) of sources.documents.document_tables and
filings(accession, cik, form_type, filing_date, period_end) in, candidate values out.

A table is one row with its cells in arrays, so headers, periods, labels and values are found by array functions without a shuffle;
tables meet their filing once, and labels the broadcast registry. Only the flow headings of funding tables need a window, over the
rows of such tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.functions.registry import metrics_of_aliases

TABLE = ["accession", "table_no"]
DEBT = "debt_and_credit."
#: What a table's context must name for a metric of a domain; other domains and empty contexts fit always.
DOMAIN_CONTEXTS = {
    "balance_sheet": ("balance sheet", "financial position"),
    "income_statement": ("statement of income", "statements of income", "statement of operations", "statements of operations", "results of operations", "earnings"),
    "cash_flow": ("cash flow", "cash flows", "statements of cash"),
    "shareholders_equity": ("equity", "stockholders", "shareholders"),
    "debt_and_credit": ("debt", "credit", "borrowings", "notes"),
    "derivatives_and_securities": ("derivative", "securities", "fair value", "hedging"),
    "equity_compensation": ("share based", "stock based", "equity compensation", "stock compensation"),
}
#: Contexts of tables that hold no values of their own.
SKIPPED = ("reference", "assets and liabilities measured at fair value on a recurring basis", "derivative netting adjustments", "fair value hierarchy", "free standing derivative receivables and payables")


def evaluated(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each of which is evaluated once however often it is named and wherever filters are pushed."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_of")).select(*kept, "_of.*")


def in_filings(grid: DataFrame, filings: DataFrame) -> DataFrame:
    """Tables with the columns of their filing: cik, form_type, report_end and own_end, its period's end or else its date."""
    base = filings.select("accession", "cik", "form_type", F.col("period_end").alias("report_end"), F.coalesce("period_end", "filing_date").alias("own_end"))
    return grid.join(base, "accession")


def with_contexts(grid: DataFrame) -> DataFrame:
    """Tables with bare, whether there is no caption, header_context, for these the texts of the first three rows without digits-only
    and unit cells, and context, the caption or else the header context."""
    wanted = lambda c: X.let(X.normalize_label(c["text"]), lambda n: (n != "") & ~n.rlike("^[0-9]+$") & ~X.has_any(n, "in millions", "in thousands"))
    texts = F.transform(F.slice("rows", 1, 3), lambda r: F.transform(F.filter(r["cells"], wanted), lambda c: c["text"]))
    bare = F.trim("caption") == ""
    out = evaluated(grid.withColumn("caption", F.coalesce("caption", F.lit(""))), header_context=F.when(bare, F.array_join(F.flatten(texts), " ")).otherwise(""))
    return out.withColumns({"bare": bare, "context": F.when(bare, F.col("header_context")).otherwise(F.col("caption"))})


def skip_generic(context: Column) -> Column:
    return X.has_any(X.normalize_label(context), *SKIPPED)


def with_periods(tables: DataFrame) -> DataFrame:
    """Tables of with_contexts and in_filings with periods: the columns (from_col, to_col) and periods (start, end) that one of the
    first four rows names, the one that names most (the first on ties)."""
    def named(c: Column) -> Column:
        n = X.normalize_label(c["text"])
        month = X.let(n, lambda x: x.rlike("(^| )(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)|^[0-9]{4}$"))
        dated = c["text"].rlike("[0-9]") & c["text"].rlike("[A-Za-z]|[0-9]{4}") & month  # others have no period; most amounts aren't normalized
        period = X.header_period(c["text"], F.col("form_type"), F.col("report_end"), F.col("allowed"))
        return F.struct(c["col_start"].alias("from_col"), c["col_end"].alias("to_col"), F.when(dated & ~X.is_reference_header(c["text"]), period).alias("p"))

    heads = F.transform(F.slice("rows", 1, 4), lambda r: F.filter(F.transform(r["cells"], named), lambda c: c["p"].isNotNull()))
    most = lambda found: F.array_max(F.transform(found, lambda x, i: F.struct(F.size(x).alias("n"), (-i).alias("row"))))
    tables = evaluated(tables, allowed=X.let(F.col("context"), X.allows_bare_years))
    return evaluated(tables, periods=X.let(heads, lambda found: F.get(found, -most(found)["row"]))).drop("allowed")


def numeric_cells(cells: Column) -> Column:
    """The cells after the first that are numbers: cell_no, text, col_start, col_end, amount."""
    each = F.transform(cells, lambda c, i: F.struct(i.alias("cell_no"), c["text"].alias("text"), c["col_start"].alias("col_start"), c["col_end"].alias("col_end"), F.when(i > 0, X.parse_number(c["text"])).alias("amount")))
    return F.filter(each, lambda c: c["amount"].isNotNull())


def cell_in_period_span(numeric: Column, period: Column) -> Column:
    """The first numeric cell that overlaps the columns of a period's header."""
    return F.get(F.filter(numeric, lambda c: (c["col_start"] <= period["to_col"]) & (c["col_end"] >= period["from_col"])), 0)


def cell_for_filing(numeric: Column, headers: Column, report_end: Column) -> Column:
    """The first numeric cell under a header (normalized texts of the first row) of the report date or year, else the first."""
    named = lambda c: X.let(F.get(headers, c["cell_no"]), lambda h: F.coalesce(F.contains(h, report_end.cast("string")) | F.contains(h, F.year(report_end).cast("string")), F.lit(False)))
    return F.coalesce(F.get(F.filter(numeric, named), 0), F.get(numeric, 0))


def labelled_rows(tables: DataFrame) -> DataFrame:
    """Rows of at least two cells, with all columns of their table but rows: row_no, cells, row_label, n (normalized)."""
    headers = F.transform(F.coalesce(F.get("rows", 0)["cells"], F.expr("cast(array() as array<struct<text: string, col_start: int, col_end: int>>)")), lambda c: X.normalize_label(c["text"]))
    rows = evaluated(tables, headers=headers).select(*[c for c in tables.columns if c != "rows"], "headers", F.posexplode("rows").alias("row_no", "r"))
    text = F.get("r.cells", 0)["text"]
    rows = evaluated(rows.where(F.size("r.cells") >= 2), row_label=F.trim(text), n=X.normalize_label(text))
    return rows.withColumn("cells", F.col("r.cells")).drop("r")


def context_fits(domain: Column, unit_hint: Column, context: Column) -> Column:
    def fitting(n: Column) -> Column:
        fits = F.lit(True)
        for name, words in DOMAIN_CONTEXTS.items():
            fits = F.when(domain == name, X.has_any(n, *words)).otherwise(fits)
        percent = X.has_any(n, "percent of net sales") & ~unit_hint.isin("percentage", "ratio")
        return F.when(n == "", True).otherwise(fits & ~percent)

    return X.let(X.normalize_label(context), fitting)


def match_labels(rows: DataFrame, context: str = "table_context") -> DataFrame:
    """Rows whose label n is an alias of registry metrics, with the first of these whose domain fits the table's context."""
    metrics = metrics_of_aliases(rows.sparkSession)
    hit = rows.where(X.label_is_usable(F.col("n"))).join(F.broadcast(metrics), F.col("n") == F.col("alias"))
    fits = lambda m: context_fits(m["domain"], m["unit_hint"], F.col(context))
    return evaluated(hit, m=F.get(F.filter("metrics", fits), 0)).where("m is not null").select(*rows.columns, "m.*").drop("position")


def extract_table_values(grid: DataFrame, filings: DataFrame) -> DataFrame:
    """Values of labelled rows: one for each column period that has one, else one at the filing's own period."""
    tables = with_periods(with_contexts(in_filings(grid, filings)))
    dated = F.coalesce(F.size("periods") > 0, F.lit(False))
    tables = tables.withColumn("table_context", F.when(dated & F.col("bare"), F.col("header_context")).otherwise(F.col("caption")))
    tables = evaluated(tables, provenance=F.when(F.trim("table_context") == "", F.col("header_context")).otherwise(F.col("table_context"))).where(~skip_generic(F.col("provenance")))
    rows = match_labels(labelled_rows(tables.withColumn("scale", X.infer_scale(F.col("caption")))).drop("header_context", "context"))
    rows = evaluated(rows, numeric=numeric_cells(F.col("cells"))).where(F.size("numeric") > 0)
    usable = lambda v: v["amount"].isNotNull() & (F.col("unit_hint").isin("percentage", "ratio") | ~X.looks_like_percentage(v["text"])) & X.is_plausible(F.col("metric_id"), v["amount"])
    value = lambda c, start, end: F.struct(c["text"].alias("text"), c["amount"].alias("amount"), start.cast("date").alias("period_start"), end.alias("period_end"))
    spans = F.transform(F.coalesce("periods", F.expr("cast(array() as array<struct<from_col: int, to_col: int, p: struct<start: date, end: date>>>)")), lambda p: value(cell_in_period_span(F.col("numeric"), p), p["p"]["start"], p["p"]["end"]))
    own = F.array(value(cell_for_filing(F.col("numeric"), F.col("headers"), F.col("report_end")), F.lit(None), F.col("own_end")))
    found = evaluated(rows, spans=F.filter(spans, usable)).select("*", F.explode(F.when(F.size("spans") > 0, F.col("spans")).otherwise(F.filter(own, usable))).alias("v"))
    return found.select("cik", "accession", "form_type", "metric_id", "metric_name", "domain", "subdomain", "v.period_start", "v.period_end", "v.amount", X.unit_from_hint(F.col("unit_hint")).alias("unit_kind"), "scale", "row_label", F.nullif("provenance", F.lit("")).alias("table_name"), F.lit("html").alias("source"), "table_no", "row_no")


# debt notes and funding


def _first_column(cells: Column, word: str, wanted) -> Column:
    """Where the first cell starts whose normalized text is wanted; only texts with a word that all wanted ones hold are normalized."""
    named = lambda c: F.contains(F.lower(c["text"]), F.lit(word)) & X.let(X.normalize_label(c["text"]), wanted)
    return F.get(F.filter(cells, named), 0)["col_start"]


def with_debt_columns(tables: DataFrame) -> DataFrame:
    """Tables that name a rate_column or a value_column (display columns) in their first three rows of two cells or more."""
    wide = F.flatten(F.transform(F.slice(F.filter("rows", lambda r: F.size(r["cells"]) >= 2), 1, 3), lambda r: r["cells"]))
    rate = lambda n: F.contains(n, F.lit("effective interest rate")) | (n == "interest rate")
    out = evaluated(tables, wide=wide)
    out = evaluated(out, rate_column=_first_column(F.col("wide"), "interest", rate), value_column=_first_column(F.col("wide"), "carrying", lambda n: F.contains(n, F.lit("carrying value"))))
    return out.where("rate_column is not null or value_column is not null").drop("wide")


def is_funding_summary(context: Column) -> Column:
    n = X.normalize_label(context)
    return reduce(lambda a, b: a & b, [F.contains(n, F.lit(w)) for w in ("long term debt", "short term borrowings", "deposits", "total")])


def is_debt_table(context: Column, rate_column: Column, value_column: Column) -> Column:
    return X.has_any(X.normalize_label(context), "debt", "borrowings", "notes", "credit") | rate_column.isNotNull() | value_column.isNotNull()


def is_note_row(n: Column) -> Column:
    return X.has_any(n, "note", "bond", "debenture")


def is_revolver_row(n: Column) -> Column:
    return X.has_any(n, "revolving credit", "revolver")


def is_rate_row(n: Column) -> Column:
    return X.has_any(n, "weighted average", "fixed rate debt", "floating rate debt", "current portion of long term debt", "short term borrowings") | is_note_row(n) | is_revolver_row(n)


def rate_priority(n: Column) -> Column:
    return F.when(X.has_any(n, "weighted average"), 0).when(n == "long term debt", 1).when(X.has_any(n, "fixed rate debt", "floating rate debt"), 2).when(is_revolver_row(n), 3).otherwise(4)


def debt_detail(n: Column) -> Column:
    """Detail metric of a debt row, without a flow."""
    kinds = [("structured_notes", X.has_any(n, "structured note")), ("subordinated_debt", X.has_any(n, "subordinated debt", "subordinated note", "junior subordinated") | (n == "subordinated")), ("secured_borrowings", X.has_any(n, "secured borrowing", "secured financing", "asset backed", "federal home loan bank", "fhlb", "credit card securitization")), ("other_borrowed_funds", X.has_any(n, "other borrowed funds", "other borrowings", "borrowed funds")), ("senior_notes", X.has_any(n, "senior note", "senior unsecured note", "medium term note"))]
    return reduce(lambda out, kind: F.when(kind[1], F.lit(f"{DEBT}detail_{kind[0]}")).otherwise(out), reversed(kinds), F.lit(None).cast("string"))


def debt_flow(n: Column) -> Column:
    return F.when(X.has_any(n, "issuance", "issued", "originated", "new borrowings"), "issuance").when(X.has_any(n, "maturit", "redemption", "redeemed", "repayment"), "maturities")


def classify_debt_row(n: Column) -> Column:
    return F.when(debt_flow(n).isNotNull(), F.concat(debt_detail(n), F.lit("_"), debt_flow(n))).otherwise(debt_detail(n))


def number_in_column(cells: Column, column: Column) -> Column:
    """Number of the first cell that covers a display column; null without."""
    return X.parse_number(F.get(F.filter(cells, lambda c: (c["col_start"] <= column) & (c["col_end"] >= column)), 0)["text"])


def debt_note_values(grid: DataFrame) -> DataFrame:
    """Of debt tables: the sum of note and bond rows, each detail row, the last revolver row, and the best interest rate."""
    known = with_debt_columns(with_contexts(grid)).where(is_debt_table(F.col("context"), F.col("rate_column"), F.col("value_column")))
    row = lambda r, i: F.struct(i.alias("row_no"), F.trim(F.get(r["cells"], 0)["text"]).alias("row_label"), X.normalize_label(F.get(r["cells"], 0)["text"]).alias("n"), number_in_column(r["cells"], F.col("value_column")).alias("value"), number_in_column(r["cells"], F.col("rate_column")).alias("rate"), (F.size(r["cells"]) >= 2).alias("wide"))
    body = F.filter(F.transform("rows", row), lambda r: r["wide"])
    rows = evaluated(known.select(*TABLE, "context", "rows", "rate_column", "value_column"), body=F.filter(F.slice(body, F.lit(2), F.size("rows")), lambda r: r["n"] != ""))
    rows = evaluated(rows, valued=F.filter("body", lambda r: r["value"].isNotNull()))
    valued = F.col("valued")
    notes = F.filter(valued, lambda r: is_note_row(r["n"]))
    revolver = F.try_element_at(F.filter(valued, lambda r: is_revolver_row(r["n"])), F.lit(-1))
    rated = F.filter("body", lambda r: r["rate"].isNotNull() & (is_rate_row(r["n"]) | (is_funding_summary(F.col("context")) & r["n"].isin("long term debt", "short term borrowings", "deposits", "total"))))
    best = F.array_min(F.transform(rated, lambda r: F.struct(rate_priority(r["n"]).alias("p"), r["row_no"].alias("row_no"), r["rate"].alias("rate"), r["row_label"].alias("row_label"))))
    entry = lambda metric, amount, label, place: F.struct(metric.alias("metric_id"), amount.alias("amount"), label.alias("row_label"), place.cast("int").alias("row_no"))
    picked = F.array(
        F.when(F.size(notes) > 0, entry(F.lit(f"{DEBT}notes_and_bonds"), F.aggregate(notes, F.lit(0.0), lambda a, r: a + r["value"]), F.lit("aggregated debt note instruments"), F.lit(-1))),
        X.let(revolver, lambda r: F.when(r.isNotNull(), entry(F.lit(f"{DEBT}revolver_balance"), r["value"], r["row_label"], r["row_no"]))),
        X.let(best, lambda r: F.when(r.isNotNull(), entry(F.lit(f"{DEBT}interest_rate"), r["rate"], r["row_label"], r["row_no"]))),
    )
    detail = F.transform(valued, lambda r: entry(classify_debt_row(r["n"]), r["value"], r["row_label"], r["row_no"]))
    values = F.concat(F.array_compact(picked), F.filter(detail, lambda v: v["metric_id"].isNotNull()))
    return rows.select(*TABLE, F.explode(values).alias("x")).select(*TABLE, "x.*")


def funding_flow_values(grid: DataFrame, filings: DataFrame) -> DataFrame:
    """Unsecured funding tables: a row 'Issuance' or one of maturities or redemptions names the flow of the rows below it."""
    context = X.normalize_label(F.col("context"))
    wanted = with_contexts(in_filings(grid, filings)).where(F.contains(context, F.lit("long term unsecured funding")) & ~F.contains(context, F.lit("long term secured funding")))
    heading = F.when(F.col("n") == "issuance", "issuance").when(X.has_any(F.col("n"), "maturities", "redemptions"), "maturities")
    rows = labelled_rows(wanted).where("n <> ''").withColumn("heading", heading)
    rows = rows.withColumn("flow", F.last("heading", ignorenulls=True).over(Window.partitionBy(*TABLE).orderBy("row_no")))
    rows = evaluated(rows.where("heading is null and flow is not null"), base=debt_detail(F.col("n"))).where("base is not null")
    amount = cell_for_filing(numeric_cells(F.col("cells")), F.col("headers"), F.col("report_end"))["amount"]
    return rows.select(*TABLE, F.concat_ws("_", "base", "flow").alias("metric_id"), amount.alias("amount"), "row_label", "row_no").where("amount is not null")


def secured_funding_flow_values(grid: DataFrame) -> DataFrame:
    """Secured funding tables: issuance and maturities stand in two columns that the first three rows name."""
    wanted = with_contexts(grid).where(F.contains(X.normalize_label(F.col("context")), F.lit("long term secured funding")))
    head = F.flatten(F.transform(F.slice("rows", 1, 3), lambda r: r["cells"]))
    columns = {"issuance_column": _first_column(head, "issuance", lambda n: X.has_any(n, "issuance")), "maturities_column": _first_column(head, "", lambda n: X.has_any(n, "maturities", "redemptions"))}
    rows = labelled_rows(wanted.withColumns(columns)).where((F.col("row_no") > 0) & (debt_detail(F.col("n")) == f"{DEBT}detail_secured_borrowings"))
    flows = F.array(*[F.struct(F.lit(f"{DEBT}detail_secured_borrowings_{c}").alias("metric_id"), number_in_column(F.col("cells"), F.col(f"{c}_column")).alias("amount")) for c in ("issuance", "maturities")])
    return rows.select(*TABLE, F.explode(flows).alias("x"), "row_label", "row_no").select(*TABLE, "x.*", "row_label", "row_no").where("amount is not null")


def funding_balance_values(grid: DataFrame) -> DataFrame:
    """Other borrowed funds: tables that qualify by context or by a row of total short-term unsecured funding."""
    named = X.has_any(X.normalize_label(F.col("context")), "short term unsecured funding", "short term and other borrowed funds")
    total = F.exists("rows", lambda r: F.coalesce(F.contains(X.normalize_label(F.get(r["cells"], 0)["text"]), F.lit("total short term unsecured funding")), F.lit(False)))
    rows = labelled_rows(with_contexts(grid).where(named | total)).where(debt_detail(F.col("n")) == f"{DEBT}detail_other_borrowed_funds")
    amount = F.get(numeric_cells(F.col("cells")), 0)["amount"]
    return rows.select(*TABLE, F.lit(f"{DEBT}detail_other_borrowed_funds").alias("metric_id"), amount.alias("amount"), "row_label", "row_no").where("amount is not null")


def undrawn_revolver(mentions: DataFrame, filings: DataFrame, values: DataFrame) -> DataFrame:
    """A zero revolver balance where a document's text (mentions: accession, text) names a credit facility, undrawn, and the report date, and no other
    value of the filing is one."""
    n = X.normalize_label(F.col("text"))
    end = F.col("period_end")
    long_date = F.lower(F.date_format(end, "MMMM d yyyy"))
    hit = mentions.join(filings.where("period_end is not null"), "accession").where(F.contains(n, F.lit("credit facility")) & F.contains(n, F.lit("undrawn")) & (F.contains(n, long_date) | F.contains(n, F.replace(end.cast("string"), F.lit("-"), F.lit(" ")))))
    out = hit.join(values.where(F.col("metric_id") == f"{DEBT}revolver_balance").select("accession").distinct(), "accession", "left_anti")
    return out.select("cik", "accession", "form_type", F.lit(f"{DEBT}revolver_balance").alias("metric_id"), "period_end", F.lit(0.0).alias("amount"), F.lit("filing_text").alias("source_method")).distinct()
