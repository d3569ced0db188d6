"""All values of filing documents, from one parse: tables, debt notes, funding tables, embedded facts and prose.

parsed is what parse_documents gives, written once (parsed_once): every extractor reads cells from there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.functions.registry import metric_registry
from ledgerloom.operators import inline, narrative, tables
from ledgerloom.sources import documents as D
from ledgerloom.sources.scratch import written

COLUMNS = ["cik", "accession", "form_type", "metric_id", "segment_name", "period_start", "period_end", "amount", "unit_kind", "unit_code", "scale", "row_label", "filing_label", "section_name", "table_name", "xbrl_tag", "source", "source_type", "source_method", "pos"]


def _shaped(values: DataFrame, part: int, place) -> DataFrame:
    """values with all of COLUMNS, those it lacks as null; pos orders the values of a document."""
    pos = F.concat_ws("/", "accession", F.lit(f"{part:02d}"), place)
    out = values.withColumns({"pos": pos, "source": F.lit("html")})
    lacking = {c: F.lit(None).cast("date" if c == "period_start" else "string") for c in COLUMNS if c not in out.columns}
    return out.withColumns(lacking).select(*[F.col(c).cast("double") if c == "amount" else F.col(c) for c in COLUMNS])


def _padded(*names: str):
    return F.concat_ws("/", *[F.lpad((F.col(n) + 1).cast("string"), 6, "0") for n in names])


def note_values(grid: DataFrame, filings: DataFrame) -> DataFrame:
    """Debt note and funding values at the filing's own period, with the scale and name of their table."""
    found = [tables.debt_note_values(grid), tables.funding_flow_values(grid, filings), tables.secured_funding_flow_values(grid), tables.funding_balance_values(grid)]
    about = tables.with_contexts(tables.in_filings(grid, filings)).select(*tables.TABLE, "cik", "form_type", F.col("own_end").alias("period_end"), X.infer_scale(F.col("caption")).alias("scale"), F.nullif("context", F.lit("")).alias("table_name"))
    rate = F.col("metric_id") == f"{tables.DEBT}interest_rate"
    out = reduce(DataFrame.unionByName, found).join(about, tables.TABLE)
    return out.withColumns({"unit_kind": F.when(rate, "percentage").otherwise("currency"), "scale": F.when(rate, "raw").otherwise(F.col("scale")), "source_method": F.lit("filing_html"), "filing_label": F.col("row_label")})


def extract_document_values(parsed: DataFrame, filings: DataFrame) -> DataFrame:
    """Candidate values (COLUMNS) of parsed documents of filings(accession, cik, form_type, filing_date, period_end).

    A union of all extractors; a zero revolver balance from prose only for filings without any other revolver value. Documents
    without a filing and ones that could not be parsed give nothing here; the latter are issues of review.documents_skipped.
    """
    parts = list(value_parts(parsed, filings))
    drawn = parts[0].unionByName(parts[1]).select("accession", "metric_id")
    return reduce(DataFrame.unionByName, [*parts, undrawn_values(parsed, filings, drawn)])


def value_parts(parsed: DataFrame, filings: DataFrame):
    """The values of each extractor but undrawn_values, one table at a time: of labelled rows, of debt notes and funding tables, and
    of each kind of embedded fact."""
    grid = D.document_tables(parsed)
    facts, contexts = D.inline_facts(parsed), D.inline_contexts(parsed)
    names = F.broadcast(metric_registry(parsed.sparkSession).select("metric_id", F.col("metric_name").alias("filing_label")))
    typed = {"source_type": F.lit("xbrl"), "source_method": F.lit("filing_html")}
    generic = tables.extract_table_values(grid, filings).withColumns({"source_method": F.lit("filing_html"), "filing_label": F.col("row_label")})
    yield _shaped(generic, 1, _padded("table_no", "row_no"))
    yield _shaped(note_values(grid, filings), 2, _padded("table_no", "row_no"))
    for k, values in enumerate([inline.core_revenue_values, inline.segment_values, inline.share_issuance_values]):
        found = values(facts, contexts, filings).withColumnRenamed("pos", "fact_no").join(names, "metric_id").withColumns(typed)
        yield _shaped(found, 3 + k, _padded("fact_no"))
    summed = inline.derivative_gain_loss(facts, contexts, filings).join(names, "metric_id").withColumns(typed | {"unit_kind": F.lit("currency"), "section_name": F.lit("inline_xbrl_derivative"), "table_name": F.lit("inline_xbrl_derivative")})
    yield _shaped(summed, 6, F.col("period_end").cast("string"))


def undrawn_values(parsed: DataFrame, filings: DataFrame, drawn: DataFrame) -> DataFrame:
    """Zero revolver balances from prose, of filings that have no revolver value among drawn(accession, metric_id)."""
    zero = tables.undrawn_revolver(D.facility_mentions(parsed), filings, drawn)
    zero = zero.withColumns({"unit_kind": F.lit("currency"), "scale": F.lit("raw"), "filing_label": F.lit("Undrawn revolving credit facility")})
    return _shaped(zero, 7, F.lit("0"))


def written_values(parsed: DataFrame, filings: DataFrame, held: list[str] | None = None) -> DataFrame:
    """extract_document_values as a written table. Each extractor is a job of its own, so the driver plans one of them at a time, and
    the values of tables are found once for both their rows and the check of revolver values. The parts are read as one table: a union
    of them would repeat whatever is computed from it for each part."""
    paths: list[str] = []
    for part in value_parts(parsed, filings):
        out = written(part, "document-values", held=paths)
    drawn = out.sparkSession.read.schema(out.schema).parquet(*paths[:2]).select("accession", "metric_id")
    out = written(undrawn_values(parsed, filings, drawn), "document-values", held=paths)
    if held is not None:
        held += paths
    return out.sparkSession.read.schema(out.schema).parquet(*paths)


def document_narratives(parsed: DataFrame, filings: DataFrame) -> DataFrame:
    """cik, accession, section_no, title, content, metric_id, period_key of the documents' classified sections."""
    found = narrative.narrative_metrics(narrative.classify_sections(narrative.sections(D.heading_blocks(parsed))))
    base = filings.select("accession", "cik", F.coalesce("period_end", "filing_date").cast("string").alias("period_key"))
    return found.join(base, "accession").select("cik", "accession", "section_no", "title", "content", "metric_id", "period_key")
