"""Reconciled values are ranked and chosen in one pass, in tasks of bounded size, and read without a shuffle."""

from ledgerloom.operators import reconcile, tables
from ledgerloom.plans.filing_report import FilingReport
from ledgerloom.queries import QUERIES, _filing_documents, _filings
from ledgerloom.sources import views


def test_values_are_read_without_a_shuffle(spark, sf):
    with FilingReport.over(spark, sf) as run:
        for df in (run.primary, run.source_values, run.ranked):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
        again = reconcile.primary_values(reconcile.choose_primary(run.ranked))
        assert sorted(map(str, again.select(*run.primary.columns).collect())) == sorted(map(str, run.primary.collect()))


def test_tasks_grow_with_the_values(spark, sf, monkeypatch):
    monkeypatch.setattr(reconcile, "TASK_VALUES", 100)
    html = views.html_candidates(spark, sf).selectExpr("*", "'USD' unit_code")
    ranked = reconcile.ranked_values(html, 1950)
    assert ranked.rdd.getNumPartitions() == 20
    assert sorted(map(str, ranked.collect())) == sorted(map(str, reconcile.ranked_values(html).collect()))


def test_extractors_are_jobs_of_their_own(spark, sf):
    """What is read of document values is the written parts, each planned by itself."""
    docs = _filing_documents(spark, sf).select("accession", "html")
    with FilingReport(views.issuers(spark, sf), _filings(spark, sf), views.facts(spark, sf), documents=docs) as run:
        plan = run.html._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and len([p for p in run.held if "document-values" in p]) == 7


def test_document_values_are_found_once(spark, sf):
    """The query reads written values: nothing of the extractors is in its plan."""
    plan = QUERIES["document_values"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_only_tables_without_a_caption_read_their_header(spark):
    """Cells of captioned tables aren't normalized for a context that nobody reads."""
    grid = spark.sql("select 'a' accession, n table_no, if(n = 0, 'Debt', ' ') caption, array(struct(array(struct('Rate' text, 0 col_start, 0 col_end)) cells)) rows from values 0, 1 v(n)")
    got = {r.table_no: (r.header_context, r.context) for r in tables.with_contexts(grid).collect()}
    assert got == {0: ("", "Debt"), 1: ("Rate", "Rate")}


def test_parts_of_document_values_are_one_table(spark, sf):
    """What reads document values is planned once, not for each extractor."""
    docs = _filing_documents(spark, sf).select("accession", "html")
    with FilingReport(views.issuers(spark, sf), _filings(spark, sf), views.facts(spark, sf), documents=docs) as run:
        plan = run.html._jdf.queryExecution().optimizedPlan().toString()
        parts = [spark.read.parquet(p).count() for p in run.held if "document-values" in p]
        assert "Union" not in plan and len(parts) == 7 and run.html.count() == sum(parts) > 0
