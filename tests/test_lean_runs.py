"""Runs that keep few tables: primary values without source values, as the whole chain of rules chooses them."""

from ledgerloom.operators import facts, reconcile, review
from ledgerloom.plans.filing_report import FilingReport
from ledgerloom.queries import _filings
from ledgerloom.sources import views

COLUMNS = ["cik", "metric_id", "period_key", "segment_key", "segment_name", "period_start", "period_end", "source", "accession", "amount", "decision"]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_primary_values_need_no_source_values(spark, sf):
    with FilingReport.over(spark, sf) as whole, FilingReport.over(spark, sf, keep="primary") as lean, FilingReport.over(spark, sf, keep=None) as lazy:
        want = rows(whole.primary, *COLUMNS)
        assert rows(lean.primary, *COLUMNS) == want and rows(lazy.primary, *COLUMNS) == want
        assert [p.rsplit("/", 1)[1].split("-")[0] for p in lean.held] == ["primary"] and lazy.held == []
        assert "row_label" not in lean.primary.columns


def test_metrics_do_not_depend_on_one_another(spark, sf):
    some = ["balance_sheet.total_assets", "income_statement.net_income"]
    with FilingReport.over(spark, sf, keep="primary", only=some) as lean, FilingReport.over(spark, sf) as whole:
        assert rows(lean.primary, *COLUMNS) == rows(whole.primary.where(whole.primary.metric_id.isin(some)), *COLUMNS)


def test_covered_values_are_told_while_ranking(spark, sf):
    run = FilingReport.over(spark, sf, keep=None)
    html = reconcile.drop_covered_html(run.candidates, run.html)
    apart = reconcile.ranked_values(run.candidates.unionByName(html, allowMissingColumns=True))
    together = reconcile.ranked_values(run.both_sides, 2000, uncovered=True)
    assert rows(together, *apart.columns) == rows(apart, *apart.columns)


def test_facts_are_dealt_once(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        source = views.facts(spark, sf)
        assert exchanges(facts.extract_facts(source, _filings(spark, sf))) == exchanges(source) + 2  # facts and filings by company
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_duplicate_flags_copy_no_rows(spark, sf):
    ranked = reconcile.ranked_values(views.html_candidates(spark, sf).selectExpr("*", "'USD' unit_code"), 2000)
    plan = review.duplicate_flags(ranked)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
