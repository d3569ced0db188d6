"""Runs that keep a row for each group and source: what is counted of source values is counted of these, and no value is written."""

import pytest

from ledgerloom.operators import report
from ledgerloom.plans import filing_report
from ledgerloom.plans.filing_report import FilingReport
from ledgerloom.queries import QUERIES

GROUP = ["cik", "metric_id", "period_key", "segment_key", "source"]


def rows(df, *columns):
    return sorted(map(str, df.select(*columns or df.columns).collect()))


def test_groups_count_source_values(spark, sf):
    with FilingReport.over(spark, sf) as whole, FilingReport.over(spark, sf, keep="groups") as groups, FilingReport.over(spark, sf, keep="issues") as issues, FilingReport.over(spark, sf, keep=None) as lazy:
        want = whole.source_values.groupBy(*GROUP).agg({"amount": "count", "selected_as_primary": "max"}).toDF(*GROUP, "n", "selected_as_primary")
        primary = rows(whole.primary, *FilingReport.PRIMARY)
        for run in (groups, issues, lazy):
            assert rows(run.groups, *GROUP, "n", "selected_as_primary") == rows(want)
        assert rows(groups.primary, *FilingReport.PRIMARY) == primary and rows(issues.primary, *FilingReport.PRIMARY) == primary
        assert rows(issues.issues) == rows(whole.issues)
        given = whole.candidates.groupBy("cik").count().selectExpr("cik", "count n")
        assert rows(issues.groups.where("source = 'xbrl'").groupBy("cik").sum("n_given").toDF("cik", "n")) == rows(given)
        assert rows(report.coverage(whole.issuers, groups.groups, groups.formulas)) == rows(report.coverage(whole.issuers, whole.source_values, whole.formulas))
        assert [p.rsplit("/", 1)[1].split("-")[0] for p in groups.held + issues.held + lazy.held] == ["groups", "groups"]


def test_no_shuffle_carries_a_row_for_each_metric(spark, sf):
    """Companies look their numbers up after the shuffles: the metrics of the registry are listed above the last of them."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        values = spark.createDataFrame([("1", "balance_sheet.total_assets", "2011-12-31", True, "xbrl")], "cik string, metric_id string, period_key string, selected_as_primary boolean, source string")
        plan = report.coverage(spark.sql("select '1' cik"), values)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" in plan and "Exchange hashpartitioning" not in plan[: plan.index("Generate inline")]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("name, kept", [("coverage", "groups"), ("coverage_sheet", None), ("missing_metrics", None), ("issue_messages", "groups"), ("issue_counts", "groups"), ("run_summary", "groups"), ("formula_inputs_sheet", "primary"), ("domain_positions", "primary")])
def test_queries_write_no_source_values(spark, sf, monkeypatch, name, kept):
    labels, write = [], filing_report.written
    monkeypatch.setattr(filing_report, "written", lambda df, label, *a, **k: (labels.append(label), write(df, label, *a, **k))[1])
    QUERIES[name](spark, sf)
    assert labels == ([kept] if kept else [])
