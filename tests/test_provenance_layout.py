"""Provenance laid out for lookups: few files read, nothing lost."""

from pyspark.sql import functions as F

from ledgerloom.operators import report

METRICS = 60


def records(spark):
    """A third of 24,000 records is of metric m0; 20 have no metric."""
    metric = F.when(F.col("id") < 20, F.lit(None)).when(F.col("id") % 3 == 0, F.lit("m0")).otherwise(F.concat(F.lit("m"), F.col("id") % METRICS))
    return spark.range(24_000).select(F.lpad((F.col("id") * 7 % 997).cast("string"), 10, "0").alias("cik"), metric.alias("metric_id"), F.concat(F.lit("20"), F.lpad((F.col("id") % 24).cast("string"), 2, "0")).alias("period_key"), F.col("id").cast("double").alias("amount"))


def scan(df):
    """Files and rows that the collected plan's only scan has read."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    assert leaves.size() == 1
    metrics = leaves.apply(0).metrics()
    return [metrics.get(n).get().value() for n in ("numFiles", "numOutputRows")]


def test_a_lookup_opens_files_of_its_metric(spark, tmp_path):
    given = records(spark)
    table = report.write_provenance(given, str(tmp_path / "p"), rows_per_file=500)
    assert table.dtypes == given.dtypes
    assert sorted(map(str, table.collect())) == sorted(map(str, given.collect()))
    files = len(table.inputFiles())
    assert files > METRICS / 2
    one = report.provenance_lookup(table, "m7")
    assert sorted(r.amount for r in one.collect()) == [r.amount for r in given.where("metric_id = 'm7'").orderBy("amount").collect()]
    opened, rows = scan(one)
    assert opened * 10 < files and rows == 399  # 7 itself is among the 20 without a metric
    narrow = report.provenance_lookup(table, "m7", "2007", "0000000049")
    assert [r.amount for r in narrow.collect()] == [r.amount for r in given.where("metric_id = 'm7' and period_key = '2007' and cik = '0000000049'").collect()]
    assert table.where("metric_id is null").count() == 20


def test_a_frequent_metric_is_many_files_of_consecutive_companies(spark, tmp_path):
    table = report.write_provenance(records(spark), str(tmp_path / "p"), rows_per_file=500)
    hot = report.provenance_lookup(table, "m0").groupBy(F.input_file_name().alias("file")).agg(F.min("cik").alias("low"), F.max("cik").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("low", "high").collect()
    assert len(hot) >= 16 and max(r.n for r in hot) <= 500
    assert all(a.high <= b.low for a, b in zip(hot, hot[1:], strict=False))


def test_empty_records_and_a_second_write(spark, tmp_path):
    path = str(tmp_path / "p")
    report.write_provenance(records(spark), path)
    assert report.write_provenance(records(spark).where("false"), path).count() == 0
