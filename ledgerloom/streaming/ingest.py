"""Structured Streaming ingestion: payload files as they arrive, through the same scans as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import normalize_cik
from ledgerloom.sources.payloads import scan_company_facts, scan_historical_submissions, scan_submissions


def stream_company_facts(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Facts of company payload files that arrive in a folder, one row per fact."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path, wholetext=True)
    return scan_company_facts(raw.select(F.col("value").alias("payload")))


def append_facts(facts: DataFrame, path: str, checkpoint: str):
    """Appends a stream of facts to a dataset, exactly once; ends when what has arrived is done."""
    return facts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_filings(spark: SparkSession, submissions: str, history: str, files_per_trigger: int = 1000) -> DataFrame:
    """Filings of submission and history payload files as they arrive, in any order: one row per accession, in update mode.

    What is kept of an accession is the row that the batch merge takes: of the recent list first, then by filing date and company. The
    state is one row for each accession, under the query's checkpoint; a later row only changes it if it comes first in that order.
    History files carry their company in their name (CIK<number>...).
    """
    read = lambda path: spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path, wholetext=True).select(F.col("value").alias("payload"), normalize_cik(F.regexp_extract("_metadata.file_name", "CIK0*([0-9]+)", 1)).alias("cik"))
    recent = scan_submissions(read(submissions)).withColumn("source_priority", F.lit(0))
    older = scan_historical_submissions(read(history)).withColumn("source_priority", F.lit(1))
    both = recent.unionByName(older).where("status = 'ok' and accession is not null").drop("status")
    both = both.withColumn("cik", F.nullif("cik", F.lit("")))  # nullable in every batch, also in one of one kind of files only: the state's schema stays
    columns = [c for c in both.columns if c not in ("accession", "source_priority")]
    first = F.min_by(F.struct(*columns), F.struct("source_priority", "filing_date", "cik"))
    return both.groupBy("accession").agg(first.alias("f")).select("accession", "f.*")


def write_filings(filings: DataFrame, path: str, checkpoint: str):
    """Appends each batch's changed filings with the batch's number; a batch that is run again replaces its own rows. Ends when what
    has arrived is done. See current_filings."""
    def put(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return filings.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_filings(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each filing that write_filings has written."""
    changes = spark.read.parquet(path)
    columns = [c for c in changes.columns if c not in ("accession", "batch")]
    return changes.groupBy("accession").agg(F.max_by(F.struct(*columns), "batch").alias("f")).select("accession", "f.*")
