"""Structured facts: match facts to filings, rank them, fall back over tags, and shape them as candidate values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.functions.registry import known_tags, metric_tags


def fact_match_score(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """Facts with the filings they may belong to. score: 0 own accession, 1 same form, 2 an instant, each for the filing's report
    date; 3 own accession where the filing has no report date.

    Both sides are dealt by company once, each company's filings as one row of lists by report date and by accession, which its
    facts look up: one equi-join, after which windows over companies need no shuffle.
    """
    f = facts.where("period_end is not null and val is not null").repartition("cik")
    keys = filings.select(F.col("cik").alias("f_cik"), "accession", "form_type", F.col("period_end").alias("report_end")).repartition("f_cik")
    dated = F.col("report_end").isNotNull()
    lists = keys.groupBy("f_cik", "report_end", F.when(~dated, F.col("accession")).alias("own")).agg(F.collect_list(F.struct("accession", "form_type", dated.alias("dated"))).alias("l"))
    by = lambda key: F.map_from_entries(F.collect_list(F.when(F.col(key).isNotNull(), F.struct(key, "l"))))
    companies = lists.groupBy("f_cik").agg(by("report_end").alias("_dates"), by("own").alias("_accessions"))
    met = f.join(companies, F.col("cik") == F.col("f_cik"))
    met = met.withColumns({"_dated": F.try_element_at("_dates", F.col("period_end")), "_own": F.try_element_at("_accessions", F.col("accn"))})
    found = F.when(F.col("_own").isNull(), F.col("_dated")).when(F.col("_dated").isNull(), F.col("_own")).otherwise(F.concat("_dated", "_own"))
    each = met.withColumn("_f", F.explode(found))
    score = F.when(~F.col("_f.dated"), 3).when(F.col("accn") == F.col("_f.accession"), 0).when(F.col("form") == F.col("_f.form_type"), 1).when(F.col("period_start").isNull(), 2)
    scored = each.withColumns({"score": score, "accession": F.col("_f.accession"), "form_type": F.col("_f.form_type")}).where("score is not null")
    return scored.select(*facts.columns, "accession", "form_type", "score")


def segment_of_fact() -> Column:
    return F.coalesce(X.segment_from_frame(F.col("frame")), "frame", F.lit("__default__"))


def best_facts(scored: DataFrame, by_segment: bool = False, match_order: str = "as_coded") -> DataFrame:
    """The best fact for each filing, metric, tag, taxonomy and unit (and segment; with a segment_key given, that). match_order
    'as_coded' prefers the highest score, 'exact_first' the lowest."""
    best = F.desc("score") if match_order == "as_coded" else F.asc("score")
    key = ["cik", "accession", "metric_id", "tag", "taxonomy", "unit"]
    if by_segment:
        scored = scored if "segment_key" in scored.columns else scored.withColumn("segment_key", segment_of_fact())
        key.append("segment_key")
    w = Window.partitionBy(*key).orderBy(best, F.desc_nulls_last("filed"), F.desc_nulls_last("period_end"), "accn", "pos")
    return scored.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def tag_fallback(found: DataFrame) -> DataFrame:
    """Of each filing's metric the first tag that matched, and of that the first taxonomy."""
    first = F.min(F.struct("tag_priority", F.col("taxonomy").isNull().alias("no_taxonomy"), "taxonomy")).over(Window.partitionBy("cik", "accession", "metric_id"))
    return found.withColumn("_first", first).where("tag_priority = _first.tag_priority and taxonomy = _first.taxonomy").drop("_first")


def extract_facts(facts: DataFrame, filings: DataFrame, match_order: str = "as_coded", metrics: list[str] | None = None) -> DataFrame:
    """Candidate values of all registry metrics, or of those given, for all filings. Facts are narrowed to known tags before they meet filings; the
    registry's tags are a fixed small table, broadcast to the matches, so that no shuffle carries what it says of them. Segment
    metrics are ranked by segment, others as a whole, in one pass."""
    tags = metric_tags(facts.sparkSession).select(F.lower("tag").alias("known_tag"), "metric_id", "metric_name", "domain", "subdomain", "tag_priority")
    tags = tags if metrics is None else tags.where(F.col("metric_id").isin(metrics))
    known = facts.where(F.lower("tag").isin(sorted({t.lower() for t in known_tags(metrics)})))
    scored = fact_match_score(known, filings).join(F.broadcast(tags), F.lower("tag") == F.col("known_tag")).drop("known_tag")
    scored = scored.withColumn("segment_key", F.when(F.col("domain") == "segment_data", segment_of_fact()))
    return as_candidates(tag_fallback(best_facts(scored, by_segment=True, match_order=match_order)))


def as_candidates(found: DataFrame) -> DataFrame:
    segment = F.when(F.col("domain") == "segment_data", X.segment_from_frame(F.col("frame")))
    return found.select(
        "cik", "metric_id", "metric_name", "domain", "subdomain",
        F.lit("xbrl").alias("source"), "accession", "form_type", "period_start", "period_end",
        X.period_key(F.col("period_start"), F.col("period_end")).alias("period_key"),
        F.col("fp").alias("period_label"),
        F.col("fy").alias("fiscal_year"),
        X.fact_fiscal_quarter(F.col("fp")).alias("fiscal_quarter"),
        segment.alias("segment_name"),
        F.col("val").alias("amount"),
        X.fact_unit_kind(F.col("unit")).alias("unit_kind"),
        F.col("unit").alias("unit_code"),
        F.lit("raw").alias("scale"),
        F.col("tag").alias("xbrl_tag"),
        "score",
        F.concat_ws("/", F.col("accn"), F.lpad(F.col("pos").cast("string"), 6, "0")).alias("pos"),
    )
