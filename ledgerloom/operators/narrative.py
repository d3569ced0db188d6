"""Prose: sections under headings, and what they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as X

DISCUSSION = ("management s discussion", "management discussion", "item 7 management", "item 2 management", "discussion and analysis of financial condition")
FOOTNOTE = ("footnote", "notes to financial statements", "notes to consolidated financial statements")


def is_discussion(n: Column) -> Column:
    return X.has_any(n, *DISCUSSION)


def is_footnote(n: Column) -> Column:
    return n.startswith("note ") | X.has_any(n, *FOOTNOTE)


def is_heading(tag: Column, text: Column) -> Column:
    n = X.normalize_label(text)
    item = n.startswith("item 7 ") | n.startswith("item 8 ") | n.startswith("item 2 ")
    return tag.rlike("^h[1-6]$") | ((F.length(n) <= 180) & (is_discussion(n) | is_footnote(n) | item))


def sections(blocks: DataFrame, key: str = "accession") -> DataFrame:
    """Headings with the blocks up to the next, joined by an empty line; sections without content are dropped."""
    full = blocks.where("trim(text) <> ''").withColumn("heading", is_heading(F.col("tag"), F.col("text")))
    w = Window.partitionBy(key).orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = full.withColumn("section_no", F.sum(F.col("heading").cast("int")).over(w)).where("section_no > 0")
    body = F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("block_no", "text"))))
    out = numbered.groupBy(key, "section_no").agg(F.max(F.when(F.col("heading"), F.col("text"))).alias("title"), F.array_join(F.transform(body, lambda b: b["text"]), "\n\n").alias("content"))
    return out.where("content <> ''").withColumn("section_no", F.col("section_no").cast("int"))


def classify_sections(found: DataFrame) -> DataFrame:
    """metric_id by title: discussion first, then footnotes; others are dropped."""
    n = X.normalize_label(F.col("title"))
    metric = F.when(is_discussion(n), "mda.management_discussion_text").when(is_footnote(n), "footnotes.disclosure_text")
    return found.withColumn("metric_id", metric).where("metric_id is not null")


def narrative_metrics(classified: DataFrame, most_bytes: int = 32_767) -> DataFrame:
    return classified.withColumn("content", X.truncate_bytes(F.col("content"), most_bytes))
