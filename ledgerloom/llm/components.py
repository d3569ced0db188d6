"""Connected components of a link table by hash-to-min labels with pointer jumping, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._common import discard, materialize


def components(links: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, label): label is the smallest node reachable from node. Nodes are whatever stands in links.

    Null ends and self links are ignored; repeated and reversed links count once. An empty link table gives an empty result.
    Each round takes the least label among a node and its neighbours and then the label of that label, so the number of
    rounds grows with the logarithm of the longest path. Rounds are written to the shared folder; nothing reaches the driver
    but one boolean. The neighbour minimum is pre-aggregated before its shuffle; a label that many nodes share only meets a
    sort-merge join, which adaptive execution splits. Each round's table is deleted when the next one is written.
    """
    pairs = links.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    both = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    spark, held, older = links.sparkSession, [], []
    both = materialize(both.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*"), "links", held)
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label"), F.lit(True).alias("moved")), "labels", older)
    for _ in range(max_rounds):
        if labels.where("moved").isEmpty():
            discard(spark, held)
            return labels.select("node", "label")
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        step = labels.select("node", "label").join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        over = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        newer: list[str] = []
        labels = materialize(step.join(over, "label").select("node", F.least("label", "far").alias("label"), (F.least("label", "far") < F.col("old")).alias("moved")), "labels", newer)
        discard(spark, older)
        older = newer
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
