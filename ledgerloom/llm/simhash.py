"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint's ball of radius r/2 holds every value that differs in at most r/2 bits. Two fingerprints within r bits have
such a value in common, so emitting the ball and grouping on its members finds every pair; for r = 2 that is 65 rows for
each different fingerprint, and a group can't hold more than 65 of them however large the input is.

near_duplicates links whole-document fingerprints and nothing else. Texts whose five-word shingles agree to 0.8 often differ in
three to eleven bits of a whole-document fingerprint, out of reach of any ball that can be emitted. near_copies therefore joins
fingerprints within balls first, and finds all other pairs of enough similarity by ledgerloom.llm.jaccard; all are verified.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm._common import fresh, materialize, slices
from ledgerloom.llm.components import components
from ledgerloom.llm.jaccard import classes, shingle_hashes, shingle_set

__all__ = ["close_pairs", "fingerprint", "fingerprints", "first_copies", "keep_first", "keep_first_copies", "near_copies", "near_duplicates", "shingle_set"]

BITS = 64
def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of 64-bit hashes; 0 for none."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 65536):  # unpacked bits take 64 bytes a shingle
        ones += np.unpackbits(h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a text over word shingles; 0 for a text without words."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id_col, fp bigint): one row per input row; the signed reading of the 64 bits. A null text counts as one without words."""
    def run(batches):
        for batch in slices(batches):
            fps = np.array([fingerprint(x, shingle, seed) for x in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    out = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("fp", T.LongType())])
    return source.mapInArrow(run, out).withColumnRenamed("id", id_col)


def ball_masks(radius: int) -> list[int]:
    """All 64-bit masks with at most radius bits set, as signed integers."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(BITS), k)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]


def close_pairs(fps: DataFrame, fp_col: str = "fp", distance: int = 2) -> DataFrame:
    """(src, dst) links between different fingerprints, enough of them that every pair within `distance` bits is connected.

    For distance 2 each group on a ball member is a set whose members all lie within 2 bits of one another, so neighbours in
    sorted order are links and connect the whole group. For other even distances all pairs of a group are verified.
    """
    if distance % 2:
        raise ValueError("distance must be even: each side emits the variants within half of it")
    each = fps.select(F.col(fp_col).alias("fp")).where("fp is not null").distinct()
    variants = each.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in ball_masks(distance // 2)])).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    if distance == 2:
        pairs = variants.select(F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")).alias("src"), F.col("fp").alias("dst")).where("src is not null")
    else:
        pairs = variants.alias("x").join(variants.alias("y"), F.expr("x.variant = y.variant and x.fp < y.fp")).select(F.col("x.fp").alias("src"), F.col("y.fp").alias("dst"))
    return pairs.distinct().where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= distance)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, distance: int = 2) -> DataFrame:
    """One row per input row: id_col, fp bigint, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Links join fingerprints within `distance` bits; equal fingerprints are collapsed before the ball is emitted, so a group of
    a million copies costs as much as one document. Texts that are null, empty or blank share fingerprint 0. Rows with a null
    id get the class of their fingerprint; a class without any id has a null component_id. Repeated rows stay repeated. Other
    columns of docs are not read.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    least = materialize(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
    labels = components(close_pairs(least, "fp", distance))
    owned = least.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    by_label = owned.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = owned.join(by_label, "label").select("fp", "component_id")
    return marked.join(classes, "fp").select(id_col, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def ball_pairs(reps: DataFrame) -> DataFrame:
    """(a, b): nodes of reps(node, mark, ..) whose fingerprints (mark) are equal or in one another's ball, once for each fingerprint."""
    of_fp = reps.groupBy(F.col("mark").alias("fp")).agg(F.min("node").alias("head"))
    balls = close_pairs(of_fp).join(of_fp.select(F.col("fp").alias("src"), F.col("head").alias("a")), "src").join(of_fp.select(F.col("fp").alias("dst"), F.col("head").alias("b")), "dst").select("a", "b")
    return balls.unionByName(reps.select(F.col("mark").alias("fp"), F.col("node").alias("b")).join(of_fp, "fp").select(F.col("head").alias("a"), "b"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id_col, component_id, text_hash): classes of rows whose shingle sets have a Jaccard similarity of at least `similarity`, closed
    over links; component_id is the smallest id of the class, text_hash Spark's xxhash64 of the row's text.

    All texts without words are one class. Null ids take part in no link: each such row has component_id null. Rows that share an
    id are judged each by its own text. Other columns are not read.
    """
    known = docs.where(F.col(id_col).isNotNull())
    found = classes(known, id_col, text_col, shingle, similarity, blank_linked=True, of_hashes=majority, more_pairs=ball_pairs).drop("n_shingles")
    none = docs.where(F.col(id_col).isNull()).select(id_col, F.lit(None).cast(docs.schema[id_col].dataType).alias("component_id"), F.xxhash64(text_col).alias("text_hash"))
    return found.unionByName(none)


def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id_col, text_hash) of the rows that have the smallest id of their class of near_copies or no id, each once."""
    first = near_copies(docs, id_col, text_col, **how).where(F.col(id_col).eqNullSafe(F.col("component_id")))
    return first.select(id_col, "text_hash").distinct()


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that are among first_copies; columns as in docs."""
    key, of_text = fresh(docs, "near_id", "near_hash")
    first = first_copies(docs, id_col, text_col, **how).select(F.col(id_col).alias(key), F.col("text_hash").alias(of_text))
    return docs.join(first, docs[id_col].eqNullSafe(first[key]) & (F.xxhash64(docs[text_col]) == first[of_text]), "left_semi")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs whose id is the smallest of its class; columns as in docs.

    A row with a null id is kept only if its class has no id at all. Repeated rows of the kept id all stay.
    """
    key, kept = fresh(docs, "near_id", "near_of")
    classes = near_duplicates(docs, id_col, text_col, **how).select(F.col(id_col).alias(key), F.col("component_id").alias(kept)).where(F.expr(f"{key} <=> {kept}")).select(key).distinct()
    return docs.join(classes, docs[id_col].eqNullSafe(classes[key]), "left_semi")
