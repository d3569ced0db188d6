"""The corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, packing.

Each stage works on all that the one before it kept, which is written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontam, langid, linededup, packing, simhash
from ledgerloom.llm._common import SLICE_BYTES, materialize, setting, table


def _send_little(spark: SparkSession) -> None:
    """The pipeline's own setting for its session: at most 4 MB at once to a Python worker, unless the caller chose a size. Its
    stages return plans that run after they are made, so they can't put a setting back; operators by themselves set nothing."""
    key, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(key) == default:
        spark.conf.set(key, str(SLICE_BYTES))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the model knows (op 10); the model learns from the folds that are not held out."""
    _send_little(spark)
    model = langid.fit(langid.learnable(docs))
    pa.default_memory_pool().release_unused()  # the sample's n-gram counts, which the driver would hold on to through all later stages
    return langid.accepted(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of recurring templates (op 7) and documents that consist of such lines alone."""
    return linededup.without_recurring_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each class of near copies (op 8): five-word shingles, similarity of 0.8 or more.
    Then drops long lines that another kept document holds (op 7): not before, as a near copy would lose what shows it is one.
    Its many jobs join by shuffles only: each small side would else be built into a hash table in the driver."""
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        first = simhash.first_copies(docs)
    return linededup.without_repeated_passages(docs, among=first)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark (op 1)."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of 2048 tokens (op 3)."""
    _send_little(spark)
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padding")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: A trained model and tokenizer files aren't SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
