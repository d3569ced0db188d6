"""Helpers shared by the training-data operators: written intermediate tables, bounded Arrow batches, packed integers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes that a Python worker handles at a time. Spark bounds what it sends at once by bytes (64 MB by default); what
#: a worker makes of texts is several times as large, so it takes slices.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or a temporary one where that is unset (tests in local mode)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("ledgerloom.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("ledgerloom.shared.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/ledgerloom/{label}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for one job; it is put back afterwards, whatever happens."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, label: str, held: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut and a lost executor loses nothing. While it is written,
    Spark sends Python workers little at a time. The path is added to `held`; see discard."""
    path = scratch_path(df.sparkSession, label)
    with setting(df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES)):
        df.write.parquet(path)
    if held is not None:
        held.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, held: list[str]) -> None:
    """Deletes written tables and empties the list. Only for tables of which nothing is read any more: those whose result is
    itself written. Shuffle files of finished jobs go too: Spark deletes them once the driver's collector has seen that nobody
    uses them, which may be long after."""
    for path in held:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    held.clear()
    gc.collect()
    spark._jvm.System.gc()


def slices(batches, rows: int = SLICE_ROWS, size: int = SLICE_BYTES):
    """Arrow batches cut to at most `rows` rows and about `size` bytes (one row at least), without copying. An operator's memory so
    depends on no setting of the session, and it leaves all of them as they were."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def runs(texts: pa.Array, size: int = SLICE_BYTES):
    """Consecutive parts of an Arrow array of texts as lists of at most SLICE_ROWS texts and about `size` bytes on average."""
    step = max(1, min(SLICE_ROWS, len(texts) * size // max(texts.nbytes, 1)))
    for at in range(0, len(texts), step):
        yield texts.slice(at, step).to_pylist()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, one for each wanted name."""
    out = []
    taken = {c.lower() for c in df.columns}
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def crc_bucket(id_col: str, n: int):
    """crc32 of the id as text, modulo n (null id: the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))
