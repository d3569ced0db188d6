"""Written intermediate tables: results that several operators read are computed once."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


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


def written(df: DataFrame, label: str, by: list[str] | None = None, held: list[str] | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, in a folder for each value of `by`; a lost executor loses nothing of it. The path
    is added to `held`; see discard."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").partitionBy(*by or []).parquet(path)
    if held is not None:
        held.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(spark: SparkSession, held: list[str]) -> None:
    """Deletes written tables of which nothing is read any more, and empties the list."""
    for path in held:
        delete(spark, path)
    held.clear()


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings (dots as double underscores) for the jobs within; they are put back afterwards, whatever happens."""
    keys = {name.replace("__", "."): value for name, value in values.items()}
    before = {key: spark.conf.get(key) for key in keys}
    try:
        for key, value in keys.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
