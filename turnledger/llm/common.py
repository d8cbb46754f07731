"""What several operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnledger.storage import shared_dir, staging_path

# Rows of documents that a Python worker holds at a time. The session's default suits
# narrow rows; a batch of that many very long texts would not fit a worker.
BATCH_ROWS = 1000

WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches, unless the session already asks for small ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of the value as text, modulo `folds`; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def map_batches(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def keep(df: DataFrame) -> DataFrame:
    """The rows written once to the folder that all executors share, lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a staged table, whose size the planner knows when it picks a join."""
    path = staging_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffles, broadcasts and checkpoints that nothing refers to any
    more. It learns of them when the driver collects garbage, which it does by itself
    every 30 minutes only; an operator of many small jobs has gone through a lot by then."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
