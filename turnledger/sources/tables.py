"""Table files: processed turns, statistics, reports, CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

# Rows per output file. Tasks write their own files, without a shuffle and without
# narrowing the stage before to a few tasks.
MAX_ROWS_PER_FILE = 5_000_000


def write_parquet(df: DataFrame, path: str, max_rows_per_file: int = MAX_ROWS_PER_FILE) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", max_rows_per_file).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer splits than the session has cores, on all of them.

    Worth its shuffle before expensive text expressions over a few files. Inputs with
    enough splits, which is every large one, are returned as they are. Only for plain
    scans: the number of splits is read off the plan.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def write_json(df: DataFrame, path: str) -> None:
    """Small result tables such as statistics; null fields are kept as nulls."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, as reports show them."""
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header line. Give the schema for large inputs: without one the
    files are read twice, the first time to infer the types."""
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)
