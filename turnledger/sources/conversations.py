"""Conversation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from turnledger.schemas import CONVERSATION
from turnledger.sources.json_array import array_elements


def read_jsonl(spark: SparkSession, path: str, schema: StructType = CONVERSATION) -> DataFrame:
    """One conversation per line. Files are split at line ends, so one large file is
    read by many tasks; the declared schema saves the inference pass."""
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str,
                    schema: StructType = CONVERSATION) -> DataFrame:
    """Files that each hold one JSON array, split between tasks by `array_elements`."""
    elements = array_elements(spark, path)
    return elements.select(F.from_json("value", schema).alias("d")).select("d.*")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return fs.exists(hadoop_path)


def read_conversations(spark: SparkSession, json_path: str,
                       schema: StructType = CONVERSATION) -> DataFrame:
    """The `.jsonl` sibling of a JSON array file if there is one, else the array. A path
    that ends with `.jsonl` is read as lines."""
    if json_path.rstrip("/").endswith(".jsonl"):
        return read_jsonl(spark, json_path, schema)
    sibling = json_path.removesuffix(".json") + ".jsonl"
    if _exists(spark, sibling):
        return read_jsonl(spark, sibling, schema)
    return read_json_array(spark, json_path, schema)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per row and line; null fields are written as nulls."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def json_array_to_jsonl(spark: SparkSession, source: str, target: str,
                        limit: int | None = None) -> int:
    """Rewrite JSON array files as JSON lines; returns the number of records.

    Whatever fields the records have are kept. Large files are split between tasks.
    `limit` takes the first records only, for trial runs.
    """
    records = array_elements(spark, source)
    if limit is not None:
        records = records.orderBy("file", "element").limit(limit)
    written = Observation()
    (
        records.select("value")
        .observe(written, F.count(F.lit(1)).alias("records"))
        .write.mode("overwrite")
        .text(target)
    )
    return int(written.get["records"])
