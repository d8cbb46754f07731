"""From raw documents to packed token rows, in five stages.

Each stage reads what the one before it has written and returns the columns of documents;
the last returns the rows of the packed id matrix. SQL cannot express the classifier, so
there is no ORACLE_SQL; tests compare stage by stage with brute force.

All stages take nulls in any column, empty and very long texts, repeated rows, columns
beside those of documents (whatever their names) and an empty table, which gives an empty
table. Each stage says what it does with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnledger.llm import curriculum, decontaminate, packing, quality, simhash
from turnledger.llm.common import table
from turnledger.storage import staging_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Null texts score like empty
    ones; a row without doc_id is scored like any other; repeated rows score alike."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


# Share of common five-word shingles from which two documents are near duplicates.
SIMILARITY = 0.8


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id, of
    rows with one doc_id the smallest row. Null, empty and blank texts are one group; a
    group without any doc_id keeps one row."""
    return simhash.keep_first(docs, similarity=SIMILARITY)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; repeated rows
    stay or go together."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order. Documents without words
    have size 0; rows without source are a source of their own; repeated rows count each."""
    return curriculum.curriculum(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of token ids, pool by pool in training order. A null or empty text is the end
    token alone; a text longer than a row continues in further rows."""
    return packing.pack(curriculum.as_written(docs))


STAGES = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("mixing to target weights", mixed),
    ("token-id output", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = staging_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
