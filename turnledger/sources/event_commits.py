"""Daily indices that are filled commit by commit, and the manifest of what they hold.

Layout: `<root>/index_prefix=<prefix>/index_date=<yyyy.MM.dd>/commit=<id>/*.parquet` and
`<root>/_manifest/<id>/`, the entry of a commit: a row per prefix and day with the number
of documents and their first and last time. Documents count as stored once the entry is
there, which is a single small file. Until then readers do not see them and the commit may
be repeated; after that, repeating it does nothing. A prefix is filled either by commits or
by `event_store.append`, not by both.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from turnledger.sources.event_store import DAY_FORMAT, UNKNOWN_DAY, kept_from
from turnledger.storage import names_in

ENTRY = "commit string, index_prefix string, index_date string, docs long, first_time timestamp, last_time timestamp"


def _entry(root: str, commit_id: str) -> str:
    return f"{root.rstrip('/')}/_manifest/{commit_id}"


def is_committed(spark: SparkSession, root: str, commit_id: str) -> bool:
    return any(n.startswith("part-") for n in names_in(spark, _entry(root, commit_id)))


def commit(docs: DataFrame, root: str, commit_id: str, ts: str = "@timestamp") -> None:
    """Store documents with `index_prefix` and `index_date` as one commit.

    The input is read once and kept until its entry is written. The rebalance brings the
    rows of one index together: a file per index, or more where an index is large. No
    documents make no entry. An id names its commit for good; a repeated attempt has to
    bring the same documents.
    """
    spark, root = docs.sparkSession, root.rstrip("/")
    if is_committed(spark, root, commit_id):
        return
    stored = docs.withColumns({
        "index_date": F.coalesce("index_date", F.lit(UNKNOWN_DAY)), "commit": F.lit(commit_id),
    })
    stored.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # Folders that an attempt without an entry has left are replaced.
        (
            stored.hint("rebalance", "index_prefix", "index_date")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("index_prefix", "index_date", "commit").parquet(root)
        )
        entry = stored.groupBy("commit", "index_prefix", "index_date").agg(
            F.count("*").alias("docs"),
            F.min(F.col(f"`{ts}`")).cast("timestamp").alias("first_time"),
            F.max(F.col(f"`{ts}`")).cast("timestamp").alias("last_time"),
        )
        entry.coalesce(1).write.mode("overwrite").parquet(_entry(root, commit_id))
    finally:
        stored.unpersist()


def manifest(spark: SparkSession, root: str, *prefixes: str) -> DataFrame:
    """The entries of all commits, for all prefixes or the given ones, without expired days.

    Counts, days and bounds come from it without opening a document. It has a row per
    commit, prefix and day.
    """
    path = f"{root.rstrip('/')}/_manifest"
    names = names_in(spark, path)
    if not names:
        return spark.createDataFrame([], ENTRY)
    entries = spark.read.schema(ENTRY).option("recursiveFileLookup", True).parquet(path)
    if prefixes:
        entries = entries.filter(F.col("index_prefix").isin(*prefixes))
    for folder in names_in(spark, f"{root.rstrip('/')}/_retention"):
        prefix = folder.removeprefix("index_prefix=")
        first = kept_from(spark, root, prefix)
        if first is not None:
            entries = entries.filter((F.col("index_prefix") != prefix) | (F.col("index_date") >= first))
    return entries


def docs_per_day(entries: DataFrame) -> DataFrame:
    """(index_prefix, index_date, docs, first_time, last_time) from a manifest."""
    return entries.groupBy("index_prefix", "index_date").agg(
        F.sum("docs").alias("docs"), F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time")
    )


def read_committed(spark: SparkSession, root: str, *prefixes: str, first_day: str | None = None,
                   last_day: str | None = None, schema: StructType | None = None) -> DataFrame:
    """The committed documents of one or several prefixes, in a range of days (`yyyy.MM.dd`).

    The manifest names the days, so that only folders of the range are listed, and the
    commits: what an attempt without an entry has left is not read. Without a schema the
    fields of all files are merged. Nothing stored: an empty frame of the schema.
    """
    entries = manifest(spark, root, *prefixes)
    if first_day is not None:
        entries = entries.filter(F.col("index_date") >= first_day)
    if last_day is not None:
        entries = entries.filter(F.col("index_date") <= last_day)
    # A row per prefix and day: as many as there are folders to name.
    found = sorted(tuple(r) for r in entries.select("index_prefix", "index_date").distinct().collect())
    index = [StructField(c, StringType()) for c in ("index_prefix", "index_date", "commit")]
    if not found:
        return spark.createDataFrame([], StructType([*(schema.fields if schema else []), *index]))
    reader = spark.read.option("basePath", root)
    if schema is None:
        reader = reader.option("mergeSchema", True)
    else:
        reader = reader.schema(StructType([*schema.fields, *index]))
    docs = reader.parquet(*[f"{root.rstrip('/')}/index_prefix={p}/index_date={d}" for p, d in found])
    return docs.join(entries, ["index_prefix", "index_date", "commit"], "left_semi")


def last_days(spark: SparkSession, root: str, prefix: str, days: int,
              schema: StructType | None = None) -> DataFrame:
    """Committed documents whose time is at most `days` days before the latest one, which
    the manifest tells; only folders of these days are listed and read."""
    since = F.max("last_time") - F.expr(f"INTERVAL {int(days)} DAYS")
    first = manifest(spark, root, prefix).agg(
        F.unix_micros(since).alias("micros"),
        F.date_format(F.convert_timezone(None, F.lit("UTC"), since), DAY_FORMAT).alias("day"),
    ).first()
    docs = read_committed(spark, root, prefix, first_day=first.day, schema=schema)
    if first.micros is None:
        return docs
    return docs.filter(F.col("`@timestamp`") >= F.timestamp_micros(F.lit(first.micros)))
