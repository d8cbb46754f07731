"""Live event feed: JSON lines in, daily indices out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from turnledger.schemas import EVENT_LINE
from turnledger.sources.event_commits import commit
from turnledger.sources.event_store import CORRUPT_PREFIX, event_time, index_day, parse_lines

AT = "@timestamp"


def read_event_lines(spark: SparkSession, path: str, schema: StructType = EVENT_LINE,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the JSON-lines files that arrive in a folder.

    Beside the columns of the schema: `@timestamp` as text, `fields` with all other fields
    of the line (nested ones as JSON text), and `_corrupt_record`, the text of a line that
    does not fit, else null. Blank lines are skipped.
    """
    reader = spark.readStream
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.text(path).filter(F.trim("value") != "")
    full = schema if AT in schema.names else StructType([*schema.fields, StructField(AT, StringType())])
    known = F.array(*[F.lit(n) for n in full.names])
    every = F.from_json("value", "map<string,string>")
    others = F.map_filter(every, lambda name, _: ~F.array_contains(known, name))
    return parse_lines(lines, full, others={"fields": others})


def to_documents(lines: DataFrame, tag: str = "turnledger") -> DataFrame:
    """`@timestamp` from the ISO 8601 field `timestamp`, else from the line's own
    `@timestamp`, or the time of arrival where both are missing or unreadable; the tag
    and the day of the index are added."""
    given = [event_time(c) for c in ("timestamp", AT) if c in lines.columns]
    stamped = lines.withColumn(AT, F.coalesce(*given, F.current_timestamp()))
    return stamped.withColumns({"pipeline": F.lit(tag), "index_date": index_day(stamped, AT)})


def well_formed(docs: DataFrame) -> DataFrame:
    return docs.filter("_corrupt_record IS NULL").drop("_corrupt_record")


def malformed(docs: DataFrame) -> DataFrame:
    """Lines that do not fit, with their text: for an ingest of their own, under the
    prefix `event_store.CORRUPT_PREFIX`."""
    return docs.filter("_corrupt_record IS NOT NULL").select(
        "_corrupt_record", AT, "pipeline", "index_date"
    )


def start_ingest(docs: DataFrame, root: str, checkpoint: str, index_prefix: str = "logs",
                 **trigger) -> StreamingQuery:
    """Append the documents to the daily indices of a prefix of the event table.

    Exactly once with this checkpoint: the folder of the prefix keeps the log of the
    committed files, which `event_store.read_index` follows. It belongs to the stream,
    so batch jobs append to other prefixes. `trigger` goes to
    `DataStreamWriter.trigger`, e.g. `availableNow=True`.
    """
    return (
        docs.writeStream.format("parquet")
        .partitionBy("index_date")
        .option("path", f"{root.rstrip('/')}/index_prefix={index_prefix}")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def start_line_ingest(docs: DataFrame, root: str, checkpoint: str, index_prefix: str = "logs",
                      name: str | None = None, **trigger) -> StreamingQuery:
    """Store good lines under `index_prefix` and lines that do not fit under
    `event_store.CORRUPT_PREFIX`, from one read of the feed.

    Every trigger is one commit of `event_commits`: its lines are brought together by day,
    readers (`event_commits.read_committed`) see all of them or none, and a trigger that is
    repeated after a failure stores nothing twice. Commits are named by `name`, the prefix
    if not given, and the number of the trigger: no two streams into one table may have the
    same name. Times of arrival are those of the trigger, so a repetition brings the same
    rows.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        prefix = F.when(F.col("_corrupt_record").isNotNull(), CORRUPT_PREFIX).otherwise(index_prefix)
        commit(batch.withColumn("index_prefix", prefix), root, f"{name or index_prefix}-{batch_id}", AT)

    return (
        docs.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )
