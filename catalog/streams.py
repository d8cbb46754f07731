"""Streaming operators, run over everything that is there and then stopped."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from catalog import inputs as I
from catalog.prompts import SQL_REQUEST_COST
from catalog.registry import query
from turnledger.operators import events as ev
from turnledger.sources import event_commits as commits, event_store as store
from turnledger.streaming import histogram, ingest, prompts as prompt_stream
from turnledger.storage import staging_path


def _finish(stream: StreamingQuery) -> None:
    stream.awaitTermination()


def _table_stream(spark: SparkSession, sf: str, name: str):
    """A table as a stream of its Parquet files, be it one file or a folder of files.

    A stream takes a plain path for a folder; a pattern, here of one name, may be either.
    """
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


@query("stream_event_ingest", """SELECT 'logs-' || strftime(ts, '%Y.%m.%d') AS index_name, event_type, count(*) AS docs,
  CAST(max(epoch_us(ts)) AS BIGINT) AS last_us FROM events GROUP BY 1, 2""")
def stream_event_ingest(spark, sf):
    feed, out = staging_path(spark, "feed"), staging_path(spark, "ingested")
    lines = I.table(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        "event_id", "event_type", "value",
    )
    lines.write.json(feed)
    docs = ingest.to_documents(ingest.read_event_lines(spark, feed))
    _finish(ingest.start_ingest(docs, f"{out}/table", f"{out}/checkpoint", availableNow=True))
    stored = store.read_index(spark, f"{out}/table", "logs")
    return stored.groupBy(
        F.concat_ws("-", "index_prefix", "index_date").alias("index_name"), "event_type"
    ).agg(F.count("*").alias("docs"), F.unix_micros(F.max("@timestamp")).alias("last_us"))


@query("stream_event_lines", """WITH d AS (
  SELECT CASE WHEN event_id % 40 = 0 THEN 'corrupt' ELSE 'logs' END AS index_prefix, * FROM events)
SELECT index_prefix, count(*) AS docs, CAST(sum(CASE WHEN index_prefix = 'logs' THEN length(props) ELSE 12 END) AS BIGINT) AS chars,
  CASE WHEN index_prefix = 'logs' THEN CAST(max(epoch_us(ts)) AS BIGINT) END AS last_us,
  CASE WHEN index_prefix = 'logs' THEN count(DISTINCT CAST(ts AS DATE)) END AS days FROM d GROUP BY 1""")
def stream_event_lines(spark, sf):
    """Lines with a field that no schema names, a third with their time in `@timestamp`, a
    third without zone, and every fortieth cut off."""
    feed, out = staging_path(spark, "feed"), staging_path(spark, "ingested")
    local = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    zoned, third = F.concat(local, F.lit("Z")), F.col("event_id") % 3
    line = F.to_json(
        F.struct(
            F.when(third == 0, zoned).when(third == 1, local).alias("timestamp"),
            F.when(third == 2, zoned).alias("@timestamp"),
            "event_id", "event_type", "props",
        )
    )
    cut = F.when(F.col("event_id") % 40 == 0, F.substring(line, 1, 12)).otherwise(line)
    I.table(spark, sf, "events").select(cut.alias("value")).write.text(feed)
    docs = ingest.to_documents(ingest.read_event_lines(spark, feed))
    _finish(ingest.start_line_ingest(docs, f"{out}/table", f"{out}/checkpoint", availableNow=True))
    good = commits.read_committed(spark, f"{out}/table", "logs").groupBy("index_prefix").agg(
        F.count("*").alias("docs"),
        F.sum(F.length(F.col("fields")["props"])).alias("chars"),
        F.unix_micros(F.max("@timestamp")).alias("last_us"),
        F.count_distinct("index_date").alias("days"),
    )
    bad = commits.read_committed(spark, f"{out}/table", store.CORRUPT_PREFIX).groupBy("index_prefix").agg(
        F.count("*").alias("docs"),
        F.sum(F.length("_corrupt_record")).alias("chars"),
        F.lit(None).cast("long").alias("last_us"),
        F.lit(None).cast("long").alias("days"),
    )
    return good.unionByName(bad)


def _event_lines(spark: SparkSession, sf: str):
    """The events as JSON lines, a thirtieth of them cut off."""
    line = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), "event_id", "event_type", "value"
    ))
    cut = F.when(F.col("event_id") % 30 == 0, F.substring(line, 1, 9)).otherwise(line)
    return I.table(spark, sf, "events").select(cut.alias("value"))


def _committed(spark: SparkSession, sf: str) -> str:
    """A table that a stream of lines has filled in several commits."""
    feed, out = staging_path(spark, "feed"), staging_path(spark, "ingested")
    _event_lines(spark, sf).repartition(3).write.text(feed)
    docs = ingest.to_documents(ingest.read_event_lines(spark, feed, max_files_per_trigger=1))
    _finish(ingest.start_line_ingest(docs, f"{out}/table", f"{out}/checkpoint", availableNow=True))
    return f"{out}/table"


@query("event_manifest", """SELECT 'logs' AS index_prefix, strftime(ts, '%Y.%m.%d') AS index_date, CAST(count(*) AS BIGINT) AS docs,
  CAST(min(epoch_us(ts)) AS BIGINT) AS first_us, CAST(max(epoch_us(ts)) AS BIGINT) AS last_us
FROM events WHERE event_id % 30 <> 0 GROUP BY 2""")
def event_manifest(spark, sf):
    """Documents and times per day, told by the entries of the commits alone."""
    days = commits.docs_per_day(commits.manifest(spark, _committed(spark, sf), "logs"))
    return days.select(
        "index_prefix", "index_date", "docs",
        F.unix_micros("first_time").alias("first_us"), F.unix_micros("last_time").alias("last_us"),
    )


@query("event_committed_last_days", """WITH good AS (SELECT * FROM events WHERE event_id % 30 <> 0)
SELECT CAST(event_id AS BIGINT) AS event_id, event_type FROM good WHERE ts >= (SELECT max(ts) FROM good) - INTERVAL 7 DAYS""")
def event_committed_last_days(spark, sf):
    """The last week of a table that a stream has filled; other days are not even listed."""
    recent = commits.last_days(spark, _committed(spark, sf), "logs", 7)
    return recent.select(F.col("event_id").cast("long").alias("event_id"), "event_type")


@query("event_stream_expired", """SELECT strftime(ts, '%Y.%m.%d') AS index_date, count(*) AS docs FROM events
WHERE CAST(ts AS DATE) >= (SELECT max(CAST(ts AS DATE)) FROM events) - 10 GROUP BY 1""")
def event_stream_expired(spark, sf):
    """Days that a stream has written and that have expired, as its readers see them."""
    feed, out = staging_path(spark, "feed"), staging_path(spark, "ingested")
    I.table(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), "event_id"
    ).write.json(feed)
    docs = ingest.to_documents(ingest.read_event_lines(spark, feed))
    _finish(ingest.start_ingest(docs, f"{out}/table", f"{out}/checkpoint", availableNow=True))
    store.drop_expired(spark, f"{out}/table", "logs", 10)
    return store.read_index(spark, f"{out}/table", "logs").groupBy("index_date").agg(F.count("*").alias("docs"))


@query("stream_event_closed_windows", f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS docs,
  {I.rnd('avg(value)')} AS avg_value FROM events
WHERE date_trunc('day', ts) + INTERVAL 25 HOURS <= (SELECT max(ts) FROM events) GROUP BY 1, 2""")
def stream_event_closed_windows(spark, sf):
    """Each day once, an hour of event time after its end."""
    out = staging_path(spark, "series")
    events = _table_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    series = histogram.windowed(
        events, F.count("*").alias("docs"), F.avg("value").alias("avg_value"), keys=["event_type"]
    )
    _finish(histogram.start_append(series, f"{out}/table", f"{out}/checkpoint", availableNow=True))
    return I.rounded(
        spark.read.parquet(f"{out}/table").select(
            F.date_format("bucket_start", "yyyy-MM-dd").alias("day"), "event_type", "docs", "avg_value"
        )
    )


@query("stream_event_histogram", f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS docs,
  {I.rnd('avg(value)')} AS avg_value FROM events GROUP BY 1, 2""")
def stream_event_histogram(spark, sf):
    out = staging_path(spark, "series")
    # The watermark needs a time with zone; the table holds UTC clock times.
    events = _table_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    series = histogram.windowed(
        events, F.count("*").alias("docs"), F.avg("value").alias("avg_value"), keys=["event_type"]
    )
    keys = ["event_type"]
    _finish(histogram.start_snapshot(series, f"{out}/table", f"{out}/checkpoint", keys, availableNow=True))
    return I.rounded(
        histogram.read_snapshot(spark, f"{out}/table", keys).select(
            F.date_format("bucket_start", "yyyy-MM-dd").alias("day"), "event_type", "docs", "avg_value"
        )
    )


@query("stream_score_prompts", f"""WITH {I.SCORED}
SELECT doc_id, input_tokens, output_tokens, {SQL_REQUEST_COST} AS estimated_cost, question_flag FROM scored""")
def stream_score_prompts(spark, sf):
    out = staging_path(spark, "answers")
    prompts = I.prompts_of(_table_stream(spark, sf, "documents"))
    answers = prompt_stream.scored(
        prompts, I.MODEL, partitions=spark.sparkContext.defaultParallelism
    )
    _finish(prompt_stream.start_scoring(answers, f"{out}/table", f"{out}/checkpoint", availableNow=True))
    return spark.read.parquet(f"{out}/table").select(
        "doc_id", "input_tokens", "output_tokens", "estimated_cost", "question_flag"
    )
