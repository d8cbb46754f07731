"""The event table: append-only documents in daily indices.

Layout: `<root>/index_prefix=<prefix>/index_date=<yyyy.MM.dd>/*.parquet`. One index
of the document store this replaces is one partition here; reading a prefix or a
range of days lists only the matching folders.

Where days hold few documents, a file for each of very many days costs far more than what
is in it. Such documents may be appended by year instead, to
`<root>/_years/index_prefix=<prefix>/index_year=<yyyy>/*.parquet`, with their day as a
column and in its order. Everything here takes both layouts, also of one prefix; what
reads folders below the root by itself sees only the daily ones.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, DataFrameReader, Observation, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from turnledger.operators.normalize import dense_positions
from turnledger.storage import names_in, remove, touch

DAY_FORMAT = "yyyy.MM.dd"
DAY_OF_FOLDER = "%Y.%m.%d"
CORRUPT_PREFIX = "corrupt"
UNKNOWN_DAY = "unknown"
# Lines that are counted together when a bulk of them is appended.
CHUNK = 500


def utc(df: DataFrame, ts: str) -> Column:
    """The event time on the UTC clock. Timestamps without a zone are UTC already."""
    if isinstance(df.schema[ts].dataType, TimestampType):
        return F.convert_timezone(None, F.lit("UTC"), F.col(ts))
    return F.col(ts)


def event_time(text: Column | str) -> Column:
    """The instant that an ISO 8601 text names, null if it is unreadable. Texts without a
    zone are UTC, as writers without zone mean it, whatever zone the session has."""
    text = F.trim(F.col(text) if isinstance(text, str) else text)
    zoned = F.regexp_like(text, F.lit(r"\d:\d\d.*([A-Za-z]|[+-]\d{1,2}(:?\d{2})?)$"))
    day_only = F.regexp_like(text, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}$"))
    return F.try_to_timestamp(
        F.when(zoned, text)
        .when(day_only, F.concat(text, F.lit("T00:00:00Z")))
        .otherwise(F.concat(text, F.lit("Z")))
    )


def index_day(df: DataFrame, ts: str) -> Column:
    """UTC day of the event as `yyyy.MM.dd`. Taken from the event, not from the clock
    of the writer, so late documents land in the right index."""
    return F.date_format(F.to_date(utc(df, ts)), DAY_FORMAT)


def documents(events: DataFrame, index_prefix: Column | str, ts: str = "ts",
              service: str = "turnledger", host: Column | str = "batch") -> DataFrame:
    """Add `@timestamp`, `service`, `host` and the two index columns."""
    as_col = lambda c: F.lit(c) if isinstance(c, str) else c
    return events.withColumns(
        {
            "@timestamp": F.col(ts),
            "service": as_col(service),
            "host": as_col(host),
            "index_prefix": as_col(index_prefix),
            "index_date": index_day(events, ts),
        }
    )


def append(docs: DataFrame, root: str, by_year: bool = False) -> None:
    """Append documents to their daily indices, each in a folder of its own or, for days
    of few documents, `by_year`.

    The rebalance brings rows of one folder together, so that a wide job does not
    leave a file per task and day; adaptive execution splits large ones again.
    """
    if by_year:
        docs = docs.withColumn("index_year", _year("index_date"))
    folder = ["index_prefix", "index_year" if by_year else "index_date"]
    dealt = docs.hint("rebalance", *folder)
    if by_year:
        dealt = dealt.sortWithinPartitions(*folder, "index_date")
    dealt.write.mode("append").partitionBy(*folder).parquet(_years(root) if by_year else root)


def _years(root: str) -> str:
    return f"{root.rstrip('/')}/_years"


def _year(day: str) -> Column:
    """The year of a day `yyyy.MM.dd`; `UNKNOWN_DAY` is a year of its own."""
    return F.substring_index(F.col(day), ".", 1)


def parse_lines(lines: DataFrame, schema: StructType, column: str = "value",
                others: dict[str, Column] | None = None) -> DataFrame:
    """JSON lines -> schema columns and `_corrupt_record`, which is null for good rows;
    `others` are more columns, computed from the line."""
    more = others or {}
    full = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    return lines.select(
        F.from_json(
            column, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
        ).alias("d"),
        *[c.alias(name) for name, c in more.items()],
    ).select("d.*", *more)


def bulk_append(lines: DataFrame, schema: StructType, root: str, index_prefix: str,
                ts: str = "timestamp") -> dict[str, int]:
    """Append JSON lines in one job; rows that do not fit the schema go to the side
    index `corrupt` with their raw text. Returns the numbers of good and bad rows."""
    parsed = parse_lines(lines, schema)
    bad = F.col("_corrupt_record").isNotNull()
    prefix = F.when(bad, F.lit(CORRUPT_PREFIX)).otherwise(F.lit(index_prefix))
    docs = documents(parsed.withColumn(ts, event_time(ts)), prefix, ts)
    docs = docs.withColumn("index_date", F.coalesce("index_date", F.lit(UNKNOWN_DAY)))
    counted = Observation()
    append(
        docs.observe(
            counted,
            F.count_if(~bad).alias("indexed"),
            F.count_if(bad).alias("failed"),
        ),
        root,
    )
    return {k: int(v) for k, v in counted.get.items()}


def chunk_counts(lines: DataFrame, schema: StructType, order: str,
                 chunk: int = CHUNK) -> DataFrame:
    """(chunk, indexed, failed): how many of each `chunk` lines, taken in the order of a
    column with unique values, `bulk_append` puts into the index and into the side index.

    Chunks are numbered from 0 whatever the splits; the last may be short, and no lines
    give no chunk. Lines are parsed where they are read, and only the order column and
    whether a line fits are moved.
    """
    parsed = parse_lines(lines, schema, others={"_at": F.col(order)})
    marked = parsed.select("_at", F.col("_corrupt_record").isNotNull().alias("_bad"))
    placed = dense_positions(marked, "_at", others=["_bad"])
    return placed.groupBy(F.floor(F.col("dense_position") / chunk).alias("chunk")).agg(
        F.count_if(~F.col("_bad")).alias("indexed"), F.count_if("_bad").alias("failed")
    )


def read_index(spark: SparkSession, root: str, prefix: str, first_day: str | None = None,
               last_day: str | None = None, schema: StructType | None = None) -> DataFrame:
    """All daily indices of a prefix, or those of a range of days (`yyyy.MM.dd`), without
    the days that have expired.

    Only folders of the prefix are listed. Documents of different kinds have different
    fields: without a schema the fields of all files are merged, which reads every
    footer once; with one, missing fields are null and nothing has to be merged.
    """
    first = max((d for d in (first_day, kept_from(spark, root, prefix)) if d), default=None)
    by_day, by_year = (f"{r.rstrip('/')}/index_prefix={prefix}" for r in (root, _years(root)))
    found = []
    in_years = bool(names_in(spark, by_year))
    if not in_years or names_in(spark, by_day):
        found.append(_in_days(_reader(spark, root, schema).parquet(by_day), "index_date", first, last_day))
    if in_years:
        full = schema and StructType([*schema.fields, StructField("index_date", StringType())])
        docs = _reader(spark, _years(root), full).parquet(by_year)
        year = lambda day: day and day.split(".")[0]
        docs = docs.withColumn("index_year", F.col("index_year").cast("string"))
        docs = _in_days(_in_days(docs, "index_year", year(first), year(last_day)), "index_date", first, last_day)
        index = ["index_prefix", "index_date"]
        found.append(docs.select(*[f"`{c}`" for c in docs.columns if c not in [*index, "index_year"]], *index))
    if len(found) == 1:
        return found[0]
    both = found[0].unionByName(found[1], allowMissingColumns=True)
    return both.select(*[f"`{c}`" for c in both.columns if c not in index], *index)


def _reader(spark: SparkSession, base: str, schema: StructType | None) -> DataFrameReader:
    reader = spark.read.option("basePath", base)
    return reader.option("mergeSchema", True) if schema is None else reader.schema(schema)


def _in_days(docs: DataFrame, column: str, first: str | None, last: str | None) -> DataFrame:
    if first is not None:
        docs = docs.filter(F.col(column) >= first)
    if last is not None:
        docs = docs.filter(F.col(column) <= last)
    return docs


def _marks(root: str, prefix: str) -> str:
    return f"{root.rstrip('/')}/_retention/index_prefix={prefix}"


def kept_from(spark: SparkSession, root: str, prefix: str) -> str | None:
    """The first day of a prefix that has not expired, null if none ever has."""
    return max(names_in(spark, _marks(root, prefix)), default=None)


def index_days(spark: SparkSession, root: str, prefix: str) -> list[str]:
    """Days of the daily indices of a prefix that have not expired, in order, from folder
    listings alone; of documents by year from their days."""
    first = kept_from(spark, root, prefix) or ""
    days = set(_days_of_folders(spark, root, prefix))
    by_year = f"{_years(root)}/index_prefix={prefix}"
    if names_in(spark, by_year):
        stored = spark.read.schema("index_date string").parquet(by_year).select("index_date").distinct()
        days |= {r.index_date for r in stored.collect()} - {None, UNKNOWN_DAY}
    return sorted(d for d in days if d >= first)


def _days_of_folders(spark: SparkSession, root: str, prefix: str) -> list[str]:
    names = names_in(spark, f"{root.rstrip('/')}/index_prefix={prefix}")
    days = [n.removeprefix("index_date=") for n in names if n.startswith("index_date=")]
    return sorted(d for d in days if d != UNKNOWN_DAY)


def drop_expired(spark: SparkSession, root: str, prefix: str, days: int,
                 as_of: date | None = None) -> list[str]:
    """Let the daily indices of a prefix older than `days` days before `as_of` (its latest
    day if not given) expire and return their days. Documents without a day stay.

    A mark beside the table hides them from readers at once, as a filter on folders; marks
    never go back. Then their folders are removed, but not those whose files a commit log
    of Spark names (`ingest.start_ingest`): they stay hidden, and the stream may go on.
    """
    present = index_days(spark, root, prefix)
    if not present:
        return []
    last = as_of or datetime.strptime(present[-1], DAY_OF_FOLDER).date()
    first_kept = (last - timedelta(days=days)).strftime(DAY_OF_FOLDER)
    expired = [d for d in present if d < first_kept]
    if expired:
        touch(spark, f"{_marks(root, prefix)}/{first_kept}")
    remove_expired(spark, root, prefix)
    return expired


def remove_expired(spark: SparkSession, root: str, prefix: str) -> None:
    """Remove folders of expired days and years, also those that late documents have filled
    again. Expired days of the first year that is kept stay hidden in its folder."""
    folder = f"{root.rstrip('/')}/index_prefix={prefix}"
    first = kept_from(spark, root, prefix)
    if first is None:
        return
    by_year = f"{_years(root)}/index_prefix={prefix}"
    for name in names_in(spark, by_year):
        year = name.removeprefix("index_year=")
        if year.isdigit() and year < first.split(".")[0]:
            remove(spark, f"{by_year}/{name}")
    if "_spark_metadata" in names_in(spark, folder):
        return
    for day in _days_of_folders(spark, root, prefix):
        if day < first:
            remove(spark, f"{folder}/index_date={day}")


def docs_per_index(docs: DataFrame) -> DataFrame:
    """Documents per daily index, sorted by index name."""
    return (
        docs.groupBy("index_prefix", "index_date")
        .agg(F.count("*").alias("docs"))
        .select(F.concat_ws("-", "index_prefix", "index_date").alias("index_name"), "docs")
        .orderBy("index_name")
    )
