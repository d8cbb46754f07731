"""Live date histograms: tumbling windows over the event stream."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from turnledger.operators.events import over_time
from turnledger.storage import names_in, remove


def windowed(events: DataFrame, *aggregates: Column, ts: str = "ts", bucket: str = "1 day",
             watermark: str = "1 hour", keys: list[str] | None = None) -> DataFrame:
    """The batch series of `events.over_time` on a stream. With `start_append` the
    watermark bounds the state: windows older than it are written and forgotten, and
    later events for them are left out."""
    return over_time(
        events.withWatermark(ts, watermark), *aggregates, ts=ts, bucket=bucket, keys=keys
    )


def start_append(series: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write each window once, after the watermark has closed it."""
    return (
        series.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def start_snapshot(series: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = (),
                   compact_every: int = 20, **trigger) -> StreamingQuery:
    """Keep the whole series, open windows included, as a versioned table.

    A trigger adds a version with the windows that it changed; nothing is replaced, so
    `read_snapshot` sees all of a trigger or none of it, also while the next one runs. The
    watermark bounds the state: windows it has closed are forgotten by the stream and stay
    in the table. Every `compact_every` triggers the table is written anew as one version,
    and what the compaction before had left is removed: a reader may take as long as the
    triggers between two compactions.

    `keys` are the columns besides `bucket_start` that name a row.
    """
    path = path.rstrip("/")

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        whole, changed = _versions(spark, path)
        if batch_id not in changed:
            batch.write.mode("overwrite").parquet(f"{path}/changed-{batch_id}")
        if (batch_id + 1) % compact_every or batch_id in whole:
            return
        table = read_snapshot(spark, path, keys)
        table.write.mode("overwrite").parquet(f"{path}/whole-{batch_id}")
        last = max(whole, default=-1)
        for kind, ids in (("whole", whole), ("changed", changed)):
            for old in ids:
                if old < last or (kind == "changed" and old == last):
                    remove(spark, f"{path}/{kind}-{old}")

    return (
        series.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(**(trigger or {"processingTime": "1 minute"}))
        .start()
    )


def _versions(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """Numbers of the finished whole versions and of the finished changes."""
    found: dict[str, list[int]] = {"whole": [], "changed": []}
    for name in names_in(spark, path):
        kind, _, number = name.partition("-")
        if kind in found and "_SUCCESS" in names_in(spark, f"{path}/{name}"):
            found[kind].append(int(number))
    return sorted(found["whole"]), sorted(found["changed"])


def read_snapshot(spark: SparkSession, path: str, keys: Sequence[str] = ()) -> DataFrame:
    """The series after the last finished trigger: of every window its latest row, from the
    last whole version and what has changed since. Needs a first trigger to have finished."""
    path = path.rstrip("/")
    whole, changed = _versions(spark, path)
    start = max(whole, default=-1)
    parts = [(start, f"{path}/whole-{start}")] if whole else []
    parts += [(n, f"{path}/changed-{n}") for n in changed if n > start]
    if not parts:
        raise FileNotFoundError(f"no finished version in {path}")
    frames = [spark.read.parquet(at).withColumn("_version", F.lit(n)) for n, at in parts]
    every = reduce(DataFrame.unionByName, frames)
    names = ["bucket_start", *keys]
    rest = [c for c in every.columns if c not in names and c != "_version"]
    latest = every.groupBy(*names).agg(F.max_by(F.struct(*rest), "_version").alias("_row"))
    return latest.select(*names, "_row.*")
