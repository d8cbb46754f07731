"""Questions to the event table: filters, terms, histograms, series, summaries.

Every aggregate here combines rows in the task that read them, so a hot event type,
model or day costs one row per task in the shuffle.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import TimestampType

from turnledger.functions.text import has_term, num_words, unicode_trim
from turnledger.sources.event_store import DAY_FORMAT, UNKNOWN_DAY


# ---- filters -----------------------------------------------------------------------


def of_type(events: DataFrame, event_type: str, column: str = "event_type") -> DataFrame:
    return events.filter(F.col(column) == event_type)


def utc_literal(at: datetime, zoned: bool = False) -> Column:
    """A literal for a time on the UTC clock (other zones are converted), whatever the
    time zones of session and machine: without zone, or as an instant if `zoned`."""
    if at.tzinfo is not None:
        at = at.astimezone(timezone.utc).replace(tzinfo=None)
    text = at.isoformat(sep=" ")
    return F.to_timestamp_ltz(F.lit(text + "Z")) if zoned else F.to_timestamp_ntz(F.lit(text))


def last_days(events: DataFrame, days: int, ts: str = "ts",
              as_of: datetime | Column | None = None) -> DataFrame:
    """Events not older than `days` times 24 hours before `as_of`.

    Without `as_of` the latest event counts: a scalar subquery that reads the time
    column only and whose value is pushed to the scan like a literal.
    """
    zoned = isinstance(events.schema[ts].dataType, TimestampType)
    if isinstance(as_of, datetime):
        start = utc_literal(as_of - timedelta(days=days), zoned)
    else:
        latest = events.agg(F.max(ts).alias("latest")).scalar() if as_of is None else as_of
        # Days of the session's calendar may have 23 or 25 hours.
        start = (
            F.timestamp_micros(F.unix_micros(latest) - F.lit(days * 86_400_000_000))
            if zoned
            else latest - F.expr(f"INTERVAL {int(days)} DAYS")
        )
    return events.filter(F.col(ts) >= start)


def last_days_of_index(docs: DataFrame, days: int, as_of: datetime, ts: str = "ts") -> DataFrame:
    """`last_days` over the event table: the time range also bounds the daily index,
    so folders of older days are not listed or read. `as_of` is on the UTC clock."""
    first_day = (as_of - timedelta(days=days)).strftime("%Y.%m.%d")
    return last_days(docs.filter(F.col("index_date") >= first_day), days, ts, as_of)


def matching(events: DataFrame, column: str, terms: str | list[str]) -> DataFrame:
    """Events whose text holds one of the terms as a whole token."""
    return events.filter(has_term(column, terms))


def retained(docs: DataFrame, days: int, as_of: date | None = None) -> DataFrame:
    """Documents of the event table from the last `days` days before `as_of` (the latest
    daily index if not given).

    Decided on `index_date` alone, so the filter skips folders of other days. Finding the
    latest day opens every file, if only its footer: `event_store.index_days` takes it from
    the folder listing, to be given as `as_of`. Documents without a day are kept.
    """
    if as_of is None:
        days_only = docs.filter(F.col("index_date") != UNKNOWN_DAY)
        latest = days_only.agg(F.max("index_date").alias("latest")).scalar()
        last = F.to_date(latest, DAY_FORMAT)
    else:
        last = F.lit(as_of)
    return docs.filter(F.col("index_date") >= F.date_format(F.date_sub(last, days), DAY_FORMAT))


# ---- terms and numbers ----------------------------------------------------------------


def doc_count(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("docs"))


def count_by(events: DataFrame, *keys: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.count("*").alias("docs"))


def top_terms(events: DataFrame, key: str, size: int = 5) -> DataFrame:
    """The `size` most frequent values, ties in order of the value."""
    return count_by(events, key).orderBy(F.desc("docs"), key).limit(size)


def top_terms_by_sum(events: DataFrame, key: str, value: str, size: int = 10) -> DataFrame:
    """The `size` values with the largest sum: key, total."""
    return (
        events.groupBy(key)
        .agg(F.sum(value).alias("total"))
        .orderBy(F.desc("total"), key)
        .limit(size)
    )


def averages_by(events: DataFrame, key: str, *metrics: str) -> DataFrame:
    return events.groupBy(key).agg(*[F.avg(m).alias(f"avg_{m}") for m in metrics])


def sums(events: DataFrame, *metrics: str) -> DataFrame:
    return events.agg(*[F.sum(m).alias(f"sum_{m}") for m in metrics])


def numeric_histogram(events: DataFrame, column: str, interval: float = 5) -> DataFrame:
    """bucket (lower bound, a multiple of the interval), docs. Nulls are left out."""
    bucket = F.floor(F.col(column) / interval) * interval
    return (
        events.filter(F.col(column).isNotNull())
        .groupBy(bucket.cast("double").alias("bucket"))
        .agg(F.count("*").alias("docs"))
    )


def throughput(rows: Column | str, seconds: Column | str) -> Column:
    """Rows per second; 0 when no time has passed."""
    rows = F.col(rows) if isinstance(rows, str) else rows
    seconds = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.when(seconds > 0, rows / seconds).otherwise(F.lit(0.0))


# ---- series over time -------------------------------------------------------------------


def over_time(events: DataFrame, *aggregates: Column, ts: str = "ts", bucket: str = "1 day",
              keys: list[str] | None = None) -> DataFrame:
    """One row per time bucket (and key): bucket_start and the aggregates."""
    window = F.window(ts, bucket)
    return (
        events.groupBy(window.alias("w"), *(keys or []))
        .agg(*aggregates)
        .withColumn("bucket_start", F.col("w.start"))
        .drop("w")
    )


def averages_over_time(events: DataFrame, metrics: list[str], ts: str = "ts",
                       bucket: str = "1 day") -> DataFrame:
    """Several averages in one pass, as long rows: bucket_start, metric, average."""
    wide = over_time(events, *[F.avg(m).alias(m) for m in metrics], ts=ts, bucket=bucket)
    return wide.unpivot(["bucket_start"], metrics, "metric", "average")


# ---- documents of our own jobs -----------------------------------------------------------


def training_documents(metrics: DataFrame, at: datetime) -> DataFrame:
    """Model metrics of `plans.train` as event documents with a `metrics` struct."""
    return metrics.select(
        utc_literal(at).alias("ts"),
        F.lit("model_training").alias("event_type"),
        "model_name",
        F.struct("mae", "rmse", "r2", "training_time_seconds", "dataset_size").alias("metrics"),
    )


def processing_document(result: DataFrame, rows: str, operation: str, seconds: float,
                        at: datetime) -> DataFrame:
    """A one-row result (statistics, totals) as the document of the job that made it;
    `rows` is the column with the number of rows it went over."""
    return result.select(
        utc_literal(at).alias("ts"),
        F.lit("data_processing").alias("event_type"),
        F.lit(operation).alias("operation"),
        F.col(rows).cast("long").alias("rows_processed"),
        F.lit(float(seconds)).alias("processing_time_seconds"),
        throughput(rows, F.lit(float(seconds))).alias("throughput_rows_per_sec"),
        *[c for c in result.columns if c != rows],
    )


def cost_document(totals: DataFrame, model: str, at: datetime) -> DataFrame:
    """The totals of a cost report as the document of that analysis."""
    return totals.select(
        utc_literal(at).alias("ts"),
        F.lit("cost_analysis").alias("event_type"),
        F.lit("cost").alias("stage"),
        F.lit("ok").alias("status"),
        F.lit(model).alias("model"),
        *totals.columns,
    )


def training_summary_document(metrics: DataFrame, best: str, at: datetime) -> DataFrame:
    """One document about a training: the best model, and what all models took."""
    return metrics.agg(
        F.round(F.max(F.when(F.col("model_name") == best, F.col("r2"))), 6).alias("best_r2"),
        F.max("dataset_size").alias("dataset_size"),
        F.round(F.sum("training_time_seconds"), 3).alias("total_training_time_seconds"),
        F.count("*").alias("model_count"),
    ).select(
        utc_literal(at).alias("ts"),
        F.lit("training_summary").alias("event_type"),
        F.lit("train").alias("stage"),
        F.lit("ok").alias("status"),
        F.lit(best).alias("best_model"),
        "*",
    )


def run_started_document(spark: SparkSession, run_id: str, at: datetime) -> DataFrame:
    return _run_document(spark, "pipeline_run_started", run_id, "running", at)


def stage_document(spark: SparkSession, run_id: str, stage: str, error: str | None,
                   at: datetime) -> DataFrame:
    """The result of one stage; `run_summary` reads these with `ts` as their order."""
    status = "ok" if error is None else "error"
    return _run_document(spark, "pipeline_stage", run_id, status, at).select(
        "*", F.lit(stage).alias("stage"), F.lit(error).cast("string").alias("error")
    )


def run_completed_document(spark: SparkSession, run_id: str, errors: dict[str, str | None],
                           seconds: float, at: datetime) -> DataFrame:
    """The end of a run; `errors` has an entry for each stage, None where it went well."""
    failed = [stage for stage, error in errors.items() if error is not None]
    status = "failed" if failed else "ok"
    return _run_document(spark, "pipeline_run_completed", run_id, status, at).select(
        "*",
        F.array(*[F.lit(s) for s in failed]).cast("array<string>").alias("failed_stages"),
        F.lit(len(errors)).cast("long").alias("stage_count"),
        F.lit(round(seconds, 2)).alias("duration_seconds"),
    )


def _run_document(spark: SparkSession, event_type: str, run_id: str, status: str,
                  at: datetime) -> DataFrame:
    return spark.range(1).select(
        utc_literal(at).alias("ts"),
        F.lit(event_type).alias("event_type"),
        F.lit(run_id).alias("run_id"),
        F.lit(status).alias("status"),
    )


def prediction_documents(answers: DataFrame, prompt: str, model_name: str,
                         ts: str = "ts") -> DataFrame:
    """Answers of `scoring.score_prompts` as one document per request."""
    trimmed = unicode_trim(prompt)
    return answers.select(
        ts,
        F.lit("prediction").alias("event_type"),
        F.lit(model_name).alias("model_name"),
        F.lit("/predict").alias("endpoint"),
        F.lit("POST").alias("method"),
        F.length(trimmed).alias("prompt_chars"),
        num_words(prompt).alias("prompt_words"),
        F.length("optimized_prompt").alias("optimized_prompt_chars"),
        "input_tokens",
        "output_tokens",
        "total_tokens",
        "estimated_cost",
        "token_savings_percent",
        "compression_percent",
        "question_flag",
    )


# ---- summaries ----------------------------------------------------------------------------


def training_summary(events: DataFrame, model_name: str, days: int = 7, ts: str = "ts",
                     as_of: datetime | Column | None = None,
                     event_type: str = "model_training") -> DataFrame:
    """Average errors and number of trainings of one model in the last days."""
    recent = last_days(events, days, ts, as_of)
    return (
        of_type(recent, event_type)
        .filter(F.col("model_name") == model_name)
        .agg(
            F.avg("mae").alias("average_mae"),
            F.avg("rmse").alias("average_rmse"),
            F.avg("r2").alias("average_r2"),
            F.count("model_name").alias("total_trainings"),
        )
    )


def run_summary(stages: DataFrame, ok: str = "ok", all_good: str = "ok",
                some_failed: str = "failed") -> DataFrame:
    """run_id, failed_stages, stage_count, status from stage events.

    Input: run_id, stage, status and an `at` column that orders repeated events; the
    last status of a stage counts. Reducing to one row per stage first bounds the
    collected list by the number of stage names.
    """
    last = stages.groupBy("run_id", "stage").agg(F.max_by("status", "at").alias("status"))
    failed = F.coalesce(F.col("status") != ok, F.lit(True))
    return last.groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.when(failed, F.col("stage")))).alias("failed_stages"),
        F.count("*").alias("stage_count"),
        F.when(F.bool_or(failed), F.lit(some_failed)).otherwise(F.lit(all_good)).alias("status"),
    )


def alerts(events: DataFrame, is_error: Column, latency_ms: Column, training_failed: Column,
           max_error_rate: float, max_latency_ms: float, ts: str = "ts",
           bucket: str = "1 hour") -> DataFrame:
    """Time buckets that break a rule: bucket_start, error_rate, avg_latency_ms,
    failed_trainings and one flag per rule."""
    measured = over_time(
        events,
        F.avg(is_error.cast("double")).alias("error_rate"),
        F.avg(latency_ms).alias("avg_latency_ms"),
        F.count_if(training_failed).alias("failed_trainings"),
        ts=ts,
        bucket=bucket,
    )
    flagged = measured.withColumns(
        {
            "high_error_rate": F.coalesce(F.col("error_rate") > max_error_rate, F.lit(False)),
            "slow": F.coalesce(F.col("avg_latency_ms") > max_latency_ms, F.lit(False)),
            "training_failure": F.col("failed_trainings") > 0,
        }
    )
    return flagged.filter(F.col("high_error_rate") | F.col("slow") | F.col("training_failure"))
