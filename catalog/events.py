"""The event table and the questions asked of it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from catalog import inputs as I
from catalog.registry import query
from turnledger.functions.money import request_cost
from turnledger.operators import events as ev
from turnledger.sources import event_store as store
from turnledger.storage import staging_path

DAY = "strftime(date_trunc('day', ts), '%Y-%m-%d')"


def _day(column: str = "bucket_start"):
    return F.date_format(F.to_date(column), "yyyy-MM-dd").alias("day")


# ---- the table -----------------------------------------------------------------------------

METRIC_KINDS = ("prediction", "model_training")
PREFIX = "CASE WHEN event_type IN ('prediction', 'model_training') THEN 'metrics' ELSE 'events' END"


def _stored(spark, sf) -> str:
    """All documents appended to a fresh event table; returns its root."""
    root = staging_path(spark, "events")
    prefix = F.when(F.col("event_type").isin(*METRIC_KINDS), "metrics").otherwise("events")
    store.append(store.documents(I.event_docs(spark, sf), prefix), root)
    return root


@query("event_daily_index", f"""WITH {I.DOCS}
SELECT {PREFIX} || '-' || strftime(ts, '%Y.%m.%d') AS index_name, count(*) AS docs FROM docs GROUP BY 1""")
def event_daily_index(spark, sf):
    return store.docs_per_index(spark.read.parquet(_stored(spark, sf)))


@query("event_count", f"WITH {I.DOCS} SELECT count(*) AS docs FROM docs WHERE {PREFIX} = 'metrics'")
def event_count(spark, sf):
    return ev.doc_count(store.read_index(spark, _stored(spark, sf), "metrics"))


LINE = StructType(
    [
        StructField("timestamp", StringType()),
        StructField("event_id", LongType()),
        StructField("event_type", StringType()),
        StructField("value", DoubleType()),
    ]
)


def _lines(spark, sf):
    """event_id and documents as JSON lines, every fortieth one cut off in the middle."""
    line = F.to_json(
        F.struct(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
            "event_id", "event_type", "value",
        )
    )
    cut = F.when(F.col("event_id") % 40 == 0, F.substring(line, 1, 20)).otherwise(line)
    return I.table(spark, sf, "events").select("event_id", cut.alias("value"))


@query("event_bulk_append", """WITH d AS (
  SELECT CASE WHEN event_id % 40 = 0 THEN 'corrupt' ELSE 'events' END AS index_prefix,
    CASE WHEN event_id % 40 = 0 THEN 'unknown' ELSE strftime(ts, '%Y.%m.%d') END AS index_date, event_id FROM events)
SELECT index_prefix || '-' || index_date AS index_name, count(*) AS docs FROM d GROUP BY 1""")
def event_bulk_append(spark, sf):
    root = staging_path(spark, "bulk")
    store.bulk_append(_lines(spark, sf), LINE, root, "events")
    return store.docs_per_index(spark.read.parquet(root))


@query("event_bulk_chunks", """WITH d AS (
  SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events)
SELECT place // 500 AS chunk, count(*) FILTER (event_id % 40 <> 0) AS indexed,
  count(*) FILTER (event_id % 40 = 0) AS failed FROM d GROUP BY 1""")
def event_bulk_chunks(spark, sf):
    return store.chunk_counts(_lines(spark, sf), LINE, "event_id")


@query("event_retention", f"""WITH {I.DOCS}
SELECT strftime(ts, '%Y.%m.%d') AS index_date, count(*) AS docs FROM docs
WHERE CAST(ts AS DATE) >= (SELECT CAST(max(ts) AS DATE) FROM docs) - 10 GROUP BY 1""")
def event_retention(spark, sf):
    docs = spark.read.parquet(_stored(spark, sf))
    return ev.count_by(ev.retained(docs, 10), "index_date")


@query("event_index_last_days", f"""WITH {I.DOCS}, metrics AS (SELECT * FROM docs WHERE {PREFIX} = 'metrics')
SELECT event_id, event_type, model_name FROM metrics WHERE ts >= (SELECT max(ts) FROM metrics) - INTERVAL 7 DAYS""")
def event_index_last_days(spark, sf):
    """The latest time from the latest day's folder, then the folders of the days asked for."""
    root = _stored(spark, sf)
    latest = store.index_days(spark, root, "metrics")[-1:]
    docs = store.read_index(spark, root, "metrics")
    as_of = docs.filter(F.col("index_date").isin(latest)).agg(F.max("ts")).first()[0]
    recent = docs.limit(0) if as_of is None else ev.last_days_of_index(docs, 7, as_of)
    return recent.select("event_id", "event_type", "model_name")


@query("event_drop_expired", f"""WITH {I.DOCS}, d AS (SELECT {PREFIX} AS index_prefix, CAST(ts AS DATE) AS day FROM docs)
SELECT index_prefix || '-' || strftime(day, '%Y.%m.%d') AS index_name, count(*) AS docs FROM d
WHERE index_prefix <> 'metrics' OR day >= (SELECT max(day) FROM d WHERE index_prefix = 'metrics') - 10 GROUP BY 1""")
def event_drop_expired(spark, sf):
    root = _stored(spark, sf)
    store.drop_expired(spark, root, "metrics", 10)
    return store.docs_per_index(spark.read.parquet(root))


# ---- filters ---------------------------------------------------------------------------------


@query("event_filter_type", f"WITH {I.DOCS} SELECT event_id, event_type, model_name FROM docs WHERE event_type = 'prediction'")
def event_filter_type(spark, sf):
    return ev.of_type(I.event_docs(spark, sf), "prediction").select(
        "event_id", "event_type", "model_name"
    )


@query("event_last_n_days", f"""WITH {I.DOCS} SELECT event_id, event_type, model_name FROM docs
WHERE event_type = 'model_training' AND model_name = 'gpt-4o' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS""")
def event_last_n_days(spark, sf):
    recent = ev.last_days(I.event_docs(spark, sf), 7)
    return (
        ev.of_type(recent, "model_training")
        .filter(F.col("model_name") == "gpt-4o")
        .select("event_id", "event_type", "model_name")
    )


@query("event_text_match", rf"""WITH {I.DOCS} SELECT event_id, message FROM docs
WHERE len(list_intersect(regexp_split_to_array(lower(message), '[^\p{{L}}\p{{N}}]+'), ['turbo', 'opus'])) > 0""")
def event_text_match(spark, sf):
    return ev.matching(I.event_docs(spark, sf), "message", ["Turbo", "opus"]).select(
        "event_id", "message"
    )


# ---- terms and numbers --------------------------------------------------------------------------


@query("event_terms_top", f"WITH {I.DOCS} SELECT level, count(*) AS docs FROM docs GROUP BY level ORDER BY docs DESC, level LIMIT 5")
def event_terms_top(spark, sf):
    return ev.top_terms(I.event_docs(spark, sf), "level", 5)


@query("event_terms_sum", f"""WITH {I.DOCS} SELECT model_name, {I.rnd('sum(value)')} AS total FROM docs
WHERE event_type = 'cost_analysis' GROUP BY model_name ORDER BY sum(value) DESC, model_name LIMIT 10""")
def event_terms_sum(spark, sf):
    costs = ev.of_type(I.event_docs(spark, sf), "cost_analysis")
    return I.rounded(ev.top_terms_by_sum(costs, "model_name", "value", 10))


@query("event_avg_by_key", f"""WITH {I.DOCS} SELECT model_name, {I.rnd('avg(r2)')} AS avg_r2, {I.rnd('avg(rmse)')} AS avg_rmse
FROM docs WHERE event_type = 'model_training' GROUP BY model_name""")
def event_avg_by_key(spark, sf):
    trainings = ev.of_type(I.event_docs(spark, sf), "model_training")
    return I.rounded(ev.averages_by(trainings, "model_name", "r2", "rmse"))


@query("event_count_by_key", f"WITH {I.DOCS} SELECT endpoint, count(*) AS docs FROM docs WHERE event_type = 'api_request' GROUP BY endpoint")
def event_count_by_key(spark, sf):
    return ev.count_by(ev.of_type(I.event_docs(spark, sf), "api_request"), "endpoint")


@query("event_sums", f"WITH {I.DOCS} SELECT CAST(sum(rows_processed) AS BIGINT) AS sum_rows_processed, {I.rnd('sum(value)')} AS sum_value FROM docs")
def event_sums(spark, sf):
    return I.rounded(ev.sums(I.event_docs(spark, sf), "rows_processed", "value"))


@query("event_numeric_histogram", "SELECT CAST(floor(value / 5) * 5 AS DOUBLE) AS bucket, count(*) AS docs FROM events GROUP BY 1")
def event_numeric_histogram(spark, sf):
    return ev.numeric_histogram(I.event_docs(spark, sf), "value", 5)


SQL_THROUGHPUT = "CASE WHEN processing_time_seconds > 0 THEN rows_processed / processing_time_seconds ELSE 0.0 END"


@query("event_throughput", f"""WITH {I.DOCS} SELECT event_id, {I.rnd(SQL_THROUGHPUT)} AS throughput_rows_per_sec FROM docs
WHERE event_type = 'data_processing'""")
def event_throughput(spark, sf):
    rate = ev.throughput("rows_processed", "processing_time_seconds")
    processing = ev.of_type(I.event_docs(spark, sf), "data_processing")
    return I.rounded(processing.select("event_id", rate.alias("throughput_rows_per_sec")))


# ---- series over time ------------------------------------------------------------------------------


def _series(name: str, kind: str | None, sql: str, aggregate, alias: str) -> None:
    where = f"WHERE event_type = '{kind}'" if kind else ""

    @query(name, f"WITH {I.DOCS} SELECT {DAY} AS day, {sql} AS {alias} FROM docs {where} GROUP BY 1")
    def run(spark, sf):
        docs = I.event_docs(spark, sf)
        docs = ev.of_type(docs, kind) if kind else docs
        return I.rounded(ev.over_time(docs, aggregate().alias(alias)).select(_day(), alias))


_series("event_avg_over_time", "prediction", I.rnd("avg(k)"), lambda: F.avg("k"), "avg_tokens")
_series("event_training_time_over_time", "model_training", I.rnd("avg(processing_time_seconds)"),
        lambda: F.avg("processing_time_seconds"), "avg_seconds")
_series("event_sum_over_time", "cost_analysis", I.rnd("sum(value)"), lambda: F.sum("value"), "total_saved")
_series("event_savings_pct_over_time", "data_processing", I.rnd("avg(value)"), lambda: F.avg("value"), "avg_savings_pct")
_series("event_rows_over_time", "data_processing", "CAST(sum(rows_processed) AS BIGINT)",
        lambda: F.sum("rows_processed"), "rows_processed")
_series("event_volume_over_time", None, "count(*)", lambda: F.count("*"), "docs")
_series("event_latency_over_time", "prediction", I.rnd("avg(value)"), lambda: F.avg("value"), "avg_ms")
_series("event_throughput_over_time", "data_processing", I.rnd(f"avg({SQL_THROUGHPUT})"),
        lambda: F.avg(ev.throughput("rows_processed", "processing_time_seconds")), "avg_throughput")
# Requests with k tokens in and twice as many out.
SQL_ESTIMATED_COST = I.rnd_shown("k / 1000.0::DOUBLE * 0.0015::DOUBLE + 2 * k / 1000.0::DOUBLE * 0.002::DOUBLE", 6)
_series("event_estimated_cost_over_time", "prediction", I.rnd(f"avg({SQL_ESTIMATED_COST})"),
        lambda: F.avg(request_cost("k", 2 * F.col("k"))), "avg_estimated_cost")


@query("event_multi_avg_over_time", f"""WITH {I.DOCS}, wide AS (
  SELECT {DAY} AS day, avg(mae) AS mae, avg(rmse) AS rmse, avg(r2) AS r2 FROM docs WHERE event_type = 'model_training' GROUP BY 1)
SELECT day, 'mae' AS metric, {I.rnd('mae')} AS average FROM wide
UNION ALL SELECT day, 'rmse', {I.rnd('rmse')} FROM wide UNION ALL SELECT day, 'r2', {I.rnd('r2')} FROM wide""")
def event_multi_avg_over_time(spark, sf):
    trainings = ev.of_type(I.event_docs(spark, sf), "model_training")
    series = ev.averages_over_time(trainings, ["mae", "rmse", "r2"])
    return I.rounded(series.select(_day(), "metric", "average"))


# ---- summaries ---------------------------------------------------------------------------------------


@query("event_training_summary", f"""WITH {I.DOCS} SELECT {I.rnd('avg(mae)')} AS average_mae, {I.rnd('avg(rmse)')} AS average_rmse,
  {I.rnd('avg(r2)')} AS average_r2, count(*) AS total_trainings FROM docs
WHERE event_type = 'model_training' AND model_name = 'gpt-4-turbo' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS""")
def event_training_summary(spark, sf):
    return I.rounded(ev.training_summary(I.event_docs(spark, sf), "gpt-4-turbo", 7))


@query("event_run_summary", f"""WITH {I.DOCS}, last AS (
  SELECT user_id AS run_id, event_type AS stage, status FROM docs
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)
SELECT run_id, coalesce(string_agg(stage, ',' ORDER BY stage) FILTER (WHERE status <> 'ok'), '') AS failed_stages,
  count(*) AS stage_count, CASE WHEN count(*) FILTER (WHERE status <> 'ok') > 0 THEN 'failed' ELSE 'ok' END AS status
FROM last GROUP BY run_id""")
def event_run_summary(spark, sf):
    stages = I.event_docs(spark, sf).select(
        F.col("user_id").alias("run_id"),
        F.col("event_type").alias("stage"),
        "status",
        F.struct("ts", "event_id").alias("at"),
    )
    return ev.run_summary(stages).withColumn("failed_stages", F.array_join("failed_stages", ","))


@query("event_alerts", f"""WITH {I.DOCS}, hours AS (
  SELECT date_trunc('hour', ts) AS h, avg(CASE WHEN status_code >= 500 THEN 1.0 ELSE 0.0 END) AS error_rate, avg(value) AS avg_latency_ms,
    count(*) FILTER (WHERE event_type = 'model_training' AND status <> 'ok') AS failed_trainings FROM docs GROUP BY 1)
SELECT strftime(h, '%Y-%m-%d %H:%M') AS hour, {I.rnd('error_rate')} AS error_rate, {I.rnd('avg_latency_ms')} AS avg_latency_ms,
  failed_trainings, error_rate > 0.1 AS high_error_rate, avg_latency_ms > 60 AS slow, failed_trainings > 0 AS training_failure
FROM hours WHERE error_rate > 0.1 OR avg_latency_ms > 60 OR failed_trainings > 0""")
def event_alerts(spark, sf):
    found = ev.alerts(
        I.event_docs(spark, sf),
        is_error=F.col("status_code") >= 500,
        latency_ms=F.col("value"),
        training_failed=(F.col("event_type") == "model_training") & (F.col("status") != "ok"),
        max_error_rate=0.1,
        max_latency_ms=60,
    )
    return I.rounded(
        found.withColumn("hour", F.date_format("bucket_start", "yyyy-MM-dd HH:mm")).drop("bucket_start")
    )
