from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from turnledger.operators import events as ev

T0 = datetime(2024, 3, 1)


def series(spark):
    rows = [
        (i, T0 + timedelta(hours=6 * i), "model_training" if i % 2 else "prediction", f"m{i % 3}", float(i),
         None if i == 5 else i / 10.0)
        for i in range(40)
    ]
    return spark.createDataFrame(
        rows, "i int, ts timestamp_ntz, event_type string, model_name string, mae double, rmse double"
    ).withColumn("r2", F.col("mae") / 100)


def test_last_days_with_given_and_latest_time(spark):
    df = series(spark)
    latest = T0 + timedelta(hours=6 * 39)
    assert {r.i for r in ev.last_days(df, 2).collect()} == set(range(31, 40))
    assert ev.last_days(df, 2, as_of=latest).count() == 9
    plan = ev.last_days(df, 2, as_of=latest)._jdf.queryExecution().optimizedPlan().toString()
    assert "interval" not in plan.lower()


def test_given_time_is_utc_in_any_session(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    df = series(spark)
    instants = df.withColumn("ts", F.col("ts").cast("timestamp"))
    fixed = spark.createDataFrame(instants.collect(), instants.schema)
    latest = T0 + timedelta(hours=6 * 39)
    aware = latest.replace(tzinfo=timezone.utc).astimezone(timezone(timedelta(hours=5)))
    try:
        for name in ("UTC", "Asia/Tokyo", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", name)
            for as_of in (latest, aware):
                assert ev.last_days(df, 2, as_of=as_of).count() == 9
                assert ev.last_days(fixed, 2, as_of=as_of).count() == 9
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_training_summary(spark):
    s = ev.training_summary(series(spark), "m1", 3).first()
    wanted = [i for i in range(27, 40) if i % 2 and i % 3 == 1]
    assert s.total_trainings == len(wanted) and s.average_mae == pytest.approx(sum(wanted) / len(wanted))
    none = ev.training_summary(series(spark), "absent", 3).first()
    assert none.total_trainings == 0 and none.average_mae is None


def test_terms_and_histogram(spark):
    df = series(spark)
    assert [(r.model_name, r.docs) for r in ev.top_terms(df, "model_name", 2).collect()] == [("m0", 14), ("m1", 13)]
    assert [r.model_name for r in ev.top_terms_by_sum(df, "model_name", "mae", 1).collect()] == ["m0"]
    buckets = {r.bucket: r.docs for r in ev.numeric_histogram(df, "rmse", 1).collect()}
    assert buckets == {0.0: 9, 1.0: 10, 2.0: 10, 3.0: 10}


def test_series_over_time(spark):
    rows = ev.averages_over_time(series(spark), ["mae", "r2"]).collect()
    assert len(rows) == 20
    first = {r.metric: r.average for r in rows if r.bucket_start == T0}
    assert first["mae"] == 1.5 and first["r2"] == pytest.approx(0.015)


def test_throughput(spark):
    df = spark.createDataFrame([(100, 4.0), (100, 0.0)], "n int, s double")
    assert [r[0] for r in df.select(ev.throughput("n", "s")).collect()] == [25.0, 0.0]


def test_run_summary_takes_last_status(spark):
    rows = [
        (1, "preprocess", "ok", 1), (1, "train", "error", 2), (1, "train", "ok", 3),
        (2, "preprocess", "ok", 1), (2, "train", "ok", 1), (2, "train", "error", 2), (2, "cost", None, 1),
    ]
    df = spark.createDataFrame(rows, "run_id int, stage string, status string, at int")
    got = {r.run_id: r for r in ev.run_summary(df).collect()}
    assert (got[1].failed_stages, got[1].stage_count, got[1].status) == ([], 2, "ok")
    assert (got[2].failed_stages, got[2].stage_count, got[2].status) == (["cost", "train"], 3, "failed")
    local = ev.run_summary(df, all_good="success", some_failed="partial")
    assert {r.run_id: r.status for r in local.collect()} == {1: "success", 2: "partial"}


def test_alerts(spark):
    rows = [(T0, 500, 10.0), (T0, 200, 10.0), (T0 + timedelta(hours=1), 200, 90.0), (T0 + timedelta(hours=2), 200, 1.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, code int, ms double")
    found = ev.alerts(df, F.col("code") >= 500, F.col("ms"), F.lit(False), 0.2, 50).orderBy("bucket_start").collect()
    assert [(r.high_error_rate, r.slow, r.training_failure) for r in found] == [(True, False, False), (False, True, False)]


def test_documents_of_jobs(spark, tmp_path):
    from turnledger.operators import ml
    from turnledger.sources import event_store as store

    metrics = spark.createDataFrame([("m", "t", "y", 2.0, 1.0, 0.5, 10, 3.5, None)], ml.METRICS_SCHEMA).withColumn(
        "dataset_size", F.lit(1000)
    )
    docs = ev.training_documents(metrics, T0)
    store.append(store.documents(docs, "metrics"), f"{tmp_path}/e")
    back = store.read_index(spark, f"{tmp_path}/e", "metrics").select("*", "metrics.*")
    assert ev.training_summary(back, "m", 7).first().average_rmse == 2.0
    assert back.first().metrics.dataset_size == 1000 and back.first().index_date == "2024.03.01"
    stats = spark.createDataFrame([(50, 0.5)], "total_turns int, avg_savings_pct double")
    job = ev.processing_document(stats, "total_turns", "preprocess", 4.0, T0).first()
    assert (job.rows_processed, job.throughput_rows_per_sec, job.avg_savings_pct) == (50, 12.5, 0.5)
