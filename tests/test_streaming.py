import json
import os
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalog.inputs import MODEL
from turnledger.operators import events as ev, scoring
from turnledger.sources import event_commits as commits, event_store as store
from turnledger.streaming import histogram, ingest, prompts


def run(stream):
    stream.awaitTermination()


def test_ingest_resumes_and_fills_missing_times(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    out, mark = f"{tmp_path}/table", f"{tmp_path}/mark"
    lines = [
        {"timestamp": "2024-01-05T23:30:00Z", "event_type": "a"},
        {"timestamp": "2024-01-05T23:30:00-05:00", "event_type": "b"},
        {"timestamp": "not a time", "event_type": "c"},
        {"event_type": "d"},
    ]
    (feed / "1.json").write_text("\n".join(json.dumps(x) for x in lines[:2]))
    start = lambda: ingest.start_ingest(
        ingest.to_documents(ingest.read_event_lines(spark, str(feed)), tag="t"), out, mark, availableNow=True
    )
    run(start())
    (feed / "2.json").write_text("\n".join(json.dumps(x) for x in lines[2:]))
    run(start())
    run(start())
    # A file of a batch that never committed is not part of the table.
    stray = next((tmp_path / "table" / "index_prefix=logs" / "index_date=2024.01.05").glob("*.parquet"))
    (stray.parent / "part-stray.parquet").write_bytes(stray.read_bytes())
    got = store.read_index(spark, out, "logs").collect()
    assert len(got) == 4 and {r.index_prefix for r in got} == {"logs"}
    got = {r.event_type: r for r in got}
    assert len(got) == 4 and {r.pipeline for r in got.values()} == {"t"}
    assert got["a"].index_date == "2024.01.05" and got["b"].index_date == "2024.01.06"
    today = datetime.now() - timedelta(days=1)
    assert got["c"]["@timestamp"] > today and got["d"]["@timestamp"] > today


def events(spark, tmp_path):
    path = f"{tmp_path}/events"
    spark.range(500).select(
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 600).alias("ts"),
        (F.col("id") % 3).cast("string").alias("kind"),
        F.col("id").cast("double").alias("value"),
    ).repartition(5).write.parquet(path)
    return path


@pytest.mark.parametrize("compact_every", [20, 1, 2])
def test_histogram_snapshot_equals_batch(spark, tmp_path, compact_every):
    path = events(spark, tmp_path)
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 2).parquet(path)
    aggregates = lambda: [F.count("*").alias("n"), F.sum("value").alias("total")]
    series = histogram.windowed(stream, *aggregates(), bucket="6 hours", watermark="30 days", keys=["kind"])
    with pytest.raises(FileNotFoundError):
        histogram.read_snapshot(spark, f"{tmp_path}/s", ["kind"])
    run(histogram.start_snapshot(series, f"{tmp_path}/s", f"{tmp_path}/sm", ["kind"], compact_every=compact_every, availableNow=True))
    want = ev.over_time(batch, *aggregates(), bucket="6 hours", keys=["kind"])
    columns = ["bucket_start", "kind", "n", "total"]
    snapshot = lambda: sorted(histogram.read_snapshot(spark, f"{tmp_path}/s", ["kind"]).select(columns).collect())
    assert snapshot() == sorted(want.select(columns).collect())
    names = [n for n in os.listdir(f"{tmp_path}/s") if not n.startswith(".")]
    assert any(n.startswith("whole-") for n in names) == (compact_every < 20)
    # A version that is being written is not part of the table.
    last = max((n for n in names if n.startswith("changed-")), key=lambda n: int(n.split("-")[1]))
    shutil.copytree(f"{tmp_path}/s/{last}", f"{tmp_path}/s/changed-99")
    os.remove(f"{tmp_path}/s/changed-99/_SUCCESS")
    assert snapshot() == sorted(want.select(columns).collect())


def test_append_writes_closed_windows_once(spark, tmp_path):
    path = events(spark, tmp_path)
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).parquet(path)
    series = histogram.windowed(stream, F.count("*").alias("n"), bucket="6 hours", watermark="1 hour")
    run(histogram.start_append(series, f"{tmp_path}/a", f"{tmp_path}/am", availableNow=True))
    got = {(r.bucket_start, r.n) for r in spark.read.parquet(f"{tmp_path}/a").collect()}
    want = {(r.bucket_start, r.n) for r in ev.over_time(batch, F.count("*").alias("n"), bucket="6 hours").collect()}
    assert got < want and len(want) - len(got) == 1


def test_scoring_equals_batch(spark, tmp_path):
    texts = ["Please explain recursion", "", None, "How? ```x```", "the and of"] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "i int, prompt string")
    df.write.parquet(f"{tmp_path}/p")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/p")
    answers = prompts.scored(stream, MODEL, partitions=3)
    run(prompts.start_scoring(answers, f"{tmp_path}/a", f"{tmp_path}/m", availableNow=True))
    got = spark.read.parquet(f"{tmp_path}/a")
    want = scoring.score_prompts(df, MODEL)
    assert sorted(got.collect(), key=lambda r: r.i) == sorted(want.select(got.columns).collect(), key=lambda r: r.i)


def test_ingest_keeps_fields_times_and_bad_lines(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    lines = [
        json.dumps({"@timestamp": "2024-01-05T23:30:00", "event_type": "log", "logger": "x.y", "metrics": {"a": 1.5}}),
        json.dumps({"timestamp": "2024-01-07T10:00:00Z", "@timestamp": "2020-01-01T00:00:00Z", "value": 2.5}),
        '{"event_type": "cu',
        '{"event_id": "no number", "line": 3}',
        "  ",
    ]
    (feed / "1.json").write_text("\n".join(lines))
    docs = ingest.to_documents(ingest.read_event_lines(spark, str(feed)))
    out = f"{tmp_path}/table"
    run(ingest.start_ingest(ingest.well_formed(docs), out, f"{tmp_path}/a", availableNow=True))
    run(ingest.start_ingest(ingest.malformed(docs), out, f"{tmp_path}/b", store.CORRUPT_PREFIX, availableNow=True))
    good = {r.index_date: r for r in store.read_index(spark, out, "logs").collect()}
    assert set(good) == {"2024.01.05", "2024.01.07"}
    assert good["2024.01.05"].fields == {"logger": "x.y", "metrics": '{"a":1.5}'} and good["2024.01.07"].value == 2.5
    bad = store.read_index(spark, out, store.CORRUPT_PREFIX).collect()
    assert sorted(r._corrupt_record for r in bad) == sorted(lines[2:4])


def line(day, hour, kind):
    return json.dumps({"timestamp": f"2024-01-{day:02d}T{hour:02d}:00:00Z", "event_type": kind})


def test_good_and_bad_lines_from_one_read(spark, tmp_path):
    feed, out = tmp_path / "feed", f"{tmp_path}/table"
    feed.mkdir()
    (feed / "1.json").write_text("\n".join([line(d, h, f"a{d}.{h}") for d in (1, 2, 3) for h in range(8)] + ["{cut", " "]))
    docs = lambda: ingest.to_documents(ingest.read_event_lines(spark, str(feed)))
    start = lambda mark: ingest.start_line_ingest(docs(), out, f"{tmp_path}/{mark}", availableNow=True)
    run(start("m"))
    (feed / "2.json").write_text("\n".join([line(3, 9, "late"), line(4, 1, "new")]))
    run(start("m"))
    run(start("m"))
    kinds = lambda: sorted(r.event_type for r in commits.read_committed(spark, out, "logs").collect())
    want = sorted([f"a{d}.{h}" for d in (1, 2, 3) for h in range(8)] + ["late", "new"])
    assert kinds() == want
    bad = commits.read_committed(spark, out, store.CORRUPT_PREFIX).collect()
    assert [r._corrupt_record for r in bad] == ["{cut"]
    for folder in (tmp_path / "table" / "index_prefix=logs").glob("index_date=*/commit=*"):
        assert len(list(folder.glob("part-*"))) == 1
    # A stream that has lost its checkpoint repeats its first commit: nothing is added.
    run(start("other"))
    assert kinds() == want
    both = commits.read_committed(spark, out, "logs", store.CORRUPT_PREFIX)
    assert both.count() == len(want) + 1
    days = {(r.index_prefix, r.index_date): r.docs for r in commits.docs_per_day(commits.manifest(spark, out)).collect()}
    assert [days["logs", f"2024.01.0{d}"] for d in (1, 2, 3, 4)] == [8, 8, 9, 1]
    # Days expire at once, for the manifest and for readers.
    assert store.drop_expired(spark, out, "logs", 1) == ["2024.01.01", "2024.01.02"]
    assert kinds() == sorted(k for k in want if not k.startswith(("a1", "a2")))
    assert store.index_days(spark, out, "logs") == ["2024.01.03", "2024.01.04"]


def test_unfinished_commit_is_not_read_and_may_be_repeated(spark, tmp_path):
    out = f"{tmp_path}/table"
    rows = spark.createDataFrame([(1, "2024-01-05"), (2, "2024-01-06"), (3, None)], "i int, day string").select(
        "i", F.to_timestamp("day").alias("@timestamp"), F.date_format(F.to_date("day"), "yyyy.MM.dd").alias("index_date"),
        F.lit("logs").alias("index_prefix"))
    numbers = lambda **days: sorted(r.i for r in commits.read_committed(spark, out, "logs", schema=rows.select("i").schema, **days).collect())
    assert numbers() == [] and commits.manifest(spark, out).count() == 0
    commits.commit(rows.limit(0), out, "b-0")
    assert numbers() == []
    commits.commit(rows, out, "b-1")
    commits.commit(rows.withColumn("i", F.col("i") + 10), out, "b-2")
    shutil.rmtree(f"{out}/_manifest/b-2")
    assert numbers() == [1, 2, 3]
    commits.commit(rows.withColumn("i", F.col("i") + 10), out, "b-2")
    commits.commit(rows, out, "b-1")
    assert numbers() == [1, 2, 3, 11, 12, 13]
    assert numbers(first_day="2024.01.06", last_day="2024.01.06") == [2, 12]
    files = commits.read_committed(spark, out, "logs", first_day="2024.01.06", last_day="2024.01.31").inputFiles()
    documents = [f for f in files if "_manifest" not in f]
    assert len(documents) == 2 and all("2024.01.06" in f for f in documents)


def test_last_days_of_commits(spark, tmp_path):
    out = f"{tmp_path}/table"
    rows = spark.range(48).select("id", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 6 * 3600).alias("@timestamp"))
    docs = rows.withColumns({"index_date": store.index_day(rows, "@timestamp"), "index_prefix": F.lit("logs")})
    commits.commit(docs.filter("id < 20"), out, "b-0")
    commits.commit(docs.filter("id >= 20"), out, "b-1")
    got = commits.last_days(spark, out, "logs", 3)
    assert sorted(r.id for r in got.collect()) == list(range(35, 48))
    assert commits.last_days(spark, out, "none", 3, rows.schema).count() == 0


def test_days_of_a_stream_expire_while_it_runs_on(spark, tmp_path):
    feed, out = tmp_path / "feed", f"{tmp_path}/table"
    feed.mkdir()
    (feed / "1.json").write_text("\n".join(line(d, 0, str(d)) for d in range(1, 8)))
    docs = lambda: ingest.to_documents(ingest.read_event_lines(spark, str(feed)))
    start = lambda: ingest.start_ingest(docs(), out, f"{tmp_path}/m", availableNow=True)
    run(start())
    days = lambda: sorted(int(r.event_type) for r in store.read_index(spark, out, "logs").collect())
    assert store.drop_expired(spark, out, "logs", 2) == [f"2024.01.0{d}" for d in range(1, 5)]
    assert days() == [5, 6, 7]
    (feed / "2.json").write_text("\n".join([line(2, 0, "2"), line(9, 0, "9")]))
    run(start())
    assert days() == [5, 6, 7, 9]
    assert store.drop_expired(spark, out, "logs", 2) == ["2024.01.05", "2024.01.06"] and days() == [7, 9]
    # Marks never go back.
    assert store.drop_expired(spark, out, "logs", 30) == [] and days() == [7, 9]


@pytest.mark.parametrize("folder", [False, True])
def test_tables_of_one_file_and_folders_of_files_are_streams(spark, tmp_path, folder):
    """A table beside them, whose files must not be read with theirs, is there as well."""
    sf = f"{tmp_path}/sf"
    texts = [(i, f"What is word {i}? " * i) for i in range(60)] + [(None, None)]
    times = [(datetime(2024, 1, 1) + timedelta(hours=i), "ab"[i % 2], i / 2) for i in range(60)]
    tables = {
        "documents": spark.createDataFrame(texts, "doc_id long, text string"),
        "events": spark.createDataFrame(times, "ts timestamp_ntz, event_type string, value double"),
        "labels": spark.createDataFrame([(1, "b")], "doc_id long, text string"),
    }
    for name, rows in tables.items():
        if folder:
            rows.repartition(3).write.parquet(f"{sf}/{name}.parquet")
        else:
            rows.coalesce(1).write.parquet(f"{tmp_path}/{name}")
            os.makedirs(sf, exist_ok=True)
            shutil.copy(next((tmp_path / name).glob("part-*.parquet")), f"{sf}/{name}.parquet")
    queries = entry.queries()
    columns = ["doc_id", "input_tokens", "output_tokens", "estimated_cost", "question_flag"]
    want = queries["score_prompts"](spark, sf).select(columns)
    got = queries["stream_score_prompts"](spark, sf)
    assert got.columns == columns and got.count() == 61
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert queries["stream_event_histogram"](spark, sf).agg(F.sum("docs")).collect() == [(60,)]
    # The last day is still open, and so is the day whose end is less than an hour ago.
    assert queries["stream_event_closed_windows"](spark, sf).agg(F.sum("docs")).collect() == [(48,)]
