import json
import random
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from turnledger.operators import events as ev
from turnledger.sources import conversations as files, event_store as store, tables
from turnledger.sources import json_array
from turnledger.sources.json_array import array_elements

BITS = ["{", "}", "[", "]", '"', "\\", '\\"', ",", "},{", '}, {"id"', "é", "\n", " ", "a", "\t", "]}"]


def awkward_records(n=150):
    """Records whose texts are full of brackets, quotes and backslashes."""
    rng = random.Random(3)
    text = lambda: "".join(rng.choice(BITS) for _ in range(rng.randint(0, 30)))
    return [
        {
            "id": text() if i % 3 else None,
            "conversations": [{"from": text(), "value": text()} for _ in range(rng.randint(0, 4))],
            "more": {"deep": [1, {"x": {}}], "none": None},
        }
        for i in range(n)
    ]


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "997", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_array_to_jsonl_inside_one_file(spark, tmp_path, small_splits):
    records = awkward_records()
    (tmp_path / "pretty.json").write_text(json.dumps(records, indent=2))
    (tmp_path / "dense.json").write_text(json.dumps(records[::-1], ensure_ascii=False, separators=(",", ":")))
    (tmp_path / "none.json").write_text("[ ]\n")
    assert spark.read.option("lineSep", "}").text(f"{tmp_path}/pretty.json").rdd.getNumPartitions() > 20
    written = files.json_array_to_jsonl(spark, f"{tmp_path}/*.json", f"{tmp_path}/out")
    got = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/out").collect()]
    canonical = lambda rs: sorted(json.dumps(r, sort_keys=True) for r in rs)
    assert written == 300 and canonical(got) == canonical(records * 2)
    in_order = array_elements(spark, f"{tmp_path}/pretty.json").orderBy("element").collect()
    assert [json.loads(r.value) for r in in_order] == records
    assert files.json_array_to_jsonl(spark, f"{tmp_path}/pretty.json", f"{tmp_path}/few", limit=7) == 7
    few = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/few").collect()]
    assert canonical(few) == canonical(records[:7])


def test_cut_off_array_is_refused(spark, tmp_path):
    path = tmp_path / "cut.json"
    path.write_text(json.dumps(awkward_records(20))[:-30])
    with pytest.raises(ValueError, match="cut.json"):
        array_elements(spark, str(path))


def test_jsonl_sibling_is_preferred(spark, tmp_path):
    array, lines = tmp_path / "raw.json", tmp_path / "raw.jsonl"
    array.write_text(json.dumps([{"id": "array", "conversations": []}, {"id": "b", "conversations": None}]))
    assert {r.id for r in files.read_conversations(spark, str(array)).collect()} == {"array", "b"}
    lines.write_text('{"id": "line", "conversations": [{"from": "human", "value": null}]}\n')
    got = files.read_conversations(spark, str(array)).collect()
    assert [(r.id, r.conversations[0].value) for r in got] == [("line", None)]


def test_csv_with_and_without_schema(spark, tmp_path):
    path = f"{tmp_path}/t"
    df = spark.createDataFrame([(1, "a,b", 1.5), (2, 'q"x', None)], "i int, s string, d double")
    df.write.option("header", True).csv(path)
    assert dict(tables.read_csv(spark, path).dtypes) == {"i": "int", "s": "string", "d": "double"}
    assert tables.read_csv(spark, path, "i long, s string, d double").filter("i = 1").first().s == "a,b"


def test_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    assert tables.spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == cores
    assert tables.spread(spark.range(100, numPartitions=50)).rdd.getNumPartitions() == 50


def event_rows(spark):
    rows = [(i, datetime(2024, 1, 1 + i % 5, 23, 30), "prediction") for i in range(50)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string")


def test_event_table_prunes_folders(spark, tmp_path):
    root = f"{tmp_path}/events"
    store.append(store.documents(event_rows(spark), "metrics"), root)
    store.append(store.documents(event_rows(spark).limit(3), "logs"), root)
    docs = store.read_index(spark, root, "metrics", "2024.01.02", "2024.01.03")
    assert docs.count() == 20
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(index_date" in plan
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("absent", T.StringType())])
    given = store.read_index(spark, root, "logs", schema=schema)
    assert given.columns == ["event_id", "absent", "index_prefix", "index_date"] and given.count() == 3
    per_index = store.docs_per_index(spark.read.parquet(root)).collect()
    assert [r.index_name for r in per_index][:1] == ["logs-2024.01.01"] and per_index[-1].docs == 10
    recent = ev.last_days_of_index(docs, 1, datetime(2024, 1, 3, 23, 30))
    assert recent.count() == 20
    kept = ev.retained(spark.read.parquet(root).filter("index_prefix = 'metrics'"), 1)
    assert {r.index_date for r in kept.collect()} == {"2024.01.04", "2024.01.05"}


def test_index_day_is_utc_in_any_session(spark):
    zoned = event_rows(spark).withColumn("ts", F.col("ts").cast("timestamp"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    days = {f"2024.01.0{d}" for d in range(1, 6)}
    try:
        rows = spark.createDataFrame(zoned.collect(), zoned.schema)
        for name in ("UTC", "Asia/Tokyo", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", name)
            for df in (rows, event_rows(spark)):
                docs = store.documents(df, "metrics")
                assert {r.index_date for r in docs.select("index_date").collect()} == days
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_bulk_append_counts_and_keeps_bad_rows(spark, tmp_path):
    schema = T.StructType([T.StructField("timestamp", T.StringType()), T.StructField("n", T.LongType())])
    lines = ['{"timestamp":"2024-01-05T10:00:00Z","n":1}', '{"n":', '{"timestamp":"2024-01-05","n":"x"}', '{"n":4}']
    df = spark.createDataFrame([(t,) for t in lines], "value string")
    assert store.bulk_append(df, schema, f"{tmp_path}/b", "events") == {"indexed": 2, "failed": 2}
    bad = store.read_index(spark, f"{tmp_path}/b", store.CORRUPT_PREFIX)
    assert sorted(r._corrupt_record for r in bad.collect()) == sorted(lines[1:3])
    good = store.read_index(spark, f"{tmp_path}/b", "events")
    assert {(r.n, r.index_date) for r in good.collect()} == {(1, "2024.01.05"), (4, "unknown")}


def test_chunks_are_counted_in_order_whatever_the_splits(spark):
    schema = T.StructType([T.StructField("n", T.LongType())])
    lines = [(i, '{"n":' if i % 7 == 0 else f'{{"n":{i}}}') for i in range(0, 2460, 2)]
    bad = [sum(p % 7 == 0 for p, _ in lines[a:a + 250]) for a in range(0, 1230, 250)]
    for parts in (1, 9):
        df = spark.createDataFrame(lines[::-1], "place long, value string").repartition(parts)
        got = sorted(tuple(r) for r in store.chunk_counts(df, schema, "place", 250).collect())
        assert got == [(c, min(250, 1230 - 250 * c) - b, b) for c, b in enumerate(bad)]
    assert store.chunk_counts(df.limit(0), schema, "place").collect() == []


@pytest.mark.parametrize("text", ['[{"id": "a", "n": 1}, {"id": "b" "n": 2}, {"id": "c"}]', '[{"id": "a"}], [{"id": "b"}]'])
def test_invalid_element_is_refused(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="not valid JSON: element 1"):
        files.json_array_to_jsonl(spark, f"{tmp_path}/bad.json", f"{tmp_path}/out")


def test_array_reader_splits_files(spark, tmp_path):
    key = "spark.sql.files.maxPartitionBytes"
    size = spark.conf.get(key)
    rows = [{"id": str(i), "conversations": [{"from": "human", "value": 'a "}]{ ' * 9}]} for i in range(300)]
    (tmp_path / "a.json").write_text(json.dumps([*rows, {"id": "none", "conversations": None}], indent=1))
    (tmp_path / "empty.json").write_text("[]")
    try:
        spark.conf.set(key, "4k")
        got = files.read_json_array(spark, f"{tmp_path}/*.json").collect()
    finally:
        spark.conf.set(key, size)
    assert {r.id for r in got} == {*map(str, range(300)), "none"} and len(got) == 301
    assert {r.conversations[0].value for r in got if r.conversations} == {'a "}]{ ' * 9}


def test_times_without_zone_are_utc_in_any_session(spark):
    texts = ["2024-01-05T23:30:00", "2024-01-05 23:30:00Z", "2024-01-05T18:30:00-05:00", "2024-01-06T01:30:00.000+0200",
             "2024-01-05", "soon", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", name)
            got = [r[0] for r in df.orderBy("i").select(F.unix_seconds(store.event_time("t"))).collect()]
            assert got == [1704497400] * 4 + [1704412800] + [None] * 3
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_expired_days_are_removed(spark, tmp_path):
    root = f"{tmp_path}/events"
    assert store.drop_expired(spark, root, "metrics", 1) == []
    store.append(store.documents(event_rows(spark), "metrics"), root)
    store.append(store.documents(event_rows(spark), "logs"), root)
    assert store.drop_expired(spark, root, "metrics", 1) == ["2024.01.01", "2024.01.02", "2024.01.03"]
    assert store.index_days(spark, root, "metrics") == ["2024.01.04", "2024.01.05"]
    assert len(store.index_days(spark, root, "logs")) == 5 and spark.read.parquet(root).count() == 70


def test_lines_are_not_an_array(spark, tmp_path):
    (tmp_path / "lines.txt").write_text('{"id": "1", "conversations": []}\n{"id": "2", "conversations": []}\n')
    with pytest.raises(ValueError, match="lines.txt"):
        files.read_json_array(spark, f"{tmp_path}/lines.txt").collect()
    (tmp_path / "spaced.json").write_text(' \n[ {"id": "1", "conversations": []}]\n')
    assert [r.id for r in files.read_json_array(spark, f"{tmp_path}/spaced.json").collect()] == ["1"]


def plain_depths(text, inside):
    """At each `}`: is it outside of strings, and the depth after it, character by character."""
    depth, out, at = 0, [], 0
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 1
        elif c == '"':
            inside = not inside
        elif not inside:
            depth += (c in "{[") - (c in "}]")
        if c == "}":
            out.append((not inside, depth))
        at += 1
    return out


def test_sums_of_pieces_against_single_characters(monkeypatch):
    rng = random.Random(11)
    monkeypatch.setattr(json_array, "SLICE", 40)
    for _ in range(60):
        parts = [rng.choice(['"', "{", "[", "]", "a", "é", "\\\\", '\\"', "\\n", "}", "}"]) for _ in range(90)]
        text = "".join(parts) + "}"
        pieces = text.split("}")[:-1]
        rows = range(100, 100 + len(pieces))
        sums = json_array._Sums(pieces[0])
        batch = pa.RecordBatch.from_pydict({"file": ["f"] * len(pieces), "block": [0] * len(pieces), "row": list(rows), "value": pieces})
        for _, part in json_array._runs(batch):
            sums.add(part.column("value"), part.column("row").to_numpy())
        got = sums.row(("f", 0))
        for state in (0, 1):
            plain = plain_depths(text, bool(state))
            at = {}
            for row, (outside, depth) in zip(rows, plain):
                if outside:
                    at.setdefault(depth, []).append(row)
            kept = [x for x in sorted(at) if x < min(at) + 3]
            assert got[f"change_{state}"] == plain[-1][1]
            assert got[f"levels_{state}"] == [{"level": x, "n": len(at[x]), "first": at[x][0], "last": at[x][-1]} for x in kept]


@pytest.mark.parametrize("sent_blocks", [0, 1000])
def test_states_of_blocks_are_sent_or_joined(spark, tmp_path, small_splits, sent_blocks):
    records = awkward_records(80)
    # One element fills many blocks, and a file has no elements.
    records[40]["more"] = [{"long": "x } \\" * 30} for _ in range(60)]
    (tmp_path / "a.json").write_text(json.dumps(records, indent=1))
    (tmp_path / "none.json").write_text("[]")
    got = array_elements(spark, f"{tmp_path}/*.json", sent_blocks).orderBy("element").collect()
    assert [json.loads(r.value) for r in got] == records
    assert [r.element for r in got] == list(range(80)) and all("\n" not in r.value for r in got)


def test_array_text_is_neither_staged_nor_shuffled(spark, tmp_path, monkeypatch):
    (tmp_path / "a.json").write_text(json.dumps([{"id": str(i), "conversations": []} for i in range(50)]))
    folder = f"{tmp_path}/staged"
    monkeypatch.setattr(json_array, "staging_path", lambda spark, name: folder)
    elements = array_elements(spark, f"{tmp_path}/a.json")
    assert elements.count() == 50
    assert "Exchange hashpartitioning" not in elements._jdf.queryExecution().executedPlan().toString()
    staged = [spark.read.parquet(f"{folder}/{name}").columns for name in ("sums", "starts")]
    assert not any("value" in columns for columns in staged)


@pytest.mark.parametrize("text", ['[{"a": 1}]]', '{"a": [{"b": 1}]}', '[{"a": "}]', "", "null"])
def test_what_is_no_array_is_refused(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text or " ")
    with pytest.raises(ValueError, match="x.json"):
        array_elements(spark, f"{tmp_path}/x.json")


def test_thin_days_share_a_folder_per_year(spark, tmp_path):
    """800 days and a document without one: a few folders instead of 801, the same answers."""
    at = F.expr("timestamp_ntz'2022-12-31 12:00:00' + make_interval(0, 0, 0, id)")
    rows = spark.range(800).select("id", F.when(F.col("id") != 5, at).alias("ts"))
    docs = store.documents(rows, "metrics").withColumn("index_date", F.coalesce("index_date", F.lit(store.UNKNOWN_DAY)))
    by_day, by_year = f"{tmp_path}/d", f"{tmp_path}/y"
    store.append(docs, by_day)
    store.append(docs, by_year, by_year=True)
    assert len(list((tmp_path / "y").rglob("part-*.parquet"))) <= 20
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("absent", T.StringType())])

    def same(first=None, last=None):
        for given in (None, schema):
            want, got = (store.read_index(spark, r, "metrics", first, last, given) for r in (by_day, by_year))
            assert got.columns == want.columns and got.dtypes == want.dtypes
            assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
        assert store.index_days(spark, by_day, "metrics") == store.index_days(spark, by_year, "metrics")
        return want.count()

    assert same() == 800 and same("2023.12.30", "2024.01.02") == 4 and same(last="2022.12.31") == 1
    files = store.read_index(spark, by_year, "metrics", "2023.12.30", "2023.12.31")
    assert "PartitionFilters: [isnotnull(index_year" in files._jdf.queryExecution().executedPlan().toString()
    for root in (by_day, by_year):
        assert len(store.drop_expired(spark, root, "metrics", 30)) == 768
    assert same() == 32
    assert [p.name for p in (tmp_path / "y" / "_years" / "index_prefix=metrics").glob("index_year=20*")] == ["index_year=2025"]
    # A prefix may have both.
    late = store.documents(rows.filter("id = 799").withColumn("more", F.lit(1)), "metrics")
    store.append(late, by_year)
    both = store.read_index(spark, by_year, "metrics")
    assert both.count() == 33 and both.columns[-2:] == ["index_prefix", "index_date"]
    assert sorted(r.more for r in both.filter("id = 799").collect() if r.more) == [1]
