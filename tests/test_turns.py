import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from turnledger.operators import normalize, sampling, stats, turns as T
from turnledger.plans.preprocess import preprocess
from turnledger.schemas import SEGMENTED_CONVERSATION, TURN_COLUMNS
from turnledger.sources import conversations as files

SCHEMA = "id string, conversations array<struct<from:string,value:string>>"


def test_goldens_of_the_synthetic_set(spark, conversations):
    turns = T.turn_features(conversations)
    assert turns.columns == TURN_COLUMNS
    s = stats.corpus_stats(turns).first()
    assert (s.total_turns, s.total_conversations) == (800, 200)
    assert turns.filter("has_code_block").count() == 200
    assert turns.select("conversation_turn_count").distinct().first()[0] == 4
    first = turns.filter("record_id = 'test_3' AND turn_index = 0").first()
    assert (first.token_count, first.optimized_token_count, first.token_savings) == (8, 5, 3)
    assert first.savings_pct == 37.5 and first.is_human and first.optimized_text == "explain concept 3 in detail"
    last = turns.filter("record_id = 'test_3' AND turn_index = 3").first()
    assert (last.token_count, last.optimized_token_count) == (4, 3) and not last.is_human


def edge_rows(spark):
    return spark.createDataFrame(
        [
            ("null", None),
            ("empty", []),
            ("mixed", [("human", None), (None, "x y"), ("system", "   "), ("gpt", "\n"), ("human", "...")]),
        ],
        SCHEMA,
    )


def test_edge_rows(spark):
    rows = {r.turn_index: r for r in T.turn_features(edge_rows(spark)).collect()}
    # Null and blank turns go after they have been counted; newlines are not blank.
    assert sorted(rows) == [1, 3, 4]
    assert {r.conversation_turn_count for r in rows.values()} == {5}
    assert rows[1].is_human is False and rows[3].token_count == 2
    assert rows[4].optimized_token_count == 1 and rows[4].optimized_text == ""


def test_flat_and_nested_shapes_agree(spark, conversations):
    both = conversations.unionByName(edge_rows(spark))
    flat = T.explode_turns(both).drop("conversation_turn_count")
    assert sorted(T.flat_turn_features(flat).collect(), key=str) == sorted(
        T.turn_features(both).collect(), key=str
    )


@pytest.mark.parametrize("segment", [1, 3, 4, 100])
def test_segments_of_long_conversations(spark, segment):
    turns = spark.range(23).select(
        F.lit("long").alias("record_id"),
        F.col("id").cast("int").alias("turn_index"),
        F.lit("gpt").alias("role"),
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("value"),
    )
    nested = normalize.nest_turns(turns, segment)
    assert nested.agg(F.max(F.size("conversations"))).first()[0] == min(segment, 23)
    back = T.explode_turns(nested).orderBy("turn_index").collect()
    assert [(r.turn_index, r.value) for r in back] == [(i, f"t{i}") for i in range(23)]
    assert {r.conversation_turn_count for r in back} == {23}


def segments(spark, path):
    """Conversation a in three rows, b in one, a row without id, c whose rows repeat one."""
    turn = lambda i: {"from": "human", "value": f"turn {i}"}
    rows = [("a", 0, 4), ("a", 4, 4), ("a", 8, 2), ("b", None, 3), (None, 0, 2), (None, 5, 1), ("c", 0, 1)]
    lines = [json.dumps({"id": i, "first_turn": f, "conversations": [turn(k) for k in range(n)]}) for i, f, n in rows]
    (path / "raw.jsonl").write_text("\n".join(lines))
    return files.read_conversations(spark, f"{path}/raw.jsonl", SEGMENTED_CONVERSATION)


COUNTS = {("a", 10): 10, ("b", 3): 3, (None, 2): 2, (None, 1): 1, ("c", 1): 1}


def of_counts(turns):
    return Counter((r.record_id, r.conversation_turn_count) for r in turns.collect())


@pytest.mark.parametrize("sent", [T.SENT_TOTALS, 0])
def test_turns_are_counted_over_rows(spark, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(T, "SENT_TOTALS", sent)
    assert of_counts(T.explode_turns(segments(spark, tmp_path))) == COUNTS


def test_text_is_not_shuffled_for_turn_counts(spark, tmp_path):
    rows = segments(spark, tmp_path)
    for df in (rows, rows.filter("first_turn = 0 OR first_turn IS NULL")):
        node = T.turn_features(df)._jdf.queryExecution().executedPlan()
        # Exchanges below carry ids and numbers only.
        moved = [n.split("[")[0] for n in str(node.toString()).splitlines() if "Exchange hashpartitioning" in n]
        plan = node.toString()
        assert "SortMergeJoin" not in plan and len(moved) <= 2
        top = plan.split("BroadcastExchange")[0]
        assert "hashpartitioning" not in top
    assert "Exchange" not in T.turn_features(rows.filter("first_turn = 0"))._jdf.queryExecution().executedPlan().toString()


def test_preprocess_counts_continued_conversations(spark, tmp_path):
    segments(spark, tmp_path)
    preprocess(spark, f"{tmp_path}/raw.jsonl", f"{tmp_path}/turns")
    assert of_counts(spark.read.parquet(f"{tmp_path}/turns")) == COUNTS
    preprocess(spark, f"{tmp_path}/raw.jsonl", f"{tmp_path}/apart", segmented=False)
    assert of_counts(spark.read.parquet(f"{tmp_path}/apart"))["a", 4] == 8


def test_empty_corpus_gives_nulls(spark):
    s = stats.corpus_stats(T.turn_features(spark.createDataFrame([], SCHEMA))).first()
    assert s.total_turns == 0 and s.avg_token_count is None and s.total_tokens is None


def test_training_rows_drop_incomplete(spark, conversations):
    turns = T.turn_features(conversations)
    holes = turns.withColumn("sentence_count", F.when(F.col("turn_index") != 1, F.col("sentence_count")))
    assert T.training_rows(holes).count() == 600


def test_sample_is_exact_and_stable(spark):
    df = spark.range(50_000).withColumn("v", F.col("id") % 7)
    a = sampling.sample_rows(df, ["id"], 500).collect()
    b = sampling.sample_rows(df.repartition(13), ["id"], 500).collect()
    assert len({r.id for r in a}) == 500 and sorted(a) == sorted(b)
    assert sampling.sample_rows(df.limit(3), ["id"], 500).count() == 3
    assert sampling.sample_rows(df.limit(0), ["id"], 5).count() == 0


def test_sample_of_copies_is_exact(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 50).alias("k"))
    for n in (1, 500, 1100, 2999, 3000):
        assert sampling.sample_rows(df, ["k"], n).count() == n
    # A third of the rows share one key; the others are distinct.
    hot = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    for seed in range(4):
        assert sampling.sample_rows(hot, ["k"], 3000, seed).count() == 3000


def test_split_shares(spark):
    train, test = sampling.split_rows(spark.range(20_000), ["id"])
    assert train.count() + test.count() == 20_000
    assert 0.78 < train.count() / 20_000 < 0.82
    assert train.join(test, "id").count() == 0


def test_preprocess_job(spark, conversations, tmp_path):
    raw = f"{tmp_path}/raw"
    files.write_jsonl(conversations, f"{raw}.jsonl")
    out = preprocess(spark, f"{raw}.json", f"{tmp_path}/turns", f"{tmp_path}/sample", f"{tmp_path}/stats")
    s = out.first()
    assert s.total_turns == 800 and s.avg_savings_pct >= 0
    assert spark.read.parquet(f"{tmp_path}/turns").columns == TURN_COLUMNS
    assert spark.read.parquet(f"{tmp_path}/sample").count() == 800
    few = preprocess(spark, f"{raw}.json", f"{tmp_path}/few", sample_conversations=10).first()
    assert few.total_conversations == 10


def test_sample_of_repeated_keys_needs_no_single_task(spark):
    df = spark.range(4000).selectExpr("CAST(NULL AS STRING) AS id", "id % 700 AS n", "map('a', id % 700) AS m")
    for n in (1, 650, 3999, 5000):
        got = sampling.sample_rows(df, ["id"], n).collect()
        assert len(got) == min(n, 4000) and all(r.m == {"a": r.n} for r in got)
    a, b = (sorted(r.n for r in sampling.sample_rows(d, ["id"], 650).collect()) for d in (df, df.repartition(7)))
    assert a == b
    same = spark.range(3000).selectExpr("CAST(NULL AS STRING) AS id", "1 AS n")
    assert sampling.sample_rows(same, ["id"], 1200).count() == 1200
