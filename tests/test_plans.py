"""What the plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalog import inputs as I
from turnledger.operators import cost, events as ev, sampling, stats, turns as T

SF = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


LAZY = [n for n in entry.queries() if n.split("_")[0] in ("feat", "filter", "agg", "cost", "prompt", "event")]


@pytest.mark.parametrize("name", LAZY)
def test_no_python_workers_and_no_cross_joins(name, spark):
    plan = physical(entry.queries()[name](spark, SF))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


def test_turn_count_join_vanishes_when_unused(spark):
    features = I.features(spark, SF)
    assert "Join" in optimized(features)
    assert "Join" not in optimized(stats.corpus_stats(features))
    assert "Join" not in optimized(cost.conversation_costs(cost.turn_costs(features)))


def test_hot_conversation_is_split_in_the_count_join(spark):
    turns = I.turns(spark, SF)
    rows = turns.withColumn("record_id", F.lit("hot")).withColumn(
        "turn_index", (F.xxhash64("record_id", "value") % 1_000_000).cast("int")
    )
    hot = rows.filter("turn_index >= 0").dropDuplicates(["turn_index"])
    featured = T.flat_turn_features(hot)
    assert featured.select("conversation_turn_count").distinct().collect() == [(hot.count(),)]
    node = featured._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().head()
    assert "_block" in node.condition().get().toString()


def test_text_is_not_shuffled_with_numeric_features(spark):
    wanted = ["record_id", "turn_index", "token_count", "conversation_turn_count"]
    node = I.features(spark, SF).select(*wanted)._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().head()
    left = node.children().head().output()
    names = {left.apply(i).name() for i in range(left.size())}
    assert names == {"record_id", "turn_index", "token_count", "_block", "_id", "_unnamed"}


def test_one_shuffle_per_grouping(spark):
    plan = physical(cost.conversation_costs(cost.turn_costs(I.features(spark, SF))))
    assert plan.count("Exchange") == 1 and "partial_sum" in plan


def test_only_needed_columns_are_read(spark):
    plan = physical(entry.queries()["feat_char_count"](spark, SF))
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,text:string>" in plan
    plan = physical(ev.of_type(I.table(spark, SF, "events"), "click").select("event_id"))
    assert "EqualTo(event_type,click)" in plan and "struct<event_id:bigint,event_type:string>" in plan


def test_latest_time_filter_reaches_the_scan(spark):
    plan = optimized(ev.last_days(I.table(spark, SF, "events"), 7).select("event_id"))
    assert "scalar-subquery" in plan
    scans = physical(ev.last_days(I.table(spark, SF, "events"), 7).select("event_id"))
    filters = re.findall(r"DataFilters: \[.*?\], Format", scans)
    assert any(re.search(r"ts#\d+ >= .*[Ss]ubquery", x) for x in filters)


def test_sample_takes_two_scans(spark):
    documents = I.table(spark, SF, "documents")
    sample = sampling.sample_rows(documents, ["doc_id"], 50)
    assert len(sample.collect()) == 50 and sample.columns == documents.columns
    plan = physical(sample).split("Initial Plan")[0]
    # Whole rows once; the keys once, in a subquery whose other uses are the same one.
    assert plan.count("FileScan") - plan.count("struct<doc_id:bigint>\n") <= 1
    assert "ReusedSubquery" in physical(sample)


def test_shortening_is_computed_once(spark):
    plan = physical(entry.queries()["prompt_shorten"](spark, SF))
    assert plan.count("array_except(") == 1


def test_price_list_is_known_to_be_small(spark):
    plan = physical(entry.queries()["cost_turns_by_model"](spark, SF))
    assert "BroadcastHashJoin" in plan
