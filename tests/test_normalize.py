import random

import pytest
from pyspark.sql import functions as F

from turnledger.operators import normalize as N, trees, turns as T

SCHEMA = "id string, question_id long, n long, conversations array<struct<from:string,value:string>>"
ONE = [("human", "x")]


def test_generated_ids_count_kept_rows(spark):
    rows = [
        ("a", None, 10, ONE), (None, 7, 20, ONE), ("", None, 30, ONE), (None, None, 35, []),
        (None, None, 36, None), (None, 0, 40, ONE),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    ids = {r.id for r in N.from_nested(df, "src", "n", start=100).collect()}
    assert ids == {"a", "7", "src_102", "src_103"}


@pytest.mark.parametrize("parts", [None, 1, 7, 1000])
def test_dense_positions(spark, parts):
    # Most values in a small cluster, the others far apart.
    rng = random.Random(1)
    numbers = list({rng.randrange(400) for _ in range(900)} | {rng.randrange(-(10**15), 10**15) for _ in range(50)})
    rng.shuffle(numbers)
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    got = {r.n: r.dense_position for r in N.dense_positions(df, "n", parts).collect()}
    assert got == {n: i for i, n in enumerate(sorted(numbers))}


def test_roles_and_pairs(spark):
    message = "array<struct<role:string,content:string>>"
    df = spark.createDataFrame(
        [
            (1, [("user", "q"), ("assistant", None)], [("system", "s")]),
            (2, [], [("user", "only b")]),
            (3, None, None),
        ],
        f"question_id long, conversation_a {message}, conversation_b {message}",
    )
    got = {r.id: [tuple(t) for t in r.conversations] for r in N.split_pairs(df).collect()}
    assert got == {"1_a": [("human", "q"), ("gpt", "")], "1_b": [("gpt", "s")], "2_b": [("human", "only b")]}


def test_union_keeps_duplicates(spark):
    a = spark.createDataFrame([("x", ONE)], "id string, conversations array<struct<from:string,value:string>>")
    assert N.union_sources(a, a, a.withColumn("first_turn", F.lit(0))).count() == 3


def walk(rows):
    """{root: [message ids]} along first replies, in plain Python."""
    children = {}
    for mid, parent, *_ in sorted(rows, key=lambda r: r[-1]):
        if parent is not None:
            children.setdefault(parent, mid)
    chains = {}
    for mid, parent, *_ in rows:
        if parent is None:
            chains[mid], at = [mid], mid
            while at in children:
                at = children[at]
                chains[mid].append(at)
    return chains


def messages(spark, rows):
    return spark.createDataFrame(
        [(m, p, t, role, f"text {m}", order) for m, p, t, role, order in rows],
        "message_id long, parent_id long, message_tree_id long, role string, text string, position long",
    )


def test_random_forest_of_replies(spark):
    rng, rows = random.Random(2), []
    for tree in range(15):
        for i in range(rng.randint(1, 40)):
            mid = tree * 1000 + i
            # Deep trees: mostly answer one of the last two messages.
            parent = None if i == 0 else tree * 1000 + max(0, i - rng.randint(1, 2))
            rows.append((mid, parent, tree, rng.choice(["prompter", "assistant"]), rng.random() * 1e9 // 1))
    rows = [(m, p, t, r, int(o) * 100 + m % 100) for m, p, t, r, o in rows]
    got = trees.linear_conversations(messages(spark, rows), "position", segment_turns=5)
    got = T.explode_turns(got).orderBy("record_id", "turn_index").collect()
    texts = {}
    for r in got:
        texts.setdefault(r.record_id, []).append(r.value)
    role = {m: "human" if r == "prompter" else "gpt" for m, _, _, r, _ in rows}
    want = {
        f"oasst1_{root // 1000}": [f"text {m}" for m in chain]
        for root, chain in walk(rows).items() if len(chain) >= 2
    }
    assert texts == want
    assert all(r.role == role[int(r.value.split()[1])] for r in got)


def test_long_chain_hot_parent_cycle_and_orphan(spark):
    chain = [(i, i - 1 if i else None, 1, "assistant", i) for i in range(300)]
    hot = [(10_000, None, 2, "prompter", 0)] + [(10_001 + i, 10_000, 2, "assistant", 500 - i) for i in range(500)]
    cycle = [(20_000, 20_001, 3, "prompter", 0), (20_001, 20_000, 3, "assistant", 1)]
    orphan = [(30_000, 39_999, 4, "prompter", 0), (30_001, 30_000, 4, "assistant", 1)]
    single = [(40_000, None, 5, "prompter", 0)]
    copies = [(1, 0, 1, "assistant", -5), (0, None, 1, "assistant", -5)]
    df = messages(spark, chain + hot + cycle + orphan + single + copies)
    df = df.withColumn("text", F.when(F.col("position") == -5, "old copy").otherwise(F.col("text")))
    got = {r.id: r.conversations for r in trees.linear_conversations(df, "position").collect()}
    assert sorted(got) == ["oasst1_1", "oasst1_2"]
    assert [t["value"] for t in got["oasst1_1"]] == [f"text {i}" for i in range(300)]
    assert [t["value"] for t in got["oasst1_2"]] == ["text 10000", "text 10500"]


def test_a_long_conversation_stays_one(spark):
    """2,500 turns in three rows, with and without an id, through every path."""
    from turnledger.operators.turns import explode_turns, flat_turn_features

    turns = spark.range(2500).select(
        F.lit("c").alias("record_id"), F.col("id").alias("turn_index"),
        F.lit("human").alias("role"), F.concat(F.lit("word "), "id").alias("value"),
    )
    nested = N.nest_turns(turns)
    assert nested.count() == 3
    flat = flat_turn_features(turns)
    assert flat.select("conversation_turn_count").distinct().first()[0] == 2500
    for named in (True, False):
        rows = nested.withColumn("position", F.lit(7))
        rows = rows if named else rows.withColumn("id", F.lit(None).cast("string"))
        out = explode_turns(N.from_nested(rows, "chats", "position"))
        got = out.agg(
            F.count("*"), F.count_distinct("turn_index"), F.max("turn_index"),
            F.min("conversation_turn_count"), F.max("conversation_turn_count"), F.count_distinct("record_id"),
        ).first()
        assert tuple(got) == (2500, 2500, 2499, 2500, 2500, 1)
        assert out.first().record_id == ("c" if named else "chats_0")


def test_turn_counts_without_ids(spark):
    from turnledger.operators.turns import explode_turns

    nested = spark.createDataFrame(
        [(None, None, [("human", "a"), ("gpt", "b")]), (None, 0, [("human", "c")])],
        "id string, first_turn long, conversations array<struct<from:string,value:string>>",
    )
    for rows in (nested, nested.drop("first_turn")):
        got = sorted((r.value, r.turn_index, r.conversation_turn_count) for r in explode_turns(rows).collect())
        assert got == [("a", 0, 2), ("b", 1, 2), ("c", 0, 1)]


def test_pairs_without_question_id(spark):
    message = "array<struct<role:string,content:string>>"
    df = spark.createDataFrame(
        [(1, "q", [("user", "x")], [("user", "y")]), (2, None, [("user", "x")], []), (3, None, [("user", "z")], [("user", "w")])],
        f"place long, question_id string, conversation_a {message}, conversation_b {message}",
    )
    ids = sorted(r.id for r in N.split_pairs(df, "place", "arena").collect())
    assert ids == ["arena_1_a", "arena_2_a", "arena_2_b", "q_a", "q_b"]
    assert sorted(str(r.id) for r in N.split_pairs(df).collect()) == ["None", "None", "None", "q_a", "q_b"]
