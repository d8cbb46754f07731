"""Sources, normalisation, turn features, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from catalog import inputs as I
from catalog.registry import query
from turnledger.functions import text as tx
from turnledger.operators import normalize, sampling, stats, trees, turns as turn_ops
from turnledger.plans.preprocess import preprocess
from turnledger.schemas import SEGMENTED_CONVERSATION
from turnledger.sources import conversations as files, tables
from turnledger.storage import staging_path

TURN_ROWS = f"""WITH {I.TURNS},
counted AS (SELECT *, CAST(count(*) OVER (PARTITION BY record_id) AS INTEGER) AS conversation_turn_count FROM turns)
SELECT record_id, turn_index, conversation_turn_count, role, value FROM counted"""


# ---- sources and sinks -------------------------------------------------------------------


@query("src_jsonl_roundtrip", TURN_ROWS)
def src_jsonl_roundtrip(spark, sf):
    path = staging_path(spark, "jsonl")
    files.write_jsonl(I.nested(spark, sf), path)
    return turn_ops.explode_turns(files.read_jsonl(spark, path, SEGMENTED_CONVERSATION))


def _write_arrays(spark, sf) -> str:
    """JSON array files of at most 256 conversation rows."""
    path = staging_path(spark, "arrays")
    block = F.floor(F.col("id").cast("long") / 256)
    arrays = (
        I.nested(spark, sf)
        .groupBy(block.alias("block"), "first_turn")
        .agg(
            F.to_json(
                F.collect_list(F.struct("id", "first_turn", "conversations")),
                {"ignoreNullFields": "false"},
            ).alias("value")
        )
    )
    arrays.write.partitionBy("block", "first_turn").text(path)
    return path


@query("src_json_array", TURN_ROWS)
def src_json_array(spark, sf):
    path = _write_arrays(spark, sf)
    return turn_ops.explode_turns(
        files.read_json_array(spark, f"{path}/*/*/", SEGMENTED_CONVERSATION)
    )


@query("src_array_to_jsonl", TURN_ROWS)
def src_array_to_jsonl(spark, sf):
    path, target = _write_arrays(spark, sf), staging_path(spark, "jsonl")
    files.json_array_to_jsonl(spark, f"{path}/*/*/", target)
    return turn_ops.explode_turns(files.read_jsonl(spark, target, SEGMENTED_CONVERSATION))


@query("src_csv", f"""SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users,
  max(event_id) AS last_event, {I.rnd('sum(value)')} AS total, max(props) AS last_props,
  CAST(sum(length(props)) AS BIGINT) AS props_chars FROM events GROUP BY event_type""")
def src_csv(spark, sf):
    path = staging_path(spark, "csv")
    I.table(spark, sf, "events").write.option("header", True).csv(path)
    return (
        tables.read_csv(spark, path)
        .groupBy("event_type")
        .agg(
            F.count("*").alias("n"),
            F.count_distinct("user_id").cast("long").alias("users"),
            F.max("event_id").cast("long").alias("last_event"),
            F.round(F.sum("value"), 6).alias("total"),
            F.max("props").alias("last_props"),
            F.sum(F.length("props")).alias("props_chars"),
        )
    )


KEY = "record_id, turn_index, "


@query("sink_parquet_roundtrip", f"""WITH {I.FEATURES}
SELECT {KEY}conversation_turn_count, role, token_count, optimized_text, {I.rnd('savings_pct')} AS savings_pct FROM features""")
def sink_parquet_roundtrip(spark, sf):
    path = staging_path(spark, "processed")
    tables.write_parquet(I.features(spark, sf), path)
    return I.rounded(
        spark.read.parquet(path).select(
            "record_id", "turn_index", "conversation_turn_count", "role", "token_count",
            "optimized_text", "savings_pct",
        )
    )


STATS_SQL = f"""SELECT count(*) AS total_turns, count(DISTINCT record_id) AS total_conversations,
  {I.rnd('avg(token_count)')} AS avg_token_count, {I.rnd('avg(optimized_token_count)')} AS avg_opt_token_count,
  {I.rnd('avg(savings_pct)')} AS avg_savings_pct, CAST(sum(token_savings) AS BIGINT) AS total_tokens_saved,
  CAST(sum(token_count) AS BIGINT) AS total_tokens, {I.rnd('avg(word_count)')} AS avg_word_count,
  {I.rnd('avg(char_count)')} AS avg_char_count FROM features"""


@query("sink_stats_json", f"WITH {I.FEATURES} {STATS_SQL}")
def sink_stats_json(spark, sf):
    """The whole preprocessing job: JSON lines in, turns, sample and statistics out."""
    raw, out = staging_path(spark, "raw"), staging_path(spark, "preprocess")
    files.write_jsonl(I.nested(spark, sf), f"{raw}.jsonl")
    return I.rounded(
        preprocess(spark, f"{raw}.json", f"{out}/processed", f"{out}/sample", f"{out}/stats")
    )


# ---- normalisation ---------------------------------------------------------------------------


def _exploded(conversations: DataFrame) -> DataFrame:
    """id, turn_index, role, value of conversations in the target shape."""
    return turn_ops.explode_turns(conversations).select(
        F.col("record_id").alias("id"), "turn_index", "role", "value"
    )


def _partly_named(spark, sf) -> DataFrame:
    """Nested rows of which a third has no id, a third only a question id, and every
    seventh no turns."""
    conv = F.col("id").cast("long")
    return I.nested(spark, sf).select(
        conv.alias("position"),
        F.when(conv % 3 == 0, F.concat(F.lit("c"), "id")).when(conv % 3 == 1, F.lit("")).alias("id"),
        F.when(conv % 3 == 1, conv).alias("question_id"),
        "first_turn",
        F.when(conv % 7 == 3, F.slice("conversations", 1, 0))
        .otherwise(F.col("conversations"))
        .alias("conversations"),
    )


PARTLY_NAMED = I.TURNS + """,
kept AS (SELECT DISTINCT conv_id FROM turns WHERE conv_id % 7 <> 3),
named AS (
  SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'c' || conv_id WHEN 1 THEN CAST(conv_id AS VARCHAR)
    ELSE 'chats_' || (row_number() OVER (ORDER BY conv_id) - 1 + 5) END AS id
  FROM kept)"""


@query("norm_sharegpt", f"""WITH {PARTLY_NAMED}
SELECT n.id, t.turn_index, t.role, t.value FROM named n JOIN turns t USING (conv_id)""")
def norm_sharegpt(spark, sf):
    return _exploded(
        normalize.from_nested(_partly_named(spark, sf), "chats", "position", start=5)
    )


@query("norm_role_map", f"""WITH {I.TURNS}
SELECT record_id AS id, turn_index, role, coalesce(value, '') AS value FROM turns""")
def norm_role_map(spark, sf):
    return _exploded(
        I.messages(spark, sf).select(
            F.col("conv_id").cast("string").alias("id"),
            "first_turn",
            normalize.map_roles(F.col("messages")).alias("conversations"),
        )
    )


def _pairs(spark, sf) -> DataFrame:
    """Neighbouring conversations side by side; every fifth pair has an empty side a."""
    m = I.messages(spark, sf).withColumn("question_id", F.floor(F.col("conv_id") / 2))
    side = lambda name, rest: m.filter(F.col("conv_id") % 2 == rest).select(
        "question_id", "first_turn", F.col("messages").alias(f"conversation_{name}")
    )
    a = side("a", 0).withColumn(
        "conversation_a",
        F.when(F.col("question_id") % 5 == 4, F.slice("conversation_a", 1, 0)).otherwise(
            F.col("conversation_a")
        ),
    )
    return a.join(side("b", 1), ["question_id", "first_turn"], "full")


@query("norm_pair_split", f"""WITH {I.TURNS}
SELECT CAST(conv_id // 2 AS VARCHAR) || CASE conv_id % 2 WHEN 0 THEN '_a' ELSE '_b' END AS id,
  turn_index, role, coalesce(value, '') AS value
FROM turns WHERE NOT (conv_id % 2 = 0 AND (conv_id // 2) % 5 = 4)""")
def norm_pair_split(spark, sf):
    return _exploded(normalize.split_pairs(_pairs(spark, sf)))


@query("norm_tree_roots", f"""WITH {I.REPLIES}
SELECT message_id, message_tree_id FROM replies WHERE parent_id IS NULL""")
def norm_tree_roots(spark, sf):
    return trees.tree_roots(I.replies(spark, sf)).select("message_id", "message_tree_id")


@query("norm_tree_linear", f"""WITH RECURSIVE {I.CHAINS}
SELECT id, CAST(depth AS INTEGER) AS turn_index, role, value FROM linear WHERE turns >= 2""")
def norm_tree_linear(spark, sf):
    return _exploded(trees.linear_conversations(I.replies(spark, sf), "position"))


@query("norm_union_sources", f"""WITH RECURSIVE {PARTLY_NAMED}, {I.CHAINS}
SELECT id, count(*) AS turns FROM (
  SELECT n.id FROM named n JOIN turns t USING (conv_id)
  UNION ALL
  SELECT CAST(conv_id // 2 AS VARCHAR) || CASE conv_id % 2 WHEN 0 THEN '_a' ELSE '_b' END
  FROM turns WHERE NOT (conv_id % 2 = 0 AND (conv_id // 2) % 5 = 4)
  UNION ALL
  SELECT id FROM linear WHERE turns >= 2) GROUP BY id""")
def norm_union_sources(spark, sf):
    union = normalize.union_sources(
        normalize.from_nested(_partly_named(spark, sf), "chats", "position", start=5),
        normalize.split_pairs(_pairs(spark, sf)),
        trees.linear_conversations(I.replies(spark, sf), "position"),
    )
    return union.groupBy("id").agg(F.sum(F.size("conversations")).alias("turns"))


@query("norm_nest_turns", TURN_ROWS)
def norm_nest_turns(spark, sf):
    """Short segments, so that conversations continue over several rows."""
    return turn_ops.explode_turns(normalize.nest_turns(I.turns(spark, sf), segment_turns=3))


# ---- turn features -----------------------------------------------------------------------------


def _feature(name: str, column: str, double: bool = False) -> None:
    value = f"{I.rnd(column)} AS {column}" if double else column

    @query(name, f"WITH {I.FEATURES} SELECT {KEY}{value} FROM features")
    def run(spark, sf):
        return I.rounded(I.features(spark, sf).select("record_id", "turn_index", column))


_feature("feat_turn_count", "conversation_turn_count")
_feature("feat_char_count", "char_count")
_feature("feat_word_count", "word_count")
_feature("feat_token_count", "token_count")
_feature("feat_sentence_count", "sentence_count")
_feature("feat_avg_word_length", "avg_word_length", double=True)
_feature("feat_code_block", "has_code_block")
_feature("feat_optimized_text", "optimized_text")
_feature("feat_optimized_tokens", "optimized_token_count")
_feature("feat_token_savings", "token_savings")
_feature("feat_savings_pct", "savings_pct", double=True)
_feature("feat_is_human", "is_human")


@query("feat_explode_turns", TURN_ROWS)
def feat_explode_turns(spark, sf):
    return turn_ops.explode_turns(I.nested(spark, sf))


@query("feat_turns", f"""WITH {I.FEATURES}
SELECT {KEY}conversation_turn_count, role, raw_text, char_count, word_count, token_count, sentence_count,
  {I.rnd('avg_word_length')} AS avg_word_length, has_code_block, optimized_text, optimized_token_count,
  token_savings, {I.rnd('savings_pct')} AS savings_pct, is_human FROM features""")
def feat_turns(spark, sf):
    return I.rounded(I.features(spark, sf))


@query("feat_turns_nested", f"""WITH {I.FEATURES}
SELECT {KEY}conversation_turn_count, char_count, token_count, optimized_token_count, has_code_block FROM features""")
def feat_turns_nested(spark, sf):
    """The same features from the nested shape."""
    return turn_ops.turn_features(I.nested(spark, sf)).select(
        "record_id", "turn_index", "conversation_turn_count", "char_count", "token_count",
        "optimized_token_count", "has_code_block",
    )


@query("filter_blank_turns", f"""WITH {I.TURNS}
SELECT {KEY}coalesce(value, '') AS raw_text FROM turns WHERE length(trim(coalesce(value, ''), ' ')) > 0""")
def filter_blank_turns(spark, sf):
    return (
        I.turns(spark, sf)
        .select("record_id", "turn_index", F.coalesce("value", F.lit("")).alias("raw_text"))
        .filter(turn_ops.not_blank())
    )


@query("filter_dropna", f"""WITH {I.FEATURES}
SELECT {KEY}char_count, token_count, has_code_block_int FROM features WHERE token_count % 4 <> 0""")
def filter_dropna(spark, sf):
    """Every row whose word count is missing (here: a multiple of four) goes."""
    holes = I.features(spark, sf).withColumn(
        "word_count", F.when(F.col("token_count") % 4 != 0, F.col("word_count"))
    )
    return turn_ops.training_rows(holes).select(
        "record_id", "turn_index", "char_count", "token_count", "has_code_block_int"
    )


@query("agg_row_counts", f"""WITH {I.FEATURES}
SELECT 'conversations' AS name, count(DISTINCT record_id) AS rows FROM turns
UNION ALL SELECT 'turns', count(*) FROM turns UNION ALL SELECT 'training', count(*) FROM features""")
def agg_row_counts(spark, sf):
    flat = I.turns(spark, sf)
    return stats.row_counts(
        conversations=flat.select("record_id").distinct(),
        turns=flat,
        training=turn_ops.training_rows(I.features(spark, sf)),
    )


@query("agg_corpus_stats", f"WITH {I.FEATURES} {STATS_SQL}")
def agg_corpus_stats(spark, sf):
    return I.rounded(stats.corpus_stats(I.features(spark, sf)))


# ---- samples -------------------------------------------------------------------------------------


@query("sample_rows", f"""WITH {I.FEATURES}
SELECT {KEY}token_count FROM features ORDER BY {I.sql_fraction('record_id', 'turn_index')}, record_id, turn_index LIMIT 100""")
def sample_rows(spark, sf):
    return sampling.sample_rows(I.features(spark, sf), ["record_id", "turn_index"], 100).select(
        "record_id", "turn_index", "token_count"
    )


@query("sample_conversations", f"""WITH {I.TURNS}, ids AS (
  SELECT record_id, count(*) AS turns FROM turns GROUP BY record_id)
SELECT record_id, turns FROM ids ORDER BY {I.sql_fraction('record_id')}, record_id LIMIT 40""")
def sample_conversations(spark, sf):
    counts = I.turns(spark, sf).groupBy("record_id").agg(F.count("*").alias("turns"))
    return sampling.sample_rows(counts, ["record_id"], 40)


@query("split_train_test", f"""WITH {I.FEATURES}
SELECT {KEY}CASE WHEN {I.sql_fraction('record_id', 'turn_index')} < 0.8 THEN 'train' ELSE 'test' END AS part FROM features""")
def split_train_test(spark, sf):
    train, test = sampling.split_rows(I.features(spark, sf), ["record_id", "turn_index"])
    keyed = lambda df, part: df.select("record_id", "turn_index", F.lit(part).alias("part"))
    return keyed(train, "train").unionByName(keyed(test, "test"))
