"""Conversations -> turns -> turn features.

Both input shapes end in the same processed turn table (`schemas.TURN_COLUMNS`):

* nested rows (`id`, `conversations`): the turn count is the array size, so the
  whole chain is one map-only stage; only conversations that continue in further rows
  are counted over their rows, and no text moves for it;
* flat rows (one per turn): features are computed next to the scan, then the count
  per conversation is joined on. It is a left join to a unique side, so Catalyst
  removes it whenever `conversation_turn_count` is not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnledger import constants as K
from turnledger.functions import text as tx
from turnledger.schemas import TURN_COLUMNS


# Turns of one conversation that may meet in one join task.
BLOCK_TURNS = 65_536
# Conversations whose totals are sent to all tasks: ids and numbers, a few MB.
SENT_TOTALS = 50_000


def _block(position: str) -> Column:
    return F.floor(F.coalesce(F.col(position), F.lit(0)) / BLOCK_TURNS)


def _join_turn_counts(rows: DataFrame, counted: DataFrame, turns: Column, position: str) -> DataFrame:
    """Add the sum of `turns` over the rows of `counted` with the same record_id; rows
    without one belong together as well.

    A conversation may hold a large share of all turns. The join therefore goes by
    conversation and block of positions: the totals, one row per conversation, are
    repeated for each of its blocks, of which nearly all conversations have one. Grouping
    the repeated totals brings them to the tasks of the join and tells the planner that
    their keys are unique.
    """
    keys = {
        "_id": F.coalesce(F.col("record_id").cast("string"), F.lit("")),
        "_unnamed": F.col("record_id").isNull(),
    }
    totals = counted.withColumns(keys).groupBy(*keys).agg(
        F.sum(turns).cast("int").alias("total"),
        F.min(_block(position)).alias("first"),
        F.max(_block(position)).alias("last"),
    )
    per_block = (
        totals.select(*keys, "total", F.explode(F.sequence("first", "last")).alias("_block"))
        .groupBy(*keys, "_block")
        .agg(F.max("total").alias("conversation_turn_count"))
    )
    return (
        rows.withColumns(keys | {"_block": _block(position)})
        .join(per_block, [*keys, "_block"], "left")
        .drop(*keys, "_block")
    )


def continues() -> Column:
    """Whether a row continues a conversation that began in another row."""
    return F.col("first_turn") > 0


def _count_over_rows(rows: DataFrame) -> DataFrame:
    """Add the turn count of conversations that may go on in further rows.

    How many conversations do is counted first, from ids alone. Usually none does, or few:
    then only their totals are made, from ids and array sizes, and sent to the rows. With
    more of them than `SENT_TOTALS` the rows are joined to all totals by a shuffle.
    """
    size = F.size("conversations")
    continued = rows.filter(continues() & F.col("record_id").isNotNull()).select("record_id").distinct()
    found = continued.limit(SENT_TOTALS + 1).count()
    if not found:
        return rows.withColumn("conversation_turn_count", size)
    if found > SENT_TOTALS:
        counted = _join_turn_counts(rows, rows, size, "first_turn")
        own = F.when(F.col("record_id").isNull(), size).otherwise(F.col("conversation_turn_count"))
        return counted.withColumn("conversation_turn_count", own)
    sizes = rows.select("record_id", size.alias("turns"))
    totals = (
        sizes.join(F.broadcast(continued), "record_id", "left_semi")
        .groupBy("record_id").agg(F.sum("turns").cast("int").alias("total"))
    )
    counted = rows.join(F.broadcast(totals), "record_id", "left")
    return counted.withColumn("conversation_turn_count", F.coalesce("total", size)).drop("total")


def explode_turns(conversations: DataFrame) -> DataFrame:
    """One row per turn: record_id, turn_index, conversation_turn_count, role, value.

    Null and empty conversations give no row. Segmented conversations (see
    `normalize.nest_turns`) carry `first_turn`, null for 0; their turn index continues
    over the segments and the count is the sum over all segments. A row without id is a
    conversation of its own. With `first_turn` a small job looks for such conversations
    when this is called.
    """
    rows = conversations.withColumnRenamed("id", "record_id")
    if "first_turn" in conversations.columns:
        rows = _count_over_rows(rows)
        first_turn = F.coalesce("first_turn", F.lit(0))
    else:
        rows = rows.withColumn("conversation_turn_count", F.size("conversations"))
        first_turn = F.lit(0)
    return rows.select(
        "record_id",
        "conversation_turn_count",
        first_turn.alias("first_turn"),
        F.posexplode("conversations").alias("position", "turn"),
    ).select(
        "record_id",
        (F.col("first_turn") + F.col("position")).cast("int").alias("turn_index"),
        "conversation_turn_count",
        F.col("turn.from").alias("role"),
        F.col("turn.value").alias("value"),
    )


def add_features(turns: DataFrame, value: str = "value") -> DataFrame:
    """Add every measure of a turn. Shared sub-expressions are computed once."""
    words = F.col("token_count")
    return (
        turns.withColumn("raw_text", F.coalesce(F.col(value), F.lit("")))
        .drop(value)
        .withColumn("char_count", F.length("raw_text"))
        .withColumn("token_count", tx.word_count("raw_text"))
        .withColumn("optimized_text", tx.optimized_text("raw_text"))
        .withColumn("word_count", words)
        .withColumn("sentence_count", tx.sentence_count("raw_text"))
        .withColumn("avg_word_length", tx.avg_word_length("char_count", words))
        .withColumn("has_code_block", tx.has_code_block("raw_text"))
        .withColumn("optimized_token_count", tx.single_spaced_word_count("optimized_text"))
        .withColumn("token_savings", words - F.col("optimized_token_count"))
        .withColumn("savings_pct", tx.savings_pct("token_savings", words))
        .withColumn("is_human", F.coalesce(F.col("role") == "human", F.lit(False)))
    )


def not_blank(text: str = "raw_text") -> Column:
    """A turn counts when something other than spaces is in it."""
    return F.length(F.trim(F.col(text))) > 0


def turn_features(conversations: DataFrame) -> DataFrame:
    """The processed turn table of nested conversations; blank turns are dropped
    after the turns of a conversation have been counted."""
    return (
        add_features(explode_turns(conversations)).filter(not_blank()).select(*TURN_COLUMNS)
    )


def flat_turn_features(turns: DataFrame) -> DataFrame:
    """The processed turn table of flat rows (record_id, turn_index, role, value).

    turn_index is the integer position of the turn. Features come before the join, so
    the text itself is shuffled only if the caller reads it.
    """
    featured = add_features(turns).filter(not_blank())
    return _join_turn_counts(featured, turns, F.lit(1), "turn_index").select(*TURN_COLUMNS)


def training_rows(turns: DataFrame) -> DataFrame:
    """Feature and label columns only, complete rows only. No text is carried on."""
    numeric = turns.withColumn("has_code_block_int", F.col("has_code_block").cast("int"))
    return numeric.dropna(subset=K.FEATURE_COLUMNS + [K.LABEL_COLUMN, K.OPT_LABEL_COLUMN])
