"""Chat datasets of different shapes -> one conversation shape.

Target: `id` and `conversations`, an array of {from, value}.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

from turnledger.storage import shared_dir

# Turns kept in one nested row. Longer conversations continue in further rows, so
# that no conversation, however long, has to fit into one task's memory.
SEGMENT_TURNS = 1024


def human_or_gpt(role: Column, human: str) -> Column:
    """`human` -> human; every other role, missing ones included, -> gpt."""
    return F.when(role == human, F.lit("human")).otherwise(F.lit("gpt"))


def map_roles(messages: Column) -> Column:
    """array<{role, content}> -> array<{from, value}>."""
    return F.transform(
        messages,
        lambda m: F.struct(
            human_or_gpt(m["role"], "user").alias("from"),
            F.coalesce(m["content"], F.lit("")).alias("value"),
        ),
    )


def dense_positions(df: DataFrame, order: str, parts: int | None = None,
                    others: Sequence[str] = ()) -> DataFrame:
    """(order, others, dense_position): 0, 1, 2, ... in the order of a column with unique
    values.

    A window over everything would sort all rows in one task. Here rows are numbered
    inside the parts of a range partitioning, which are even whatever the values are,
    and shifted by the number of rows in the parts before. The parts are checkpointed,
    because they come from a sample and must stay the same; only the order column and
    the narrow `others` are written.
    """
    shared_dir(df.sparkSession)
    values = df.select(F.col(order).alias("_order"), *others)
    ranged = (
        values.repartitionByRange("_order")
        if parts is None
        else values.repartitionByRange(parts, "_order")
    )
    placed = ranged.withColumn("_part", F.spark_partition_id()).checkpoint()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_order")) - 1
    return (
        placed.withColumn("_inside", inside)
        .join(offsets, "_part")
        .select(
            F.col("_order").alias(order),
            *others,
            (F.col("_inside") + F.col("_offset")).cast("long").alias("dense_position"),
        )
    )


def from_nested(df: DataFrame, source: str, order: str, start: int = 0) -> DataFrame:
    """Rows that already have the target shape: keep non-empty conversations.

    The id is the first of `id`, `question_id` and `<source>_<position>` that is neither
    empty nor zero; position counts the kept conversations, beginning at `start`. `order`
    has one value for each conversation, which its segments share. Only rows without an
    own id take part in the numbering join.
    """
    kept = df.filter(F.size("conversations") > 0)
    none = lambda c: F.lit(0) if isinstance(df.schema[c].dataType, NumericType) else F.lit("")
    own_id = F.coalesce(
        *[F.nullif(F.col(c), none(c)).cast("string") for c in ("id", "question_id")
          if c in df.columns]
    )
    named = kept.withColumn("_own", own_id)
    rest = [c for c in ("first_turn", "conversations") if c in df.columns]
    with_id = named.filter(F.col("_own").isNotNull()).select(F.col("_own").alias("id"), *rest)
    generated = F.concat(F.lit(f"{source}_"), (F.col("dense_position") + start).cast("string"))
    without_id = (
        named.filter(F.col("_own").isNull())
        .join(dense_positions(kept.select(order).distinct(), order), order)
        .select(generated.alias("id"), *rest)
    )
    return with_id.unionByName(without_id)


def split_pairs(df: DataFrame, order: str | None = None, source: str = "pair",
                start: int = 0) -> DataFrame:
    """Paired rows (question_id, conversation_a, conversation_b) -> up to two
    conversations `<question_id>_a` and `<question_id>_b`; empty sides are skipped.

    A row without question_id gets `<source>_<position>` in its place, where position
    counts all rows by the unique column `order`, beginning at `start`. Without an order
    the ids of such rows are null.
    """
    name = F.col("question_id").cast("string")
    if order is not None:
        placed = dense_positions(df.select(order).distinct(), order)
        number = F.col("dense_position") + start
        own = df.filter("question_id IS NOT NULL").withColumn("_name", name)
        rest = df.filter("question_id IS NULL").join(placed, order).withColumn(
            "_name", F.concat(F.lit(f"{source}_"), number.cast("string"))
        )
        df = own.unionByName(rest.drop("dense_position"))
    else:
        df = df.withColumn("_name", name)
    sides = F.array(
        *[
            F.struct(F.lit(side).alias("side"), F.col(f"conversation_{side}").alias("messages"))
            for side in ("a", "b")
        ]
    )
    segment = [c for c in ("first_turn",) if c in df.columns]
    return (
        df.select("_name", *segment, F.inline(sides))
        .filter(F.size("messages") > 0)
        .select(
            F.concat("_name", F.lit("_"), "side").alias("id"),
            *segment,
            map_roles(F.col("messages")).alias("conversations"),
        )
    )


def nest_turns(turns: DataFrame, segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """Flat turns (record_id, turn_index, role, value) -> nested conversations.

    Output: id, first_turn, conversations. turn_index has to be the integer position
    of the turn. A row holds at most `segment_turns` turns; `first_turn` is the
    position of its first possible turn and 0 for all but overlong conversations.
    """
    first_turn = (F.floor(F.col("turn_index") / segment_turns) * segment_turns).cast("long")
    message = F.struct(F.col("role").alias("from"), F.col("value").alias("value"))
    return (
        turns.groupBy(F.col("record_id").alias("id"), first_turn.alias("first_turn"))
        .agg(F.sort_array(F.collect_list(F.struct("turn_index", message.alias("m")))).alias("t"))
        .select("id", "first_turn", F.col("t")["m"].alias("conversations"))
    )


def union_sources(*sources: DataFrame) -> DataFrame:
    """All sources one after the other, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)
