"""Reply trees -> linear conversations along the first reply.

Messages: message_id, parent_id, message_tree_id, role, text and an order column that
tells which reply came first. Of several copies of a message the last one counts.

The first replies form chains: every message has at most one first reply and at most
one parent. Finding the place of each message in its chain is therefore done by
pointer doubling over (message, ancestor) pairs. Every join is one to one, so a tree
or a message with a third of all rows is no hot spot, no tree has to fit into one
task, and a chain of depth d takes about log2(d) rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnledger.operators.normalize import SEGMENT_TURNS, human_or_gpt, nest_turns
from turnledger.storage import shared_dir


def is_root() -> Column:
    return F.coalesce(F.col("parent_id").cast("string"), F.lit("")) == ""


def tree_roots(messages: DataFrame) -> DataFrame:
    return messages.filter(is_root())


def first_replies(messages: DataFrame, order: str) -> DataFrame:
    """(parent_id, message_id) of the earliest reply to each message. The minimum is
    taken before the shuffle, so a message with very many replies is harmless."""
    return (
        messages.filter(~is_root())
        .groupBy("parent_id")
        .agg(F.min_by("message_id", order).alias("message_id"))
    )


def chain_positions(messages: DataFrame, order: str) -> DataFrame:
    """(message_id, root_id, depth) of every message on a first-reply chain that
    begins at a root.

    Each round replaces the ancestor of a message by the ancestor's ancestor. Rounds
    end when every chain has reached its head; pairs that no round can finish belong
    to a cycle and are never reached from a root. The state is checkpointed each
    round, which keeps the plan short and lets lost executors restart from files.
    """
    shared_dir(messages.sparkSession)
    roots = tree_roots(messages).select(F.col("message_id").alias("root_id")).distinct()
    links = first_replies(messages, order)
    state = (
        links.join(roots, links["parent_id"] == roots["root_id"], "left")
        .select(
            "message_id",
            F.col("parent_id").alias("ancestor"),
            F.lit(1).cast("long").alias("depth"),
            F.col("root_id").isNotNull().alias("rooted"),
            F.lit(True).alias("open"),
        )
        .checkpoint()
    )
    open_before = None
    while (open_now := state.filter("open").count()) not in (0, open_before):
        open_before = open_now
        higher = state.select(
            F.col("message_id").alias("ancestor"),
            F.col("ancestor").alias("next_ancestor"),
            F.col("depth").alias("next_depth"),
            F.col("rooted").alias("next_rooted"),
            F.col("open").alias("next_open"),
        )
        advanced = (
            state.filter("open")
            .join(higher, "ancestor", "left")
            .select(
                "message_id",
                F.coalesce("next_ancestor", "ancestor").alias("ancestor"),
                (F.col("depth") + F.coalesce("next_depth", F.lit(0))).alias("depth"),
                F.coalesce("next_rooted", "rooted").alias("rooted"),
                F.coalesce("next_open", F.lit(False)).alias("open"),
            )
        )
        state = state.filter(~F.col("open")).unionByName(advanced).checkpoint()
    below = state.filter(~F.col("open") & F.col("rooted"))
    return below.select("message_id", F.col("ancestor").alias("root_id"), "depth").unionByName(
        roots.select(
            F.col("root_id").alias("message_id"), "root_id", F.lit(0).cast("long").alias("depth")
        )
    )


def linear_conversations(messages: DataFrame, order: str, prefix: str = "oasst1_",
                         segment_turns: int = SEGMENT_TURNS) -> DataFrame:
    """One conversation `<prefix><message_tree_id>` per root with at least one reply:
    id, first_turn, conversations.

    `prompter` becomes human, every other role gpt.
    """
    messages = messages.select(
        "message_id", "parent_id", "message_tree_id", "role", "text", order
    )
    positions = chain_positions(messages, order)
    texts = (
        messages.groupBy("message_id")
        .agg(F.max_by(F.struct("message_tree_id", "role", "text"), order).alias("m"))
        .select("message_id", "m.*")
    )
    turns = positions.join(texts, "message_id").select(
        F.struct("message_tree_id", "root_id").alias("record_id"),
        F.col("depth").alias("turn_index"),
        human_or_gpt(F.col("role"), "prompter").alias("role"),
        F.col("text").alias("value"),
    )
    nested = nest_turns(turns, max(2, segment_turns))
    has_reply = (F.col("first_turn") > 0) | (F.size("conversations") >= 2)
    return nested.filter(has_reply).select(
        F.concat(F.lit(prefix), F.col("id.message_tree_id").cast("string")).alias("id"),
        "first_turn",
        "conversations",
    )
