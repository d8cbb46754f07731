"""Conversation files -> processed turns, a sample and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from turnledger.operators.sampling import sample_rows
from turnledger.operators.stats import corpus_stats
from turnledger.operators.turns import continues, turn_features
from turnledger.schemas import CONVERSATION, SEGMENTED_CONVERSATION
from turnledger.sources.conversations import read_conversations
from turnledger.sources.tables import write_json, write_parquet

SAMPLE_ROWS = 10_000


def preprocess(spark: SparkSession, source: str, processed: str, sample: str | None = None,
               stats: str | None = None, sample_conversations: int | None = None,
               segmented: bool = True) -> DataFrame:
    """Write the processed turns and, if asked for, a row sample and the statistics.

    The text is parsed once and not shuffled: every row is taken for a whole conversation,
    and whether one continues in further rows is counted on the way. Only if one does, the
    turns are written again, with counts over all rows of a conversation. Sample and
    statistics read the written Parquet, of which the statistics need only the numeric
    columns. `sample_conversations` limits the input for trial runs. With `segmented`
    False the rows of an id are not looked at as one conversation. Returns the one-row
    statistics.
    """
    schema = SEGMENTED_CONVERSATION if segmented else CONVERSATION
    conversations = read_conversations(spark, source, schema)
    if sample_conversations is not None:
        conversations = sample_rows(conversations, ["id"], sample_conversations)
    if segmented:
        seen = Observation()
        rows = conversations.observe(seen, F.count_if(continues()).alias("continued"))
        write_parquet(turn_features(rows.drop("first_turn")), processed)
    if not segmented or seen.get["continued"]:
        write_parquet(turn_features(conversations), processed)
    turns = spark.read.parquet(processed)
    if sample is not None:
        write_parquet(sample_rows(turns, ["record_id", "turn_index"], SAMPLE_ROWS), sample)
    result = corpus_stats(turns)
    if stats is not None:
        write_json(result, stats)
        result = spark.read.schema(result.schema).json(stats)
    return result
