"""Declared schemas: reading with one of these needs no inference pass."""

from pyspark.sql import types as T

MESSAGE = T.StructType(
    [T.StructField("from", T.StringType()), T.StructField("value", T.StringType())]
)

CONVERSATION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("conversations", T.ArrayType(MESSAGE)),
    ]
)

# Conversations too long for one row continue in further rows (`normalize.nest_turns`).
SEGMENTED_CONVERSATION = T.StructType(
    [CONVERSATION["id"], T.StructField("first_turn", T.LongType()), CONVERSATION["conversations"]]
)

# One JSON line of the live event feed. `timestamp` stays text: it is optional and
# parsed by the stream (ISO 8601).
EVENT_LINE = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("event_id", T.LongType()),
        T.StructField("value", T.DoubleType()),
    ]
)

TURN_COLUMNS = [
    "record_id",
    "turn_index",
    "conversation_turn_count",
    "role",
    "raw_text",
    "char_count",
    "word_count",
    "token_count",
    "sentence_count",
    "avg_word_length",
    "has_code_block",
    "optimized_text",
    "optimized_token_count",
    "token_savings",
    "savings_pct",
    "is_human",
]
