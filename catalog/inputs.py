"""Inputs of the registered queries, as DataFrames and as SQL.

The tables hold no filler phrases, code fences, blanks or nulls, so each input adds
them to some rows, chosen by id; no row is left out. The Spark part and the SQL part
of an input stand next to each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from turnledger import constants as K
from turnledger.operators.normalize import human_or_gpt, nest_turns
from turnledger.operators.scoring import LinearModel
from turnledger.operators.turns import flat_turn_features
from turnledger.sources.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rnd(expr: str, digits: int = 6) -> str:
    """SQL: round halves away from zero, decided on the decimal digits."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38, 15)), {digits}) AS DOUBLE)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """`rnd` for all double columns: sums differ between engines in their last bits,
    which must not decide a half."""
    exact = lambda c: F.round(F.col(c).cast("decimal(38,15)"), digits).cast("double").alias(c)
    return df.select(*[exact(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def sql_fraction(*keys: str, seed: int = K.SPLIT_SEED) -> str:
    """SQL of `keys.hash_fraction`."""
    joined = " || ':' || ".join([f"'{seed}'", *keys])
    return f"CAST(('0x' || substr(md5({joined}), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE"


def rnd_shown(expr: str, digits: int) -> str:
    """SQL: the rounding of `functions.round` for a double, which goes by its digits as
    printed; for values that both engines compute with the same steps."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 24)), {digits}) AS DOUBLE)"


# ---- turns: one row per message, flat ---------------------------------------------------


def _turn_text() -> Column:
    text, turn = F.col("text"), F.col("turn")
    variant = F.col("conv_id") % 5
    fenced = F.concat(text, F.lit("\n```python\nprint("), turn.cast("string"), F.lit(")\n```"))
    blanked = F.when(turn == 1, F.lit("   ")).when(turn == 2, F.lit(None)).otherwise(text)
    return (
        F.when(variant == 1, F.concat(F.lit("Please could you "), text))
        .when(variant == 2, F.concat(F.lit("Can you tell me how "), text))
        .when(variant == 3, fenced)
        .when(variant == 4, blanked)
        .otherwise(text)
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("record_id"),
        F.col("turn").cast("int").alias("turn_index"),
        human_or_gpt(F.col("role"), "user").alias("role"),
        _turn_text().alias("value"),
    )


TURNS = """turns AS (
  SELECT CAST(conv_id AS VARCHAR) AS record_id, CAST(turn AS INTEGER) AS turn_index,
    CASE WHEN role = 'user' THEN 'human' ELSE 'gpt' END AS role,
    CASE conv_id % 5
      WHEN 1 THEN 'Please could you ' || text
      WHEN 2 THEN 'Can you tell me how ' || text
      WHEN 3 THEN text || chr(10) || '```python' || chr(10) || 'print(' || turn || ')' || chr(10) || '```'
      WHEN 4 THEN CASE turn WHEN 1 THEN '   ' WHEN 2 THEN NULL ELSE text END
      ELSE text END AS value,
    conv_id
  FROM conversations)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The processed turn table."""
    return flat_turn_features(turns(spark, sf_dir))


FEATURES = TURNS + rf""",
counted AS (
  SELECT record_id, turn_index, role, coalesce(value, '') AS raw_text,
    CAST(count(*) OVER (PARTITION BY record_id) AS INTEGER) AS conversation_turn_count
  FROM turns),
measured AS (
  SELECT *, CAST(length(raw_text) AS INTEGER) AS char_count,
    CAST(len(regexp_split_to_array(trim(raw_text, ' '), '\s+')) AS INTEGER) AS token_count,
    CAST(greatest(1, len(regexp_split_to_array(raw_text, '[.!?]+')) - 1) AS INTEGER) AS sentence_count,
    contains(raw_text, '```') AS has_code_block,
    trim(regexp_replace(regexp_replace(regexp_replace(lower(raw_text),
      '{K.filler_pattern()}', ' ', 'g'), '[^\w\s]', '', 'g'), '\s+', ' ', 'g'), ' ') AS optimized_text
  FROM counted WHERE length(trim(raw_text, ' ')) > 0),
shortened AS (
  SELECT *, token_count AS word_count,
    CAST(char_count AS DOUBLE) / greatest(token_count, 1) AS avg_word_length,
    CAST(len(regexp_split_to_array(trim(optimized_text, ' '), '\s+')) AS INTEGER) AS optimized_token_count
  FROM measured),
features AS (
  SELECT *, token_count - optimized_token_count AS token_savings,
    CAST(token_count - optimized_token_count AS DOUBLE) / token_count * 100 AS savings_pct,
    role = 'human' AS is_human, CAST(has_code_block AS INTEGER) AS has_code_block_int
  FROM shortened)"""


# ---- nested conversations ------------------------------------------------------------------


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, first_turn, conversations."""
    return nest_turns(turns(spark, sf_dir))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, first_turn, messages: array of {role, content} with the roles as given."""
    flat = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("record_id"),
        F.col("turn").alias("turn_index"),
        "role",
        _turn_text().alias("value"),
    )
    as_message = lambda m: F.struct(m["from"].alias("role"), m["value"].alias("content"))
    return nest_turns(flat).select(
        F.col("id").alias("conv_id"),
        "first_turn",
        F.transform("conversations", as_message).alias("messages"),
    )


# ---- reply trees -----------------------------------------------------------------------------


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message trees: turn t answers turn floor((t - 1) / 2); the messages of every
    tenth conversation are single roots."""
    c = table(spark, sf_dir, "conversations")
    # Texts that order like (conv_id, turn), for conversations of any length.
    name = lambda turn: F.concat(
        F.lpad(F.col("conv_id").cast("string"), 18, "0"), F.lit("-"), F.lpad(turn.cast("string"), 18, "0")
    )
    mid = name(F.col("turn"))
    parent = name(F.floor((F.col("turn") - 1) / 2))
    is_reply = (F.col("turn") > 0) & (F.col("conv_id") % 10 != 9)
    return c.select(
        mid.alias("message_id"),
        F.when(is_reply, parent).alias("parent_id"),
        F.col("conv_id").alias("message_tree_id"),
        F.when(F.col("role") == "user", F.lit("prompter")).otherwise(F.col("role")).alias("role"),
        "text",
        mid.alias("position"),
    )


REPLIES = """replies AS (
  SELECT format('{:018d}-{:018d}', conv_id, turn) AS message_id,
    CASE WHEN turn > 0 AND conv_id % 10 <> 9
         THEN format('{:018d}-{:018d}', conv_id, CAST(floor((turn - 1) / 2) AS BIGINT)) END AS parent_id,
    conv_id AS message_tree_id, role, text
  FROM conversations)"""

CHAINS = REPLIES + """,
first_reply AS (
  SELECT parent_id, min(message_id) AS message_id FROM replies
  WHERE parent_id IS NOT NULL GROUP BY parent_id),
chains AS (
  SELECT message_id AS root_id, message_id, 0 AS depth FROM replies WHERE parent_id IS NULL
  UNION ALL
  SELECT c.root_id, f.message_id, c.depth + 1 FROM chains c JOIN first_reply f ON f.parent_id = c.message_id),
linear AS (
  SELECT 'oasst1_' || r.message_tree_id AS id, c.depth,
    CASE WHEN r.role = 'user' THEN 'human' ELSE 'gpt' END AS role, r.text AS value,
    count(*) OVER (PARTITION BY c.root_id) AS turns
  FROM chains c JOIN replies r USING (message_id))"""


# ---- prompts -----------------------------------------------------------------------------------


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, prompt."""
    return prompts_of(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def prompts_of(documents: DataFrame) -> DataFrame:
    text, rare, variant = F.col("text"), F.col("doc_id") % 50, F.col("doc_id") % 4
    prompt = (
        F.when(rare == 7, F.lit("Please, the and of!"))
        .when(rare == 8, F.lit(None))
        .when(rare == 9, F.lit(""))
        .when(variant == 1, F.concat(F.lit("Please could you explain "), text))
        .when(variant == 2, F.concat(text, F.lit("\n```python\ndef f(x): return x[0]\n```")))
        .when(variant == 3, F.concat(F.lit("  "), text, F.lit("\n ")))
        .otherwise(text)
    )
    return documents.select("doc_id", prompt.alias("prompt"))


PROMPTS = """prompts AS (
  SELECT doc_id, CASE
    WHEN doc_id % 50 = 7 THEN 'Please, the and of!'
    WHEN doc_id % 50 = 8 THEN NULL
    WHEN doc_id % 50 = 9 THEN ''
    WHEN doc_id % 4 = 1 THEN 'Please could you explain ' || text
    WHEN doc_id % 4 = 2 THEN text || chr(10) || '```python' || chr(10) || 'def f(x): return x[0]' || chr(10) || '```'
    WHEN doc_id % 4 = 3 THEN ' ' || chr(160) || text || chr(10) || ' '
    ELSE text END AS prompt
  FROM documents)"""


def sql_words(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{K.UNICODE_NOT_BLANK}+'))"


def sql_mean_word(text: str) -> str:
    letters = f"length(regexp_replace({text}, '{K.UNICODE_BLANK}+', '', 'g'))"
    return (
        f"CASE WHEN {sql_words(text)} > 0 THEN CAST({letters} AS DOUBLE) / {sql_words(text)} "
        "ELSE 0.0 END"
    )


def sql_trim(text: str) -> str:
    blank = K.UNICODE_BLANK
    return f"regexp_replace({text}, '^{blank}+|{blank}+$', '', 'g')"


def sql_question(text: str) -> str:
    return f"CAST(regexp_matches(lower({text}), '{'|'.join(K.QUESTION_WORDS)}') AS INTEGER)"


def sql_segment(text: str) -> str:
    return (
        f"CASE WHEN contains({text}, '```') THEN 'code' "
        f"WHEN {sql_question(text)} = 1 THEN 'question' ELSE 'general' END"
    )


def sql_shorten(source: str, key: str, text: str, stopwords: list[str]) -> str:
    """CTEs that end in `shortened(key, short)`; short is null where nothing is left."""
    plain = f"lower({text})"
    for filler in K.FILLERS:
        plain = f"replace({plain}, '{filler}', '')"
    plain = f"regexp_replace({plain}, '{K.UNICODE_NOT_WORD_OR_BLANK}', '', 'g')"
    dropped = [w for w in stopwords if w not in K.KEEP_WORDS]
    listed = ", ".join(f"'{w}'" for w in dropped)
    return f"""word_lists AS (
  SELECT {key}, regexp_split_to_array({plain}, '{K.UNICODE_BLANK}+') AS words FROM {source}),
positions AS (
  SELECT {key}, unnest(words) AS word, unnest(range(len(words))) AS pos FROM word_lists),
firsts AS (
  SELECT {key}, word, min(pos) AS pos FROM positions
  WHERE word <> '' AND word NOT IN ({listed}) GROUP BY {key}, word),
shortened AS (
  SELECT {key}, string_agg(word, ' ' ORDER BY pos) AS short FROM firsts GROUP BY {key})"""


# ---- a fixed linear model, so that scores can be compared -----------------------------------------

MODEL = LinearModel(
    features=tuple(K.FEATURE_COLUMNS),
    mean=(900.0, 150.0, 10.0, 6.0, 1.0, 0.0, 0.0),
    std=(1200.0, 200.0, 14.0, 1.5, 0.0, 0.0, 0.0),
    coefficients=(25.0, 180.0, 2.0, -1.5, 0.0, 0.0, 0.0),
    intercept=150.25,
)


def sql_prediction() -> str:
    terms = [
        f"(CAST({f} AS DOUBLE) - {m!r}::DOUBLE) / {s or 1.0!r}::DOUBLE * {c!r}::DOUBLE"
        for f, m, s, c in zip(MODEL.features, MODEL.mean, MODEL.std, MODEL.coefficients)
    ]
    return "0.0::DOUBLE + " + " + ".join(terms) + f" + {MODEL.intercept!r}::DOUBLE"


SCORED = PROMPTS + f""",
trimmed AS (SELECT doc_id, {sql_trim('prompt')} AS prompt FROM prompts),
request AS (
  SELECT doc_id, prompt, CAST(length(prompt) AS DOUBLE) AS char_count,
    CAST(coalesce({sql_words('prompt')}, 0) AS DOUBLE) AS word_count,
    {sql_mean_word('prompt')} AS avg_word_length,
    {sql_question('prompt')} AS question_flag,
    1.0::DOUBLE AS conversation_turn_count, 0.0::DOUBLE AS turn_index, 0.0::DOUBLE AS has_code_block_int
  FROM trimmed),
predicted AS (
  SELECT *, {sql_prediction()} AS prediction
  FROM (SELECT *, greatest(1.0::DOUBLE, word_count / {K.WORDS_PER_SENTENCE}) AS sentence_count FROM request)),
with_input AS (
  SELECT *, CASE WHEN prediction IS NOT NULL
    THEN greatest(1, CAST(round_even(prediction, 0) AS BIGINT)) END AS input_tokens FROM predicted),
scored AS (
  SELECT *, CASE WHEN input_tokens IS NOT NULL
    THEN greatest(1, CAST(round_even(input_tokens * 1.5::DOUBLE, 0) AS BIGINT)) END AS output_tokens
  FROM with_input)"""


# ---- event documents ---------------------------------------------------------------------------------

# Event types of the table -> kinds of documents.
EVENT_KINDS = {
    "view": "prediction",
    "purchase": "model_training",
    "click": "api_request",
    "signup": "data_processing",
    "error": "cost_analysis",
}
ENDPOINTS = ["/", "/health", "/predict"]
LEVELS = ["INFO", "WARNING", "ERROR", "DEBUG", "CRITICAL", "NOTSET"]


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def event_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as monitoring documents: metrics, requests, log records, stage results."""
    return docs_of(table(spark, sf_dir, "events"))


def docs_of(events: DataFrame) -> DataFrame:
    kind = F.coalesce(*[F.when(F.col("event_type") == t, F.lit(k)) for t, k in EVENT_KINDS.items()])
    k = F.get_json_object("props", "$.k").cast("int")
    docs = events.select(
        "event_id",
        "ts",
        kind.alias("event_type"),
        _pick(list(K.PRICES), F.col("user_id")).alias("model_name"),
        _pick(ENDPOINTS, F.col("user_id")).alias("endpoint"),
        _pick(LEVELS, k).alias("level"),
        "user_id",
        k.alias("k"),
        "value",
    )
    return docs.withColumns(
        {
            "mae": F.col("value") / 10,
            "rmse": F.col("value") / 8,
            "r2": 1 - F.col("value") / 1000,
            "rows_processed": (F.col("k") * 100).cast("long"),
            "processing_time_seconds": F.when(F.col("k") % 10 == 0, F.lit(0.0)).otherwise(
                F.col("value") / 10
            ),
            "status_code": F.when(F.col("k") >= 95, F.lit(500)).otherwise(F.lit(200)),
            "status": F.when(F.col("k") >= 90, F.lit("error")).otherwise(F.lit("ok")),
            "message": F.concat_ws(
                " ", F.lit("Stage"), F.concat("event_type", F.lit(":")), "model_name",
                F.concat(F.lit("k="), F.col("k").cast("string")),
            ),
        }
    )


def _sql_pick(values: list[str], index: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"list_extract([{listed}], CAST({index} % {len(values)} + 1 AS INTEGER))"


DOCS = f"""raw_docs AS (
  SELECT event_id, ts, user_id, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    CASE event_type {' '.join(f"WHEN '{t}' THEN '{k}'" for t, k in EVENT_KINDS.items())} END AS event_type,
    {_sql_pick(list(K.PRICES), 'user_id')} AS model_name,
    {_sql_pick(ENDPOINTS, 'user_id')} AS endpoint
  FROM events),
docs AS (
  SELECT *, {_sql_pick(LEVELS, 'k')} AS level, value / 10 AS mae, value / 8 AS rmse, 1 - value / 1000 AS r2,
    CAST(k * 100 AS BIGINT) AS rows_processed,
    CASE WHEN k % 10 = 0 THEN 0.0 ELSE value / 10 END AS processing_time_seconds,
    CASE WHEN k >= 95 THEN 500 ELSE 200 END AS status_code,
    CASE WHEN k >= 90 THEN 'error' ELSE 'ok' END AS status,
    'Stage ' || event_type || ': ' || model_name || ' k=' || k AS message
  FROM raw_docs)"""
