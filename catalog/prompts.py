"""Prompt shortening, request features and scores over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.registry import query
from turnledger import constants as K
from turnledger.functions import text as tx
from turnledger.functions.money import request_cost
from turnledger.operators import cost, events as ev, scoring
from turnledger.sources import event_store as store
from turnledger.storage import staging_path


def _measure(name: str, sql: str, measure, alias: str) -> None:
    @query(name, f"WITH {I.PROMPTS} SELECT doc_id, {sql} AS {alias} FROM prompts")
    def run(spark, sf):
        return I.rounded(I.prompts(spark, sf).select("doc_id", measure("prompt").alias(alias)))


@query("prompt_shorten_strong", f"""WITH {I.PROMPTS}, {I.sql_shorten('prompts', 'doc_id', 'prompt', K.BASIC_STOPWORDS)}
SELECT doc_id, coalesce(short, prompt) AS short FROM prompts LEFT JOIN shortened USING (doc_id)""")
def prompt_shorten_strong(spark, sf):
    return I.prompts(spark, sf).select("doc_id", tx.shorten("prompt").alias("short"))


@query("prompt_shorten", f"""WITH {I.PROMPTS}, {I.sql_shorten('prompts', 'doc_id', 'prompt', K.ENGLISH_STOPWORDS)}
SELECT doc_id, coalesce(short, prompt, '') AS short FROM prompts LEFT JOIN shortened USING (doc_id)""")
def prompt_shorten(spark, sf):
    return I.prompts(spark, sf).select("doc_id", tx.shorten_prompt("prompt").alias("short"))


_measure(
    "prompt_approx_tokens",
    f"CASE WHEN coalesce(prompt, '') = '' THEN 0 ELSE CAST(greatest(1, {I.sql_words('prompt')}) AS INTEGER) END",
    tx.approx_tokens,
    "tokens",
)
_measure(
    "prompt_sentence_count",
    "CAST(greatest(1, coalesce(len(regexp_split_to_array(prompt, '[.!?]+')), 1)) AS INTEGER)",
    tx.sentence_pieces,
    "sentences",
)
_measure("prompt_avg_word_len", I.rnd(I.sql_mean_word("prompt")), tx.mean_word_length, "avg_word_len")
_measure(
    "prompt_estimate_tokens",
    f"CAST(greatest(1, floor(coalesce({I.sql_words('prompt')}, 0) * 1.3::DOUBLE)) AS INTEGER)",
    tx.estimate_tokens,
    "tokens",
)
_measure("prompt_segment", I.sql_segment("prompt"), tx.segment, "segment")


@query("prompt_request_features", f"""WITH {I.PROMPTS}, trimmed AS (SELECT doc_id, {I.sql_trim('prompt')} AS prompt FROM prompts)
SELECT doc_id, CAST(length(prompt) AS DOUBLE) AS text_len, CAST(length(prompt) AS DOUBLE) AS context_len,
  CAST(coalesce({I.sql_words('prompt')}, 0) AS DOUBLE) AS num_words, {I.rnd(I.sql_mean_word('prompt'))} AS avg_word_len,
  CAST({I.sql_question('prompt')} AS DOUBLE) AS question_flag FROM trimmed""")
def prompt_request_features(spark, sf):
    return I.rounded(
        scoring.add_request_features(I.prompts(spark, sf)).select(
            "doc_id", "text_len", "context_len", "num_words", "avg_word_len", "question_flag"
        )
    )


def _sql_less(before: str, after: str) -> str:
    pct = I.rnd_shown(f"CAST({before} - {after} AS DOUBLE) / {before} * 100", 2)
    return f"CASE WHEN {before} > 0 THEN {pct} ELSE 0.0 END"


@query("prompt_savings", f"""WITH {I.PROMPTS}, trimmed AS (SELECT doc_id, {I.sql_trim('prompt')} AS prompt FROM prompts),
{I.sql_shorten('trimmed', 'doc_id', 'prompt', K.ENGLISH_STOPWORDS)},
pairs AS (SELECT doc_id, prompt, coalesce(short, prompt, '') AS short FROM trimmed LEFT JOIN shortened USING (doc_id)),
sizes AS (SELECT doc_id, length(prompt) AS chars_before, length(short) AS chars_after,
  greatest(1, floor(coalesce({I.sql_words('prompt')}, 0) * 1.3::DOUBLE)) AS tokens_before,
  greatest(1, floor({I.sql_words('short')} * 1.3::DOUBLE)) AS tokens_after FROM pairs)
SELECT doc_id, {_sql_less('tokens_before', 'tokens_after')} AS token_savings_percent,
  {_sql_less('chars_before', 'chars_after')} AS compression_percent FROM sizes""")
def prompt_savings(spark, sf):
    sized = (
        I.prompts(spark, sf)
        .withColumn("trimmed", tx.unicode_trim("prompt"))
        .withColumn("short", tx.shorten_prompt("trimmed"))
    )
    return sized.select(
        "doc_id",
        tx.percent_less(tx.estimate_tokens("trimmed"), tx.estimate_tokens("short")).alias(
            "token_savings_percent"
        ),
        tx.percent_less(F.length("trimmed"), F.length("short")).alias("compression_percent"),
    )


@query("prompt_code_signals", f"""WITH {I.PROMPTS}
SELECT doc_id, CAST((length(prompt) - length(replace(prompt, '```', ''))) // 3 AS INTEGER) AS fences,
  CAST(len(regexp_extract_all(prompt, '\\b(?:{'|'.join(K.CODE_KEYWORDS)})\\b')) AS INTEGER) AS keywords,
  CASE WHEN length(prompt) > 0 THEN {I.rnd("CAST(length(regexp_replace(prompt, '[^(){}\\[\\]]', '', 'g')) AS DOUBLE) / length(prompt)")}
    ELSE 0.0 END AS bracket_density FROM prompts""")
def prompt_code_signals(spark, sf):
    return I.rounded(
        I.prompts(spark, sf).select(
            "doc_id",
            tx.code_fences("prompt").alias("fences"),
            tx.code_keywords("prompt").alias("keywords"),
            tx.bracket_density("prompt").alias("bracket_density"),
        )
    )


SQL_REQUEST_COST = I.rnd_shown(
    "input_tokens / 1000.0::DOUBLE * 0.0015::DOUBLE + output_tokens / 1000.0::DOUBLE * 0.002::DOUBLE", 6
)


@query("score_prompts", f"""WITH {I.SCORED}, {I.sql_shorten('trimmed', 'doc_id', 'prompt', K.ENGLISH_STOPWORDS)}
SELECT doc_id, input_tokens, output_tokens, input_tokens + output_tokens AS total_tokens,
  {SQL_REQUEST_COST} AS estimated_cost, coalesce(short, prompt, '') AS optimized_prompt, question_flag
FROM scored LEFT JOIN shortened USING (doc_id)""")
def score_prompts(spark, sf):
    return scoring.score_prompts(I.prompts(spark, sf), I.MODEL).select(
        "doc_id", "input_tokens", "output_tokens", "total_tokens", "estimated_cost",
        "optimized_prompt", "question_flag",
    )


@query("prompt_request_cost", f"""WITH {I.PROMPTS}, estimated AS (
  SELECT doc_id, greatest(1, floor(coalesce({I.sql_words('prompt')}, 0) * 1.3::DOUBLE)) AS input_tokens FROM prompts),
both AS (SELECT *, round_even(input_tokens * 1.5::DOUBLE, 0) AS output_tokens FROM estimated)
SELECT doc_id, {SQL_REQUEST_COST} AS estimated_cost FROM both""".replace("both", "priced"))
def prompt_request_cost(spark, sf):
    tokens = tx.estimate_tokens("prompt")
    return (
        I.prompts(spark, sf)
        .withColumn("input_tokens", tokens)
        .withColumn("output_tokens", F.rint(F.col("input_tokens") * K.OUTPUT_PER_INPUT))
        .select("doc_id", request_cost("input_tokens", "output_tokens").alias("estimated_cost"))
    )


@query("score_feature_defaults", f"""WITH {I.PROMPTS}
SELECT doc_id, CAST(length(prompt) AS DOUBLE) AS char_count,
  CAST(coalesce({I.sql_words('prompt')}, 0) AS DOUBLE) AS word_count,
  {I.rnd(f"greatest(1.0::DOUBLE, coalesce({I.sql_words('prompt')}, 0) / 15.0::DOUBLE)")} AS sentence_count,
  {I.rnd(f"length(prompt) / greatest(1.0::DOUBLE, coalesce({I.sql_words('prompt')}, 0))")} AS avg_word_length,
  1.0::DOUBLE AS conversation_turn_count, 0.0::DOUBLE AS turn_index, 0.0::DOUBLE AS has_code_block_int FROM prompts""")
def score_feature_defaults(spark, sf):
    request = I.prompts(spark, sf).select(
        "doc_id",
        F.length("prompt").cast("double").alias("context_len"),
        tx.num_words("prompt").cast("double").alias("num_words"),
    )
    return I.rounded(
        scoring.add_feature_defaults(request).select("doc_id", *K.FEATURE_COLUMNS)
    )


@query("score_hybrid", f"""WITH {I.PROMPTS}, predicted AS (
  SELECT doc_id, {I.sql_segment('prompt')} AS segment,
    1.5::DOUBLE * coalesce({I.sql_words('prompt')}, 0) AS prediction FROM prompts),
blended AS (SELECT doc_id, segment, CASE segment WHEN 'code' THEN 1200.0 WHEN 'question' THEN 350.0 ELSE 500.0 END::DOUBLE
  * 0.6::DOUBLE + prediction * 0.4::DOUBLE AS p FROM predicted)
SELECT doc_id, segment, {I.rnd('p')} AS point_estimate, {I.rnd('p * 0.7::DOUBLE')} AS lower_bound,
  {I.rnd('p * 1.5::DOUBLE')} AS upper_bound, {I.rnd('p * 1.5::DOUBLE / 1000 * 0.002::DOUBLE', 8)} AS budget_usd FROM blended""")
def score_hybrid(spark, sf):
    predicted = I.prompts(spark, sf).select(
        "doc_id",
        tx.segment("prompt").alias("segment"),
        (tx.num_words("prompt") * 1.5).alias("prediction"),
    )
    estimate = scoring.hybrid_estimate(predicted)
    budget = cost.conservative_budget("upper_bound", K.REQUEST_OUTPUT_PRICE)
    return I.rounded(estimate.drop("prediction")).withColumn(
        "budget_usd", F.round(budget, 8)
    )


@query("score_batch_summary", f"""WITH {I.SCORED}
SELECT CAST(sum(input_tokens) AS BIGINT) // count(input_tokens) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) // count(input_tokens) AS output_tokens, count(*) AS batch_size,
  count(input_tokens) AS successful, count(*) - count(input_tokens) AS failed,
  {I.rnd('count(input_tokens)::DOUBLE / count(*) * 100')} AS success_rate FROM scored""")
def score_batch_summary(spark, sf):
    scored = scoring.score_prompts(I.prompts(spark, sf), I.MODEL)
    return I.rounded(scoring.batch_summary(scored))


@query("event_prediction_documents", f"""WITH {I.SCORED}, {I.sql_shorten('trimmed', 'doc_id', 'prompt', K.ENGLISH_STOPWORDS)},
documented AS (
  SELECT strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * doc_id, '%Y.%m.%d') AS index_date, input_tokens, output_tokens,
    length(prompt) AS prompt_chars, {I.sql_words('prompt')} AS prompt_words,
    length(coalesce(short, prompt, '')) AS optimized_prompt_chars
  FROM scored LEFT JOIN shortened USING (doc_id))
SELECT index_date, count(*) AS docs, CAST(sum(prompt_chars) AS BIGINT) AS prompt_chars, CAST(sum(prompt_words) AS BIGINT) AS prompt_words,
  CAST(sum(optimized_prompt_chars) AS BIGINT) AS optimized_prompt_chars, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS total_tokens
FROM documented GROUP BY 1""")
def event_prediction_documents(spark, sf):
    """Every scored prompt as a document of the event table, one hour after the other: no
    more than 24 a day, so that they are stored by year."""
    at = F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, doc_id)")
    scored = scoring.score_prompts(I.prompts(spark, sf), I.MODEL).withColumn("ts", at)
    docs = ev.prediction_documents(scored, "prompt", "ridge_token_count")
    root = staging_path(spark, "predictions")
    store.append(store.documents(docs, "metrics"), root, by_year=True)
    return (
        store.read_index(spark, root, "metrics")
        .groupBy("index_date")
        .agg(
            F.count("*").alias("docs"),
            *[F.sum(c).alias(c) for c in ("prompt_chars", "prompt_words", "optimized_prompt_chars", "total_tokens")],
        )
    )


@query("cost_projection", f"""WITH {I.SCORED}, priced AS (SELECT doc_id, {SQL_REQUEST_COST} AS estimated_cost FROM scored)
SELECT doc_id, CAST(t.turns AS INTEGER) AS turns, {I.rnd('estimated_cost * t.turns')} AS projected_cost
FROM priced, (SELECT unnest(range(1, 11)) AS turns) t""")
def cost_projection(spark, sf):
    scored = scoring.score_prompts(I.prompts(spark, sf), I.MODEL)
    projected = cost.cost_projection(scored.select("doc_id", "estimated_cost"))
    return I.rounded(projected.drop("estimated_cost"))
