"""Turn cost, conversation cost, price comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as I
from catalog.registry import query
from turnledger import constants as K
from turnledger.operators import cost
from turnledger.plans.cost_report import cost_report
from turnledger.sources.tables import write_parquet
from turnledger.storage import staging_path

IN, OUT = K.PRICES[K.DEFAULT_PRICE_MODEL]
PRICE_ROWS = ", ".join(f"('{m}', {i!r}::DOUBLE, {o!r}::DOUBLE)" for m, (i, o) in K.PRICES.items())
PRICES = f"prices AS (SELECT * FROM (VALUES {PRICE_ROWS}) p(model, input, output))"


def _costed(source: str, rate: str) -> str:
    return f"""costed AS (
  SELECT *, cost_raw_usd - cost_opt_usd AS cost_saved_usd FROM (
    SELECT *, token_count / 1000.0::DOUBLE * {rate} AS cost_raw_usd,
      optimized_token_count / 1000.0::DOUBLE * {rate} AS cost_opt_usd FROM {source}))"""


RATE = f"(CASE WHEN role = 'human' THEN {IN!r}::DOUBLE ELSE {OUT!r}::DOUBLE END)"
COSTED = f"{I.FEATURES}, {_costed('features', RATE)}"
CONVERSATIONS = COSTED + """,
per_conversation AS (
  SELECT *, CASE WHEN conv_cost_raw > 0 THEN conv_cost_saved / conv_cost_raw * 100 ELSE 0.0 END AS conv_savings_pct FROM (
    SELECT record_id, sum(cost_raw_usd) AS conv_cost_raw, sum(cost_opt_usd) AS conv_cost_opt,
      sum(cost_saved_usd) AS conv_cost_saved, CAST(sum(token_count) AS BIGINT) AS conv_tokens_raw,
      CAST(sum(optimized_token_count) AS BIGINT) AS conv_tokens_opt, count(*) AS conv_turns
    FROM costed GROUP BY record_id))"""


def _turns(spark, sf):
    return I.features(spark, sf)


def _conversations(spark, sf):
    return cost.conversation_costs(cost.turn_costs(_turns(spark, sf)))


@query("cost_turns", f"""WITH {COSTED}
SELECT record_id, turn_index, {I.rnd('cost_raw_usd', 9)} AS cost_raw_usd, {I.rnd('cost_opt_usd', 9)} AS cost_opt_usd,
  {I.rnd('cost_saved_usd', 9)} AS cost_saved_usd FROM costed""")
def cost_turns(spark, sf):
    costed = cost.turn_costs(_turns(spark, sf))
    return I.rounded(
        costed.select("record_id", "turn_index", "cost_raw_usd", "cost_opt_usd", "cost_saved_usd"), 9
    )


BY_MODEL = [*K.PRICES, "unpriced"]


@query("cost_turns_by_model", f"""WITH {I.FEATURES}, {PRICES},
labelled AS (SELECT *, list_extract([{', '.join(repr(m) for m in BY_MODEL)}],
  CAST(CAST(record_id AS BIGINT) % {len(BY_MODEL)} + 1 AS INTEGER)) AS model FROM features),
joined AS (SELECT labelled.*, CASE WHEN role = 'human' THEN input ELSE output END AS rate FROM labelled JOIN prices USING (model)),
{_costed('joined', 'rate')}
SELECT record_id, turn_index, model, {I.rnd('cost_raw_usd', 9)} AS cost_raw_usd,
  {I.rnd('cost_saved_usd', 9)} AS cost_saved_usd FROM costed""")
def cost_turns_by_model(spark, sf):
    index = (F.col("record_id").cast("long") % len(BY_MODEL) + 1).cast("int")
    labelled = _turns(spark, sf).withColumn(
        "model", F.element_at(F.array(*[F.lit(m) for m in BY_MODEL]), index)
    )
    costed = cost.turn_costs_by_model(labelled, cost.price_list(spark))
    return I.rounded(
        costed.select("record_id", "turn_index", "model", "cost_raw_usd", "cost_saved_usd"), 9
    )


CONVERSATION_COLUMNS = f"""record_id, {I.rnd('conv_cost_raw', 8)} AS conv_cost_raw, {I.rnd('conv_cost_opt', 8)} AS conv_cost_opt,
  {I.rnd('conv_cost_saved', 8)} AS conv_cost_saved, conv_tokens_raw, conv_tokens_opt, conv_turns,
  {I.rnd('conv_savings_pct', 8)} AS conv_savings_pct"""


@query("cost_per_conversation", f"WITH {CONVERSATIONS} SELECT {CONVERSATION_COLUMNS} FROM per_conversation")
def cost_per_conversation(spark, sf):
    return I.rounded(_conversations(spark, sf), 8)


@query("cost_top_conversations", f"""WITH {CONVERSATIONS} SELECT {CONVERSATION_COLUMNS} FROM per_conversation
ORDER BY round(per_conversation.conv_cost_saved, 8) DESC, record_id LIMIT 20""")
def cost_top_conversations(spark, sf):
    """The conversations that save most (ties in eight digits go by id)."""
    return cost.top_savings(I.rounded(_conversations(spark, sf), 8), 20)


TOTALS = CONVERSATIONS + f""",
totals AS (
  SELECT count(*) AS total_conversations, sum(conv_cost_raw) AS total_cost_raw_usd, sum(conv_cost_opt) AS total_cost_opt_usd,
    sum(conv_cost_saved) AS total_cost_saved_usd, CAST(sum(conv_tokens_raw) AS BIGINT) AS total_tokens_raw,
    CAST(sum(conv_tokens_opt) AS BIGINT) AS total_tokens_opt, avg(conv_cost_raw) AS avg_cost_raw_usd,
    avg(conv_cost_opt) AS avg_cost_opt_usd, avg(conv_savings_pct) AS avg_savings_pct,
    max(conv_cost_saved) AS max_savings_single_conv_usd FROM per_conversation)"""
TOTAL_COLUMNS = "total_conversations, total_tokens_raw, total_tokens_opt, " + ", ".join(
    f"{I.rnd(c)} AS {c}"
    for c in ["total_cost_raw_usd", "total_cost_opt_usd", "total_cost_saved_usd", "avg_cost_raw_usd",
              "avg_cost_opt_usd", "avg_savings_pct", "max_savings_single_conv_usd"]
)


@query("cost_totals", f"WITH {TOTALS} SELECT {TOTAL_COLUMNS} FROM totals")
def cost_totals(spark, sf):
    return I.rounded(cost.cost_totals(_conversations(spark, sf)))


@query("sink_cost_report", f"WITH {TOTALS} SELECT '{K.DEFAULT_PRICE_MODEL}' AS model, {TOTAL_COLUMNS} FROM totals")
def sink_cost_report(spark, sf):
    """The whole cost job, read back from its JSON totals."""
    processed, target = staging_path(spark, "processed"), staging_path(spark, "report")
    write_parquet(_turns(spark, sf), processed)
    report = cost_report(spark, processed, target)
    schema = report.totals.withColumn("model", F.lit("")).schema
    return spark.read.schema(schema).json(f"{target}/totals")


COMPARISON = I.FEATURES + f""", {PRICES},
sums AS (SELECT CAST(sum(token_count) AS BIGINT) AS traw, CAST(sum(optimized_token_count) AS BIGINT) AS topt FROM features),
compared AS (
  SELECT model, traw * 0.6::DOUBLE / 1000 * input + traw * 0.4::DOUBLE / 1000 * output AS raw,
    topt * 0.6::DOUBLE / 1000 * input + topt * 0.4::DOUBLE / 1000 * output AS opt FROM sums, prices),
comparison AS (
  SELECT model, {I.rnd_shown('raw', 4)} AS raw_cost_usd, {I.rnd_shown('opt', 4)} AS opt_cost_usd, {I.rnd_shown('raw - opt', 4)} AS saved_usd,
    CASE WHEN raw > 0 THEN {I.rnd_shown('(raw - opt) / raw * 100', 2)} ELSE 0.0 END AS savings_pct FROM compared)"""


@query("cost_model_comparison", f"WITH {COMPARISON} SELECT * FROM comparison")
def cost_model_comparison(spark, sf):
    return cost.model_comparison(cost.token_totals(_turns(spark, sf)))


@query("cost_model_comparison_long", f"""WITH {COMPARISON}
SELECT model, 'raw' AS series, raw_cost_usd AS cost_usd FROM comparison
UNION ALL SELECT model, 'optimised', opt_cost_usd FROM comparison""")
def cost_model_comparison_long(spark, sf):
    return cost.model_comparison_long(cost_model_comparison(spark, sf))


@query("cost_savings_histogram", f"""WITH {CONVERSATIONS},
b AS (SELECT min(conv_savings_pct) AS low, max(conv_savings_pct) AS high, avg(conv_savings_pct) AS mean FROM per_conversation),
w AS (SELECT low, mean, (high - low) / 50 AS width FROM b),
found AS (SELECT CAST(least(floor((conv_savings_pct - low) / width), 49) AS INTEGER) AS bin, count(*) AS n
  FROM per_conversation, w GROUP BY 1)
SELECT CAST(range AS INTEGER) AS bin, {I.rnd('low + range * width')} AS bin_from,
  {I.rnd('low + (range + 1) * width')} AS bin_to, coalesce(n, 0) AS n, {I.rnd('mean')} AS mean
FROM range(50) CROSS JOIN w LEFT JOIN found ON found.bin = range""")
def cost_savings_histogram(spark, sf):
    return I.rounded(cost.histogram(_conversations(spark, sf), "conv_savings_pct"))


@query("cost_share", f"""WITH {TOTALS},
parts AS (SELECT total_cost_opt_usd AS opt, greatest(0.0, total_cost_raw_usd - total_cost_opt_usd) AS saved FROM totals)
SELECT 'remaining' AS share_of, {I.rnd('opt')} AS cost_usd, {I.rnd('opt / (opt + saved) * 100')} AS share_pct FROM parts
UNION ALL SELECT 'saved', {I.rnd('saved')}, {I.rnd('saved / (opt + saved) * 100')} FROM parts""")
def cost_share(spark, sf):
    return I.rounded(cost.cost_shares(cost.cost_totals(_conversations(spark, sf))))
