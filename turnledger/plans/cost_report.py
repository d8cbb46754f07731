"""Processed turns -> conversation costs, totals and price comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnledger import constants as K
from turnledger.functions.money import price_of
from turnledger.operators import cost
from turnledger.sources.tables import round_doubles, write_json, write_parquet


@dataclass
class CostReport:
    conversations: DataFrame
    totals: DataFrame
    model_comparison: DataFrame
    savings_histogram: DataFrame


def cost_report(spark: SparkSession, processed: str, target: str,
                model: str = K.DEFAULT_PRICE_MODEL) -> CostReport:
    """Write the report tables below `target` and return them.

    The conversation table is written first and everything else is computed from it:
    the turns are grouped once, and a lost executor does not repeat the grouping.
    """
    price_of(model)
    target = target.rstrip("/")
    turns = spark.read.parquet(processed)
    per_conversation = cost.conversation_costs(cost.turn_costs(turns, model))
    write_parquet(per_conversation, f"{target}/conversations")
    conversations = spark.read.parquet(f"{target}/conversations")
    totals = cost.cost_totals(conversations)
    write_json(
        round_doubles(totals).withColumn("model", F.lit(model)), f"{target}/totals"
    )
    comparison = cost.model_comparison(totals)
    write_json(comparison, f"{target}/model_comparison")
    histogram = cost.histogram(conversations, "conv_savings_pct")
    write_json(histogram, f"{target}/savings_histogram")
    return CostReport(conversations, totals, comparison, histogram)
