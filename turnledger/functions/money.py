"""Token cost as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from turnledger import constants as K


def price_of(model: str) -> tuple[float, float]:
    """(input, output) price per 1,000 tokens; unknown models are rejected here,
    before anything is planned."""
    if model not in K.PRICES:
        raise ValueError(f"unknown price model {model!r}; choose from {sorted(K.PRICES)}")
    return K.PRICES[model]


def cost_usd(tokens: Column | str, rate_per_1k: Column | float) -> Column:
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    rate = rate_per_1k if isinstance(rate_per_1k, Column) else F.lit(float(rate_per_1k))
    return tokens / 1000.0 * rate


def rate_for(role: Column | str, input_rate: Column | float, output_rate: Column | float) -> Column:
    """Human turns are input; every other role, null included, is output."""
    role = F.col(role) if isinstance(role, str) else role
    as_col = lambda r: r if isinstance(r, Column) else F.lit(float(r))
    return F.when(role == "human", as_col(input_rate)).otherwise(as_col(output_rate))


def request_cost(input_tokens: Column | str, output_tokens: Column | str) -> Column:
    """Cost of one request with its answer, six digits."""
    return F.round(
        cost_usd(input_tokens, K.REQUEST_INPUT_PRICE)
        + cost_usd(output_tokens, K.REQUEST_OUTPUT_PRICE),
        6,
    )
