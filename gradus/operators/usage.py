"""Token usage and cost of judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.functions.prompts import PRICES


def no_price(model: str | None) -> str:
    """Fixed output: why a cost is null."""
    return f"No token prices configured for {model}"


def usage_and_cost(judgments: DataFrame, pricing_model: str | None, prices: dict[str, tuple[float, float]] = PRICES) -> DataFrame:
    """One row: tokens of the judgments that have both counts, how many do and don't, and costs; null without a price."""
    both = F.col("usage.input_tokens").isNotNull() & F.col("usage.output_tokens").isNotNull()
    tokens = {side: F.coalesce(F.sum(F.when(both, F.col(f"usage.{side}_tokens"))), F.lit(0).cast("bigint")) for side in ("input", "output")}
    sums = judgments.agg(
        tokens["input"].alias("input_tokens"), tokens["output"].alias("output_tokens"), F.count_if(both).alias("judgments_with_usage"), F.count_if(~both).alias("judgments_without_usage"),
    )
    price = prices.get(pricing_model) if pricing_model else None
    cost = [F.lit(price[i]) * F.col(c) / F.lit(1_000_000.0) if price else F.lit(None).cast("double") for i, c in enumerate(("input_tokens", "output_tokens"))]
    return sums.select(
        "*", (F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), cost[0].alias("input_cost"), cost[1].alias("output_cost"), (cost[0] + cost[1]).alias("total_cost"),
        (F.lit(price is not None) & (F.col("judgments_without_usage") == 0)).alias("complete"),
        F.lit(None if price else no_price(pricing_model)).cast("string").alias("undefined_reason"),
    )
