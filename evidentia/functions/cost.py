"""Token and cost arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.schemas import PRICING

# --- fixed values -----------------------------------------------------------
# USD per one million tokens, one flat rate per model: (model, input, output).
# A model missing from this table costs 0.
PRICES = [
    ("gemini-2.5-flash", 0.30, 2.50),
    ("gemini-2.5-pro", 1.25, 10.00),
    ("gemini-embedding-001", 0.15, 0.0),
    ("gemini-3.7-flash", 0.75, 3.75),
    ("gemini-3.1-pro-preview", 2.00, 12.00),
]
EMBEDDING_MODEL = "gemini-embedding-001"
# ---------------------------------------------------------------------------


def pricing_frame(spark: SparkSession, prices=None) -> DataFrame:
    """The price table as a DataFrame (five rows; small by construction)."""
    return spark.createDataFrame(prices or PRICES, PRICING)


def billed_output(visible, thinking=None) -> Column:
    """Visible output tokens plus thinking tokens, nulls as 0."""
    v = F.coalesce(F.col(visible) if isinstance(visible, str) else visible, F.lit(0))
    if thinking is None:
        return v.cast("long")
    t = F.col(thinking) if isinstance(thinking, str) else thinking
    return (v + F.coalesce(t, F.lit(0))).cast("long")


def cost_expr(in_tokens="input_tokens", out_tokens="output_tokens",
              rate_in="input", rate_out="output") -> Column:
    """in/1e6 * rate_in + out/1e6 * rate_out; no rate (unknown model) -> 0."""
    i = F.col(in_tokens).cast("double") / F.lit(1e6) * F.col(rate_in)
    o = F.col(out_tokens).cast("double") / F.lit(1e6) * F.col(rate_out)
    return F.coalesce(i + o, F.lit(0.0))


MONEY = "decimal(38,10)"


def money_sum(c) -> Column:
    """Exact sum of costs. Each cost is tokens x a two-decimal rate / 1e6, so
    its decimal form has at most 10 places; summing decimals makes the total
    independent of the order rows arrive in (float sums are not)."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast(MONEY))


def money_round(c, places: int) -> Column:
    """Half-even rounding of an exact amount, returned as a double."""
    return F.bround(F.col(c) if isinstance(c, str) else c, places).cast("double")


def with_cost(df: DataFrame, pricing: DataFrame, model_col: str = "model",
              in_tokens: str = "input_tokens", out_tokens: str = "output_tokens",
              out_col: str = "cost_usd") -> DataFrame:
    """Left join the (tiny, fixed-size) price table by model and add the cost.

    The price table is a handful of rows, so broadcasting it is safe at any
    scale; the usage side is never shuffled for this join.
    """
    p = F.broadcast(pricing.select(F.col("model").alias("_pm"),
                                   F.col("input").alias("_rin"),
                                   F.col("output").alias("_rout")))
    j = df.join(p, df[model_col].eqNullSafe(p["_pm"]), "left")
    return (j.withColumn(out_col, cost_expr(in_tokens, out_tokens, "_rin", "_rout"))
             .drop("_pm", "_rin", "_rout"))
