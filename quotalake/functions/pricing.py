"""Exact cost arithmetic.

Prices are dollars per million tokens.  The cost is formed as an exact
DECIMAL of micro-dollars, divided by 10^6 and rounded half-up to ``dp``
places once, in DECIMAL, then converted to double once.  This never rounds a
binary fraction, so it gives the same digits as exact integer arithmetic
even when sums exceed 2^53.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Model price in dollars per million tokens (input, output),
# the blended rate of the documentation variants, and the per-call token
# estimate used when only call counts are known.
INPUT_PRICE_PER_MTOK = 3
OUTPUT_PRICE_PER_MTOK = 15
BLENDED_PRICE_PER_MTOK = 9
TOKENS_PER_CALL_ESTIMATE = 500



# Types that keep every product and sum below exact: 20 digits hold any
# BIGINT count, prices have at most 3 digits before and 6 after the point.
TOKENS, PRICE, MILLIONTH = "decimal(20,0)", "decimal(9,6)", Decimal("0.000001")


def _price(p) -> Column:
    return F.lit(str(Decimal(str(p)))).cast(PRICE)


def dollars(micro: Column, dp: int | None) -> Column:
    """Micro-dollar DECIMAL -> dollars as double, rounded half-up once to ``dp`` (None: unrounded)."""
    value = micro.cast("decimal(31,6)") * F.lit(MILLIONTH)
    if dp is not None:
        value = F.round(value, dp)
    return value.cast("double")


def estimate_cost(tokens_in: Column, tokens_out: Column, in_price=INPUT_PRICE_PER_MTOK,
                  out_price=OUTPUT_PRICE_PER_MTOK, dp: int | None = 4) -> Column:
    """(in * in_price + out * out_price) / 1e6, half-up to ``dp`` places.

    NULL in either input gives NULL, as SQL arithmetic does.
    """
    micro = tokens_in.cast(TOKENS) * _price(in_price) + tokens_out.cast(TOKENS) * _price(out_price)
    return dollars(micro, dp)


def blended_cost(tokens: Column, rate=BLENDED_PRICE_PER_MTOK, dp: int | None = 4) -> Column:
    """tokens * rate / 1e6: one price for input and output."""
    return dollars(tokens.cast(TOKENS) * _price(rate), dp)


def estimate_tokens(invocations: Column, per_call: int = TOKENS_PER_CALL_ESTIMATE) -> Column:
    """Token estimate from a call count."""
    return invocations * F.lit(per_call).cast("bigint")


def usage_totals(inv: DataFrame) -> DataFrame:
    """Total calls, total tokens and whole tokens per call with a zero guard (C4).

    One global aggregate: partial sums per task, one tiny final merge.
    """
    tokens = F.coalesce(F.col("input_tokens"), F.lit(0)) + F.coalesce(F.col("output_tokens"), F.lit(0))
    agg = inv.agg(F.count(F.lit(1)).alias("total_calls"),
                  F.coalesce(F.sum(tokens), F.lit(0)).cast("bigint").alias("total_tokens"))
    return agg.select(
        "total_calls", "total_tokens",
        F.expr("if(total_calls > 0, total_tokens div total_calls, 0L)").alias("avg_tokens_per_call"),
    )
