"""Query variants of the documentation (cost by user/tenant/department,
blended cost, any-dimension cost, per-tenant and per-day views, live views).

Month filters use the derived ``usage_month`` ('YYYY-MM') rather than a
partition column (partition values are written without the year).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotalake.functions.pricing import (
    BLENDED_PRICE_PER_MTOK, blended_cost, dollars, estimate_cost,
)
from quotalake.functions.timecols import bucket_start, day_start
from quotalake.operators.normalize import metadata_value
from quotalake.operators.usage import days_before, hours_before, since_filter, total_tokens_col

DIMENSIONS = {"user": "user_id", "tenant": "tenant", "department": "department"}


def _sum(c: Column, name: str) -> Column:
    return F.sum(c).cast("bigint").alias(name)


def in_month(inv: DataFrame, month: str) -> DataFrame:
    """Rows of one calendar month; the day bounds prune a day-partitioned table."""
    first = F.to_date(F.lit(f"{month}-01"))
    return inv.where((F.col("usage_month") == F.lit(month)) & (F.col("usage_day") >= first)
                     & (F.col("usage_day") < F.add_months(first, 1)))


def cost_by_user_tenant(inv: DataFrame, as_of, days: int = 30) -> DataFrame:
    """V1: calls, tokens and cost (4 dp) per (user, tenant); no account or metadata filter."""
    return (since_filter(inv, days_before(as_of, days))
            .groupBy(F.col("user_id").alias("user_email"), F.col("tenant"))
            .agg(F.count(F.lit(1)).alias("invocations"),
                 _sum(F.col("input_tokens"), "input_tokens"),
                 _sum(F.col("output_tokens"), "output_tokens"))
            .withColumn("estimated_cost_usd", estimate_cost(F.col("input_tokens"), F.col("output_tokens"), dp=4))
            .orderBy(F.col("estimated_cost_usd").desc_nulls_last()))


def cost_by_user(inv: DataFrame, as_of, days: int = 30) -> DataFrame:
    """V2: tokens and cost (4 dp) per user."""
    return (since_filter(inv, days_before(as_of, days))
            .groupBy("user_id")
            .agg(_sum(total_tokens_col(), "total_tokens"),
                 F.sum("input_tokens").alias("_in"), F.sum("output_tokens").alias("_out"))
            .select("user_id", "total_tokens",
                    estimate_cost(F.col("_in"), F.col("_out"), dp=4).alias("cost_usd"))
            .orderBy(F.col("cost_usd").desc_nulls_last()))


def split_cost_by_user(inv: DataFrame, month: str) -> DataFrame:
    """V3: tokens, input cost and output cost (4 dp each) per user in one month."""
    return (in_month(inv, month).groupBy("user_id")
            .agg(_sum(total_tokens_col(), "tokens"),
                 F.sum("input_tokens").alias("_in"), F.sum("output_tokens").alias("_out"))
            .select("user_id", "tokens",
                    estimate_cost(F.col("_in"), F.lit(0), dp=4).alias("input_cost"),
                    estimate_cost(F.lit(0), F.col("_out"), dp=4).alias("output_cost")))


def tenant_cost_month(inv: DataFrame, month: str) -> DataFrame:
    """V4: tokens and cost (2 dp) per tenant in one month."""
    return (in_month(inv, month).groupBy("tenant")
            .agg(_sum(total_tokens_col(), "tokens"),
                 F.sum("input_tokens").alias("_in"), F.sum("output_tokens").alias("_out"))
            .select("tenant", "tokens", estimate_cost(F.col("_in"), F.col("_out"), dp=2).alias("cost_usd")))


def department_chargeback(inv: DataFrame, month: str) -> DataFrame:
    """V5: calls, tokens and cost (2 dp) per department in one month."""
    return (in_month(inv, month).groupBy(F.col("department").alias("dept"))
            .agg(F.count(F.lit(1)).alias("calls"), _sum(total_tokens_col(), "tokens"),
                 F.sum("input_tokens").alias("_in"), F.sum("output_tokens").alias("_out"))
            .select("dept", "calls", "tokens", estimate_cost(F.col("_in"), F.col("_out"), dp=2).alias("cost_usd"))
            .orderBy(F.col("cost_usd").desc_nulls_last()))


def blended_cost_by(inv: DataFrame, dim: str, month: str, rate=BLENDED_PRICE_PER_MTOK,
                    dp: int | None = None, with_counts: bool = False) -> DataFrame:
    """V6: tokens x one blended rate per user / tenant / department.

    The per-dimension forms are unrounded; the tenant form of the chargeback
    view adds call counts and rounds to 2 dp (``with_counts=True, dp=2``).
    """
    col = DIMENSIONS[dim]
    aggs = [F.count(F.lit(1)).alias("invocation_count")] if with_counts else []
    aggs.append(_sum(total_tokens_col(), "total_tokens"))
    out = (in_month(inv, month).groupBy(col).agg(*aggs)
           .withColumn("cost_usd", blended_cost(F.col("total_tokens"), rate, dp)))
    return out.orderBy(F.col("cost_usd").desc_nulls_last()) if with_counts else out


def cost_by_dimension(inv: DataFrame, key: str, month: str) -> DataFrame:
    """V7: exact (unrounded) cost grouped by any requestmetadata key.

    The per-call cost is exact, so its sum is formed in DECIMAL micro-dollars
    and converted once; rows missing either count contribute nothing.
    """
    micro = (F.col("input_tokens").cast("decimal(38,0)") * F.lit(3)
             + F.col("output_tokens").cast("decimal(38,0)") * F.lit(15))
    return (in_month(inv, month)
            .select(metadata_value(inv, key).alias(key), micro.alias("_micro"))
            .groupBy(key).agg(F.sum("_micro").alias("_micro"))
            .select(key, dollars(F.col("_micro"), None).alias("cost_usd")))


def tenant_user_department_usage(inv: DataFrame, tenant: str, month: str) -> DataFrame:
    """V8: one tenant's users, departments, tokens and calls in one month."""
    return (in_month(inv, month).where(F.col("tenant") == F.lit(tenant))
            .groupBy("user_id", "tenant", "department")
            .agg(_sum(total_tokens_col(), "tokens"), F.count(F.lit(1)).alias("calls"))
            .orderBy(F.col("tokens").desc_nulls_last()))


def daily_tokens_by_user(inv: DataFrame, month: str) -> DataFrame:
    """V9: tokens per (day, user) in one month, newest day first."""
    return (in_month(inv, month)
            .groupBy(day_start(F.col("ts")).alias("day"), F.col("user_id"))
            .agg(_sum(total_tokens_col(), "tokens"))
            .orderBy(F.col("day").desc()))


def recent_calls(inv: DataFrame, as_of, hours: int = 1) -> DataFrame:
    """Calls per (user, tenant) in the last ``hours`` (batch form of the live view)."""
    return (since_filter(inv, hours_before(as_of, hours), strict=True)
            .groupBy("user_id", "tenant").agg(F.count(F.lit(1)).alias("calls")))


def tenant_invocations_5m(inv: DataFrame, profile_id: str, as_of, hours: int = 1) -> DataFrame:
    """Calls of one inference profile in the last hour, per 5-minute bucket."""
    return (since_filter(inv, hours_before(as_of, hours)).where(F.col("profile_id") == F.lit(profile_id))
            .groupBy(bucket_start(F.col("ts"), 300).alias("bucket_start"))
            .agg(F.count(F.lit(1)).alias("invocations")))


def avg_quota_percent(metrics: DataFrame, as_of, user: str | None = None, hours: int = 1) -> DataFrame:
    """Average MonthlyUsagePercent of one user (or of every user) over the last hour."""
    df = since_filter(metrics, hours_before(as_of, hours))
    if user is not None:
        df = df.where(F.col("user_id") == F.lit(user))
    # A sum of doubles depends on summation order; 6 decimals keep the
    # result independent of how the engine splits the work.
    return df.groupBy("user_id").agg(F.round(F.avg("monthly_pct"), 6).alias("avg_monthly_pct"),
                                     F.count(F.lit(1)).alias("points"))
