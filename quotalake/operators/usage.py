"""Q1-Q10: the named usage, cost and audit queries over ``inv``.

Every query is a filter + grouped aggregate (partial aggregation on the
map side, one shuffle on the group keys) or a top-k; ``as_of`` replaces
the current date/time so results are deterministic.  Time bounds are
plain column predicates on ``ts`` and reach the parquet scan as pushed
filters when ``inv`` is stored (see sources.logs).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotalake.functions.pricing import estimate_cost
from quotalake.functions.timecols import day_start, hour_start, month_start


def ts_lit(value) -> Column:
    """A datetime / ISO text literal as TIMESTAMP_NTZ."""
    if isinstance(value, dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(str(value)).cast("timestamp_ntz")


def days_before(as_of, days: int) -> Column:
    """``current_date - interval days`` with current_date = date(as_of)."""
    return F.date_sub(F.to_date(ts_lit(as_of)), days).cast("timestamp_ntz")


def hours_before(as_of, hours: int) -> Column:
    return F.timestamp_add("HOUR", F.lit(-hours), ts_lit(as_of))


def total_tokens_col() -> Column:
    """Per-call total; NULL when either count is NULL (SUM(a+b) skips such rows)."""
    return F.col("input_tokens") + F.col("output_tokens")


def since_filter(inv: DataFrame, since: Column, strict: bool = False) -> DataFrame:
    """``ts >= since`` (``>`` if strict), plus the implied ``usage_day`` bound.

    The day predicate is redundant for the result but lets a day-partitioned
    fact table prune whole partitions; the ``ts`` predicate is pushed to the
    parquet row groups.
    """
    cond = (F.col("ts") > since) if strict else (F.col("ts") >= since)
    if "usage_day" in inv.columns:
        cond = cond & (F.col("usage_day") >= F.to_date(since))
    return inv.where(cond)


def scoped(inv: DataFrame, account: str | None, since: Column | None = None) -> DataFrame:
    """Rows of one account with identity metadata, at or after ``since``.

    The stored fact table carries ``has_metadata`` so this test does not
    read the metadata text column.
    """
    cond = F.col("has_metadata") if "has_metadata" in inv.columns else F.col("requestmetadata").isNotNull()
    if account is not None:
        cond = cond & (F.col("account_id") == F.lit(account))
    out = inv.where(cond)
    return since_filter(out, since) if since is not None else out


def _sum_tokens(c: Column, name: str) -> Column:
    return F.sum(c).cast("bigint").alias(name)


def usage_by_user(inv: DataFrame, as_of, account: str, days: int = 30) -> DataFrame:
    """Q1: calls and tokens per (user, tenant, department), last ``days`` days."""
    return (scoped(inv, account, days_before(as_of, days))
            .groupBy("user_id", "tenant", "department")
            .agg(F.count(F.lit(1)).alias("invocation_count"),
                 _sum_tokens(F.col("input_tokens"), "input_tokens"),
                 _sum_tokens(F.col("output_tokens"), "output_tokens"),
                 _sum_tokens(total_tokens_col(), "total_tokens"))
            .orderBy(F.col("total_tokens").desc_nulls_last()))


def tenant_daily_usage(inv: DataFrame, as_of, account: str, days: int = 7) -> DataFrame:
    """Q2: calls, tokens and average tokens per call per (day, tenant)."""
    return (scoped(inv, account, days_before(as_of, days))
            .groupBy(day_start(F.col("ts")).alias("day"), F.col("tenant"))
            .agg(F.count(F.lit(1)).alias("invocation_count"),
                 _sum_tokens(total_tokens_col(), "total_tokens"),
                 F.avg(total_tokens_col()).alias("avg_tokens_per_call"))
            .orderBy(F.col("day").desc(), F.col("tenant").asc_nulls_last()))


def _distinct(col: str, approx: bool, rsd: float = 0.01) -> Column:
    """Exact count-distinct (Catalyst's Expand rewrite), or HyperLogLog++ with
    fixed memory per group when ``approx`` (for very high-cardinality groups)."""
    return F.approx_count_distinct(col, rsd) if approx else F.count_distinct(col)


def department_cost(inv: DataFrame, as_of, account: str, days: int = 30, approx: bool = False) -> DataFrame:
    """Q3: per (tenant, department) users, calls, tokens and exact cost (4 dp)."""
    return (scoped(inv, account, days_before(as_of, days))
            .groupBy("tenant", "department")
            .agg(_distinct("user_id", approx).alias("unique_users"),
                 F.count(F.lit(1)).alias("invocation_count"),
                 _sum_tokens(F.col("input_tokens"), "input_tokens"),
                 _sum_tokens(F.col("output_tokens"), "output_tokens"),
                 _sum_tokens(total_tokens_col(), "total_tokens"))
            .withColumn("estimated_cost_usd",
                        estimate_cost(F.col("input_tokens"), F.col("output_tokens"), dp=4))
            .orderBy(F.col("total_tokens").desc_nulls_last()))


# The literal per-user monthly limits of the quota-tracking
# query (substring of the user id -> limit), first match wins, else default.
LITERAL_MONTHLY_LIMITS = [
    ("john.doe", 500000000),
    ("alice.johnson", 400000000),
    ("david.chen", 350000000),
    ("jane.smith", 300000000),
    ("bob.wilson", 250000000),
]
LITERAL_DEFAULT_LIMIT = 100000000


def half_up_quotient(num: Column, den: Column) -> Column:
    """round(num / den) half-up for num >= 0, den > 0, exactly (DECIMAL, no binary fractions)."""
    n2 = num.cast("decimal(38,0)") * F.lit(2) + den.cast("decimal(38,0)")
    d2 = den.cast("decimal(38,0)") * F.lit(2)
    return ((n2 - F.pmod(n2, d2)) / d2).cast("decimal(38,0)")


def percent_2dp(used: Column, limit: Column) -> Column:
    """round(used / limit * 100, 2) half-up, exact; NULL when the limit is not positive."""
    hundredths = half_up_quotient(used.cast("decimal(38,0)") * F.lit(10000), limit)
    return F.when(limit > 0, hundredths.cast("double") / F.lit(100.0))


def monthly_usage(inv: DataFrame, as_of, account: str | None) -> DataFrame:
    """Tokens per user in the calendar month of ``as_of`` (the CTE of Q4)."""
    month = month_start(ts_lit(as_of))
    end = F.add_months(month, 1).cast("timestamp_ntz")
    return (since_filter(scoped(inv, account), month)
            .where((F.col("ts") < end) & (F.col("usage_day") < F.to_date(end)))
            .groupBy("user_id")
            .agg(_sum_tokens(total_tokens_col(), "tokens_used")))


def user_quota_tracking(inv: DataFrame, as_of, account: str) -> DataFrame:
    """Q4: month-to-date tokens per user against literal limits."""
    limit = F.lit(LITERAL_DEFAULT_LIMIT)
    for needle, value in reversed(LITERAL_MONTHLY_LIMITS):
        limit = F.when(F.col("user_id").contains(needle), F.lit(value)).otherwise(limit)
    return (monthly_usage(inv, as_of, account)
            .withColumn("monthly_limit", limit.cast("bigint"))
            .withColumn("usage_percentage", percent_2dp(F.col("tokens_used"), F.col("monthly_limit")))
            .orderBy(F.col("usage_percentage").desc_nulls_last()))


def hourly_pattern(inv: DataFrame, as_of, account: str, days: int = 7) -> DataFrame:
    """Q5: calls and tokens per hour bucket."""
    return (scoped(inv, account, days_before(as_of, days))
            .groupBy(hour_start(F.col("ts")).alias("hour"))
            .agg(F.count(F.lit(1)).alias("invocation_count"),
                 _sum_tokens(total_tokens_col(), "total_tokens"))
            .orderBy(F.col("hour").desc()))


def model_distribution(inv: DataFrame, as_of, account: str, days: int = 30) -> DataFrame:
    """Q6: calls and tokens per (model id, tenant)."""
    return (scoped(inv, account, days_before(as_of, days))
            .groupBy(F.col("model_id").alias("modelid"), F.col("tenant"))
            .agg(F.count(F.lit(1)).alias("invocation_count"),
                 _sum_tokens(total_tokens_col(), "total_tokens"),
                 F.avg(total_tokens_col()).alias("avg_tokens"))
            .orderBy(F.col("total_tokens").desc_nulls_last()))


def error_analysis(inv: DataFrame, as_of, account: str, days: int = 7) -> DataFrame:
    """Q7: failed calls per (user, tenant, error type)."""
    return (scoped(inv, account, days_before(as_of, days))
            .where(F.col("error_type").isNotNull())
            .groupBy("user_id", "tenant", "error_type")
            .agg(F.count(F.lit(1)).alias("error_count"))
            .orderBy(F.col("error_count").desc()))


def audit_trail(inv: DataFrame, as_of, account: str, hours: int = 1, n: int = 100) -> DataFrame:
    """Q8: the newest ``n`` calls of the last ``hours`` (request id breaks ties).

    orderBy + limit plans as TakeOrderedAndProject: each task keeps its own
    top n, only n rows per task reach the final merge.
    """
    return (scoped(inv, account, hours_before(as_of, hours))
            .select(F.col("ts").alias("timestamp"), "user_id", "tenant", "department", "source",
                    F.col("model_id").alias("modelid"), "input_tokens", "output_tokens",
                    F.col("request_id").alias("requestid"))
            .orderBy(F.col("timestamp").desc(), F.col("requestid").desc())
            .limit(n))


def tenant_monthly_cost(inv: DataFrame, account: str) -> DataFrame:
    """Q9: chargeback per (month, tenant), exact cost at 2 dp, whole history."""
    return (scoped(inv, account)
            .groupBy(month_start(F.col("ts")).alias("month"), F.col("tenant"))
            .agg(F.count(F.lit(1)).alias("invocation_count"),
                 _sum_tokens(F.col("input_tokens"), "input_tokens"),
                 _sum_tokens(F.col("output_tokens"), "output_tokens"))
            .withColumn("total_cost_usd",
                        estimate_cost(F.col("input_tokens"), F.col("output_tokens"), dp=2))
            .orderBy(F.col("month").desc(), F.col("total_cost_usd").desc_nulls_last()))


def user_activity_summary(inv: DataFrame, as_of, account: str, days: int = 30,
                          approx: bool = False) -> DataFrame:
    """Q10: per (user, group, tenant) calls, active days, first/last call, tokens."""
    return (scoped(inv, account, days_before(as_of, days))
            .groupBy("user_id", "user_group", "tenant")
            .agg(F.count(F.lit(1)).alias("total_invocations"),
                 _distinct("usage_day", approx).alias("active_days"),
                 F.min("ts").alias("first_activity"),
                 F.max("ts").alias("last_activity"),
                 _sum_tokens(total_tokens_col(), "total_tokens"))
            .orderBy(F.col("total_tokens").desc_nulls_last()))
