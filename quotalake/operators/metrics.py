"""Dashboard datasets as batch time series, one row per series point.

Every series is ``groupBy(dims, bucket)`` with a built-in aggregate, so
partial aggregation runs before the shuffle and a hot user or tenant only
adds one partial row per task.  Buckets are epoch-aligned TIMESTAMP_NTZ.
Percentiles are exact, from counts per distinct value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotalake.functions.pricing import estimate_tokens
from quotalake.functions.timecols import bucket_start
from quotalake.operators.usage import hours_before, since_filter
from quotalake.session import cut_lineage

# Gauge bands of the quota widgets and the warning line.
WARNING_PCT = 80
CRITICAL_PCT = 95


def histogram_stat(stat: str, value: Column, n: Column) -> Column:
    """Percentile ``pNN`` of values with frequencies: exact, and as small as the number of distinct values."""
    # Rounded to 6 decimals so that engines agree on the interpolation.
    return F.round(F.percentile(value, float(stat[1:]) / 100.0, n), 6)


def _stat(stat: str, value: Column) -> Column:
    simple = {"sum": F.sum, "average": F.avg, "maximum": F.max, "minimum": F.min, "samplecount": F.count}
    if stat.lower() not in simple:
        raise ValueError(f"unknown statistic {stat!r}")
    return simple[stat.lower()](value)


def metric_statistics(df: DataFrame, value: str | Column, dims: Sequence[str], period_s: int,
                      stat: str = "Sum", start=None, end=None, ts: str = "ts", name: str = "value") -> DataFrame:
    """M0: one statistic of ``value`` per (dims, period bucket) within [start, end).

    Percentiles count equal values first (partial aggregation), so a task
    holds the distinct values of a period at most.
    """
    if start is not None:
        df = since_filter(df, F.lit(str(start)).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col(ts) < F.lit(str(end)).cast("timestamp_ntz"))
    v = F.col(value) if isinstance(value, str) else value
    period = bucket_start(F.col(ts), period_s).alias("period_start")
    if stat.lower().startswith("p"):
        counted = df.groupBy(*dims, period, v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        return counted.groupBy(*dims, "period_start").agg(histogram_stat(stat.lower(), F.col("_v"), F.col("_n")).alias(name))
    return df.groupBy(*dims, period).agg(_stat(stat, v).alias(name))


def _latency(calls: DataFrame, dims: Sequence[str], period_s: int) -> DataFrame:
    """(dims, period_start, avg_ms, max_ms, p99_ms) of ``latency_ms`` from counts per distinct value."""
    counted = (calls.groupBy(*dims, bucket_start(F.col("ts"), period_s).alias("period_start"), "latency_ms")
               .agg(F.count(F.lit(1)).alias("_n")))
    v, n = F.col("latency_ms"), F.col("_n")
    return counted.groupBy(*dims, "period_start").agg(
        (F.sum(v * n) / F.sum(F.when(v.isNotNull(), n))).alias("avg_ms"), F.max(v).alias("max_ms"),
        histogram_stat("p99", v, n).alias("p99_ms"))


def tenant_label(name: Column) -> Column:
    """'Tenant A (Marketing)' -> 'Tenant A'."""
    return F.trim(F.split(name, r"\(").getItem(0))


def user_label(user_id: Column) -> Column:
    return F.split(user_id, "@").getItem(0)


def _with_profile(inv: DataFrame, profiles: DataFrame) -> DataFrame:
    p = profiles.select("profile_id", tenant_label(F.col("name")).alias("tenant_name"))
    return inv.join(p, "profile_id", "inner")


def tenant_invocations_hourly(inv: DataFrame, profiles: DataFrame) -> DataFrame:
    """M1: calls per tenant inference profile per hour."""
    return metric_statistics(_with_profile(inv, profiles), F.lit(1), ["tenant_name", "profile_id"],
                             3600, "SampleCount", name="invocations")


def tenant_tokens_hourly(inv: DataFrame, profiles: DataFrame) -> DataFrame:
    """M2: Sum(input) + Sum(output) per profile per hour (added after aggregation)."""
    return (_with_profile(inv, profiles)
            .groupBy("tenant_name", "profile_id", bucket_start(F.col("ts"), 3600).alias("period_start"))
            .agg(F.sum("input_tokens").alias("_in"), F.sum("output_tokens").alias("_out"))
            .select("tenant_name", "profile_id", "period_start",
                    (F.col("_in") + F.col("_out")).cast("bigint").alias("tokens")))


def _band(pct: Column) -> Column:
    return (F.when(pct >= CRITICAL_PCT, F.lit("Critical"))
            .when(pct >= WARNING_PCT, F.lit("Warning")).otherwise(F.lit("OK")))


def quota_gauge(metrics: DataFrame) -> DataFrame:
    """M3: max MonthlyUsagePercent per user per 5 minutes with its band."""
    s = metric_statistics(metrics, "monthly_pct", ["user_id"], 300, "Maximum", name="max_pct")
    return s.select("user_id", user_label(F.col("user_id")).alias("label"), "period_start",
                    "max_pct", _band(F.col("max_pct")).alias("band"))


def quota_sparkline(metrics: DataFrame) -> DataFrame:
    """M4: latest 5-minute max MonthlyUsagePercent per user (the single value shown)."""
    s = metric_statistics(metrics, "monthly_pct", ["user_id"], 300, "Maximum", name="max_pct")
    return s.groupBy("user_id").agg(
        F.max("period_start").alias("latest_period"),
        F.max_by("max_pct", "period_start").alias("latest_pct"),
        F.count(F.lit(1)).alias("points"))


def tokens_by_user_hourly(metrics: DataFrame) -> DataFrame:
    """M5: Sum TokensUsed per (user, tenant) per hour."""
    return metric_statistics(metrics, "tokens_used", ["user_id", "tenant"], 3600, "Sum", name="tokens")


def monthly_pct_trend(metrics: DataFrame) -> DataFrame:
    """M6: max MonthlyUsagePercent per user per 5 minutes."""
    return metric_statistics(metrics, "monthly_pct", ["user_id"], 300, "Maximum", name="max_pct")


def daily_pct_trend(metrics: DataFrame) -> DataFrame:
    """M7: max DailyUsagePercent per user per 5 minutes, flag at the 80 % line."""
    s = metric_statistics(metrics, "daily_pct", ["user_id"], 300, "Maximum", name="max_pct")
    return s.withColumn("above_warning", F.col("max_pct") >= F.lit(WARNING_PCT))


def api_calls_5m(outcomes: DataFrame) -> DataFrame:
    """M8: gateway calls per 5 minutes."""
    return metric_statistics(outcomes, F.lit(1), [], 300, "SampleCount", name="calls")


def function_health_5m(outcomes: DataFrame) -> DataFrame:
    """M9: invocations, errors (status 500) and throttles (status 429) per 5 minutes."""
    return (outcomes.groupBy(bucket_start(F.col("ts"), 300).alias("period_start"))
            .agg(F.count(F.lit(1)).alias("invocations"),
                 F.count(F.when(F.col("status") == 500, True)).alias("errors"),
                 F.count(F.when(F.col("status") == 429, True)).alias("throttles")))


def duration_stats_5m(calls: DataFrame) -> DataFrame:
    """Average, maximum and p99 call duration per 5 minutes."""
    return _latency(calls, [], 300)


def peak_concurrency_1m(calls: DataFrame, chunk_seconds: int = 10) -> DataFrame:
    """Most calls in flight at once within each minute that any call overlaps.

    A call is in flight on [ts, ts + latency): +1 at its beginning, -1 at its
    end, summed per instant, so that a call of any length is two rows.  The
    running sum is local to a chunk of ``chunk_seconds``; what is in flight
    when a chunk begins comes from sums over one row per chunk inside a day
    and one row per day with an event.  Minutes without an event have what
    the last chunk before them left.  Calls without a time, or without a
    positive latency, do not count.
    """
    if 60 % chunk_seconds:
        raise ValueError("chunk seconds must divide a minute")
    ends = F.timestamp_add("MILLISECOND", F.col("latency_ms"), F.col("ts"))
    events = (calls.where((F.col("latency_ms") > 0) & F.col("ts").isNotNull())
              .select(F.explode(F.array(F.struct(F.col("ts").alias("at"), F.lit(1).alias("delta")),
                                        F.struct(ends.alias("at"), F.lit(-1).alias("delta")))).alias("x")).select("x.*")
              .groupBy("at").agg(F.sum("delta").alias("delta")).withColumn("c", bucket_start(F.col("at"), chunk_seconds)))
    running = F.sum("delta").over(Window.partitionBy("c").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chunks = cut_lineage(events.withColumn("n", running).groupBy("c").agg(
        F.min("at").alias("first"), F.max("n").alias("peak"), F.sum("delta").alias("net")).withColumn("day", F.to_date("c")))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # One row per day with an event.
    by_day = Window.partitionBy().orderBy("day")
    days = chunks.groupBy("day").agg(F.sum("net").alias("_net"), F.min("c").alias("_first")).select(
        "day", F.coalesce(F.sum("_net").over(earlier(by_day)), F.lit(0)).alias("_before"), F.lead("_first").over(by_day).alias("_after"))
    by_chunk = Window.partitionBy("day").orderBy("c")
    carried = (chunks.withColumn("_own", F.coalesce(F.sum("net").over(earlier(by_chunk)), F.lit(0)))
               .withColumn("_next", F.lead("c").over(by_chunk)).join(days, "day")
               .select("first", bucket_start(F.col("c"), 60).alias("minute"), "peak", "net",
                       (F.col("_before") + F.col("_own")).alias("carry"),
                       bucket_start(F.coalesce("_next", "_after"), 60).alias("next")))
    # What came in was in flight in this minute, too, unless the first change is at its very beginning.
    came = F.when(F.col("first") > F.col("minute"), F.col("carry")).otherwise(F.lit(0))
    busy = carried.select(F.col("minute").alias("period_start"), F.greatest(came, F.col("carry") + F.col("peak")).alias("n"))
    # The minutes up to the next event, listed day by day.
    left = F.col("carry") + F.col("net")
    minute = F.make_dt_interval(mins=F.lit(1))
    low, high = F.col("minute") + minute, F.col("next") - minute
    quiet = (carried.where((left > 0) & (low <= high))
             .select(left.alias("n"), low.alias("low"), high.alias("high"),
                     F.explode(F.sequence(F.to_date(low), F.to_date(high))).alias("d"))
             .select("n", F.explode(F.sequence(
                 F.greatest("low", F.col("d").cast("timestamp_ntz")),
                 F.least("high", F.col("d").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(23), mins=F.lit(59))),
                 minute)).alias("period_start")))
    return (busy.unionByName(quiet).groupBy("period_start").agg(F.max("n").cast("bigint").alias("max_concurrent"))
            .where("max_concurrent > 0"))


def tenant_comparison_24h(inv: DataFrame, profiles: DataFrame) -> DataFrame:
    """Calls per tenant profile per day."""
    return metric_statistics(_with_profile(inv, profiles), F.lit(1), ["tenant_name", "profile_id"],
                             86400, "SampleCount", name="invocations")


def user_token_comparison_24h(metrics: DataFrame) -> DataFrame:
    """Sum TokensUsed per user per day."""
    return metric_statistics(metrics, "tokens_used", ["user_id"], 86400, "Sum", name="tokens")


def tenant_latency_5m(inv: DataFrame, profiles: DataFrame) -> DataFrame:
    """Average and p99 latency per tenant profile per 5 minutes."""
    return _latency(_with_profile(inv, profiles), ["tenant_name", "profile_id"], 300).drop("max_ms")


def tenant_errors_5m(inv: DataFrame, profiles: DataFrame) -> DataFrame:
    """Failed calls per tenant profile per 5 minutes (periods with calls)."""
    return (_with_profile(inv, profiles)
            .groupBy("tenant_name", "profile_id", bucket_start(F.col("ts"), 300).alias("period_start"))
            .agg(F.count(F.col("error_type")).alias("errors")))


def token_share_24h(inv: DataFrame, profiles: DataFrame, as_of=None, hours: int | None = None) -> DataFrame:
    """Token share of each tenant profile (pie chart), optionally last ``hours``.

    Shares divide by the total over the aggregated rows: the window has one
    row per profile (a bounded dimension), never one row per call.
    """
    df = _with_profile(inv, profiles)
    if hours is not None:
        df = since_filter(df, hours_before(as_of, hours))
    per = (df.groupBy("tenant_name", "profile_id")
           .agg(F.sum("input_tokens").alias("_in"), F.sum("output_tokens").alias("_out"))
           .select("tenant_name", "profile_id",
                   (F.coalesce("_in", F.lit(0)) + F.coalesce("_out", F.lit(0))).cast("bigint").alias("tokens")))
    total = F.sum("tokens").over(Window.partitionBy())
    return per.withColumn("share_pct", F.when(total > 0, F.col("tokens") * F.lit(100.0) / total))


def quota_status_table(resolved: DataFrame) -> DataFrame:
    """User label, monthly limit in whole millions ('{n}M', half-even), status."""
    millions = F.bround(F.col("monthly_limit") / F.lit(1e6), 0).cast("bigint")
    return resolved.select(
        "user_id", user_label(F.col("user_id")).alias("user"),
        F.concat(millions.cast("string"), F.lit("M")).alias("monthly_limit"),
        F.lit("Varies").alias("daily_limit"), F.lit("Active").alias("status"))


def tenant_usage_last_hour(inv: DataFrame, profiles: DataFrame, as_of, hours: int = 1,
                           per_call: int = 500) -> DataFrame:
    """Calls in the last hour and the token estimate per profile (0 when none)."""
    recent = (since_filter(inv, hours_before(as_of, hours))
              .groupBy("profile_id").agg(F.count(F.lit(1)).alias("_n")))
    p = profiles.select("profile_id", tenant_label(F.col("name")).alias("tenant_name"))
    n = F.coalesce(F.col("_n"), F.lit(0)).cast("bigint")
    return p.join(recent, "profile_id", "left").select(
        "tenant_name", "profile_id", n.alias("invocations"), estimate_tokens(n, per_call).alias("tokens_estimate"))


def user_invocations(inv: DataFrame, period_s: int = 3600) -> DataFrame:
    """Calls per (user, tenant) per period."""
    return metric_statistics(inv.where(F.col("user_id").isNotNull()), F.lit(1), ["user_id", "tenant"],
                             period_s, "SampleCount", name="invocations")
