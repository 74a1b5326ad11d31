"""Named queries: (spark, sf_dir) -> DataFrame over the driver tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotalake.functions.pricing import usage_totals
from quotalake.functions.timecols import bucket_start
from quotalake.operators import alarms as AL
from quotalake.operators import metrics as M
from quotalake.operators import quota as K
from quotalake.operators import retention as RT
from quotalake.operators import rollups as RU
from quotalake.operators import sketches as SK
from quotalake.operators import usage as U
from quotalake.operators import variants as V
from quotalake.operators.normalize import normalize_invocations, normalize_rejects
from quotalake.schema import INVOCATION_LOG
from quotalake.sources import dims as DM
from quotalake.sources import fixtures as fx
from quotalake.sources import logs as LG
from quotalake.sources.logs import derived_path, derived_table
from quotalake.session import cut_lineage
from quotalake.streaming import alerts as ST3
from quotalake.streaming import common as SC
from quotalake.streaming import counters as ST1
from quotalake.streaming import metrics as ST2
from quotalake.streaming import quota as ST4

Query = Callable[[SparkSession, str], DataFrame]


def _events_path(sf_dir: str) -> str:
    return f"{sf_dir}/events.parquet"


def invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised invocations of the fixture log, stored once per application.

    S2 over the projection of ``events`` is written as the day-partitioned
    fact table (S6) in the shared checkpoint folder; queries read it back
    with pruning and pushed filters, as they would on the production table.
    """
    return spark.read.parquet(_inv_path(spark, sf_dir))


def _usage_queries() -> dict[str, Query]:
    A, ACC = fx.AS_OF, fx.ACCOUNT
    return {
        "usage_by_user": lambda s, d: U.usage_by_user(invocations(s, d), A, ACC),
        "tenant_daily_usage": lambda s, d: U.tenant_daily_usage(invocations(s, d), A, ACC),
        "department_cost": lambda s, d: U.department_cost(invocations(s, d), A, ACC),
        "user_quota_tracking": lambda s, d: U.user_quota_tracking(invocations(s, d), A, ACC),
        "hourly_pattern": lambda s, d: U.hourly_pattern(invocations(s, d), A, ACC),
        "model_distribution": lambda s, d: U.model_distribution(invocations(s, d), A, ACC),
        "error_analysis": lambda s, d: U.error_analysis(invocations(s, d), A, ACC),
        "audit_trail": lambda s, d: U.audit_trail(invocations(s, d), fx.AS_OF_RECENT, ACC),
        "tenant_monthly_cost": lambda s, d: U.tenant_monthly_cost(invocations(s, d), ACC),
        "user_activity_summary": lambda s, d: U.user_activity_summary(invocations(s, d), A, ACC),
    }


def _variant_queries() -> dict[str, Query]:
    A, R, M = fx.AS_OF, fx.AS_OF_RECENT, fx.USAGE_MONTH
    inv = invocations
    return {
        "cost_by_user_tenant": lambda s, d: V.cost_by_user_tenant(inv(s, d), A),
        "cost_by_user": lambda s, d: V.cost_by_user(inv(s, d), A),
        "split_cost_by_user": lambda s, d: V.split_cost_by_user(inv(s, d), M),
        "tenant_cost_month": lambda s, d: V.tenant_cost_month(inv(s, d), M),
        "department_chargeback": lambda s, d: V.department_chargeback(inv(s, d), M),
        "blended_cost_user": lambda s, d: V.blended_cost_by(inv(s, d), "user", M),
        "blended_cost_department": lambda s, d: V.blended_cost_by(inv(s, d), "department", M),
        "blended_cost_tenant": lambda s, d: V.blended_cost_by(inv(s, d), "tenant", M, dp=2, with_counts=True),
        "cost_by_project": lambda s, d: V.cost_by_dimension(inv(s, d), "project", M),
        "tenant_user_department_usage": lambda s, d: V.tenant_user_department_usage(inv(s, d), "tenant_a", M),
        "daily_tokens_by_user": lambda s, d: V.daily_tokens_by_user(inv(s, d), M),
        "recent_calls": lambda s, d: V.recent_calls(inv(s, d), R),
        "tenant_invocations_5m": lambda s, d: V.tenant_invocations_5m(
            inv(s, d), fx.TENANT_PROFILES[0][0], R),
    }


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User metadata derived from ``events`` (stored once per application)."""
    return derived_table(spark, "user_metadata", _events_path(sf_dir), lambda: fx.user_metadata(spark, sf_dir))


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quota policies: fixed base rows plus user rows derived from the users (stored)."""
    return derived_table(spark, "quota_policies", _events_path(sf_dir), lambda: fx.quota_policies(spark, sf_dir))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gateway call log derived from ``events`` (stored once per application)."""
    return derived_table(spark, "gateway_calls", _events_path(sf_dir), lambda: fx.gateway_calls(spark, sf_dir))


def compute_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8 over the fixture: every gateway call, fixture users and policies."""
    return K.quota_replay(calls(spark, sf_dir), users(spark, sf_dir), policies(spark, sf_dir))


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored decision log (K8 output, built once per application).

    Dashboards, metrics and alarms read the decision log rather than
    replaying the whole call history for every chart.
    """
    return derived_table(spark, "quota_replay", _events_path(sf_dir), lambda: compute_replay(spark, sf_dir))


def compute_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 over the whole fact table."""
    return K.usage_counters(invocations(spark, sf_dir))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored counter table (K3 output, built once per application) that checks and reports read."""
    return derived_table(spark, "usage_counters", _events_path(sf_dir), lambda: compute_counters(spark, sf_dir))


REPLAY_COLUMNS = ["request_id", "ts", "user_id", "policy_source", "enforcement_mode", "monthly_limit",
                  "daily_limit", "tokens", "allowed", "charged_tokens", "monthly_usage", "daily_usage",
                  "status"]


def policy_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S8 over the stored puts: every version of every policy with its time in force."""
    path = SC.run_dir(spark, "policy-versions")
    fx.policy_puts(spark, sf_dir).write.mode("overwrite").json(path)
    return DM.policy_versions(DM.load_policy_puts(spark, path))


def _resolve_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.resolve_policy_at(calls(spark, sf_dir), users(spark, sf_dir), policy_versions(spark, sf_dir))
    return found.where("policy_source is not null").select(
        "request_id", "user_id", "ts", "policy_source", "policy_since", "monthly_limit", "daily_limit", "enforcement_mode")


def _replay_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = cut_lineage(policy_versions(spark, sf_dir))
    return K.quota_replay_versions(calls(spark, sf_dir), users(spark, sf_dir), versions).select(*REPLAY_COLUMNS)


def _spans(spark: SparkSession, sf_dir: str) -> str:
    """K8 and K3 run span by span (five days each) over the call log, once per application; returns the folder."""
    def write(rows: DataFrame, out: str) -> None:
        first, last = rows.agg(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).first()
        who, limits = cut_lineage(users(spark, sf_dir)), cut_lineage(policies(spark, sf_dir))
        rows = cut_lineage(rows.repartitionByRange("ts"))  # each span reads its own files
        while first <= last:
            end = first + dt.timedelta(days=5)
            K.replay_span(spark, out, rows, who, limits, first, end)
            first = end

    return derived_path(spark, "replay_spans", _events_path(sf_dir), lambda: calls(spark, sf_dir), write)


def _replay_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.decisions_of_spans(spark, _spans(spark, sf_dir)).select(*REPLAY_COLUMNS)


def _counters_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.counters_from_spans(spark, _spans(spark, sf_dir))


def _quota_queries() -> dict[str, Query]:
    A, R = fx.AS_OF, fx.AS_OF_RECENT
    pols = policies

    def check(s, d):
        return K.check_quota(users(s, d), pols(s, d), counters(s, d), R)

    return {
        "enrich_identity": lambda s, d: K.enrich_identity(calls(s, d), users(s, d), "default"),
        "resolve_policy": lambda s, d: K.resolve_policy(users(s, d), pols(s, d)),
        "quota_replay_spans": _replay_spans,
        "usage_counters_spans": _counters_spans,
        "policy_versions": policy_versions,
        "resolve_policy_at_call": _resolve_at,
        "quota_replay_versions": _replay_versions,
        "usage_counters": compute_counters,
        "check_quota": check,
        "quota_remaining": lambda s, d: K.quota_remaining(check(s, d)),
        "quota_replay": lambda s, d: compute_replay(s, d).select(*REPLAY_COLUMNS),
        "quota_exceeded_messages": lambda s, d: K.quota_exceeded_messages(replay(s, d)),
        "quota_metrics": lambda s, d: K.quota_metrics(replay(s, d)),
        "expire_counters": lambda s, d: K.expire_counters(counters(s, d), A),
        "initialize_counters": lambda s, d: K.initialize_counters(users(s, d), counters(s, d), R),
        "monthly_usage_report": lambda s, d: K.monthly_usage_report(counters(s, d)),
        "policy_report": lambda s, d: K.policy_report(pols(s, d)),
        "user_quota_tracking_joined": lambda s, d: K.user_quota_tracking_joined(
            invocations(s, d), users(s, d), pols(s, d), A, fx.ACCOUNT),
        "user_period_history": lambda s, d: K.user_period_history(counters(s, d), "user3@company.com", "daily_"),
        "request_outcomes": lambda s, d: K.request_outcomes(replay(s, d)),
        "current_usage": lambda s, d: K.current_usage(users(s, d), counters(s, d), R),
        "counter_accuracy": lambda s, d: K.counter_accuracy(K.counters_from_replay(replay(s, d)), invocations(s, d)),
    }


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6 quota metrics of the replay."""
    return K.quota_metrics(replay(spark, sf_dir))


def _metric_queries() -> dict[str, Query]:
    A, R = fx.AS_OF, fx.AS_OF_RECENT
    prof = fx.tenant_profiles
    inv = invocations
    return {
        "avg_quota_percent": lambda s, d: V.avg_quota_percent(metrics(s, d), R),
        "tenant_invocations_hourly": lambda s, d: M.tenant_invocations_hourly(inv(s, d), prof(s)),
        "tenant_tokens_hourly": lambda s, d: M.tenant_tokens_hourly(inv(s, d), prof(s)),
        "quota_gauge": lambda s, d: M.quota_gauge(metrics(s, d)),
        "quota_sparkline": lambda s, d: M.quota_sparkline(metrics(s, d)),
        "tokens_by_user_hourly": lambda s, d: M.tokens_by_user_hourly(metrics(s, d)),
        "monthly_pct_trend": lambda s, d: M.monthly_pct_trend(metrics(s, d)),
        "daily_pct_trend": lambda s, d: M.daily_pct_trend(metrics(s, d)),
        "api_calls_5m": lambda s, d: M.api_calls_5m(replay(s, d)),
        "function_health_5m": lambda s, d: M.function_health_5m(replay(s, d)),
        "duration_stats_5m": lambda s, d: M.duration_stats_5m(calls(s, d)),
        "peak_concurrency_1m": lambda s, d: M.peak_concurrency_1m(calls(s, d)),
        "tenant_comparison_24h": lambda s, d: M.tenant_comparison_24h(inv(s, d), prof(s)),
        "user_token_comparison_24h": lambda s, d: M.user_token_comparison_24h(metrics(s, d)),
        "tenant_latency_5m": lambda s, d: M.tenant_latency_5m(inv(s, d), prof(s)),
        "tenant_errors_5m": lambda s, d: M.tenant_errors_5m(inv(s, d), prof(s)),
        "token_share_24h": lambda s, d: M.token_share_24h(inv(s, d), prof(s), R, 24),
        "quota_status_table": lambda s, d: M.quota_status_table(K.resolve_policy(users(s, d), policies(s, d))),
        "tenant_usage_last_hour": lambda s, d: M.tenant_usage_last_hour(inv(s, d), prof(s), R),
        "user_invocations": lambda s, d: M.user_invocations(inv(s, d), 3600),
        "metric_statistics": lambda s, d: M.metric_statistics(
            inv(s, d), "output_tokens", ["tenant"], 3600, "Average", start="2024-02-01 00:00:00",
            end="2024-02-08 00:00:00", name="avg_output_tokens"),
        "evaluate_alarm_2of2": lambda s, d: AL.evaluate_alarm(
            M.metric_statistics(inv(s, d), F.lit(1), [], 3600, "SampleCount"), 14, 3600, eval_periods=2),
        "high_quota_alarm": lambda s, d: AL.high_quota_alarm(metrics(s, d)),
        "error_alarm": lambda s, d: AL.error_alarm(replay(s, d)),
        "high_token_alarm": lambda s, d: AL.high_token_alarm(inv(s, d)),
        "span_sketches": _span_sketches,
        "rollup_span": _rollup_span,
        "rollup_hourly": _rollup_hourly,
        "storage_tier": lambda s, d: RT.storage_tier(inv(s, d), A),
        "expire_partitions": lambda s, d: RT.expire_partitions(inv(s, d), 30, A).select(
            "request_id", "ts", F.col("usage_day").cast("timestamp_ntz").alias("day")),
    }


# From the middle of an hour to the end of a month, so that every level is read.
ROLLUP_SPAN = dt.datetime(2024, 1, 20, 10, 17), dt.datetime(2024, 3, 1)
ROLLUP_MEASURES = ["input_tokens", "output_tokens", "latency_ms"]


def _rollup_path(spark: SparkSession, sf_dir: str) -> str:
    """Rollups of the fact table per tenant and profile, stored once per application."""
    return derived_path(spark, "rollups", _events_path(sf_dir), lambda: invocations(spark, sf_dir),
                        lambda rows, path: RU.write_rollups(rows, path, ["tenant", "profile_id"], ROLLUP_MEASURES))


def _rollup_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, tokens and latency per tenant over a span, from the coarsest stored levels that make it up."""
    found = RU.rollup_series(spark, _rollup_path(spark, sf_dir), ["tenant"], ["input_tokens", "output_tokens", "latency_ms"], *ROLLUP_SPAN)
    return found.select("tenant", "calls", "input_tokens_sum", "output_tokens_sum", "output_tokens_n", "latency_ms_min", "latency_ms_max", "latency_ms_avg")


def _rollup_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and tokens per profile and hour (M1, M2) of the same span; the hour it cuts comes from minutes."""
    found = RU.rollup_series(spark, _rollup_path(spark, sf_dir), ["profile_id"], ["input_tokens", "output_tokens"], *ROLLUP_SPAN, "hour")
    return found.select("profile_id", "period_start", "calls", "input_tokens_sum", "output_tokens_sum")


def _sketch_path(spark: SparkSession, sf_dir: str) -> str:
    """Daily sketches per tenant of the fact table, stored once per application."""
    return derived_path(spark, "daily_sketches", _events_path(sf_dir), lambda: SK.daily_sketches(
        invocations(spark, sf_dir), ["tenant"], "latency_ms", "user_id"), SK.write_daily_sketches)


def _span_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency quantiles and users per tenant and three days, from the daily sketches alone."""
    days = F.datediff("day", F.lit("2024-01-01").cast("date"))
    found = SK.span_statistics(SK.read_daily_sketches(spark, _sketch_path(spark, sf_dir)), ["tenant"], F.floor(days / 3).cast("int"))
    return found.withColumnRenamed("distinct", "users")


def _inv_path(spark: SparkSession, sf_dir: str) -> str:
    # The events are dealt by time before they become records: neither these nor the facts are sent or stored twice.
    return derived_path(spark, "invocations", _events_path(sf_dir), lambda: normalize_invocations(fx.invocation_log(spark, sf_dir, by_time=True)),
                        lambda df, path: LG.write_invocations_partitioned(df, path, dealt=True))


def _calls_path(spark: SparkSession, sf_dir: str) -> str:
    return derived_path(spark, "gateway_calls", _events_path(sf_dir), lambda: fx.gateway_calls(spark, sf_dir))


def _arrivals_path(spark: SparkSession, sf_dir: str, name: str, build) -> str:
    """Rows with an arrival time ``arrived_at`` as three slices, one after the other arrived; calls are out of order in them."""
    return derived_path(spark, f"{name}_arrivals", _events_path(sf_dir), build,
                        lambda df, path: SC.write_slices(df, path, "arrived_at", [F.xxhash64("ts")]))


def _arrives(df: DataFrame, *after: str) -> DataFrame:
    """Each row delivered at each of ``after`` (SQL intervals) past its own delay of up to five minutes."""
    wait = F.pmod(F.xxhash64("request_id"), F.lit(300)).cast("int")
    return (df.withColumn("_after", F.explode(F.array(*[F.expr(x) for x in after])))
            .withColumn("arrived_at", F.timestamp_add("SECOND", wait, F.col("ts")) + F.col("_after")).drop("_after"))


# Half of the second deliveries come within the hour that the stream's state remembers.
TWICE = ("interval 0 minutes", "if(pmod(xxhash64(request_id), 2) = 0, interval 20 minutes, interval 2 days)")


def _stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 over the log delivered twice, out of order: each request counts once."""
    out = SC.run_dir(spark, "counters")
    columns = ["request_id", "ts", "user_id", "error_type", "input_tokens", "output_tokens"]
    path = _arrivals_path(spark, sf_dir, "deliveries", lambda: _arrives(invocations(spark, sf_dir).select(*columns), *TWICE))
    SC.run_until_caught_up(ST1.stream_usage_counters(SC.slice_stream(spark, path), out + "/sink", out + "/checkpoint", "arrived_at"))
    return ST1.read_counters(spark, out + "/sink")


def _stream_raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 and S2 per micro-batch: tail the JSON log folders, normalise, count per day."""
    out = SC.run_dir(spark, "raw-log-stream")
    stream = normalize_invocations(LG.stream_invocations(spark, _raw_log_path(spark, sf_dir)))
    SC.run_until_caught_up(ST1.stream_usage_counters(stream, out + "/sink", out + "/checkpoint"))
    return ST1.read_counters(spark, out + "/sink")


def _stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5 over the call log delivered twice, out of order."""
    path = _arrivals_path(spark, sf_dir, "calls_twice", lambda: _arrives(calls(spark, sf_dir), *TWICE))
    out = SC.run_dir(spark, "dedup")
    SC.run_until_caught_up(ST1.dedup_stream(SC.slice_stream(spark, path), out + "/sink", out + "/checkpoint", "arrived_at"))
    return ST1.read_deduplicated(spark, out + "/sink", calls(spark, sf_dir).schema)


def _with_tick(rows: DataFrame, seconds: int, period_s: int) -> DataFrame:
    """``rows`` and one without a call, that arrives ``seconds`` after the last period with calls ended."""
    end = F.timestamp_add("SECOND", F.lit(seconds + period_s), bucket_start(F.max("ts"), period_s)).alias("arrived_at")
    return rows.unionByName(cut_lineage(rows.agg(end)), allowMissingColumns=True)


def _metric_stream(spark: SparkSession, sf_dir: str) -> str:
    """Run T2 over the fact table out of order, once per application; returns its folder.

    Every 16th row arrives a day late, after its windows came out.
    """
    columns = ["request_id", "ts", "tenant", "latency_ms", "input_tokens", "output_tokens", "error_type"]
    late = "if(pmod(xxhash64(request_id, 1), 16) = 0, interval 1 day, interval 0 minutes)"
    path = _arrivals_path(spark, sf_dir, "invocations_stream", lambda: _with_tick(
        _arrives(invocations(spark, sf_dir).select(*columns), late), 2 * 86400, 86400))

    def write(stream: DataFrame, out: str) -> None:
        sums = {"tokens": F.col("input_tokens") + F.col("output_tokens"), "errors": F.col("error_type").isNotNull().cast("int")}
        SC.run_until_caught_up(ST2.stream_metrics(stream, ["tenant"], F.col("latency_ms"), sums, out + "/sink", out + "/checkpoint",
                                                  arrived="arrived_at"))

    return derived_path(spark, "metric_windows", _events_path(sf_dir), lambda: SC.slice_stream(spark, path), write)


def _stream_metrics(period_s: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ST2.read_metrics(spark, _metric_stream(spark, sf_dir) + "/sink", ["tenant"], period_s)

    return run


def _token_arrivals(spark: SparkSession, sf_dir: str) -> str:
    return _arrivals_path(spark, sf_dir, "tokens_stream", lambda: _with_tick(
        _arrives(invocations(spark, sf_dir).select("request_id", "ts", "input_tokens"), "interval 0 minutes"), 601, 3600))


def _stream_token_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 on what T2 emits: input tokens per hour, out of order."""
    out = SC.run_dir(spark, "token-alarm")
    SC.run_until_caught_up(ST2.stream_metrics(
        SC.slice_stream(spark, _token_arrivals(spark, sf_dir)), [], F.lit(None).cast("bigint"), {"value": F.col("input_tokens")},
        out + "/sink", out + "/checkpoint", [3600], arrived="arrived_at"))
    return AL.evaluate_alarm(ST2.read_metrics(spark, out + "/sink", [], 3600).select("period_start", "value"), 1_000_000, 3600)


def _alerts(spark: SparkSession, path: str, name: str, value, how: str, threshold: float, period_s: int) -> DataFrame:
    out = SC.run_dir(spark, name)
    SC.run_until_caught_up(ST3.stream_alerts(SC.slice_stream(spark, path), value, how, threshold, period_s, out + "/sink", out + "/checkpoint",
                                             arrived="arrived_at"))
    return spark.read.schema(ST3.CHANGES).parquet(out + "/sink")


def _stream_token_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 for A3: changes of the alarm on TOKEN_ALERT input tokens an hour, as they are emitted."""
    return _alerts(spark, _token_arrivals(spark, sf_dir), "token-alerts", F.col("input_tokens"), "sum", TOKEN_ALERT, 3600)


# The alarm's own million tokens an hour is never reached in the test data.
TOKEN_ALERT = 6_000


def _decision_arrivals(spark: SparkSession, sf_dir: str) -> str:
    """T4's decisions as a stream with arrival times."""
    used = F.col("monthly_usage") + F.col("charged_tokens")
    pct = F.when(F.col("metric_monthly_limit") > 0, used / F.col("metric_monthly_limit") * F.lit(100)).otherwise(F.lit(0.0))
    return _arrivals_path(spark, sf_dir, "decisions", lambda: _with_tick(_arrives(_decision_stream(spark, sf_dir).select(
        "request_id", "ts", "status", F.when(F.col("status") == 200, pct).alias("pct")), "interval 0 minutes"), 601, 300))


def _stream_error_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 for A2: changes of the alarm on failed calls per five minutes, behind T4."""
    return _alerts(spark, _decision_arrivals(spark, sf_dir), "error-alerts", (F.col("status") == 500).cast("int"), "sum", ERROR_ALERT, 300)


# More than one failed call in five minutes, as the alarm's own five are rare in the test data.
ERROR_ALERT = 1


def _stream_quota_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 for A1: changes of the alarm on the highest quota percent per five minutes, behind T4."""
    return _alerts(spark, _decision_arrivals(spark, sf_dir), "quota-alerts", F.col("pct"), "max", 80.0, 300)


def _alarm_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A0 with each rule for missing data: changes of the alarm on more than one call in two periods of ten minutes, per tenant."""
    series = cut_lineage(M.metric_statistics(invocations(spark, sf_dir), F.lit(1), ["tenant"], 600, "SampleCount"))
    found = [AL.alarm_transitions(series, 1, 600, 2, ["tenant"], missing=rule).withColumn("rule", F.lit(rule)) for rule in AL.MISSING_RULES]
    return reduce(DataFrame.unionByName, found)


def _run_decisions(spark: SparkSession, sf_dir: str, rows: DataFrame, out: str) -> DataFrame:
    """T4 over the call log ``rows`` in three slices of time, one micro-batch each; returns the decisions."""
    paths = [derived_path(spark, name, _events_path(sf_dir), lambda b=build: b(spark, sf_dir))
             for name, build in (("user_metadata", fx.user_metadata), ("quota_policies", fx.quota_policies))]

    SC.write_slices(rows, out + "/calls", "ts")
    SC.run_until_caught_up(ST4.stream_quota_decisions(
        SC.slice_stream(spark, out + "/calls"), lambda: tuple(map(spark.read.parquet, paths)),
        out + "/sink", out + "/checkpoint"))
    return ST4.read_decisions(spark, out + "/sink")


def _stream_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_decisions(spark, sf_dir, calls(spark, sf_dir), SC.run_dir(spark, "quota"))


def _decision_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4's decisions, streamed once per application; alarms read them where the stream put them."""
    path = derived_path(spark, "quota_decisions_stream", _events_path(sf_dir), lambda: calls(spark, sf_dir),
                        lambda rows, out: _run_decisions(spark, sf_dir, rows, out))
    return ST4.read_decisions(spark, path + "/sink")


def _stream_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 for A2: failed calls per five minutes behind T4."""
    return AL.error_alarm(_decision_stream(spark, sf_dir))


def _raw_log_path(spark: SparkSession, sf_dir: str) -> str:
    """The fixture log stored as hourly JSON folders (built once per application)."""
    return derived_path(spark, "raw_log_json", _events_path(sf_dir), lambda: fx.invocation_log(spark, sf_dir, by_hour=True), fx.write_raw_log)


# Rows older than this go from the stored table; it lies inside an hour.
EXPIRY = fx.AS_OF - dt.timedelta(days=25, minutes=20)


def _source_queries() -> dict[str, Query]:
    A = fx.AS_OF
    since = fx.AS_OF - dt.timedelta(days=7)

    def read_logs(s, d):
        raw = LG.read_invocation_logs(s, _raw_log_path(s, d), since=since)
        inv = U.since_filter(normalize_invocations(raw), U.ts_lit(since))
        return inv.groupBy(F.col("usage_day").cast("timestamp_ntz").alias("day")).agg(
            F.count(F.lit(1)).alias("calls"),
            F.sum(F.col("input_tokens") + F.col("output_tokens")).cast("bigint").alias("tokens"))

    def discover(s, d):
        previous = T.StructType([f for f in INVOCATION_LOG.fields if f.name not in ("latency_ms", "region")])
        return LG.discover_schema(s, _raw_log_path(s, d), previous)[1]

    def widened(s, d):
        path = derived_path(s, "changing_log_json", _events_path(d), lambda: fx.invocation_log(s, d, by_hour=True), fx.write_changing_log)
        schema = None
        for era in ("era=1", "era=2"):
            schema, _ = LG.discover_schema(s, f"{path}/{era}", schema)
        inv = normalize_invocations(LG.read_invocation_logs(s, path, schema=schema))
        total = lambda c: F.sum(c).cast("bigint").alias(c)
        return inv.groupBy(F.col("usage_day").cast("timestamp_ntz").alias("day")).agg(
            F.count(F.lit(1)).alias("calls"), total("input_tokens"), total("output_tokens"), total("latency_ms"))

    def load_users(s, d):
        path = SC.run_dir(s, "user-puts")
        fx.user_metadata_puts(users(s, d)).write.mode("overwrite").json(path)
        return DM.load_user_metadata(s, path).select("userId", "group", "tenant", "department", "updatedAt")

    def load_profiles(s, d):
        path = SC.run_dir(s, "profile-puts")
        fx.profile_puts(s, d).write.mode("overwrite").json(path)
        return DM.load_tenant_profiles(s, path).select("profile_id", "name", "tenant", "color", "updatedAt")

    def report(s, d):
        path = SC.run_dir(s, "report")
        LG.write_report(U.department_cost(invocations(s, d), A, fx.ACCOUNT), path)
        return s.read.parquet(path)

    def freshness(s, d):
        inv = invocations(s, d)
        srcs = inv.where(F.col("source").isNotNull()).select("source").distinct().unionByName(
            s.createDataFrame([("batch-import",)], "source string"))
        return LG.log_freshness(inv, srcs, fx.AS_OF_RECENT)

    def write_hourly(s, d):
        path = SC.run_dir(s, "fact-hourly")
        LG.write_invocations_partitioned(invocations(s, d), path, layout="hour")
        back = LG.read_invocations(s, path)
        return back.groupBy("year", "month", "day", "hour").agg(
            F.count(F.lit(1)).alias("calls"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))

    def expire_stored(s, d):
        path = SC.run_dir(s, "fact-expiring")
        LG.write_invocations_partitioned(invocations(s, d), path, layout="hour")
        RT.expire_stored(s, path, EXPIRY)
        back = LG.read_invocations(s, path)
        return back.groupBy("year", "month", "day", "hour").agg(
            F.count(F.lit(1)).alias("calls"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))

    def load_policies(s, d):
        path = SC.run_dir(s, "policy-puts")
        pols = policies(s, d)
        later = (pols.where(F.col("policy_type") == "group")
                 .withColumn("enforcement_mode", F.lit("alert")).withColumn("updatedAt", F.lit("2024-02-01T00:00:00Z")))
        pols.unionByName(later).write.mode("overwrite").json(path)
        return DM.load_quota_policies(s, path).select(
            "policy_type", "identifier", "monthly_limit", "daily_limit", "enforcement_mode")

    return {
        "sql_dialect_project_hours": _dialect_project_hours,
        "load_tenant_profiles": load_profiles,
        "upsert_dimension_put": lambda s, d: DM.upsert_dimension(
            users(s, d), fx.department_puts(users(s, d)), ["userId"]).select(
            "userId", "group", "department", "monthlyLimit", "dailyLimit", "updatedAt"),
        "normalize_rejects": lambda s, d: normalize_rejects(fx.invocation_log(s, d)),
        "write_invocations_partitioned": write_hourly,
        "expire_stored_partitions": expire_stored,
        "load_quota_policies": load_policies,
        "normalize_invocations": lambda s, d: invocations(s, d).select(*NORMALIZED_COLUMNS).withColumn(
            "usage_day", F.col("usage_day").cast("timestamp_ntz")),
        "read_invocation_logs": read_logs,
        "discover_schema": discover,
        "read_widened_log": widened,
        "load_user_metadata": load_users,
        "write_report": report,
        "log_file_inventory": lambda s, d: LG.folder_inventory(LG.log_file_inventory(s, _raw_log_path(s, d), n=None)),
        "log_freshness": freshness,
        "upsert_dimension": lambda s, d: DM.upsert_dimension(
            users(s, d), fx.limit_changes(users(s, d)), ["userId"], partial=True).select(
            "userId", "group", "monthlyLimit", "dailyLimit", "updatedAt"),
        "derive_user_policies": lambda s, d: DM.derive_user_policies(users(s, d)).select(
            "policy_type", "identifier", "monthly_limit", "daily_limit", "enforcement_mode", "description"),
        "usage_totals": lambda s, d: usage_totals(invocations(s, d)),
        "enrich_identity_reject": lambda s, d: K.enrich_identity(calls(s, d), users(s, d), "reject"),
    }


# Use of the two dialect functions on their own ground: nested metadata,
# missing metadata and ISO times, in hours of the day.
DIALECT_PROJECT_HOURS = """
WITH parsed AS (
  SELECT hour(from_iso8601_timestamp(timestamp)) AS hour_of_day,
         coalesce(json_extract_scalar(requestmetadata, '$.project'), 'none') AS project,
         json_extract_scalar(error, '$.type') AS failure,
         CAST(json_extract_scalar(usage, '$.outputTokens') AS BIGINT) AS answer
  FROM invocations)
SELECT project, hour_of_day, count(*) AS calls, count(failure) AS failures, max(answer) AS longest_answer
FROM parsed GROUP BY project, hour_of_day
"""


def _dialect_project_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quotalake.plans.sqlcompat import register_invocations_view

    register_invocations_view(spark, fx.invocation_log(spark, sf_dir))
    return spark.sql(DIALECT_PROJECT_HOURS)


NORMALIZED_COLUMNS = ["ts", "account_id", "request_id", "model_id", "profile_id", "user_id", "tenant",
                      "user_group", "department", "source", "input_tokens", "output_tokens", "error_type",
                      "latency_ms", "usage_month", "usage_day"]


def _stream_quota_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3 for A1: quota percent behind T4."""
    return ST4.read_quota_alarm(_decision_stream(spark, sf_dir))


def _stream_queries() -> dict[str, Query]:
    return {
        "stream_quota_alarm": _stream_quota_alarm,
        "stream_usage_counters": _stream_counters,
        "stream_raw_log": _stream_raw_log,
        "dedup_stream": _stream_dedup,
        "stream_metrics_1m": _stream_metrics(60),
        "stream_metrics_5m": _stream_metrics(300),
        "stream_metrics_1h": _stream_metrics(3600),
        "stream_metrics_1d": _stream_metrics(86400),
        "stream_alarms": _stream_alarms,
        "stream_token_alarm": _stream_token_alarm,
        "stream_token_alerts": _stream_token_alerts,
        "stream_error_alerts": _stream_error_alerts,
        "stream_quota_alerts": _stream_quota_alerts,
        "alarm_missing_rules": _alarm_rules,
        "stream_quota_decisions": _stream_decisions,
    }


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    out.update(_usage_queries())
    out.update(_variant_queries())
    out.update(_quota_queries())
    out.update(_metric_queries())
    out.update(_stream_queries())
    out.update(_source_queries())
    return out
