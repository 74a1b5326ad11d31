"""Identity enrichment, policy resolution, usage counters, quota checks
and the replay of the check-then-add protocol over a call log.

Check semantics (per call, per user): usage of the current month and day is
read, ``exceeded = usage >= limit``; in ``block`` mode the call is allowed
only if neither limit is exceeded, in any other mode it is always allowed;
allowed successful calls add their tokens to both counters.  Periods are
event-time (UTC) calendar months and days.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotalake.functions.timecols import day_key, epoch_seconds, month_key, month_start
from quotalake.operators.usage import ts_lit
from quotalake.plans.asof import in_force
from quotalake.plans.scan import prefix_sums, with_chunk
from quotalake.session import cut_lineage

# The built-in policy used when no policy row matches, the
# identity defaults, and the rejection response.
BUILTIN_MONTHLY_LIMIT = 100000000
BUILTIN_DAILY_LIMIT = 5000000
BUILTIN_MODE = "alert"
DEFAULT_MODE = "block"
DEFAULT_GROUP = "default"
DEFAULT_TENANT = "default"
DEFAULT_DEPARTMENT = "unknown"
METRIC_DEFAULT_TENANT = "unknown"
GATEWAY_SOURCE = "hybrid-gateway"
RETRY_AFTER_SECONDS = 3600
MONTHLY_TTL_DAYS = 60
DAILY_TTL_DAYS = 7


def _users(users: DataFrame) -> DataFrame:
    return users.select(
        F.col("userId").alias("user_id"),
        F.col("group").alias("_group"), F.col("tenant").alias("_tenant"),
        F.col("department").alias("_department"),
    )


# ---------------------------------------------------------------- K1
def enrich_identity(calls: DataFrame, users: DataFrame, on_missing_user: str = "reject") -> DataFrame:
    """K1: attach group / tenant / department of the caller.

    ``reject`` drops calls of users without metadata (they get 404 in
    ``request_outcomes``); ``default`` keeps them with default identity.
    """
    joined = calls.join(_users(users).withColumn("_known", F.lit(True)), "user_id", "left")
    out = joined.select(
        *calls.columns,
        F.coalesce("_group", F.lit(DEFAULT_GROUP)).alias("user_group"),
        F.coalesce("_tenant", F.lit(DEFAULT_TENANT)).alias("tenant"),
        F.coalesce("_department", F.lit(DEFAULT_DEPARTMENT)).alias("department"),
        F.lit(GATEWAY_SOURCE).alias("source"),
        F.coalesce("_known", F.lit(False)).alias("known_user"),
    )
    if on_missing_user == "reject":
        return out.where("known_user")
    if on_missing_user == "default":
        return out
    raise ValueError(f"on_missing_user must be 'reject' or 'default', not {on_missing_user!r}")


# ---------------------------------------------------------------- K2
def resolve_policy(users: DataFrame, policies: DataFrame) -> DataFrame:
    """K2: the policy row of each user: user row, else group row, else default row,
    else the built-in constants.  The whole row is taken from the first match,
    so a matched row with a missing limit yields limit 0 for checks (and 1 for
    the percent metrics) rather than falling through.

    User rows are joined on the user id, group rows (one per group) on the
    group, and the one default row is a scalar subquery, so no join key is
    shared by all users.
    """
    u = users.select(
        F.col("userId").alias("user_id"),
        F.coalesce(F.col("group"), F.lit(DEFAULT_GROUP)).alias("user_group"),
        F.col("tenant"), F.col("department"),
    )
    row = F.struct("monthly_limit", "daily_limit", "enforcement_mode", F.col("policy_type").alias("source"))

    def rows(kind: str, key: str, out: str) -> DataFrame:
        own = policies.where((F.col("policy_type") == kind) & F.col("identifier").isNotNull())
        return own.groupBy(F.col("identifier").alias(key)).agg(F.first(row).alias(out))

    default = (policies.where((F.col("policy_type") == "default") & (F.col("identifier") == "default"))
               .agg(F.first(row).alias("p")).scalar())
    best = (u.join(rows("user", "user_id", "_user"), "user_id", "left")
            .join(rows("group", "user_group", "_group"), "user_group", "left")
            .withColumn("_default", default)
            .withColumn("p", F.coalesce("_user", "_group", "_default")))
    return best.select("user_id", "user_group", "tenant", "department", *_limits(F.col("p")))


def _limits(p: Column) -> list[Column]:
    """The columns of a resolved policy from its matched row ``p``; the built-in constants where there is none."""
    hit = p.isNotNull()
    return [
        F.when(hit, p["source"]).otherwise(F.lit("builtin")).alias("policy_source"),
        F.when(hit, F.coalesce(p["monthly_limit"], F.lit(0))).otherwise(F.lit(BUILTIN_MONTHLY_LIMIT))
        .cast("bigint").alias("monthly_limit"),
        F.when(hit, F.coalesce(p["daily_limit"], F.lit(0))).otherwise(F.lit(BUILTIN_DAILY_LIMIT))
        .cast("bigint").alias("daily_limit"),
        F.when(hit, F.coalesce(p["enforcement_mode"], F.lit(DEFAULT_MODE))).otherwise(F.lit(BUILTIN_MODE))
        .alias("enforcement_mode"),
        F.when(hit, F.coalesce(p["monthly_limit"], F.lit(1))).otherwise(F.lit(BUILTIN_MONTHLY_LIMIT))
        .cast("bigint").alias("metric_monthly_limit"),
        F.when(hit, F.coalesce(p["daily_limit"], F.lit(1))).otherwise(F.lit(BUILTIN_DAILY_LIMIT))
        .cast("bigint").alias("metric_daily_limit"),
    ]


def resolve_policy_at(calls: DataFrame, users: DataFrame, versions: DataFrame, chunk_seconds: int = 3600) -> DataFrame:
    """K2 at the time of each call: every call with the limits that were in force at its ``ts``.

    ``versions`` are ``policy_versions``.  The call's user row, else its
    group's row, else the default row counts, each as it stood at that time,
    else the built-in constants.  ``policy_since`` is when the matched row
    came into force (null for the constants).  Calls without a user id or of
    unknown users have a null ``policy_source``.
    """
    known = users.select(F.col("userId").alias("user_id"), F.coalesce(F.col("group"), F.lit(DEFAULT_GROUP)).alias("user_group"),
                         "tenant", "department", F.lit("default").alias("_everyone"))
    row = F.struct("monthly_limit", "daily_limit", "enforcement_mode", F.col("policy_type").alias("source"),
                   F.col("valid_from").alias("since"))
    at = calls.join(known, "user_id", "left")
    for kind, key in (("user", "user_id"), ("group", "user_group"), ("default", "_everyone")):
        own = versions.where(F.col("policy_type") == kind).select(F.col("identifier").alias(key), "valid_from", row.alias("row"))
        at = in_force(at, key, own.where(F.col(key) == "default") if kind == "default" else own, f"_{kind}", "ts", chunk_seconds)
    p = F.coalesce("_user", "_group", "_default")
    found = at.withColumn("p", p).select(
        *calls.columns, "user_group", "tenant", "department", "_everyone", F.col("p.since").alias("policy_since"), *_limits(F.col("p")))
    return (found.withColumn("policy_source", F.when(F.col("_everyone").isNotNull(), F.col("policy_source"))).drop("_everyone"))


# ---------------------------------------------------------------- K3
def call_tokens() -> Column:
    return F.coalesce(F.col("input_tokens"), F.lit(0)) + F.coalesce(F.col("output_tokens"), F.lit(0))


def usage_counters(inv: DataFrame) -> DataFrame:
    """K3: counters ``(user_email, metric_period)`` with tokens of successful calls.

    The calls are read and shuffled once, to (user, day).
    """
    ok = inv.where(F.col("user_id").isNotNull() & F.col("error_type").isNull())
    return counters_from_daily(
        ok.groupBy(F.col("user_id").alias("user_email"), F.col("usage_day").alias("day"))
        .agg(F.sum(call_tokens()).cast("bigint").alias("tokens_used"), F.max("ts").alias("last_updated")))


def counters_from_daily(daily: DataFrame) -> DataFrame:
    """Counters of (user_email, day, tokens_used, last_updated) rows: each day adds to its own and its month's.

    One branch: every daily row is doubled and summed per period, so the
    daily rows are computed once.
    """
    month = F.trunc("day", "MM")
    month_ttl = epoch_seconds(month.cast("timestamp_ntz")) + F.lit(MONTHLY_TTL_DAYS * 86400)
    both = daily.select("user_email", "tokens_used", "last_updated", F.explode(F.array(
        F.struct(month_key(month).alias("metric_period"), month_ttl.alias("month_ttl")),
        F.struct(day_key(F.col("day")).alias("metric_period"), F.lit(None).cast("bigint").alias("month_ttl")))).alias("p"))
    return (both.groupBy("user_email", "p.metric_period")
            .agg(F.sum("tokens_used").cast("bigint").alias("tokens_used"), F.max("last_updated").alias("last_updated"),
                 F.max("p.month_ttl").alias("_ttl"))
            .select("user_email", "metric_period", "tokens_used", "last_updated",
                    F.coalesce("_ttl", epoch_seconds(F.col("last_updated")) + F.lit(DAILY_TTL_DAYS * 86400)).alias("ttl")))


# ---------------------------------------------------------------- K4 / K5 / K7
def check_quota(users: DataFrame, policies: DataFrame, counters: DataFrame, as_of) -> DataFrame:
    """K4: would a call by each user be allowed at ``as_of``?  Missing counters are 0."""
    now = ts_lit(as_of)
    mk, dk = month_key(now), day_key(now)
    usage = (counters.where(F.col("metric_period").isin(mk, dk))
             .groupBy(F.col("user_email").alias("user_id"))
             .agg(F.sum(F.when(F.col("metric_period") == mk, F.col("tokens_used"))).alias("_m"),
                  F.sum(F.when(F.col("metric_period") == dk, F.col("tokens_used"))).alias("_d")))
    r = resolve_policy(users, policies).join(usage, "user_id", "left")
    out = r.select(
        "user_id", "enforcement_mode",
        F.coalesce("_m", F.lit(0)).cast("bigint").alias("monthly_usage"), "monthly_limit",
        F.coalesce("_d", F.lit(0)).cast("bigint").alias("daily_usage"), "daily_limit",
    )
    out = (out.withColumn("monthly_exceeded", F.col("monthly_usage") >= F.col("monthly_limit"))
           .withColumn("daily_exceeded", F.col("daily_usage") >= F.col("daily_limit")))
    return out.withColumn("allowed", _allowed(out))


def _allowed(df: DataFrame) -> Column:
    blocked = df["monthly_exceeded"] | df["daily_exceeded"]
    return F.when(df["enforcement_mode"] == F.lit("block"), ~blocked).otherwise(F.lit(True))


def quota_remaining(checked: DataFrame) -> DataFrame:
    """K5: limit, used and remaining (may be negative) per period."""
    return checked.select(
        "user_id",
        "monthly_limit", F.col("monthly_usage").alias("monthly_used"),
        (F.col("monthly_limit") - F.col("monthly_usage")).alias("monthly_remaining"),
        "daily_limit", F.col("daily_usage").alias("daily_used"),
        (F.col("daily_limit") - F.col("daily_usage")).alias("daily_remaining"),
    )


def quota_exceeded_messages(checked: DataFrame) -> DataFrame:
    """K7: the 429 response of each rejected check: message parts joined by ' | '."""
    monthly = F.when(F.col("monthly_exceeded"), F.format_string(
        "Monthly quota exceeded (%d/%d tokens)", F.col("monthly_usage"), F.col("monthly_limit")))
    daily = F.when(F.col("daily_exceeded"), F.format_string(
        "Daily quota exceeded (%d/%d tokens)", F.col("daily_usage"), F.col("daily_limit")))
    keys = [c for c in ("request_id", "user_id") if c in checked.columns]
    return checked.where(~F.col("allowed")).select(
        *keys,
        F.lit(429).alias("status"),
        F.lit("Quota exceeded").alias("error"),
        F.concat_ws(" | ", monthly, daily).alias("message"),
        F.lit(RETRY_AFTER_SECONDS).alias("retry_after"),
        F.col("monthly_usage").alias("monthly_used"), "monthly_limit",
        F.col("daily_usage").alias("daily_used"), "daily_limit",
    )


# ---------------------------------------------------------------- K8
def prepare_calls(calls: DataFrame, users: DataFrame, policies: DataFrame) -> DataFrame:
    """Calls with their user's policy, tokens, day and month; ``status`` is 400 (no user id), 404 (unknown user) or null."""
    return _prepared(calls.join(resolve_policy(users, policies), "user_id", "left"))


def _prepared(resolved: DataFrame) -> DataFrame:
    return (resolved
            .withColumn("status", F.when(F.col("user_id").isNull(), F.lit(400))
                        .when(F.col("policy_source").isNull(), F.lit(404)))
            .withColumn("tokens", F.when(F.col("failed"), F.lit(0)).otherwise(call_tokens()).cast("bigint"))
            .withColumn("_day", F.to_date("ts"))
            .withColumn("_month", F.trunc(F.to_date("ts"), "MM")))


def rejected_calls(prepared: DataFrame) -> DataFrame:
    return prepared.where("status is not null").select("request_id", "ts", "user_id", "status")


def quota_replay(calls: DataFrame, users: DataFrame, policies: DataFrame, chunk_seconds: int = 60) -> DataFrame:
    """K8: replay a call log through check-then-add; one row per call.

    ``calls``: request_id, ts, user_id, input_tokens, output_tokens, failed.
    Order within a user is (ts, request_id).  Failed calls are checked but
    add nothing.  Calls without user id get 400, unknown users 404.

    ``decide_calls`` has the rules and why they equal the protocol.
    """
    base = prepare_calls(calls, users, policies)
    decided = decide_calls(base.where("status is null"), chunk_seconds, calls)
    return _replayed(decided).unionByName(rejected_calls(base), allowMissingColumns=True)


def _replayed(decided: DataFrame) -> DataFrame:
    return decided.select(
        "request_id", "ts", "user_id", "user_group", "tenant", "department", "policy_source",
        "enforcement_mode", "monthly_limit", "daily_limit", "metric_monthly_limit", "metric_daily_limit",
        "tokens", "failed", "allowed", "charged_tokens", "monthly_usage", "daily_usage",
        (F.col("monthly_usage") >= F.col("monthly_limit")).alias("monthly_exceeded"),
        (F.col("daily_usage") >= F.col("daily_limit")).alias("daily_exceeded"), "status")


def decide_calls(t: DataFrame, chunk_seconds: int = 60, calls: DataFrame | None = None,
                 carried: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """Check-then-add for prepared rows (tokens >= 0, _day, _month, limits, mode, failed); sets ``status`` 200, 429 or 500.

    ``_carry_d`` and ``_carry_m``, where given, are the usage accepted before
    these rows in their day and month; 0 otherwise.  Limits, mode and carry
    are constant within a user's day.

    In block mode the calls that a day accepts are its first ones: those with
    d < cap, where d is the sum of all earlier tokens of the day, accepted or
    not.  As long as every call is accepted d is the usage, and at the first
    d >= cap the usage stays at that value, so all later calls are refused.
    The cap is what is left of the daily limit, or of the monthly limit after
    the earlier days, whichever is less.  What a day accepts in all is the
    first running total >= cap (all tokens if there is none).  For the
    monthly limit it does for earlier days to accept by the daily limit
    alone: from the call on that reaches the monthly limit this sum is too
    high, and every call is refused with either.

    The rows are exchanged once, by user, and all this is told by running
    sums over the order they are sorted in.  Only a user's month of more
    than HOT_CALLS calls, which one task should not hold, is decided in
    chunks that spread over many tasks (``_decide_in_chunks``).  ``calls``
    (user_id, ts), from which ``t`` was made, is counted for that if given.
    ``carried`` adds the carry to rows, which it gets dealt by user.
    """
    t = t.where(F.col("ts").isNotNull())
    counted = t if calls is None else calls.select("user_id", F.trunc(F.to_date("ts"), "MM").alias("_month"))
    hot = cut_lineage(counted.groupBy("user_id", "_month").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_CALLS).drop("_n"))
    none = hot.isEmpty()
    few, keys = F.broadcast(hot), ["user_id", "_month"]  # one row per HOT_CALLS calls at most

    def with_carry(rows: DataFrame) -> DataFrame:
        rows = carried(rows)
        return rows.withColumns({c: F.lit(0).cast("bigint") for c in ("_carry_d", "_carry_m") if c not in rows.columns})

    found = _decide_in_order(with_carry((t if none else t.join(few, keys, "left_anti")).repartition("user_id")))
    return found if none else found.unionByName(_decide_in_chunks(with_carry(t.join(few, keys, "left_semi")), chunk_seconds))


# Calls of a user's month that one task decides.
HOT_CALLS = 50_000


def _decide_in_order(t: DataFrame) -> DataFrame:
    """``decide_calls`` by running sums over each user's month in order of time."""
    order = ["ts", "request_id"]
    day, month = Window.partitionBy("user_id", "_month", "_day").orderBy(*order), Window.partitionBy("user_id", "_month").orderBy("_day", *order)
    upto = lambda c, w: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blocks = F.col("enforcement_mode") == F.lit("block")
    left = F.col("daily_limit") - F.col("_carry_d")
    part = lambda cap: F.when(cap.isNull() | (F.col("_d") < cap), F.col("tokens")).otherwise(F.lit(0))
    rows = t.withColumn("_d", upto("tokens", day) - F.col("tokens"))
    rows = rows.withColumn("_x", part(left))  # by the daily limit alone
    rows = rows.withColumn("_before", upto("_x", month) - upto("_x", day))
    rows = rows.withColumn("_cap", F.when(blocks, F.least(left, F.col("monthly_limit") - F.col("_carry_m") - F.col("_before"))))
    rows = rows.withColumn("_y", part(F.col("_cap")))
    rows = rows.withColumns({"_taken": upto("_y", day) - F.col("_y"), "_earlier": upto("_y", month) - upto("_y", day)})
    return _decided(rows)


def _decide_in_chunks(t: DataFrame, chunk_seconds: int) -> DataFrame:
    """``decide_calls`` with no task holding a user's day.

    One running sum over the rows is enough (one exchange of them, on
    (user, chunk), so that a user with a third of all calls is spread over
    many tasks; one stored copy); everything else is small: one row per user
    and day, one window over the days of a user's month.
    """
    order = [F.col("ts"), F.col("request_id")]
    rows = cut_lineage(prefix_sums(with_chunk(t, "ts", chunk_seconds), "user_id", order, [("tokens", "_day", "_d")], materialize=False))
    blocks = F.col("enforcement_mode") == F.lit("block")
    end = F.col("_d") + F.col("tokens")

    def taken(cap: Column) -> Column:
        """Tokens that a day takes under a cap: an aggregate over its rows."""
        return F.when(cap <= 0, F.lit(0)).otherwise(F.coalesce(F.min(F.when(end >= cap, end)), F.max(end)))

    left = F.col("daily_limit") - F.col("_carry_d")
    per_day = ["user_id", "_month", "_day", "daily_limit", "monthly_limit", "enforcement_mode", "_carry_d", "_carry_m"]
    # Few distinct chunks per day: what follows for a day reaches its rows through them, and no join has a day as its key.
    chunks = rows.groupBy("user_id", "_chunk", "_day").agg(F.lit(1).alias("_one")).drop("_one")
    days = rows.groupBy(*per_day).agg(taken(left).alias("_by_day"), F.max(end).alias("_all"))
    before = Window.partitionBy("user_id", "_month").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    days = (days.withColumn("_cap", F.when(blocks, F.least(left, F.col("monthly_limit") - F.col("_carry_m") - so_far("_by_day"))))
            .withColumn("_split", blocks & (F.col("_cap") < left) & (F.col("_cap") > 0)))
    # The day on which a month runs out (one per user and month) is looked at once more under its own cap.
    last = days.where("_split").select("user_id", "_day", "_cap")
    cut = (rows.join(last, ["user_id", "_day"]).groupBy("user_id", "_day").agg(F.min(F.when(end >= F.col("_cap"), end)).alias("_cut")))
    accepted = (F.when(~blocks | F.col("_cap").isNull(), F.col("_all")).when(F.col("_cap") <= 0, F.lit(0))
                .when(F.col("_split"), F.coalesce("_cut", "_all")).otherwise(F.col("_by_day")))
    days = days.join(cut, ["user_id", "_day"], "left").withColumn("_taken", accepted)
    days = days.select("user_id", "_day", "_cap", "_taken", so_far("_taken").alias("_earlier"))
    return _decided(rows.join(chunks.join(days, ["user_id", "_day"]).drop("_day"), ["user_id", "_chunk"]))


def _decided(t: DataFrame) -> DataFrame:
    """Columns of a decision from ``_d``, the day's ``_cap`` and what it ``_taken``, and what days ``_earlier`` took."""
    kept = [c for c in t.columns if not c.startswith("_") or c in ("_day", "_month")]
    fits = F.col("_cap").isNull() | (F.col("_d") < F.col("_cap"))
    used = F.when(fits, F.col("_d")).otherwise(F.col("_taken"))
    return (t.withColumn("allowed", fits)
            .withColumn("charged_tokens", F.when(F.col("allowed"), F.col("tokens")).otherwise(F.lit(0)))
            .withColumn("daily_usage", (F.col("_carry_d") + used).cast("bigint"))
            .withColumn("monthly_usage", (F.col("_carry_m") + F.col("_earlier") + used).cast("bigint"))
            .withColumn("status", F.when(~F.col("allowed"), F.lit(429)).when(F.col("failed"), F.lit(500)).otherwise(F.lit(200)))
            .select(*[c for c in kept if c not in ("allowed", "charged_tokens", "daily_usage", "monthly_usage", "status")],
                    "allowed", "charged_tokens", "daily_usage", "monthly_usage", "status"))


def quota_replay_versions(calls: DataFrame, users: DataFrame, versions: DataFrame, chunk_seconds: int = 60) -> DataFrame:
    """K8 with the limits in force at the time of each call (``versions``: S8 ``policy_versions``); one row per call.

    A raised limit counts from its put on: calls refused before it have used
    nothing.  The calls of a user's month are decided stretch by stretch of
    constant limits, all users' first stretches in one pass, then all second
    ones on top of what the first accepted, and so on; there are as many
    passes as the most often changed policy has versions within a month, and
    each call is in one of them.
    """
    base = cut_lineage(_prepared(resolve_policy_at(calls, users, versions)))
    known = base.where("status is null")
    since = F.coalesce("policy_since", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))
    stretches = known.select("user_id", "_month", since.alias("_since")).distinct()
    number = F.row_number().over(Window.partitionBy("user_id", "_month").orderBy("_since")) - 1
    numbered = cut_lineage(stretches.withColumn("_stretch", number).where("_stretch > 0"))
    known = cut_lineage(known.withColumn("_since", since).join(numbered, ["user_id", "_month", "_since"], "left")
                        .withColumn("_stretch", F.coalesce("_stretch", F.lit(0))))
    passes = 1 + (numbered.agg(F.max("_stretch")).first()[0] or 0)
    decided = None
    for k in range(passes):
        part = known.where(F.col("_stretch") == k).drop("_stretch", "_since")
        if decided is not None:
            earlier = decided.join(numbered.where(F.col("_stretch") == k).select("user_id", "_month"), ["user_id", "_month"], "left_semi")
            for key, out in (("_month", "_carry_m"), ("_day", "_carry_d")):
                carry = earlier.groupBy("user_id", key).agg(F.sum("charged_tokens").cast("bigint").alias(out))
                part = part.join(carry, ["user_id", key], "left").fillna(0, [out])
        done = cut_lineage(decide_calls(part, chunk_seconds).select(*_DECIDED))
        decided = done if decided is None else decided.unionByName(done)
    return _replayed(decided).unionByName(rejected_calls(base), allowMissingColumns=True)


_DECIDED = ["request_id", "ts", "user_id", "user_group", "tenant", "department", "policy_source", "enforcement_mode",
            "monthly_limit", "daily_limit", "metric_monthly_limit", "metric_daily_limit", "tokens", "failed", "allowed",
            "charged_tokens", "monthly_usage", "daily_usage", "status", "_day", "_month"]


def replay_span(spark, root: str, calls: DataFrame, users: DataFrame, policies: DataFrame, start, end, chunk_seconds: int = 60) -> None:
    """K8 and K3 for the days ``start`` <= day < ``end`` (dates) on top of the spans closed before.

    Reads the calls of these days and the carry that the last closed span of
    the same month left (one row per user with calls in that month), never
    earlier calls.  Writes, as partitions of tables under ``root``,
    ``decisions`` and ``daily`` counters by ``day``, and ``carry`` by
    ``closed`` (= ``end``): accepted tokens per user of the month that ``end``
    lies in, none if ``end`` starts a month.  Running a span again replaces
    its partitions.  Spans are run in order of time and meet at their ends; a
    span whose month has begun and whose predecessor is not closed is an
    error.  Within a month, n spans give the rows of one full replay.
    """
    if end <= start:
        raise ValueError("a span has at least one day")
    inside = calls.where((F.col("ts") >= F.lit(str(start)).cast("timestamp_ntz")) & (F.col("ts") < F.lit(str(end)).cast("timestamp_ntz")))
    base = prepare_calls(inside, users, policies)
    known, carried = base.where("status is null"), None
    if start.day != 1 and _closed(spark, root, start):
        carried = (spark.read.schema(CARRY).parquet(f"{root}/carry").where(F.col("closed") == F.lit(start))
                   .select("user_id", "_month", F.col("used").alias("_carry_m")))
        known = known.join(carried, ["user_id", "_month"], "left").fillna(0, ["_carry_m"])
    decided = decide_calls(known, chunk_seconds, inside)
    rows = _replayed(decided).unionByName(rejected_calls(base), allowMissingColumns=True).withColumn("day", F.to_date("ts"))
    done = cut_lineage(rows)
    _replace(done.hint("rebalance", "day"), f"{root}/decisions", "day")
    ok = done.where("status = 200 and user_id is not null")
    _replace(ok.groupBy(F.col("user_id").alias("user_email"), "day").agg(
        F.sum("charged_tokens").cast("bigint").alias("tokens_used"), F.max("ts").alias("last_updated")).hint("rebalance", "day"), f"{root}/daily", "day")
    month = F.trunc(F.lit(str(end)).cast("date"), "MM")
    new = done.where(F.col("charged_tokens").isNotNull()).select("user_id", F.trunc("day", "MM").alias("_month"), F.col("charged_tokens").alias("used"))
    if carried is not None:
        new = new.unionByName(carried.withColumnRenamed("_carry_m", "used"))
    left = (new.where(F.col("_month") == month).groupBy("user_id", "_month").agg(F.sum("used").cast("bigint").alias("used"))
            .withColumn("closed", F.lit(str(end)).cast("date")))
    _replace(cut_lineage(left), f"{root}/carry", "closed")
    _replace(spark.createDataFrame([(start, end)], "start date, end date").withColumn("closed", F.col("end")), f"{root}/spans", "closed")


CARRY = "user_id string, _month date, used bigint, closed date"


def _replace(rows: DataFrame, path: str, key: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def _closed(spark, root: str, day) -> bool:
    """True if a span ended at ``day``; false if no span was ever closed, so that this is the first one."""
    spans = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/spans")
    if not spans.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spans):
        return False
    if spark.read.parquet(f"{root}/spans").where(F.col("end") == F.lit(day)).isEmpty():
        raise ValueError(f"the span before {day} is not closed")
    return True


def counters_from_spans(spark, root: str) -> DataFrame:
    """K3 counters of all closed spans, from their daily rows: the calls are not read again."""
    return counters_from_daily(spark.read.parquet(f"{root}/daily").select("user_email", F.col("day").cast("date").alias("day"), "tokens_used", "last_updated"))


def decisions_of_spans(spark, root: str) -> DataFrame:
    """The decision log of all closed spans."""
    return spark.read.parquet(f"{root}/decisions").drop("day")


# ---------------------------------------------------------------- K6
def quota_metrics(replayed: DataFrame) -> DataFrame:
    """K6: percent metrics after each allowed successful call (post-update usage).

    Percent is usage / limit * 100 with the metric limits (missing -> 1),
    0 when the limit is not positive; tenant defaults to 'unknown'.
    """
    done = replayed.where((F.col("status") == 200))
    m_after = F.col("monthly_usage") + F.col("charged_tokens")
    d_after = F.col("daily_usage") + F.col("charged_tokens")

    def pct(used: Column, limit: str) -> Column:
        return F.when(F.col(limit) > 0, used / F.col(limit) * F.lit(100)).otherwise(F.lit(0.0))

    return done.select(
        "request_id", "ts", "user_id",
        F.coalesce(F.col("tenant"), F.lit(METRIC_DEFAULT_TENANT)).alias("tenant"),
        pct(m_after, "metric_monthly_limit").alias("monthly_pct"),
        pct(d_after, "metric_daily_limit").alias("daily_pct"),
        F.col("charged_tokens").alias("tokens_used"),
    )


def metric_points(metrics: DataFrame) -> DataFrame:
    """K6 in long form: (namespace, metric, user_id, tenant, ts, value, unit)."""
    specs = [("MonthlyUsagePercent", "monthly_pct", "Percent"),
             ("DailyUsagePercent", "daily_pct", "Percent"),
             ("TokensUsed", "tokens_used", "Count")]
    point = F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), F.col(col).cast("double").alias("value"), F.lit(unit).alias("unit"))
        for name, col, unit in specs])).alias("p")
    return metrics.select(F.lit("Quota").alias("namespace"), "user_id", "tenant", "ts", point).select(
        "namespace", "p.metric", "user_id", "tenant", "ts", "p.value", "p.unit")


# ---------------------------------------------------------------- K9 - K16
def expire_counters(counters: DataFrame, as_of) -> DataFrame:
    """K9: counters not yet expired at ``as_of``: an item expires only once its
    ttl (epoch seconds) is earlier than the current time."""
    return counters.where(F.col("ttl") >= epoch_seconds(ts_lit(as_of)))


def initialize_counters(users: DataFrame, counters: DataFrame, as_of) -> DataFrame:
    """Counters plus zero rows for the current month and day of users lacking them.

    Existing usage is kept (an anti join, not an overwrite with 0).
    """
    now = ts_lit(as_of)
    periods = users.select(F.col("userId").alias("user_email"), F.explode(F.array(
        F.struct(month_key(now).alias("metric_period"),
                 (epoch_seconds(month_start(now)) + F.lit(MONTHLY_TTL_DAYS * 86400)).alias("ttl")),
        F.struct(day_key(now).alias("metric_period"),
                 (epoch_seconds(now) + F.lit(DAILY_TTL_DAYS * 86400)).alias("ttl")),
    )).alias("p")).select("user_email", "p.metric_period", "p.ttl")
    fresh = (periods.join(counters.select("user_email", "metric_period"),
                          ["user_email", "metric_period"], "left_anti")
             .select("user_email", "metric_period", F.lit(0).cast("bigint").alias("tokens_used"),
                     now.alias("last_updated"), "ttl"))
    return counters.select("user_email", "metric_period", "tokens_used", "last_updated", "ttl") \
        .unionByName(fresh)


def monthly_usage_report(counters: DataFrame) -> DataFrame:
    """Monthly counters, ordered by user."""
    return (counters.where(F.col("metric_period").startswith("monthly"))
            .select("user_email", "metric_period", "tokens_used", "last_updated")
            .orderBy("user_email", "metric_period"))


def policy_report(policies: DataFrame) -> DataFrame:
    """Policies ordered by (type, identifier) with limits in whole millions ('{n}M', half-even)."""
    def millions(c: str) -> Column:
        whole = F.bround(F.coalesce(F.col(c), F.lit(0)) / F.lit(1e6), 0).cast("bigint")
        return F.concat(whole.cast("string"), F.lit("M"))

    return (policies.select(
        "policy_type", "identifier", "monthly_limit", "daily_limit",
        F.coalesce("enforcement_mode", F.lit("unknown")).alias("enforcement_mode"),
        millions("monthly_limit").alias("monthly_limit_m"), millions("daily_limit").alias("daily_limit_m"))
        .orderBy("policy_type", "identifier"))


def user_quota_tracking_joined(inv: DataFrame, users: DataFrame, policies: DataFrame,
                               as_of, account: str | None) -> DataFrame:
    """Month-to-date tokens per user against the resolved policy limits."""
    from quotalake.operators.usage import monthly_usage, percent_2dp

    limits = resolve_policy(users, policies).select("user_id", "monthly_limit", "policy_source")
    return (monthly_usage(inv, as_of, account).join(limits, "user_id", "left")
            .withColumn("monthly_limit", F.coalesce("monthly_limit", F.lit(BUILTIN_MONTHLY_LIMIT)).cast("bigint"))
            .withColumn("policy_source", F.coalesce("policy_source", F.lit("builtin")))
            .withColumn("usage_percentage", percent_2dp(F.col("tokens_used"), F.col("monthly_limit")))
            .orderBy(F.col("usage_percentage").desc_nulls_last()))


def user_period_history(counters: DataFrame, user: str, prefix: str = "monthly_") -> DataFrame:
    """All counters of one user whose period starts with ``prefix``."""
    return (counters.where((F.col("user_email") == F.lit(user)) & F.col("metric_period").startswith(prefix))
            .orderBy("metric_period"))


OUTCOME_CLASSES = {200: "ok", 400: "missing_user_id", 404: "unknown_user", 429: "quota_exceeded",
                   500: "model_failure"}


def request_outcomes(replayed: DataFrame) -> DataFrame:
    """Calls per outcome class (status code and name)."""
    name = F.lit(None).cast("string")
    for code, label in OUTCOME_CLASSES.items():
        name = F.when(F.col("status") == code, F.lit(label)).otherwise(name)
    return replayed.groupBy("status").agg(F.count(F.lit(1)).alias("calls")).withColumn("outcome", name)


def current_usage(users: DataFrame, counters: DataFrame, as_of) -> DataFrame:
    """Each user's current month and day usage and last update (0 / 'unknown' if none)."""
    now = ts_lit(as_of)
    mk, dk = month_key(now), day_key(now)
    cur = (counters.where(F.col("metric_period").isin(mk, dk))
           .groupBy(F.col("user_email").alias("user_id"))
           .agg(F.sum(F.when(F.col("metric_period") == mk, F.col("tokens_used"))).alias("_m"),
                F.max(F.when(F.col("metric_period") == mk, F.col("last_updated"))).alias("_mu"),
                F.sum(F.when(F.col("metric_period") == dk, F.col("tokens_used"))).alias("_d"),
                F.max(F.when(F.col("metric_period") == dk, F.col("last_updated"))).alias("_du")))
    return users.select(F.col("userId").alias("user_id")).join(cur, "user_id", "left").select(
        "user_id",
        F.coalesce("_m", F.lit(0)).cast("bigint").alias("monthly_tokens"),
        F.coalesce(F.col("_mu").cast("string"), F.lit("unknown")).alias("monthly_last_updated"),
        F.coalesce("_d", F.lit(0)).cast("bigint").alias("daily_tokens"),
        F.coalesce(F.col("_du").cast("string"), F.lit("unknown")).alias("daily_last_updated"),
    )


def counters_from_replay(replayed: DataFrame) -> DataFrame:
    """Counters implied by a replay: tokens charged per user and period (compare with K3)."""
    ok = replayed.where(F.col("status") == 200).withColumn("_day", F.to_date("ts"))
    return usage_counters(ok.select(
        "user_id", "ts", F.col("_day").alias("usage_day"), F.lit(None).cast("string").alias("error_type"),
        F.col("charged_tokens").alias("input_tokens"), F.lit(0).cast("bigint").alias("output_tokens")))


def counter_accuracy(counters: DataFrame, inv: DataFrame) -> DataFrame:
    """K16 check: stored counters against counters recomputed from the log (K3).

    Full outer join on (user, period); ``difference`` = stored - recomputed
    (missing side counts as 0).  Rows where both agree are kept with
    ``matches = true``, so the result is a complete reconciliation.
    """
    stored = counters.select("user_email", "metric_period", F.col("tokens_used").alias("stored_tokens"))
    log = usage_counters(inv).select("user_email", "metric_period", F.col("tokens_used").alias("log_tokens"))
    both = stored.join(log, ["user_email", "metric_period"], "full_outer")
    diff = F.coalesce("stored_tokens", F.lit(0)) - F.coalesce("log_tokens", F.lit(0))
    return both.select("user_email", "metric_period", "stored_tokens", "log_tokens",
                       diff.cast("bigint").alias("difference"), (diff == 0).alias("matches"))
