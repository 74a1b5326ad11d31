"""Deterministic projection of the driver's ``events`` table onto the data model.

``invocation_log`` turns each event into one raw log record in the form
the log store keeps (ISO timestamp text, identity metadata and usage as
JSON text), so that the operators exercise parsing exactly as they would
on real logs.  The rules are listed in FIXTURES.md section 3.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotalake.functions.timecols import ts_to_iso
from quotalake.schema import QUOTA_POLICIES

# Fixed values of the fixture projection (FIXTURES.md section 3).
ACCOUNT = "123456789012"
OTHER_ACCOUNT = "999999999999"
TENANTS = ["tenant_a", "tenant_b", "tenant_c", "tenant_d"]
GROUPS = ["engineering", "data-science", "sales", "finance", "support"]
DEPARTMENTS = ["platform", "ml-ops", "sales-ops", "devops", "analytics", "support-ops"]
ERROR_TYPES = ["ThrottlingException", "ValidationException", "ModelTimeoutException"]
SOURCE = "hybrid-gateway"
PLAIN_MODEL_ID = "anthropic.claude-3-5-sonnet-20241022-v2:0"
PROFILE_ARN_PREFIX = "arn:aws:inference:us-west-2:123456789012:application-inference-profile/"
# Invented tenant profiles (profile id, display name, tenant, colour).
TENANT_PROFILES = [(f"profile-{k}-{t[-1]}", f"Tenant {t[-1].upper()} (Unit {k})", t, f"#{k}{k}{k}")
                   for k, t in enumerate(TENANTS, 1)]
# Quota policies of the fixture, limits scaled to the data.
# (policy_type, identifier, monthly_limit, daily_limit, enforcement_mode)
FIXTURE_POLICIES = [
    ("default", "default", 25000, 4000, "block"),
    ("group", "engineering", 22000, 3000, "block"),
    ("group", "data-science", 30000, 4000, "block"),
    ("group", "sales", 20000, 2500, "alert"),
    ("group", "finance", 26000, 5000, "block"),
    ("user", "user3@company.com", 10000, 1500, "block"),
    ("user", "user7@company.com", 10000, 1500, "block"),
    ("user", "user11@company.com", 0, 0, "block"),
    ("user", "user13@company.com", None, 5000, None),
]
# Later puts of the fixture, limits raised and restored.
# (policy_type, identifier, monthly_limit, daily_limit, enforcement_mode, updatedAt)
POLICY_CHANGES = [
    ("group", "engineering", 60000, 9000, "block", "2024-02-05T00:00:00Z"),
    ("group", "engineering", 22000, 3000, "block", "2024-02-09T12:00:00Z"),
    ("group", "data-science", 30000, 1200, "block", "2024-01-25T06:30:00Z"),
    ("group", "data-science", 30000, 4000, "block", "2024-01-28T00:00:00Z"),
    ("group", "sales", 20000, 2500, "alert", "2024-02-01T00:00:00Z"),
    ("group", "sales", 15000, 2500, "block", "2024-02-06T18:00:00Z"),
    ("default", "default", 25000, 1500, "block", "2024-02-10T00:00:00Z"),
    ("user", "user7@company.com", 90000, 9000, "block", "2024-02-03T03:00:00Z"),
    ("user", "user7@company.com", 10000, 1500, "block", "2024-02-07T03:00:00Z"),
]
TIME_SHIFT_DAYS = 15
AS_OF = dt.datetime(2024, 2, 18, 0, 0, 0)
AS_OF_RECENT = dt.datetime(2024, 2, 14, 23, 30, 0)
USAGE_MONTH = "2024-02"


def _pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + F.lit(1)).cast("int"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores: a file with few row groups is read by few tasks, and what follows per row takes long."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


def latency_ms() -> Column:
    """0.5 to 2 seconds; every 40th call takes 150 seconds longer."""
    return (F.lit(500) + F.col("event_id") % 1500
            + F.when(F.col("event_id") % 40 == 0, F.lit(150_000)).otherwise(F.lit(0))).cast("bigint").alias("latency_ms")


def user_email(user_id: Column) -> Column:
    return F.concat(F.lit("user"), user_id.cast("string"), F.lit("@company.com"))


def invocation_log(spark: SparkSession, sf_dir: str, by_hour: bool = False, by_time: bool = False) -> DataFrame:
    """Raw invocation-log records, one per event (columns of ``schema.INVOCATION_LOG``).

    ``by_hour`` adds HOUR_KEYS and orders the records by them for
    ``write_raw_log``: the events are sent and sorted before they become
    records ten times as wide.  ``by_time`` sends them by ranges of time.
    """
    ts = F.timestamp_add("DAY", F.lit(TIME_SHIFT_DAYS), F.col("ts"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if by_time:
        ev = events(spark, sf_dir).repartitionByRange(ranges, F.to_date(ts), "ts", "event_id")
    elif by_hour:
        ev = (events(spark, sf_dir).select("*", *_hour_keys(ts)).repartitionByRange(ranges, *HOUR_KEYS, "ts")
              .sortWithinPartitions(*HOUR_KEYS))
    else:
        ev = dealt(events(spark, sf_dir))
    uid, eid = F.col("user_id"), F.col("event_id")
    is_error = F.col("event_type") == "error"
    tenant = _pick(TENANTS, uid % 4)
    k = F.get_json_object("props", "$.k").cast("bigint")
    metadata = F.to_json(F.struct(
        user_email(uid).alias("userId"),
        _pick(GROUPS, uid % 5).alias("group"),
        tenant.alias("tenant"),
        _pick(DEPARTMENTS, uid % 6).alias("department"),
        F.lit(SOURCE).alias("source"),
        F.concat(F.lit("proj"), (uid % 7).cast("string")).alias("project"),
    ))
    profile = F.element_at(
        F.create_map(*[F.lit(x) for p in TENANT_PROFILES for x in (p[2], p[0])]), tenant)
    usage = F.to_json(F.struct(
        (k * 10).alias("inputTokens"),
        F.floor(F.col("value") * 10).cast("int").alias("outputTokens"),
    ))
    return ev.select(
        F.lit("ModelInvocationLog").alias("schemaType"),
        F.lit("1.0").alias("schemaVersion"),
        ts_to_iso(ts).alias("timestamp"),
        F.when(eid % 97 == 0, F.lit(OTHER_ACCOUNT)).otherwise(F.lit(ACCOUNT)).alias("accountid"),
        F.lit("us-west-2").alias("region"),
        F.concat(F.lit("req-"), F.lpad(eid.cast("string"), 12, "0")).alias("requestid"),
        F.lit("InvokeModel").alias("operation"),
        F.when(eid % 3 == 0, F.lit(PLAIN_MODEL_ID))
        .otherwise(F.concat(F.lit(PROFILE_ARN_PREFIX), profile)).alias("modelid"),
        F.when(eid % 50 == 0, F.lit(None).cast("string")).otherwise(metadata).alias("requestmetadata"),
        F.when(is_error, F.lit(None).cast("string")).otherwise(usage).alias("usage"),
        F.when(is_error, F.to_json(F.struct(_pick(ERROR_TYPES, uid % 3).alias("type"))))
        .alias("error"),
        latency_ms(),
        *(HOUR_KEYS if by_hour else []),
    )


HOUR_KEYS = ["year", "month", "day", "hour"]


def _hour_keys(ts: Column) -> list[Column]:
    return [f(ts).alias(k) for f, k in zip((F.year, F.month, F.dayofmonth, F.hour), HOUR_KEYS)]


def user_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metadata row per known user (users with id % 25 = 24 are unknown)."""
    ev = events(spark, sf_dir)
    users = ev.select("user_id").where(F.col("user_id") % 25 != 24).distinct()
    email = user_email(F.col("user_id"))
    own = spark.createDataFrame(
        [(p[1], p[2], p[3]) for p in FIXTURE_POLICIES if p[0] == "user"],
        "identifier string, monthly_limit long, daily_limit long")
    base = users.select(
        email.alias("userId"),
        _pick(GROUPS, F.col("user_id") % 5).alias("group"),
        _pick(TENANTS, F.col("user_id") % 4).alias("tenant"),
        _pick(DEPARTMENTS, F.col("user_id") % 6).alias("department"),
    )
    return (base.join(F.broadcast(own), base.userId == own.identifier, "left")
            .select("userId", "group", "tenant", "department",
                    F.col("monthly_limit").alias("monthlyLimit"),
                    F.col("daily_limit").alias("dailyLimit"),
                    F.lit("active").alias("status"),
                    F.lit("2024-01-01T00:00:00Z").alias("createdAt"),
                    F.lit("2024-01-01T00:00:00Z").alias("updatedAt")))


def quota_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy table: fixed default and group rows plus one user row per user
    whose metadata carries its own limits (derived from the user table)."""
    from quotalake.sources.dims import derive_user_policies

    rows = [(t, i, m, d, mode, f"{t} policy for {i}", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z")
            for t, i, m, d, mode in FIXTURE_POLICIES if t != "user"]
    users = user_metadata(spark, sf_dir).where(
        F.col("monthlyLimit").isNotNull() | F.col("dailyLimit").isNotNull())
    return spark.createDataFrame(rows, QUOTA_POLICIES).unionByName(derive_user_policies(users))


def policy_puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policies as first put, the later puts of POLICY_CHANGES, and policies that users whose id ends in 1 get later."""
    first = quota_policies(spark, sf_dir)
    columns = "policy_type string, identifier string, monthly_limit long, daily_limit long, enforcement_mode string, updatedAt string"
    changes = spark.createDataFrame(POLICY_CHANGES, columns)
    own = user_metadata(spark, sf_dir).where(F.col("userId").rlike("1@")).select(
        F.lit("user").alias("policy_type"), F.col("userId").alias("identifier"), F.explode(F.array(*[
            F.struct(F.lit(m).cast("bigint").alias("monthly_limit"), F.lit(d).cast("bigint").alias("daily_limit"),
                     F.lit("block").alias("enforcement_mode"), F.lit(at).alias("updatedAt"))
            for m, d, at in ((12000, 2000, "2024-02-04T00:00:00Z"), (70000, 8000, "2024-02-08T12:30:00Z"))])).alias("c")).select(
        "policy_type", "identifier", "c.*")
    return first.unionByName(changes, allowMissingColumns=True).unionByName(own, allowMissingColumns=True)


def tenant_profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TENANT_PROFILES, "profile_id string, name string, tenant string, color string")


def gateway_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as the gateway sees them: principal, time, tokens, failure flag.

    Every event is one request by ``user{id}@company.com``; failed model
    calls (event type ``error``) carry no token counts.  They lie in ranges
    of time, so that readers of a span pass over the others.
    """
    ev = events(spark, sf_dir).repartitionByRange(2 * spark.sparkContext.defaultParallelism, "ts", "event_id")
    is_error = F.col("event_type") == "error"
    k = F.get_json_object("props", "$.k").cast("bigint")
    return ev.select(
        F.concat(F.lit("req-"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("request_id"),
        F.timestamp_add("DAY", F.lit(TIME_SHIFT_DAYS), F.col("ts")).alias("ts"),
        user_email(F.col("user_id")).alias("user_id"),
        F.when(~is_error, k * 10).alias("input_tokens"),
        F.when(~is_error, F.floor(F.col("value") * 10)).cast("bigint").alias("output_tokens"),
        is_error.alias("failed"),
        latency_ms(),
    )


def write_changing_log(log: DataFrame, path: str) -> None:
    """The log whose format changes with February: from then on latencies are text, and usage is text instead of an object."""
    late = F.col("timestamp") >= "2024-02-01"
    write_raw_log(log.where(~late).withColumn("usage", F.from_json("usage", "inputTokens long, outputTokens long")), f"{path}/era=1")
    write_raw_log(log.where(late).withColumn("latency_ms", F.col("latency_ms").cast("string")), f"{path}/era=2")


def write_raw_log(raw: DataFrame, path: str) -> None:
    """Store raw log records as JSON under ``year=/month=/day=/hour=`` folders.

    Range partitioning on the timestamp text gives each task a contiguous
    time slice, so each hour folder gets one or two files.  Records that have
    HOUR_KEYS lie in such slices already.
    """
    if not set(HOUR_KEYS) <= set(raw.columns):
        ts = F.to_timestamp_ntz(F.regexp_replace("timestamp", "Z$", ""))
        raw = raw.select("*", *_hour_keys(ts)).repartitionByRange("timestamp")
    raw.write.mode("overwrite").partitionBy(*HOUR_KEYS).json(path)


def user_metadata_puts(users: DataFrame) -> DataFrame:
    """Two puts per changed user: the original row, then a later one moving the
    user to another department (every user whose id ends in 0)."""
    changed = (users.where(F.col("userId").rlike("0@"))
               .withColumn("department", F.concat(F.col("department"), F.lit("-moved")))
               .withColumn("updatedAt", F.lit("2024-02-01T00:00:00Z")))
    return users.unionByName(changed)


def profile_puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts of the profiles of the tenants that have events: an old name, then the present one."""
    tenants = events(spark, sf_dir).select(_pick(TENANTS, F.col("user_id") % 4).alias("tenant")).distinct()
    now = tenant_profiles(spark).join(tenants, "tenant", "left_semi").select("profile_id", "name", "tenant", "color")
    return (now.withColumn("name", F.lit("old name")).withColumn("updatedAt", F.lit("2024-01-01T00:00:00Z"))
            .unionByName(now.withColumn("updatedAt", F.lit("2024-02-01T00:00:00Z"))))


def department_puts(users: DataFrame) -> DataFrame:
    """Whole items put later: users whose id ends in 4, with a new department and no limits of their own."""
    return users.where(F.col("userId").rlike("4@")).select(
        "userId", "group", "tenant", F.lit("reorganised").alias("department"), F.lit("active").alias("status"),
        F.lit("2024-02-01T00:00:00Z").alias("updatedAt"))


def limit_changes(users: DataFrame) -> DataFrame:
    """Attribute updates of users whose id ends in 5: a daily limit of 5000, then a monthly limit, then 6000 a day."""
    changed = users.where(F.col("userId").rlike("5@")).select("userId", F.explode(F.array(*[
        F.struct(F.lit(d).cast("bigint").alias("dailyLimit"), F.lit(m).cast("bigint").alias("monthlyLimit"),
                 F.lit(at).alias("updatedAt"))
        for d, m, at in ((5000, None, "2024-02-01T00:00:00Z"), (None, 50000, "2024-02-02T00:00:00Z"),
                         (6000, None, "2024-02-03T00:00:00Z"), (None, None, "2024-02-04T00:00:00Z"))])).alias("c"))
    return changed.select("userId", "c.*")
