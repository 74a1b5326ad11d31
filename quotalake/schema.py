"""Explicit schemas of the data model (no inference on the hot path)."""

from pyspark.sql import types as T

# One flattened record of the invocation log, as the SQL layer sees it.
# JSON objects that the log stores as text (requestmetadata, usage, error)
# are declared as strings and parsed once by ``normalize_invocations``.
INVOCATION_LOG = T.StructType([
    T.StructField("schemaType", T.StringType()),
    T.StructField("schemaVersion", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("accountid", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("requestid", T.StringType()),
    T.StructField("operation", T.StringType()),
    T.StructField("modelid", T.StringType()),
    T.StructField("requestmetadata", T.StringType()),
    T.StructField("usage", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("latency_ms", T.LongType()),
    T.StructField("output", T.StructType([
        T.StructField("outputBodyJson", T.StructType([
            T.StructField("usage", T.StructType([
                T.StructField("input_tokens", T.LongType()),
                T.StructField("output_tokens", T.LongType()),
            ])),
        ])),
    ])),
])

USER_METADATA = T.StructType([
    T.StructField("userId", T.StringType(), False),
    T.StructField("group", T.StringType()),
    T.StructField("tenant", T.StringType()),
    T.StructField("department", T.StringType()),
    T.StructField("monthlyLimit", T.LongType()),
    T.StructField("dailyLimit", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("createdAt", T.StringType()),
    T.StructField("updatedAt", T.StringType()),
])

QUOTA_POLICIES = T.StructType([
    T.StructField("policy_type", T.StringType(), False),
    T.StructField("identifier", T.StringType(), False),
    T.StructField("monthly_limit", T.LongType()),
    T.StructField("daily_limit", T.LongType()),
    T.StructField("enforcement_mode", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("createdAt", T.StringType()),
    T.StructField("updatedAt", T.StringType()),
])

USAGE_COUNTERS = T.StructType([
    T.StructField("user_email", T.StringType(), False),
    T.StructField("metric_period", T.StringType(), False),
    T.StructField("tokens_used", T.LongType()),
    T.StructField("last_updated", T.TimestampNTZType()),
    T.StructField("ttl", T.LongType()),
])

TENANT_PROFILES = T.StructType([
    T.StructField("profile_id", T.StringType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("tenant", T.StringType()),
    T.StructField("color", T.StringType()),
    T.StructField("updatedAt", T.StringType()),
])

METRIC_POINTS = T.StructType([
    T.StructField("namespace", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("tenant", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("unit", T.StringType()),
])
