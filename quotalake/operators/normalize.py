"""S2 normalize_invocations: raw log records -> flat fact table ``inv``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quotalake.functions.jsonpath import json_struct, scalar_field
from quotalake.functions.timecols import iso_to_ts

# Identity keys read from requestmetadata (key -> output column).
IDENTITY_KEYS = {
    "userId": "user_id",
    "tenant": "tenant",
    "group": "user_group",
    "department": "department",
    "source": "source",
}

INV_COLUMNS = [
    "ts", "account_id", "request_id", "model_id", "profile_id", "user_id", "tenant",
    "user_group", "department", "source", "input_tokens", "output_tokens", "error_type",
    "latency_ms", "requestmetadata", "has_metadata", "usage_month", "usage_day",
]


def _field(raw: DataFrame, path: str) -> Column | None:
    """Nested column if ``path`` exists in the raw schema, else None."""
    dtype: T.DataType = raw.schema
    for part in path.split("."):
        if not isinstance(dtype, T.StructType):
            return None
        match = [f for f in dtype.fields if f.name.lower() == part.lower()]
        if not match:
            return None
        dtype = match[0].dataType
    return F.col(path)


def _text(raw: DataFrame, name: str) -> Column:
    col = _field(raw, name)
    return col.cast("string") if col is not None else F.lit(None).cast("string")


def _whole(value: Column) -> Column:
    """Whole number of a number or its text (a log whose field widened to text); the fraction is cut, other text gives NULL."""
    return F.coalesce(value.try_cast("bigint"), value.try_cast("double").try_cast("bigint"))


def normalize_invocations(raw: DataFrame) -> DataFrame:
    """Flat fact: one row per call with parsed identity, tokens and error.

    Token counts are taken from the ``usage`` JSON text (or ``usage``
    struct), then the nested response body, whichever the record has.
    Text that is not an integer becomes NULL rather than failing the job.
    Each JSON column is parsed once (``jsonpath.json_fields``).
    """
    usage_type = next((f.dataType for f in raw.schema.fields if f.name.lower() == "usage"), None)
    usage_is_text = isinstance(usage_type, T.StringType)
    body_in = _field(raw, "output.outputBodyJson.usage.input_tokens")
    body_out = _field(raw, "output.outputBodyJson.usage.output_tokens")
    latency = _field(raw, "latency_ms")
    none = F.lit(None).cast("string")
    # Step 1: one parse per JSON column.  A separate projection keeps the
    # parsed struct whole (referenced several times, so Catalyst neither
    # collapses it nor splits it into one pruned parse per field).
    step = raw.select(
        iso_to_ts(_text(raw, "timestamp")).alias("ts"),
        _text(raw, "accountid").alias("account_id"),
        _text(raw, "requestid").alias("request_id"),
        _text(raw, "modelid").alias("model_id"),
        _text(raw, "requestmetadata").alias("requestmetadata"),
        json_struct(_text(raw, "requestmetadata"), list(IDENTITY_KEYS)).alias("_md"),
        (F.col("usage") if usage_is_text else none).alias("_usage_text"),
        (json_struct(F.col("usage"), ["inputTokens", "outputTokens"]) if usage_is_text
         else F.lit(None).cast("struct<inputTokens: string, outputTokens: string>")).alias("_usage"),
        (F.col("usage.inputTokens").cast("string") if isinstance(usage_type, T.StructType) else none)
        .alias("_struct_in"),
        (F.col("usage.outputTokens").cast("string") if isinstance(usage_type, T.StructType) else none)
        .alias("_struct_out"),
        _text(raw, "error").alias("_error_text"),
        json_struct(_text(raw, "error"), ["type"]).alias("_error"),
        (body_in if body_in is not None else F.lit(None)).try_cast("bigint").alias("_body_in"),
        (body_out if body_out is not None else F.lit(None)).try_cast("bigint").alias("_body_out"),
        _whole(latency if latency is not None else F.lit(None)).alias("latency_ms"),
    )
    md_text = F.col("requestmetadata")
    usage_in = F.coalesce(scalar_field(F.col("_usage"), F.col("_usage_text"), "inputTokens"), F.col("_struct_in"))
    usage_out = F.coalesce(scalar_field(F.col("_usage"), F.col("_usage_text"), "outputTokens"), F.col("_struct_out"))
    return step.select(
        "ts", "account_id", "request_id", "model_id",
        F.element_at(F.split("model_id", "/"), -1).alias("profile_id"),
        *[scalar_field(F.col("_md"), md_text, key).alias(name) for key, name in IDENTITY_KEYS.items()],
        F.coalesce(usage_in.try_cast("bigint"), F.col("_body_in")).alias("input_tokens"),
        F.coalesce(usage_out.try_cast("bigint"), F.col("_body_out")).alias("output_tokens"),
        scalar_field(F.col("_error"), F.col("_error_text"), "type").alias("error_type"),
        "latency_ms", "requestmetadata",
        F.col("requestmetadata").isNotNull().alias("has_metadata"),
        F.date_format("ts", "yyyy-MM").alias("usage_month"),
        F.to_date("ts").alias("usage_day"),
    )


def metadata_value(inv: DataFrame, key: str) -> Column:
    """Scalar of any key of the raw requestmetadata (custom dimensions).

    A one-field ``from_json`` lets the parser skip the other keys; only
    object / array-looking values take the exact VARIANT path.
    """
    text = inv["requestmetadata"]
    return scalar_field(json_struct(text, [key]), text, key)


def normalize_rejects(raw: DataFrame) -> DataFrame:
    """Data-quality counts for ``normalize_invocations`` (one global aggregate row).

    Values that S2 turns into NULL instead of failing the job: timestamps
    that do not parse, token text present but not an integer, and
    metadata / usage text that is not a JSON object.
    """
    usage_type = next((f.dataType for f in raw.schema.fields if f.name.lower() == "usage"), None)
    usage_text = F.col("usage") if isinstance(usage_type, T.StringType) else F.lit(None).cast("string")
    # A projection of its own, so that each text is made and parsed once.
    step = raw.select(_text(raw, "timestamp").alias("_ts"), _text(raw, "requestmetadata").alias("_md"), usage_text.alias("_usage_text"),
                      json_struct(usage_text, ["inputTokens", "outputTokens"]).alias("_usage"))
    usage = F.col("_usage")

    def bad_int(c: Column) -> Column:
        return c.isNotNull() & c.try_cast("bigint").isNull()

    def bad_json(text: Column) -> Column:
        return text.isNotNull() & F.try_parse_json(text).isNull()

    def n(cond: Column, name: str) -> Column:
        return F.count(F.when(cond, True)).alias(name)

    return step.agg(
        F.count(F.lit(1)).alias("records"),
        n(F.col("_ts").isNull() | iso_to_ts(F.col("_ts")).isNull(), "bad_timestamp"),
        n(bad_int(usage.getField("inputTokens")), "bad_input_tokens"),
        n(bad_int(usage.getField("outputTokens")), "bad_output_tokens"),
        n(bad_json(F.col("_md")), "malformed_metadata"),
        n(bad_json(F.col("_usage_text")), "malformed_usage"),
    )
