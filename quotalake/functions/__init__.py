"""Column-level helpers: JSON scalar extraction, exact money, time buckets."""

from quotalake.functions.jsonpath import json_scalar, json_struct, parse_json_text, scalar_field
from quotalake.functions.pricing import (
    blended_cost, dollars, estimate_cost, estimate_tokens, usage_totals,
)
from quotalake.functions.timecols import (
    bucket_start, day_key, day_start, epoch_seconds, hour_start, iso_to_ts, month_key, month_start, ts_to_iso,
)

__all__ = [
    "json_scalar", "json_struct", "parse_json_text", "scalar_field", "blended_cost", "dollars",
    "estimate_cost", "estimate_tokens", "usage_totals", "bucket_start", "day_key", "day_start",
    "epoch_seconds", "hour_start", "iso_to_ts", "month_key", "month_start", "ts_to_iso",
]
