"""Time columns that never depend on the session time zone.

Timestamps are TIMESTAMP_NTZ holding UTC wall-clock time.  ``date_trunc``
returns a zoned TIMESTAMP, so buckets are built from dates and
``make_timestamp_ntz`` instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOCAL = r"^(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?)?)"
_OFFSET = r"[T ].*([+-])(\d{2}):?(\d{2})$"


def iso_to_ts(text: Column) -> Column:
    """ISO-8601 text (``...Z``, ``+hh:mm`` or no zone) -> UTC TIMESTAMP_NTZ; bad text gives NULL.

    The log writes ``yyyy-MM-ddTHH:mm:ss[.f]Z``; that form is a plain cast
    once the ``T`` and ``Z`` are replaced.  Only other forms (offsets, no
    zone) take the regular-expression path (CASE branches are lazy).
    """
    canonical = text.endswith("Z") & (F.length(text) >= 20) & (F.substring(text, 11, 1) == F.lit("T"))
    fast = F.concat(F.substring(text, 1, 10), F.lit(" "),
                    text.substr(F.lit(12), F.length(text) - F.lit(12))).try_cast("timestamp_ntz")
    local = F.regexp_replace(F.regexp_extract(text, _LOCAL, 1), "T", " ")
    parsed = F.when(local != "", local).try_cast("timestamp_ntz")
    sign = F.regexp_extract(text, _OFFSET, 1)
    minutes = (F.regexp_extract(text, _OFFSET, 2).try_cast("int") * 60
               + F.regexp_extract(text, _OFFSET, 3).try_cast("int"))
    offset = F.when(sign == "+", minutes).when(sign == "-", -minutes).otherwise(F.lit(0))
    return F.when(canonical, fast).otherwise(F.timestamp_add("MINUTE", -offset, parsed))


def ts_to_iso(ts: Column) -> Column:
    """TIMESTAMP_NTZ (UTC) -> ``yyyy-MM-ddTHH:mm:ss.SSSSSSZ``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def day_start(ts: Column) -> Column:
    return F.to_date(ts).cast("timestamp_ntz")


def month_start(ts: Column) -> Column:
    return F.trunc(F.to_date(ts), "MM").cast("timestamp_ntz")


def hour_start(ts: Column) -> Column:
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts),
                                F.lit(0), F.lit(0))


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970-01-01 of a TIMESTAMP_NTZ (zone free)."""
    return F.timestamp_diff("SECOND", _epoch(), ts)


def bucket_start(ts: Column, period_s: int) -> Column:
    """Start of the ``period_s``-second tumbling bucket (epoch aligned), TIMESTAMP_NTZ."""
    period = int(period_s)
    if period == 3600:
        return hour_start(ts)
    if period == 86400:
        return day_start(ts)
    secs = epoch_seconds(ts)
    return F.timestamp_add("SECOND", secs - F.pmod(secs, F.lit(period)), _epoch())


def month_key(ts: Column) -> Column:
    """Counter key ``monthly_YYYY-MM``."""
    return F.concat(F.lit("monthly_"), F.date_format(ts, "yyyy-MM"))


def day_key(ts: Column) -> Column:
    """Counter key ``daily_YYYY-MM-DD``."""
    return F.concat(F.lit("daily_"), F.date_format(ts, "yyyy-MM-dd"))
