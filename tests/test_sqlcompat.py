import datetime as dt

from pyspark.sql import functions as F

from quotalake.operators.normalize import normalize_invocations
from quotalake.plans.sqlcompat import register_invocations_view, register_sql_functions
from quotalake.sources import fixtures as fx


def test_dialect_functions(spark):
    register_sql_functions(spark)
    r = spark.sql("""
      SELECT json_extract_scalar('{"a": 1, "b": {"c": 2}, "d": "x", "e": [1]}', '$.a') AS a,
             json_extract_scalar('{"a": 1, "b": {"c": 2}, "d": "x", "e": [1]}', '$.b') AS b,
             json_extract_scalar('{"a": 1, "b": {"c": 2}, "d": "x", "e": [1]}', '$.d') AS d,
             json_extract_scalar('{"a": 1, "b": {"c": 2}, "d": "x", "e": [1]}', '$.e') AS e,
             json_extract_scalar('oops', '$.a') AS bad,
             from_iso8601_timestamp('2024-02-14T23:59:59.123456Z') AS z,
             from_iso8601_timestamp('2024-02-15T01:00:00+02:00') AS plus,
             from_iso8601_timestamp('garbage') AS g""").first()
    assert (r.a, r.b, r.d, r.e, r.bad) == ("1", None, "x", None, None)
    assert r.z == dt.datetime(2024, 2, 14, 23, 59, 59, 123456) and r.plus == dt.datetime(2024, 2, 14, 23)
    assert r.g is None


def test_dialect_view_over_the_log(spark):
    """Both functions in one query of the registered view, against the parsed columns."""
    raw = fx.invocation_log(spark, "/root/testdata/sf0.001")
    register_invocations_view(spark, raw)
    got = spark.sql("""
      SELECT min(from_iso8601_timestamp(timestamp)) AS first_call, max(from_iso8601_timestamp(timestamp)) AS last_call,
             count(json_extract_scalar(requestmetadata, '$.group')) AS grouped
      FROM invocations WHERE json_extract_scalar(error, '$.type') IS NULL""").first()
    inv = normalize_invocations(raw).where("error_type IS NULL")
    assert tuple(got) == tuple(inv.agg(F.min("ts"), F.max("ts"), F.count("user_group")).first())
