import datetime as dt

from quotalake.operators import usage as U
from quotalake.operators.normalize import normalize_invocations
from quotalake.schema import INVOCATION_LOG


def _raw(spark, rows):
    base = {f.name: None for f in INVOCATION_LOG.fields}
    return spark.createDataFrame([{**base, **r} for r in rows], INVOCATION_LOG)


def test_edge_rows(spark):
    md = '{"userId": "a@x.com", "tenant": "t1", "group": "g", "department": "d", "source": "s"}'
    rows = [
        {"timestamp": "2024-01-31T23:59:59.999Z", "requestid": "r1", "requestmetadata": None,
         "usage": '{"inputTokens": 5, "outputTokens": 7}'},
        {"timestamp": "2024-02-01T00:00:00Z", "requestid": "r2",
         "requestmetadata": '{"userId": "a@x.com", "tenant": {"nested": 1}}',
         "usage": '{"inputTokens": "abc", "outputTokens": "1.5"}'},
        {"timestamp": "2024-02-01T00:00:00Z", "requestid": "r3", "requestmetadata": md,
         "usage": '{"inputTokens": 3}'},
        {"timestamp": "2024-02-01T00:00:01Z", "requestid": "r4", "requestmetadata": md, "usage": None,
         "output": {"outputBodyJson": {"usage": {"input_tokens": 12, "output_tokens": 56}}}},
        {"timestamp": "2024-02-01T00:00:02Z", "requestid": "r4", "requestmetadata": md,
         "usage": '{"inputTokens": 0, "outputTokens": 0}', "error": None},
        {"timestamp": "2024-02-01T00:00:03Z", "requestid": "r5", "requestmetadata": md, "usage": None,
         "error": '{"type": "ThrottlingException"}', "modelid": "arn:x:y/abc123"},
    ]
    inv = {r.request_id + str(r.ts): r for r in normalize_invocations(_raw(spark, rows)).collect()}
    r1 = inv["r12024-01-31 23:59:59.999000"]
    assert r1.user_id is None and r1.input_tokens == 5 and r1.usage_month == "2024-01"
    r2 = inv["r22024-02-01 00:00:00"]
    assert r2.tenant is None and r2.user_id == "a@x.com"          # object value -> NULL
    assert r2.input_tokens is None and r2.output_tokens is None   # not integers -> NULL
    r3 = inv["r32024-02-01 00:00:00"]
    assert r3.input_tokens == 3 and r3.output_tokens is None
    r4 = inv["r42024-02-01 00:00:01"]
    assert (r4.input_tokens, r4.output_tokens) == (12, 56)       # nested response path
    r5 = inv["r52024-02-01 00:00:03"]
    assert r5.error_type == "ThrottlingException" and r5.profile_id == "abc123"


def test_sum_of_pair_skips_rows_with_a_null_side(spark):
    md = '{"userId": "a", "tenant": "t", "department": "d"}'
    rows = [{"timestamp": "2024-02-10T00:00:00Z", "accountid": "1", "requestid": f"r{i}",
             "requestmetadata": md, "usage": u}
            for i, u in enumerate(['{"inputTokens": 1, "outputTokens": 2}', '{"inputTokens": 10}'])]
    out = U.usage_by_user(normalize_invocations(_raw(spark, rows)), dt.datetime(2024, 2, 18), "1").first()
    assert (out.invocation_count, out.input_tokens, out.output_tokens, out.total_tokens) == (2, 11, 2, 3)


def test_empty_input(spark):
    inv = normalize_invocations(_raw(spark, []))
    assert U.department_cost(inv, dt.datetime(2024, 2, 18), "1").count() == 0


def test_rejects_are_counted(spark):
    from quotalake.operators.normalize import normalize_rejects

    rows = [{"timestamp": "2024-02-01T00:00:00Z", "requestmetadata": '{"userId": "a"}',
             "usage": '{"inputTokens": "abc", "outputTokens": "1.5"}'},
            {"timestamp": "not a time", "requestmetadata": "{broken", "usage": "nope"},
            {"timestamp": None, "requestmetadata": None, "usage": '{"inputTokens": 3, "outputTokens": 4}'}]
    r = normalize_rejects(_raw(spark, rows)).first()
    assert (r.records, r.bad_timestamp, r.bad_input_tokens, r.bad_output_tokens,
            r.malformed_metadata, r.malformed_usage) == (3, 2, 1, 1, 1, 1)
