"""Independent DuckDB SQL for every registered query.

The oracle computes the fixture projection straight from ``events`` (no
JSON round trip, no shared code path with the Spark operators) and then
answers each query in plain SQL.  Money is rounded with integer
arithmetic, sums are cast to BIGINT, buckets are plain timestamps.
"""

from __future__ import annotations

import datetime as dt

from quotalake.sources import fixtures as fx


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _ts(value: dt.datetime) -> str:
    return f"TIMESTAMP '{value.strftime('%Y-%m-%d %H:%M:%S')}'"


def since_days(days: int, as_of: dt.datetime = fx.AS_OF) -> str:
    return _ts(dt.datetime.combine(as_of.date() - dt.timedelta(days=days), dt.time()))


def since_hours(hours: int, as_of: dt.datetime = fx.AS_OF_RECENT) -> str:
    return _ts(as_of - dt.timedelta(hours=hours))


_PROFILE_CASE = "CASE e.user_id % 4 " + " ".join(
    f"WHEN {i} THEN '{p[0]}'" for i, p in enumerate(fx.TENANT_PROFILES)) + " END"

# The fixture projection of FIXTURES.md section 3, computed from events.
INV = f"""inv AS (
  SELECT
    e.event_id,
    e.ts + INTERVAL {fx.TIME_SHIFT_DAYS} DAY AS ts,
    CASE WHEN e.event_id % 97 = 0 THEN '{fx.OTHER_ACCOUNT}' ELSE '{fx.ACCOUNT}' END AS account_id,
    'req-' || lpad(CAST(e.event_id AS VARCHAR), 12, '0') AS request_id,
    CASE WHEN e.event_id % 3 = 0 THEN '{fx.PLAIN_MODEL_ID}'
         ELSE '{fx.PROFILE_ARN_PREFIX}' || {_PROFILE_CASE} END AS model_id,
    CASE WHEN e.event_id % 3 = 0 THEN '{fx.PLAIN_MODEL_ID}' ELSE {_PROFILE_CASE} END AS profile_id,
    e.event_id % 50 <> 0 AS has_md,
    CASE WHEN e.event_id % 50 <> 0 THEN 'user' || CAST(e.user_id AS VARCHAR) || '@company.com' END AS user_id,
    CASE WHEN e.event_id % 50 <> 0 THEN {_list(fx.TENANTS)}[e.user_id % 4 + 1] END AS tenant,
    CASE WHEN e.event_id % 50 <> 0 THEN {_list(fx.GROUPS)}[e.user_id % 5 + 1] END AS user_group,
    CASE WHEN e.event_id % 50 <> 0 THEN {_list(fx.DEPARTMENTS)}[e.user_id % 6 + 1] END AS department,
    CASE WHEN e.event_id % 50 <> 0 THEN '{fx.SOURCE}' END AS source,
    CASE WHEN e.event_id % 50 <> 0 THEN 'proj' || CAST(e.user_id % 7 AS VARCHAR) END AS project,
    CASE WHEN e.event_type <> 'error' THEN CAST(json_extract_string(e.props, '$.k') AS BIGINT) * 10 END AS input_tokens,
    CASE WHEN e.event_type <> 'error' THEN CAST(floor(e.value * 10) AS BIGINT) END AS output_tokens,
    CASE WHEN e.event_type = 'error' THEN {_list(fx.ERROR_TYPES)}[e.user_id % 3 + 1] END AS error_type,
    CAST(500 + e.event_id % 1500 + CASE WHEN e.event_id % 40 = 0 THEN 150000 ELSE 0 END AS BIGINT) AS latency_ms,
    'user' || CAST(e.user_id AS VARCHAR) || '@company.com' AS caller,
    e.user_id AS uid,
    e.event_type = 'error' AS failed
  FROM events e
)"""

ACCT = f"account_id = '{fx.ACCOUNT}' AND has_md"


def cost_4dp(i: str, o: str) -> str:
    return f"CAST(({i} * 3 + {o} * 15 + 50) // 100 AS DOUBLE) / 10000.0"


def cost_2dp(i: str, o: str) -> str:
    return f"CAST(({i} * 3 + {o} * 15 + 5000) // 10000 AS DOUBLE) / 100.0"


def pct_2dp(used: str, limit: str) -> str:
    return (f"CASE WHEN {limit} > 0 THEN CAST((CAST({used} AS HUGEINT) * 20000 + {limit}) "
            f"// (2 * {limit}) AS DOUBLE) / 100.0 END")


def _sql(body: str) -> str:
    return f"WITH {INV}\n{body}"


def _q() -> dict[str, str]:
    d30, d7 = since_days(30), since_days(7)
    tot = "(input_tokens + output_tokens)"
    return {
        "usage_by_user": _sql(f"""
SELECT user_id, tenant, department, COUNT(*) AS invocation_count,
       CAST(SUM(input_tokens) AS BIGINT) AS input_tokens,
       CAST(SUM(output_tokens) AS BIGINT) AS output_tokens,
       CAST(SUM({tot}) AS BIGINT) AS total_tokens
FROM inv WHERE {ACCT} AND ts >= {d30}
GROUP BY user_id, tenant, department"""),
        "tenant_daily_usage": _sql(f"""
SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, tenant, COUNT(*) AS invocation_count,
       CAST(SUM({tot}) AS BIGINT) AS total_tokens, AVG({tot}) AS avg_tokens_per_call
FROM inv WHERE {ACCT} AND ts >= {d7}
GROUP BY 1, 2"""),
        "department_cost": _sql(f"""
SELECT tenant, department, COUNT(DISTINCT user_id) AS unique_users, COUNT(*) AS invocation_count,
       CAST(SUM(input_tokens) AS BIGINT) AS input_tokens,
       CAST(SUM(output_tokens) AS BIGINT) AS output_tokens,
       CAST(SUM({tot}) AS BIGINT) AS total_tokens,
       {cost_4dp('SUM(input_tokens)', 'SUM(output_tokens)')} AS estimated_cost_usd
FROM inv WHERE {ACCT} AND ts >= {d30}
GROUP BY tenant, department"""),
        "user_quota_tracking": _sql(f"""
, u AS (
  SELECT user_id, CAST(SUM({tot}) AS BIGINT) AS tokens_used FROM inv
  WHERE {ACCT} AND date_trunc('month', ts) = TIMESTAMP '2024-02-01 00:00:00'
  GROUP BY user_id
), l AS (
  SELECT user_id, tokens_used,
    CAST(CASE WHEN user_id LIKE '%john.doe%' THEN 500000000
         WHEN user_id LIKE '%alice.johnson%' THEN 400000000
         WHEN user_id LIKE '%david.chen%' THEN 350000000
         WHEN user_id LIKE '%jane.smith%' THEN 300000000
         WHEN user_id LIKE '%bob.wilson%' THEN 250000000
         ELSE 100000000 END AS BIGINT) AS monthly_limit
  FROM u
)
SELECT user_id, tokens_used, monthly_limit, {pct_2dp('tokens_used', 'monthly_limit')} AS usage_percentage
FROM l""").replace("\n,", ",", 1),
        "hourly_pattern": _sql(f"""
SELECT date_trunc('hour', ts) AS hour, COUNT(*) AS invocation_count,
       CAST(SUM({tot}) AS BIGINT) AS total_tokens
FROM inv WHERE {ACCT} AND ts >= {d7}
GROUP BY 1"""),
        "model_distribution": _sql(f"""
SELECT model_id AS modelid, tenant, COUNT(*) AS invocation_count,
       CAST(SUM({tot}) AS BIGINT) AS total_tokens, AVG({tot}) AS avg_tokens
FROM inv WHERE {ACCT} AND ts >= {d30}
GROUP BY 1, 2"""),
        "error_analysis": _sql(f"""
SELECT user_id, tenant, error_type, COUNT(*) AS error_count
FROM inv WHERE {ACCT} AND ts >= {d7} AND error_type IS NOT NULL
GROUP BY 1, 2, 3"""),
        "audit_trail": _sql(f"""
SELECT ts AS timestamp, user_id, tenant, department, source, model_id AS modelid,
       input_tokens, output_tokens, request_id AS requestid
FROM inv WHERE {ACCT} AND ts >= {since_hours(1)}
ORDER BY ts DESC, request_id DESC LIMIT 100"""),
        "tenant_monthly_cost": _sql(f"""
SELECT date_trunc('month', ts) AS month, tenant, COUNT(*) AS invocation_count,
       CAST(SUM(input_tokens) AS BIGINT) AS input_tokens,
       CAST(SUM(output_tokens) AS BIGINT) AS output_tokens,
       {cost_2dp('SUM(input_tokens)', 'SUM(output_tokens)')} AS total_cost_usd
FROM inv WHERE {ACCT}
GROUP BY 1, 2"""),
        "user_activity_summary": _sql(f"""
SELECT user_id, user_group, tenant, COUNT(*) AS total_invocations,
       COUNT(DISTINCT CAST(ts AS DATE)) AS active_days,
       MIN(ts) AS first_activity, MAX(ts) AS last_activity,
       CAST(SUM({tot}) AS BIGINT) AS total_tokens
FROM inv WHERE {ACCT} AND ts >= {d30}
GROUP BY 1, 2, 3"""),
    }


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(_q())
    out.update(_v())
    out.update(_k())
    out.update(_m())
    out.update(_t())
    out.update(_s())
    return out


MONTH = fx.USAGE_MONTH
IN_MONTH = f"strftime(ts, '%Y-%m') = '{MONTH}'"
TOT = "(input_tokens + output_tokens)"


def _v() -> dict[str, str]:
    d30 = since_days(30)
    recent = since_hours(1)
    return {
        "cost_by_user_tenant": _sql(f"""
SELECT user_id AS user_email, tenant, COUNT(*) AS invocations,
       CAST(SUM(input_tokens) AS BIGINT) AS input_tokens, CAST(SUM(output_tokens) AS BIGINT) AS output_tokens,
       {cost_4dp('SUM(input_tokens)', 'SUM(output_tokens)')} AS estimated_cost_usd
FROM inv WHERE ts >= {d30} GROUP BY 1, 2"""),
        "cost_by_user": _sql(f"""
SELECT user_id, CAST(SUM({TOT}) AS BIGINT) AS total_tokens,
       {cost_4dp('SUM(input_tokens)', 'SUM(output_tokens)')} AS cost_usd
FROM inv WHERE ts >= {d30} GROUP BY 1"""),
        "split_cost_by_user": _sql(f"""
SELECT user_id, CAST(SUM({TOT}) AS BIGINT) AS tokens,
       {cost_4dp('SUM(input_tokens)', '0')} AS input_cost,
       {cost_4dp('0', 'SUM(output_tokens)')} AS output_cost
FROM inv WHERE {IN_MONTH} GROUP BY 1"""),
        "tenant_cost_month": _sql(f"""
SELECT tenant, CAST(SUM({TOT}) AS BIGINT) AS tokens,
       {cost_2dp('SUM(input_tokens)', 'SUM(output_tokens)')} AS cost_usd
FROM inv WHERE {IN_MONTH} GROUP BY 1"""),
        "department_chargeback": _sql(f"""
SELECT department AS dept, COUNT(*) AS calls, CAST(SUM({TOT}) AS BIGINT) AS tokens,
       {cost_2dp('SUM(input_tokens)', 'SUM(output_tokens)')} AS cost_usd
FROM inv WHERE {IN_MONTH} GROUP BY 1"""),
        "blended_cost_user": _sql(f"""
SELECT user_id, CAST(SUM({TOT}) AS BIGINT) AS total_tokens,
       CAST(SUM({TOT}) * 9 AS DOUBLE) / 1000000.0 AS cost_usd
FROM inv WHERE {IN_MONTH} GROUP BY 1"""),
        "blended_cost_department": _sql(f"""
SELECT department, CAST(SUM({TOT}) AS BIGINT) AS total_tokens,
       CAST(SUM({TOT}) * 9 AS DOUBLE) / 1000000.0 AS cost_usd
FROM inv WHERE {IN_MONTH} GROUP BY 1"""),
        "blended_cost_tenant": _sql(f"""
SELECT tenant, COUNT(*) AS invocation_count, CAST(SUM({TOT}) AS BIGINT) AS total_tokens,
       CAST((SUM({TOT}) * 9 + 5000) // 10000 AS DOUBLE) / 100.0 AS cost_usd
FROM inv WHERE {IN_MONTH} GROUP BY 1"""),
        "cost_by_project": _sql(f"""
SELECT project, CAST(SUM(input_tokens * 3 + output_tokens * 15) AS DOUBLE) / 1000000.0 AS cost_usd
FROM inv WHERE {IN_MONTH} GROUP BY 1"""),
        "tenant_user_department_usage": _sql(f"""
SELECT user_id, tenant, department, CAST(SUM({TOT}) AS BIGINT) AS tokens, COUNT(*) AS calls
FROM inv WHERE {IN_MONTH} AND tenant = 'tenant_a' GROUP BY 1, 2, 3"""),
        "daily_tokens_by_user": _sql(f"""
SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, user_id, CAST(SUM({TOT}) AS BIGINT) AS tokens
FROM inv WHERE {IN_MONTH} GROUP BY 1, 2"""),
        "recent_calls": _sql(f"""
SELECT user_id, tenant, COUNT(*) AS calls FROM inv WHERE ts > {recent} GROUP BY 1, 2"""),
        "tenant_invocations_5m": _sql(f"""
SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bucket_start, COUNT(*) AS invocations
FROM inv WHERE profile_id = '{fx.TENANT_PROFILES[0][0]}' AND ts >= {recent} GROUP BY 1"""),
    }


def _policy_rows() -> str:
    return ", ".join(
        f"('{t}', '{i}', {m}, {d}, '{mode}')" for t, i, m, d, mode in fx.FIXTURE_POLICIES if t != "user")


_USER_LIMITS = ", ".join(
    f"('{i}', {'NULL' if m is None else m}, {'NULL' if d is None else d})"
    for t, i, m, d, _ in fx.FIXTURE_POLICIES if t == "user")

# Users, policies, resolved policy per user, calls, counters (section 2.5).
QUOTA_CTES = f"""
, users AS (
  SELECT DISTINCT caller AS user_id, {_list(fx.GROUPS)}[uid % 5 + 1] AS user_group,
         {_list(fx.TENANTS)}[uid % 4 + 1] AS tenant, {_list(fx.DEPARTMENTS)}[uid % 6 + 1] AS department
  FROM inv WHERE uid % 25 <> 24
), own AS (
  SELECT * FROM (VALUES {_USER_LIMITS}) AS t(user_id, monthly_limit, daily_limit)
), pol AS (
  SELECT * FROM (VALUES {_policy_rows()}) AS t(policy_type, identifier, monthly_limit, daily_limit, enforcement_mode)
  UNION ALL
  SELECT 'user', o.user_id, CAST(o.monthly_limit AS BIGINT), CAST(o.daily_limit AS BIGINT), 'block'
  FROM own o JOIN users u USING (user_id)
), res AS (
  SELECT u.user_id, u.user_group, u.tenant, u.department,
    CASE WHEN up.identifier IS NOT NULL THEN 'user' WHEN gp.identifier IS NOT NULL THEN 'group'
         WHEN dp.identifier IS NOT NULL THEN 'default' ELSE 'builtin' END AS policy_source,
    CAST(CASE WHEN up.identifier IS NOT NULL THEN coalesce(up.monthly_limit, 0)
         WHEN gp.identifier IS NOT NULL THEN coalesce(gp.monthly_limit, 0)
         WHEN dp.identifier IS NOT NULL THEN coalesce(dp.monthly_limit, 0) ELSE 100000000 END AS BIGINT) AS monthly_limit,
    CAST(CASE WHEN up.identifier IS NOT NULL THEN coalesce(up.daily_limit, 0)
         WHEN gp.identifier IS NOT NULL THEN coalesce(gp.daily_limit, 0)
         WHEN dp.identifier IS NOT NULL THEN coalesce(dp.daily_limit, 0) ELSE 5000000 END AS BIGINT) AS daily_limit,
    CASE WHEN up.identifier IS NOT NULL THEN coalesce(up.enforcement_mode, 'block')
         WHEN gp.identifier IS NOT NULL THEN coalesce(gp.enforcement_mode, 'block')
         WHEN dp.identifier IS NOT NULL THEN coalesce(dp.enforcement_mode, 'block') ELSE 'alert' END AS enforcement_mode,
    CAST(CASE WHEN up.identifier IS NOT NULL THEN coalesce(up.monthly_limit, 1)
         WHEN gp.identifier IS NOT NULL THEN coalesce(gp.monthly_limit, 1)
         WHEN dp.identifier IS NOT NULL THEN coalesce(dp.monthly_limit, 1) ELSE 100000000 END AS BIGINT) AS metric_monthly_limit,
    CAST(CASE WHEN up.identifier IS NOT NULL THEN coalesce(up.daily_limit, 1)
         WHEN gp.identifier IS NOT NULL THEN coalesce(gp.daily_limit, 1)
         WHEN dp.identifier IS NOT NULL THEN coalesce(dp.daily_limit, 1) ELSE 5000000 END AS BIGINT) AS metric_daily_limit
  FROM users u
  LEFT JOIN pol up ON up.policy_type = 'user' AND up.identifier = u.user_id
  LEFT JOIN pol gp ON gp.policy_type = 'group' AND gp.identifier = u.user_group
  LEFT JOIN pol dp ON dp.policy_type = 'default' AND dp.identifier = 'default'
), calls AS (
  SELECT request_id, ts, caller AS user_id, input_tokens, output_tokens, failed, latency_ms,
         CASE WHEN failed THEN 0 ELSE coalesce(input_tokens, 0) + coalesce(output_tokens, 0) END AS tokens
  FROM inv
), daily AS (
  SELECT user_id AS user_email, CAST(ts AS DATE) AS d,
         CAST(SUM(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) AS BIGINT) AS tokens_used,
         MAX(ts) AS last_updated
  FROM inv WHERE user_id IS NOT NULL AND error_type IS NULL GROUP BY 1, 2
), counters AS (
  SELECT user_email, 'monthly_' || strftime(m, '%Y-%m') AS metric_period, tokens_used, last_updated,
         epoch_us(CAST(m AS TIMESTAMP)) // 1000000 + {60 * 86400} AS ttl
  FROM (SELECT user_email, date_trunc('month', d) AS m, CAST(SUM(tokens_used) AS BIGINT) AS tokens_used,
               MAX(last_updated) AS last_updated FROM daily GROUP BY 1, 2)
  UNION ALL
  SELECT user_email, 'daily_' || strftime(d, '%Y-%m-%d'), tokens_used, last_updated,
         epoch_us(last_updated) // 1000000 + {7 * 86400}
  FROM daily
), k AS (
  SELECT c.*, r.user_group, r.tenant, r.department, r.policy_source, r.monthly_limit, r.daily_limit,
         r.enforcement_mode, r.metric_monthly_limit, r.metric_daily_limit
  FROM calls c JOIN res r USING (user_id)
), s1 AS (
  SELECT *, coalesce(SUM(tokens) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, request_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < daily_limit AS day_ok FROM k
), s2 AS (
  SELECT *, coalesce(SUM(CASE WHEN day_ok THEN tokens ELSE 0 END) OVER (PARTITION BY user_id, date_trunc('month', ts)
            ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m_ok FROM s1
), s3 AS (
  SELECT *, CASE WHEN enforcement_mode = 'block' THEN day_ok AND m_ok < monthly_limit ELSE TRUE END AS allowed FROM s2
), s4 AS (
  SELECT *, CASE WHEN allowed THEN tokens ELSE 0 END AS charged_tokens FROM s3
), replay AS (
  SELECT request_id, ts, user_id, user_group, tenant, department, policy_source, enforcement_mode,
         monthly_limit, daily_limit, metric_monthly_limit, metric_daily_limit, tokens, failed, allowed, charged_tokens,
         CAST(coalesce(SUM(charged_tokens) OVER (PARTITION BY user_id, date_trunc('month', ts) ORDER BY ts, request_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS monthly_usage,
         CAST(coalesce(SUM(charged_tokens) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, request_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS daily_usage,
         CASE WHEN NOT allowed THEN 429 WHEN failed THEN 500 ELSE 200 END AS status
  FROM s4
)"""

REPLAY_COLS = ("request_id, ts, user_id, policy_source, enforcement_mode, monthly_limit, daily_limit, tokens, "
               "allowed, charged_tokens, monthly_usage, daily_usage, status")


def _qsql(body: str) -> str:
    return f"WITH {INV}{QUOTA_CTES}\n{body}"


_CHANGES = ", ".join(f"('{t}', '{i}', {m}, {d}, '{mode}', TIMESTAMP '{at[:19].replace('T', ' ')}')" for t, i, m, d, mode, at in fx.POLICY_CHANGES)

# Every put, its time in force, each call's policy at its time, and the protocol played call by call.
VERSION_CTES = f"""
, puts AS (
  SELECT *, TIMESTAMP '2024-01-01 00:00:00' AS put_at FROM pol
  UNION ALL SELECT * FROM (VALUES {_CHANGES}) AS t(policy_type, identifier, monthly_limit, daily_limit, enforcement_mode, put_at)
  UNION ALL SELECT 'user', user_id, m, d, 'block', put_at FROM users,
    (VALUES (12000, 2000, TIMESTAMP '2024-02-04 00:00:00'), (70000, 8000, TIMESTAMP '2024-02-08 12:30:00')) AS v(m, d, put_at)
  WHERE user_id LIKE '%1@%'
), changed AS (
  SELECT * FROM (SELECT *, lag([monthly_limit::VARCHAR, daily_limit::VARCHAR, enforcement_mode]) OVER
                           (PARTITION BY policy_type, identifier ORDER BY put_at) AS before FROM puts)
  WHERE before IS NULL OR before IS DISTINCT FROM [monthly_limit::VARCHAR, daily_limit::VARCHAR, enforcement_mode]
), at_call AS (
  SELECT c.*, (SELECT arg_max({{'s': p.policy_type, 'f': p.put_at, 'm': p.monthly_limit, 'd': p.daily_limit, 'e': p.enforcement_mode}},
                              (CASE p.policy_type WHEN 'user' THEN 2 WHEN 'group' THEN 1 ELSE 0 END, p.put_at))
               FROM changed p WHERE p.put_at <= c.ts AND (p.policy_type, p.identifier) IN
                 (('user', c.user_id), ('group', u.user_group), ('default', 'default'))) AS p
  FROM calls c JOIN users u USING (user_id)
), limited AS (
  SELECT request_id, user_id, ts, tokens, failed, coalesce(p.s, 'builtin') AS policy_source, p.f AS policy_since,
         CAST(CASE WHEN p IS NULL THEN 100000000 ELSE coalesce(p.m, 0) END AS BIGINT) AS monthly_limit,
         CAST(CASE WHEN p IS NULL THEN 5000000 ELSE coalesce(p.d, 0) END AS BIGINT) AS daily_limit,
         CASE WHEN p IS NULL THEN 'alert' ELSE coalesce(p.e, 'block') END AS enforcement_mode,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, request_id) AS nth
  FROM at_call
)"""

# One step per call of a user: read both counters, decide, add.
PLAYED = """
, played AS (
  SELECT user_id, CAST(0 AS BIGINT) AS nth, NULL::TIMESTAMP AS ts, CAST(0 AS BIGINT) AS month_after, CAST(0 AS BIGINT) AS day_after,
         NULL::VARCHAR AS request_id, NULL::BOOLEAN AS allowed, CAST(0 AS BIGINT) AS charged_tokens,
         CAST(0 AS BIGINT) AS monthly_usage, CAST(0 AS BIGINT) AS daily_usage FROM users
  UNION ALL
  SELECT user_id, nth, ts, monthly_usage + charged, daily_usage + charged, request_id, allowed, charged, monthly_usage, daily_usage
  FROM (SELECT *, CAST(CASE WHEN allowed THEN tokens ELSE 0 END AS BIGINT) AS charged
    FROM (SELECT *, enforcement_mode <> 'block' OR (monthly_usage < monthly_limit AND daily_usage < daily_limit) AS allowed
      FROM (SELECT l.*, CAST(CASE WHEN date_trunc('month', l.ts) = date_trunc('month', p.ts) THEN p.month_after ELSE 0 END AS BIGINT) AS monthly_usage,
                   CAST(CASE WHEN CAST(l.ts AS DATE) = CAST(p.ts AS DATE) THEN p.day_after ELSE 0 END AS BIGINT) AS daily_usage
            FROM played p JOIN limited l ON l.user_id = p.user_id AND l.nth = p.nth + 1))))"""


def _k() -> dict[str, str]:
    recent = _ts(fx.AS_OF_RECENT)
    mk, dk = f"monthly_{fx.AS_OF_RECENT:%Y-%m}", f"daily_{fx.AS_OF_RECENT:%Y-%m-%d}"
    check = f"""
SELECT r.user_id, r.enforcement_mode,
       CAST(coalesce(u.m, 0) AS BIGINT) AS monthly_usage, r.monthly_limit,
       CAST(coalesce(u.d, 0) AS BIGINT) AS daily_usage, r.daily_limit,
       coalesce(u.m, 0) >= r.monthly_limit AS monthly_exceeded,
       coalesce(u.d, 0) >= r.daily_limit AS daily_exceeded
FROM res r LEFT JOIN (
  SELECT user_email AS user_id, SUM(CASE WHEN metric_period = '{mk}' THEN tokens_used END) AS m,
         SUM(CASE WHEN metric_period = '{dk}' THEN tokens_used END) AS d
  FROM counters WHERE metric_period IN ('{mk}', '{dk}') GROUP BY 1) u USING (user_id)"""
    allowed = ("CASE WHEN enforcement_mode = 'block' THEN NOT (monthly_exceeded OR daily_exceeded) "
               "ELSE TRUE END")
    return {
        "enrich_identity": _qsql("""
SELECT c.request_id, c.ts, c.user_id, c.input_tokens, c.output_tokens, c.failed, c.latency_ms,
       coalesce(u.user_group, 'default') AS user_group, coalesce(u.tenant, 'default') AS tenant,
       coalesce(u.department, 'unknown') AS department, 'hybrid-gateway' AS source,
       u.user_id IS NOT NULL AS known_user
FROM calls c LEFT JOIN users u USING (user_id)"""),
        "resolve_policy": _qsql("SELECT * FROM res"),
        "usage_counters_spans": _qsql("""
, rd AS (
  SELECT user_id, CAST(ts AS DATE) AS d, CAST(SUM(charged_tokens) AS BIGINT) AS t, MAX(ts) AS at_ FROM replay WHERE status = 200 GROUP BY 1, 2
)
SELECT user_id AS user_email, 'daily_' || strftime(d, '%Y-%m-%d') AS metric_period, t AS tokens_used, at_ AS last_updated,
       epoch_us(at_) // 1000000 + 604800 AS ttl FROM rd
UNION ALL
SELECT user_id, 'monthly_' || strftime(date_trunc('month', d), '%Y-%m'), CAST(SUM(t) AS BIGINT), MAX(at_),
       epoch_us(CAST(date_trunc('month', d) AS TIMESTAMP)) // 1000000 + 5184000 FROM rd GROUP BY user_id, date_trunc('month', d)
""").replace("\n\n, rd AS", ", rd AS"),
        "policy_versions": _qsql(f"""{VERSION_CTES}
SELECT policy_type, identifier, CAST(monthly_limit AS BIGINT) AS monthly_limit, CAST(daily_limit AS BIGINT) AS daily_limit, enforcement_mode,
       put_at AS valid_from, lead(put_at) OVER (PARTITION BY policy_type, identifier ORDER BY put_at) AS valid_to
FROM changed""").replace("\n\n, puts", ", puts"),
        "resolve_policy_at_call": _qsql(f"""{VERSION_CTES}
SELECT request_id, user_id, ts, policy_source, policy_since, monthly_limit, daily_limit, enforcement_mode FROM limited""").replace("\n\n, puts", ", puts"),
        "quota_replay_versions": _qsql(f"""{VERSION_CTES}{PLAYED}
SELECT request_id, l.ts, user_id, policy_source, enforcement_mode, monthly_limit, daily_limit, tokens, allowed, charged_tokens,
       monthly_usage, daily_usage, CASE WHEN NOT allowed THEN 429 WHEN failed THEN 500 ELSE 200 END AS status
FROM limited l JOIN played USING (user_id, nth, request_id)
UNION ALL
SELECT request_id, ts, user_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN user_id IS NULL THEN 400 ELSE 404 END
FROM calls WHERE user_id NOT IN (SELECT user_id FROM users)""").replace("\n\n, puts", ", puts").replace("WITH inv", "WITH RECURSIVE inv", 1),
        "usage_counters": _qsql("SELECT * FROM counters"),
        "check_quota": _qsql(f"SELECT *, {allowed} AS allowed FROM ({check})"),
        "quota_remaining": _qsql(f"""
SELECT user_id, monthly_limit, monthly_usage AS monthly_used, monthly_limit - monthly_usage AS monthly_remaining,
       daily_limit, daily_usage AS daily_used, daily_limit - daily_usage AS daily_remaining
FROM ({check})"""),
        "quota_replay": _qsql(f"""
SELECT {REPLAY_COLS} FROM replay
UNION ALL
SELECT request_id, ts, user_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
       CASE WHEN user_id IS NULL THEN 400 ELSE 404 END
FROM calls WHERE user_id NOT IN (SELECT user_id FROM users)"""),
        "quota_replay_spans": _qsql(f"""
SELECT {REPLAY_COLS} FROM replay
UNION ALL
SELECT request_id, ts, user_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
       CASE WHEN user_id IS NULL THEN 400 ELSE 404 END
FROM calls WHERE user_id NOT IN (SELECT user_id FROM users)"""),
        "quota_exceeded_messages": _qsql("""
SELECT request_id, user_id, 429 AS status, 'Quota exceeded' AS error,
       concat_ws(' | ',
         CASE WHEN monthly_usage >= monthly_limit THEN
           'Monthly quota exceeded (' || monthly_usage || '/' || monthly_limit || ' tokens)' END,
         CASE WHEN daily_usage >= daily_limit THEN
           'Daily quota exceeded (' || daily_usage || '/' || daily_limit || ' tokens)' END) AS message,
       3600 AS retry_after, monthly_usage AS monthly_used, monthly_limit, daily_usage AS daily_used, daily_limit
FROM replay WHERE NOT allowed"""),
        "quota_metrics": _qsql("""
SELECT request_id, ts, user_id, coalesce(tenant, 'unknown') AS tenant,
       CASE WHEN metric_monthly_limit > 0 THEN (monthly_usage + charged_tokens) / metric_monthly_limit * 100
            ELSE 0.0 END AS monthly_pct,
       CASE WHEN metric_daily_limit > 0 THEN (daily_usage + charged_tokens) / metric_daily_limit * 100
            ELSE 0.0 END AS daily_pct,
       charged_tokens AS tokens_used
FROM replay WHERE status = 200"""),
        "expire_counters": _qsql(f"""
SELECT * FROM counters WHERE ttl >= epoch_us({_ts(fx.AS_OF)}) // 1000000"""),
        "initialize_counters": _qsql(f"""
, p AS (
  SELECT user_id AS user_email, '{mk}' AS metric_period,
         epoch_us(TIMESTAMP '{fx.AS_OF_RECENT:%Y-%m}-01 00:00:00') // 1000000 + {60 * 86400} AS ttl FROM users
  UNION ALL
  SELECT user_id, '{dk}', epoch_us({recent}) // 1000000 + {7 * 86400} FROM users
)
SELECT user_email, metric_period, tokens_used, last_updated, ttl FROM counters
UNION ALL
SELECT p.user_email, p.metric_period, CAST(0 AS BIGINT), {recent}, p.ttl FROM p
WHERE NOT EXISTS (SELECT 1 FROM counters c WHERE c.user_email = p.user_email AND c.metric_period = p.metric_period)
""").replace(")\n\n, p AS", "), p AS").replace("\n\n, p AS", ", p AS"),
        "monthly_usage_report": _qsql("""
SELECT user_email, metric_period, tokens_used, last_updated FROM counters WHERE metric_period LIKE 'monthly%'"""),
        "policy_report": _qsql("""
SELECT policy_type, identifier, monthly_limit, daily_limit, coalesce(enforcement_mode, 'unknown') AS enforcement_mode,
       CAST(CAST(round_even(coalesce(monthly_limit, 0) / 1e6, 0) AS BIGINT) AS VARCHAR) || 'M' AS monthly_limit_m,
       CAST(CAST(round_even(coalesce(daily_limit, 0) / 1e6, 0) AS BIGINT) AS VARCHAR) || 'M' AS daily_limit_m
FROM pol"""),
        "user_quota_tracking_joined": _qsql(f"""
, u AS (
  SELECT user_id, CAST(SUM({TOT}) AS BIGINT) AS tokens_used FROM inv
  WHERE {ACCT} AND date_trunc('month', ts) = TIMESTAMP '2024-02-01 00:00:00' GROUP BY 1
)
SELECT u.user_id, u.tokens_used, coalesce(r.monthly_limit, 100000000) AS monthly_limit,
       coalesce(r.policy_source, 'builtin') AS policy_source,
       {pct_2dp('u.tokens_used', 'coalesce(r.monthly_limit, 100000000)')} AS usage_percentage
FROM u LEFT JOIN res r USING (user_id)""").replace(")\n\n, u AS", "), u AS"),
        "user_period_history": _qsql("""
SELECT * FROM counters WHERE user_email = 'user3@company.com' AND metric_period LIKE 'daily_%'"""),
        "request_outcomes": _qsql("""
, o AS (
  SELECT status FROM replay
  UNION ALL SELECT CASE WHEN user_id IS NULL THEN 400 ELSE 404 END FROM calls
  WHERE user_id NOT IN (SELECT user_id FROM users)
)
SELECT status, COUNT(*) AS calls,
       CASE status WHEN 200 THEN 'ok' WHEN 400 THEN 'missing_user_id' WHEN 404 THEN 'unknown_user'
                   WHEN 429 THEN 'quota_exceeded' WHEN 500 THEN 'model_failure' END AS outcome
FROM o GROUP BY status""").replace(")\n\n, o AS", "), o AS"),
        "counter_accuracy": _qsql(f"""
, rd AS (
  SELECT user_id AS user_email, CAST(ts AS DATE) AS d, CAST(SUM(charged_tokens) AS BIGINT) AS t
  FROM replay WHERE status = 200 GROUP BY 1, 2
), stored AS (
  SELECT user_email, 'daily_' || strftime(d, '%Y-%m-%d') AS metric_period, t AS stored_tokens FROM rd
  UNION ALL
  SELECT user_email, 'monthly_' || strftime(date_trunc('month', d), '%Y-%m'), CAST(SUM(t) AS BIGINT) FROM rd GROUP BY 1, 2
)
SELECT coalesce(s.user_email, c.user_email) AS user_email, coalesce(s.metric_period, c.metric_period) AS metric_period,
       s.stored_tokens, c.tokens_used AS log_tokens,
       CAST(coalesce(s.stored_tokens, 0) - coalesce(c.tokens_used, 0) AS BIGINT) AS difference,
       coalesce(s.stored_tokens, 0) - coalesce(c.tokens_used, 0) = 0 AS matches
FROM stored s FULL OUTER JOIN counters c ON s.user_email = c.user_email AND s.metric_period = c.metric_period
""").replace("\n\n, rd AS", ", rd AS"),
        "current_usage": _qsql(f"""
SELECT u.user_id,
       CAST(coalesce(c.m, 0) AS BIGINT) AS monthly_tokens,
       coalesce(CAST(c.mu AS VARCHAR), 'unknown') AS monthly_last_updated,
       CAST(coalesce(c.d, 0) AS BIGINT) AS daily_tokens,
       coalesce(CAST(c.du AS VARCHAR), 'unknown') AS daily_last_updated
FROM users u LEFT JOIN (
  SELECT user_email AS user_id,
         SUM(CASE WHEN metric_period = '{mk}' THEN tokens_used END) AS m,
         MAX(CASE WHEN metric_period = '{mk}' THEN last_updated END) AS mu,
         SUM(CASE WHEN metric_period = '{dk}' THEN tokens_used END) AS d,
         MAX(CASE WHEN metric_period = '{dk}' THEN last_updated END) AS du
  FROM counters WHERE metric_period IN ('{mk}', '{dk}') GROUP BY 1) c USING (user_id)"""),
    }


_PROFILES = ", ".join(f"('{p[0]}', '{p[1].split('(')[0].strip()}')" for p in fx.TENANT_PROFILES)
PROFILE_CTE = f"""
, prof AS (SELECT * FROM (VALUES {_PROFILES}) AS t(profile_id, tenant_name)
), metrics AS (
  SELECT request_id, ts, user_id, coalesce(tenant, 'unknown') AS tenant,
         CASE WHEN metric_monthly_limit > 0 THEN (monthly_usage + charged_tokens) / metric_monthly_limit * 100
              ELSE 0.0 END AS monthly_pct,
         CASE WHEN metric_daily_limit > 0 THEN (daily_usage + charged_tokens) / metric_daily_limit * 100
              ELSE 0.0 END AS daily_pct,
         charged_tokens AS tokens_used
  FROM replay WHERE status = 200
), outcomes AS (
  SELECT ts, status FROM replay
  UNION ALL SELECT ts, CASE WHEN user_id IS NULL THEN 400 ELSE 404 END FROM calls
  WHERE user_id NOT IN (SELECT user_id FROM users)
), ip AS (SELECT inv.*, prof.tenant_name FROM inv JOIN prof USING (profile_id))"""


def _msql(body: str) -> str:
    return f"WITH {INV}{QUOTA_CTES}{PROFILE_CTE}\n{body}"


def _b(seconds: int, col: str = "ts") -> str:
    return f"time_bucket(INTERVAL {seconds} SECOND, {col})"


def _alarm(series: str, threshold, period: int) -> str:
    return f"""
, series AS ({series}
), st AS (
  SELECT *, coalesce(value > {threshold}, FALSE) AS breaching,
         CASE WHEN coalesce(value > {threshold}, FALSE) THEN 'ALARM' ELSE 'OK' END AS state FROM series
)
SELECT period_start, value, breaching, state,
       state <> CASE WHEN lag(period_start) OVER w IS NOT NULL
                      AND lag(period_start) OVER w <> period_start - INTERVAL {period} SECOND THEN 'OK'
                     ELSE coalesce(lag(state) OVER w, 'OK') END AS changed
FROM st WINDOW w AS (ORDER BY period_start)"""


def _changes(series: str, threshold, period: int) -> str:
    """Changes of an alarm of one period, on every period from the first with data to that of the last call; silence does not breach."""
    return f"""
, series AS ({series}
), grid AS (
  SELECT unnest(generate_series(min(period_start), (SELECT max({_b(period)}) FROM inv), INTERVAL {period} SECOND)) AS period_start FROM series
), st AS (
  SELECT period_start, CAST(value AS DOUBLE) AS value, CASE WHEN value > {threshold} THEN 'ALARM' ELSE 'OK' END AS state
  FROM grid LEFT JOIN series USING (period_start)
), pair AS (SELECT *, coalesce(lag(state) OVER (ORDER BY period_start), 'OK') AS previous FROM st)
SELECT period_start, value, previous, state FROM pair WHERE previous <> state"""


_RULES = f"""
, series AS (SELECT tenant, {_b(600)} AS period_start, COUNT(*) AS value FROM inv GROUP BY 1, 2
), grid AS (SELECT tenant, unnest(generate_series(min(period_start), max(period_start), INTERVAL 600 SECOND)) AS period_start FROM series GROUP BY 1
), judged AS (
  SELECT rule, tenant, period_start, value, CASE WHEN value IS NULL THEN rule = 'breaching' ELSE value > 1 END AS b
  FROM (SELECT rule, grid.tenant, grid.period_start, value FROM (SELECT unnest(['notBreaching', 'breaching', 'missing']) AS rule), grid
        LEFT JOIN series ON series.tenant IS NOT DISTINCT FROM grid.tenant AND series.period_start = grid.period_start)
  UNION ALL SELECT 'ignore', tenant, period_start, value, value > 1 FROM series
), st AS (
  SELECT *, CASE WHEN value IS NULL AND rule = 'missing' THEN 'INSUFFICIENT_DATA'
                 WHEN b AND coalesce(lag(b) OVER w, FALSE) THEN 'ALARM' ELSE 'OK' END AS state
  FROM judged WINDOW w AS (PARTITION BY rule, tenant ORDER BY period_start)
), pair AS (SELECT *, coalesce(lag(state) OVER (PARTITION BY rule, tenant ORDER BY period_start), 'OK') AS previous FROM st)
SELECT rule, tenant, period_start, CAST(value AS DOUBLE) AS value, previous, state FROM pair WHERE previous <> state"""


def _m() -> dict[str, str]:
    recent = _ts(fx.AS_OF_RECENT)
    band = "CASE WHEN max_pct >= 95 THEN 'Critical' WHEN max_pct >= 80 THEN 'Warning' ELSE 'OK' END"
    out = {
        "avg_quota_percent": _msql(f"""
SELECT user_id, round(AVG(monthly_pct), 6) AS avg_monthly_pct, COUNT(*) AS points
FROM metrics WHERE ts >= {since_hours(1)} GROUP BY 1"""),
        "tenant_invocations_hourly": _msql(f"""
SELECT tenant_name, profile_id, {_b(3600)} AS period_start, COUNT(*) AS invocations FROM ip GROUP BY 1, 2, 3"""),
        "tenant_tokens_hourly": _msql(f"""
SELECT tenant_name, profile_id, {_b(3600)} AS period_start,
       CAST(SUM(input_tokens) + SUM(output_tokens) AS BIGINT) AS tokens FROM ip GROUP BY 1, 2, 3"""),
        "quota_gauge": _msql(f"""
SELECT user_id, split_part(user_id, '@', 1) AS label, period_start, max_pct, {band} AS band
FROM (SELECT user_id, {_b(300)} AS period_start, MAX(monthly_pct) AS max_pct FROM metrics GROUP BY 1, 2)"""),
        "quota_sparkline": _msql(f"""
SELECT user_id, MAX(period_start) AS latest_period, arg_max(max_pct, period_start) AS latest_pct,
       COUNT(*) AS points
FROM (SELECT user_id, {_b(300)} AS period_start, MAX(monthly_pct) AS max_pct FROM metrics GROUP BY 1, 2)
GROUP BY 1"""),
        "tokens_by_user_hourly": _msql(f"""
SELECT user_id, tenant, {_b(3600)} AS period_start, CAST(SUM(tokens_used) AS BIGINT) AS tokens
FROM metrics GROUP BY 1, 2, 3"""),
        "monthly_pct_trend": _msql(f"""
SELECT user_id, {_b(300)} AS period_start, MAX(monthly_pct) AS max_pct FROM metrics GROUP BY 1, 2"""),
        "daily_pct_trend": _msql(f"""
SELECT user_id, {_b(300)} AS period_start, MAX(daily_pct) AS max_pct, MAX(daily_pct) >= 80 AS above_warning
FROM metrics GROUP BY 1, 2"""),
        "api_calls_5m": _msql(f"""
SELECT {_b(300)} AS period_start, COUNT(*) AS calls FROM outcomes GROUP BY 1"""),
        "function_health_5m": _msql(f"""
SELECT {_b(300)} AS period_start, COUNT(*) AS invocations, COUNT(*) FILTER (WHERE status = 500) AS errors,
       COUNT(*) FILTER (WHERE status = 429) AS throttles FROM outcomes GROUP BY 1"""),
        "duration_stats_5m": _msql(f"""
SELECT {_b(300)} AS period_start, AVG(latency_ms) AS avg_ms, MAX(latency_ms) AS max_ms,
       round(quantile_cont(latency_ms, 0.99), 6) AS p99_ms FROM calls GROUP BY 1"""),
        "peak_concurrency_1m": _msql("""
, c AS (SELECT ts AS b, ts + latency_ms * INTERVAL 1 MILLISECOND AS e FROM calls WHERE latency_ms > 0),
minutes AS (
  SELECT DISTINCT unnest(generate_series(date_trunc('minute', b), date_trunc('minute', e - INTERVAL 1 MICROSECOND), INTERVAL 1 MINUTE)) AS m FROM c),
-- The number in flight is highest at the minute's beginning or where a call begins.
instants AS (SELECT m, m AS at FROM minutes UNION SELECT date_trunc('minute', b), b FROM c),
counted AS (SELECT i.m, i.at, COUNT(*) AS n FROM instants i JOIN c ON c.b <= i.at AND c.e > i.at GROUP BY 1, 2)
SELECT m AS period_start, CAST(MAX(n) AS BIGINT) AS max_concurrent FROM counted GROUP BY 1""").replace("\n\n, c AS", ", c AS"),
        "tenant_comparison_24h": _msql(f"""
SELECT tenant_name, profile_id, {_b(86400)} AS period_start, COUNT(*) AS invocations FROM ip GROUP BY 1, 2, 3"""),
        "user_token_comparison_24h": _msql(f"""
SELECT user_id, {_b(86400)} AS period_start, CAST(SUM(tokens_used) AS BIGINT) AS tokens FROM metrics GROUP BY 1, 2"""),
        "tenant_latency_5m": _msql(f"""
SELECT tenant_name, profile_id, {_b(300)} AS period_start, AVG(latency_ms) AS avg_ms,
       round(quantile_cont(latency_ms, 0.99), 6) AS p99_ms FROM ip GROUP BY 1, 2, 3"""),
        "tenant_errors_5m": _msql(f"""
SELECT tenant_name, profile_id, {_b(300)} AS period_start, COUNT(error_type) AS errors FROM ip GROUP BY 1, 2, 3"""),
        "token_share_24h": _msql(f"""
, per AS (
  SELECT tenant_name, profile_id,
         CAST(coalesce(SUM(input_tokens), 0) + coalesce(SUM(output_tokens), 0) AS BIGINT) AS tokens
  FROM ip WHERE ts >= {since_hours(24)} GROUP BY 1, 2
)
SELECT tenant_name, profile_id, tokens,
       CASE WHEN SUM(tokens) OVER () > 0 THEN CAST(tokens AS DOUBLE) * 100.0 / SUM(tokens) OVER () END AS share_pct
FROM per""").replace("\n\n, per AS", ", per AS"),
        "quota_status_table": _msql("""
SELECT user_id, split_part(user_id, '@', 1) AS user,
       CAST(CAST(round_even(monthly_limit / 1e6, 0) AS BIGINT) AS VARCHAR) || 'M' AS monthly_limit,
       'Varies' AS daily_limit, 'Active' AS status FROM res"""),
        "tenant_usage_last_hour": _msql(f"""
SELECT p.tenant_name, p.profile_id, CAST(coalesce(n, 0) AS BIGINT) AS invocations,
       CAST(coalesce(n, 0) * 500 AS BIGINT) AS tokens_estimate
FROM prof p LEFT JOIN (SELECT profile_id, COUNT(*) AS n FROM inv WHERE ts >= {since_hours(1)} GROUP BY 1) c
USING (profile_id)"""),
        "user_invocations": _msql(f"""
SELECT user_id, tenant, {_b(3600)} AS period_start, COUNT(*) AS invocations
FROM inv WHERE user_id IS NOT NULL GROUP BY 1, 2, 3"""),
        "metric_statistics": _msql(f"""
SELECT tenant, {_b(3600)} AS period_start, AVG(output_tokens) AS avg_output_tokens
FROM inv WHERE ts >= TIMESTAMP '2024-02-01 00:00:00' AND ts < TIMESTAMP '2024-02-08 00:00:00' GROUP BY 1, 2"""),
        "evaluate_alarm_2of2": _msql(f"""
, series AS (SELECT {_b(3600)} AS period_start, COUNT(*) AS value FROM inv GROUP BY 1),
  st AS (SELECT *, value > 14 AS breaching FROM series),
  st2 AS (
    SELECT *, CASE WHEN breaching AND coalesce(lag(breaching) OVER w, FALSE)
                    AND lag(period_start) OVER w = period_start - INTERVAL 3600 SECOND
                   THEN 'ALARM' ELSE 'OK' END AS state
    FROM st WINDOW w AS (ORDER BY period_start))
SELECT period_start, value, breaching, state,
       state <> CASE WHEN lag(period_start) OVER w IS NOT NULL
                      AND lag(period_start) OVER w <> period_start - INTERVAL 3600 SECOND THEN 'OK'
                     ELSE coalesce(lag(state) OVER w, 'OK') END AS changed
FROM st2 WINDOW w AS (ORDER BY period_start)""").replace("\n\n, series AS", ", series AS"),
        "high_quota_alarm": _msql(_alarm(f"""
  SELECT period_start, MAX(v) AS value FROM (
    SELECT user_id, {_b(300)} AS period_start, MAX(monthly_pct) AS v FROM metrics GROUP BY 1, 2) GROUP BY 1""",
                                          80.0, 300)).replace("\n\n, series AS", ", series AS"),
        "error_alarm": _msql(_alarm(f"""
  SELECT {_b(300)} AS period_start, COUNT(*) FILTER (WHERE status = 500) AS value FROM outcomes GROUP BY 1""",
                                     5, 300)).replace("\n\n, series AS", ", series AS"),
        "high_token_alarm": _msql(_alarm(f"""
  SELECT {_b(3600)} AS period_start, CAST(coalesce(SUM(input_tokens), 0) AS BIGINT) AS value FROM inv GROUP BY 1""",
                                          1000000, 3600)).replace("\n\n, series AS", ", series AS"),
        "storage_tier": _msql(f"""
SELECT CASE WHEN age >= 365 THEN 'EXPIRED' WHEN age >= 90 THEN 'GLACIER' WHEN age >= 30 THEN 'STANDARD_IA'
            ELSE 'STANDARD' END AS tier,
       COUNT(*) AS rows, CAST(MIN(d) AS TIMESTAMP) AS oldest_day, CAST(MAX(d) AS TIMESTAMP) AS newest_day
FROM (SELECT CAST(ts AS DATE) AS d, date_diff('day', CAST(ts AS DATE), DATE '{fx.AS_OF:%Y-%m-%d}') AS age FROM inv)
GROUP BY 1"""),
        "expire_partitions": _msql(f"""
SELECT request_id, ts, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day FROM inv WHERE ts >= {since_days(30)}"""),
    }
    return out


def _t() -> dict[str, str]:
    return {
        "stream_quota_alarm": _m()["high_quota_alarm"],
        "stream_usage_counters": _qsql("SELECT * FROM counters"),
        "dedup_stream": _qsql("""
SELECT request_id, ts, user_id, input_tokens, output_tokens, failed, latency_ms FROM calls"""),
        **{f"stream_metrics_{name}": _qsql(f"""
SELECT tenant, {_b(period)} AS period_start, COUNT(*) AS calls, CAST(coalesce(SUM({TOT}), 0) AS BIGINT) AS tokens,
       COUNT(error_type) AS errors, AVG(latency_ms) AS average, MAX(latency_ms) AS maximum,
       round(quantile_cont(latency_ms, 0.99), 6) AS p99
FROM inv GROUP BY 1, 2""") for name, period in (("1m", 60), ("5m", 300), ("1h", 3600), ("1d", 86400))},
        "stream_alarms": _m()["error_alarm"],
        "stream_token_alarm": _m()["high_token_alarm"],
        "span_sketches": _msql("""
SELECT tenant, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 3 AS INTEGER) AS span, COUNT(*) AS calls, COUNT(latency_ms) AS valued,
       quantile_disc(latency_ms, 0.5) AS q50, quantile_disc(latency_ms, 0.99) AS q99, COUNT(DISTINCT user_id) AS users
FROM inv GROUP BY 1, 2"""),
        "rollup_span": _sql("""
SELECT tenant, COUNT(*) AS calls, CAST(SUM(input_tokens) AS BIGINT) AS input_tokens_sum, CAST(SUM(output_tokens) AS BIGINT) AS output_tokens_sum,
       COUNT(output_tokens) AS output_tokens_n, MIN(latency_ms) AS latency_ms_min, MAX(latency_ms) AS latency_ms_max, AVG(latency_ms) AS latency_ms_avg
FROM inv WHERE ts >= TIMESTAMP '2024-01-20 10:17:00' AND ts < TIMESTAMP '2024-03-01' GROUP BY 1"""),
        "rollup_hourly": _sql("""
SELECT profile_id, date_trunc('hour', ts) AS period_start, COUNT(*) AS calls,
       CAST(SUM(input_tokens) AS BIGINT) AS input_tokens_sum, CAST(SUM(output_tokens) AS BIGINT) AS output_tokens_sum
FROM inv WHERE ts >= TIMESTAMP '2024-01-20 10:17:00' AND ts < TIMESTAMP '2024-03-01' GROUP BY 1, 2"""),
        "stream_token_alerts": _msql(_changes(f"""
  SELECT {_b(3600)} AS period_start, coalesce(SUM(input_tokens), 0) AS value FROM inv GROUP BY 1""", 6000, 3600)).replace("\n\n, series", ", series"),
        "stream_error_alerts": _msql(_changes(f"""
  SELECT {_b(300)} AS period_start, COUNT(*) FILTER (status = 500) AS value FROM (
    SELECT ts, status FROM replay UNION ALL SELECT ts, 404 FROM calls WHERE user_id NOT IN (SELECT user_id FROM users)) GROUP BY 1""",
                                              1, 300)).replace("\n\n, series", ", series"),
        "stream_quota_alerts": _msql(_changes(f"""
  SELECT {_b(300)} AS period_start, MAX(CASE WHEN metric_monthly_limit > 0 THEN (monthly_usage + charged_tokens) / metric_monthly_limit * 100 ELSE 0.0 END) AS value
  FROM replay WHERE status = 200 GROUP BY 1""", 80, 300)).replace("\n\n, series", ", series"),
        "alarm_missing_rules": _msql(_RULES).replace("\n\n, series", ", series"),
        "stream_raw_log": _qsql("SELECT * FROM counters"),
        "stream_quota_decisions": _qsql("""
SELECT request_id, ts, user_id, enforcement_mode, monthly_limit, daily_limit, metric_monthly_limit, tokens,
       allowed, charged_tokens, monthly_usage, daily_usage, status FROM replay
UNION ALL
SELECT request_id, ts, user_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
       CASE WHEN user_id IS NULL THEN 400 ELSE 404 END
FROM calls WHERE user_id NOT IN (SELECT user_id FROM users)"""),
    }


def _s() -> dict[str, str]:
    since7 = since_days(7)
    return {
        "sql_dialect_project_hours": _qsql("""
SELECT coalesce(project, 'none') AS project, CAST(hour(ts) AS INTEGER) AS hour_of_day, COUNT(*) AS calls,
       COUNT(error_type) AS failures, MAX(output_tokens) AS longest_answer
FROM inv GROUP BY 1, 2"""),
        "load_tenant_profiles": _sql(" UNION ALL ".join(
            f"SELECT '{i}' AS profile_id, '{n}' AS name, '{t}' AS tenant, '{c}' AS color, '2024-02-01T00:00:00Z' AS updatedAt "
            f"WHERE EXISTS (SELECT 1 FROM events WHERE user_id % 4 = {k})" for k, (i, n, t, c) in enumerate(fx.TENANT_PROFILES))),
        "upsert_dimension_put": _qsql("""
SELECT u.user_id AS userId, u.user_group AS "group",
       CASE WHEN u.user_id LIKE '%4@%' THEN 'reorganised' ELSE u.department END AS department,
       CAST(CASE WHEN u.user_id NOT LIKE '%4@%' THEN o.monthly_limit END AS BIGINT) AS monthlyLimit,
       CAST(CASE WHEN u.user_id NOT LIKE '%4@%' THEN o.daily_limit END AS BIGINT) AS dailyLimit,
       CASE WHEN u.user_id LIKE '%4@%' THEN '2024-02-01T00:00:00Z' ELSE '2024-01-01T00:00:00Z' END AS updatedAt
FROM users u LEFT JOIN own o USING (user_id)"""),
        "read_widened_log": _sql("""
SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, COUNT(*) AS calls, CAST(SUM(input_tokens) AS BIGINT) AS input_tokens,
       CAST(SUM(output_tokens) AS BIGINT) AS output_tokens, CAST(SUM(latency_ms) AS BIGINT) AS latency_ms
FROM inv GROUP BY 1"""),
        "discover_schema": _sql("""
SELECT field, type, change FROM (
  -- The hour folders and two columns that the previous schema lacked; no record has a response body.
  SELECT unnest(['year', 'month', 'day', 'hour']) AS field, 'int' AS type, 'added' AS change
  UNION ALL SELECT 'latency_ms', 'bigint', 'added' WHERE EXISTS (SELECT 1 FROM inv WHERE latency_ms IS NOT NULL)
  UNION ALL SELECT 'region', 'string', 'added'
  UNION ALL SELECT 'output' || path, type, 'missing' FROM (VALUES
    ('', 'struct<outputBodyJson:struct<usage:struct<input_tokens:bigint,output_tokens:bigint>>>'),
    ('.outputBodyJson', 'struct<usage:struct<input_tokens:bigint,output_tokens:bigint>>'),
    ('.outputBodyJson.usage', 'struct<input_tokens:bigint,output_tokens:bigint>'),
    ('.outputBodyJson.usage.input_tokens', 'bigint'), ('.outputBodyJson.usage.output_tokens', 'bigint')) AS v(path, type))
WHERE EXISTS (SELECT 1 FROM inv)"""),
        "log_file_inventory": _sql("""
SELECT 'year=' || year(ts) || '/month=' || month(ts) || '/day=' || day(ts) || '/hour=' || hour(ts) AS folder,
       COUNT(*) AS records FROM inv GROUP BY 1"""),
        "normalize_rejects": _qsql("""
SELECT COUNT(*) AS records, COUNT(*) FILTER (WHERE ts IS NULL) AS bad_timestamp,
       CAST(0 AS BIGINT) AS bad_input_tokens, CAST(0 AS BIGINT) AS bad_output_tokens,
       CAST(0 AS BIGINT) AS malformed_metadata, CAST(0 AS BIGINT) AS malformed_usage
FROM inv"""),
        "write_invocations_partitioned": _qsql("""
SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day,
       CAST(hour(ts) AS INTEGER) AS hour, COUNT(*) AS calls,
       MIN(ts) AS first_ts, MAX(ts) AS last_ts
FROM inv GROUP BY 1, 2, 3, 4"""),
        "expire_stored_partitions": _qsql(f"""
SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day,
       CAST(hour(ts) AS INTEGER) AS hour, COUNT(*) AS calls, MIN(ts) AS first_ts, MAX(ts) AS last_ts
FROM inv WHERE ts >= {_ts(fx.AS_OF - dt.timedelta(days=25, minutes=20))} GROUP BY 1, 2, 3, 4"""),
        "load_quota_policies": _qsql("""
SELECT policy_type, identifier, monthly_limit, daily_limit,
       CASE WHEN policy_type = 'group' THEN 'alert' ELSE enforcement_mode END AS enforcement_mode
FROM pol"""),
        "normalize_invocations": _qsql("""
SELECT ts, account_id, request_id, model_id, profile_id, user_id, tenant, user_group, department, source,
       input_tokens, output_tokens, error_type, latency_ms, strftime(ts, '%Y-%m') AS usage_month,
       CAST(CAST(ts AS DATE) AS TIMESTAMP) AS usage_day
FROM inv"""),
        "read_invocation_logs": _qsql(f"""
SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, COUNT(*) AS calls, CAST(SUM({TOT}) AS BIGINT) AS tokens
FROM inv WHERE ts >= {since7} GROUP BY 1"""),
        "load_user_metadata": _qsql("""
SELECT user_id AS userId, user_group AS "group", tenant,
       CASE WHEN user_id LIKE '%0@%' THEN department || '-moved' ELSE department END AS department,
       CASE WHEN user_id LIKE '%0@%' THEN '2024-02-01T00:00:00Z' ELSE '2024-01-01T00:00:00Z' END AS updatedAt
FROM users"""),
        "write_report": _q()["department_cost"],
        "log_freshness": _qsql(f"""
, srcs AS (SELECT DISTINCT source FROM inv WHERE source IS NOT NULL UNION ALL SELECT 'batch-import'),
  newest AS (SELECT source, MAX(ts) AS newest_event FROM inv GROUP BY 1)
SELECT s.source, n.newest_event,
       CASE WHEN n.newest_event IS NOT NULL THEN
         epoch_us({_ts(fx.AS_OF_RECENT)}) // 1000000 - epoch_us(n.newest_event) // 1000000 END AS lag_seconds,
       CASE WHEN n.newest_event IS NULL THEN 'no events yet' ELSE 'ok' END AS status
FROM srcs s LEFT JOIN newest n USING (source)""").replace("\n\n, srcs AS", ", srcs AS"),
        "upsert_dimension": _qsql("""
SELECT u.user_id AS userId, u.user_group AS "group",
       CAST(CASE WHEN u.user_id LIKE '%5@%' THEN 50000 ELSE o.monthly_limit END AS BIGINT) AS monthlyLimit,
       CAST(CASE WHEN u.user_id LIKE '%5@%' THEN 6000 ELSE o.daily_limit END AS BIGINT) AS dailyLimit,
       CASE WHEN u.user_id LIKE '%5@%' THEN '2024-02-04T00:00:00Z' ELSE '2024-01-01T00:00:00Z' END AS updatedAt
FROM users u LEFT JOIN own o USING (user_id)"""),
        "derive_user_policies": _qsql("""
SELECT 'user' AS policy_type, u.user_id AS identifier, CAST(o.monthly_limit AS BIGINT) AS monthly_limit,
       CAST(o.daily_limit AS BIGINT) AS daily_limit,
       'block' AS enforcement_mode, 'User-specific quota for ' || u.user_id AS description
FROM users u LEFT JOIN own o USING (user_id)"""),
        "usage_totals": _qsql("""
SELECT COUNT(*) AS total_calls, CAST(coalesce(SUM(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)), 0) AS BIGINT)
       AS total_tokens,
       CAST(CASE WHEN COUNT(*) > 0 THEN coalesce(SUM(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)), 0)
            // COUNT(*) ELSE 0 END AS BIGINT) AS avg_tokens_per_call
FROM inv"""),
        "enrich_identity_reject": _qsql("""
SELECT c.request_id, c.ts, c.user_id, c.input_tokens, c.output_tokens, c.failed, c.latency_ms,
       u.user_group, u.tenant, u.department, 'hybrid-gateway' AS source, TRUE AS known_user
FROM calls c JOIN users u USING (user_id)"""),
    }
