"""A0-A3: threshold alarms over metric series.

A series is (dims, period_start, value).  A period is breaching when
``value > threshold`` (strict).  The state is ALARM when the last
``eval_periods`` consecutive periods all breach.  What a period without data
does is the alarm's ``missing`` rule: ``notBreaching`` and ``breaching``
count it as such, ``ignore`` leaves state and run as they are, and
``missing`` breaks the run and gives INSUFFICIENT_DATA.  Periods before the
first data, and after the last, are not judged; the state before them is OK.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotalake.functions.timecols import bucket_start
from quotalake.plans.asof import neighbour

OK, ALARM, INSUFFICIENT = "OK", "ALARM", "INSUFFICIENT_DATA"
MISSING_RULES = ("notBreaching", "breaching", "ignore", "missing")


def check_rule(missing: str) -> None:
    if missing not in MISSING_RULES:
        raise ValueError(f"missing is one of {', '.join(MISSING_RULES)}")


def evaluate_alarm(series: DataFrame, threshold: float, period_s: int, eval_periods: int = 1,
                   dims: Sequence[str] = (), value: str = "value", missing: str = "notBreaching") -> DataFrame:
    """A0: state per series point and whether it changed from the previous period's.

    By the rule ``notBreaching``, each point tells itself and the
    ``eval_periods`` periods after it whether it breaches; one aggregation per
    (dims, period) gathers these marks, so no task holds a series.  The other
    rules look at the points before (``_judged``).
    """
    check_rule(missing)
    dims = list(dims)
    if missing != "notBreaching":
        judged = _judged(series, threshold, period_s, eval_periods, dims, value, missing)
        return judged.where("_kind = 'data'").select(*series.columns, "breaching", "state", (F.col("state") != F.col("_prior")).alias("changed"))
    breach = F.coalesce(F.col(value) > F.lit(threshold), F.lit(False))
    told = (series.withColumn("breaching", breach).withColumn("_row", F.struct(*series.columns))
            .withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(eval_periods))))
            .select(*dims, F.timestamp_add("SECOND", F.col("_k") * F.lit(period_s), F.col("period_start")).alias("_period"),
                    "_k", "breaching", F.when(F.col("_k") == 0, F.col("_row")).alias("_row")))
    marks = [F.coalesce(F.bool_or(F.when(F.col("_k") == k, F.col("breaching"))), F.lit(False)).alias(f"_b{k}")
             for k in range(eval_periods + 1)]
    points = told.groupBy(*dims, "_period").agg(F.max("_row").alias("_row"), *marks).where("_row is not null")

    def all_of(first: int) -> Column:
        out = F.lit(True)
        for k in range(first, first + eval_periods):
            out = out & F.col(f"_b{k}")
        return out

    return points.select("_row.*", F.col("_b0").alias("breaching"),
                         F.when(all_of(0), F.lit("ALARM")).otherwise(F.lit("OK")).alias("state"),
                         (all_of(0) != all_of(1)).alias("changed"))


def _judged(series: DataFrame, threshold: float, period_s: int, eval_periods: int, dims: list[str], value: str,
            missing: str) -> DataFrame:
    """Rows (columns of ``series``, ``_kind``, breaching, state, ``_prior``: the state of the period before).

    Beside the points (``data``) there are rows for the periods without data
    (``silent``) within ``eval_periods`` of a point, where the state can still
    change; further away from data it is what the rule makes of silence.
    Each row tells itself and the ``eval_periods`` periods after it what it
    is, and one aggregation per (dims, period) gathers that.
    """
    whole = list(series.columns)
    breach = F.coalesce(F.col(value) > F.lit(threshold), F.lit(False))
    points = series.withColumn("breaching", breach)
    if missing == "ignore":
        far = F.array("breaching")
        points = points.withColumn("_far", far)
        for _ in range(eval_periods):  # the flags of this point and of those before it, newest first
            points = neighbour(points, dims, "period_start", F.struct("_far"), "_n")
            points = points.withColumn("_far", F.concat(F.array("breaching"), F.coalesce("_n._far", F.array()))).drop("_n")
        alarm = lambda first: F.size(F.filter(F.slice("_far", first, eval_periods), lambda b: b)) == eval_periods
        state = lambda first: F.when(alarm(first), F.lit(ALARM)).otherwise(F.lit(OK))
        return points.select(*whole, F.lit("data").alias("_kind"), "breaching", state(1).alias("state"), state(2).alias("_prior"))
    at = lambda k, c: F.timestamp_add("SECOND", k * F.lit(period_s), F.col(c))
    near = lambda n, sign, c: F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array()), lambda k: at(k * sign, c))
    linked = neighbour(neighbour(points, dims, "period_start", F.struct("period_start"), "_p"), dims, "period_start", F.struct("period_start"), "_q", later=True)
    gap = F.coalesce((F.timestamp_diff("SECOND", F.col("period_start"), F.col("_q.period_start")) / period_s).cast("int") - 1, F.lit(0))
    n = F.least(gap, F.lit(eval_periods))
    linked = linked.withColumn("_next", F.col("_q.period_start"))
    silent = F.transform(F.array_distinct(F.concat(near(n, 1, "period_start"), near(n, -1, "_next"))), lambda t: F.struct(t.alias("t"), F.lit("silent").alias("kind")))
    outside = F.transform(F.when(F.col("_p").isNull(), near(F.lit(eval_periods), -1, "period_start")).otherwise(F.array()),
                          lambda t: F.struct(t.alias("t"), F.lit("outside").alias("kind")))
    quiet = linked.select(*dims, F.explode(F.concat(silent, outside)).alias("_x")).select(
        *dims, F.col("_x.t").alias("period_start"), F.col("_x.kind").alias("_kind"), (F.col("_x.kind") == "silent").alias("_s"))
    quiet = quiet.select(*dims, "period_start", "_kind", (F.col("_s") & F.lit(missing == "breaching")).alias("breaching"))
    rows = points.withColumn("_kind", F.lit("data")).unionByName(quiet, allowMissingColumns=True)
    told = (rows.withColumn("_row", F.struct(*whole)).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(eval_periods))))
            .select(*dims, at(F.col("_k"), "period_start").alias("_period"), "_k", "breaching", "_kind",
                    F.when(F.col("_k") == 0, F.col("_row")).alias("_row")))
    marks = [F.coalesce(F.bool_or(F.when(F.col("_k") == k, F.col("breaching"))), F.lit(missing == "breaching")).alias(f"_b{k}")
             for k in range(eval_periods + 1)]
    kinds = [F.max(F.when(F.col("_k") == k, F.col("_kind"))).alias(f"_kind{k}") for k in (0, 1)]
    met = told.groupBy(*dims, "_period").agg(F.max("_row").alias("_row"), *marks, *kinds).where("_kind0 in ('data', 'silent')")

    def state(first: int) -> Column:
        found = F.lit(True)
        for k in range(first, first + eval_periods):
            found = found & F.col(f"_b{k}")
        found = F.when(found, F.lit(ALARM)).otherwise(F.lit(OK))
        if missing == "missing":  # a period of which nothing is known lies far from data, and is silent
            found = F.when(F.coalesce(f"_kind{first}", F.lit("silent")) == "silent", F.lit(INSUFFICIENT)).otherwise(found)
        return found

    return met.select("_row.*", F.col("_kind0").alias("_kind"), F.col("_b0").alias("breaching"), state(0).alias("state"), state(1).alias("_prior"))


def alarm_transitions(series: DataFrame, threshold: float, period_s: int, eval_periods: int = 1, dims: Sequence[str] = (),
                      value: str = "value", missing: str = "notBreaching") -> DataFrame:
    """Every change of the alarm's state: (dims, period_start, value, previous, state).

    Changes that silence makes are rows too (``value`` null), between the
    first and the last period with data of each series.
    """
    check_rule(missing)
    judged = _judged(series.select(*dims, "period_start", F.col(value).cast("double").alias("value")), threshold, period_s, eval_periods,
                     list(dims), "value", missing)
    return judged.where("state <> _prior").select(*dims, "period_start", "value", F.col("_prior").alias("previous"), "state")


def high_quota_alarm(metrics: DataFrame, threshold: float = 80.0, period_s: int = 300) -> DataFrame:
    """A1: Maximum MonthlyUsagePercent over any user > 80, 5-minute periods."""
    per_user = (metrics.groupBy("user_id", bucket_start(F.col("ts"), period_s).alias("period_start"))
                .agg(F.max("monthly_pct").alias("v")))
    series = per_user.groupBy("period_start").agg(F.max("v").alias("value"))
    return evaluate_alarm(series, threshold, period_s)


def error_alarm(outcomes: DataFrame, threshold: float = 5, period_s: int = 300) -> DataFrame:
    """A2: Sum of errors (status 500) > 5 per 5-minute period."""
    series = (outcomes.groupBy(bucket_start(F.col("ts"), period_s).alias("period_start"))
              .agg(F.count(F.when(F.col("status") == 500, True)).alias("value")))
    return evaluate_alarm(series, threshold, period_s)


def high_token_alarm(inv: DataFrame, threshold: float = 1_000_000, period_s: int = 3600) -> DataFrame:
    """A3: Sum of input tokens > 1,000,000 per hour."""
    series = (inv.groupBy(bucket_start(F.col("ts"), period_s).alias("period_start"))
              .agg(F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("value")))
    return evaluate_alarm(series, threshold, period_s)
