"""T3 stream_alerts: every change of an alarm's state, emitted once, by a timer where silence is the cause."""

from __future__ import annotations

import datetime as dt
import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quotalake.functions.timecols import bucket_start
from quotalake.operators.alarms import ALARM, INSUFFICIENT, OK, check_rule
from quotalake.streaming.metrics import ARRIVAL, EPOCH, _ms, combined, keep_state_on_disk


CHANGES = "period_start timestamp_ntz, value double, previous string, state string"


class _Alarm(StatefulProcessor):
    """Open periods and state of one series; a period is judged once the clock has passed its end."""

    def __init__(self, dims: Sequence[str], how: str, threshold: float, period_s: int, eval_periods: int, missing: str):
        self.dims, self.how, self.threshold, self.step = list(dims), how, threshold, period_s * 1000
        self.eval_periods, self.missing = eval_periods, missing

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("alarm", "series binary")

    def _load(self) -> dict:
        if self.state.exists():
            return pickle.loads(self.state.get()[0])
        return {"open": {}, "next": None, "run": 0, "state": OK, "timer": None}

    def _judge(self, had: dict, value) -> str:
        """State after one more period; ``value`` None: a period without data.  ``run`` is the breaching periods in a row."""
        if value is None and self.missing == "ignore":
            return had["state"]
        breaching = self.missing == "breaching" if value is None else value > self.threshold
        had["run"] = min(self.eval_periods, had["run"] + 1) if breaching else 0
        if value is None and self.missing == "missing":
            return INSUFFICIENT
        return ALARM if had["run"] >= self.eval_periods else OK

    def _advance(self, key, had: dict, now: int) -> Iterator[pd.DataFrame]:
        """Judge all periods that ended by ``now``; rows for the changes."""
        rows = []
        if had["next"] is None and had["open"]:
            had["next"] = min(had["open"])
        while had["next"] is not None and had["next"] + self.step <= now:
            at = had["next"]
            value = had["open"].pop(at, None)
            state = self._judge(had, value)
            if state != had["state"]:
                rows.append([*key[:len(self.dims)], EPOCH + dt.timedelta(milliseconds=at), None if value is None else float(value), had["state"], state])
                had["state"] = state
            silent_for_long = value is None and min(had["open"], default=now) > at + self.eval_periods * self.step
            if silent_for_long and not self._restless(had):  # nothing changes before the next data
                had["next"] = min(min(had["open"], default=now), now - now % self.step)
            else:
                had["next"] = at + self.step
        if rows:
            yield pd.DataFrame(rows, columns=[*self.dims, "period_start", "value", "previous", "state"])

    def _restless(self, had: dict) -> bool:
        """Whether silence would still change the state or the run."""
        return {"ignore": False, "notBreaching": had["run"] > 0 or had["state"] != OK, "breaching": had["run"] < self.eval_periods,
                "missing": had["run"] > 0 or had["state"] != INSUFFICIENT}[self.missing]

    def _wait(self, had: dict) -> None:
        """A timer at the end of the next period to judge, if there is data or silence would change something."""
        end = None
        if had["open"] or (had["next"] is not None and self._restless(had)):
            end = self.step + (min(had["open"]) if had["next"] is None else had["next"])
        if end != had["timer"]:
            if had["timer"] is not None:
                self.handle.deleteTimer(had["timer"])
            if end is not None:
                self.handle.registerTimer(end)
            had["timer"] = end

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        had, seen, now = self._load(), False, timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if pd.isna(r.period_start):  # a tick of the clock
                    continue
                start, seen = _ms(r.period_start), True
                if start + self.step <= now or (had["next"] is not None and start < had["next"]):  # too late
                    continue
                value = int(r.added) if self.how == "sum" else float(r.most)
                if start in had["open"]:
                    value = had["open"][start] + value if self.how == "sum" else max(had["open"][start], value)
                had["open"][start] = value
        if not seen:
            return
        yield from self._advance(key, had, now)
        self._wait(had)
        self.state.update((pickle.dumps(had),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        had = self._load()
        had["timer"] = None
        yield from self._advance(key, had, timerValues.getCurrentWatermarkInMs())
        self._wait(had)
        self.state.update((pickle.dumps(had),))

    def close(self) -> None:
        pass


def stream_alerts(stream: DataFrame, value: Column, how: str, threshold: float, period_s: int, root: str, checkpoint: str,
                  eval_periods: int = 1, missing: str = "notBreaching", dims: Sequence[str] = (), arrived: str | None = None,
                  delay: str = "10 minutes"):
    """(dims, period_start, value, previous, state) for every change of the alarm (A0); returns the writer.

    The series is the ``sum`` (whole numbers) or ``max`` of ``value`` per
    period, combined in the tasks that read it.  A period is judged once, when
    the clock of arrival (the column ``arrived``, else the time of the
    micro-batch) is ``delay`` past its end; rows that come later than that do
    not change what was reported.  Silence counts by ``missing`` as in
    ``evaluate_alarm``, and a timer reports the change it makes (``value``
    null) without waiting for data.  A row without a time moves the clock.
    """
    keep_state_on_disk(stream.sparkSession)
    if how not in ("sum", "max"):
        raise ValueError("how is 'sum' or 'max'")
    check_rule(missing)
    clock = (F.col(arrived) if arrived else F.current_timestamp()).cast("timestamp")
    series = list(dims) or ["series"]
    rows = stream if dims else stream.withColumn("series", F.lit("all"))
    rows = rows.select(*series, bucket_start(F.col("ts"), period_s).alias("period_start"),
                       (value.cast("double") if how == "max" else F.lit(0.0)).alias("most"),
                       (F.coalesce(value.cast("bigint"), F.lit(0)) if how == "sum" else F.lit(0).cast("long")).alias("added"), clock.alias(ARRIVAL))
    if how == "max":
        rows = rows.where("most is not null or period_start is null")
    parts = combined(rows, [*series, "period_start"], ["added"], delay, ["most"])
    types = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    out = ", ".join([*[f"`{d}` {types[d]}" for d in series], "period_start timestamp_ntz", "value double", "previous string", "state string"])
    found = parts.groupBy(*series).transformWithStateInPandas(
        _Alarm(series, how, threshold, period_s, eval_periods, missing), out, "append", "eventTime")
    found = found if dims else found.drop("series")
    return (found.writeStream.format("parquet").option("path", root).option("checkpointLocation", checkpoint).outputMode("append"))
