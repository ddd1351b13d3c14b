"""Sustained alerts on a stream: pending, firing, resolved, cleared.

Requests are rolled up into one-minute steps (a watermarked aggregate, combined in
every task, emitted once the watermark has passed the minute); each step then meets
the state of its alert in ``transformWithState``.  That state is one run of breached
minutes per alert and series, whatever the number of requests:

* ``pending``  the first breached minute of a run;
* ``firing``   the run has lasted as many minutes as the rule asks for;
* ``resolved`` a firing run has ended, ``cleared`` a run ended before it fired.

A run ends with a minute that is not breached, or with a minute without requests: an
event-time timer ends it once the watermark has passed the minute after its last.
Requests may come in any order within the watermark's delay; later ones are dropped
by the roll-up.  Minutes that the watermark has not passed are not judged yet.

Null ``ts`` and null series: a request without a time is in no minute; a null series
is a series.  A null condition (no requests counted) is not a breach.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The processor runs in Python workers, which may not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEP_MS = 60_000
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Rule(NamedTuple):
    """``breached`` is a condition on a step's columns ``err``, ``p95`` and ``n``."""

    alert: str
    breached: Column
    minutes: int


def default_rules(error_threshold: float = 0.1, error_minutes: int = 5, p95_threshold: float = 2.0,
                  p95_minutes: int = 5) -> list[Rule]:
    return [Rule("HighErrorRate", F.col("err") > error_threshold, error_minutes),
            Rule("SlowResponses", F.col("p95") > p95_threshold, p95_minutes)]


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of the same context whose streams keep state in RocksDB, as timers need; ``spark`` stays as it is."""
    own = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled",
                 "spark.sql.adaptive.enabled"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    return own


class AlertRun(StatefulProcessor):
    """One alert of one series: its open run of breached minutes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "first long, last long, steps long, minutes long")

    def _row(self, key: tuple, state: str, first: int, at: int, steps: int) -> tuple:
        return (*key, state, first, at, steps)

    def _ended(self, key: tuple, run: tuple) -> tuple:
        first, last, steps, minutes = run
        return self._row(key, "resolved" if steps >= minutes else "cleared", first, last + STEP_MS, steps)

    def _keep(self, run: tuple | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if run is None:
            self.run.clear()
            return
        self.run.update(run)
        # the minute after the last one is complete at last + 2 steps; a timer is due once the watermark is beyond it
        self.handle.registerTimer(run[1] + 2 * STEP_MS - 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        run = tuple(int(x) for x in self.run.get()) if self.run.exists() else None
        steps = pd.concat(list(rows)).sort_values("step_ms")  # one row per minute of this batch
        out = []
        for step, breached, minutes in zip(steps["step_ms"], steps["breached"], steps["minutes"]):
            step, minutes = int(step), int(minutes)
            if run is not None and (not breached or step != run[1] + STEP_MS):
                out.append(self._ended(key, run))
                run = None
            if not breached:
                continue
            run = (step, step, 1, minutes) if run is None else (run[0], step, run[2] + 1, minutes)
            if run[2] == 1:
                out.append(self._row(key, "pending", run[0], step + STEP_MS, 1))
            if run[2] == minutes:
                out.append(self._row(key, "firing", run[0], step + STEP_MS, run[2]))
        self._keep(run)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.run.exists():
            run = tuple(int(x) for x in self.run.get())
            if timerValues.getCurrentWatermarkInMs() >= run[1] + 2 * STEP_MS:
                out.append(self._ended(key, run))
                self.run.clear()
            else:
                self._keep(run)
        yield self._frame(key, out)

    def _frame(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        names = [f"key{i}" for i in range(len(key))]
        return pd.DataFrame(rows, columns=[*names, "state", "first_ms", "at_ms", "steps"])

    def close(self) -> None:
        pass


def minute_steps(ev: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(minute, series...): requests, share of errors and 95th percentile of the latency."""
    return ev.groupBy(F.window("ts", "1 minute").alias("w"), *by).agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.count_if("is_error").cast("double"), F.count(F.lit(1)).cast("double")).alias("err"),
        F.percentile("latency", F.lit(0.95)).alias("p95"))


def alert_changes(ev: DataFrame, rules: Sequence[Rule] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Streamed (alert, series..., state, start, at, steps): a row for each change of an alert's state.

    ``ev`` is a stream with a watermark on ``ts``, of a session with RocksDB state
    (:func:`stateful_session`); write the result in append mode.  ``by`` names string
    columns that split an alert into series (an endpoint, a host).
    """
    rules = default_rules() if rules is None else list(rules)
    each = F.explode(F.array(*[
        F.struct(F.lit(r.alert).alias("alert"), F.coalesce(r.breached, F.lit(False)).alias("breached"),
                 F.lit(r.minutes).cast("long").alias("minutes")) for r in rules]))
    steps = minute_steps(ev, by).select(
        F.window_time("w").alias("event_time"), F.unix_millis("w.start").alias("step_ms"), *by, each.alias("r")).select(
        "event_time", "step_ms", *by, "r.alert", "r.breached", "r.minutes")
    keys = ["alert", *by]
    schema = ", ".join([*(f"key{i} string" for i in range(len(keys))), "state string, first_ms long, at_ms long, steps long"])
    found = steps.groupBy(*keys).transformWithStateInPandas(
        AlertRun(), outputStructType=schema, outputMode="append", timeMode="eventTime")
    return found.select(*[F.col(f"key{i}").alias(k) for i, k in enumerate(keys)], "state",
                        F.timestamp_millis("first_ms").alias("start"), F.timestamp_millis("at_ms").alias("at"), "steps")
