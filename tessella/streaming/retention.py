"""Expiry of jobs in the stream: event-time timers on keyed state.

A job that was submitted and never taken up fails at the end of its retention. The result of
a settled job expires a retention after it settled, and its state goes after the state's retention; a
later submission under its id starts anew. What runs is never expired. A retention of 0 is endless.

Deadlines hold in event time: before an event counts, whatever fell due before it is applied, so the
outcome does not depend on how events come in batches. Timers do the same for jobs that no
event reaches any more, when the watermark passes their deadline.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "job string, what string, at long"
STATE = "status string, since long"
ABANDONED = "SUBMISSION_EXPIRED"


def due(status: str, since: int, result: int, state: int) -> int | None:
    """When, in milliseconds, a job's next deadline is."""
    if status in ("queued", "succeeded", "failed"):
        return since + result if result else None
    return since + state if status == "expired" and state else None


def advanced(status: str, since: int, now: int, result: int, state: int) -> tuple[str, int, list[tuple[str, int]]]:
    """The state at ``now`` and what fell due until then."""
    told = []
    while (at := due(status, since, result, state)) is not None and at <= now:
        if status == "queued":
            status, since, what = "failed", at, ABANDONED
        elif status == "expired":
            status, what = "new", "gone"
        else:
            status, what = "expired", "expired"
        told.append((what, at))
    return status, since, told


class Retention(StatefulProcessor):
    def __init__(self, result: int, state: int):
        self.result, self.keep = result, state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", STATE)

    def _held(self) -> tuple[str, int]:
        return self.state.get() if self.state.exists() else ("new", 0)

    def _keep(self, status: str, since: int) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if status == "new":
            self.state.clear()
            return
        self.state.update((status, since))
        if (at := due(status, since, self.result, self.keep)) is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, since = self._held()
        told: list[tuple[str, int]] = []
        for e in pd.concat(list(rows)).sort_values(["ms", "seq"], kind="stable").itertuples(index=False):
            status, since, fell = advanced(status, since, e.ms, self.result, self.keep)
            told += fell
            if e.kind == "submitted" and status == "new":
                status, since = "queued", e.ms
            elif e.kind == "running" and status == "queued":
                status, since = "running", e.ms
            elif e.kind in ("succeeded", "failed") and status in ("queued", "running"):
                status, since = e.kind, e.ms
                told.append((e.kind, e.ms))
        self._keep(status, since)
        yield pd.DataFrame([(key[0], *x) for x in told], columns=["job", "what", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, since, told = advanced(*self._held(), timerValues.getCurrentWatermarkInMs(), self.result, self.keep)
        self._keep(status, since)
        yield pd.DataFrame([(key[0], *x) for x in told], columns=["job", "what", "at"])

    def close(self) -> None:
        pass


def expiring(events: DataFrame, result_ms: int, state_ms: int, late: str = "0 seconds") -> DataFrame:
    """events: a stream of job, seq, kind, ts. job, what (succeeded, failed, SUBMISSION_EXPIRED, expired,
    gone) and at (milliseconds), a row for each step of each job. Events older than the watermark are dropped."""
    rows = events.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return rows.groupBy("job").transformWithStateInPandas(Retention(result_ms, state_ms), outputStructType=OUT, outputMode="append", timeMode="eventTime")
