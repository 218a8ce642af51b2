"""Task states in a stream, with leases that run out by themselves: a timer for each running task puts it back to pending.

tasks.current says the same of a table of events, and tasks.recover_stale of a moment; here no event and no query has to come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from inkgrid.config import Settings
from inkgrid.operators.tasks import KINDS, STATES

STATE = "status string, lease double, updated double, attempts long"
CHANGES = "task_id string, status string, at double, lease_expires_at double, attempt_count bigint, recovered boolean"


class Leases(StatefulProcessor):
    """One task's state: what its last event left, until when its run has a lease, and how often it was claimed."""

    def __init__(self, lease: float):
        self.lease = lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", STATE)

    def _timer(self, lease: float | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if lease is not None:
            self.handle.registerTimer(int(lease * 1000))

    def _row(self, task: str, status: str, at: float, lease: float | None, attempts: int, recovered: bool) -> pd.DataFrame:
        return pd.DataFrame([(task, status, at, lease, attempts, recovered)], columns=[c.split()[0] for c in CHANGES.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = pd.concat(list(rows))
        held = held.assign(turn=held["kind"].map({k: n for n, k in enumerate(KINDS)})).sort_values(["at", "turn"], kind="stable")
        status, lease, updated, attempts = self.state.get() if self.state.exists() else ("pending", None, None, 0)
        for kind, at in zip(held["kind"], held["at"].astype(float)):
            if updated is not None and at < updated:
                continue  # older than what is known of the task
            status, updated = STATES.get(kind, status), at
            lease = at + self.lease if kind in ("claimed", "progress") and status == "running" else None if kind in STATES else lease
            attempts += kind == "claimed"
        self.state.update((status, lease, updated, attempts))
        self._timer(lease if status == "running" else None)
        yield self._row(key[0], status, updated, lease if status == "running" else None, attempts, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, lease, updated, attempts = self.state.get()
        at = expiredTimerInfo.getExpiryTimeInMs() / 1000.0
        if status == "running" and lease is not None and int(lease * 1000) <= at * 1000:
            self.state.update(("pending", None, lease, attempts))
            yield self._row(key[0], "pending", at, None, attempts, True)

    def close(self) -> None:
        pass


def task_changes(events: DataFrame, settings: Settings) -> DataFrame:
    """A stream of a queue's events (task_id, kind, at) as changes of state: one for each task of a batch, and one when a lease has run out.

    Needs the RocksDB state store. Events that are older than the last one known of their task are passed over; a task's events
    of one batch count in the order of tasks.current. A recovered task's `at` is when its lease ended.
    """
    rows = events.select("task_id", "kind", "at").filter("task_id is not null and at is not null")
    return rows.groupBy("task_id").transformWithStateInPandas(Leases(settings.lease), CHANGES, "Update", "ProcessingTime")
