"""The task state machine as a stateful streaming operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from pactspark.packs.fixed import STALE_DETAIL, TRANSITIONS

EDGES = frozenset(TRANSITIONS)

OUTPUT = StructType([
    StructField("task_id", LongType()), StructField("event_id", LongType()), StructField("from_status", StringType()),
    StructField("to_status", StringType()), StructField("outcome", StringType()), StructField("version", LongType()),
    StructField("detail", StringType()), StructField("at", TimestampType()),
])
STATE = StructType([
    StructField("status", StringType()), StructField("version", LongType()), StructField("timer", LongType()),
])


class TaskStateMachine(StatefulProcessor):
    """Current status and version per task.

    Events are applied in id order within a micro-batch and checked against the
    state at arrival. Rejected events are emitted with their reason and change
    nothing. A task that sits in parsing or reviewing for longer than ``stale_ms``
    of event time is blocked by a timer.
    """

    def __init__(self, stale_ms: int = 0):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", STATE)

    def _read(self) -> tuple[str, int, int]:
        return tuple(self.state.get()) if self.state.exists() else ("pending", 0, 0)

    def _arm(self, status: str, timer: int, now: int) -> int:
        if not self.stale_ms:
            return 0
        if timer:
            self.handle.deleteTimer(timer)
        due = now + self.stale_ms if status in ("parsing", "reviewing") else 0
        if due:
            self.handle.registerTimer(due)
        return due

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, version, timer = self._read()
        batch = pd.concat(list(rows)).sort_values("event_id")
        out = []
        for row in batch.itertuples(index=False):
            expected = getattr(row, "expected_version", None)
            source = status
            if (status, row.to_status) not in EDGES:
                outcome = "invalid_transition"
            elif expected is not None and not pd.isna(expected) and int(expected) != version:
                outcome = "version_conflict"
            else:
                outcome, status, version = "accepted", row.to_status, version + 1
                timer = self._arm(status, timer, int(row.created_at.timestamp() * 1000))
            out.append((key[0], row.event_id, source, row.to_status, outcome, version, None, row.created_at))
        self.state.update((status, version, timer))
        yield pd.DataFrame(out, columns=OUTPUT.fieldNames())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, version, _ = self._read()
        if status in ("parsing", "reviewing"):
            self.state.update(("blocked", version + 1, 0))
            at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
            row = (key[0], None, status, "blocked", "timeout", version + 1, STALE_DETAIL, at)
            yield pd.DataFrame([row], columns=OUTPUT.fieldNames()).astype({"event_id": "Int64"})

    def close(self) -> None:
        pass


class ProgressState(StatefulProcessor):
    """Newest progress per task; it expires when nothing is reported for a while."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = StructType([StructField("parsed_pages", LongType()), StructField("total_pages", LongType())])
        self.state = handle.getValueState("progress", fields, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = pd.concat(list(rows)).sort_values("event_id").iloc[-1]
        parsed = min(int(last.parsed_pages), int(last.total_pages))
        self.state.update((parsed, int(last.total_pages)))
        yield pd.DataFrame([(key[0], parsed, int(last.total_pages))], columns=["task_id", "parsed_pages", "total_pages"])

    def close(self) -> None:
        pass


def run_state_machine(events: DataFrame, *, stale_seconds: int = 0, delay: str = "10 minutes") -> DataFrame:
    """Apply the machine to a stream (task_id, event_id, to_status, created_at, …)."""
    timed = bool(stale_seconds)
    source = events.withColumn("created_at", F.col("created_at").cast("timestamp"))
    source = source.withWatermark("created_at", delay) if timed else source
    return source.groupBy("task_id").transformWithStateInPandas(
        TaskStateMachine(stale_seconds * 1000), OUTPUT, "Append", "EventTime" if timed else "None")


def run_progress(events: DataFrame, ttl_seconds: int) -> DataFrame:
    schema = StructType([StructField(n, LongType()) for n in ("task_id", "parsed_pages", "total_pages")])
    return events.groupBy("task_id").transformWithStateInPandas(
        ProgressState(ttl_seconds * 1000), schema, "Update", "ProcessingTime")
