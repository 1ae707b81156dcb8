"""Job states as a stateful stream: what nobody finishes is queued again, what is finished expires.

Events tell the status of a job at a time. Of each job only its last status is kept, in RocksDB. A job that is queued or
running and has no event for the lease is queued again, ATTEMPTS times, then it has failed; a finished job is forgotten
after its time to live. Both follow from event time: a deadline that lies before the job's next event, or that the
watermark has passed, is a transition, so the result does not depend on how events are cut into batches. Events of a
batch are taken in the order of time, then of number; one that is older than the job's last event is left out. Timers and
states are in the checkpoint, from which a stream goes on after a failure."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ATTEMPTS = 3  # times that a job is queued again after an event
ACTIVE = ("queued", "running")
FINISHED = ("completed", "skipped", "failed")

STATE = "status string, at long, number long, attempts int"
TRANSITION = "job_id long, kind string, at long, attempts int"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def transitions(state: tuple | None, before: int, lease: int, live: int) -> tuple[tuple | None, list[tuple[str, int, int]]]:
    """The state after all deadlines before a time, and what happened at each: kind, time and attempts. state: status, at,
    number, attempts; a job that is forgotten has none."""
    out: list[tuple[str, int, int]] = []
    while state is not None:
        status, at, number, attempts = state
        deadline = at + (lease if status in ACTIVE else live)
        if deadline >= before:
            break
        if status not in ACTIVE:
            state = None
            out.append(("expired", deadline, attempts))
        elif attempts < ATTEMPTS:
            state = ("queued", deadline, number, attempts + 1)
            out.append(("requeued", deadline, attempts + 1))
        else:
            state = ("failed", deadline, number, attempts)
            out.append(("failed", deadline, attempts))
    return state, out


class JobStates(StatefulProcessor):
    def __init__(self, lease: int, live: int):
        self.lease, self.live = lease, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)

    def _held(self) -> tuple | None:
        return tuple(self.job.get()) if self.job.exists() else None

    def _keep(self, old: tuple | None, new: tuple | None) -> None:
        """Stores a state with a timer for its next deadline."""
        deadline = lambda s: s[1] + (self.lease if s[0] in ACTIVE else self.live)
        if old is not None and (new is None or deadline(old) != deadline(new)):
            self.handle.deleteTimer(deadline(old))
        if new is None:
            self.job.clear()
            return
        self.job.update(new)
        self.handle.registerTimer(deadline(new))

    def handleInputRows(self, key: Any, rows: Iterable[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        old = state = self._held()
        for r in sorted(rows, key=lambda r: (r["at"], r["number"])):
            if state is not None and (r["at"], r["number"]) <= (state[1], state[2]) and state[3] == 0:
                continue
            state, passed = transitions(state, r["at"], self.lease, self.live)
            yield from (Row(job_id=key[0], kind=k, at=at, attempts=n) for k, at, n in passed)
            state = (r["status"], r["at"], r["number"], 0)
        self._keep(old, state)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        old = self._held()
        state, passed = transitions(old, timerValues.getCurrentWatermarkInMs(), self.lease, self.live)
        yield from (Row(job_id=key[0], kind=k, at=at, attempts=n) for k, at, n in passed)
        if state != old:
            self._keep(None, state)

    def close(self) -> None:
        pass


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """A stream takes the store of its states from the session when it starts."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def watch(events: DataFrame, folder: str, checkpoint: str, lease: int, live: int, delay: str = "0 seconds") -> StreamingQuery:
    """Starts the stream over all that is there now; transitions are appended to a folder, each once. events: job_id long,
    number long, status, ts timestamp; lease and live in milliseconds, delay as of a watermark."""
    rows = events.selectExpr("job_id", "number", "status", "ts", "unix_millis(ts) AS at").withWatermark("ts", delay)
    found = rows.groupBy("job_id").transformWithState(JobStates(lease, live), TRANSITION, "Append", "EventTime")
    with _rocksdb(events.sparkSession):
        return found.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(folder)
