"""Jobs as keyed state in a stream: attempts, retry seeds, failure policy and timers for stuck ones, over micro-batches and restarts.

The stream has one row per event: ``run_id, job_id, at`` (timestamp), ``kind`` (start, done or failed), ``seed`` (of the plan, decimal
text; on start) and ``error``. The result has one row per change of a job: ``run_id, job_id, attempt, status, seed, at,
error`` with status running, completed, retry (a new attempt with the next seed is due), failed or stopped.

Policy ``continue``: state is kept by job, so a run of any size is spread over all tasks. Policy ``stop``: the first failure
of a run stops what starts after it, which is an order over the run's jobs by definition; state is kept by run, one
entry a job, and a run is worked on by one task. Events of a key are taken in order of ``at`` within a micro-batch
(ties: start, failed, done); an event of a job that is finished, stopped or unknown changes nothing, so events that are delivered twice do no harm.
A running job that nothing is heard of for ``timeout`` seconds of event time (by the watermark) has failed with
``stuck``, as if that event had come.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship

STATE = "attempt int, status string, seed string, heard long"
CHANGES = "run_id string, job_id string, attempt int, status string, seed string, at timestamp, error string"
CHANGE = Row("run_id", "job_id", "attempt", "status", "seed", "ms", "error")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OPEN = ("running", "retry")
ORDER = {"start": 0, "failed": 1, "done": 2}


class Jobs(StatefulProcessor):
    def __init__(self, policy: str, attempts: int, stride: int, timeout: float) -> None:
        if policy not in ("continue", "stop") or attempts < 1:
            raise ValueError("policy is continue or stop, and at least one attempt is needed")
        self.policy, self.attempts, self.stride, self.timeout = policy, attempts, stride, int(timeout * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "job_id string", STATE)
        self.halted = handle.getValueState("halted", "at long")

    def _begin(self) -> None:
        """What is known of the key within one call. Each look into the store is a message to the JVM and back: one for each job that is heard of, none for new keys, and one for each job that changes."""
        self.new, self.is_halted, self.due = not self.jobs.exists(), None, None
        self.known: dict[str, tuple | None] = {}
        self.changed: set[str] = set()

    def _end(self) -> None:
        for job_id in self.changed:
            self.jobs.updateValue((job_id,), self.known[job_id])

    def _halted(self) -> bool:
        if self.is_halted is None:
            self.is_halted = not self.new and self.halted.exists()
        return self.is_halted

    def _change(self, run_id: str, job_id: str, at: int, kind: str, seed: str | None, error: str | None) -> tuple | None:
        """Applies one event (``at`` in ms); the change of the job, if there is one."""
        if job_id not in self.known:
            found = None if self.new else self.jobs.getValue((job_id,))
            self.known[job_id] = found and tuple(found)
        known = self.known[job_id]
        if kind == "start":
            if known is not None and known[1] != "retry":
                return None
            attempt, own = (1, seed) if known is None else (known[0], known[2])
            status = "stopped" if known is None and self._halted() else "running"
        elif known is None or known[1] not in OPEN:
            return None
        elif kind == "done":
            attempt, status, own = known[0], "completed", known[2]
        else:
            more = known[0] < self.attempts
            attempt, status = known[0] + more, "retry" if more else "failed"
            own = str((int(known[2]) + self.stride) % 2**64) if more and known[2] is not None else known[2]
            if not more and self.policy == "stop" and not self._halted():
                self.halted.update((at,))
                self.is_halted = True
        self.known[job_id] = (attempt, status, own, at)
        self.changed.add(job_id)
        if status in OPEN and self.timeout:
            if self.due is None:
                self.due = set(self.handle.listTimers())
            if at + self.timeout not in self.due:
                self.handle.registerTimer(at + self.timeout)
                self.due.add(at + self.timeout)
        return run_id, job_id, attempt, status, own, at, error

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # a key's rows of one micro-batch; bounded by the trigger
        events = sorted(((r.ms, ORDER[r.kind], r.job_id, r.run_id, r.kind, r.seed, r.error) for r in rows), key=lambda e: e[:3])
        self._begin()
        for at, _, job_id, run_id, kind, seed, error in events:
            if change := self._change(run_id, job_id, at, kind, seed, error):
                yield CHANGE(*change)
        self._end()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        stuck = [(k[0], v) for k, v in self.jobs.iterator() if v[1] == "running" and v[3] + self.timeout <= due]
        self._begin()
        for job_id, _ in sorted(stuck):
            if change := self._change(key[0], job_id, due, "failed", None, "stuck"):
                yield CHANGE(*change)
        self._end()

    def close(self) -> None:
        return None


def job_changes(events: DataFrame, *, policy: str = "continue", attempts: int = 3, stride: int = 1, timeout: float = 3600, delay: str = "10 minutes") -> DataFrame:
    """The changes of the jobs of a stream of events; ``delay`` is the watermark's."""
    ship(events.sparkSession)
    keys = ["run_id", "job_id"] if policy == "continue" else ["run_id"]
    marked = events.select("run_id", "job_id", "at", F.unix_millis("at").alias("ms"), "kind", "seed", "error").withWatermark("at", delay)
    # rows, not pandas: most keys have few of them
    changes = marked.groupBy(*keys).transformWithState(Jobs(policy, attempts, stride, timeout), CHANGES.replace("at timestamp", "ms long"), "append", "EventTime")
    return changes.select("run_id", "job_id", "attempt", "status", "seed", F.timestamp_millis("ms").alias("at"), "error")


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """State with timers needs the RocksDB store: chosen for the streams that start in the block, unless the session has another than Spark's default."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    if before.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def changes_now(events: DataFrame, folder: str, **options) -> DataFrame:
    """Runs ``job_changes`` over what the stream has now; the changes so far, of this and earlier runs in the same ``folder`` (of checkpoint and output)."""
    spark = events.sparkSession
    with state_store(spark):
        stream = job_changes(events, **options).writeStream.format("parquet").outputMode("append")
        query = stream.option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(CHANGES).parquet(f"{folder}/changes")
