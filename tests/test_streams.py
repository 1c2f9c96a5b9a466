"""Keyed job state over micro-batches and restarts, and workers with state."""

import json
import os
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from granary.operators import workers
from granary.plans import catalogue
from granary.streaming import jobs

EVENTS = "run_id string, job_id string, at timestamp, kind string, seed string, error string"


def event(job, minute, kind, run="r", seed=None, error=None):
    return {"run_id": run, "job_id": job, "at": f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z", "kind": kind, "seed": seed, "error": error}


def replay(spark, tmp_path, batches, split, **options):
    """Runs the batches as one file each, with a restart after ``split`` of them; the changes in order of arrival."""
    source = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    schema = spark.createDataFrame([], EVENTS).schema
    for part in (batches[:split], batches[split:]):
        for batch in part:
            k = len(list((tmp_path / "in").iterdir()))
            file = tmp_path / "in" / f"{k:03d}.json"
            file.write_text("\n".join(map(json.dumps, batch)))
            os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))  # files are taken in order of their times
        found = jobs.changes_now(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source), str(tmp_path / "run"), **options)
    return {(r["run_id"], r["job_id"], r["attempt"], r["status"], r["seed"], r["error"]) for r in found.collect()}


def test_failed_jobs_are_tried_again_with_the_next_seed(spark, tmp_path):
    top = str(2**64 - 1)
    batches = [
        [event("a", 0, "start", seed=top), event("b", 0, "start", seed="5"), event("c", 1, "start", seed="7")],
        [event("a", 2, "failed", error="x"), event("b", 3, "done"), event("b", 3, "done"), event("z", 3, "done")],
        [event("a", 4, "start"), event("a", 5, "failed", error="y"), event("b", 5, "failed", error="late")],
        [event("a", 6, "start"), event("a", 7, "failed", error="z"), event("a", 8, "start"), event("c", 8, "done")],
    ]
    found = replay(spark, tmp_path, batches, 2, policy="continue", attempts=3, stride=2, timeout=0)
    assert found == {
        ("r", "a", 1, "running", top, None), ("r", "a", 2, "retry", "1", "x"), ("r", "a", 2, "running", "1", None), ("r", "a", 3, "retry", "3", "y"), ("r", "a", 3, "running", "3", None), ("r", "a", 3, "failed", "3", "z"),
        ("r", "b", 1, "running", "5", None), ("r", "b", 1, "completed", "5", None), ("r", "c", 1, "running", "7", None), ("r", "c", 1, "completed", "7", None),
    }


def test_a_failure_stops_what_starts_later_in_its_run(spark, tmp_path):
    batches = [
        [event("a", 0, "start", seed="1"), event("b", 1, "start", seed="1"), event("a", 0, "start", run="other", seed="1")],
        [event("a", 2, "failed", error="x")],
        [event("c", 3, "start", seed="1"), event("b", 4, "done"), event("d", 5, "start", run="other", seed="1")],
        [event("c", 6, "done")],
    ]
    found = replay(spark, tmp_path, batches, 2, policy="stop", attempts=1, timeout=0)
    assert found == {
        ("r", "a", 1, "running", "1", None), ("r", "b", 1, "running", "1", None), ("other", "a", 1, "running", "1", None), ("r", "a", 1, "failed", "1", "x"),
        ("r", "c", 1, "stopped", "1", None), ("r", "b", 1, "completed", "1", None), ("other", "d", 1, "running", "1", None),
    }


def test_stuck_jobs_fail_by_event_time(spark, tmp_path):
    batches = [
        [event("stuck", 0, "start", seed="1"), event("fine", 0, "start", seed="1")],
        [event("fine", 20, "done"), event("clock", 30, "start", seed="9")],
        [event("clock", 200, "done")],
        [event("clock2", 400, "start", seed="1")],
        [event("clock3", 401, "start", seed="1")],
    ]
    found = replay(spark, tmp_path, batches, 3, policy="continue", attempts=1, timeout=3600, delay="1 minute")
    assert ("r", "stuck", 1, "failed", "1", "stuck") in found and ("r", "fine", 1, "completed", "1", None) in found
    assert not [f for f in found if f[1] == "fine" and f[3] == "failed"]


def test_policies_and_attempts_are_checked():
    for wrong in ({"policy": "other"}, {"attempts": 0}):
        with pytest.raises(ValueError):
            jobs.Jobs(**{"policy": "stop", "attempts": 1, "stride": 1, "timeout": 0, **wrong})


def test_the_state_store_is_asked_once_a_job():
    calls = []

    class Store(dict):
        def exists(self):
            calls.append("exists")
            return bool(self)

        def getValue(self, key):
            calls.append("get")
            return self.get(key)

        def updateValue(self, key, value):
            calls.append("update")
            self[key] = value

        def update(self, value):
            calls.append("halt")
            self["at"] = value

    class Handle:
        getMapState = getValueState = staticmethod(lambda *_: Store())

    row = lambda k, ms, kind, error=None: Row(run_id="r", job_id=str(k), ms=ms, kind=kind, seed="1", error=error)
    run = jobs.Jobs("stop", 1, 1, 0)
    run.init(Handle())
    found = list(run.handleInputRows(("r",), iter([row(k, 10 * k + d, kind) for k in range(100) for d, kind in ((5, "done"), (0, "start"))]), None))
    assert len(found) == 200 and calls.count("update") == 100 and len(calls) == 101
    calls.clear()
    found = list(run.handleInputRows(("r",), iter([row(7, 2000, "done"), row("x", 2001, "start"), row("x", 2002, "failed", "e"), row("y", 2003, "start")]), None))
    assert [tuple(f) for f in found] == [("r", "x", 1, "running", "1", 2001, None), ("r", "x", 1, "failed", "1", 2002, "e"), ("r", "y", 1, "stopped", "1", 2003, None)]
    assert sorted(calls) == ["exists"] * 2 + ["get"] * 3 + ["halt"] + ["update"] * 2


def test_stream_over_conversations(spark):
    folder = "/root/testdata/sf0.001"
    found = {(r["run_id"], r["job_id"], r["status"], r["seed"], r["error"]) for r in catalogue.QUERIES["job_state_stream"](spark, folder).collect()}
    want, runs = set(), {}
    for r in pq.read_table(f"{folder}/conversations.parquet").to_pylist():
        runs.setdefault(r["conv_id"], set()).add(r["turn"])
    for run, turns in runs.items():
        halted = False
        for t in sorted(turns):
            own = (str(run), str(t))
            failed = zlib.crc32(f"{run}:{t}".encode()) % 7 == 0
            want |= {(*own, "stopped", str(run * 100 + t), None)} if halted else {(*own, "running", str(run * 100 + t), None), (*own, "failed" if failed else "completed", str(run * 100 + t), "checksum" if failed else None)}
            halted |= failed
    assert found == want and any(w[2] == "stopped" for w in want)


def test_exported_lines_are_numbered_in_order(spark):
    folder = "/root/testdata/sf0.001"
    found = sorted((r["doc_id"], r["ordinal"]) for r in catalogue.QUERIES["exported_line_numbers"](spark, folder).collect())
    assert found == [(i, k) for k, i in enumerate(sorted(pq.read_table(f"{folder}/documents.parquet", columns=["doc_id"])["doc_id"].to_pylist()))]


# --- workers


def test_a_worker_is_made_once_a_task_and_failures_are_rows(spark):
    class Counting(workers.Simple):
        """Counts its rows; fails on negative ones."""

        seen = 0

        def run(self, row):
            self.seen += 1
            if row["x"] < 0:
                raise KeyError("negative")
            return {"y": row["x"] * 2, "seen": self.seen}

    rows = spark.range(0, 40, 1, 2).select("id", F.when(F.col("id") == 7, -1).otherwise(F.col("id")).alias("x"))
    got = workers.apply_worker(rows, Counting, "id", "y long, seen int").collect()
    assert len(got) == 40 and max(r["seen"] or 0 for r in got) == 20  # one object for the 20 rows of a task
    assert [(r["id"], r["y"], r["error"]) for r in got if r["error"]] == [(7, None, "KeyError: 'negative'")]
    assert workers.apply_worker(rows.limit(0), Counting, "id", "y long, seen int").count() == 0


def test_unusable_and_fixture_workers(spark):
    rows = spark.createDataFrame([(1, "a.wav", True), (2, "b.wav", False)], "id int, path string, present boolean")
    held = workers.apply_worker(rows, workers.factory("unverified"), "id", "duration_sec double").collect()
    assert {r["error"] for r in held} == {"ValueError: the licence is pending and not acknowledged"}
    scores = {r["id"]: (r["synthetic_score"], r["error"]) for r in workers.apply_worker(rows, workers.factory("constant"), "id", "synthetic_score double").collect()}
    assert scores == {1: (0.5, None), 2: (None, "FileNotFoundError: b.wav")}
    with pytest.raises(ValueError, match="unknown worker"):
        workers.factory("other")


def test_mock_targets():
    case = {"case_id": "VE-003", "expected_answer": "yes", "expected_citations": [{"document_id": "d", "section": "1"}]}
    good, bad = workers.MockTarget("mock-a"), workers.MockTarget("mock-b")
    assert good.run(case) == {"answer": "yes", "citations": case["expected_citations"], "latency_ms": 5}
    assert bad.run(case)["citations"] == [{"document_id": "policy-v1", "section": "1.1"}] and bad.run(case)["latency_ms"] == 9
    assert bad.run({**case, "case_id": "VE-012"}) == {"answer": "yes", "citations": [{"document_id": "policy-v1", "section": "9.9"}], "latency_ms": 8}
    assert bad.run({**case, "case_id": "VE-001"}) == {**good.run(case), "latency_ms": 8}


class Long(workers.Simple):
    """As long as a table says for the seed."""

    def __init__(self, durations):
        self.durations, self.closed = durations, False

    def run(self, row):
        return {"duration_sec": self.durations[row["seed"]]}

    def close(self):
        self.closed = True


def test_runaways_are_tried_again():
    row = {"seed": 2**64 - 1, "max_tokens": 120}  # ten seconds at 12 tokens a second: nine are too many
    worker = workers.Retrying(Long({2**64 - 1: 9.0, 1: 8.99, 3: 1.0}), attempts=3, stride=2)
    assert worker.run(row) == {"duration_sec": 8.99, "effective_seed": "1", "attempt": 2, "rejected": [9.0]}
    with pytest.raises(RuntimeError, match=r"every attempt ran away \(9.00s, 10.00s; max_tokens=120\)"):
        workers.Retrying(Long({2**64 - 1: 9.0, 1: 10.0}), attempts=2, stride=2).run(row)
    with pytest.raises(ValueError):
        workers.Retrying(Long({}), attempts=0, stride=1)
    worker.close()
    assert worker.worker.closed
