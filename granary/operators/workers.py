"""Workers with state: an object that is loaded once a task and applied row by row, an error row for each failure, retries with new seeds.

A worker is anything with ``check()`` (raises before the first row when it can't be used), ``run(row)`` (a dict of outputs) and
``close()``. Factories are called on the executors; importing one loads no model.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.audio import log_mel
from ..session import ship
from .runs import as_batch

#: Rows whose outputs are held before they are handed on.
HELD = 500


class Worker(Protocol):
    def check(self) -> None: ...

    def run(self, row: dict[str, Any]) -> dict[str, Any]: ...

    def close(self) -> None: ...


class Simple:
    """A worker that is always ready and holds nothing."""

    def check(self) -> None:
        return None

    def close(self) -> None:
        return None


class Unverified(Simple):
    """A generator whose licence nobody has acknowledged: no row is made."""

    def check(self) -> None:
        raise ValueError("the licence is pending and not acknowledged")

    def run(self, row: dict[str, Any]) -> dict[str, Any]:
        raise AssertionError("not reached")


class ConstantDetector(Simple):
    """The same score for every file that is there: for tests of the plumbing, never a detector."""

    def run(self, row: dict[str, Any]) -> dict[str, Any]:
        if not row.get("present"):
            raise FileNotFoundError(str(row.get("path")))
        return {"synthetic_score": 0.5}


class ToneGenerator(Simple):
    """Figures of the fixture tone: as long as asked for."""

    def run(self, row: dict[str, Any]) -> dict[str, Any]:
        return {"duration_sec": row["seconds"], "sample_rate": 16_000}


class HashedDurations(Simple):
    """A generator that makes nothing but a duration of up to 30 s in hundredths, by the digest of its seed."""

    def run(self, row: dict[str, Any]) -> dict[str, Any]:
        share = int(hashlib.sha256(str(row["seed"]).encode()).hexdigest()[:16], 16) / 2**64
        return {"duration_sec": math.floor(share * 3000) / 100}


class LogMel(Simple):
    """Normalised log mel features of ``samples`` at ``rate``, bands one after another."""

    def __init__(self, n_mels: int = 64, n_fft: int = 512, hop: int = 160) -> None:
        self.n_mels, self.n_fft, self.hop = n_mels, n_fft, hop

    def run(self, row: dict[str, Any]) -> dict[str, Any]:
        if not row["samples"]:
            raise ValueError("no samples")
        out = log_mel(np.array(row["samples"], np.float32), row["rate"], self.n_fft, self.hop, self.n_mels)
        return {"bands": out.shape[0], "frames": out.shape[1], "features": out.ravel().tolist()}


class MockTarget(Simple):
    """A demonstration target: ``mock-a`` answers as expected; ``mock-b`` fails on chosen cases, in the answer or in the citation."""

    # What the failing variant says and cites.
    ANSWER = "В документе достаточно оснований, поэтому ответ можно подтвердить."
    WRONG, ELSEWHERE = ("policy-v1", "1.1"), ("policy-v1", "9.9")

    def __init__(self, variant: str, bad_answers: frozenset[str] = frozenset({"VE-003", "VE-007", "VE-010"}), bad_citations: frozenset[str] = frozenset({"VE-005", "VE-012"})) -> None:
        self.fails, self.bad_answers, self.bad_citations = variant == "mock-b", bad_answers, bad_citations

    def run(self, row: dict[str, Any]) -> dict[str, Any]:
        if self.fails and row["case_id"] in self.bad_answers:
            return {"answer": self.ANSWER, "citations": [self._cited(self.WRONG)], "latency_ms": 9}
        cited = [self._cited(self.ELSEWHERE)] if self.fails and row["case_id"] in self.bad_citations else row["expected_citations"]
        return {"answer": row["expected_answer"], "citations": cited, "latency_ms": 8 if self.fails else 5}

    @staticmethod
    def _cited(pair: tuple[str, str]) -> dict[str, str]:
        return {"document_id": pair[0], "section": pair[1]}


class Retrying:
    """Runs a generator until its output isn't a runaway: shorter than ``fraction`` of what ``max_tokens`` could last.

    The k-th attempt (from 0) has the seed (seed + k * stride) modulo 2^64. The outputs carry the seed that took
    effect, the attempt (from 1) and the durations that were rejected; when all attempts are runaways, that is an error.
    """

    def __init__(self, worker: Worker, attempts: int, stride: int, fraction: float = 0.9, token_rate: float = 12.0) -> None:
        if attempts < 1:
            raise ValueError("at least one attempt is needed")
        self.worker, self.attempts, self.stride, self.fraction, self.rate = worker, attempts, stride, fraction, token_rate

    def check(self) -> None:
        self.worker.check()

    def close(self) -> None:
        self.worker.close()

    def run(self, row: dict[str, Any]) -> dict[str, Any]:
        limit = row["max_tokens"] / self.rate * self.fraction
        rejected: list[float] = []
        for k in range(self.attempts):
            seed = (int(row["seed"]) + k * self.stride) % 2**64
            made = self.worker.run({**row, "seed": seed})
            if made["duration_sec"] < limit:
                return {**made, "effective_seed": str(seed), "attempt": k + 1, "rejected": rejected}
            rejected.append(made["duration_sec"])
        raise RuntimeError(f"every attempt ran away ({', '.join(f'{d:.2f}s' for d in rejected)}; max_tokens={row['max_tokens']})")


FACTORIES: dict[str, Callable[..., Worker]] = {"unverified": Unverified, "constant": ConstantDetector, "tone": ToneGenerator, "hashed": HashedDurations, "log_mel": LogMel, "mock": MockTarget}


def factory(name: str) -> Callable[..., Worker]:
    if name not in FACTORIES:
        raise ValueError(f"unknown worker {name!r}; known: {sorted(FACTORIES)}")
    return FACTORIES[name]


def apply_worker(rows: DataFrame, make: Callable[[], Worker], key: str, outputs: str) -> DataFrame:
    """``key``, the ``outputs`` (DDL) and ``error`` of every row; a row that fails has null outputs and ``Type: message``.

    ``make()`` and ``check()`` are called once a task, before its first row; a worker that can't be made or used gives
    each of the task's rows that error. Partitions stay as they are: skewed work is dealt out by whoever calls.
    """
    out = StructType([rows.schema[key], *StructType.fromDDL(outputs), StructField("error", StringType())])
    names, arrow = [f.name for f in StructType.fromDDL(outputs)], to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, broken = None, None
        try:
            for batch in batches:
                if worker is None and broken is None and batch.num_rows:
                    try:
                        worker = make()
                        worker.check()
                    except Exception as e:  # an error row each: that is the contract
                        broken = f"{type(e).__name__}: {e}"
                for at in range(0, batch.num_rows, HELD):
                    done = []
                    for row in batch.slice(at, HELD).to_pylist():
                        made, error = {}, broken
                        if error is None:
                            try:
                                made = worker.run(row)
                            except Exception as e:
                                error = f"{type(e).__name__}: {e}"
                        done.append((row[key], *(made.get(n) for n in names), error))
                    yield as_batch(done, arrow)
        finally:
            if worker is not None:
                worker.close()

    ship(rows.sparkSession)
    return rows.mapInArrow(run, out)
