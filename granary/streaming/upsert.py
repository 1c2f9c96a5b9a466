"""Resumable results: a keyed store of Parquet versions, a stream that upserts into it, and a store of runs."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import result_json
from ..session import file_system

NAME = re.compile(r"v(\d+)")
BATCH = re.compile(r"(.*)-(\d+)")


class ResultStore:
    """Versions ``v<N>`` of a table keyed by ``key``. A version counts once it is complete (its _SUCCESS is written).

    Beside each version, ``applied/v<N>.json`` names the streams that have written so far, with the last batch of each: a
    batch that is run again is known whatever else was written between. The last ``keep`` versions stay for
    readers, others are deleted, so an upsert lists ``keep`` folders, however many batches there were.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, keep: int = 3) -> None:
        self.spark, self.path, self.key, self.schema, self.keep = spark, path.rstrip("/"), key, schema, max(1, keep)

    def _versions(self) -> list[int]:
        """The complete versions that are kept."""
        root, fs = file_system(self.spark, self.path)
        if not fs.exists(root):
            return []
        found = (NAME.fullmatch(x.getPath().getName()) for x in fs.listStatus(root))
        return sorted(int(m[1]) for m in found if m and fs.exists(file_system(self.spark, f"{self.path}/{m[0]}/_SUCCESS")[0]))

    def _applied(self, version: int) -> dict[str, int]:
        at, fs = file_system(self.spark, f"{self.path}/applied/v{version}.json")
        if not fs.exists(at):
            return {}
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _note(self, version: int, applied: dict[str, int]) -> None:
        at, fs = file_system(self.spark, f"{self.path}/applied/v{version}.json")
        stream = fs.create(at, True)
        try:
            stream.write(bytearray(json.dumps(applied, sort_keys=True).encode()))
        finally:
            stream.close()

    def read(self) -> DataFrame:
        found = self._versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{found[-1]}") if found else self.spark.createDataFrame([], self.schema)

    def upsert(self, new: DataFrame, batch: str | None = None, order: str | None = None) -> None:
        """New rows replace rows of their key. Of rows of one key within ``new`` the last by ``order`` stays; without it they are an error.

        ``batch`` is ``<stream>-<number>``, with numbers that grow; up to the last one that was written, nothing happens.
        """
        found = self._versions()
        applied = self._applied(found[-1]) if found else {}
        if batch is not None:
            if not (m := BATCH.fullmatch(batch)):
                raise ValueError(f"{batch!r} is no <stream>-<number>")
            if int(m[2]) <= applied.get(m[1], -1):
                return  # a batch that is run again after it was written
            applied[m[1]] = int(m[2])
        old = self.read()
        new = new.select(*old.columns, *([order] if order and order not in old.columns else []))
        if order:
            new = new.groupBy(self.key).agg(F.max_by(F.struct(*old.columns), F.struct(F.col(order), F.xxhash64(*old.columns))).alias("row")).select("row.*")
        elif not new.groupBy(self.key).count().where("count > 1").isEmpty():
            raise ValueError(f"repeated {self.key} within one upsert: name a column that orders them")
        merged = old.join(new.select(self.key), self.key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))
        number = found[-1] + 1 if found else 0
        self._note(number, applied)  # before the version is complete: a version never lacks it
        merged.write.mode("overwrite").parquet(f"{self.path}/v{number}")
        for version in [*found, number][: -self.keep]:
            for name in (f"v{version}", f"applied/v{version}.json"):
                at, fs = file_system(self.spark, f"{self.path}/{name}")
                fs.delete(at, True)

    def insert_missing(self, new: DataFrame) -> None:
        """Rows whose key the store lacks; others are left as they are."""
        known = self.read().select(self.key)
        self.upsert(new.join(known, self.key, "left_anti"))

    def finish(self, key: object, status: str, **values: object) -> None:
        """Guarded update: only a running row changes its status (and the other columns named)."""
        hit = (F.col(self.key) == F.lit(key)) & (F.col("status") == "running")
        types = dict(self.read().dtypes)
        self.upsert(self.read().where(hit).withColumns({"status": F.lit(status), **{k: F.lit(v).cast(types[k]) for k, v in values.items()}}))

    def find(self, key: object) -> DataFrame:
        """The row with this key, if there is one."""
        return self.read().where(F.col(self.key) == F.lit(key))


def stream_upsert(stream: DataFrame, store: ResultStore, checkpoint: str, order: str | None = None, name: str | None = None) -> StreamingQuery:
    """Each micro-batch becomes one version; stream and batch id name it, so a replayed batch changes nothing.

    ``name`` tells streams into one store apart; without it the checkpoint does.
    """
    own = name or hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    return stream.writeStream.foreachBatch(lambda df, batch: store.upsert(df, f"{own}-{batch}", order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RunStore:
    """Targets, runs, case results and metrics, each a ``ResultStore``."""

    TARGETS = "id string, name string, adapter_type string, endpoint string, version string, languages array<string>, visibility string, created_at string"
    RUNS = (
        "id string, benchmark_id string, benchmark_version string, target_id string, target_version string, status string, started_at string, finished_at string, "
        "config_hash string, dataset_hash string, result_hash string, evaluator_version string, git_commit string, visibility string, limitations array<string>"
    )
    RESULTS = "row_id string, run_id string, case_id string, result_json string"
    METRICS = "row_id string, run_id string, metric string, value double, metric_source string"

    def __init__(self, spark: SparkSession, path: str, seeds: list[tuple | dict] = ()) -> None:
        """``seeds`` are targets (id, name, version, created_at as a tuple, or a dict with what else is known); one whose id is there changes nothing."""
        self.spark = spark
        seeds = [s if isinstance(s, dict) else dict(zip(("id", "name", "version", "created_at"), s, strict=True)) for s in seeds]
        at = lambda name, key, schema: ResultStore(spark, f"{path}/{name}", key, schema)
        self.targets, self.runs = at("targets", "id", self.TARGETS), at("runs", "id", self.RUNS)
        self.results, self.metrics = at("results", "row_id", self.RESULTS), at("metrics", "row_id", self.METRICS)
        if seeds:
            self.targets.insert_missing(self._rows([{"adapter_type": "mock", "languages": ["kk", "ru"], "visibility": "public", **s} for s in seeds], self.TARGETS))

    def _rows(self, values: list[dict], schema: str) -> DataFrame:
        wanted = self.spark.createDataFrame([], schema).schema
        for v in values:
            if unknown := sorted(set(v) - set(wanted.names)):
                raise ValueError(f"unknown fields: {unknown}")
        return self.spark.createDataFrame([tuple(v.get(n) for n in wanted.names) for v in values], wanted)

    def create(self, run_id: str, target: str, version: str, config: dict, started_at: str, **fields: object) -> None:
        """A running run; ``fields`` are further columns (benchmark_id, benchmark_version, dataset_hash, evaluator_version, git_commit, limitations; visibility is private unless given)."""
        digest = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()
        row = {"id": run_id, "target_id": target, "target_version": version, "status": "running", "started_at": started_at, "config_hash": digest, "visibility": "private", **fields}
        self.runs.insert_missing(self._rows([row], self.RUNS))

    def finish(self, run_id: str, results: list[dict], metrics: dict[str, float | tuple[float, str]], finished_at: str) -> None:
        """Only a running run is completed; its results and metrics are written after it has changed, and only by the one whose digest it carries.

        Results are stored as they come and hashed with sorted keys. A metric is a value, or a value with its source.
        """
        if self.runs.find(run_id).where("status = 'running'").isEmpty():
            return
        digest = hashlib.sha256("\n".join(result_json(r) for r in results).encode()).hexdigest()
        self.runs.finish(run_id, "completed", finished_at=finished_at, result_hash=digest)
        if self.runs.find(run_id).where((F.col("result_hash") == digest) & (F.col("finished_at") == finished_at)).isEmpty():
            return
        if results:
            self.results.upsert(self._rows([{"row_id": f"{run_id}/{r['case_id']}", "run_id": run_id, "case_id": r["case_id"], "result_json": json.dumps(r, ensure_ascii=False)} for r in results], self.RESULTS))
        if metrics:
            pairs = {k: v if isinstance(v, tuple) else (v, "computed") for k, v in metrics.items()}
            self.metrics.upsert(self._rows([{"row_id": f"{run_id}/{k}", "run_id": run_id, "metric": k, "value": None if v is None else float(v), "metric_source": source} for k, (v, source) in pairs.items()], self.METRICS))

    def list_runs(self) -> DataFrame:
        """Newest first."""
        return self.runs.read().orderBy(F.desc("started_at"), "id")

    def list_targets(self) -> DataFrame:
        """Oldest first."""
        return self.targets.read().orderBy("created_at", "id")

    def list_results(self, run_id: str) -> DataFrame:
        return self.results.read().where(F.col("run_id") == run_id).orderBy("case_id")

    def list_metrics(self, run_id: str) -> DataFrame:
        return self.metrics.read().where(F.col("run_id") == run_id).select("metric", "value", "metric_source").orderBy("metric")
