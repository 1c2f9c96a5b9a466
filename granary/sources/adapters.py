"""Sources brought into the canonical shape, append-only extraction, keyed scans and run artifacts."""

from __future__ import annotations

import hashlib
import json
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import deterministic_id, normalize_text, text_identity, written_score
from ..operators.rules import LANGUAGES, RuleError, duplicate_keys, require_none
from ..operators.runs import digests
from ..operators.selection import extract_new, top_k
from ..session import Scratch, file_system
from .manifests import read_protocol, read_seven_columns, sniff

FIELDS = ("path", "speaker_id", "source_id", "language", "transcript")


def read_config(path: str) -> dict:
    """A mapping from JSON, or from YAML where that library is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        value = json.loads(text)
    else:
        import yaml  # optional: only YAML files need it

        value = yaml.safe_load(text)
    if not isinstance(value, dict):
        raise ValueError(f"{path}: a mapping is required")
    return value


def enabled_sources(sources: list[dict], roles: tuple[str, ...] = ("primary",)) -> list[dict]:
    return [s for s in sources if s.get("enabled", True) and s.get("role", "primary") in roles]


def canonical(rows: DataFrame, source: str, *, columns: dict[str, str] | None = None, filters: dict[str, list[str]] | None = None, languages: dict[str, str] | None = None, language: str = "kk") -> DataFrame:
    """Renamed columns with defaults: an id from the source and the record (the path without its suffix if it has none),
    ``unknown_<id>`` for a missing speaker, the mapped language; ``bad`` names what cannot be used.

    Columns that a source lacks count as null, and as an empty text in filters; a null passes a filter as ``None``.
    """
    names = {f: (columns or {}).get(f, f) for f in FIELDS}
    at = {f: F.nullif(F.col(n).cast("string"), F.lit("")) if n in rows.columns else F.lit(None).cast("string") for f, n in names.items()}
    for name, accepted in (filters or {}).items():
        value = F.coalesce(F.col(name).cast("string"), F.lit("None")) if name in rows.columns else F.lit("")
        rows = rows.where(value.isin(accepted))
    path = F.trim(at["path"])
    sample_id = deterministic_id(F.lit(source), F.coalesce(at["source_id"], F.regexp_replace(path, "\\.[^./]+\\z", "")))
    raw = F.coalesce(at["language"], F.lit(language))
    mapped = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in languages.items() for x in pair)), raw), raw) if languages else raw
    text = F.nullif(F.trim(at["transcript"]), F.lit(""))
    own = rows.select(path.alias("path"), sample_id.alias("sample_id"), mapped.alias("language"), at["speaker_id"].alias("speaker"), text.alias("transcript"), normalize_text(text).alias("normalized_text"))
    return own.select(
        "sample_id", "path", "language", F.coalesce("speaker", F.concat(F.lit("unknown_"), "sample_id")).alias("speaker_id"), F.lit(source).alias("source_dataset"),
        F.when(F.col("speaker").isNull(), F.array(F.lit("speaker_id"))).otherwise(F.array().cast("array<string>")).alias("missing_metadata"), "transcript", "normalized_text",
        text_identity(F.col("language"), F.col("normalized_text")).alias("text_id"),
        F.when(F.coalesce("path", F.lit("")) == "", "path").when(~F.col("language").isin(*LANGUAGES), "language").alias("bad"),
    )


def protocol_samples(spark: SparkSession, protocol: str, audio: DataFrame) -> DataFrame:
    """Protocol rows with the file of their stem (the last path of equal stems); ``missing`` where there is none."""
    stem = F.regexp_extract("path", "([^/]+?)(\\.[^./]+)?\\z", 1)
    files = audio.groupBy(stem.alias("utterance")).agg(F.max("path").alias("path"))
    return read_protocol(spark, protocol).join(files, "utterance", "left").withColumn("missing", F.col("path").isNull())


def embedded_audio(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Six columns of a Parquet table with audio bytes inside; an unknown kind of file has a null ``extension``."""
    rows = spark.read.parquet(path)
    if lacking := sorted({"id", "audio", "raw_transcription", "transcription", "num_samples", "gender"} - set(rows.columns)):
        raise ValueError(f"columns are missing: {lacking}")
    clean = lambda c: F.translate(F.col(c).cast("string"), "\t\n\r", "   ")
    digest = F.substring(F.sha2("audio.bytes", 256), 1, 12)
    return rows.select(
        F.concat_ws("_", F.lit(split), "id", digest).alias("record_id"), F.col("audio.bytes").alias("content"), sniff(F.col("audio.bytes")).alias("extension"),
        clean("raw_transcription").alias("raw"), clean("transcription").alias("text"), "num_samples", clean("gender").alias("gender"),
    )


def append_new(rows: DataFrame, target: str, key: str, most: int | None = None, order: str | None = None) -> int:
    """Appends the rows whose key the target lacks, the first ``most`` of them in ``order`` if given; a run again adds nothing. How many were added."""
    spark = rows.sparkSession
    at, fs = file_system(spark, target)
    new = extract_new(rows, spark.read.parquet(target), key) if fs.exists(at) else rows
    if most is not None:
        new = new.orderBy(order).limit(most)
    with Scratch(spark) as scratch:
        new = scratch.cut(new)
        new.write.mode("append").parquet(target)
        return new.count()


def pinned_texts(spark: SparkSession, path: str, language: str, sha256: str, k: int = 5) -> DataFrame:
    """The first k usable texts of a file of seven columns whose digest is known; the report needs all k."""
    content = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    if content != sha256:
        raise RuleError(f"{path}: digest differs")
    rows = read_seven_columns(spark, path)
    if bad := rows.where("bad").orderBy("line").first():
        raise RuleError(f"{path}: row {bad['line']} has {bad['fields']} fields instead of seven")
    usable = rows.withColumn("normalized_text", normalize_text("text")).where("normalized_text <> ''").withColumn("language", F.lit(language))
    out = top_k(usable, "language", "ordinal", k)
    if out.count() < k:
        raise RuleError(f"{path}: fewer than {k} texts")
    return out.withColumn("text_id", text_identity(F.col("language"), F.col("normalized_text")))


def read_keyed(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines of texts, jobs or results: an empty file or a repeated key is an error."""
    rows = spark.read.schema(schema).json(path, mode="FAILFAST")
    if rows.isEmpty():
        raise RuleError(f"{path}: no rows")
    require_none(duplicate_keys(rows, key), path)
    return rows


def _line(job: DataFrame) -> Column:
    """A job as one line: its fields by name, as JSON; nulls are written."""
    return F.to_json(F.struct(*sorted(job.columns)), {"ignoreNullFields": "false"})


def write_plan(jobs: DataFrame, folder: str, metadata: dict) -> str:
    """Writes jobs as lines in order of ``job_id`` below a new ``folder``, and beside them the metadata with the digest of all lines; the digest.

    A plan without jobs, or with a repeated job, is an error. The metadata come last: a plan without them is unfinished.
    """
    spark = jobs.sparkSession
    at, fs = file_system(spark, folder)
    if fs.exists(at):
        raise FileExistsError(folder)
    with Scratch(spark) as scratch:
        jobs = scratch.cut(jobs)
        if jobs.isEmpty():
            raise RuleError("the plan is empty")
        require_none(duplicate_keys(jobs, "job_id"), "jobs of the plan")
        lines = jobs.select("job_id", _line(jobs).alias("value"))
        digest = digests(lines, [], [F.col("job_id")], F.col("value"), b"\n").first()[0]
        lines.orderBy("job_id").select("value").write.text(f"{folder}/generation_jobs")
    stream = fs.create(file_system(spark, f"{folder}/generation_plan.json")[0], False)
    try:
        stream.write(bytearray(json.dumps({**metadata, "generation_jobs_sha256": digest}, ensure_ascii=False, sort_keys=True, allow_nan=False).encode()))
    finally:
        stream.close()
    return digest


def read_plan(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, dict]:
    """The jobs and the metadata of a plan; lines that don't have the recorded digest are an error."""
    at, fs = file_system(spark, f"{folder}/generation_plan.json")
    if not fs.exists(at):
        raise RuleError(f"{folder}: no metadata")
    stream = fs.open(at)
    try:
        metadata = json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()
    jobs = read_keyed(spark, f"{folder}/generation_jobs", schema, "job_id")
    lines = spark.read.text(f"{folder}/generation_jobs")
    named = lines.select("value", F.get_json_object("value", "$.job_id").alias("job_id"))
    if digests(named, [], [F.col("job_id")], F.col("value"), b"\n").first()[0] != metadata["generation_jobs_sha256"]:
        raise RuleError(f"{folder}: the jobs have changed")
    return jobs, metadata


def snapshot_problems(models: DataFrame, samples: DataFrame) -> DataFrame:
    """``rule, key``: repeated model or sample ids, and samples of unknown models."""
    unknown = samples.select("model_id").where("model_id is not null").distinct().join(models.select("model_id").distinct(), "model_id", "left_anti")
    parts = [duplicate_keys(models, "model_id"), duplicate_keys(samples, "sample_id"), unknown.select(F.lit("V15").alias("rule"), F.col("model_id").cast("string").alias("key"))]
    return reduce(DataFrame.unionByName, parts)


def decisions(scored: DataFrame, threshold: float, *kept: Column | str) -> DataFrame:
    """``sample_id, synthetic_score, decision`` as they are written, and what is kept beside them."""
    decided: Column = F.when(F.col("synthetic_score") >= threshold, "synthetic").otherwise("real")
    return scored.select("sample_id", written_score("synthetic_score").alias("synthetic_score"), decided.alias("decision"), *kept)


def write_artifacts(folder: str, documents: dict[str, dict]) -> dict[str, str]:
    """Small JSON reports and a list of their digests; existing files are never replaced."""
    root, digests = Path(folder), {}
    root.mkdir(parents=True, exist_ok=True)
    for name, value in sorted(documents.items()):
        data = json.dumps(value, ensure_ascii=False, sort_keys=True, allow_nan=False).encode()
        with open(root / name, "xb") as f:
            f.write(data)
        digests[name] = hashlib.sha256(data).hexdigest()
    with open(root / "sha256.txt", "x", encoding="utf-8") as f:
        f.write("".join(f"{d}  {n}\n" for n, d in digests.items()))
    return digests
