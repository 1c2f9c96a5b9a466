"""Readers and sinks of manifests, delimited tables, protocols and files."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import written_score
from ..session import file_system
from .formats import numbered_lines

# The canonical manifest row.
SAMPLE = (
    "sample_id string, path string, label string, language string, speaker_id string, related_speaker_ids array<string>, source_dataset string, source_id string, "
    "generator_id string, license string, original_path string, parent_sample_id string, rights_reference string, usage_permission string, codec string, condition string, "
    "split string, source_sha256 string, processed_sha256 string, sample_rate int, duration_sec double, transcript string, normalized_text string, text_id string, "
    "source_text_id string, generator_family string, generator_version string, generator_model string, generator_runtime string, voice_id string, generator_speaker_id int, "
    "generator_speaker_name string, generation_seed decimal(20,0), generation_params string, intended_role string, quality_gate string, training_eligible boolean, "
    "diagnostic_only boolean, candidate boolean, missing_metadata array<string>, attack_id string, source_record_id string"
)
AUDIO = ("wav", "flac", "ogg", "mp3")


def conform(df: DataFrame, schema: str = SAMPLE) -> DataFrame:
    """Casts to the canonical columns; absent ones become null, unknown ones are an error."""
    want = df.sparkSession.createDataFrame([], schema).schema
    if extra := sorted(set(df.columns) - set(want.names)):
        raise ValueError(f"unknown columns: {extra}")
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".parquet"):
        return conform(spark.read.parquet(path))  # read as written, then cast: all-null columns come back as int
    return spark.read.schema(SAMPLE).json(path, mode="FAILFAST")


def write_manifest(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    writer.parquet(path) if path.endswith(".parquet") else writer.json(path)


def read_table(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    sep = delimiter or ("\t" if path.endswith((".tsv", ".txt")) else ",")
    return spark.read.csv(path, header=True, sep=sep, escape='"', inferSchema=False, encoding="UTF-8")


def read_seven_columns(spark: SparkSession, path: str) -> DataFrame:
    """Headerless tab-separated rows without quoting, with their ``file`` and ``line``; rows of other than seven ``fields`` are ``bad``. Blank lines count, but are no rows."""
    names = ("id", "filename", "raw", "text", "chars", "num_samples", "gender")
    rows = numbered_lines(spark, path).where("trim(value) <> ''").withColumn("f", F.split("value", "\t", -1))
    return rows.select(*(F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)), F.size("f").alias("fields"), (F.size("f") != 7).alias("bad"), "file", "line", "ordinal")


def read_numbered_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSONL manifest with each row's ``file``, ``line`` and ``ordinal`` in file order; a line that isn't a row is an error that names it."""
    lines = numbered_lines(spark, path).where("trim(value) <> ''")
    parsed = lines.select("file", "line", "ordinal", F.from_json("value", f"{SAMPLE}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    message = F.concat(F.lit("Invalid manifest row: "), "file", F.lit(", line "), "line")
    checked = parsed.withColumn("r", F.when(F.col("r").isNull() | F.col("r._corrupt").isNotNull(), F.raise_error(message)).otherwise(F.col("r")))
    return checked.select("r.*", "file", "line", "ordinal").drop("_corrupt")


def read_protocol(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace protocol with ``file`` and ``line``: label in field 6 if it is one, else in field 5; ``-`` attacks are null."""
    f = F.split(F.trim("value"), "\\s+")
    rows = numbered_lines(spark, path).where("trim(value) <> '' AND NOT trim(value) LIKE '#%'").select(f.alias("f"), "file", "line")
    sixth = F.get("f", F.lit(5)).isin("bonafide", "spoof")
    raw = F.when(sixth, F.get("f", F.lit(5))).otherwise(F.get("f", F.lit(4)))
    attack = F.nullif(F.when(sixth, F.get("f", F.lit(4))).otherwise(F.get("f", F.lit(3))), F.lit("-"))
    label = F.when(raw == "bonafide", "real").when(raw == "spoof", "synthetic")
    return rows.select(
        F.get("f", F.lit(0)).alias("speaker_id"), F.get("f", F.lit(1)).alias("utterance"), label.alias("label"),
        F.when(label == "synthetic", F.coalesce(attack, F.lit("asvspoof_unknown_attack"))).alias("attack_id"), label.isNull().alias("bad"), "file", "line",
    )


def read_audio_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path, sha256, bytes, extension, transcript``: audio files, with the text of the same stem beside them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    stem, kind = F.regexp_replace("path", "\\.[^./]+\\z", ""), F.lower(F.regexp_extract("path", "\\.([^./]+)\\z", 1))
    files = files.withColumns({"stem": stem, "kind": kind})
    texts = files.where("kind = 'txt'").select("stem", F.trim(F.col("content").cast("string")).alias("transcript"))
    audio = files.where(F.col("kind").isin(*AUDIO)).select("path", "stem", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), sniff(F.col("content")).alias("extension"))
    return audio.join(texts, "stem", "left").drop("stem")


def sniff(content):
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head == "52494646", ".wav").when(head == "664C6143", ".flac").when(head == "4F676753", ".ogg")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """``sample_id, synthetic_score`` and, if it is there, ``decision``; any other header is an error."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    if df.columns not in (["sample_id", "synthetic_score"], ["sample_id", "synthetic_score", "decision"]):
        raise ValueError(f"unexpected header: {df.columns}")
    return df.withColumn("synthetic_score", F.expr("try_cast(synthetic_score AS double)"))


def write_predictions(df: DataFrame, path: str) -> None:
    df.select("sample_id", written_score("synthetic_score").alias("synthetic_score")).write.mode("errorifexists").csv(path, header=True)


def write_report(value: dict, path: str) -> None:
    """A small report as JSON; the file must be new and NaN is refused."""
    with open(path, "x", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False)


def markdown(rows: DataFrame, columns: list[str]) -> str:
    """A table of a report: six decimals, N/A for nulls. Every row is written; rows come to the driver a partition at a time."""
    shown = rows.select(*(F.coalesce(F.format_string("%.6f", c) if t in ("double", "float") else F.col(c).cast("string"), F.lit("N/A")).alias(c) for c, t in rows.select(*columns).dtypes))
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(r) + " |" for r in shown.toLocalIterator()]) + "\n"


def write_splits(rows: DataFrame, folder: str, splits: tuple[str, ...] = ("train", "val", "test")) -> dict[str, int]:
    """The manifest and one manifest per split, and how many rows each split has; a folder that has any of them is an error."""
    spark = rows.sparkSession
    targets = {"manifest.split": rows, **{s: rows.where(F.col("split") == s) for s in splits}}
    for name in targets:
        at, fs = file_system(spark, f"{folder}/{name}.parquet")
        if fs.exists(at):
            raise FileExistsError(f"{folder}/{name}.parquet")
    for name, part in targets.items():
        write_manifest(part, f"{folder}/{name}.parquet")
    counted = {r["split"]: r["count"] for r in rows.where(F.col("split").isin(*splits)).groupBy("split").count().collect()}
    return {s: counted.get(s, 0) for s in splits}


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "manifest": read_manifest, "table": read_table, "numbered_manifest": read_numbered_manifest, "seven_columns": read_seven_columns, "protocol": read_protocol, "audio_tree": read_audio_tree, "predictions": read_predictions,
}


def reader(name: str) -> Callable[[SparkSession, str], DataFrame]:
    if name not in READERS:
        raise ValueError(f"unknown source {name!r}; known: {sorted(READERS)}")
    return READERS[name]
