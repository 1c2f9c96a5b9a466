"""Files held against what a manifest records: size, digest and frames in one pass, a piece at a time.

A task reads the files of its rows through pyarrow's file systems (by the root's scheme), ``PIECE`` bytes at a time, so
memory is the same for a file of any size. Frames and rate come from the headers of WAV and FLAC; other kinds have
none. A path that leaves the root is never opened.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import contained_path
from ..operators.runs import as_batch
from ..session import ship

PIECE = 4 << 20
#: What is kept of a file's start to read its header from.
HEAD = 1 << 20
FACTS = "path string, bytes long, sha256 string, frames long, sample_rate int, declared long, problem string"


def wav_frames(head: bytes) -> tuple[int, int, int] | None:
    """Frames, rate and the file size that the header of a RIFF WAVE file declares up to the end of its samples; None if it has no format and data within ``head``."""
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at, width, rate = 12, 0, 0
    while at + 8 <= len(head):
        name, size = head[at : at + 4], struct.unpack_from("<I", head, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(head):
            rate, width = struct.unpack_from("<I", head, at + 12)[0], struct.unpack_from("<H", head, at + 20)[0]
        elif name == b"data":
            return (size // width, rate, at + 8 + size) if width else None
        at += 8 + size + size % 2
    return None


def flac_frames(head: bytes) -> tuple[int, int, int] | None:
    """Frames and rate of a FLAC stream's first block; the size isn't declared (0)."""
    if head[:4] != b"fLaC" or len(head) < 26:
        return None
    packed = int.from_bytes(head[18:26], "big")
    return packed & (1 << 36) - 1, packed >> 44, 0


def file_facts(paths: DataFrame, root: str) -> DataFrame:
    """``path, bytes, sha256, frames, sample_rate, declared, problem`` of each distinct ``path`` below ``root``; problem is outside, missing or unreadable."""
    out = StructType.fromDDL(FACTS)
    arrow = to_arrow_schema(out)

    def facts(fs: pafs.FileSystem, base: str, path: str) -> tuple:
        at = f"{base.rstrip('/')}/{path}"
        if fs.get_file_info(at).type != pafs.FileType.File:
            return path, None, None, None, None, None, "missing"
        state, size, head = hashlib.sha256(), 0, b""
        try:
            with fs.open_input_file(at) as f:
                while piece := f.read(PIECE):
                    state.update(piece)
                    size += len(piece)
                    if len(head) < HEAD:
                        head += piece[: HEAD - len(head)]
        except OSError:
            return path, size, None, None, None, None, "unreadable"
        frames, rate, declared = wav_frames(head) or flac_frames(head) or (None, None, None)
        return path, size, state.hexdigest(), frames, rate, declared, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
        for batch in batches:
            for path, inside in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield as_batch([facts(fs, base, path) if inside else (path, None, None, None, None, None, "outside")], arrow)

    ship(paths.sparkSession)
    # dealt out by path: a manifest in one small partition still keeps all tasks busy
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = paths.select("path").where("path is not null").distinct().repartition(parts, "path")
    return own.select("path", contained_path(F.col("path")).alias("inside")).mapInArrow(run, out)


def verify_files(manifest: DataFrame, root: str, digest: str = "source_sha256", size: str | None = None) -> DataFrame:
    """``sample_id, problem`` of rows whose file isn't what is recorded: outside, missing, unreadable, truncated (shorter than recorded in ``size``, or than its own header says) or changed."""
    facts = file_facts(manifest, root).withColumnRenamed("problem", "found")
    rows = manifest.select("sample_id", "path", F.col(digest).alias("want"), (F.col(size) if size else F.lit(None)).cast("long").alias("length")).join(facts, "path", "left")
    short = (F.col("bytes") < F.col("length")) | (F.col("bytes") < F.col("declared"))
    problem = F.when(F.col("path").isNull(), "missing").when(F.col("found").isNotNull(), F.col("found"))
    problem = problem.when(F.coalesce(short, F.lit(False)), "truncated").when(~F.col("sha256").eqNullSafe(F.col("want")) | (F.col("bytes") != F.coalesce("length", "bytes")), "changed")
    return rows.select("sample_id", problem.alias("problem")).where("problem is not null")


def snapshot_file_problems(samples: DataFrame, root: str) -> DataFrame:
    """``audio_path, problem`` of a snapshot's samples (``audio_path, bytes, sha256``), as its validation words them; the first that holds."""
    facts = file_facts(samples.select(F.col("audio_path").alias("path")), root).select("path", F.col("bytes").alias("size"), F.col("sha256").alias("actual"), F.col("problem").alias("found"))
    rows = samples.select("audio_path", "bytes", "sha256").join(facts, F.col("audio_path") == F.col("path"), "left")
    problem = F.when(F.col("found").isNotNull() | F.col("path").isNull(), "missing public audio").when(~F.col("size").eqNullSafe(F.col("bytes")), "byte count mismatch")
    problem = problem.when(~F.col("actual").eqNullSafe(F.col("sha256")), "SHA-256 mismatch")
    return rows.select("audio_path", problem.alias("problem")).where("problem is not null")


def valid_outputs(results: DataFrame, root: str) -> DataFrame:
    """``job_id, valid`` of results (``job_id, output_relative_path, output_sha256``): the file is there, has frames, and has the recorded digest."""
    facts = file_facts(results.select(F.col("output_relative_path").alias("path")), root).select("path", "sha256", "frames")
    rows = results.select("job_id", "output_relative_path", "output_sha256").join(facts, F.col("output_relative_path") == F.col("path"), "left")
    return rows.select("job_id", F.coalesce((F.col("frames") > 0) & (F.col("sha256") == F.col("output_sha256")), F.lit(False)).alias("valid"))
