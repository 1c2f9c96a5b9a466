"""Append-only targets with a sketch of the keys beside each data file.

A sketch is a Bloom filter in blocks of 256 bits: a key's hash names a block, eight more bits of it lie within, so a test reads
one block. An append tests its keys against the sketches and reads the keys of those files only that may hold one of
them; these are compared exactly, so a false hit costs a file's reading and nothing else. A file without a
sketch (an append that was cut off between the two) always counts as a candidate, and a sketch without a file is ignored.

Appends of more than ``MANY`` keys read all files: a sketch rules nothing out for them. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runs import runs, sorted_by
from ..operators.selection import extract_new
from ..session import Scratch, file_system, ship

#: Keys (8 bytes each) that are sent to the sketches; bits of a block; blocks for each key, as 1 / PER_BLOCK.
MANY, BITS, PER_BLOCK, PROBES = 1_000_000, 256, 16, 8
FOLDER = "_membership"


def positions(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash, and its eight bits in it (5 bits of the hash name one bit in each eighth of the block)."""
    block = (hashes >> np.uint64(40)) % np.uint64(blocks)
    lanes = np.arange(PROBES, dtype=np.uint64)
    bits = (hashes[:, None] >> (lanes * np.uint64(5))) & np.uint64(31)
    return block.astype(np.int64), (bits + lanes * np.uint64(32)).astype(np.int64)


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    blocks = max(1, -(-len(hashes) // PER_BLOCK))
    table = np.zeros(blocks * BITS, bool)
    block, bits = positions(hashes, blocks)
    table[(block[:, None] * BITS + bits).ravel()] = True
    return np.packbits(table)


def may_hold(sketch: np.ndarray, hashes: np.ndarray) -> bool:
    """Whether any of the hashes passes the sketch."""
    blocks = len(sketch) * 8 // BITS
    block, bits = positions(hashes, blocks)
    at = block[:, None] * BITS + bits
    return bool(((sketch[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1).any())


def data_files(spark: SparkSession, target: str) -> list[str]:
    root, fs = file_system(spark, target)
    return sorted(x.getPath().toString() for x in fs.listStatus(root) if x.getPath().getName().startswith("part-")) if fs.exists(root) else []


def write_sketches(spark: SparkSession, target: str, files: list[str], key: str) -> None:
    """Adds the sketches of ``files``: a file's hashes, 8 bytes a row, meet in one task."""
    if not files:
        return
    rows = spark.read.parquet(*files)
    hashed = rows.select(F.regexp_extract(rows.metadataColumn("_metadata")["file_path"], "([^/]+)\\z", 1).alias("file"), F.xxhash64(F.col(key).cast("string")).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []

        def ready() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": [name], "bits": [sketch_of(np.concatenate(held).view(np.uint64)).tobytes()]})

        for begins, piece in runs(batches, ["file"]):
            if begins and held:
                yield ready()
                held = []
            name = piece.column(0)[0].as_py()
            held.append(piece.column(1).to_numpy())
        if held:
            yield ready()

    ship(spark)
    sorted_by(hashed, ["file"], []).mapInArrow(run, "file string, bits binary").write.mode("append").parquet(f"{target}/{FOLDER}")


def candidates(spark: SparkSession, target: str, files: list[str], keys: DataFrame) -> list[str]:
    """The files that may hold one of ``keys`` (one column); files without a sketch among them."""
    at, fs = file_system(spark, f"{target}/{FOLDER}")
    if not files or not fs.exists(at):
        return files
    hashes = np.sort(keys.select(F.xxhash64(F.col(keys.columns[0]).cast("string")).alias("h")).distinct().limit(MANY + 1).toArrow()["h"].to_numpy())
    if len(hashes) > MANY:
        return files
    shared = spark.sparkContext.broadcast(hashes.view(np.uint64))  # 8 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for j in range(batch.num_rows):
                sketch = np.frombuffer(batch.column(1)[j].as_py(), np.uint8)
                hit = any(may_hold(sketch, own[k : k + 100_000]) for k in range(0, len(own), 100_000))
                yield pa.RecordBatch.from_pydict({"file": [batch.column(0)[j].as_py()], "hit": [hit]})

    ship(spark)
    # names of files come to the driver, which lists them anyway
    tested = {r["file"]: r["hit"] for r in spark.read.parquet(f"{target}/{FOLDER}").mapInArrow(run, "file string, hit boolean").collect()}
    return [f for f in files if tested.get(f.rsplit("/", 1)[1], True)]


def append_unknown(rows: DataFrame, target: str, key: str) -> dict[str, int]:
    """Appends the rows whose key the target lacks (of rows that repeat a key, all) and the sketches of the new files: ``added``, ``files`` and ``read``, the files whose keys were read."""
    spark = rows.sparkSession
    target = target.rstrip("/")
    before = data_files(spark, target)
    with Scratch(spark) as scratch:
        rows = scratch.cut(rows)
        read = candidates(spark, target, before, rows.select(key))
        new = scratch.cut(extract_new(rows, spark.read.parquet(*read), key) if read else rows)
        added = new.count()
        if added:
            new.write.mode("append").parquet(target)
        write_sketches(spark, target, sorted(set(data_files(spark, target)) - set(before)), key)
    return {"added": added, "files": len(before), "read": len(read)}
