"""Row-wise Arrow maps and word shingles shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import ship

WORD = re.compile(r"\w+")
SHINGLE = 5
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of input, by the batch's mean, from which one output batch is made.
FLUSH_BYTES = 1_000_000


def give_back() -> None:
    """Returns freed memory to the system: a Python worker lives on, idle or in other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def release_loaded(keep: dict | None = None) -> None:
    """Drops what operators keep loaded in this worker (their ``_LOADED``) but ``keep``: a worker lives on through the stages of a pipeline."""
    held = [m._LOADED for n, m in list(sys.modules.items()) if n.startswith(f"{__package__}.") and getattr(m, "_LOADED", None)]
    held = [d for d in held if d is not keep]
    if held:
        for d in held:
            d.clear()
        gc.collect()
        give_back()


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], Iterator[tuple]]], schema: str) -> DataFrame:
    """Applies ``make()`` (built once per task) to each row; it yields output tuples.

    Rows come as dicts. Output is flushed by bytes of input, so that memory stays
    bounded with long texts; for the same reason a session with Spark's default of
    10,000 rows an Arrow batch is set to 1,000.
    """
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        try:
            for batch in batches:
                size = max(1, min(2000, FLUSH_BYTES * batch.num_rows // max(1, batch.nbytes)))
                for at in range(0, batch.num_rows, size):
                    found = [x for row in batch.slice(at, size).to_pylist() for x in step(row)]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*found), out, strict=True)], schema=out)
        finally:
            del step
            found = batch = None
            give_back()

    ship(df.sparkSession)
    if df.sparkSession.conf.get(BATCH_ROWS) == "10000":
        df.sparkSession.conf.set(BATCH_ROWS, "1000")
    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, keys: list[str], make: Callable[[], Callable[[list[dict]], Iterator[tuple]]], schema: str) -> DataFrame:
    """Applies ``make()`` to the rows of each group of equal ``keys``, as a list: for groups of a bounded size only."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        group: list[dict] = []
        found: list[tuple] = []

        def ready(least: int) -> Iterator[pa.RecordBatch]:
            if len(found) > least:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*found), out, strict=True)], schema=out)
                found.clear()

        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if group and any(group[0][k] != row[k] for k in keys):
                        found.extend(step(group))
                        group = []
                        yield from ready(20_000)
                    group.append(row)
            if group:
                found.extend(step(group))
            yield from ready(0)
        finally:
            del step
            group = batch = None
            found.clear()
            give_back()

    ship(df.sparkSession)
    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def pick(df: DataFrame, id_col: str, text_col: str, *, keep_null: bool = False) -> DataFrame:
    """Only the id and the text, by fixed names: other columns can't clash."""
    text = F.col(text_col) if keep_null else F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("doc_id"), text.alias("text"))


LONGEST_KEY = 100


class Memo(dict):
    """A dict that computes what it lacks and starts anew at ``limit`` entries; long strings are not kept, so its size is bounded."""

    def __init__(self, make: Callable, limit: int = 80_000) -> None:
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self.make(key)
        if not isinstance(key, str) or len(key) <= LONGEST_KEY:
            self[key] = value
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Lower-cased word runs (``\\w+``) of a text as hashes, and hashed shingles of them."""

    def __init__(self) -> None:
        self.memo = Memo(xxhash.xxh3_64_intdigest)

    def words(self, text: str | None) -> np.ndarray:
        found = WORD.findall((text or "").lower())
        return np.fromiter(map(self.memo.__getitem__, found), np.uint64, len(found))

    @staticmethod
    def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
        """One hash per ``k`` words; a shorter text is one shingle, an empty one has none."""
        if not len(words):
            return words
        k = min(k, len(words))
        out = words[: len(words) - k + 1].copy()
        for i in range(1, k):
            out = out * np.uint64(0x9E3779B97F4A7C15 | 1) + words[i : len(words) - k + 1 + i]
        return mix(out)
