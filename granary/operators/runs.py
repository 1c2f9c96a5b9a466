"""Rows shuffled by group and sorted within partitions, read as runs of equal keys: one pass, constant memory a group.

Digests of groups longer than ``PART_BYTES`` go part by part: the rows are dealt out by ranges of their order, and each
part is one task that takes up the state that the part before it left.
"""

from __future__ import annotations

import _hashlib
import ctypes
import functools
import hashlib
from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..session import Scratch, ship

#: Bytes of one group that a task digests, about; longer groups are digested part by part.
PART_BYTES = 1 << 27
#: Long groups that are worked on at the same time.
AT_ONCE = 8


def sorted_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``rows`` with each group of equal ``keys`` in one partition, one group after another, in ``order``."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def differs(column: pa.Array) -> np.ndarray:
    """For each value but the first whether it differs from the one before; nulls equal nulls."""
    now, before = column.slice(1), column.slice(0, len(column) - 1)
    known = pc.fill_null(pc.not_equal(now, before), True)
    return np.asarray(pc.and_(known, pc.invert(pc.and_(pc.is_null(now), pc.is_null(before)))).to_numpy(zero_copy_only=False))


def run_starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """The places where a run of equal keys begins, 0 first."""
    new = np.zeros(max(0, batch.num_rows - 1), dtype=bool)
    for k in keys:
        new |= differs(batch.column(batch.schema.get_field_index(k)))
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Pieces of the sorted rows that hold one group each, with a flag: whether the piece begins a group."""
    last = None
    for batch in batches:
        if batch.num_rows:
            starts = run_starts(batch, keys).tolist()
            for at, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                piece = batch.slice(at, end - at)
                key = tuple(piece.column(piece.schema.get_field_index(k))[0].as_py() for k in keys) if at == 0 or end == batch.num_rows else None
                yield at > 0 or last is None or key != last, piece
                last = key


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """The sorted rows in tables of whole groups, of ``rows`` or somewhat more each: for groups of a bounded size."""
    held: list[pa.RecordBatch] = []
    n = 0
    for begins, piece in runs(batches, keys):
        if begins and n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
        held.append(piece)
        n += piece.num_rows
    if held:
        yield pa.Table.from_batches(held)


@functools.cache
def _functions(algorithm: str):
    """Begin, update and end of a digest in the library that hashlib itself uses; None if it lacks them."""
    try:
        library = ctypes.CDLL(_hashlib.__file__)
        return tuple(getattr(library, f"{algorithm.upper()}_{f}") for f in ("Init", "Update", "Final"))
    except (OSError, AttributeError):
        return None


class Resumable:
    """A digest whose ``state`` is bytes, so that another task can go on with it: hashlib's objects can't leave their process."""

    def __init__(self, algorithm: str, state: bytes | None = None) -> None:
        self.algorithm = algorithm
        begin, self._update, self._end = _functions(algorithm)
        self._state = ctypes.create_string_buffer(state or b"", 256)  # the library's struct is smaller, and has no pointers
        if state is None:
            begin(self._state)

    def update(self, data: bytes) -> None:
        self._update(self._state, data, ctypes.c_size_t(len(data)))

    @property
    def state(self) -> bytes:
        return self._state.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(hashlib.new(self.algorithm).digest_size)
        self._end(out, ctypes.create_string_buffer(self.state, 256))
        return out.raw.hex()


def digests(
    rows: DataFrame, keys: list[str], order: list[Column], value: Column, separator: bytes = b"", name: str = "sha256", *, prefix: bytes = b"", algorithm: str = "sha256", short: bool = False
) -> DataFrame:
    """The digest in lowercase hex of each group's values (strings or bytes) in ``order``: ``prefix``, then the values joined by ``separator``.

    A digest demands one order, so a group is one stream with a hash state as its only memory: through one task up to
    ``PART_BYTES``, else through one task after another. A null value counts as empty; null keys form a group; without
    ``keys`` all rows are one group. ``order`` must be unique within a group, up to equal values. ``short`` says that no
    group can be long, which saves the pass that looks for them.
    """
    ship(rows.sparkSession)
    # narrow before the shuffle: the keys, the order and the value
    narrow = rows.select(*keys, *(o.alias(f"_o{k}") for k, o in enumerate(order)), value.cast("binary").alias("_value"))
    places = [f"_o{k}" for k in range(len(order))]
    if short or not _functions(algorithm):
        return _streamed(narrow, keys, places, separator, name, prefix, algorithm)
    size = F.coalesce(F.octet_length("_value"), F.lit(0)).cast("long") + len(separator)
    sizes = narrow.groupBy(*keys).agg(F.sum(size).alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    long = sizes.where(F.col("_bytes") > PART_BYTES).collect()  # one of each PART_BYTES of the input at most
    if not long:
        return _streamed(narrow, keys, places, separator, name, prefix, algorithm)
    spark = rows.sparkSession
    fields = [rows.schema[k] for k in keys]
    named = spark.createDataFrame([(*r[: len(keys)], g) for g, r in enumerate(long)], StructType([*(StructField(f"_k{k}", f.dataType) for k, f in enumerate(fields)), StructField("_g", IntegerType())]))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] or F.lit(True)
    with Scratch(spark) as scratch:
        own = narrow.join(F.broadcast(named), same).select("_g", *places, "_value")
        found = _chained(own, places, separator, prefix, algorithm, sum(r["_bytes"] for r in long), sum(r["_rows"] for r in long), scratch)
    done = spark.createDataFrame([(*r[: len(keys)], found[g]) for g, r in enumerate(long)], StructType([*fields, StructField(name, StringType())]))
    if not keys:
        return done
    return _streamed(narrow.join(F.broadcast(named), same, "left_anti"), keys, places, separator, name, prefix, algorithm).unionByName(done)


def _chained(rows: DataFrame, places: list[str], separator: bytes, prefix: bytes, algorithm: str, size: int, n: int, scratch: Scratch) -> dict[int, str]:
    """The digest of each long group ``_g``.

    Values are cut into pieces of twice their mean length at most, so ranges of equally many pieces have bounded bytes;
    neighbouring ranges make up a part. Parts of one group follow each other, groups are worked on side by side.
    """
    width = max(256, 2 * size // n)
    ranges = -(-(n * width + size) // PART_BYTES)
    value = F.coalesce("_value", F.lit(b""))
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length(value) / width), F.lit(1)).cast("int") - 1), lambda k: F.substring(value, k * width + 1, F.lit(width)))
    # equal places have equal values, but their pieces may not mix
    pieces = rows.withColumn("_row", F.monotonically_increasing_id()).select("_g", *places, "_row", F.posexplode(cuts).alias("_at", "_piece"))
    line = [*places, "_row", "_at"]
    dealt = pieces.withColumn("_size", F.octet_length("_piece").cast("long")).repartitionByRange(int(ranges), "_g", *line).withColumn("_part", F.spark_partition_id())
    dealt = scratch.cut(dealt, ["_part"])
    spans = dealt.groupBy("_g", "_part").agg(F.sum("_size").alias("_size")).orderBy("_g", "_part").collect()  # a row for each range and group
    parts: dict[int, list[list[int]]] = {}
    filled = 0
    for g, part, own in spans:
        if g not in parts or filled + own > PART_BYTES:
            parts.setdefault(g, []).append([])
            filled = 0
        parts[g][-1].append(part)
        filled += own

    def chain(g: int) -> str:
        state = digest = None
        for part in parts[g]:
            def run(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
                at_start = state is None
                own = Resumable(algorithm, state)
                if at_start:
                    own.update(prefix)
                for batch in batches:
                    for at in range(0, batch.num_rows, 1000):
                        some = batch.slice(at, 1000)
                        text = b"".join(v if k else separator + v for k, v in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True))
                        own.update(text[len(separator) :] if at_start else text)
                        at_start = False
                yield pa.RecordBatch.from_arrays([pa.array([own.state]), pa.array([own.hexdigest()])], names=["state", "digest"])

            # one task that sorts one part: no shuffle
            sorted_part = dealt.where(F.col("_part").isin(part) & (F.col("_g") == g)).coalesce(1).sortWithinPartitions(*line)
            state, digest = sorted_part.select("_at", "_piece").mapInArrow(run, "state binary, digest string").first()
            state = bytes(state)
        return digest

    with ThreadPool(min(AT_ONCE, len(parts))) as pool:
        return dict(zip(parts, pool.map(chain, list(parts)), strict=True))


def _streamed(narrow: DataFrame, keys: list[str], places: list[str], separator: bytes, name: str, prefix: bytes, algorithm: str) -> DataFrame:
    """Each group through one task."""
    out = StructType([*(narrow.schema[k] for k in keys), StructField(name, StringType())])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, group, done = None, None, []
        for begins, piece in runs(batches, keys):
            if begins:
                if state is not None:
                    done.append((*group, state.hexdigest()))
                    if len(done) >= 10_000:
                        yield as_batch(done, arrow)
                        done = []
                state, group = hashlib.new(algorithm, prefix), [piece.column(k)[0].as_py() for k in range(len(keys))]
            else:
                state.update(separator)
            values = piece.column(len(keys))
            for at in range(0, len(values), 1000):  # a piece may be a batch of long texts: not all of them twice
                state.update((separator if at else b"") + separator.join(v or b"" for v in values.slice(at, 1000).to_pylist()))
        if state is not None:
            done.append((*group, state.hexdigest()))
        if done:
            yield as_batch(done, arrow)

    sorted_rows = sorted_by(narrow, keys, [F.col(p) for p in places]) if keys else narrow.repartition(1).sortWithinPartitions(*places)
    return sorted_rows.select(*keys, "_value").mapInArrow(run, out)


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
