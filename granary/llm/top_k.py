"""Exact top-k search: tiled matrix products of query blocks and shards, partial selection per tile, tree merge of the top lists.

Vectors become integers floor(scale * x). Both sides are packed into blocks of rows. A cell of the grid (query group,
shard) holds its queries, a bounded number, in memory while the shard's blocks stream past them; each tile is one
matrix product, of which the best ``k`` of each row join the query's running list. The lists of a query's shards are
merged ``FAN`` at a time, level by level. Nothing is approximate, and no candidate is left out.

Edges: a vector that is null, or holds a null, NaN or infinite component (also after scaling), takes no part; nor does
a row without an id. A shorter vector counts as filled up with zeros, so an empty one scores 0. Equal scores go to the
smaller id. Rows that repeat an id are queries and candidates of their own, but no candidates for their own id.
Products are exact at any size (floating matrices as long as those are exact, Python's integers else); a score beyond
a long counts as the nearest long. With fewer than ``k`` candidates all are given; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.runs import runs
from ..session import Scratch, ship

#: Rows of a packed block, and of the part of a query group that one matrix product takes.
BLOCK, PART = 4096, 512
#: Queries that a task holds, and candidates of a shard, on average.
GROUP_ROWS, SHARD_ROWS = 1 << 16, 1 << 20
#: Lists merged at a time.
FAN = 8
LEAST, MOST = -(2**63), 2**63 - 1
#: Integers below this are exact as float32, or as float64.
EXACT_32, EXACT_64 = 2**24, 2**53
PACKED = "n int, dim int, wide boolean, ids binary, vecs binary"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``vec`` (doubles) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vec")).where(F.col("id").isNotNull() & finite)


def pack(vectors: DataFrame, scale: float) -> DataFrame:
    """Blocks of at most ``BLOCK`` integer vectors, by ascending id, with a number each; written, as the numbers must not change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                ids = np.asarray(piece.column(0).to_numpy(zero_copy_only=False), dtype=np.int64)
                lists = piece.column(1)
                lengths = np.diff(lists.offsets.to_numpy())
                dim = int(lengths.max(initial=0))
                flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False))
                vecs = np.zeros((len(ids), dim))
                vecs[np.arange(dim) < lengths[:, None]] = flat
                fine = np.isfinite(vecs).all(axis=1)
                order = np.argsort(ids[fine], kind="stable")
                ids, vecs = ids[fine][order], vecs[fine][order]
                wide = bool(len(vecs) and np.abs(vecs).max(initial=0) >= EXACT_32)
                cells = vecs if wide else vecs.astype(np.float32)
                if len(ids):
                    yield pa.RecordBatch.from_pydict(
                        {"n": pa.array([len(ids)], pa.int32()), "dim": pa.array([dim], pa.int32()), "wide": [wide], "ids": [ids.tobytes()], "vecs": [cells.tobytes()]}
                    )

    ship(vectors.sparkSession)
    return vectors.mapInArrow(run, PACKED).withColumn("block", F.monotonically_increasing_id())


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vecs"], np.float64 if row["wide"] else np.float32).reshape(row["n"], row["dim"])


def products(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Exact inner products as float64, or as objects (integers within a long) where those would not be exact with a place appended."""
    dim = min(queries.shape[1], block.shape[1])
    q, c = queries[:, :dim], block[:, :dim]
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, dim)
    if bound < EXACT_32:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    if bound * 2 * BLOCK < EXACT_64:
        return q.astype(np.float64) @ c.astype(np.float64).T
    whole = lambda m: np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape)
    scores = whole(q) @ whole(c).T if dim else np.zeros((len(q), len(c)), dtype=object)
    return np.array([[max(LEAST, min(MOST, int(x))) for x in r] for r in scores], dtype=object).reshape(len(q), len(c))


class Cell:
    """The queries of one group with their best ``k`` so far, as (-score, id) in order."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, list[list[tuple[int, int]]]]] = []

    def add(self, block: int, ids: np.ndarray, vecs: np.ndarray) -> None:
        for at in range(0, len(ids), PART):
            part = ids[at : at + PART]
            self.parts.append((block * BLOCK + np.arange(at, at + len(part)), part, vecs[at : at + PART], [[] for _ in part]))

    def see(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        """One tile for each part of the queries; ``ids`` ascend."""
        for _, own, queries, best in self.parts:
            scores = products(queries, vecs)
            self._select(scores, own, ids, best)

    def _select(self, scores: np.ndarray, own: np.ndarray, ids: np.ndarray, best: list) -> None:
        n, k = len(ids), min(self.k, len(ids))
        low, high = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
        exact = scores.dtype != object
        if exact:
            for i in np.flatnonzero(high > low):
                scores[i, low[i] : high[i]] = -np.inf
            kth = np.array([-b[-1][0] if len(b) == self.k else -np.inf for b in best], dtype=np.float64)
            rows = np.flatnonzero((scores.max(axis=1) >= kth) & (scores.max(axis=1) > -np.inf))
            # a score with its place appended: places ascend by id, so all values differ and ties go to the smaller id
            ranked = scores[rows] * n + np.arange(n - 1, -1, -1)
            tops = np.argpartition(ranked, n - k, axis=1)[:, n - k :]
        else:
            rows = range(len(own))
            tops = ([*sorted((j for j in range(n) if not low[i] <= j < high[i]), key=lambda j: (-scores[i, j], j))[:k]] for i in rows)
        for i, top in zip(rows, tops, strict=True):
            found = [(-int(scores[i, j]), int(ids[j])) for j in top if not low[i] <= j < high[i]]
            best[i] = sorted(best[i] + found)[: self.k]

    def results(self) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        for rows, own, _, best in self.parts:
            yield from zip(rows.tolist(), own.tolist(), best, strict=True)


TOP = pa.list_(pa.struct([("rev", pa.int64()), ("vec_id", pa.int64())]))
CELLS = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("shard", pa.int64()), ("top", TOP)])


def cell_lists(tiles: DataFrame, k: int) -> DataFrame:
    """The top list of each query in each cell; queries (``side`` 0) come before the shard's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, shard = None, None

        def done(cell: Cell | None, shard: int | None) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            for row, query, best in cell.results() if cell else ():
                held.append((row, query, shard, [{"rev": minus - 1, "vec_id": i} for minus, i in best]))
                if len(held) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), CELLS, strict=True)], schema=CELLS)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), CELLS, strict=True)], schema=CELLS)

        for begins, piece in runs(batches, ["group", "shard"]):
            if begins:
                yield from done(cell, shard)
                cell, shard = Cell(k), piece.column(1)[0].as_py()
            for j in range(piece.num_rows):
                row = piece.slice(j, 1).to_pylist()[0]
                cell.see(*unpacked(row)) if row["side"] else cell.add(row["block"], *unpacked(row))
        yield from done(cell, shard)

    ship(tiles.sparkSession)
    return tiles.mapInArrow(run, "row long, query_id long, shard long, top array<struct<rev: long, vec_id: long>>")


def merged(lists: DataFrame, shards: int, k: int) -> DataFrame:
    """One list a query: ``FAN`` lists meet at a time."""
    while shards > 1:
        groups = lists.groupBy("row", "query_id", F.floor(F.col("shard") / FAN).alias("shard"))
        lists = groups.agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))  # at most FAN lists of k
        shards = -(-shards // FAN)
    return lists


def top_k(vectors: DataFrame, is_query: Column, k: int, scratch: Scratch, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """The ``k`` highest integer inner products of each query row (``is_query``, a condition on ``id``) with all other rows: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    blocks = scratch.keep(pack(rows, scale))
    asked = scratch.keep(pack(rows.where(is_query), scale))
    n, n_blocks = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("n")).first()
    n_asked = asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = max(1, -(-n_asked // GROUP_ROWS))
    shards = max(1, min(n_blocks, max(-(-n // SHARD_ROWS), -(-spark.sparkContext.defaultParallelism // groups))))
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    of = lambda m: F.pmod(F.xxhash64("block"), F.lit(m)).cast("int")
    left = asked.select(of(groups).alias("group"), numbers(shards).alias("shard"), F.lit(0).alias("side"), *blocks.columns)
    right = blocks.select(numbers(groups).alias("group"), of(shards).alias("shard"), F.lit(1).alias("side"), *blocks.columns)
    cells = left.unionByName(right).repartition(2 * groups * shards, "group", "shard").sortWithinPartitions("group", "shard", "side", "block")
    tops = merged(cell_lists(cells, k), shards, k)
    ranked = tops.select("query_id", F.posexplode("top").alias("at", "one"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), F.bitwise_not(F.col("one.rev")).alias("score"))
