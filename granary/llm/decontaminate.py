"""Benchmark decontamination by SimHash over item-sized windows.

For each benchmark item, the windows of a document that have as many words as the item get
a ``bits``-bit SimHash of their weighted five-word shingles. Fingerprints are cut into blocks of 32
bits; an item is a candidate for a window if some block differs by no more than
``radius`` / blocks bits (by the pigeonhole principle, no fingerprint within the radius is
missed), then if the whole fingerprints are within ``radius``. A block is looked up through tables of its four
bytes, of which one differs by no more than a quarter of the block's bits. Candidates are decided by
the exact weighted Jaccard similarity of their shingles (weights: occurrences).

At similarity 0.8 two fingerprints of 768 bits differ by 116 bits on average, with a standard
deviation of 10: the radius of 166 is five deviations away. Of unrelated fingerprints 0.6 % share a near
block. Windows that share no shingle with any item have similarity 0 and get no fingerprint.

Items with fewer than five words are one shingle of all their words; items without words and
null texts match nothing; a document shorter than an item is compared whole. Equal items are
reported each by its id; items with a null id are reported with a null id. There is one row for each pair of
document id and item id: rows that repeat an id, or have none, are put together, with the best similarity and of equal
ones the first word. Ids can be of any type; only the id and the text are read, so other columns can't clash. An
empty table or benchmark gives an empty result. The benchmark is the stated query set: it is read in blocks of at
most ``block_bytes`` of text, and each block (a bounded size) is broadcast against all rows.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import SHINGLE, Shingler, map_rows, mix, pick


@dataclass(frozen=True)
class Settings:
    bits: int = 768
    radius: int = 166
    similarity: float = 0.8
    block_bytes: int = 8_000_000


def signs(shingles: np.ndarray, bits: int) -> np.ndarray:
    """One row of +1 and -1 per shingle."""
    words = [mix(shingles + np.uint64((k + 1) * 0xD1342543DE82EF95 % 2**64)) for k in range(bits // 64)]
    raw = np.ascontiguousarray(np.stack(words, 1)).view(np.uint8)
    return np.unpackbits(raw, axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


class Blocks:
    """Fingerprints (rows of bytes), found again from any that has a near block."""

    def __init__(self, prints: np.ndarray, settings: Settings) -> None:
        self.words = np.ascontiguousarray(prints).view(np.uint32)
        self.near = settings.radius // self.words.shape[1]
        byte = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :]) <= self.near // 4
        # per byte of a fingerprint: value -> items whose byte is near, a bit an item (3 KB an item in all)
        self.tables = [np.packbits(byte[:, prints[:, b]], axis=1) for b in range(prints.shape[1])]

    def candidates(self, prints: np.ndarray) -> np.ndarray:
        """Windows x items: whether some block is near."""
        words = np.ascontiguousarray(prints).view(np.uint32)
        found = np.zeros((len(prints), len(self.words)), bool)
        for b in range(words.shape[1]):
            some = self.tables[4 * b][prints[:, 4 * b]]
            for k in range(1, 4):
                some = some | self.tables[4 * b + k][prints[:, 4 * b + k]]
            w, i = np.nonzero(np.unpackbits(some, axis=1, count=len(self.words)).view(bool) & ~found)
            near = np.bitwise_count(words[w, b] ^ self.words[i, b]) <= self.near
            found[w[near], i[near]] = True
        return found


def weighted_similarity(a: Counter, b: Counter) -> float:
    shared = sum(min(n, b[x]) for x, n in a.items() if x in b)
    total = sum(a.values()) + sum(b.values()) - shared
    return shared / total if total else 0.0


class Index:
    """Items by (words in a shingle, words in a window)."""

    def __init__(self, items: list[tuple[int, str]], settings: Settings) -> None:
        self.settings, self.shingler = settings, Shingler()
        groups: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for item, text in items:
            words = self.shingler.words(text)
            if len(words):
                k = min(SHINGLE, len(words))
                groups[k][len(words)].append((item, self.shingler.shingles(words, k)))
        self.anchors = {k: np.unique(np.concatenate([s for g in sized.values() for _, s in g])) for k, sized in groups.items()}
        self.sizes: dict[int, dict[int, dict[int, set]]] = {}  # k -> shingle -> sizes of the items that have it
        self.items: dict[tuple[int, int], tuple] = {}
        for k, sized in groups.items():
            by = self.sizes.setdefault(k, defaultdict(set))
            for size, own in sized.items():
                for _, s in own:
                    for x in s.tolist():
                        by[x].add(size)
                prints = np.stack([self.fingerprints(s, np.array([0]), len(s))[0] for _, s in own])
                self.items[k, size] = ([i for i, _ in own], [Counter(s.tolist()) for _, s in own], prints, Blocks(prints, settings))

    def fingerprints(self, shingles: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
        """Packed SimHashes of the windows of ``width`` shingles that begin at ``starts``."""
        kind = np.int16 if len(shingles) < 1 << 15 else np.int32
        sums = np.zeros((len(shingles) + 1, self.settings.bits), kind)
        np.cumsum(signs(shingles, self.settings.bits), axis=0, dtype=kind, out=sums[1:])
        return np.packbits(sums[starts + width] > sums[starts], axis=1)

    def matches(self, text: str) -> list[tuple[int, float, int]]:
        """(item, similarity, first word) of the best window for each item that the text contains."""
        words = self.shingler.words(text)
        best: dict[int, tuple[float, int]] = {}
        for k, anchors in self.anchors.items():
            if len(words) < k:
                continue
            s = self.shingler.shingles(words, k)
            place = np.searchsorted(anchors, s)
            hits = np.flatnonzero(anchors[np.minimum(place, len(anchors) - 1)] == s)
            where = defaultdict(list)
            for at in hits.tolist():
                for size in self.sizes[k][int(s[at])]:
                    where[size].append(at)
            for size, at in where.items():
                self._windows(s, k, size, np.array(at), best)
        return [(i, v, at) for i, (v, at) in best.items()]

    def _windows(self, s: np.ndarray, k: int, size: int, hits: np.ndarray, best: dict) -> None:
        ids, counters, prints, index = self.items[k, size]
        width = min(size - k + 1, len(s))  # a short text is one window
        last = len(s) - width
        # all windows that hold a hit, in runs, so that sums are kept for one stretch at a time
        low, high = np.clip(hits - width + 1, 0, last), np.clip(hits, 0, last)
        runs = np.flatnonzero(np.append(True, low[1:] > np.maximum.accumulate(high)[:-1] + 1))
        for r, begin in enumerate(runs):
            end = (runs[r + 1] if r + 1 < len(runs) else len(hits)) - 1
            for first in range(int(low[begin]), int(high[end]) + 1, 2048):
                starts = np.arange(first, min(first + 2048, int(high[end]) + 1))
                part = s[first : int(starts[-1]) + width]
                own = self.fingerprints(part, starts - first, width)
                w, i = np.nonzero(index.candidates(own))
                far = np.bitwise_count(own[w] ^ prints[i]).sum(axis=1, dtype=np.int64)
                for x, y in zip(w[far <= self.settings.radius].tolist(), i[far <= self.settings.radius].tolist(), strict=True):
                    v = weighted_similarity(Counter(part[x : x + width].tolist()), counters[y])
                    if v >= self.settings.similarity - 1e-12 and v > best.get(ids[y], (0.0, 0))[0]:
                        best[ids[y]] = (v, int(starts[x]))


def blocks(benchmark: DataFrame, settings: Settings, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    items = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").distinct()
    size = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = 1 + int(size // settings.block_bytes)
    for b in range(n):
        yield sorted(((r["i"], r["t"]) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()), key=lambda x: (x[0] is not None, x[1], str(x[0])))


_LOADED: dict[str, Index] = {}


def loaded(name: str, items: list[tuple[int, str]], settings: Settings) -> Index:
    """One index per Python worker; each block of a benchmark has a name of its own."""
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = Index(items, settings)
    return _LOADED[name]


def contaminated(df: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``doc_id, item_id, similarity, first_word``: a row for each item that a document holds."""
    kind, item_kind = dict(df.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    out = None
    for items in blocks(benchmark, settings, item_col, "text"):
        shared, name = df.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def make(shared=shared, name=name):
            index = loaded(name, shared.value, settings)

            def step(row: dict) -> Iterator[tuple]:
                for item, v, at in index.matches(row["text"]):
                    yield row["doc_id"], item, v, at

            return step

        part = map_rows(pick(df, id_col, text_col), make, f"doc_id {kind}, item_id {item_kind}, similarity double, first_word int")
        out = part if out is None else out.unionByName(part)
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("back"))).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.similarity", (-F.col("best.back")).alias("first_word"))


def drop_contaminated(df: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), *, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows that hold no item, with their columns: one pass per block, without a join."""
    columns = df.columns
    for items in blocks(benchmark, settings, item_col, "text"):
        shared, name = df.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

        def make(shared=shared, name=name):
            index = loaded(name, shared.value, settings)

            def step(row: dict) -> Iterator[tuple]:
                if not index.matches(row[text_col] or ""):
                    yield tuple(row[c] for c in columns)

            return step

        df = map_rows(df, make, ", ".join(f"`{n}` {t}" for n, t in df.dtypes))
    return df
