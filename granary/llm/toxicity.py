"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Lower-cased texts are read as UTF-8 bytes, each run of other bytes than ASCII letters and
non-ASCII letters counting as one space, and hashed into ``2 ** bits`` buckets for each n of
``sizes``. A feature is a bucket's presence in a text. For each bucket the log-count ratio r
of the two classes is estimated with one document of smoothing; buckets whose ratio is not
significant (``z`` standard errors), or that fewer than ``least_documents`` labelled documents have, get weight 0, all others enter a logistic regression as
r, so that the weight of a bucket is its r times a learned coefficient. A row of the rarer
class counts by the fourth root of the classes' ratio.

Labelled rows are read up to ``max_labelled`` of them, those with the smallest hash of their
id (a documented bound; the statistics of the fit need no more), split by
crc32(doc_id) % folds, of which fold 0 is never learned from. Labels count only if a document
has their id. An id that several documents have is learned once, by its least text; one with
several labels by its greatest. Ids can be of any type; null ids and null labels teach nothing.
Nothing but the text enters a score. A null text is scored as an empty one. Without rows of
both classes the score is the prior (0.0 if there is no label at all). Every row is scored,
repeated ones alike; an empty table gives an empty result.

The labelled rows' buckets are written once. The driver holds the counts of 2 ** ``bits``
buckets at the most, and 4 bytes for each significant bucket of each labelled row.
"""

from __future__ import annotations

import contextlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from .rows import map_rows, pick, release_loaded

GAP = re.compile(r"[\W\d_]+")
#: Features of the fit that are worked on at a time.
CHUNK = 1_000_000
#: The labelled rows' buckets are long arrays: an Arrow batch of them holds so many bytes, whatever its rows.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
LEARNED_BYTES = 4 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most ``LEARNED_BYTES`` for what is run in the block."""
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(LEARNED_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


@dataclass(frozen=True)
class Settings:
    sizes: tuple[int, ...] = (4, 5, 6)
    bits: int = 20
    z: float = 3.5
    least_documents: int = 5
    max_labelled: int = 12_000
    folds: int = 5
    l2: float = 1e-4
    rounds: int = 800


def buckets(text: str, settings: Settings) -> np.ndarray:
    """Bucket numbers of all n-grams, with repeats."""
    data = np.frombuffer((" " + GAP.sub(" ", text.lower()).strip() + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    out = []
    h = np.full(len(data), 2166136261, np.uint32)
    for n in range(1, max(settings.sizes) + 1):
        if len(data) < n:
            break
        h = (h[: len(data) - n + 1] ^ data[n - 1 :]) * np.uint32(16777619)
        if n in settings.sizes:
            x = (h ^ np.uint32(n * 0x9E3779B1 % 2**32)) * np.uint32(0x85EBCA6B)
            out.append((x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - settings.bits))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class Model:
    settings: Settings
    bias: float
    weights: np.ndarray  # float32, 2 ** bits

    def margin(self, text: str) -> float:
        found = buckets(text, self.settings)
        values = self.weights[found]
        return self.bias + float(self.weights[np.unique(found[values != 0])].sum(dtype=np.float64))


def fold(id_col: str, folds: int) -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def train(df: DataFrame, labels: DataFrame, settings: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from ``labels`` (``doc_id`` and ``label_col``) of the documents ``df``; see above for nulls and repeats."""
    with small_batches(df.sparkSession):
        return _train(df, labels, settings, id_col, text_col, label_col)


def _train(df: DataFrame, labels: DataFrame, settings: Settings, id_col: str, text_col: str, label_col: str) -> Model:
    docs = pick(df, id_col, text_col)
    kind = dict(docs.dtypes)["doc_id"]
    known = (
        labels.select("doc_id", F.col(label_col).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold("doc_id", settings.folds) != 0))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.max_labelled)
    )
    # at most max_labelled ids and labels: some 200 KB, whatever the input
    rows = docs.join(F.broadcast(cut(known)), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def make():
        release_loaded()

        def step(row: dict) -> Iterator[tuple]:
            yield row["doc_id"], row["y"], np.unique(buckets(row["text"], settings)).astype(np.int32)

        return step

    features = cut(map_rows(rows, make, f"doc_id {kind}, y int, f array<int>"))
    n = {r["y"]: r["count"] for r in features.groupBy("y").count().collect()}
    weights = np.zeros(1 << settings.bits, np.float32)
    if min(n.get(0, 0), n.get(1, 0)) == 0:
        return Model(settings, 40.0 if n.get(1, 0) else -40.0, weights)
    sums = features.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    p, q = F.col("p") + F.lit(0.5), F.col("q") + F.lit(0.5)
    ratio = F.log(p / (n[1] + 1)) - F.log(q / (n[0] + 1))
    error = F.sqrt(1 / p + 1 / q - F.lit(1 / (n[1] + 1) + 1 / (n[0] + 1)))
    # one row per bucket at most: bounded by 2 ** bits
    kept = sums.where((F.col("p") + F.col("q") >= settings.least_documents) & (F.abs(ratio) > settings.z * error)).select("f", ratio.alias("r")).toArrow()
    index, r = kept["f"].to_numpy(), kept["r"].to_numpy()
    order = np.argsort(index)
    index, r = index[order], r[order]
    shared = df.sparkSession.sparkContext.broadcast(index)  # 4 bytes a bucket

    def look_up():
        own = shared.value

        def step(row: dict) -> Iterator[tuple]:
            place = np.searchsorted(own, np.array(row["f"], np.int32))
            place = place[place < len(own)]
            found = np.array(row["f"], np.int32)[: len(place)] == own[place]  # both ascend: what is cut off is beyond all
            yield row["doc_id"], row["y"], place[found].astype(np.int32)

        return step

    # flat Arrow columns, no Python objects
    table = map_rows(features, look_up, f"doc_id {kind}, y int, c array<int>").toArrow()
    lists = table["c"].combine_chunks()
    col, offsets, y = lists.flatten().to_numpy(), lists.offsets.to_numpy(), table["y"].to_numpy().astype(np.float64)
    # summed in order of the ids, whatever order the rows come in
    order = pc.sort_indices(table["doc_id"]).to_numpy()
    starts, sizes = offsets[:-1][order], np.diff(offsets)[order]
    ends = np.cumsum(sizes)
    col = col[np.arange(len(col)) + np.repeat(starts - (ends - sizes), sizes)] if len(col) else col
    beta, bias = fit(col, np.append(0, ends), y[order], r, settings)
    weights[index] = beta * r
    return Model(settings, bias, weights)


def fit(col: np.ndarray, ends: np.ndarray, y: np.ndarray, r: np.ndarray, settings: Settings) -> tuple[np.ndarray, float]:
    """Logistic regression on features r, by accelerated gradient steps from coefficient 0; deterministic.

    Row i has the features ``col[ends[i] : ends[i + 1]]``. Rows are taken a few at a time, so that nothing but ``col``
    grows with their number.
    """
    m, d = len(y), len(r)
    share = np.where(y > 0, max(1.0, (y == 0).sum() / (y > 0).sum()) ** 0.25, max(1.0, (y > 0).sum() / (y == 0).sum()) ** 0.25)
    share /= share.sum()
    parts = []
    begin = 0
    while begin < m:
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + CHUNK, "right")) - 1)
        own = col[ends[begin] : ends[end]]
        parts.append((slice(begin, end), own, ends[begin : end + 1] - ends[begin]))
        begin = end

    def row_sums(values: np.ndarray, own: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0.0, np.cumsum(values[own]))[at])

    largest = 0.0
    for _, own, at in parts:
        largest = max(largest, row_sums(r**2, own, at).max(initial=0))
    rate = 4.0 / (m * share.max() * largest + 1)
    w = np.zeros(d + 1)
    v = w.copy()
    for t in range(settings.rounds):
        grad = np.append(settings.l2 * v[:d], 0.0)
        effect = v[:d] * r
        for rows, own, at in parts:
            margin = row_sums(effect, own, at) + v[d]
            g = share[rows] * (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y[rows])
            grad[:d] += np.bincount(own, np.repeat(g, np.diff(at)), d) * r
            grad[d] += g.sum()
        step = v - rate * grad
        v = step + t / (t + 3) * (step - w)
        w = step
    return w[:d], float(w[d])


def score(df: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # 4 bytes a bucket

    def make():
        release_loaded()
        known = shared.value

        def step(row: dict) -> Iterator[tuple]:
            s = 1 / (1 + np.exp(-min(50.0, max(-50.0, known.margin(row["text"])))))
            yield row["doc_id"], float(s), int(s >= 0.5)

        return step

    kind = dict(df.dtypes)[id_col]
    return map_rows(pick(df, id_col, text_col), make, f"doc_id {kind}, score double, predicted int")


def drop_toxic(df: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with their columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    columns = df.columns

    def make():
        release_loaded()
        known = shared.value

        def step(row: dict) -> Iterator[tuple]:
            if known.margin(row[text_col] or "") < 0:
                yield tuple(row[c] for c in columns)

        return step

    return map_rows(df, make, ", ".join(f"`{n}` {t}" for n, t in df.dtypes))
