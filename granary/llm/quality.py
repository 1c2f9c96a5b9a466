"""Quality rules and a hashed n-gram likelihood ratio, in DataFrame expressions alone.

Base figures are counts on a text's words, lines and three-word windows. The verdict is a
length-normalised log-likelihood ratio: tokens (runs of letters, digits and non-ASCII
characters, and runs of other visible ones, lower-cased) and pairs of neighbours are hashed into
``buckets``; two multinomials over the buckets, of the trusted documents and of the whole
corpus, give each bucket a log ratio; a text's score is the mean over its n-grams. It is
kept if no base rule fails and the score is at least ``threshold``.

Every document is counted, and none but the bucket table (fixed size) leaves the executors.
A null text has no words: base_failed. If no document is trusted, all ratios are 0 and the
base rules decide alone. A document that several trusted rows name counts once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trusted ids up to this number are broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
SPACES = "[\\x20\\x09-\\x0D]+"
#: Letters, digits and all beyond ASCII, or else other visible ASCII characters.
TOKEN = "[0-9A-Za-z\\x80-\\x{10FFFF}]+|[!-/:-@\\[-`{-~]+"


@dataclass(frozen=True)
class Settings:
    buckets: int = 10_000
    threshold: float = -0.2
    least_words: int = 50
    repeat_percent: int = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates ``value`` once per row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(text, SPACES, " "), " "), "")


def repeat_words(w: Column) -> Column:
    """Words that lie in a three-word window which occurs at least twice.

    Windows are compared by 64-bit hashes of their words. Texts without a repeat are told by a hash set;
    in others, windows are sorted by hash, so the work is n log n.
    """
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def repeated(s: Column) -> Column:
        same = F.filter(s, lambda e, i: F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)) | F.coalesce((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["h"] == e["h"]), F.lit(False)))
        return let(F.array_sort(F.transform(same, lambda e: e["i"])), covered)

    def check(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(pairs), repeated))

    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(hashes, check))


def neighbours(text: Column) -> Column:
    """Each token with the one behind it (null for the last)."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return let(tokens, lambda t: F.arrays_zip(t.alias("a"), F.slice(t, F.lit(2), F.size(t)).alias("b")))


def bucket(buckets: int, *tokens: str) -> Column:
    return F.pmod(F.xxhash64(*tokens), F.lit(buckets)).cast("int")


def log_ratios(df: DataFrame, trusted: DataFrame, settings: Settings) -> list[float]:
    """One log ratio per bucket, from counts over all documents; ``trusted`` has one column ``doc_id``."""
    ids = trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("is_target", F.lit(True))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    n = settings.buckets
    pairs = df.join(ids, "doc_id", "left").select("is_target", F.inline(neighbours(F.col("text"))).alias("a", "b"))
    both = F.when(F.col("b").isNull(), F.array(bucket(n, "a"))).otherwise(F.array(bucket(n, "a"), bucket(n, "a", "b")))
    rows = pairs.select("is_target", F.explode(both).alias("b"))
    found = rows.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count("is_target").alias("target")).collect()  # one row a bucket
    raw, target = np.zeros(settings.buckets), np.zeros(settings.buckets)
    for b, r, t in found:
        raw[b], target[b] = r, t
    if not target.sum():
        return [0.0] * settings.buckets
    ratio = np.log((target + 1) / (target.sum() + settings.buckets)) - np.log((raw + 1) / (raw.sum() + settings.buckets))
    return [round(float(x), 9) for x in ratio]


def quality(df: DataFrame, trusted: DataFrame, settings: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the base figures, ``base_failed``, ``kept`` and ``score`` of every row."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ratios = log_ratios(docs, trusted, settings)
    # a constant: folded once into an array of doubles
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    from_words = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).cast("long").alias("n_repeat_words")
        ),
    )
    out = docs.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),  # rows of one id stay apart; partitions and their order are those of the input files
        from_words.alias("w"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        neighbours(text).alias("tokens"),
    )
    figures = ["doc_id", "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = out.select("doc_id", "row", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", F.inline_outer("tokens").alias("a", "b"))
    # A row's tokens stand together in one partition: they are summed there, in order, before the shuffle of one row per document.
    one, two = table[bucket(settings.buckets, "a")], table[bucket(settings.buckets, "a", "b")]
    ratio = F.when(F.col("a").isNull(), 0.0).when(F.col("b").isNull(), one).otherwise(one + two)
    size = F.when(F.col("a").isNull(), 0).when(F.col("b").isNull(), 1).otherwise(2)
    out = out.groupBy(*figures).agg(F.sum(ratio).alias("ratio"), F.sum(size).alias("size"))
    out = out.withColumn("score", F.round(F.col("ratio") / F.greatest("size", F.lit(1)), 6))
    failed = (F.col("n_words") < settings.least_words) | (100 * F.col("n_repeat_words") > settings.repeat_percent * F.col("n_words"))
    return out.select(*(c for c in figures if c != "row"), failed.alias("base_failed"), (~failed & (F.col("score") >= settings.threshold)).alias("kept"), "score")
