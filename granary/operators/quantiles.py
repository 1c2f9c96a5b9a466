"""Exact order statistics of groups of any size: selection by refining ranges of values.

A pass counts a group's values by ``BUCKETS`` ranges between its bounds; only the range that holds the wanted rank goes
into the next pass, with its own bounds. Ranges are equally wide, or equally wide in log(1 + |x|), in turn, so
neither outliers nor many magnitudes cost more than a few passes; after ``PASSES`` what is left is ranked by range-split
running counts. What travels are counts of ranges, combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import Scratch
from .ranges import running_sums
from .skew import HOT

#: Ranges of one pass; groups up to this size are ranked at once; passes before what is left is sorted.
BUCKETS, SMALL, PASSES = 1024, 100_000, 6


def _magnitude(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def _at_ranks(rows: DataFrame, wanted: DataFrame, scratch: Scratch, n: int) -> DataFrame:
    """``key, rank, value``: the values at the ranks (from 0) of ``wanted`` (key, rank; at most ``HOT`` keys) within the hot groups of ``rows`` (key, value)."""
    bounds = rows.join(F.broadcast(wanted.select("key").distinct()), "key").groupBy("key").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    state = scratch.cut(wanted.join(bounds, "key").select("key", "rank", F.col("rank").alias("left"), "lo", "hi"))
    found = state.where("lo = hi")
    for k in range(PASSES):
        state = scratch.cut(state.where("lo < hi"))
        if state.isEmpty():
            break
        inside = rows.join(F.broadcast(state), "key").where("value >= lo and value <= hi")
        scale = _magnitude if k % 2 else (lambda x: x)
        # the halves' difference cannot overflow; a share that isn't a number (equal magnitudes) is one range
        share = F.try_divide(scale(F.col("value")) / 2 - scale(F.col("lo")) / 2, scale(F.col("hi")) / 2 - scale(F.col("lo")) / 2)
        bucket = F.least(F.lit(BUCKETS - 1), F.floor(F.coalesce(share, F.lit(0.0)) * BUCKETS))
        counts = inside.withColumn("bucket", bucket).groupBy("key", "rank", "left", "bucket").agg(F.count(F.lit(1)).alias("c"), F.min("value").alias("low"), F.max("value").alias("high"))
        upto = F.sum("c").over(Window.partitionBy("key", "rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))  # at most BUCKETS rows
        chosen = counts.withColumn("upto", upto).where("left < upto and left >= upto - c")
        state = scratch.cut(chosen.select("key", "rank", (F.col("left") - (F.col("upto") - F.col("c"))).alias("left"), F.col("low").alias("lo"), F.col("high").alias("hi")))
        found = found.unionByName(state.where("lo = hi"))
    found = found.select("key", "rank", F.col("lo").alias("value"))
    state = state.where("lo < hi")
    if not state.isEmpty():
        inside = rows.join(F.broadcast(state), "key").where("value >= lo and value <= hi").groupBy("key", "rank", "left", "value").agg(F.count(F.lit(1)).alias("c"))
        ranked = running_sums(inside, ["key", "rank"], [F.col("value")], ["c"]).where("left < c_upto and left >= c_upto - c")
        found = found.unionByName(ranked.select("key", "rank", "value"))
    return found


def quantiles(rows: DataFrame, key: str, value: str, p: float, name: str = "value") -> DataFrame:
    """``key`` and the interpolated quantile of ``value`` at ``p`` (as ``percentile`` has it), exact; nulls don't count, null keys are a group.

    Groups of at most ``SMALL`` rows, or a 1 / ``HOT`` share, are aggregated as usual; larger ones, at most ``HOT``, by selection.
    """
    with Scratch(rows.sparkSession) as scratch:
        own = scratch.cut(rows.select(F.col(key).alias("key"), F.col(value).cast("double").alias("value")).where("value is not null"))
        sizes = scratch.cut(own.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
        limit = max(SMALL, (sizes.agg(F.sum("n")).first()[0] or 0) // HOT)
        hot = scratch.cut(sizes.where(F.col("n") > limit).withColumn("id", F.monotonically_increasing_id()))
        if hot.isEmpty():
            return scratch.keep(own.groupBy(F.col("key").alias(key)).agg(F.percentile("value", p).alias(name)))
        # at most HOT groups: broadcast; their number stands for a key that may be null
        same = F.col("key").eqNullSafe(F.col("_k"))
        marked = scratch.cut(own.join(F.broadcast(hot.select(F.col("key").alias("_k"), "id")), same, "left").select("key", "value", "id"))
        small = marked.where("id is null").groupBy("key").agg(F.percentile("value", p).alias("value"))
        at = (F.col("n") - 1) * p
        ranks = hot.select(F.col("id").alias("key"), F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("rank"))
        picked = _at_ranks(marked.where("id is not null").select(F.col("id").alias("key"), "value"), scratch.cut(ranks), scratch, limit)
        pairs = picked.groupBy(F.col("key").alias("id")).agg(F.min_by("value", "rank").alias("low"), F.max_by("value", "rank").alias("high"))
        part = at - F.floor(at)
        large = hot.join(pairs, "id").select("key", ((1 - part) * F.col("low") + part * F.col("high")).alias("value"))
        return scratch.keep(small.unionByName(large).select(F.col("key").alias(key), F.col("value").alias(name)))
