"""Joins that stay even when a third of the rows has one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Groups with more than 1 / HOT of the rows are hot; so there are at most HOT of them.
HOT = 2000
#: Smaller groups are never hot.
LEAST = 64


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n: int, size: str = "size") -> DataFrame:
    """``rows`` with the columns of ``groups``, a cut table of one row per key with the number of its rows in ``size``.

    ``n`` is the number of rows. The hot groups, at most ``HOT`` rows, are broadcast and their rows stay where they
    are; the others are joined by shuffle. Rows whose key is null or has no group are dropped.
    """
    limit = max(LEAST, n // HOT)
    hot = [r[0] for r in groups.where(F.col(size) > limit).select(key).collect()]  # HOT keys at most
    if not hot:
        return rows.join(groups.hint("merge"), key)  # the same plan at every size
    is_hot = F.col(key).isin(hot)
    own = rows.where(is_hot).join(F.broadcast(groups.where(F.col(size) > limit)), key)
    return own.unionByName(rows.where(~is_hot).join(groups.where(F.col(size) <= limit).hint("merge"), key))


def with_groups(rows: DataFrame, key: str, n: int, scratch: Scratch, least: int = 1, **figures: Column) -> DataFrame:
    """Each row of a group of ``least`` or more with ``figures`` of its group, and the group's ``size``; cut ``rows`` before."""
    groups = rows.groupBy(key).agg(F.count(F.lit(1)).alias("size"), *(v.alias(k) for k, v in figures.items()))
    return join_groups(rows, scratch.cut(groups.where(F.col("size") >= least)), key, n)


def lookup(rows: DataFrame, unique: DataFrame, key: str, n: int) -> DataFrame:
    """``rows`` with the columns of ``unique`` (one row per ``key``), nulls where it has none: a left join for keys that may be hot, or null, in ``rows``.

    ``n`` is the number of rows. The entries of hot keys, at most ``HOT`` of them, are broadcast; rows without a key take part in no join.
    """
    limit = max(LEAST, n // HOT)
    known = rows.where(F.col(key).isNotNull())
    hot = [r[0] for r in known.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(key).collect()]  # HOT keys at most
    extra = [f for f in unique.schema if f.name != key]
    out = rows.where(F.col(key).isNull()).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in extra))
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    out = out.unionByName(known.where(~is_hot).join(unique.hint("merge"), key, "left"))
    return out.unionByName(known.where(is_hot).join(F.broadcast(unique.where(F.col(key).isin(hot))), key, "left")) if hot else out
