"""Running sums over groups of any size: ranges of (group, order) first, then one offset per range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut


def running_sums(rows: DataFrame, keys: list[str], order: list[Column], amounts: list[str]) -> DataFrame:
    """``rows`` with ``<amount>_upto`` (the sum to and with the row, in ``order`` within its group) and ``<amount>_all`` (the group's sum).

    Without ``keys`` all rows are one group. No task sees a whole group, however hot. ``order`` must be unique within a group. The ranges are written, as sampled
    bounds may differ from one reading to the next.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # a group has at most one sum per range
    sums = ranged.groupBy(*keys, "_part").agg(*(F.sum(a).alias(f"_s_{a}") for a in amounts))
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_part").alias("_p"),
        *(F.coalesce(F.sum(f"_s_{a}").over(earlier), F.lit(0)).alias(f"_b_{a}") for a in amounts), *(F.sum(f"_s_{a}").over(whole).alias(f"{a}_all") for a in amounts),
    )
    own = ranged.select("*", *(F.sum(a).over(local).alias(f"_o_{a}") for a in amounts))
    on = [F.col("_part") == F.col("_p"), *(F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys)]
    return own.join(offsets if keys else F.broadcast(offsets), on).select(*rows.columns, *((F.col(f"_o_{a}") + F.col(f"_b_{a}")).alias(f"{a}_upto") for a in amounts), *(f"{a}_all" for a in amounts))
