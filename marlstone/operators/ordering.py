"""Total orders over distributed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import stored


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with row numbers from 1 in a total order, without one task for all rows.

    Rows are dealt into ranges and numbered inside them; the sizes of the ranges before are added.
    """
    dealt = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").count()  # a row for each range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_inside", inside).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_inside") + F.col("_before")).drop("_part", "_inside", "_before")


def running_total(df: DataFrame, name: str, value: str, keys: list[str], *order: str) -> DataFrame:
    """df with the sum of `value` over the rows before it in its group, for groups of any size.

    Rows are dealt into ranges of (keys, order); sums of whole ranges are added up per group, so a
    hot group is sorted by many tasks.
    """
    dealt = stored(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))  # rows: groups plus ranges
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*keys, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    same = [placed[k].eqNullSafe(offsets[k]) for k in [*keys, "_part"]]
    joined = placed.join(offsets, same).select(*[placed[c] for c in placed.columns], offsets["_before"])
    return joined.withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def previous(df: DataFrame, name: str, value: str, keys: list[str], *order: str) -> DataFrame:
    """df with the value of the row before it in its group, null for the first, for groups of any size.

    Rows are dealt into ranges of (keys, order); a range's first row of a group takes the last value of the group's range
    before it, so a hot group is sorted by many tasks.
    """
    dealt = stored(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    ends = dealt.groupBy(*keys, "_part").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))  # rows: groups plus ranges
    carried = ends.select(*keys, "_part", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_part")).alias("_carried"))
    own = F.lag(F.struct(value)).over(Window.partitionBy(*keys, "_part").orderBy(*order))
    placed = dealt.withColumn("_own", own)
    same = [placed[k].eqNullSafe(carried[k]) for k in [*keys, "_part"]]
    joined = placed.join(carried, same).select(*[placed[c] for c in placed.columns], carried["_carried"])
    return joined.withColumn(name, F.coalesce("_own", "_carried")[value]).drop("_part", "_own", "_carried")
