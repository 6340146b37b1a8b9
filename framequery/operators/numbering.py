"""Rows numbered in a global order without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequery.streaming.shared import written

#: monotonically_increasing_id: the partition above, the row in it below.
ROW_BITS = 33


def numbered(df: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """``df`` with each row's place in the order, from 1.

    Range partitions are sorted side by side; a row's place is its place in the
    partition plus the rows of all partitions before, one number for each.  The order
    has to tell rows apart, or rows that are equal in it take places at random.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(ranged.withColumn("_id", F.monotonically_increasing_id()), "ranged")
    part, at = F.shiftright("_id", ROW_BITS), F.col("_id").bitwiseAND((1 << ROW_BITS) - 1)
    sizes = rows.groupBy(part.alias("_part")).agg((F.max(at) + 1).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # a row a partition
    placed = rows.withColumn("_part", part).join(F.broadcast(base), "_part")
    return placed.withColumn(name, F.col("_base") + at + 1).drop("_id", "_part", "_base")


def running_sums(df: DataFrame, group: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """``df`` with its columns ``sums`` replaced by their totals so far in the
    ``group`` by ``order``, rows of equal order in any.  Rows are dealt by ranges of
    both, so no group lies in one task; what a group has in the ranges before is added.
    """
    dealt = df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id())
    placed = written(dealt, "ranges")
    inner = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumns({c: F.sum(c).over(inner) for c in sums})
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    each = placed.groupBy("_part", *group).agg(*[F.sum(c).alias(c) for c in sums])
    carried = each.select("_part", *group, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    carried = carried.where(F.greatest(F.lit(0), *[F.abs(f"_{c}") for c in sums]) > 0)
    out = own.join(F.broadcast(carried) if not group else carried, ["_part", *group], "left")
    return out.withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in sums}).drop("_part", *[f"_{c}" for c in sums])
