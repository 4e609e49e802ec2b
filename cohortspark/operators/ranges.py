"""Places and running sums in a total order, without any task that reads all rows.

Rows are dealt out by ranges of the order and written, so that every later pass
sees the same ranges; what lies before a range is known from one small
aggregate.  Up to ``ONE_SORT`` rows (counted first) one sorted window does the
same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import saved

ONE_SORT = 1_000_000


def _dealt(rows: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    return saved(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")


def numbered(rows: DataFrame, *order: str | Column, one_sort: int = ONE_SORT) -> DataFrame:
    """``rows`` with ``number``: the place in the order, from 0; rows that are equal in it get places in any order."""
    if rows.count() <= one_sort:
        return rows.withColumn("number", F.row_number().over(Window.orderBy(*order)) - 1)
    dealt = _dealt(rows, order)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_place", place).join(F.broadcast(before), "_range").withColumn("number", (F.col("_before") + F.col("_place")).cast("int")).drop("_range", "_place", "_before")


def running_sums(rows: DataFrame, group: str, order: str, amount: str, one_sort: int = ONE_SORT) -> DataFrame:
    """``rows``, one for each value of ``order`` within a group, with ``running`` (the group's sum of ``amount`` up to the row) and ``whole`` (the group's sum)."""
    within = Window.partitionBy(group)
    if rows.count() <= one_sort:
        return rows.withColumn("running", F.sum(amount).over(within.orderBy(order))).withColumn("whole", F.sum(amount).over(within))
    dealt = _dealt(rows, (group, order))
    sizes = dealt.groupBy(group, "_range").agg(F.sum(amount).alias("_n"))
    before = sizes.select(group, "_range", F.coalesce(F.sum("_n").over(within.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(within).alias("whole"))
    here = F.sum(amount).over(Window.partitionBy("_range", group).orderBy(order))
    before = before.select(F.col(group).alias("_group"), F.col("_range").alias("_at"), "_before", "whole")  # ranges times groups that begin or end in one
    joined = dealt.withColumn("_here", here).join(F.broadcast(before), F.col("_group").eqNullSafe(F.col(group)) & (F.col("_range") == F.col("_at")))
    return joined.withColumn("running", F.col("_before") + F.col("_here")).select(*rows.columns, "running", "whole")
