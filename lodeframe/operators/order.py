"""Places and running totals in a global order, without one task that sorts everything."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.sources.scratch import written


def cumulated(df: DataFrame, order: Sequence[str | Column], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """df with, for each of sums, its total over the rows up to this one; order has no ties.

    Rows are cut to ranges of the order, written, and summed within each; the ranges' totals
    are as few as the ranges and are all that one task sees in order.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = written(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("__part").agg(*(F.sum(c).alias(f"__{k}") for k, c in sums.items()))
    totals = totals.select("__part", *(F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in sums))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranges.join(F.broadcast(totals), "__part")
    return out.withColumns({k: F.col(f"__{k}") + F.sum(c).over(within) for k, c in sums.items()}).drop("__part", *(f"__{k}" for k in sums))


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "place") -> DataFrame:
    """df with the row's place in the order, from 1."""
    return cumulated(df, order, {name: F.lit(1).cast("long")})
