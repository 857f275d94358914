"""Month grids with terms of office, events and crises."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def months(spark: SparkSession, start: str, end: str) -> DataFrame:
    """(year, month, first): all months between two dates."""
    grid = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "MM"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("first"))
    return grid.select(F.year("first").alias("year"), F.month("first").alias("month"), "first")


def terms_of_office(grid: DataFrame, terms: DataFrame) -> DataFrame:
    """The holder of each month; of overlapping terms the one that began later.

    terms: holder, side, start, end. first_year is 1 in a term's first twelve months.
    """
    inside = (F.col("first") >= F.trunc("start", "MM")) & (F.col("first") <= F.trunc("end", "MM"))
    joined = grid.join(F.broadcast(terms), inside, "left")
    latest = F.max_by(F.struct("holder", "side", "start"), "start")
    out = joined.groupBy("year", "month", "first").agg(latest.alias("t"))
    new = F.coalesce((F.col("first") <= F.add_months(F.trunc("t.start", "MM"), 11)).cast("int"), F.lit(0))
    return out.select("year", "month", "first", F.col("t.holder").alias("holder"), F.col("t.side").alias("side"), new.alias("first_year"))


def acting(grid: DataFrame, periods: DataFrame, name: str = "acting") -> DataFrame:
    """1 in months inside one of the periods (start, end)."""
    hit = grid.join(F.broadcast(periods), (F.col("first") >= F.trunc("start", "MM")) & (F.col("first") <= F.trunc("end", "MM")), "left_semi").select("year", "month", F.lit(1).alias(name))
    return grid.join(F.broadcast(hit), ["year", "month"], "left").fillna(0, [name])


def event_labels(grid: DataFrame, events: DataFrame, name: str, order: str = "seq") -> DataFrame:
    """The label of each month's last event, '' without one."""
    last = events.groupBy("year", "month").agg(F.max_by("label", order).alias(name))
    return grid.join(F.broadcast(last), ["year", "month"], "left").fillna("", [name])


def crises(grid: DataFrame, events: DataFrame, kinds: Sequence[str], severities: Sequence[int] = (1, 2, 3), topics: int = 17) -> DataFrame:
    """Flags of kind x severity and of affected topics, with any, count and highest severity.

    events: year, month, kind, severity, topics (an array); they count in their first month only.
    """
    joined = grid.select("year", "month").join(F.broadcast(events), ["year", "month"], "left")
    flag = lambda c: F.coalesce(F.max(F.when(c, 1).otherwise(0)), F.lit(0))
    return joined.groupBy("year", "month").agg(
        *(flag((F.col("kind") == k) & (F.col("severity") == s)).alias(f"{k}_{s}") for k in kinds for s in severities),
        flag(F.col("kind").isNotNull()).alias("crisis_any"), F.count("kind").alias("crisis_count"), F.coalesce(F.max("severity"), F.lit(0)).alias("crisis_severity"),
        *(flag(F.array_contains("topics", t)).alias(f"crisis_sdg_{t}") for t in range(1, topics + 1)),
    )


def affects(topic: Column, topics: int = 17) -> Column:
    """1 if the row's own topic is flagged in crisis_sdg_1..N."""
    flags = F.array(*(F.coalesce(F.col(f"crisis_sdg_{t}"), F.lit(0)) for t in range(1, topics + 1)))
    return F.when(topic.between(1, topics), F.try_element_at(flags, topic.cast("int"))).otherwise(0)
