"""Spending records: topics by tag, sector and marker, and annual tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.session import few


def crosswalk(df: DataFrame, code: str, exact: DataFrame, prefix: DataFrame, digits: int = 3, name: str = "sector_sdg") -> DataFrame:
    """The topic of the whole code, else that of its first digits; two joins with tables (key, value), sent to all tasks if they are small."""
    e = exact.select(F.col("key").alias("__e"), F.col("value").alias("__ev"))
    p = prefix.select(F.col("key").alias("__p"), F.col("value").alias("__pv"))
    out = df.join(few(e), F.col(code) == F.col("__e"), "left").join(few(p), F.substring(code, 1, digits) == F.col("__p"), "left")
    return out.withColumn(name, F.coalesce("__ev", "__pv")).drop("__e", "__ev", "__p", "__pv")


def by_marker(markers: Sequence[tuple[Column, int]], values: Sequence[str]) -> Column:
    """The topic of the first marker that has one of the values."""
    out = None
    for column, topic in markers:
        out = F.when(column.isin(*values), topic) if out is None else out.when(column.isin(*values), topic)
    return out


def topic_and_source(df: DataFrame, tag: str, sector: str, marker: str) -> DataFrame:
    """sdg by tag, else sector, else marker; sdg_source says which."""
    source = F.when(F.col(tag).isNotNull(), "direct_tag").when(F.col(sector).isNotNull(), "sector_code").when(F.col(marker).isNotNull(), "marker").otherwise("none")
    return df.withColumns({"sdg": F.coalesce(tag, sector, marker), "sdg_source": source})


def total(amount: str) -> Column:
    """The sum of a group's amounts, added as decimals of 14 places: that of doubles depends on the order of rows, which
    decides a rounding at a tie. Groups with amounts that decimals can't hold (NaN, 1e14 and more) are added as doubles."""
    exact = F.col(amount).try_cast("decimal(28,14)")
    return F.when(F.count(exact) == F.count(amount), F.sum(exact).cast("double")).otherwise(F.sum(amount))


def annual_by_topic(df: DataFrame, sums: Sequence[str], project: str = "project_id") -> DataFrame:
    """Rows without year or topic are left out."""
    return df.where("year is not null and sdg is not null").groupBy("year", "sdg").agg(*(F.sum(c).alias(c) for c in sums), F.count(project).alias("n_projects"))


def annual_by_country(df: DataFrame, sums: Sequence[str], fund: str, grant: str, loan: str, amount: str, project: str = "project_id") -> DataFrame:
    """By year, country and topic, with grants and loans counted, and the share of all of the year's amounts with a topic."""
    tagged = df.where("year is not null and sdg is not null")
    has = lambda t: F.count_if(F.coalesce(F.contains(F.col(fund), F.lit(t)), F.lit(False)))
    # The year's total also counts rows without a country: those stay a group until it is summed.
    out = tagged.groupBy("year", "country", "sdg").agg(*(F.sum(c).alias(c) for c in sums), F.count(project).alias("n_projects"), has(grant).alias("n_grant_projects"), has(loan).alias("n_loan_projects"))
    total = F.sum(amount).over(Window.partitionBy("year"))
    return out.withColumn("oda_share_pct", F.round(100 * F.col(amount) / F.nullif(total, F.lit(0.0)), 4)).where("country is not null")


def annual_share(df: DataFrame, amount: str, digits: int = 4) -> DataFrame:
    return df.withColumn("oda_share_pct", F.round(100 * F.col(amount) / F.nullif(F.sum(amount).over(Window.partitionBy("year")), F.lit(0.0)), digits))
