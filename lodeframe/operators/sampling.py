"""Reproducible draws: order by arithmetic or hash on ids, never by the rows' chance order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.operators.order import numbered
from lodeframe.sources.scratch import written

def order_key(key: str, seed: int, arithmetic: bool = False) -> Column:
    """A fixed pseudo-random order of ids of any type, by hash.

    arithmetic: (7919 id + seed) modulo 100003 of integer ids instead, which other engines can
    repeat; it has only so many places, so it is for small tables.
    """
    return F.pmod(F.pmod(F.col(key), F.lit(100003)) * 7919 + seed, F.lit(100003)) if arithmetic else F.xxhash64(F.col(key), F.lit(seed))


def quotas(n: int, percent: dict[str, float], available: dict[str, int], spill_to: str = "negative") -> dict[str, int]:
    """round(n * percent) of each stratum; what others can't fill is drawn from spill_to."""
    want = {k: round(n * p) for k, p in percent.items()}
    got = {k: min(v, available.get(k, 0)) for k, v in want.items()}
    missing = sum(want[k] - got[k] for k in want if k != spill_to)
    got[spill_to] = min(want.get(spill_to, 0) + missing, available.get(spill_to, 0))
    return got


def stratified(df: DataFrame, stratum: str, key: str, n: int, percent: dict[str, float], seed: int = 42, spill_to: str = "negative", arithmetic: bool = False) -> DataFrame:
    """A draw without replacement by quotas with spill. Only the strata's sizes come to the driver.

    df is computed once: its rows are written before they are counted and drawn.
    """
    df = written(df.where(F.col(stratum).isin(*{*percent, spill_to})), "strata")
    available = {r[0]: r[1] for r in df.groupBy(stratum).count().collect()}
    got = quotas(n, percent, available, spill_to)
    most = F.element_at(F.create_map(*(F.lit(x) for kv in got.items() for x in kv)), F.col(stratum))
    w = Window.partitionBy(stratum).orderBy(order_key(key, seed, arithmetic), key)
    # No stratum gives more than the largest quota: that bound is applied before the shuffle too.
    drawn = df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(got.values()))
    return drawn.where(F.col("place") <= most).drop("place")


def by_year(df: DataFrame, year: str, stratum: str, key: str, n: int, percent: dict[str, float], years: int, seed: int = 42, arithmetic: bool = False) -> DataFrame:
    """n // years of each year by strata, then n in all."""
    per = n // years
    most = F.element_at(F.create_map(*(F.lit(x) for k, p in percent.items() for x in (k, round(per * p)))), F.col(stratum))
    w = Window.partitionBy(year, stratum).orderBy(order_key(key, seed, arithmetic), key)
    drawn = df.where(F.col(stratum).isin(*percent)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(round(per * p) for p in percent.values()))
    return drawn.where(F.col("place") <= most).drop("place").orderBy(order_key(key, seed, arithmetic), key).limit(n)


def halves(df: DataFrame, key: str, seed: int = 42, arithmetic: bool = False) -> DataFrame:
    """half 0 or 1 by a hash order; sizes differ by one at most, the first is the larger."""
    out = numbered(df, [order_key(key, seed, arithmetic), key], "__r")
    first = out.agg(F.ceil(F.max("__r") / 2).alias("__first"))
    return out.crossJoin(F.broadcast(first)).withColumn("half", (F.col("__r") > F.col("__first")).cast("int")).drop("__r", "__first")


def folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42, arithmetic: bool = False) -> DataFrame:
    """fold 0..k-1, each with its share of every label.

    Labels are few and large, so rows are numbered in ranges and no task sorts all of a label.
    """
    rows = numbered(df, [label, order_key(key, seed, arithmetic), key], "__r")
    first = rows.groupBy(F.col(label).alias("__label")).agg(F.min("__r").alias("__first"))
    rows = rows.join(F.broadcast(first), F.col(label).eqNullSafe(F.col("__label")))
    return rows.select(*df.columns, ((F.col("__r") - F.col("__first")) % k).cast("int").alias("fold"))


def every(df: DataFrame, order: str, step: int) -> DataFrame:
    """Each step-th row, from the first; order has no ties."""
    return numbered(df, [order], "__r").where((F.col("__r") - 1) % step == 0).drop("__r")


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def with_text(sample: DataFrame, texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Texts for a sample: read late, and only those of sampled ids. Whether the ids are broadcast is for Spark to see."""
    wanted = texts.join(sample.select(*keys).distinct(), list(keys), "left_semi")
    return sample.join(wanted, list(keys), "left")
