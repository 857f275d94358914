"""A session with the settings that the engine's plans count on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "lodeframe", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Adaptive execution, UTC and Arrow on; anything may be overridden by conf (dots as double underscores)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    if shuffle_partitions:
        base["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def spread(df: DataFrame, key: str) -> DataFrame:
    """A scanned table by key in as many tasks as there are cores, if it is small and lies in fewer files than that.

    A file of one row group is one task, and so is the work behind its scan. Larger tables,
    and those of many files, are read as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > cores * (32 << 20):
        return df
    return df.repartition(cores, key)


def few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, to be broadcast if it has at most so many rows, which is looked at first; Spark doesn't know the size of a table made of literals."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
