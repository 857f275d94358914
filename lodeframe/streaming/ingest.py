"""Incremental ingest of article files as a stream: an extension of the batch upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lodeframe.sources.scratch import scratch


def stream_files(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files_at_once: int = 100) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_at_once).load(path)


def upsert_stream(df: DataFrame, target: str, checkpoint: str, key: str, seq: str, day: str) -> StreamingQuery:
    """Merges each batch into a table partitioned by day; only the batch's days are read and rewritten."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        w = Window.partitionBy(key).orderBy(F.desc(seq))
        days = [r[0] for r in batch.select(day).distinct().collect()]
        old = None
        if spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)):
            old = spark.read.schema(batch.schema).parquet(target).where(F.col(day).isin(days))
        both = batch if old is None else old.unionByName(batch)
        merged = both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
        # A partition can't be overwritten while it is read: the merged rows are a table first.
        path = scratch(spark, "merge")
        merged.write.parquet(path)
        merged = spark.read.schema(batch.schema).parquet(path)
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(target)

    return df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(df: DataFrame, ts: str, by: str, value: str, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by time window with late rows up to a watermark; the same on a batch."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, length).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")
