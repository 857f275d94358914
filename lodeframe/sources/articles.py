"""Article files: scans, upserts by day, the collection log, monthly tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.functions import scalar
from lodeframe.session import few

RAW_COLUMNS = ("news_id", "pub_date", "provider", "reporter", "title", "category1", "category2", "category3", "incident1", "incident2", "incident3", "persons", "places", "organizations", "keywords", "top_keywords", "body", "url", "exclude_flag")

#: Names under which a canonical column may arrive.
ALIASES = {
    "article_id": ("news_id", "newsId", "_id", "id", "뉴스 식별자"),
    "date": ("pub_date", "publishDate", "published_at", "일자"),
    "outlet": ("provider", "provider_name", "언론사"),
    "title": ("제목",),
    "body": ("content", "본문"),
    "keywords": ("키워드",),
    "top_keywords": (),
    "persons": ("인물",),
    "places": ("locations", "위치"),
    "organizations": ("기관",),
    "category": ("category1", "통합 분류1"),
}


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_csv(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None, skip_bad: bool = False, glob: str | None = None) -> DataFrame:
    """All columns as text; a byte order mark before the first header is taken off. Files that are missing give no rows."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "DROPMALFORMED" if skip_bad else "PERMISSIVE").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.csv(paths)
    df = df.toDF(*(c.lstrip("﻿") for c in df.columns))
    return df if columns is None else df.select(*(c for c in columns if c in df.columns))


def read_json_days(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """Day files: each an array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(paths)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_months(df: DataFrame, path: str, key: str = "article_id") -> None:
    """A table partitioned by year and month, sorted by key within files."""
    df.repartition("year", "month").sortWithinPartitions("year", "month", key).write.mode("overwrite").partitionBy("year", "month").parquet(path)


def write_years(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("year").parquet(path)


def articles(df: DataFrame) -> DataFrame:
    """The canonical article table: aliases resolved, rows without id or date dropped."""
    out = scalar.canonicalise(df, ALIASES)
    lists = {c: scalar.to_list(F.col(c)) for c in ("persons", "places", "organizations", "keywords")}
    out = out.withColumns({**lists, "pub_date": scalar.parse_date(F.col("date"))}).drop("date")
    out = out.withColumns({"year": F.year("pub_date"), "month": F.month("pub_date")})
    return scalar.required(out, "article_id", "pub_date")


def compile_month(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The first row of each key in the order given."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def upsert(old: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """Old and new rows, the last (by seq) of each key."""
    both = old.unionByName(new, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc(seq))
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def log_state(log: DataFrame, day: str = "day", at: str = "at") -> DataFrame:
    """The latest entry of each day of an appended log (day, at, status, count)."""
    return log.groupBy(day).agg(F.max_by(F.struct("status", "count"), at).alias("s")).select(day, "s.status", "s.count")


def uncollected(spark: SparkSession, state: DataFrame, start: str, end: str, day: str = "day") -> DataFrame:
    """Each date from start to end that isn't done."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias(day))
    return days.join(state.where("status = 'done'").select(day), day, "left_anti")


def failed(state: DataFrame, day: str = "day") -> DataFrame:
    return state.where("status = 'failed'").select(day).orderBy(day)


def pending(inputs: DataFrame, manifest: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Inputs that the manifest doesn't list; all with force."""
    return inputs if force else inputs.join(manifest.select(key).distinct(), key, "left_anti")


def outlet_lookup(df: DataFrame, codes: DataFrame, code: str = "code") -> DataFrame:
    """df with outlet and media_category of its code, null if unknown; of codes listed twice the first name."""
    first = codes.groupBy(code).agg(F.min(F.struct("outlet", "media_category")).alias("o")).select(code, "o.*")
    return df.join(few(first), code, "left")


def codes_of_category(codes: DataFrame, code: str = "code") -> DataFrame:
    """media_category, codes: its codes in order, joined by commas."""
    return codes.groupBy("media_category").agg(F.array_join(F.array_sort(F.collect_set(code)), ",").alias("codes"))
