"""Finding article files by year, reading them whatever their headers, and results kept in parts."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeframe.sources.articles import strings

#: What marks files made from others.
DERIVED = ("_classified", "_oda")


def year_of(path: str, root: str) -> int | None:
    """The year of a file below root: that of its year folder, or of a name such as news_2016_01.csv in root itself."""
    parts = path.split(root.rstrip("/").rsplit(":", 1)[-1], 1)[-1].strip("/").split("/")
    if len(parts) > 1:
        return int(parts[0]) if re.fullmatch(r"\d{4}", parts[0]) else None
    flat = re.match(r"news_(\d{4})_", parts[0])
    return int(flat[1]) if flat else None


def article_files(spark: SparkSession, root: str, years: Sequence[int] | None = None, derived: Sequence[str] = DERIVED) -> dict[int, list[str]]:
    """The CSV files of each year, in order of their names, without derived ones; only names are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root).select("path")
    out: dict[int, list[str]] = {}
    for path in sorted(r[0] for r in found.collect()):
        year = year_of(path, root)
        stem = path.rsplit("/", 1)[-1].removesuffix(".csv")
        if year is not None and (years is None or year in years) and not any(x in stem for x in derived):
            out.setdefault(year, []).append(path)
    # A year folder stands in front of flat files of that year.
    return {y: [p for p in ps if f"/{y}/" in p] or ps for y, ps in sorted(out.items())}


def header(spark: SparkSession, path: str) -> list[str]:
    """A CSV file's column names, without a byte order mark; only its first line is read."""
    return [c.lstrip("﻿") for c in spark.read.option("header", True).csv(path).columns]


def read_files(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], most_rows: int | None = None) -> DataFrame:
    """Those of the columns that each file has, as text, and source_file.

    Rows with more fields than their file's header are skipped; those with fewer end in nulls. most_rows: of each
    file only so many, from its begin. Files that have none of the columns give no rows.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for path in paths:
        names = tuple(header(spark, path))
        if set(names) & set(columns):
            groups.setdefault(names, []).append(path)
    if not groups:
        return spark.createDataFrame([], strings(*columns, "source_file"))
    out = []
    for names, some in groups.items():
        df = spark.read.schema(strings(*names, "__over")).option("header", True).option("multiLine", True).option("escape", '"').csv(some)
        df = df.where("__over is null").select(*(c for c in columns if c in names), F.col("_metadata.file_name").alias("source_file"))
        if most_rows is not None:
            # A file is read by one task, so these numbers follow its lines.
            first = Window.partitionBy("source_file").orderBy("__line")
            df = df.withColumn("__line", F.monotonically_increasing_id()).withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= most_rows).drop("__line", "__r")
        out.append(df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def process_parts(spark: SparkSession, root: str, parts: dict[str, Callable[[], DataFrame]], force: bool = False) -> dict[str, bool]:
    """Writes each part's rows to its folder below root, but for parts that an earlier run completed; {part: whether it ran}.

    A part is complete once its writer has committed (_SUCCESS), so a run that was broken off goes on where it was.
    """
    ran = {}
    for name, make in parts.items():
        path = f"{root}/part={name}"
        ran[name] = force or not _exists(spark, f"{path}/_SUCCESS")
        if ran[name]:
            make().write.mode("overwrite").parquet(path)
    return ran


def merge_parts(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all parts, with part."""
    return spark.read.option("mergeSchema", True).parquet(root).withColumn("part", F.col("part").cast("string"))


def export_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """One CSV file with a header below path: for results that one task can hold."""
    (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
