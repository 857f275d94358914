"""Awkward tables: nulls, empty and very long texts, copies, repeated rows, clashing columns."""

from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} and then w{i}" for i in range(30_000))
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew potent coffee beside old stone bridges under pale winter light"
TEXTS = [(1, "Hello world, this is a text."), (2, None), (3, ""), (None, "a text without an id"), (4, "   \n\t "), (5, "!!! ??? ..."), (6, LONG), (7, LONG), (8, "Hello world, this is a text."), (8, "Hello world, this is a text."), (9, "x"), (10, "mail a.b@c.org now"), (11, WORDS), (12, WORDS.replace("lazy", "sleepy")), (None, None)]


def awkward(spark):
    """documents with columns that operators use inside: they must neither clash nor get lost."""
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    df = df.withColumns({"lang": F.when(F.col("doc_id") % 3 == 0, None).otherwise("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit(1) for c in ("doc", "n", "key", "root", "rep", "pos", "mark", "h", "t", "kind", "score", "item", "item_id", "found", "block", "keys0", "spans", "entity", "begin", "pattern", "seed", "r", "a", "b", "id", "term", "df")})


def empty(spark):
    return awkward(spark).limit(0)


def benchmark(spark):
    return spark.createDataFrame([(1, WORDS), (2, None), (3, ""), (None, "no id"), (4, "x y"), (1, WORDS)], "item_id long, text string")
