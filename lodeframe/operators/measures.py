"""Attention measures of topic x country x month cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explode_cells(df: DataFrame, topics: str, countries: str, no_topic: int = 0, no_country: str = "---") -> DataFrame:
    """A row for each topic x country of an article; empty or null lists count as the sentinel."""
    filled = lambda c, s: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.col(c)).otherwise(F.array(F.lit(s)))
    return df.withColumn("sdg", F.explode(filled(topics, no_topic))).withColumn("country", F.explode(filled(countries, no_country))).drop(*({topics, countries} - {"sdg", "country"}))


def cells(df: DataFrame, keys: Sequence[str], outlet: str, score: str, label: str, positive: str = "positive", neutral: str = "neutral", negative: str = "negative") -> DataFrame:
    """Frequency, sentiment moments and shares, and outlet concentration of each cell.

    Two aggregations: by cell and outlet (which keeps moments, so that both levels combine
    map-side), then by cell. No join brings the parts together again.
    """
    s, of = F.col(score), F.col(label)
    known = F.coalesce(F.col(outlet), F.lit("unknown"))
    by_outlet = df.groupBy(*keys, known.alias("__outlet")).agg(
        F.count("*").alias("n"), F.count(s).alias("ns"), F.avg(s).alias("m"), F.coalesce(F.var_pop(s), F.lit(0.0)).alias("v"),
        F.count_if(of == positive).alias("pos"), F.count_if(of == neutral).alias("neu"), F.count_if(of == negative).alias("neg"),
    )
    # Moments of parts: the sum of squares around the cell's mean from those around the parts'.
    n, ns = F.sum("n"), F.sum("ns")
    total = F.sum(F.col("m") * F.col("ns"))
    around = F.sum(F.col("v") * F.col("ns")) + F.sum(F.col("m") * F.col("m") * F.col("ns")) - total * total / F.nullif(ns, F.lit(0))
    variance = F.coalesce(F.when(ns > 1, F.greatest(around, F.lit(0.0)) / (ns - 1)), F.lit(0.0))
    outlets = F.collect_list("n")
    shares = F.transform(outlets, lambda x: x / F.aggregate(outlets, F.lit(0).cast("long"), lambda a, y: a + y))
    out = by_outlet.groupBy(*keys).agg(
        n.alias("freq_articles"), (total / F.nullif(ns, F.lit(0))).alias("avg_sentiment"), variance.alias("sentiment_variance"),
        (F.sum("pos") / n).alias("share_positive"), (F.sum("neu") / n).alias("share_neutral"), (F.sum("neg") / n).alias("share_negative"),
        shares.alias("__shares"),
    )
    zero = F.lit(0.0)
    return out.withColumns({
        "sentiment_std": F.sqrt("sentiment_variance"),
        "polarization_index": F.col("share_positive") * F.col("share_negative"),
        "hhi": F.aggregate("__shares", zero, lambda a, p: a + p * p),
        "entropy": F.abs(F.aggregate("__shares", zero, lambda a, p: a + p * F.log2(p))),
    }).drop("__shares")


def observed_months(df: DataFrame, year: str = "year", month: str = "month") -> DataFrame:
    """(year, month, idx): the months that occur, numbered from 0 in order.

    The distinct months are few whatever the data's size, so numbering them in one task and
    sending them to all is cheap.
    """
    months = df.select(year, month).distinct()
    return months.withColumn("idx", F.row_number().over(Window.orderBy(year, month)) - 1)


def rolling(df: DataFrame, keys: Sequence[str] = ("sdg", "country"), value: str = "freq_articles", spans: Sequence[int] = (3, 6, 12), year: str = "year", month: str = "month") -> DataFrame:
    """Sums of the previous observed months, persistence, and cumulated values.

    rolling_Nm excludes the month itself and counts months that occur anywhere in df; a cell
    that is absent in one counts 0 there. RANGE frames over the months' numbers make filling
    the gaps unnecessary. cumulative_all_time is the series' total, cumulative_running the
    sum up to the month.
    """
    numbered = df.join(F.broadcast(observed_months(df, year, month)), [year, month])
    series = Window.partitionBy(*keys).orderBy("idx")
    v = F.col(value)
    past = {f"rolling_{n}m": F.coalesce(F.sum(v).over(series.rangeBetween(-n, -1)), F.lit(0)) for n in spans}
    out = numbered.withColumns({
        **past,
        "__r12": F.coalesce(F.sum(v).over(series.rangeBetween(-12, -1)), F.lit(0)),
        "cumulative_ytd": F.sum(v).over(Window.partitionBy(*keys, year).orderBy("idx").rangeBetween(Window.unboundedPreceding, 0)),
        "cumulative_all_time": F.sum(v).over(Window.partitionBy(*keys)),
        "cumulative_running": F.sum(v).over(series.rangeBetween(Window.unboundedPreceding, 0)),
    })
    mean = F.col("__r12") / F.nullif(F.least(F.col("idx"), F.lit(12)), F.lit(0))
    return out.withColumn("persistence_score", F.when(F.coalesce(mean, F.lit(0.0)) > 0, v / mean).otherwise(1.0)).drop("idx", "__r12")


def shares(df: DataFrame, value: str = "freq_articles", total: Sequence[str] = ("year", "month"), within: Sequence[str] = ("year", "month", "sdg"), digits: int = 5) -> DataFrame:
    """value as a share of its month, and of its month and topic."""
    of = lambda by: F.round(F.col(value) / F.nullif(F.sum(value).over(Window.partitionBy(*by)), F.lit(0)), digits)
    return df.withColumns({"freq_share_total": of(total), "freq_share_sdg": of(within)})


def topic_country_month(df: DataFrame, outlet: str, score: str, label: str, keys: Sequence[str] = ("year", "month", "sdg", "country"), **labels: str) -> DataFrame:
    """The full cell table: cells, rolling sums and shares."""
    return shares(rolling(cells(df, keys, outlet, score, label, **labels)))


def marginalise(df: DataFrame, keys: Sequence[str], sums: Sequence[str], means: Sequence[str]) -> DataFrame:
    """Coarser cells: sums, and unweighted means of the finer cells."""
    return df.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums), *(F.avg(c).alias(c) for c in means))


def topic_years(df: DataFrame, topics: str, year: str = "year", most: int = 17) -> DataFrame:
    """Articles of each topic and year (once for each topic they have), of all years x topics, with the share of the year."""
    totals = df.groupBy(year).agg(F.count("*").alias("n_total"))
    counts = df.select(year, F.explode(F.array_distinct(topics)).alias("sdg")).groupBy(year, "sdg").agg(F.count("*").alias("n_articles"))
    grid = totals.withColumn("sdg", F.explode(F.sequence(F.lit(1), F.lit(most))))
    n = F.coalesce(F.col("n_articles"), F.lit(0))
    return grid.join(counts, [year, "sdg"], "left").select(year, "sdg", n.alias("n_articles"), "n_total", F.round(n * 100 / F.nullif(F.col("n_total"), F.lit(0)), 3).alias("media_share_pct"))


def gap(df: DataFrame, by: str = "sdg", media: str = "media_share_pct", aid: str = "oda_share_pct", keep: Column | None = None) -> DataFrame:
    """Mean shares by topic, their difference and ratio."""
    df = df if keep is None else df.where(keep)
    out = df.groupBy(by).agg(F.avg(media).alias("m"), F.avg(aid).alias("a"))
    return out.select(by, F.round("m", 3).alias("media"), F.round("a", 3).alias("oda"), F.round(F.col("m") - F.col("a"), 3).alias("gap"), F.round(F.col("m") / F.nullif(F.col("a"), F.lit(0.0)), 2).alias("ratio"))


def value_counts(df: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """Values by descending number; equals in their own order."""
    out = df.groupBy(column).agg(F.count("*").alias("n"))
    return out if most is None else out.orderBy(F.desc("n"), column).limit(most)


def tier_shares(df: DataFrame, column: str) -> DataFrame:
    out = df.groupBy(column).agg(F.count("*").alias("n"))
    return out.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 1))


def top_of_group(df: DataFrame, by: str, score: str, key: str, most: int) -> DataFrame:
    """The rows of the highest scores of each group; equals by key."""
    w = Window.partitionBy(by).orderBy(F.desc(score), key)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def first_of_key(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """One row for each key, the first in the order given (never by the rows' chance order)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def first_n_flag(df: DataFrame, n: int, *order: str | Column, name: str = "overlap_row") -> DataFrame:
    """YES for the first n rows of the order, '' for others: a limit and a join of its keys, not one sorted task."""
    keys = df.select(*order).orderBy(*order).limit(n).withColumn(name, F.lit("YES"))
    return df.join(F.broadcast(keys) if n <= 100_000 else keys, list(order), "left").fillna("", [name])


def shifts(df: DataFrame, by: str, order: str, value: str, steps: Sequence[int] = (1, 2, 3), by_value: bool = False) -> DataFrame:
    """lag_k and lead_k of value: of the k-th row before and after or, by_value, of the order's value k less and more."""
    w = Window.partitionBy(by).orderBy(order)
    if not by_value:
        return df.withColumns({f"{name}_{k}": f(value, k).over(w) for k in steps for name, f in (("lag", F.lag), ("lead", F.lead))})
    at = lambda k: F.max(value).over(w.rangeBetween(k, k))
    return df.withColumns({f"{name}_{k}": at(sign * k) for k in steps for name, sign in (("lag", -1), ("lead", 1))})


def annual_to_monthly(df: DataFrame, amounts: Sequence[str], digits: int = 4, counts: Sequence[str] = (), count_digits: int = 2) -> DataFrame:
    """Twelve rows for each, amounts divided by 12; other columns repeat."""
    twelfth = {**{c: F.round(F.col(c) / 12, digits) for c in amounts}, **{c: F.round(F.col(c) / 12, count_digits) for c in counts}}
    return df.withColumns(twelfth).withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
