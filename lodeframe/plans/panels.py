"""Panels: media cells, spending and calendar dimensions side by side.

Outer joins leave the absent side's measures null; they aren't filled with zeros.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.operators.calendar import affects


def _dims(df: DataFrame, *dims: DataFrame) -> DataFrame:
    for d in dims:
        df = df.join(F.broadcast(d), ["year", "month"], "left")
    return df


def _years(df: DataFrame, years: Sequence[int] | None) -> DataFrame:
    return df if years is None else df.where(F.col("year").isin(*years))


def panel(media: DataFrame, aid: DataFrame, keys: Sequence[str], dims: Sequence[DataFrame] = (), years: Sequence[int] | None = None) -> DataFrame:
    """media and aid by keys (both sides already at that grain), with calendar columns.

    Years are filtered on the inputs: a full outer join lets no filter through.
    """
    return _dims(_years(media, years).join(_years(aid, years), list(keys), "full_outer"), *dims)


def by_topic(media: DataFrame, aid: DataFrame, dims: Sequence[DataFrame] = (), years: Sequence[int] | None = None, sums: Sequence[str] = ("freq_articles",), means: Sequence[str] = ()) -> DataFrame:
    """Panel A: topic x month."""
    m = media.groupBy("year", "month", "sdg").agg(*(F.sum(c).alias(c) for c in sums), *(F.avg(c).alias(c) for c in means))
    return panel(m, aid, ["year", "month", "sdg"], dims, years)


def by_country(media: DataFrame, aid: DataFrame | None, dims: Sequence[DataFrame] = (), years: Sequence[int] | None = None, sums: Sequence[str] = ("freq_articles",), aid_sums: Sequence[str] = ("oda_disbursement",)) -> DataFrame:
    """Panel B: country x month; spending may be absent."""
    m = media.groupBy("year", "month", "country").agg(*(F.sum(c).alias(c) for c in sums))
    if aid is None:
        return _dims(_years(m, years), *dims)
    a = aid.groupBy("year", "month", "country").agg(*(F.sum(c).alias(c) for c in aid_sums))
    return panel(m, a, ["year", "month", "country"], dims, years)


def by_country_topic(media: DataFrame, aid: DataFrame, crisis: DataFrame | None = None, dims: Sequence[DataFrame] = (), years: Sequence[int] | None = None, topics: int = 17) -> DataFrame:
    """Panel C: country x topic x month. Spending without a country column meets every country of its topic."""
    keys = ["year", "month", "country", "sdg"] if "country" in aid.columns else ["year", "month", "sdg"]
    out = panel(media, aid, keys, [*dims, *([] if crisis is None else [crisis])], years)
    return out if crisis is None else out.withColumn("crisis_affects_sdg", affects(F.col("sdg"), topics))
