"""Correlation, agreement, classification metrics and fixed-effects regression."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.operators.order import cumulated
from lodeframe.shipping import ship


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_p_value(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return float("nan") if math.isnan(t) or df <= 0 else incomplete_beta(df / 2, 0.5, df / (df + t * t))


def r_p_value(r: float, n: int) -> float:
    """Two-sided p of a correlation."""
    if n < 3:
        return float("nan")
    return 0.0 if abs(r) >= 1 else t_p_value(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def p_of_r(r: Column, n: Column) -> Column:
    """r_p_value of columns, a batch at a time; null for fewer than three pairs."""

    @F.pandas_udf("double")
    def p(rs: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([r_p_value(float(a), int(b)) for a, b in zip(rs, ns, strict=True)], dtype=float)

    return F.nanvl(p(r, n), F.lit(None).cast("double"))


def p_of_t(t: Column, df: Column) -> Column:
    """t_p_value of columns, a batch at a time; null without a t."""

    @F.pandas_udf("double")
    def p(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series([float("nan") if a is None else t_p_value(float(a), float(b)) for a, b in zip(ts, dfs, strict=True)], dtype=float)

    return F.nanvl(p(t, df), F.lit(None).cast("double"))


def correlations(df: DataFrame, by: Sequence[str], x: str, y: str, min_n: int = 4) -> DataFrame:
    """n, Pearson's r and its two-sided p of each group; groups with fewer pairs or without variance are left out.

    Groups are few, so that the p-values (the only step in Python) are too.
    """
    ship(df.sparkSession)
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    out = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"))
    return out.where((F.col("n") >= min_n) & (F.col("sx") > 0) & (F.col("sy") > 0)).drop("sx", "sy").withColumn("p", p_of_r(F.col("r"), F.col("n")))


def average_ranks(df: DataFrame, by: Sequence[str], *columns: str) -> DataFrame:
    """rank_<column>: equals share their mean rank."""
    out = {}
    for c in columns:
        w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
        same = Window.partitionBy(*by, c)
        out[f"rank_{c}"] = F.rank().over(w.orderBy(c)) + (F.count("*").over(same) - 1) / 2.0
    return df.withColumns(out)


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, min_n: int = 4) -> DataFrame:
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return correlations(average_ranks(pairs, by, x, y), by, f"rank_{x}", f"rank_{y}", min_n)


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull()).groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))


def kappa_band(k: Column) -> Column:
    return F.when(k >= 0.8, "almost perfect").when(k >= 0.6, "substantial").when(k >= 0.4, "moderate").when(k >= 0.2, "fair").otherwise("poor")


def binary_agreement(df: DataFrame, a: str, b: str, min_n: int = 10) -> DataFrame:
    """n, agreement, Cohen's kappa and its band of two coders with labels 0 and 1; no row for fewer than min_n."""
    both = df.where(F.col(a).isin(0, 1) & F.col(b).isin(0, 1))
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    s = both.agg(F.count("*").alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same"), is_(a, 1).alias("a1"), is_(b, 1).alias("b1"))
    n = F.col("n").cast("double")
    chance = (F.col("a1") * F.col("b1") + (n - F.col("a1")) * (n - F.col("b1"))) / (n * n)
    po = F.col("same") / n
    s = s.where(F.col("n") >= min_n).select("n", F.round(po, 6).alias("agreement"), F.round((po - chance) / F.nullif(1 - chance, F.lit(0.0)), 6).alias("kappa"))
    return s.withColumn("band", kappa_band(F.col("kappa")))


def multiclass(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """n, accuracy, macro F1 (over labels that occur on either side) and kappa."""
    c = confusion(df, truth, guess)
    rows = c.groupBy("truth").agg(F.sum("n").alias("t")).withColumnRenamed("truth", "k")
    cols = c.groupBy("guess").agg(F.sum("n").alias("g")).withColumnRenamed("guess", "k")
    hits = c.where("truth = guess").select(F.col("truth").alias("k"), F.col("n").alias("h"))
    per = rows.join(cols, "k", "full").join(hits, "k", "left").fillna(0, ["t", "g", "h"])
    s = per.agg(F.sum("t").alias("n"), F.sum("h").alias("hit"), F.avg(2 * F.col("h") / (F.col("t") + F.col("g"))).alias("f1"), F.sum(F.col("t") * F.col("g")).alias("tg"))
    n = F.col("n").cast("double")
    po, pe = F.col("hit") / n, F.col("tg") / (n * n)
    return s.select("n", F.round(po, 6).alias("accuracy"), F.round("f1", 6).alias("macro_f1"), F.round((po - pe) / F.nullif(1 - pe, F.lit(0.0)), 6).alias("kappa"))


def class_accuracy(df: DataFrame, truth: str, guess: str, min_n: int = 3) -> DataFrame:
    out = df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull()).groupBy(F.col(truth).alias("truth")).agg(F.count("*").alias("n"), F.round(F.avg((F.col(truth) == F.col(guess)).cast("double")), 6).alias("accuracy"))
    return out.where(F.col("n") >= min_n)


def binary_metrics(df: DataFrame, truth: str, guess: str, score: str) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1, and the ROC area."""
    y, g = F.col(truth) == 1, F.col(guess) == 1
    s = df.agg(F.count_if(y & g).alias("tp"), F.count_if(~y & g).alias("fp"), F.count_if(y & ~g).alias("fn"), F.count_if(~y & ~g).alias("tn"))
    # The ROC area is the share of (positive, negative) pairs in order, half of those of equal score: from counts by score.
    by_score = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count_if(y).alias("p"), F.count_if(~y).alias("q"))
    below = cumulated(by_score, [score], {"cq": F.col("q")})
    s = s.crossJoin(below.agg(F.sum(F.col("p").cast("double") * (F.col("cq") - F.col("q") / 2)).alias("pairs")))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    pos, neg = tp + fn, fp + tn
    zero = F.lit(0.0)
    return s.select(
        "tp", "fp", "fn", "tn", F.round((tp + tn) / (pos + neg), 6).alias("accuracy"), F.round(tp / F.nullif(tp + fp, zero), 6).alias("precision"), F.round(tp / F.nullif(pos, zero), 6).alias("recall"),
        F.round(2 * tp / F.nullif(2 * tp + fp + fn, zero), 6).alias("f1"), F.round(F.col("pairs") / F.nullif(pos * neg, zero), 6).alias("roc_auc"),
    )


def ranking_metrics(df: DataFrame, truth: str, score: str, key: str, ks: Sequence[int] = (50, 100, 200, 400)) -> DataFrame:
    """Average precision (equal scores are one threshold) and precision at k (equals by key)."""
    by_score = df.groupBy(score).agg(F.count("*").alias("c"), F.count_if(F.col(truth) == 1).alias("p"))
    cum = cumulated(by_score, [F.desc(score)], {"cp": F.col("p"), "cc": F.col("c")})
    ap = cum.agg(F.round(F.sum(F.col("p") * F.col("cp") / F.col("cc")) / F.nullif(F.sum("p"), F.lit(0)), 6).alias("average_precision"))
    top = df.orderBy(F.desc(score), key).limit(max(ks)).withColumn("r", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(score), key)))
    at = top.agg(*(F.round(F.count_if((F.col("r") <= k) & (F.col(truth) == 1)) / k, 6).alias(f"precision_at_{k}") for k in ks))
    return ap.crossJoin(at)


def simple_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, slope, intercept, r squared, and whether the line is close to the diagonal."""
    s = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.regr_r2(y, x).alias("r2"))
    return s.select("n", F.round("b", 6).alias("slope"), F.round("a", 6).alias("intercept"), F.round("r2", 6).alias("r_squared"), ((F.col("r2") > 0.9) & (F.abs(F.col("b") - 1) < 0.05)).alias("passes"))


def fixed_effects(rows: list[tuple], min_n: int = 10) -> dict[str, float] | None:
    """Two-way fixed effects of (unit, time, x, y): least squares with dummies, HC1 errors.

    For panels of a few thousand rows, such as topic x year; see within() for larger ones.
    """
    rows = [r for r in rows if r[2] is not None and r[3] is not None]
    if len(rows) < min_n:
        return None
    units, times = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    x = np.array([[float(r[2]), 1.0, *(float(r[0] == u) for u in units[1:]), *(float(r[1] == t) for t in times[1:])] for r in rows])
    y = np.array([float(r[3]) for r in rows])
    inverse = np.linalg.pinv(x.T @ x)
    beta = inverse @ x.T @ y
    e = y - x @ beta
    n, k = x.shape
    if n <= k:
        return None
    cov = inverse @ (x.T * e**2) @ x @ inverse * n / (n - k)
    se = math.sqrt(max(cov[0, 0], 0))
    t = beta[0] / se if se else float("nan")
    return {"coef": float(beta[0]), "se": se, "t_stat": float(t), "p_val": t_p_value(float(t), n - k), "n": n, "df_r": n - k, "r2": float(1 - e @ e / ((y - y.mean()) @ (y - y.mean())))}


def within(df: DataFrame, unit: str, time: str, *columns: str) -> DataFrame:
    """dm_<column>: demeaned by unit and time, at any scale; exact for balanced panels."""
    w = lambda *by: Window.partitionBy(*by)
    means = df.agg(*(F.avg(c).alias(f"__{c}") for c in columns))
    out = df.crossJoin(F.broadcast(means))
    return out.withColumns({f"dm_{c}": F.col(c) - F.avg(c).over(w(unit)) - F.avg(c).over(w(time)) + F.col(f"__{c}") for c in columns}).drop(*(f"__{c}" for c in columns))


def two_way(df: DataFrame, unit: str, time: str, x: str, y: str, min_n: int = 10) -> DataFrame:
    """fixed_effects as one row of a table: coef, se, t_stat, p_val, n, df_r, r2; no row for fewer than min_n.

    A balanced panel (each unit at each time once) of any size is demeaned and summed in
    Spark, which gives the same slope, errors and degrees of freedom as dummies. One with
    gaps goes to the dummies if it is small, and is refused otherwise.
    """
    ship(df.sparkSession)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(unit).alias("__u"), F.col(time).alias("__t"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    size = rows.agg(F.count("*"), F.count_distinct("__u"), F.count_distinct("__t"), F.count_distinct("__u", "__t")).first()
    n, units, times, cells = size
    k = units + times
    if not n == cells == units * times:
        if n * k > 20_000_000:
            raise ValueError("a panel with gaps is solved on the driver, and this one is too large: fill or drop incomplete units")
        fit = fixed_effects([tuple(r) for r in rows.collect()], min_n)
        schema = "coef double, se double, t_stat double, p_val double, n long, df_r long, r2 double"
        return df.sparkSession.createDataFrame([tuple(fit.values())] if fit else [], schema)
    d = within(rows, "__u", "__t", "x", "y")
    slope = d.agg((F.sum(F.col("dm_x") * F.col("dm_y")) / F.nullif(F.sum(F.col("dm_x") ** 2), F.lit(0.0))).alias("coef"), F.avg("y").alias("my"))
    e = F.col("dm_y") - F.col("coef") * F.col("dm_x")
    s = d.crossJoin(F.broadcast(slope)).groupBy("coef").agg(F.sum(F.col("dm_x") ** 2 * e**2).alias("xe"), F.sum(F.col("dm_x") ** 2).alias("xx"), F.sum(e**2).alias("ee"), F.sum((F.col("y") - F.col("my")) ** 2).alias("yy"))
    s = s.where(F.lit(n >= min_n and n > k)).withColumn("se", F.sqrt(F.col("xe") * n / (n - k)) / F.col("xx")).withColumn("t_stat", F.col("coef") / F.nullif(F.col("se"), F.lit(0.0)))
    return s.select("coef", "se", "t_stat", p_of_t(F.col("t_stat"), F.lit(n - k)).alias("p_val"), F.lit(n).cast("long").alias("n"), F.lit(n - k).cast("long").alias("df_r"), (1 - F.col("ee") / F.nullif(F.col("yy"), F.lit(0.0))).alias("r2"))


def stars(p: Column) -> Column:
    return F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*").otherwise("")


def placebo(panels: dict[str, DataFrame], unit: str, time: str, x: str, y: str, steps: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """two_way of y on x now, earlier and later, for each named panel: panel, direction, k, the fit, stars."""
    from lodeframe.operators.measures import shifts

    out = None
    for name, df in panels.items():
        moved = shifts(df, unit, time, x, steps)
        for direction, k, column in [("contemporaneous", 0, x), *((s, k, f"{s}_{k}") for s in ("lag", "lead") for k in steps)]:
            fit = two_way(moved, unit, time, column, y).select(F.lit(name).alias("panel"), F.lit(direction).alias("direction"), F.lit(k).alias("k"), "*")
            fit = fit.withColumn("stars", stars(F.col("p_val")))
            out = fit if out is None else out.unionByName(fit)
    return out


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The interval of a share."""
    n = n.cast("double")
    p = hits / n
    middle, half, below = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return (middle - half) / below, (middle + half) / below


def krippendorff(df: DataFrame, unit: str, coder_value: str) -> DataFrame:
    """Nominal alpha of long ratings (unit, value); units with one rating don't count."""
    n_u = F.count("*").over(Window.partitionBy(unit))
    rated = df.where(F.col(coder_value).isNotNull()).withColumn("m", n_u).where("m > 1")
    cell = rated.groupBy(unit, coder_value, "m").agg(F.count("*").alias("c"))
    same = cell.groupBy().agg(F.sum(F.col("c") * (F.col("c") - 1) / (F.col("m") - 1)).alias("agree"), F.sum("c").alias("n"))
    totals = cell.groupBy(coder_value).agg(F.sum("c").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1)).alias("tt"))
    n = F.col("n").cast("double")
    return same.crossJoin(totals).select(F.col("n"), F.round(1 - (1 - F.col("agree") / n) / F.nullif(1 - F.col("tt") / (n * (n - 1)), F.lit(0.0)), 6).alias("alpha"))


def long_report(df: DataFrame, task: str) -> DataFrame:
    """One row of metrics as (task, metric, value)."""
    names = df.columns
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in names))).alias("m")).select(F.lit(task).alias("task"), "m.*")
