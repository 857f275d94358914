"""Text classifiers: TF-IDF of character or word n-grams beside given features, and a balanced logistic model.

n-grams are counted, looked up and weighted in numpy, a batch at a time (no dense vectors, no
rows in Python), pairs of words as pairs of numbers; Spark ML fits the model on the labelled rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType
from pyspark.sql.types import StructType

from lodeframe.functions.terms import Terms, counted, weighted
from lodeframe.operators.sampling import folds
from lodeframe.operators.scoring import fold_probabilities
from lodeframe.sources.scratch import scratch, written

#: n-grams that a task holds while it counts.
HELD = 1 << 19


def char_grams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams inside words, each word padded by a blank on both sides; words shorter than low are one n-gram."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    padded = F.transform(tokens, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(word: Column, n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(word) - (n - 1), F.lit(1)))
        grams = F.transform(places, lambda i: F.substring(word, i, F.lit(n)))
        return grams if n == low else F.when(F.length(word) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(padded, lambda w: F.concat(*(of(w, n) for n in range(low, high + 1)))))


def word_grams(text: Column, high: int = 2) -> Column:
    """Words of two characters or more, and runs of up to high of them.

    Runs come of the shorter ones and the words moved on by zip_with: nothing is evaluated once for each place.
    """
    w = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    parts = [w]
    for n in range(2, high + 1):
        parts.append(F.array_compact(F.zip_with(parts[-1], F.slice(w, n, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))))
    return F.concat(*parts)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """df with weight = n / (classes * class size)."""
    n = df.groupBy(label).count().collect()
    total = sum(r["count"] for r in n)
    w = F.create_map(*(F.lit(x) for r in n for x in (r[0], total / (len(n) * r["count"]))))
    return df.withColumn("weight", F.element_at(w, F.col(label)))


def gram_counts(df: DataFrame, grams: str, pairs: bool = False) -> DataFrame:
    """gram, tf, df: how often each n-gram of the rows' arrays is there, and in how many rows; with pairs, also each two neighbours, joined by a blank.

    A task adds up its batches while they have at most HELD different ones; their sums are shuffled.
    """
    parts = df.select(grams).mapInArrow(lambda batches: counted(batches, pairs, HELD), "gram string, tf bigint, df bigint")
    return parts.groupBy("gram").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def by_batch(returns: str, of, terms: Terms | None):
    """An Arrow function of(columns, found): the terms' lookup is made once for each task."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        found = terms.lookup() if terms else None
        for columns in batches:
            yield of(columns if isinstance(columns, tuple) else (columns,), found)

    return F.arrow_udf(run, returns, ArrowUDFType.SCALAR_ITER)


@dataclass
class TextModel:
    """A fitted classifier. grams names the column of n-grams, extra those of other features."""

    coef: list[float]
    intercept: float
    extra: list[str] = field(default_factory=list)
    grams: str | None = None
    counts: Terms | None = None
    idf: list[float] = field(default_factory=list)
    sublinear: bool = False

    def probability(self, df: DataFrame, name: str) -> DataFrame:
        """df with the positive class's probability: n-grams go to numpy, a batch at a time, and one number comes back."""
        k, intercept, sublinear, grams, terms = len(self.extra), self.intercept, self.sublinear, bool(self.grams), self.counts
        coef, idf = np.array(self.coef), np.array(self.idf)

        def logistic(columns: tuple[pa.Array, ...], found) -> pa.Array:
            z = np.full(len(columns[0]), intercept)
            if grams:
                i, v, of = found(columns[0])
                z = z + np.bincount(of, weighted(i, v, of, len(z), idf, sublinear) * coef[k:][i], len(z))
            for c, x in zip(coef[:k], columns[grams:], strict=True):
                z = z + c * x.to_numpy(zero_copy_only=False)
            return pa.array(1 / (1 + np.exp(-z)))

        return df.select("*", by_batch("double", logistic, terms)(*((self.grams,) if grams else ()), *(F.col(x).cast("double") for x in self.extra)).alias(name))


def fit(df: DataFrame, label: str = "label", grams: str | None = None, extra: Sequence[str] = (), vocabulary: int = 50_000, min_df: float = 2, sublinear: bool = False, c: float = 1.0, stored: bool = False, pairs: bool = False) -> TextModel:
    """A balanced logistic model of labelled rows (label 0 or 1).

    n-grams: those in min_df texts or more (a share of them below 1), the vocabulary most
    frequent (equals by the n-gram); tf (1 + ln tf if sublinear) times idf = ln((n + 1) / (df + 1)) + 1,
    of unit length. Extra features are taken as they are. The penalty is that of inverse
    strength c: 1 / (c * sum of weights). Labelled rows are written once, unless they are a stored table.
    pairs: grams are words, and each two neighbours are an n-gram too.
    """
    df = df.select(label, *([grams] if grams else ()), *extra)
    df = class_weights(df if stored else written(df, "labelled"), label)
    model = TextModel([], 0.0, list(extra), grams, sublinear=sublinear)
    if grams:
        n = df.count()
        known = gram_counts(df, grams, pairs).where(F.col("df") >= (min_df if min_df >= 1 else min_df * n)).orderBy(F.desc("tf"), "gram").limit(vocabulary).collect()
        model.counts = Terms([r["gram"] for r in known], pairs)
        model.idf = [math.log((n + 1) / (r["df"] + 1)) + 1 for r in known]
    features = vectors(model, df, label)
    total = df.agg(F.sum("weight")).first()[0]
    # An iteration is a job: rows that fit one task aren't spread over many.
    features = features.coalesce(1 + int(total) // 20_000)
    fitted = LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", regParam=1 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-5).fit(features)
    model.coef, model.intercept = fitted.coefficients.toArray().tolist(), float(fitted.intercept)
    return model


def vectors(model: TextModel, rows: DataFrame, label: str) -> DataFrame:
    """label, weight and features of rows, from a table: Arrow arrays of a vector's fields, which are read as vectors."""
    k, idf, sublinear, grams = len(model.extra), np.array(model.idf), model.sublinear, bool(model.grams)
    size = k + len(idf)

    def sparse(columns: tuple[pa.Array, ...], found) -> pa.Array:
        n = len(columns[0])
        i, v, lengths = np.array((), dtype=int), np.array(()), np.zeros(n, dtype=int)
        if grams:
            i, v, of = found(columns[0])
            lengths, v = np.bincount(of, minlength=n), weighted(i, v, of, n, idf, sublinear)
        ends = np.concatenate(([0], np.cumsum(lengths + k))).astype(np.int32)
        given = (ends[:-1, None] + np.arange(k)).ravel()
        rest = np.ones(ends[-1], dtype=bool)
        rest[given] = False
        places, values = np.empty(ends[-1], dtype=np.int32), np.empty(ends[-1])
        places[given], places[rest] = np.tile(np.arange(k), n), k + i
        values[given] = np.array([x.to_numpy(zero_copy_only=False) for x in columns[grams:]]).T.ravel()
        values[rest] = v
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (places, values)]
        return pa.StructArray.from_arrays([pa.array(np.zeros(n, dtype=np.int8)), pa.array(np.full(n, size, dtype=np.int32)), *lists], names=["type", "size", "indices", "values"])

    vector = by_batch("struct<type: tinyint, size: int, indices: array<int>, values: array<double>>", sparse, model.counts)
    out = rows.select(label, "weight", vector(*((model.grams,) if grams else ()), *(F.col(x).cast("double") for x in model.extra)).alias("features"))
    path = scratch(rows.sparkSession, "features")
    out.write.parquet(path)
    return rows.sparkSession.read.schema(StructType([*out.schema.fields[:2]]).add("features", VectorUDT())).parquet(path)


def score(model: TextModel, df: DataFrame, name: str = "oda", threshold: float = 0.5, digits: int = 4) -> DataFrame:
    """df with <name>_prob and <name>_relevant."""
    out = model.probability(df, f"{name}_prob").withColumn(f"{name}_prob", F.round(f"{name}_prob", digits))
    return out.withColumn(f"{name}_relevant", (F.col(f"{name}_prob") >= threshold).cast("int"))


def sentiment(model: TextModel, df: DataFrame) -> DataFrame:
    """df with sentiment_label, sentiment_score and sentiment_continuous of a model that was fitted on positive (1) and negative (0) texts.

    Stands in for a pre-trained model's batches (scoring.with_model takes any other): the
    class probabilities are folded in the same way.
    """
    p = F.col("__p")
    either = lambda name, x: F.struct(F.lit(name).alias("label"), x.alias("score"))
    folded = fold_probabilities(F.array(either("positive", p), either("negative", 1 - p)))
    out = model.probability(df, "__p").withColumn("__s", folded)
    return out.select(*df.columns, *(F.col(f"__s.{x}").alias(f"sentiment_{x}") for x in ("label", "score", "continuous")))


def cross_validate(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42, **options) -> DataFrame:
    """Each row scored by a model that was fitted without its fold: no label is seen twice."""
    return out_of_fold(written(folds(df, label, key, k, seed), "folds"), label, k, **options)


def out_of_fold(parts: DataFrame, label: str, k: int, **options) -> DataFrame:
    """The rows of a stored table with fold 0..k-1, each scored by the model of the other folds."""
    out = None
    for i in range(k):
        scored = score(fit(parts.where(F.col("fold") != i), label, stored=True, **options), parts.where(F.col("fold") == i))
        out = scored if out is None else out.unionByName(scored)
    return out


def rule_features(hits: Column, actor: Column, labels: Column, vocabulary: Column, shared: Column, place: Column) -> dict[str, Column]:
    """The six features of the rules: topic hits, policy actor, number of topics, vocabulary, shared sector and place, as doubles."""
    named = {"kw_sdg_hits": hits, "policy_actor": actor, "kw_sdg_label_count": labels, "has_dev_vocab": vocabulary, "has_cooccur_sector": shared, "has_oda_country": place}
    return {k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in named.items()}


FRAME_FEATURES = ("kw_sdg_hits", "policy_actor", "kw_sdg_label_count")
RULE_FEATURES = (*FRAME_FEATURES, "has_dev_vocab", "has_cooccur_sector", "has_oda_country")


def score_corpus(model: TextModel, df: DataFrame, stratum: str, name: str = "precision") -> DataFrame:
    """Scores of all rows that aren't negative: the filter comes before the features."""
    return score(model, df.where(F.col(stratum) != "negative"), name)


def compare_scorers(df: DataFrame, scorers: dict[str, Column | dict], label: str, key: str, ks: Sequence[int] = (50, 100, 200, 400), k: int = 5) -> DataFrame:
    """Average precision and precision at k of each scorer: a column, or the options of a model that is scored out of fold.

    The models share their folds, and the metrics read scores that are written once.
    """
    from lodeframe.operators.stats import ranking_metrics

    out, parts = None, None
    for name, scorer in scorers.items():
        if isinstance(scorer, dict):
            parts = written(folds(df, label, key, k), "folds") if parts is None else parts
            rows = written(out_of_fold(parts, label, k, **scorer).select(key, label, F.col("oda_prob").alias("score")), "scores")
        else:
            rows = df.select(key, label, scorer.alias("score"))
        one = ranking_metrics(rows, label, "score", key, ks).select(F.lit(name).alias("scorer"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def three_scorers(grams: str, vocabulary: int = 3000, pairs: bool = False) -> dict[str, dict]:
    """A: what the sampling frame has; B: all rules; C: B and the text (pairs: of words, see fit)."""
    return {"A": {"extra": FRAME_FEATURES}, "B": {"extra": RULE_FEATURES}, "C": {"extra": RULE_FEATURES, "grams": grams, "vocabulary": vocabulary, "pairs": pairs}}


def stratum_agreement(df: DataFrame, candidate: str, stratum: str) -> DataFrame:
    """n, and the share of rows whose recomputed candidate flag says what their recorded stratum says."""
    return df.agg(F.count("*").alias("n"), F.round(F.avg((F.coalesce(F.col(candidate), F.lit(False)) == (F.col(stratum) == "candidate")).cast("double")), 6).alias("agreement"))


__all__ = ["FRAME_FEATURES", "RULE_FEATURES", "Terms", "TextModel", "char_grams", "class_weights", "compare_scorers", "cross_validate", "fit", "gram_counts", "out_of_fold", "rule_features", "score", "score_corpus", "sentiment", "stratum_agreement", "three_scorers", "word_grams"]
