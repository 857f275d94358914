"""Vector scoring against anchors, score fusion, and model adapters.

A model is any callable from a list of texts to a list of results, made once for each
worker by a factory; it runs behind an iterator pandas UDF on filtered rows only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def anchor_scores(df: DataFrame, anchors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, anchor, score of each vector with each anchor (anchor, anchor_vector).

    Anchors are sent to all tasks: they are one for each topic, and more than 10,000 are refused.
    """
    if anchors.limit(10_001).count() > 10_000:
        raise ValueError("over 10,000 anchors: too many to compare every vector with")
    return df.select(key, vector).crossJoin(F.broadcast(anchors)).select(key, "anchor", cosine(F.col(vector), F.col("anchor_vector")).alias("score"))


def fuse(score: Column, hits: Column, each: float = 0.03, most: float = 0.15) -> Column:
    """A score with a bonus for dictionary hits, at most 1."""
    return F.least(score + F.least(hits * each, F.lit(most)), F.lit(1.0))


def ranked(scores: Column) -> Column:
    """Array of (label, score) by descending score; equals by label."""
    return F.array_sort(scores, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0))


def single_label(scores: Column, low: float = 0.35) -> Column:
    """(label, score) of the best; label 0 below low."""
    best = F.try_element_at(ranked(scores), F.lit(1))
    return F.struct(F.when(best["score"] >= low, best["label"]).otherwise(0).alias("label"), best["score"].alias("score"))


def multi_label(scores: Column, low: float = 0.35) -> Column:
    """The labels of low or more, best first."""
    return F.transform(F.filter(ranked(scores), lambda x: x["score"] >= low), lambda x: x["label"])


def second_label(scores: Column, first: Column, low: float = 0.2) -> Column:
    """The best label but first, of low or more; 0 without one."""
    rest = F.filter(ranked(scores), lambda x: (x["label"] != first) & (x["score"] >= low))
    return F.coalesce(F.try_element_at(rest, F.lit(1))["label"], F.lit(0))


def similarity_intensity(score: Column) -> Column:
    return F.when(score < 0.35, 0).when(score < 0.5, 1).when(score < 0.65, 2).otherwise(3)


#: Labels of models by sentiment; the numbered ones are those of unnamed three-class models.
SENTIMENTS = {
    **dict.fromkeys(("positive", "pos", "긍정", "호의적", "label_2"), "positive"),
    **dict.fromkeys(("negative", "neg", "부정", "비판적", "label_0"), "negative"),
    **dict.fromkeys(("neutral", "neu", "중립", "mixed", "label_1"), "neutral"),
}


def sentiment_name(label: Column) -> Column:
    """positive, negative or neutral; unknown labels are neutral."""
    known = F.create_map(*(F.lit(x) for kv in SENTIMENTS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(label))), F.lit("neutral"))


def fold_probabilities(probabilities: Column) -> Column:
    """(label, score, continuous) of array<(label, score)>: sums by sentiment, the highest, and positive minus negative."""
    total = lambda name: F.aggregate(F.filter(probabilities, lambda x: sentiment_name(x["label"]) == name), F.lit(0.0), lambda s, x: s + x["score"])
    pos, neu, neg = total("positive"), total("neutral"), total("negative")
    best = F.greatest(pos, neu, neg)
    label = F.when(pos == best, "positive").when(neg == best, "negative").otherwise("neutral")
    return F.struct(label.alias("label"), F.round(best, 4).alias("score"), F.round(pos - neg, 4).alias("continuous"))


Model = Callable[[list[str]], list]


def with_model(df: DataFrame, text: str, name: str, returns: str, factory: Callable[[], Model], batch: int = 128) -> DataFrame:
    """df with the model's results; the factory runs once for each worker."""

    @F.pandas_udf(returns)
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for part in parts:
            texts = part.fillna("").tolist()
            out: list = []
            for at in range(0, len(texts), batch):
                out += model(texts[at : at + batch])
            yield pd.Series(out)

    return df.withColumn(name, score(F.col(text)))


def embed_and_score(df: DataFrame, key: str, text: str, anchors: dict[int, str], factory: Callable[[], Model], batch: int = 128) -> DataFrame:
    """key, anchor, score: the cosine of each text's embedding with those of the anchors' texts, all by the same model."""
    given = df.sparkSession.createDataFrame(list(anchors.items()), "anchor int, text string")
    vectors = with_model(given, "text", "anchor_vector", "array<double>", factory, batch).select("anchor", "anchor_vector")
    return anchor_scores(with_model(df.select(key, text), text, "embedding", "array<double>", factory, batch), vectors, key, "embedding")


def cascade(df: DataFrame, candidate: Column, defaults: dict[str, Column], scored: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Defaults for rows that aren't candidates; for candidates what scored() adds to them, or the defaults where that is null.

    Candidates are filtered before the model sees them (a model inside a conditional
    expression would run on every row), and the others are put beside them: no join, no
    shuffle. scored keeps all rows and columns.
    """
    chosen = F.coalesce(candidate, F.lit(False))
    kept = [c for c in df.columns if c not in defaults]
    found = scored(df.where(chosen)).select(*kept, *(F.coalesce(F.col(c), d).alias(c) for c, d in defaults.items()))
    return found.unionByName(df.where(~chosen).select(*kept, *(d.alias(c) for c, d in defaults.items())))
