"""Plans and counts of the text models at size: what is shuffled, scanned and counted."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeframe.functions import terms
from lodeframe.operators import ml, sampling
from lodeframe.plans import catalogue


def test_folds_sort_no_label_in_one_task(spark):
    rows = [(i, None if i % 50 == 0 else int(i % 7 > 0)) for i in range(2000)] + [(7, 1)]
    df = spark.createDataFrame(rows, "id long, label int")
    got = sampling.folds(df, "label", "id", 3)
    assert "windowspecdefinition(label" not in got._jdf.queryExecution().toString()
    w = Window.partitionBy("label").orderBy(sampling.order_key("id", 42), "id")
    want = df.withColumn("fold", ((F.row_number().over(w) - 1) % 3).cast("int"))
    assert got.schema["fold"].dataType == want.schema["fold"].dataType
    assert "windowspecdefinition(label" in want._jdf.queryExecution().toString()
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_only_labelled_texts_are_scanned_for_rules(spark, sf):
    t = catalogue.Tables(spark, sf)
    plan = catalogue._labelled(t)._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Join ")
    assert "RLIKE" in above and "RLIKE" not in below and "regexp" not in below
    assert catalogue._labelled(t).count() == t.labels.count()


def test_ngrams_are_counted_in_one_pass_of_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(ml, "HELD", 40)
    rng = random.Random(3)
    rows = [(k, None if k == 5 else [rng.choice("abcdefgh") * rng.randrange(1, 12) for _ in range(rng.randrange(30))]) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, g array<string>")
    tf, n = Counter(x for _, g in rows for x in g or ()), Counter(x for _, g in rows for x in set(g or ()))
    assert {(r.gram, r.tf, r.df) for r in ml.gram_counts(df, "g").collect()} == {(x, tf[x], n[x]) for x in tf}


def test_pairs_of_words_are_the_ngrams_of_strings(spark):
    rng = random.Random(5)
    rows = [(k, None if k == 9 else " ".join(rng.choice(["aa", "bb", "cc", "dd", "ee"][k % 2 :]) for _ in range(rng.randrange(12))), k % 2) for k in range(120)]
    df = spark.createDataFrame(rows, "k int, text string, label int").withColumns({f"g{n}": ml.word_grams(F.col("text"), n) for n in (1, 2)})
    counts = [{tuple(r) for r in ml.gram_counts(df, *x).collect()} for x in (("g2",), ("g1", True))]
    assert counts[0] == counts[1] and any(" " in r[0] for r in counts[0])
    a, b = ml.fit(df, grams="g2", vocabulary=20), ml.fit(df, grams="g1", vocabulary=20, pairs=True)
    assert a.counts.vocabulary == b.counts.vocabulary and a.idf == b.idf
    scores = [{r.k: r.oda_prob for r in ml.score(m, df, digits=6).collect()} for m in (a, b)]
    assert len(scores[0]) == 120 and all(abs(scores[0][k] - scores[1][k]) < 1e-4 for k in scores[0])


def test_texts_are_scanned_once_for_rules_and_strata(spark, sf):
    rows = catalogue._rules(catalogue.Tables(spark, sf).texts).where("stratum <> 'negative'")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # Actor, vocabulary, shared sector and five topics; hits, short and long places.
    assert plan.count("RLIKE(") == 8 and plan.count("regexp_extract_all(") == 3


def test_parts_of_a_batch_are_bounded_and_give_the_same(monkeypatch):
    lists = pa.array([["a", "b", "a", "b"], None, [], ["b"], ["a", "b", "c"] * 9, ["c", "a", "b"]])
    whole = terms.Terms(["a", "b", "a b", "c a"], True).lookup()(lists)
    monkeypatch.setattr(terms, "PART", 4)
    assert [(at, len(x)) for at, x in terms._slices(lists)] == [(0, 3), (3, 1), (4, 1), (5, 1)]
    split = terms.Terms(["a", "b", "a b", "c a"], True).lookup()(lists)
    assert sorted(zip(*whole)) == sorted(zip(*split)) and (2, 8.0, 4) not in zip(*split) and (2, 9.0, 4) in zip(*split)
