"""Scalar and text functions, with the cases that are easily got wrong."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from lodeframe.functions import scalar, topics
from lodeframe.operators import aid, measures, ml, order, sampling, scoring, stats

LEX = {1: ["빈곤", "빈곤율"], 2: ["학교"], 3: ["ODA"]}


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("v")).first()[0]


def test_occurrences_and_distinct_terms_differ(spark):
    t = F.lit("빈곤율 빈곤 ODA")
    assert one(spark, topics.occurrence_counts(t, LEX)) == [2, 0, 1]
    assert one(spark, topics.occurrence_counts(F.lit("빈곤율"), LEX)) == [1, 0, 0]
    assert one(spark, topics.distinct_terms(F.lit("빈곤율"), LEX[1])) == 2


def test_capital_terms_match_unless_legacy(spark):
    assert one(spark, topics.topic_hits(F.lit("ODA 확대"), LEX)) == [3]
    assert one(spark, topics.topic_hits(F.lit("ODA 확대"), LEX, legacy_case=True)) == []


def test_null_text_counts_nothing(spark):
    t = F.lit(None).cast("string")
    assert one(spark, topics.occurrence_counts(t, LEX)) == [0, 0, 0]
    assert one(spark, topics.topic_hits(t, LEX)) == []
    assert one(spark, topics.places(t, {"이란": "IRN"})) == []


def test_short_names_dont_match_inside_words(spark):
    names = {"이란": "IRN", "베트남": "VNM", "아시아 지역": "---"}
    assert one(spark, topics.places(F.lit("건강이란 무엇인가"), names)) == []
    assert one(spark, topics.places(F.lit("이란의 핵협상, 아시아 지역"), names)) == ["IRN"]


def test_recipients_fall_back_to_all_names():
    names = {"a": "A", "b": "B"}
    assert topics.recipients_only(names, None) == names
    assert topics.recipients_only(names, {"B"}) == {"b": "B"}


def test_actor_in_any_case(spark):
    assert one(spark, topics.holds(F.lit("x koica y"), ["KOICA"], any_case=True)) is True
    assert one(spark, topics.holds(F.lit("x koica y"), ["KOICA"])) is False


def test_ties_go_to_the_lowest_topic(spark):
    c = F.array(F.lit(2), F.lit(5), F.lit(5))
    assert one(spark, topics.primary(c)) == 2
    assert one(spark, topics.secondary(c, F.lit(2))) == 3
    assert one(spark, topics.primary(F.array(F.lit(0)))) == 0


def test_metacharacters_are_plain(spark):
    assert one(spark, topics.occurrences(F.lit("a.b axb c++"), ["a.b", "c++"])) == 2


def test_dates(spark):
    for text, day in [("2024-01-05 09:30", "2024-01-05"), ("2024-01-05T09:30:00", "2024-01-05"), ("2024-1-5", "2024-01-05"), ("20240105", "2024-01-05"), ("n/a", "None"), ("2024013", "None")]:
        assert str(one(spark, scalar.parse_date(F.lit(text)))) == day
    y, m = scalar.year_month(F.lit("2024-13-01"))
    assert one(spark, y) is None and one(spark, m) is None
    assert one(spark, scalar.year_month(F.lit("20241301"), check_month=False)[1]) == 13


def test_lists_codes_and_tags(spark):
    assert one(spark, scalar.to_list(F.lit("a| b ,c||"))) == ["a", "b ,c"]
    assert one(spark, scalar.to_list(F.lit(None).cast("string"))) == []
    assert one(spark, scalar.sector_code(F.lit("12399, 11110"))) == "12399"
    assert one(spark, scalar.sector_code(F.lit("x"))) is None
    assert [one(spark, scalar.goal_tag(F.lit(x))) for x in ("16.5", "18", "0", "x")] == [16, None, None, None]
    assert [one(spark, scalar.number(F.lit(x))) for x in ("1.5", "abc")] == [1.5, 0.0]


def test_headers_match_without_white_space(spark):
    df = spark.createDataFrame([("1", "t", "")], ["뉴스식별자", "제목", "extra"])
    from lodeframe.sources.articles import ALIASES

    out = scalar.canonicalise(df, ALIASES).first()
    assert (out["article_id"], out["title"], out["extra"]) == ("1", "t", "")


def test_years():
    assert scalar.years_of("2010-2012,2015") == [2010, 2011, 2012, 2015]


def test_strata_partition_rows(spark):
    bools = [(a, b) for a in (True, False, None) for b in (True, False)]
    df = spark.createDataFrame(bools, "a boolean, p boolean")
    c = topics.candidate(F.col("a"), F.lit(0), F.lit(True), F.lit(False), F.lit(False))
    assert {r[0] for r in df.select(topics.stratum(c, F.col("p"))).collect()} <= {"candidate", "borderline", "negative"}


def test_one_outlet_and_equal_outlets(spark):
    rows = [(1, "a", 0.5, "positive"), (2, "a", 0.5, "positive"), (2, "b", 0.7, "negative")]
    out = {r.k: r for r in measures.cells(spark.createDataFrame(rows, "k int, o string, s double, l string"), ["k"], "o", "s", "l").collect()}
    assert (out[1].hhi, out[1].entropy, out[1].sentiment_variance) == (1.0, 0.0, 0.0)
    assert (out[2].hhi, out[2].entropy) == (0.5, 1.0)
    assert abs(out[2].sentiment_variance - 0.02) < 1e-12


def test_rolling_counts_observed_months_without_the_current(spark):
    rows = [(2020, 1, 1, "x", 2), (2020, 2, 1, "y", 1), (2020, 5, 1, "x", 3), (2020, 6, 1, "x", 4)]
    out = {(r.country, r.month): r for r in measures.rolling(spark.createDataFrame(rows, "year int, month int, sdg int, country string, freq_articles long")).collect()}
    assert [out["x", m].rolling_3m for m in (1, 5, 6)] == [0, 2, 5]
    assert out["x", 1].persistence_score == 1.0
    assert out["x", 6].persistence_score == 4 / (5 / 3)
    assert (out["x", 1].cumulative_all_time, out["x", 5].cumulative_running) == (9, 5)


def test_quotas_spill():
    assert sampling.quotas(10, {"candidate": 0.5, "borderline": 0.3, "negative": 0.2}, {"candidate": 3, "borderline": 9, "negative": 9}) == {"candidate": 3, "borderline": 3, "negative": 4}


def test_t_distribution_matches_published_values():
    for t, df, p in [(2.228, 10, 0.05), (1.96, 1e6, 0.05), (2.763, 28, 0.01), (0, 5, 1.0)]:
        assert abs(stats.t_p_value(t, df) - p) < 2e-4


def test_fixed_effects_recover_a_slope():
    rows = [(u, y, x := (u * 7 + y * 3 + u * y) % 11 / 10, 2 * x + u + 0.5 * y) for u in range(5) for y in range(8)]
    fit = stats.fixed_effects(rows)
    assert abs(fit["coef"] - 2) < 1e-9 and fit["df_r"] == 40 - 1 - 1 - 4 - 7
    assert stats.fixed_effects(rows[:9]) is None


def test_label_decisions(spark):
    s = F.array(*(F.struct(F.lit(k).alias("label"), F.lit(v).alias("score")) for k, v in ((1, 0.4), (2, 0.5), (3, 0.5), (4, 0.1))))
    assert one(spark, scoring.multi_label(s)) == [2, 3, 1]
    assert one(spark, scoring.second_label(s, F.lit(2))) == 3
    assert one(spark, scoring.single_label(s, 0.6))["label"] == 0


def test_every_sentiment_label(spark):
    for label, name in [("호의적", "positive"), ("비판적", "negative"), ("mixed", "neutral"), ("neu", "neutral"), ("POS", "positive"), ("?", "neutral")]:
        assert one(spark, scoring.sentiment_name(F.lit(label))) == name


def test_found_terms_are_all_substrings(spark):
    """One scan finds what one search for each term finds, terms that begin others and metacharacters too."""
    rng = random.Random(1)
    for _ in range(30):
        terms = ["".join(rng.choice("ab.c") for _ in range(rng.randrange(1, 5))) for _ in range(8)]
        text = "".join(rng.choice("ab.c ") for _ in range(40))
        assert sorted(one(spark, topics.found_terms(F.lit(text), terms))) == sorted({t for t in terms if t in text})
    assert one(spark, topics.found_terms(F.lit("x"), [])) == []
    assert sorted(one(spark, topics.found_terms(F.lit("xab ab"), ["ab", "a"], "(?<![a-z])"))) == ["a", "ab"]


def test_names_and_codes(spark):
    codes = {"이란": "IRN", "페르시아": "IRN", "베트남": "VNM"}
    assert one(spark, topics.code_of(F.lit("베트남"), codes)) == "VNM" and one(spark, topics.code_of(F.lit("x"), codes)) is None
    assert one(spark, topics.names_of_code(F.lit("IRN"), codes)) == ["이란", "페르시아"] and one(spark, topics.names_of_code(F.lit("x"), codes)) == []
    assert one(spark, topics.places(F.lit("건강이란 무엇인가, 베트남과 이란"), codes)) == ["IRN", "VNM"]
    assert one(spark, topics.places(F.lit("x"), {})) == []


def test_tags_with_zeros_and_long_numbers(spark):
    assert [one(spark, scalar.goal_tag(F.lit(x))) for x in ("016", " 3.", "170", "1 7", "99999999999", "")] == [16, 3, None, 1, None, None]


def test_hash_orders_take_any_id(spark):
    rows = spark.createDataFrame([(f"id{k}", "a" if k % 3 else "b") for k in range(200)], "k string, s string")
    drawn = sampling.stratified(rows, "s", "k", 50, {"a": 0.8, "b": 0.2}, spill_to="b")
    assert dict(drawn.groupBy("s").count().collect()) == {"a": 40, "b": 10}
    assert drawn.select("k").orderBy("k").collect() == sampling.stratified(rows.repartition(3), "s", "k", 50, {"a": 0.8, "b": 0.2}, spill_to="b").select("k").orderBy("k").collect()
    big = spark.createDataFrame([(4 * 10**15 + k,) for k in range(9)], "k long")
    assert sampling.halves(big, "k", arithmetic=True).where("half = 0").count() == 5 == sampling.halves(big, "k").where("half = 0").count()


def test_running_totals_over_ranges(spark):
    rng = random.Random(2)
    values = [rng.randrange(10**6) for _ in range(500)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v long")
    out = {r.k: r for r in order.cumulated(df, [F.desc("v"), "k"], {"n": F.lit(1), "t": F.col("v")}, parts=7).collect()}
    total = 0
    for n, k in enumerate(sorted(out, key=lambda k: (-values[k], k)), 1):
        total += values[k]
        assert (out[k].n, out[k].t) == (n, total)
    assert sorted(r.v for r in sampling.every(df.select("v").distinct(), "v", 50).collect()) == sorted(set(values))[::50]
    assert order.numbered(df.limit(0), ["v"]).count() == 0


def test_fits_of_balanced_and_other_panels_agree(spark):
    rng = random.Random(3)
    rows = [(u, t, rng.random(), rng.random()) for u in range(6) for t in range(7)]
    for some in (rows, rows[:-3]):
        want = stats.fixed_effects(some)
        got = stats.two_way(spark.createDataFrame(some, "u int, t int, x double, y double"), "u", "t", "x", "y").first().asDict()
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert stats.two_way(spark.createDataFrame(rows[:8], "u int, t int, x double, y double"), "u", "t", "x", "y").count() == 0


def test_character_grams_are_those_of_words_with_blanks(spark):
    def plain(text):
        out = []
        for w in text.lower().split():
            w = f" {w} "
            for n in range(2, 5):
                out += [w[i : i + n] for i in range(max(len(w) - n + 1, 1))]
                if len(w) <= n:
                    break
        return out

    for text in ("a", "ab cd", "Ünder  the\nbig tree", ""):
        assert sorted(one(spark, ml.char_grams(F.lit(text)))) == sorted(plain(text))
    assert one(spark, ml.word_grams(F.lit("The a big tree"), 3)) == ["the", "big", "tree", "the big", "big tree", "the big tree"]


def test_weights_and_scores_of_a_text_model(spark):
    """Log counts, idf + 1, unit length, extra features and the logistic function, in plain arithmetic."""
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["aa", "bb", "cc", "dd"][k % 2 :]) for _ in range(rng.randrange(1, 9))), float(k % 3), k % 2) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, text string, f double, label int").withColumn("g", ml.word_grams(F.col("text"), 1))
    m = ml.fit(df, grams="g", extra=["f"], sublinear=True)
    vocabulary = m.counts.vocabulary
    for t, idf in zip(vocabulary, m.idf, strict=True):
        assert abs(idf - (math.log(61 / (1 + sum(t in r[1].split() for r in rows))) + 1)) < 1e-9
    for r in ml.score(m, df, digits=9).collect():
        w = {t: (1 + math.log(n)) * m.idf[vocabulary.index(t)] for t, n in Counter(r.text.split()).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        z = m.intercept + m.coef[0] * r.f + sum(x / norm * m.coef[1 + vocabulary.index(t)] for t, x in w.items())
        assert abs(r.oda_prob - 1 / (1 + math.exp(-z))) < 1e-8
    for r in ml.sentiment(m, ml.score(m, df, digits=9)).collect():
        assert r.sentiment_label == ("positive" if r.oda_prob >= 0.5 else "negative")
        assert abs(r.sentiment_score - max(r.oda_prob, 1 - r.oda_prob)) < 1e-4 and abs(r.sentiment_continuous - (2 * r.oda_prob - 1)) < 1e-4
    # What is minimised: the balanced loss, with a penalty of inverse strength 1.
    def loss(coef, intercept):
        total = sum(x * x for x in coef) / 2
        for r in df.collect():
            w = {t: (1 + math.log(n)) * m.idf[vocabulary.index(t)] for t, n in Counter(r.text.split()).items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            z = intercept + coef[0] * r.f + sum(x / norm * coef[1 + vocabulary.index(t)] for t, x in w.items())
            total += math.log1p(math.exp(-z if r.label else z))
        return total

    best = loss(m.coef, m.intercept)
    for i in range(len(m.coef)):
        for step in (-0.05, 0.05):
            assert loss([c + step * (j == i) for j, c in enumerate(m.coef)], m.intercept) > best - 1e-4


def test_sums_of_amounts_do_not_depend_on_the_order_of_rows(spark):
    """Amounts of eight places whose sums lie right between two of four: half up of the exact sum, NaN and large amounts as they are."""
    rng, rows, want = random.Random(21), [], {}
    for k in range(300):
        units = [rng.randrange(10**6, 10**7) for _ in range(20)]
        units.append(10_000 + (5_000 - sum(units)) % 10_000)
        rows += [(k, u / 1e8) for u in units]
        want[k] = (sum(units) // 10_000 + 1) / 1e4
    rows += [(-1, float("nan")), (-1, 1.0), (-2, 1e20), (-2, None), (-3, None)]
    got = {r.k: r.total for r in spark.createDataFrame(rows, "k int, amount double").groupBy("k").agg(F.round(aid.total("amount"), 4).alias("total")).collect()}
    assert math.isnan(got.pop(-1)) and got.pop(-2) == 1e20 and got.pop(-3) is None
    assert got == want
