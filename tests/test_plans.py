"""Plans keep the shape that scale asks for."""

import re

from pyspark.sql import functions as F

from lodeframe.operators import measures, scoring
from lodeframe.plans.catalogue import QUERIES, Tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark, sf):
    p = plan(Tables(spark, sf).art().groupBy("year", "sdg").count())
    schemas = " ".join(re.findall(r"ReadSchema: struct<([^>]*)>", p))
    assert "o_orderpriority" in schemas and "c_acctbal" not in schemas and "o_totalprice" not in schemas


def test_filters_reach_the_scan(spark, sf):
    t = Tables(spark, sf)
    assert "GreaterThan(o_totalprice" in plan(t.orders.where("o_totalprice > 1000").select("o_orderkey"))


def test_cells_take_two_aggregations(spark):
    df = spark.createDataFrame([(1, "a", 0.5, "x")], "k int, o string, s double, l string")
    p = plan(measures.cells(df, ["k"], "o", "s", "l"))
    assert p.count("Exchange hashpartitioning") == 2 and "Join" not in p


def test_models_run_behind_the_filter(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "id int, text string")
    seen = spark.sparkContext.accumulator(0)

    def factory():
        def model(texts):
            seen.add(len(texts))
            return [1] * len(texts)

        return model

    out = scoring.cascade(df, F.col("id") % 4 == 0, {"v": F.lit(0)}, lambda d: scoring.with_model(d, "text", "v", "int", factory))
    assert out.agg(F.sum("v")).first()[0] == 5 and seen.value == 5


def test_rolling_never_sorts_everything_in_one_task(spark, sf):
    p = plan(QUERIES["w01_w04_rolling"](spark, sf))
    single = [line for line in p.splitlines() if "Exchange SinglePartition" in line]
    assert len(single) <= 1  # the numbering of the distinct months
    assert "CartesianProduct" not in p


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_each_expression_is_evaluated_once(spark, sf):
    """Regular expressions in the optimised plans: one for each lexicon that is counted or looked for."""
    t = Tables(spark, sf)
    assert optimized(t.projects().where("sdg is not null").groupBy("year", "sdg").count()).count("regexp_extract(") <= 4
    counted = lambda name: [optimized(QUERIES[name](spark, sf)).count(x) for x in ("regexp_extract_all(", "RLIKE", "Relation [doc_id")]
    assert counted("t07_t14_classify") == [5 + 3 + 2 + 5, 5, 1]  # a count is an extraction in this plan
    assert counted("t15_t17_distinct_terms") == [1, 0, 1]
    assert counted("t18_t19_places") == [4, 0, 1]
    assert counted("o06_stratified_draw") == [0, 0, 1]  # it reads what was written once
    assert counted("t39_t40_cascade") == [2 * 5, 2 * 3, 2]  # candidates and others, each filtered by the rules
    assert "Join" not in optimized(QUERIES["t39_t40_cascade"](spark, sf))


def test_no_window_takes_all_rows(spark, sf):
    """Windows without partitions see the totals of ranges, or a limited number of rows."""
    for name in ("o08_o09_halves", "o11_every", "m03_fixed_effects", "m08_binary_metrics", "m09_ranking_metrics"):
        lone = []
        for line in plan(QUERIES[name](spark, sf)).splitlines():
            parts = re.search(r"Window \[.*?\]((?:, \[[^\[\]]*\])+)$", line)
            if parts and parts[1].count(", [") == 1 and "NULLS" in parts[1]:
                lone.append(parts[1])
        assert all("__part" in x for x in lone) or name == "m09_ranking_metrics" and sum("__part" not in x for x in lone) == 1


def test_small_tables_are_spread(spark, sf):
    t = Tables(spark, sf)
    assert t.texts.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
