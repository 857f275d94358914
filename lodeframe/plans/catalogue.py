"""The catalogue of queries: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL beside each.

Names begin with the operator's id. The driver's tables stand in for articles (orders and
customers), spending (lineitem), texts (documents), coders (labels) and logs (events).
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeframe.functions import scalar, topics
from lodeframe.operators import aid, calendar, measures, sampling, scoring, stats
from lodeframe.plans import panels
from lodeframe.session import few, spread
from lodeframe.shipping import ship
from lodeframe.sources import articles as files
from lodeframe.sources import files as by_year
from lodeframe.sources import lexicons
from lodeframe.sources.scratch import scratch, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Fixture tables, and the views that queries share."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def texts(self) -> DataFrame:
        """documents, in as many tasks as there are cores even if they are one small file."""
        return spread(self.documents, "doc_id")

    def art(self) -> DataFrame:
        df = self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(self.nation), F.col("c_nationkey") == F.col("n_nationkey"))
        return df.select(
            F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.substring("o_orderpriority", 1, 1).cast("int").alias("sdg"), F.col("n_name").alias("country"),
            F.col("c_mktsegment").alias("outlet"), (F.col("o_totalprice") / 1e6).alias("score"), F.col("o_orderstatus").alias("label"), F.col("o_orderdate").cast("date").alias("day"),
        )

    def cells(self) -> DataFrame:
        return measures.cells(self.art(), ["year", "month", "sdg", "country"], "outlet", "score", "label", positive="O", neutral="P", negative="F")

    def spend(self) -> DataFrame:
        df = self.lineitem.join(self.supplier.join(F.broadcast(self.nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name"), F.col("l_suppkey") == F.col("s_suppkey"))
        df = df.join(self.part.select("p_partkey", "p_brand", "p_size", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
        return df.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("project_id"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), F.when(F.col("n_name") != "CHINA", F.col("n_name")).alias("country"), F.col("l_returnflag").alias("fund"),
            F.col("p_brand").alias("sector"), F.when(F.col("p_size") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".5"))).alias("tag"), F.when(F.col("l_linestatus") == "O", F.lit("major")).otherwise("none").alias("marker"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1e6).alias("disbursement"), (F.col("l_extendedprice") / 1e6).alias("commitment"),
        )

    def projects(self) -> DataFrame:
        exact = self.spark.createDataFrame([("Brand#11", 1), ("Brand#23", 2), ("Brand#35", 3), ("Brand#42", 4)], "key string, value int")
        prefix = self.spark.createDataFrame([("Brand#1", 5), ("Brand#2", 6), ("Brand#4", 7)], "key string, value int")
        df = aid.crosswalk(self.spend(), "sector", exact, prefix, digits=7)
        df = df.withColumns({"tag_sdg": scalar.goal_tag(F.col("tag")), "marker_sdg": aid.by_marker([(F.col("marker"), 13)], ["major", "partial"])})
        return aid.topic_and_source(df, "tag_sdg", "sector_sdg", "marker_sdg")

    def grid(self) -> DataFrame:
        return calendar.months(self.spark, "1995-01-01", "2001-12-01")

    def terms(self) -> DataFrame:
        return self.spark.createDataFrame([("A", "left", "1995-01-10", "1997-02-24"), ("B", "right", "1997-02-25", "1999-06-30"), ("C", "left", "1999-06-15", "2002-01-01")], "holder string, side string, start string, end string").withColumns({"start": F.to_date("start"), "end": F.to_date("end")})

    def crisis_events(self) -> DataFrame:
        rows = [(1995, 3, "disaster", 2, [1, 3]), (1995, 3, "health", 3, [3]), (1996, 7, "conflict", 1, [4, 5]), (1997, 1, "food", 2, [2]), (1998, 5, "disaster", 3, [1, 2, 5]), (1999, 12, "conflict", 2, [5]), (2000, 2, "health", 1, [3])]
        return self.spark.createDataFrame(rows, "year int, month int, kind string, severity int, topics array<int>")

    def coders(self) -> DataFrame:
        return self.labels.select("doc_id", F.col("quality").alias("a"), F.col("toxic").alias("b"))

    def log(self) -> DataFrame:
        return self.events.select(F.col("ts").cast("date").alias("day"), F.col("event_id").alias("at"), F.when(F.col("event_id") % 3 == 0, "done").when(F.col("event_id") % 3 == 1, "failed").otherwise("running").alias("status"), F.col("user_id").alias("count"))


ART = """art AS (SELECT o_orderkey AS id, year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month, substr(o_orderpriority, 1, 1)::INTEGER AS sdg, n_name AS country,
 c_mktsegment AS outlet, o_totalprice / 1e6::DOUBLE AS score, o_orderstatus AS label, o_orderdate::DATE AS day FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
_CELL_KEYS = "year, month, sdg, country"
CELLS = f"""{ART}, byo AS (SELECT {_CELL_KEYS}, outlet, count(*) AS n FROM art GROUP BY ALL),
hhi AS (SELECT {_CELL_KEYS}, sum((n / t::DOUBLE) ** 2) AS hhi, abs(sum(n / t::DOUBLE * log2(n / t::DOUBLE))) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY {_CELL_KEYS}) AS t FROM byo) GROUP BY ALL),
base AS (SELECT {_CELL_KEYS}, count(*) AS freq_articles, avg(score) AS avg_sentiment, coalesce(var_samp(score), 0) AS sentiment_variance, coalesce(stddev_samp(score), 0) AS sentiment_std,
 avg((label = 'O')::INTEGER) AS share_positive, avg((label = 'P')::INTEGER) AS share_neutral, avg((label = 'F')::INTEGER) AS share_negative FROM art GROUP BY ALL),
cells AS (SELECT base.*, share_positive * share_negative AS polarization_index, hhi, entropy FROM base JOIN hhi USING ({_CELL_KEYS}))"""
ROLLED = f"""{CELLS}, mon AS (SELECT year, month, row_number() OVER (ORDER BY year, month) - 1 AS idx FROM (SELECT DISTINCT year, month FROM cells)),
num AS (SELECT cells.*, idx FROM cells JOIN mon USING (year, month)),
rolled AS (SELECT *, coalesce(sum(freq_articles) OVER (s RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rolling_3m,
 coalesce(sum(freq_articles) OVER (s RANGE BETWEEN 6 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rolling_6m, coalesce(sum(freq_articles) OVER (s RANGE BETWEEN 12 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rolling_12m,
 sum(freq_articles) OVER (PARTITION BY sdg, country, year ORDER BY idx)::BIGINT AS cumulative_ytd, sum(freq_articles) OVER (PARTITION BY sdg, country)::BIGINT AS cumulative_all_time,
 sum(freq_articles) OVER (s RANGE UNBOUNDED PRECEDING)::BIGINT AS cumulative_running FROM num WINDOW s AS (PARTITION BY sdg, country ORDER BY idx))"""
PERSISTENCE = "CASE WHEN rolling_12m > 0 THEN freq_articles / (rolling_12m::DOUBLE / least(idx, 12)) ELSE 1.0 END"
SPEND = """spend AS (SELECT l_orderkey * 10 + l_linenumber AS project_id, year(l_shipdate)::INTEGER AS year, month(l_shipdate)::INTEGER AS month, CASE WHEN n_name <> 'CHINA' THEN n_name END AS country, l_returnflag AS fund, p_brand AS sector,
 CASE WHEN p_size % 3 = 0 THEN p_size || '.5' END AS tag, CASE WHEN l_linestatus = 'O' THEN 'major' ELSE 'none' END AS marker, l_extendedprice * (1 - l_discount) / 1e6::DOUBLE AS disbursement, l_extendedprice / 1e6::DOUBLE AS commitment
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
PROJECTS = f"""{SPEND}, ex(k, v) AS (VALUES ('Brand#11', 1), ('Brand#23', 2), ('Brand#35', 3), ('Brand#42', 4)), pf(k, v) AS (VALUES ('Brand#1', 5), ('Brand#2', 6), ('Brand#4', 7)),
coded AS (SELECT spend.*, coalesce(ex.v, pf.v) AS sector_sdg, CASE WHEN try_cast(regexp_extract(tag, '^([0-9]+)', 1) AS INTEGER) BETWEEN 1 AND 17 THEN try_cast(regexp_extract(tag, '^([0-9]+)', 1) AS INTEGER) END AS tag_sdg,
 CASE WHEN marker IN ('major', 'partial') THEN 13 END AS marker_sdg FROM spend LEFT JOIN ex ON sector = ex.k LEFT JOIN pf ON substr(sector, 1, 7) = pf.k),
projects AS (SELECT *, coalesce(tag_sdg, sector_sdg, marker_sdg) AS sdg, CASE WHEN tag_sdg IS NOT NULL THEN 'direct_tag' WHEN sector_sdg IS NOT NULL THEN 'sector_code' WHEN marker_sdg IS NOT NULL THEN 'marker' ELSE 'none' END AS sdg_source FROM coded)"""
GRID = "grid AS (SELECT year(d)::INTEGER AS year, month(d)::INTEGER AS month, d::DATE AS first FROM generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH) t(d))"
TERMS = "terms(holder, side, s, e) AS (VALUES ('A', 'left', DATE '1995-01-10', DATE '1997-02-24'), ('B', 'right', DATE '1997-02-25', DATE '1999-06-30'), ('C', 'left', DATE '1999-06-15', DATE '2002-01-01'))"
CRISIS = "ev(year, month, kind, severity, topics) AS (VALUES (1995, 3, 'disaster', 2, [1, 3]), (1995, 3, 'health', 3, [3]), (1996, 7, 'conflict', 1, [4, 5]), (1997, 1, 'food', 2, [2]), (1998, 5, 'disaster', 3, [1, 2, 5]), (1999, 12, 'conflict', 2, [5]), (2000, 2, 'health', 1, [3]))"
LOG = "log AS (SELECT ts::DATE AS day, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'done' WHEN event_id % 3 = 1 THEN 'failed' ELSE 'running' END AS status, user_id AS cnt FROM events), state AS (SELECT day, arg_max(status, seq) AS status, arg_max(cnt, seq) AS cnt FROM log GROUP BY day)"

KINDS = ("disaster", "conflict", "health", "food")
LEXICON = {1: ["that", "than"], 2: ["with", "wi"], 3: ["für", "von", "den"], 4: ["la", "les"], 5: ["para", "The", "por"]}
FRAMES = {"humanitarian": ["and", "est"], "economic": ["of", "que"], "security": ["this", "nicht"], "environmental": ["for", "dans"], "governance": ["from", "mit"]}
CRISES = {"disaster": ["shed"], "climate": ["erea"], "conflict": ["ichen"], "health": ["ement"]}
PLACES = {"tha": "AAA", "ing": "BBB", "tion": "CCC", "schte": "DDD", "ment": "EEE", "ado": "FFF", "nowhere": "---", "an": "---"}


def q(sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE[f.__name__] = sql if sql.lstrip().upper().startswith("SELECT") else "WITH " + sql
        return run

    return add


def r(c: str | Column, digits: int = 4) -> Column:
    return F.round(c, digits).alias(c) if isinstance(c, str) else F.round(c, digits)


# --- flagship -----------------------------------------------------------------------------

_FLOATS = ("avg_sentiment", "sentiment_variance", "sentiment_std", "share_positive", "share_neutral", "share_negative", "polarization_index", "hhi", "entropy")


@q(f"""{ROLLED} SELECT {_CELL_KEYS}, freq_articles, {', '.join(f'round({c}, 4) AS {c}' for c in _FLOATS)}, rolling_3m, rolling_6m, rolling_12m, cumulative_ytd, cumulative_all_time, cumulative_running, round({PERSISTENCE}, 4) AS persistence_score,
 round(freq_articles / sum(freq_articles) OVER (PARTITION BY year, month)::DOUBLE, 5) AS freq_share_total, round(freq_articles / sum(freq_articles) OVER (PARTITION BY year, month, sdg)::DOUBLE, 5) AS freq_share_sdg FROM rolled""")
def flagship_topic_country_month(t: Tables) -> DataFrame:
    out = measures.shares(measures.rolling(t.cells()))
    return out.withColumns({c: F.round(c, 4) for c in (*_FLOATS, "persistence_score")})


# --- S: sources and sinks ------------------------------------------------------------------


@q("SELECT doc_id::VARCHAR AS doc_id, lang, source FROM documents")
def s01_s10_csv_round_trip(t: Tables) -> DataFrame:
    path = scratch(t.spark, "csv")
    files.write_csv(t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "source"), path)
    return files.read_csv(t.spark, path, ["doc_id", "lang", "source"])


@q("SELECT event_id % 97 AS news_id, max(event_id) AS seq, arg_max(event_type, event_id) AS title FROM events GROUP BY 1")
def s06_upsert(t: Tables) -> DataFrame:
    rows = t.events.select((F.col("event_id") % 97).alias("news_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("title"))
    return files.upsert(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"), "news_id", "seq")


@q(f"{LOG} SELECT day::VARCHAR AS day, status, cnt AS count FROM state")
def s07_log_state(t: Tables) -> DataFrame:
    return files.log_state(t.log()).withColumn("day", F.col("day").cast("string"))


@q(f"{LOG} SELECT d::DATE::VARCHAR AS day FROM generate_series(DATE '2023-12-28', DATE '2024-02-03', INTERVAL 1 DAY) g(d) WHERE d::DATE NOT IN (SELECT day FROM state WHERE status = 'done')")
def s08_uncollected(t: Tables) -> DataFrame:
    return files.uncollected(t.spark, files.log_state(t.log()), "2023-12-28", "2024-02-03").select(F.col("day").cast("string").alias("day"))


@q(f"{LOG} SELECT day::VARCHAR AS day FROM state WHERE status = 'failed'")
def s09_failed(t: Tables) -> DataFrame:
    return files.failed(files.log_state(t.log())).select(F.col("day").cast("string").alias("day"))


@q(f"{ART} SELECT year, month, id % 500 AS article_id, min(id) AS first_id FROM art GROUP BY ALL")
def s11_compile_month(t: Tables) -> DataFrame:
    rows = t.art().select("year", "month", F.col("id").alias("first_id"), (F.col("id") % 500).alias("article_id"), F.concat_ws("-", "year", "month", F.col("id") % 500).alias("k"))
    return files.compile_month(rows, "k", "first_id").drop("k")


@q(f"{ART} SELECT year, count(*) AS n FROM art GROUP BY year")
def s12_split_years(t: Tables) -> DataFrame:
    path = scratch(t.spark, "years")
    files.write_years(t.art(), path)
    return t.spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("n"))


@q("SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id < 7)")
def s16_pending(t: Tables) -> DataFrame:
    return files.pending(t.documents.select("source").distinct(), t.documents.where("doc_id < 7"), "source")


# --- P: projection and normalisation -----------------------------------------------------------


@q("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN lang END, ''), source) AS v FROM documents")
def p01_first_filled(t: Tables) -> DataFrame:
    a = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("lang"))
    return t.documents.select("doc_id", scalar.first_filled(a, F.col("source")).alias("v"))


@q("SELECT doc_id FROM documents WHERE CASE WHEN doc_id % 4 <> 0 THEN lang END IS NOT NULL")
def p02_required(t: Tables) -> DataFrame:
    return scalar.required(t.documents.withColumn("x", F.when(F.col("doc_id") % 4 != 0, F.col("lang"))), "x").select("doc_id")


@q("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' ELSE ts::DATE::VARCHAR END AS d FROM events""")
def p03_parse_date(t: Tables) -> DataFrame:
    ts, k = F.col("ts"), F.col("event_id") % 5
    text = F.when(k == 0, "n/a").when(k == 1, F.date_format(ts, "yyyy-MM-dd HH:mm")).when(k == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 3, F.date_format(ts, "yyyyMMdd")).otherwise(F.date_format(ts, "yyyy-M-d"))
    return t.events.select("event_id", F.coalesce(scalar.parse_date(text).cast("string"), F.lit("")).alias("d"))


@q("SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN year(ts)::INTEGER ELSE -1 END AS year, CASE WHEN event_id % 4 <> 0 THEN month(ts)::INTEGER ELSE -1 END AS month FROM events")
def p04_year_month(t: Tables) -> DataFrame:
    text = F.when(F.col("event_id") % 4 == 0, "2024013").when(F.col("event_id") % 4 == 1, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 4 == 2, F.date_format("ts", "yyyy/MM/dd")).otherwise(F.date_format("ts", "yyyyMMdd"))
    y, m = scalar.year_month(text)
    return t.events.select("event_id", y.alias("year"), m.alias("month")).fillna(-1)


@q("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(CASE WHEN contains(x, '|') THEN x ELSE replace(x, ',', '|') END, '|'), lambda s: trim(s)), lambda s: s <> ''), ';') AS v FROM (SELECT doc_id, lang || CASE WHEN doc_id % 2 = 0 THEN ' | ' ELSE ' , ' END || source || ',' AS x FROM documents)")
def p05_to_list(t: Tables) -> DataFrame:
    text = F.concat("lang", F.when(F.col("doc_id") % 2 == 0, " | ").otherwise(" , "), "source", F.lit(","))
    return t.documents.select("doc_id", F.array_join(scalar.to_list(text), ";").alias("v"))


@q("SELECT o_orderkey, n_name AS outlet, n_regionkey::VARCHAR AS media_category FROM orders LEFT JOIN nation ON o_custkey % 40 = n_nationkey")
def p06_outlet_lookup(t: Tables) -> DataFrame:
    codes = t.nation.select(F.col("n_nationkey").cast("long").alias("code"), F.col("n_name").alias("outlet"), F.col("n_regionkey").cast("string").alias("media_category"))
    return files.outlet_lookup(t.orders.select("o_orderkey", (F.col("o_custkey") % 40).alias("code")), codes).select("o_orderkey", "outlet", "media_category")


@q("SELECT r_name AS media_category, string_agg(n_name, ',' ORDER BY n_name) AS codes FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def p07_codes_of_category(t: Tables) -> DataFrame:
    return files.codes_of_category(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("media_category"), F.col("n_name").alias("code")))


@q("SELECT doc_id, coalesce(source, '') || ' ' || coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, '') AS short, coalesce(source, '') || ' ' || coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, '') || ' ' || substr(text, 1, 300) AS long, substr(text, 1, 250) AS preview, CASE WHEN doc_id % 2 = 0 THEN source || ' ' || lang ELSE source END AS two FROM documents")
def p08_p11_text_columns(t: Tables) -> DataFrame:
    half = F.when(F.col("doc_id") % 2 == 0, F.col("lang"))
    short = scalar.joined_text(F.col("source"), half)
    return t.documents.select("doc_id", short.alias("short"), scalar.long_text(short, F.col("text")).alias("long"), scalar.preview(F.col("text"), 250).alias("preview"), scalar.first_two_filled(F.col("source"), half, F.lit(" ")).alias("two"))


@q("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_totalprice END AS amount, CASE WHEN o_orderkey % 4 <> 0 THEN year(o_orderdate)::INTEGER ELSE -1 END AS year FROM orders")
def p12_numbers(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    amount = F.when(k % 3 == 0, "abc").otherwise(F.col("o_totalprice").cast("string"))
    year = F.when(k % 4 == 0, "n/a").otherwise(F.concat(F.year("o_orderdate").cast("string"), F.lit(".0")))
    return t.orders.select("o_orderkey", scalar.number(amount).alias("amount"), scalar.whole(year).alias("year")).fillna(-1, ["year"])


@q("SELECT p_partkey, nullif(substr(regexp_replace(string_split(x, ',')[1], '[^0-9]', '', 'g'), 1, 5), '') AS code, CASE WHEN p_size BETWEEN 1 AND 17 THEN p_size ELSE -1 END AS tag FROM (SELECT p_partkey, p_size, CASE WHEN p_partkey % 5 = 0 THEN 'none' ELSE p_brand || p_size || '77, 999' END AS x FROM part)")
def p13_p14_codes(t: Tables) -> DataFrame:
    x = F.when(F.col("p_partkey") % 5 == 0, "none").otherwise(F.concat("p_brand", F.col("p_size").cast("string"), F.lit("77, 999")))
    return t.part.select("p_partkey", scalar.sector_code(x).alias("code"), scalar.goal_tag(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".5"))).alias("tag")).fillna(-1, ["tag"])


@q("SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'mid' ELSE 'high' END AS band, CASE WHEN o_orderstatus IN ('O', 'P') THEN 1 ELSE 0 END AS open FROM orders WHERE year(o_orderdate) IN (1996, 1998)")
def p15_p16_p20_ladders_and_sets(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    return t.orders.where(F.year("o_orderdate").isin(1996, 1998)).select("o_orderkey", scalar.ladder(price, [(50000, "low"), (200000, "mid")], "high").alias("band"), F.when(F.col("o_orderstatus").isin("O", "P"), 1).otherwise(0).alias("open"))


@q("SELECT doc_id AS article_id, source AS outlet FROM documents")
def p19_rename_and_select(t: Tables) -> DataFrame:
    return scalar.existing(t.documents.withColumnsRenamed({"doc_id": "article_id", "source": "outlet"}), ["article_id", "outlet", "absent"])


# --- T: text classification ------------------------------------------------------------------


def _count_sql(text: str, terms: list[str]) -> str:
    return f"len(regexp_extract_all({text}, '{topics.alternation(terms)}'))"


_COUNTS = "[" + ", ".join(_count_sql("text", LEXICON[k]) for k in sorted(LEXICON)) + "]"
_COUNTED = f"c AS (SELECT doc_id, text, {_COUNTS} AS c FROM documents), d AS (SELECT *, list_max(c) AS m, CASE WHEN list_max(c) > 0 THEN list_position(c, list_max(c)) ELSE 0 END AS p FROM c), e AS (SELECT *, list_transform(c, lambda x, i: CASE WHEN i = p THEN -1 ELSE x END) AS c2 FROM d)"


@q(f"{_COUNTED} SELECT doc_id, array_to_string(c, ',') AS counts, p::INTEGER AS sdg_label, (CASE WHEN list_max(c2) > 0 THEN list_position(c2, list_max(c2)) ELSE 0 END)::INTEGER AS sdg_secondary, CASE WHEN m > 0 THEN round(m / (m + 3.0::DOUBLE), 4) ELSE 0 END::DOUBLE AS sdg_score, (CASE WHEN m <= 0 THEN 0 WHEN m < 3 THEN 1 WHEN m < 6 THEN 2 ELSE 3 END)::INTEGER AS sdg_intensity FROM e")
def t02_t06_topic_counts(t: Tables) -> DataFrame:
    df = t.texts.withColumn("c", topics.occurrence_counts(F.col("text"), LEXICON)).withColumn("p", topics.primary(F.col("c")))
    c = F.col("c")
    return df.select("doc_id", F.array_join(c.cast("array<string>"), ",").alias("counts"), F.col("p").alias("sdg_label"), topics.secondary(c, F.col("p")).alias("sdg_secondary"), topics.score(c).alias("sdg_score"), topics.intensity(c).alias("sdg_intensity"))


def _frame_sql(text: str) -> str:
    counts = "[" + ", ".join(_count_sql(text, v) for v in FRAMES.values()) + "]"
    names = "[" + ", ".join(f"'{k}'" for k in FRAMES) + "]"
    return f"CASE WHEN len(list_filter({counts}, lambda x: x > 0)) = 0 THEN '' WHEN len(list_filter({counts}, lambda x: x > 0)) >= 3 THEN 'mixed' ELSE {names}[list_position({counts}, list_max({counts}))] END"


_LONG = "(source || ' ' || substr(text, 1, 300))"
_SHORT = "(source || ' ' || substr(text, 1, 120))"


@q(f"""x AS (SELECT doc_id, {_SHORT} AS s, {_LONG} AS l FROM documents), c AS (SELECT *, [{', '.join(_count_sql('s', LEXICON[k]) for k in sorted(LEXICON))}] AS c, {_count_sql('l', ['eau', 'hand'])} AS sev, {_count_sql('l', ['the', 'der'])} AS pro, {_count_sql('l', ['and', 'und', 'les'])} AS con, {_count_sql('s', ['the', 'un'])} AS pr, {_count_sql('s', ['of', 'en'])} AS so FROM x),
d AS (SELECT *, list_max(c) AS m, CASE WHEN list_max(c) > 0 THEN list_position(c, list_max(c)) ELSE 0 END AS p FROM c), e AS (SELECT *, list_transform(c, lambda y, i: CASE WHEN i = p THEN -1 ELSE y END) AS c2, CASE WHEN pro > con THEN 'supportive' WHEN con > pro THEN 'opposed' ELSE 'neutral' END AS st FROM d)
SELECT doc_id, p::INTEGER AS sdg_label, (CASE WHEN list_max(c2) > 0 THEN list_position(c2, list_max(c2)) ELSE 0 END)::INTEGER AS sdg_secondary, CASE WHEN m > 0 THEN round(m / (m + 3.0::DOUBLE), 4) ELSE 0 END::DOUBLE AS sdg_score,
 (CASE WHEN m <= 0 THEN 0 WHEN m < 3 THEN 1 WHEN m < 6 THEN 2 ELSE 3 END)::INTEGER AS sdg_intensity, (CASE WHEN m <= 0 THEN 0 ELSE least(CASE WHEN m <= 1 THEN m WHEN m <= 3 THEN 2 WHEN m <= 6 THEN 3 ELSE 4 END + least(sev, 1), 5) END)::INTEGER AS issue_intensity,
 st AS aid_stance, CASE st WHEN 'supportive' THEN 'positive' WHEN 'opposed' THEN 'negative' ELSE 'neutral' END AS sdg_favorability, {_frame_sql('l')} AS issue_frame,
 CASE WHEN pr = 0 AND so = 0 THEN 'neutral' WHEN so = 0 THEN 'problem' WHEN pr = 0 THEN 'solution' WHEN pr > 2 * so THEN 'problem' WHEN so > 2 * pr THEN 'solution' ELSE 'mixed' END AS problem_solution,
 array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(l, '{topics.alternation(v)}') THEN '{k}' END" for k, v in CRISES.items())}], lambda z: z IS NOT NULL), ',') AS crisis_type,
 regexp_matches(l, '(?i)(?:THE OF|des)')::INTEGER AS policy_actor, list_sum(c)::INTEGER AS kw_hits FROM e""")
def t07_t14_classify(t: Tables) -> DataFrame:
    short, long = F.concat("source", F.lit(" "), F.substring("text", 1, 120)), F.concat("source", F.lit(" "), F.substring("text", 1, 300))
    return topics.classify(t.texts.select("doc_id", "text", "source"), short, long, LEXICON, ["eau", "hand"], ["the", "der"], ["and", "und", "les"], FRAMES, ["the", "un"], ["of", "en"], CRISES, ["THE OF", "des"]).drop("text", "source")


def _reference(t: Tables) -> lexicons.Reference:
    """The dictionaries of these queries, by way of a file."""
    path = scratch(t.spark, "reference")
    data = {"topics": {str(k): v for k, v in LEXICON.items()}, "severity": ["eau", "hand"], "supportive": ["the", "der"], "opposed": ["and", "und", "les"], "frames": FRAMES, "problems": ["the", "un"], "solutions": ["of", "en"], "crises": CRISES, "actors": ["THE OF", "des"], "places": PLACES, "recipients": ["AAA", "CCC"]}
    t.spark.createDataFrame([(json.dumps(data, ensure_ascii=False),)], "value string").coalesce(1).write.text(path)
    return lexicons.read_reference(t.spark, path)


@q(ORACLE["t07_t14_classify"].removeprefix("WITH "))
def t14_classify_by_file(t: Tables) -> DataFrame:
    short, long = F.concat("source", F.lit(" "), F.substring("text", 1, 120)), F.concat("source", F.lit(" "), F.substring("text", 1, 300))
    return _reference(t).classify(t.texts.select("doc_id", "text", "source"), short, long).drop("text", "source")


def _distinct_sql(terms: list[str]) -> str:
    return " + ".join(f"contains(lower(text), '{x.lower()}')::INTEGER" for x in terms)


@q(f"""s AS (SELECT doc_id, {', '.join(f'({_distinct_sql(LEXICON[k])}) AS s{k}' for k in sorted(LEXICON))} FROM documents)
SELECT doc_id, array_to_string(list_filter([{', '.join(f"CASE WHEN s{k} > 0 THEN '{k}:' || s{k} END" for k in sorted(LEXICON))}], lambda x: x IS NOT NULL), ',') AS scores,
 coalesce(CASE {' '.join(f"WHEN s{k} > 0 AND s{k} = greatest({', '.join(f's{j}' for j in LEXICON)}) THEN {k}" for k in sorted(LEXICON))} END, 0)::INTEGER AS top,
 array_to_string(list_filter([{', '.join(f"CASE WHEN s{k} > 0 THEN '{k}' END" for k in sorted(LEXICON))}], lambda x: x IS NOT NULL), '|') AS hits FROM s""")
def t15_t17_distinct_terms(t: Tables) -> DataFrame:
    df = t.texts.withColumn("m", topics.term_scores(F.col("text"), LEXICON))
    pairs = F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))))
    return df.select("doc_id", F.array_join(pairs, ",").alias("scores"), topics.top_of_scores(F.col("m")).cast("int").alias("top"), F.array_join(topics.topics_of_scores(F.col("m")).cast("array<string>"), "|").alias("hits"))


def _places_sql(names: dict[str, str], text: str = "text") -> str:
    by: dict[str, list[str]] = {}
    for n, c in names.items():
        if c != "---":
            by.setdefault(c, []).append(f"(^|[^a-z]){n}" if len(n) <= 3 else n)
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({text}, '{'|'.join(by[c])}') THEN '{c}' END" for c in sorted(by)) + "], lambda x: x IS NOT NULL)"


@q(f"SELECT doc_id, array_to_string({_places_sql(PLACES)}, '|') AS countries, array_to_string({_places_sql({k: v for k, v in PLACES.items() if v in ('AAA', 'CCC')})}, '|') AS recipients FROM documents")
def t18_t19_places(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.texts.select("doc_id", F.array_join(topics.places(text, PLACES, letter="a-z"), "|").alias("countries"), F.array_join(topics.places(text, topics.recipients_only(PLACES, {"AAA", "CCC"}), letter="a-z"), "|").alias("recipients"))


@q("SELECT o_orderkey, n_name AS iso3 FROM orders LEFT JOIN nation ON o_custkey % 30 = n_nationkey")
def t20_name_lookup(t: Tables) -> DataFrame:
    codes = {str(r.n_nationkey): r.n_name for r in t.nation.collect()}
    return t.orders.select("o_orderkey", topics.code_of((F.col("o_custkey") % 30).cast("string"), codes).alias("iso3"))


@q("SELECT n_regionkey AS code, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def t21_reverse_index(t: Tables) -> DataFrame:
    codes = {r.n_name: str(r.n_regionkey) for r in t.nation.orderBy("n_name").collect()}
    return t.region.select(F.col("r_regionkey").alias("code"), F.array_join(topics.names_of_code(F.col("r_regionkey").cast("string"), codes), "|").alias("names"))


_SIGNALS = f"""g AS (SELECT doc_id, regexp_matches(text, '(?i)(?:des les|erea)') AS actor, {_count_sql('text', LEXICON[1] + LEXICON[3])} AS hits, len({_places_sql({k: v for k, v in PLACES.items() if v in ('AAA', 'CCC')})}) > 0 AS recipient, len({_places_sql(PLACES)}) > 0 AS place,
 regexp_matches(text, 'ouaux|schver') AS vocabulary, regexp_matches(text, 'edth|cionde') AS shared FROM documents), h AS (SELECT *, actor OR (hits >= 1 AND recipient) OR vocabulary OR (shared AND place) AS candidate FROM g), st AS (SELECT *, CASE WHEN candidate THEN 'candidate' WHEN place THEN 'borderline' ELSE 'negative' END AS stratum FROM h)"""


def _signals(t: Tables, *more: str) -> DataFrame:
    """The rules' signals of each document, with more of its columns."""
    return _signals_of(t.texts, *more)


def _signals_of(texts: DataFrame, *more: str) -> DataFrame:
    text = F.col("text")
    df = texts.select(
        "doc_id", *more, topics.holds(text, ["des les", "erea"], any_case=True).alias("actor"), topics.occurrences(text, LEXICON[1] + LEXICON[3]).alias("hits"), topics.places(text, PLACES, letter="a-z").alias("__places"),
        topics.holds(text, ["ouaux", "schver"]).alias("vocabulary"), topics.holds(text, ["edth", "cionde"]).alias("shared"),
    )
    # One scan for places: the recipients are some of them.
    at = df.columns.index("__places")
    df = df.select(*df.columns[:at], F.arrays_overlap("__places", F.array(F.lit("AAA"), F.lit("CCC"))).alias("recipient"), (F.size("__places") > 0).alias("place"), *df.columns[at + 1 :])
    df = df.withColumn("candidate", topics.candidate(F.col("actor"), F.col("hits"), F.col("recipient"), F.col("vocabulary"), F.col("shared") & F.col("place")))
    return df.withColumn("stratum", topics.stratum(F.col("candidate"), F.col("place")))


@q(f"{_SIGNALS} SELECT doc_id, actor, hits::INTEGER AS hits, recipient, place, vocabulary, shared, candidate, stratum FROM st")
def t22_t27_signals_and_strata(t: Tables) -> DataFrame:
    return _signals(t)


@q(f"SELECT doc_id, array_to_string(list_filter([{', '.join(f'''CASE WHEN regexp_matches(text, '{topics.alternation(v)}') THEN '{k}' END''' for k, v in CRISES.items())}], lambda z: z IS NOT NULL), ',') AS kinds, regexp_matches(text, '(?i)(?:SHED|ouaux)')::INTEGER AS seed FROM documents")
def t23_t28_vocabulary_kinds(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(topics.matching(F.col("text"), CRISES), ",").alias("kinds"), topics.holds(F.col("text"), ["SHED", "ouaux"], any_case=True).cast("int").alias("seed"))


_PROBS = "SELECT event_id, (event_id % 7)::DOUBLE / 20 AS a, (event_id % 5)::DOUBLE / 20 AS b, (event_id % 3)::DOUBLE / 20 AS c FROM events"


@q(f"SELECT event_id, CASE WHEN a = greatest(a, b, c) THEN 'positive' WHEN c = greatest(a, b, c) THEN 'negative' ELSE 'neutral' END AS label, round(greatest(a, b, c), 4) AS score, round(a - c, 4) AS continuous FROM ({_PROBS})")
def t29_t30_sentiment_fold(t: Tables) -> DataFrame:
    p = lambda name, n: F.struct(F.lit(name).alias("label"), ((F.col("event_id") % n).cast("double") / 20).alias("score"))
    return t.events.select("event_id", scoring.fold_probabilities(F.array(p("POS", 7), p("label_1", 5), p("Negative", 3))).alias("s")).select("event_id", "s.*")


_LABELS = {"positive": ("positive", "pos", "긍정", "호의적", "LABEL_2", " Pos "), "negative": ("negative", "neg", "부정", "비판적", "label_0", "NEG"), "neutral": ("neutral", "neu", "중립", "mixed", "label_1", "unheard of", "")}


@q("v(label, sentiment) AS (VALUES " + ", ".join(f"('{x}', '{k}')" for k, xs in _LABELS.items() for x in xs) + ") SELECT label, sentiment FROM v")
def t29_every_label(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(x,) for xs in _LABELS.values() for x in xs], "label string").select("label", scoring.sentiment_name(F.col("label")).alias("sentiment"))


_ANCHORS = "an AS (SELECT label AS anchor, list(m ORDER BY i) AS av FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label), sc AS (SELECT vec_id, anchor, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), av) AS score FROM embeddings, an)"


def _anchor_scores(t: Tables) -> DataFrame:
    e = t.embeddings
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    anchors = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("anchor_vector")).withColumnRenamed("label", "anchor")
    return scoring.anchor_scores(e, anchors, "vec_id", "embedding")


@q(f"{_ANCHORS} SELECT vec_id, anchor, round(score, 5) AS score, round(least(score + least((vec_id % 8) * 0.03::DOUBLE, 0.15::DOUBLE), 1.0::DOUBLE), 5) AS fused FROM sc")
def t33_t34_anchor_scores(t: Tables) -> DataFrame:
    return _anchor_scores(t).select("vec_id", "anchor", F.round("score", 5).alias("score"), F.round(scoring.fuse(F.col("score"), F.col("vec_id") % 8), 5).alias("fused"))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_TOPIC_TEXTS = {1: "the other of these things and that", 2: "der die das und nicht werden", 3: "les deux pour une dans ce jour"}


def _letter_counts():
    """A model in miniature: a text's letters as its embedding."""
    return lambda texts: [[float(t.count(c)) for c in _LETTERS] for t in texts]


_LETTER_SQL = "list_transform([" + ", ".join(f"'{c}'" for c in _LETTERS) + "], lambda c: (length(x) - length(replace(x, c, '')))::DOUBLE)"


@q("an(anchor, x) AS (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in _TOPIC_TEXTS.items()) + f"), av AS (SELECT anchor, {_LETTER_SQL} AS v FROM an), dv AS (SELECT doc_id, {_LETTER_SQL} AS v FROM (SELECT doc_id, text AS x FROM documents)) SELECT doc_id, anchor, round(list_cosine_similarity(dv.v, av.v), 5) AS score FROM dv, av WHERE list_sum(dv.v) > 0")
def t33_embed_and_score(t: Tables) -> DataFrame:
    """Texts and anchors through the same model adapter, then their cosines."""
    return scoring.embed_and_score(t.texts, "doc_id", "text", _TOPIC_TEXTS, _letter_counts).where("score is not null").withColumn("score", F.round("score", 5))


@q(f"""{_ANCHORS}, rk AS (SELECT vec_id, anchor + 1 AS label, round(score, 4) AS score, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 4) DESC, anchor) AS r FROM sc)
SELECT vec_id, (CASE WHEN max(score) >= 0.35 THEN min(label) FILTER (r = 1) ELSE 0 END)::INTEGER AS label, max(score) AS score, coalesce(string_agg(label::VARCHAR, '|' ORDER BY r) FILTER (score >= 0.35), '') AS labels,
 coalesce(min(label) FILTER (r = 2 AND score >= 0.2), 0)::INTEGER AS second, (CASE WHEN max(score) < 0.35 THEN 0 WHEN max(score) < 0.5 THEN 1 WHEN max(score) < 0.65 THEN 2 ELSE 3 END)::INTEGER AS intensity FROM rk GROUP BY vec_id""")
def t35_t38_label_decisions(t: Tables) -> DataFrame:
    s = _anchor_scores(t).groupBy("vec_id").agg(F.collect_list(F.struct((F.col("anchor") + 1).alias("label"), F.round("score", 4).alias("score"))).alias("s"))
    top = scoring.ranked(F.col("s"))[0]
    one = scoring.single_label(F.col("s"))
    return s.select("vec_id", one["label"].cast("int").alias("label"), one["score"].alias("score"), F.array_join(scoring.multi_label(F.col("s")).cast("array<string>"), "|").alias("labels"), scoring.second_label(F.col("s"), top["label"]).cast("int").alias("second"), scoring.similarity_intensity(one["score"]).alias("intensity"))


@q(f"{_SIGNALS} SELECT doc_id, CASE WHEN candidate THEN 'model' ELSE 'keyword' END AS method, (CASE WHEN candidate THEN length(text) % 18 ELSE 0 END)::INTEGER AS sdg_label FROM st JOIN documents USING (doc_id)")
def t39_t40_cascade(t: Tables) -> DataFrame:
    rows = _signals(t, "text")
    model = lambda df: scoring.with_model(df, "text", "sdg_label", "int", lambda: lambda texts: [len(x) % 18 for x in texts]).withColumn("method", F.lit("model"))
    return scoring.cascade(rows, F.col("candidate"), {"method": F.lit("keyword"), "sdg_label": F.lit(0)}, model).select("doc_id", "method", "sdg_label")


# --- J: joins ----------------------------------------------------------------------------------

_MEDIA_SDG = "ms AS (SELECT year, month, sdg, count(*) AS freq_articles FROM art GROUP BY ALL)"
_AID_SDG = "oa AS (SELECT year, month, sdg, round(sum(disbursement), 4) AS oda_disbursement FROM projects WHERE sdg IS NOT NULL GROUP BY ALL)"


def _media(t: Tables, *keys: str) -> DataFrame:
    return t.art().groupBy(*keys).agg(F.count("*").alias("freq_articles"))


def _aid(t: Tables, *keys: str) -> DataFrame:
    return t.projects().where("sdg is not null").groupBy(*keys).agg(F.round(F.sum("disbursement"), 4).alias("oda_disbursement"))


@q(f"{ART}, {PROJECTS}, {_MEDIA_SDG}, {_AID_SDG} SELECT year, month, sdg, coalesce(freq_articles, -1)::BIGINT AS freq_articles, oda_disbursement FROM ms FULL JOIN oa USING (year, month, sdg)")
def j01_media_aid_by_topic(t: Tables) -> DataFrame:
    return panels.panel(_media(t, "year", "month", "sdg"), _aid(t, "year", "month", "sdg"), ["year", "month", "sdg"]).fillna(-1, ["freq_articles"])


@q(f"{ART}, {PROJECTS}, m AS (SELECT year, month, country, count(*) AS freq_articles FROM art GROUP BY ALL), o AS (SELECT year, month, coalesce(country, '---') AS country, round(sum(disbursement), 4) AS oda_disbursement FROM projects WHERE sdg IS NOT NULL GROUP BY ALL) SELECT year, month, country, coalesce(freq_articles, -1)::BIGINT AS freq_articles, oda_disbursement FROM m FULL JOIN o USING (year, month, country)")
def j02_media_aid_by_country(t: Tables) -> DataFrame:
    a = _aid(t, "year", "month", "country").fillna("---", ["country"])
    return panels.panel(_media(t, "year", "month", "country"), a, ["year", "month", "country"]).fillna(-1, ["freq_articles"])


@q(f"{ART}, {PROJECTS}, m AS (SELECT year, month, country, sdg, count(*) AS freq_articles FROM art GROUP BY ALL), o AS (SELECT year, month, coalesce(country, '---') AS country, sdg, round(sum(disbursement), 4) AS oda_disbursement FROM projects WHERE sdg IS NOT NULL GROUP BY ALL) SELECT year, month, country, sdg, coalesce(freq_articles, -1)::BIGINT AS freq_articles, oda_disbursement FROM m FULL JOIN o USING (year, month, country, sdg)")
def j03_media_aid_by_country_topic(t: Tables) -> DataFrame:
    keys = ["year", "month", "country", "sdg"]
    return panels.panel(_media(t, *keys), _aid(t, *keys).fillna("---", ["country"]), keys).fillna(-1, ["freq_articles"])


@q(f"{ART}, {PROJECTS}, m AS (SELECT year, month, country, sdg, count(*) AS freq_articles FROM art GROUP BY ALL), {_AID_SDG} SELECT year, month, sdg, coalesce(country, '') AS country, coalesce(freq_articles, -1)::BIGINT AS freq_articles, oda_disbursement FROM m FULL JOIN oa USING (year, month, sdg)")
def j04_fallback_by_topic(t: Tables) -> DataFrame:
    return panels.by_country_topic(_media(t, "year", "month", "country", "sdg"), _aid(t, "year", "month", "sdg")).fillna("", ["country"]).fillna(-1, ["freq_articles"])


@q(f"{ART}, {GRID}, {TERMS} SELECT art.year, art.month, count(*) AS n, max(h) AS holder FROM art LEFT JOIN (SELECT year, month, arg_max(holder, s) AS h FROM grid JOIN terms ON first BETWEEN date_trunc('month', s) AND date_trunc('month', e) GROUP BY ALL) USING (year, month) GROUP BY ALL")
def j05_calendar_left_join(t: Tables) -> DataFrame:
    dims = calendar.terms_of_office(t.grid(), t.terms()).select("year", "month", "holder")
    return t.art().groupBy("year", "month").agg(F.count("*").alias("n")).join(F.broadcast(dims), ["year", "month"], "left")


@q(f"{ART}, m AS (SELECT year, sdg, count(*) AS n FROM art GROUP BY ALL), tt AS (SELECT year, sum(n) AS total FROM m GROUP BY year) SELECT year, sdg, n, total::BIGINT AS total FROM m LEFT JOIN tt USING (year)")
def j06_total_join_back(t: Tables) -> DataFrame:
    return _media(t, "year", "sdg").select("year", "sdg", F.col("freq_articles").alias("n"), F.sum("freq_articles").over(Window.partitionBy("year")).alias("total"))


@q(f"{ART}, {PROJECTS}, m AS (SELECT year, sdg, count(*) AS n FROM art GROUP BY ALL), o AS (SELECT year, sdg, round(sum(commitment), 4) AS c FROM projects WHERE sdg IS NOT NULL GROUP BY ALL) SELECT year, sdg, n, c FROM m JOIN o USING (year, sdg)")
def j08_inner_by_year_topic(t: Tables) -> DataFrame:
    o = t.projects().where("sdg is not null").groupBy("year", "sdg").agg(F.round(F.sum("commitment"), 4).alias("c"))
    return _media(t, "year", "sdg").withColumnRenamed("freq_articles", "n").join(o, ["year", "sdg"])


@q("SELECT a.doc_id, a.quality AS coder1, b.toxic AS coder2 FROM labels a JOIN labels b USING (doc_id)")
def j09_two_coders(t: Tables) -> DataFrame:
    return t.labels.select("doc_id", F.col("quality").alias("coder1")).join(t.labels.select("doc_id", F.col("toxic").alias("coder2")), "doc_id")


@q("SELECT doc_id, quality, text FROM labels JOIN documents USING (doc_id) WHERE doc_id % 10 = 0")
def j11_late_text(t: Tables) -> DataFrame:
    return sampling.with_text(t.labels.where("doc_id % 10 = 0").select("doc_id", "quality"), t.documents.select("doc_id", "text"), ["doc_id"])


@q("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j12_exclude_ids(t: Tables) -> DataFrame:
    return sampling.without(t.documents.select("doc_id", "lang"), t.labels, "doc_id")


@q("SELECT n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
def j13_recipients(t: Tables) -> DataFrame:
    return t.nation.join(F.broadcast(t.supplier.select(F.col("s_nationkey").alias("n_nationkey")).distinct()), "n_nationkey", "left_semi").select("n_name")


@q(f"{PROJECTS} SELECT project_id, coalesce(sector_sdg, -1) AS sector_sdg FROM projects")
def j14_crosswalk(t: Tables) -> DataFrame:
    return t.projects().select("project_id", "sector_sdg").fillna(-1)


@q(f"{GRID}, {TERMS}, h AS (SELECT year, month, first, arg_max(holder, s) AS holder, arg_max(side, s) AS side, max(s) AS s FROM grid JOIN terms ON first BETWEEN date_trunc('month', s) AND date_trunc('month', e) GROUP BY ALL) SELECT year, month, holder, side, (first <= date_trunc('month', s) + INTERVAL 11 MONTH)::INTEGER AS first_year FROM h")
def j15_terms_of_office(t: Tables) -> DataFrame:
    return calendar.terms_of_office(t.grid(), t.terms()).drop("first")


@q(f"{GRID}, e(year, month, seq, label) AS (VALUES (1995, 3, 1, 'x'), (1995, 3, 2, 'y'), (1999, 9, 3, 'z')), l AS (SELECT year, month, arg_max(label, seq) AS l FROM e GROUP BY ALL) SELECT year, month, coalesce(l, '') AS event FROM grid LEFT JOIN l USING (year, month)")
def j16_event_labels(t: Tables) -> DataFrame:
    events = t.spark.createDataFrame([(1995, 3, 1, "x"), (1995, 3, 2, "y"), (1999, 9, 3, "z")], "year int, month int, seq int, label string")
    return calendar.event_labels(t.grid(), events, "event").drop("first")


@q("lx(topic, term) AS (VALUES (1, 'that'), (2, 'with'), (3, 'nicht'), (4, 'dans')) SELECT doc_id, topic, count(*) AS terms FROM documents JOIN lx ON contains(text, term) GROUP BY ALL")
def j17_lexicon_join(t: Tables) -> DataFrame:
    lx = t.spark.createDataFrame([(1, "that"), (2, "with"), (3, "nicht"), (4, "dans")], "topic int, term string")
    return t.documents.select("doc_id", "text").join(F.broadcast(lx), F.expr("contains(text, term)")).groupBy("doc_id", "topic").agg(F.count("*").alias("terms"))


# --- A: aggregations -------------------------------------------------------------------------------


@q(f"{CELLS} SELECT {_CELL_KEYS}, freq_articles, {', '.join(f'round({c}, 4) AS {c}' for c in _FLOATS)} FROM cells")
def a01_a05_cells(t: Tables) -> DataFrame:
    return t.cells().withColumns({c: F.round(c, 4) for c in _FLOATS})


@q("x AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [0] WHEN doc_id % 3 = 1 THEN [1, 2] ELSE [3] END AS s, CASE WHEN doc_id % 4 = 0 THEN ['---'] ELSE [lang, source] END AS c FROM documents) SELECT doc_id, unnest(s)::INTEGER AS sdg, country FROM (SELECT doc_id, s, unnest(c) AS country FROM x)")
def a06_explode_cells(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    rows = t.documents.select("doc_id", F.when(k % 3 == 0, F.array().cast("array<int>")).when(k % 3 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(3))).alias("s"), F.when(k % 4 != 0, F.array("lang", "source")).alias("c"))
    return measures.explode_cells(rows, "s", "c")


@q(f"{ROLLED} SELECT year, month, sdg, sum(freq_articles)::BIGINT AS freq_articles, sum(rolling_3m)::BIGINT AS rolling_3m, round(avg(hhi), 6) AS hhi, round(avg(avg_sentiment), 6) AS avg_sentiment FROM rolled GROUP BY ALL")
def a07_marginalise_country(t: Tables) -> DataFrame:
    out = measures.marginalise(measures.rolling(t.cells()), ["year", "month", "sdg"], ["freq_articles", "rolling_3m"], ["hhi", "avg_sentiment"])
    return out.withColumns({"hhi": F.round("hhi", 6), "avg_sentiment": F.round("avg_sentiment", 6)})


@q(f"{CELLS} SELECT year, month, country, sum(freq_articles)::BIGINT AS freq_articles, round(avg(entropy), 6) AS entropy, round(avg(share_positive), 6) AS share_positive FROM cells GROUP BY ALL")
def a08_country_rollup(t: Tables) -> DataFrame:
    out = measures.marginalise(t.cells(), ["year", "month", "country"], ["freq_articles"], ["entropy", "share_positive"])
    return out.withColumns({"entropy": F.round("entropy", 6), "share_positive": F.round("share_positive", 6)})


@q(f"{PROJECTS} SELECT year, month, country, round(sum(disbursement), 4) AS disbursement, round(sum(commitment), 4) AS commitment FROM projects WHERE country IS NOT NULL GROUP BY ALL")
def a09_aid_by_country(t: Tables) -> DataFrame:
    return t.projects().where("country is not null").groupBy("year", "month", "country").agg(*(F.round(aid.total(c), 4).alias(c) for c in ("disbursement", "commitment")))


@q(f"{PROJECTS} SELECT year, sdg, round(sum(disbursement), 4) AS disbursement, round(sum(commitment), 4) AS commitment, count(project_id) AS n_projects FROM projects WHERE sdg IS NOT NULL GROUP BY ALL")
def a10_aid_annual(t: Tables) -> DataFrame:
    return aid.annual_by_topic(t.projects(), ["disbursement", "commitment"]).withColumns({c: F.round(c, 4) for c in ("disbursement", "commitment")})


@q(f"""{PROJECTS}, y AS (SELECT year, sum(disbursement) AS total FROM projects WHERE sdg IS NOT NULL GROUP BY year)
SELECT p.year, country, sdg, round(sum(disbursement), 4) AS disbursement, count(project_id) AS n_projects, count(*) FILTER (fund = 'A') AS n_grant_projects, count(*) FILTER (fund = 'R') AS n_loan_projects, round(100 * sum(disbursement) / any_value(total), 4) AS oda_share_pct
FROM projects p JOIN y USING (year) WHERE sdg IS NOT NULL AND country IS NOT NULL GROUP BY p.year, country, sdg""")
def a11_a12_aid_by_country(t: Tables) -> DataFrame:
    return aid.annual_by_country(t.projects(), ["disbursement"], "fund", "A", "R", "disbursement").withColumn("disbursement", F.round("disbursement", 4))


@q("SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 10")
def a13_value_counts(t: Tables) -> DataFrame:
    return measures.value_counts(t.part, "p_type", 10)


@q(f"{_SIGNALS} SELECT stratum, source, count(*) AS n FROM st JOIN documents USING (doc_id) GROUP BY ALL")
def a14_stratum_counts(t: Tables) -> DataFrame:
    return _signals(t, "source").groupBy("stratum", "source").agg(F.count("*").alias("n"))


@q(f"{PROJECTS} SELECT count(DISTINCT year) AS years, count(DISTINCT country) AS countries, count(DISTINCT sdg) AS topics FROM projects")
def a15_distinct_counts(t: Tables) -> DataFrame:
    return t.projects().agg(F.count_distinct("year").alias("years"), F.count_distinct("country").alias("countries"), F.count_distinct("sdg").alias("topics"))


@q(f"""{ART}, x AS (SELECT year, unnest(list_distinct([sdg, (id % 17) + 1])) AS sdg FROM art), c AS (SELECT year, sdg, count(*) AS n FROM x GROUP BY ALL), tt AS (SELECT year, count(*) AS n_total FROM art GROUP BY year)
SELECT year, g::INTEGER AS sdg, coalesce(n, 0)::BIGINT AS n_articles, n_total, round(coalesce(n, 0) * 100 / n_total::DOUBLE, 3) AS media_share_pct FROM tt, range(1, 18) r(g) LEFT JOIN c ON c.year = tt.year AND c.sdg = g""".replace("SELECT year, g::", "SELECT tt.year, g::"))
def a16_topic_years(t: Tables) -> DataFrame:
    return measures.topic_years(t.art().withColumn("s", F.array(F.col("sdg").cast("int"), ((F.col("id") % 17) + 1).cast("int"))), "s")


@q(f"{ART}, {PROJECTS}, m AS (SELECT year, sdg, count(*) * 1.0::DOUBLE AS a FROM art WHERE year < 2001 GROUP BY ALL), o AS (SELECT year, sdg, sum(commitment) AS b FROM projects GROUP BY ALL), g AS (SELECT sdg, avg(a) AS a, avg(b) AS b FROM m JOIN o USING (year, sdg) GROUP BY sdg) SELECT sdg, round(a, 3) AS media, round(b, 3) AS oda, round(a - b, 3) AS gap, round(a / nullif(b, 0), 2) AS ratio FROM g")
def a17_gap(t: Tables) -> DataFrame:
    o = t.projects().where("sdg is not null").groupBy("year", "sdg").agg(F.sum("commitment").alias("oda_share_pct"))
    m = _media(t, "year", "sdg").select("year", "sdg", F.col("freq_articles").cast("double").alias("media_share_pct"))
    return measures.gap(m.join(o, ["year", "sdg"]), keep=F.col("year") < 2001)


_CRISIS_COLUMNS = ", ".join([f"coalesce(max((kind = '{k}' AND severity = {s})::INTEGER), 0) AS {k}_{s}" for k in KINDS for s in (1, 2, 3)] + ["max((kind IS NOT NULL)::INTEGER) AS crisis_any", "count(kind) AS crisis_count", "coalesce(max(severity), 0) AS crisis_severity"] + [f"coalesce(max(list_contains(topics, {k})::INTEGER), 0) AS crisis_sdg_{k}" for k in range(1, 6)])


@q(f"{GRID}, {CRISIS} SELECT year, month, {_CRISIS_COLUMNS} FROM grid LEFT JOIN ev USING (year, month) GROUP BY ALL")
def a18_crisis_panel(t: Tables) -> DataFrame:
    return calendar.crises(t.grid(), t.crisis_events(), KINDS, topics=5)


@q(f"{_SIGNALS} SELECT count(*) FILTER (actor) AS actors, count(*) FILTER (hits >= 1 AND recipient) AS paired, count(*) FILTER (vocabulary) AS vocabulary, count(*) FILTER (candidate) AS candidates, count(*) AS n, round(avg((candidate = place)::INTEGER), 6) AS agreement FROM st")
def a19_a21_funnel(t: Tables) -> DataFrame:
    return _signals(t).agg(F.count_if("actor").alias("actors"), F.count_if((F.col("hits") >= 1) & F.col("recipient")).alias("paired"), F.count_if("vocabulary").alias("vocabulary"), F.count_if("candidate").alias("candidates"), F.count("*").alias("n"), F.round(F.avg((F.col("candidate") == F.col("place")).cast("double")), 6).alias("agreement"))


@q("SELECT lang, round(quantile_cont(n_chars, 0.5), 4) AS median, round(quantile_cont(n_chars, 0.75), 4) AS p75, min(n_chars) AS low, max(n_chars) AS high FROM documents GROUP BY lang")
def a20_quantiles(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang").agg(F.round(F.percentile("n_chars", 0.5), 4).alias("median"), F.round(F.percentile("n_chars", 0.75), 4).alias("p75"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))


@q(f"{PROJECTS} SELECT sdg_source, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM projects)::DOUBLE, 1) AS pct FROM projects GROUP BY sdg_source")
def a22_source_tiers(t: Tables) -> DataFrame:
    return measures.tier_shares(t.projects(), "sdg_source")


# --- W: windows ----------------------------------------------------------------------------------------


@q(f"{ROLLED} SELECT {_CELL_KEYS}, freq_articles, rolling_3m, rolling_6m, rolling_12m, cumulative_ytd, cumulative_all_time, cumulative_running, round({PERSISTENCE}, 4) AS persistence_score FROM rolled")
def w01_w04_rolling(t: Tables) -> DataFrame:
    out = measures.rolling(t.art().groupBy("year", "month", "sdg", "country").agg(F.count("*").alias("freq_articles")))
    return out.withColumn("persistence_score", F.round("persistence_score", 4))


@q(f"{ART}, c AS (SELECT year, month, sdg, country, count(*) AS freq_articles FROM art GROUP BY ALL) SELECT *, round(freq_articles / sum(freq_articles) OVER (PARTITION BY year, month)::DOUBLE, 5) AS freq_share_total, round(freq_articles / sum(freq_articles) OVER (PARTITION BY year, month, sdg)::DOUBLE, 5) AS freq_share_sdg FROM c")
def w05_shares(t: Tables) -> DataFrame:
    return measures.shares(_media(t, "year", "month", "sdg", "country"))


@q(f"{PROJECTS}, a AS (SELECT year, sdg, sum(disbursement) AS d FROM projects WHERE sdg IS NOT NULL GROUP BY ALL) SELECT year, sdg, round(d, 4) AS disbursement, round(100 * d / sum(d) OVER (PARTITION BY year), 4) AS oda_share_pct FROM a")
def w06_annual_share(t: Tables) -> DataFrame:
    return aid.annual_share(aid.annual_by_topic(t.projects(), ["disbursement"]), "disbursement").select("year", "sdg", F.round("disbursement", 4).alias("disbursement"), "oda_share_pct")


@q(f"{ART}, a AS (SELECT year, sdg, count(*) AS n FROM art GROUP BY ALL) SELECT year, sdg, n, {', '.join(f'coalesce({f}(n, {k}) OVER (PARTITION BY sdg ORDER BY year), -1) AS {f}_{k}' for k in (1, 2, 3) for f in ('lag', 'lead'))} FROM a")
def w07_lags_and_leads(t: Tables) -> DataFrame:
    return measures.shifts(_media(t, "year", "sdg").withColumnRenamed("freq_articles", "n"), "sdg", "year", "n").fillna(-1)


@q(f"{PROJECTS}, a AS (SELECT year, sdg, sum(disbursement) AS d, count(*) AS n FROM projects WHERE sdg IS NOT NULL GROUP BY ALL) SELECT year, sdg, m::INTEGER AS month, round(d / 12, 4) AS disbursement, round(n / 12::DOUBLE, 2) AS n_projects FROM a, range(1, 13) r(m)")
def w08_annual_to_monthly(t: Tables) -> DataFrame:
    return measures.annual_to_monthly(aid.annual_by_topic(t.projects(), ["disbursement"]), ["disbursement"], 4, ["n_projects"], 2)


@q(f"{ART}, {GRID}, {CRISIS}, cr AS (SELECT year, month, list_distinct(flatten(list(topics))) AS ts FROM ev GROUP BY ALL) SELECT art.year, art.month, sdg, count(*) AS n, max(coalesce(list_contains(ts, sdg), false)::INTEGER) AS crisis_affects_sdg FROM art LEFT JOIN cr USING (year, month) GROUP BY ALL")
def w09_crisis_affects(t: Tables) -> DataFrame:
    flags = calendar.crises(t.grid(), t.crisis_events(), KINDS, topics=5)
    return _media(t, "year", "month", "sdg").withColumnRenamed("freq_articles", "n").join(F.broadcast(flags), ["year", "month"], "left").select("year", "month", "sdg", "n", calendar.affects(F.col("sdg"), 5).alias("crisis_affects_sdg"))


@q(f"{ART} SELECT sdg, id, round(score, 6) AS score, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY sdg ORDER BY score DESC, id)::INTEGER AS r FROM art) WHERE r <= 3")
def w10_top_of_group(t: Tables) -> DataFrame:
    return measures.top_of_group(t.art(), "sdg", "score", "id", 3).select("sdg", "id", F.round("score", 6).alias("score"), "place")


@q("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def w11_first_of_key(t: Tables) -> DataFrame:
    return measures.first_of_key(t.documents.select("source", "doc_id"), "source", "doc_id")


@q("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= 50 THEN 'YES' ELSE '' END AS overlap_row FROM labels")
def w12_first_n_flag(t: Tables) -> DataFrame:
    return measures.first_n_flag(t.labels.select("doc_id"), 50, "doc_id")


# --- O: sort, limit, sets, samples ------------------------------------------------------------------------


@q(f"{ART} SELECT year, sdg, count(*) AS n FROM art GROUP BY ALL ORDER BY n DESC, year, sdg LIMIT 15")
def o01_o03_sort_and_head(t: Tables) -> DataFrame:
    return _media(t, "year", "sdg").withColumnRenamed("freq_articles", "n").orderBy(F.desc("n"), "year", "sdg").limit(15)


@q("SELECT doc_id, lang, -1 AS quality FROM documents WHERE doc_id < 50 UNION ALL SELECT doc_id, NULL, quality FROM labels WHERE doc_id < 90")
def o04_union_all(t: Tables) -> DataFrame:
    return t.documents.where("doc_id < 50").select("doc_id", "lang").unionByName(t.labels.where("doc_id < 90").select("doc_id", "quality"), allowMissingColumns=True).fillna(-1, ["quality"])


@q("(SELECT doc_id FROM documents WHERE doc_id % 2 = 0 UNION SELECT doc_id FROM labels) EXCEPT SELECT doc_id FROM documents WHERE doc_id % 3 = 0".replace("(SELECT", "SELECT * FROM (SELECT", 1))
def o05_set_operations(t: Tables) -> DataFrame:
    both = t.documents.where("doc_id % 2 = 0").select("doc_id").union(t.labels.select("doc_id")).distinct()
    return sampling.without(both, t.documents.where("doc_id % 3 = 0"), "doc_id")


_ORDER = "(doc_id * 7919 + 42) % 100003, doc_id"


@q(f"""{_SIGNALS}, av AS (SELECT count(*) FILTER (stratum = 'candidate') AS c, count(*) FILTER (stratum = 'borderline') AS b, count(*) FILTER (stratum = 'negative') AS n FROM st),
qt AS (SELECT least(150, c) AS c, least(90, b) AS b, least(60 + greatest(150 - c, 0) + greatest(90 - b, 0), n) AS n FROM av),
rk AS (SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY {_ORDER}) AS r FROM st) SELECT doc_id, stratum FROM rk, qt WHERE r <= CASE stratum WHEN 'candidate' THEN c WHEN 'borderline' THEN b ELSE n END""")
def o06_stratified_draw(t: Tables) -> DataFrame:
    return sampling.stratified(_signals(t).select("doc_id", "stratum"), "stratum", "doc_id", 300, {"candidate": 0.5, "borderline": 0.3, "negative": 0.2}, arithmetic=True)


@q(f"{ART}, rk AS (SELECT id, year, label, row_number() OVER (PARTITION BY year, label ORDER BY (id * 7919 + 42) % 100003, id) AS r FROM art), dr AS (SELECT id, year, label FROM rk WHERE r <= CASE label WHEN 'O' THEN 10 WHEN 'F' THEN 6 ELSE 4 END) SELECT * FROM dr ORDER BY (id * 7919 + 42) % 100003, id LIMIT 140")
def o07_year_sample(t: Tables) -> DataFrame:
    return sampling.by_year(t.art().select("id", "year", "label"), "year", "label", "id", 140, {"O": 0.5, "F": 0.3, "P": 0.2}, 7, arithmetic=True)


@q(f"SELECT doc_id, (ntile(2) OVER (ORDER BY {_ORDER}) - 1)::INTEGER AS half FROM labels")
def o08_o09_halves(t: Tables) -> DataFrame:
    return sampling.halves(t.labels.select("doc_id"), "doc_id", arithmetic=True)


@q(f"SELECT doc_id, toxic, ((row_number() OVER (PARTITION BY toxic ORDER BY {_ORDER}) - 1) % 5)::INTEGER AS fold FROM labels")
def o10_folds(t: Tables) -> DataFrame:
    return sampling.folds(t.labels.select("doc_id", "toxic"), "toxic", "doc_id", arithmetic=True)


@q("SELECT source FROM (SELECT source, row_number() OVER (ORDER BY source) - 1 AS r FROM (SELECT DISTINCT source FROM documents)) WHERE r % 3 = 0")
def o11_every(t: Tables) -> DataFrame:
    return sampling.every(t.documents.select("source").distinct(), "source", 3)


# --- D: composites ---------------------------------------------------------------------------------------------


@q(f"{PROJECTS} SELECT project_id, coalesce(sdg, -1) AS sdg, sdg_source FROM projects")
def d01_d02_topic_and_source(t: Tables) -> DataFrame:
    return t.projects().select("project_id", "sdg", "sdg_source").fillna(-1, ["sdg"])


@q("SELECT p_type AS name, count(*) AS n FROM part WHERE NOT contains(p_type, 'STEEL') GROUP BY 1 ORDER BY n DESC, name LIMIT 10")
def d03_unmapped(t: Tables) -> DataFrame:
    known = t.part.where(F.contains("p_type", F.lit("STEEL"))).select(F.col("p_type").alias("name")).distinct()
    return measures.value_counts(t.part.select(F.col("p_type").alias("name")).join(F.broadcast(known), "name", "left_anti"), "name", 10)


@q(f"{PROJECTS} SELECT count(*) AS n, round(sum(disbursement), 4) AS disbursement, round(sum(commitment), 4) AS commitment, count(sdg) AS tagged FROM projects")
def d04_summary(t: Tables) -> DataFrame:
    return t.projects().agg(F.count("*").alias("n"), F.round(F.sum("disbursement"), 4).alias("disbursement"), F.round(F.sum("commitment"), 4).alias("commitment"), F.count("sdg").alias("tagged"))


_HOLD = f"{GRID}, {TERMS}, ho AS (SELECT year, month, arg_max(holder, s) AS holder FROM grid JOIN terms ON first BETWEEN date_trunc('month', s) AND date_trunc('month', e) GROUP BY ALL)"
_YEARS = "year BETWEEN 1996 AND 1999"


def _dims(t: Tables) -> list[DataFrame]:
    return [calendar.terms_of_office(t.grid(), t.terms()).select("year", "month", "holder")]


@q(f"{ART}, {PROJECTS}, {_MEDIA_SDG}, {_AID_SDG}, {_HOLD} SELECT year, month, sdg, coalesce(freq_articles, -1)::BIGINT AS freq_articles, oda_disbursement, holder FROM (SELECT * FROM ms FULL JOIN oa USING (year, month, sdg)) LEFT JOIN ho USING (year, month) WHERE {_YEARS}")
def d05_panel_a(t: Tables) -> DataFrame:
    return panels.by_topic(_media(t, "year", "month", "sdg"), _aid(t, "year", "month", "sdg"), _dims(t), range(1996, 2000)).fillna(-1, ["freq_articles"])


@q(f"{ART}, {PROJECTS}, m AS (SELECT year, month, country, count(*) AS freq_articles FROM art GROUP BY ALL), o AS (SELECT year, month, country, round(sum(d), 4) AS oda_disbursement FROM (SELECT year, month, coalesce(country, '---') AS country, round(sum(disbursement), 4) AS d FROM projects WHERE sdg IS NOT NULL GROUP BY ALL) GROUP BY ALL), {_HOLD} SELECT year, month, country, coalesce(freq_articles, -1)::BIGINT AS freq_articles, oda_disbursement, holder FROM (SELECT * FROM m FULL JOIN o USING (year, month, country)) LEFT JOIN ho USING (year, month) WHERE {_YEARS}")
def d06_panel_b(t: Tables) -> DataFrame:
    a = _aid(t, "year", "month", "country").fillna("---", ["country"])
    out = panels.by_country(_media(t, "year", "month", "country"), a, _dims(t), range(1996, 2000))
    return out.withColumn("oda_disbursement", F.round("oda_disbursement", 4)).fillna(-1, ["freq_articles"])


@q(f"{ART}, {PROJECTS}, m AS (SELECT year, month, country, sdg, count(*) AS freq_articles FROM art GROUP BY ALL), o AS (SELECT year, month, coalesce(country, '---') AS country, sdg, round(sum(disbursement), 4) AS oda_disbursement FROM projects WHERE sdg IS NOT NULL GROUP BY ALL), {_HOLD}, {CRISIS}, cr AS (SELECT year, month, list_distinct(flatten(list(topics))) AS ts FROM ev GROUP BY ALL) SELECT year, month, country, sdg, coalesce(freq_articles, -1)::BIGINT AS freq_articles, oda_disbursement, holder, coalesce(list_contains(ts, sdg), false)::INTEGER AS crisis_affects_sdg FROM (SELECT * FROM m FULL JOIN o USING (year, month, country, sdg)) LEFT JOIN ho USING (year, month) LEFT JOIN cr USING (year, month) WHERE {_YEARS}")
def d07_panel_c(t: Tables) -> DataFrame:
    keys = ["year", "month", "country", "sdg"]
    crisis = calendar.crises(t.grid(), t.crisis_events(), KINDS, topics=5)
    out = panels.by_country_topic(_media(t, *keys), _aid(t, *keys).fillna("---", ["country"]), crisis, _dims(t), range(1996, 2000), topics=5)
    return out.select(*keys, "freq_articles", "oda_disbursement", "holder", "crisis_affects_sdg").fillna(-1, ["freq_articles"])


@q(f"{GRID}, {TERMS}, h AS (SELECT year, month, first, arg_max(holder, s) AS holder, arg_max(side, s) AS side, max(s) AS s FROM grid JOIN terms ON first BETWEEN date_trunc('month', s) AND date_trunc('month', e) GROUP BY ALL) SELECT year, month, holder, side, (first <= date_trunc('month', s) + INTERVAL 11 MONTH)::INTEGER AS first_year, (first BETWEEN DATE '1997-01-01' AND DATE '1997-03-01')::INTEGER AS acting, (CASE WHEN year = 1998 AND month = 6 THEN 'vote' ELSE '' END) AS election FROM h")
def d08_political_panel(t: Tables) -> DataFrame:
    periods = t.spark.createDataFrame([("1997-01-15", "1997-03-20")], "start string, end string").withColumns({"start": F.to_date("start"), "end": F.to_date("end")})
    events = t.spark.createDataFrame([(1998, 6, 1, "vote")], "year int, month int, seq int, label string")
    held = calendar.terms_of_office(t.grid(), t.terms())
    return calendar.event_labels(calendar.acting(held, periods), events, "election").drop("first")


@q(f"{CRISIS} SELECT year, month, kind, severity, array_to_string(topics, '|') AS topics FROM ev")
def d09_crisis_events(t: Tables) -> DataFrame:
    return t.crisis_events().withColumn("topics", F.array_join(F.col("topics").cast("array<string>"), "|"))


# --- M: statistics -----------------------------------------------------------------------------------------------

_PAIR = f"{ART}, {PROJECTS}, pr AS (SELECT * FROM (SELECT year, sdg, month, count(*)::DOUBLE AS x FROM art GROUP BY ALL) JOIN (SELECT year, sdg, month, sum(disbursement) AS y FROM projects GROUP BY ALL) USING (year, sdg, month))"


def _pair(t: Tables) -> DataFrame:
    x = t.art().groupBy("year", "sdg", "month").agg(F.count("*").cast("double").alias("x"))
    return x.join(t.projects().where("sdg is not null").groupBy("year", "sdg", "month").agg(F.sum("disbursement").alias("y")), ["year", "sdg", "month"])


def _p_sql(t: str, df: str) -> str:
    """The two-sided p of Student's t for whole degrees of freedom: the finite sums in the angle atan(t / sqrt(df))."""
    angle = f"atan(abs({t}) / sqrt({df}))"
    even = f"sin({angle}) * list_sum(list_transform(range(0, ({df}) // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1) - lgamma(0.5)) * pow(cos({angle}), 2 * j)))"
    odd = f"2 / pi() * ({angle} + sin({angle}) * coalesce(list_sum(list_transform(range(0, ({df} - 1) // 2), lambda j: 0.5 * sqrt(pi()) * exp(lgamma(j + 1) - lgamma(j + 1.5)) * pow(cos({angle}), 2 * j + 1))), 0))"
    return f"(1 - CASE WHEN ({df}) % 2 = 0 THEN {even} ELSE {odd} END)"


_R_TO_T = "r * sqrt((n - 2) / (1 - r * r))"


@q(f"{_PAIR}, co AS (SELECT year, count(*) AS n, corr(x, y) AS r FROM pr GROUP BY year HAVING count(*) >= 4 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0), tt AS (SELECT *, {_R_TO_T} AS tv, n - 2 AS df FROM co) SELECT year, n, round(r, 4) AS r, round({_p_sql('tv', 'df')}, 5) AS p FROM tt")
def m01_pearson(t: Tables) -> DataFrame:
    return stats.correlations(_pair(t), ["year"], "x", "y").withColumns({"r": F.round("r", 4), "p": F.round("p", 5)})


@q(f"{_PAIR}, rk AS (SELECT year, rank() OVER (PARTITION BY year ORDER BY x) + (count(*) OVER (PARTITION BY year, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY year ORDER BY y) + (count(*) OVER (PARTITION BY year, y) - 1) / 2.0::DOUBLE AS ry FROM pr), co AS (SELECT year, count(*) AS n, corr(rx, ry) AS r FROM rk GROUP BY year HAVING count(*) >= 4 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0), tt AS (SELECT *, {_R_TO_T} AS tv, n - 2 AS df FROM co) SELECT year, n, round(r, 4) AS r, round({_p_sql('tv', 'df')}, 5) AS p FROM tt")
def m02_spearman(t: Tables) -> DataFrame:
    return stats.spearman(_pair(t), ["year"], "x", "y").withColumns({"r": F.round("r", 4), "p": F.round("p", 5)})


_PANEL = f"{ART}, bl AS (SELECT sdg, year, avg(score) AS x, count(*)::DOUBLE AS y FROM art WHERE year < 2001 GROUP BY ALL)"


def _two_way_sql(x: str) -> str:
    """The fit of y on x with both effects, of the balanced panel where x isn't null."""
    return f"""(WITH pa AS (SELECT sdg, year, {x} AS x, y FROM mv WHERE {x} IS NOT NULL),
    dm AS (SELECT x - avg(x) OVER (PARTITION BY sdg) - avg(x) OVER (PARTITION BY year) + avg(x) OVER () AS dx, y - avg(y) OVER (PARTITION BY sdg) - avg(y) OVER (PARTITION BY year) + avg(y) OVER () AS dy, y - avg(y) OVER () AS cy, sdg, year FROM pa),
    b AS (SELECT sum(dx * dy) / sum(dx * dx) AS coef FROM dm),
    s AS (SELECT any_value(coef) AS coef, sum(dx * dx * (dy - coef * dx) ** 2) AS xe, sum(dx * dx) AS xx, sum((dy - coef * dx) ** 2) AS ee, sum(cy * cy) AS yy, count(*) AS n, count(DISTINCT sdg) + count(DISTINCT year) AS k FROM dm, b),
    f AS (SELECT coef, sqrt(xe * n / (n - k)) / xx AS se, n, n - k AS df, 1 - ee / yy AS r2 FROM s) SELECT coef, se, coef / se AS tv, n, df, r2 FROM f WHERE n >= 10)"""


_FIT = f"round(coef, 2) AS coef, round(se, 2) AS se, round(tv, 3) AS t_stat, round({_p_sql('tv', 'df')}, 4) AS p_val, n, df AS df_r, round(r2, 4) AS r2"


def _panel(t: Tables) -> DataFrame:
    return t.art().where("year < 2001").groupBy("sdg", "year").agg(F.avg("score").alias("x"), F.count("*").cast("double").alias("y"))


def _rounded(fit: DataFrame) -> DataFrame:
    return fit.withColumns({c: F.round(c, d) for c, d in (("coef", 2), ("se", 2), ("t_stat", 3), ("p_val", 4), ("r2", 4))})


@q(f"{_PANEL}, mv AS (SELECT * FROM bl) SELECT {_FIT} FROM {_two_way_sql('x')}")
def m03_fixed_effects(t: Tables) -> DataFrame:
    return _rounded(stats.two_way(_panel(t), "sdg", "year", "x", "y"))


_MOVES = [("contemporaneous", 0, "x"), *((d, k, f"{d}_{k}") for d in ("lag", "lead") for k in (1, 2))]
_MOVED = ", ".join(f"{d}(x, {k}) OVER (PARTITION BY sdg ORDER BY year) AS {d}_{k}" for d in ("lag", "lead") for k in (1, 2))


@q(f"{_PANEL}, mv AS (SELECT *, {_MOVED} FROM bl), al AS (" + " UNION ALL ".join(f"SELECT 'clean' AS panel, '{d}' AS direction, {k} AS k, * FROM {_two_way_sql(c)}" for d, k, c in _MOVES) + f"), pv AS (SELECT *, {_p_sql('tv', 'df')} AS pv FROM al) SELECT panel, direction, k, {_FIT}, CASE WHEN pv < 0.01 THEN '***' WHEN pv < 0.05 THEN '**' WHEN pv < 0.1 THEN '*' ELSE '' END AS stars FROM pv")
def m04_placebo(t: Tables) -> DataFrame:
    return _rounded(stats.placebo({"clean": _panel(t)}, "sdg", "year", "x", "y", (1, 2)))


@q(f"{_PAIR} SELECT count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r_squared, (regr_r2(y, x) > 0.9 AND abs(regr_slope(y, x) - 1) < 0.05) AS passes FROM pr")
def m05_regression(t: Tables) -> DataFrame:
    return stats.simple_regression(_pair(t), "x", "y")


@q("s AS (SELECT count(*)::DOUBLE AS n, avg((quality = toxic)::INTEGER) AS po, avg(quality) AS a, avg(toxic) AS b FROM labels), k AS (SELECT *, a * b + (1 - a) * (1 - b) AS pe FROM s) SELECT n::BIGINT AS n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa, CASE WHEN (po - pe) / (1 - pe) >= 0.8 THEN 'almost perfect' WHEN (po - pe) / (1 - pe) >= 0.6 THEN 'substantial' WHEN (po - pe) / (1 - pe) >= 0.4 THEN 'moderate' WHEN (po - pe) / (1 - pe) >= 0.2 THEN 'fair' ELSE 'poor' END AS band FROM k")
def m06_kappa(t: Tables) -> DataFrame:
    return stats.binary_agreement(t.coders(), "a", "b")


_MULTI = "mc AS (SELECT o_orderkey % 5 AS t, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 4 ELSE o_orderkey % 5 END AS g FROM orders)"


def _multi(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select((k % 5).alias("t"), F.when(k % 3 == 0, k % 4).otherwise(k % 5).alias("g"))


@q(f"{_MULTI}, r AS (SELECT t AS k, count(*) AS t FROM mc GROUP BY 1), c AS (SELECT g AS k, count(*) AS g FROM mc GROUP BY 1), h AS (SELECT t AS k, count(*) AS h FROM mc WHERE t = g GROUP BY 1), p AS (SELECT k, coalesce(t, 0) AS t, coalesce(g, 0) AS g, coalesce(h, 0) AS h FROM r FULL JOIN c USING (k) LEFT JOIN h USING (k)), s AS (SELECT sum(t)::DOUBLE AS n, sum(h) AS h, avg(2 * h / (t + g)::DOUBLE) AS f1, sum(t * g)::DOUBLE AS tg FROM p) SELECT n::BIGINT AS n, round(h / n, 6) AS accuracy, round(f1, 6) AS macro_f1, round((h / n - tg / (n * n)) / (1 - tg / (n * n)), 6) AS kappa FROM s")
def m07_multiclass(t: Tables) -> DataFrame:
    return stats.multiclass(_multi(t), "t", "g")


@q(f"{_MULTI} SELECT t AS truth, count(*) AS n, round(avg((t = g)::INTEGER), 6) AS accuracy FROM mc GROUP BY t HAVING count(*) >= 3")
def m07_class_accuracy(t: Tables) -> DataFrame:
    return stats.class_accuracy(_multi(t), "t", "g")


_SCORED = "sc AS (SELECT doc_id, quality AS y, ((doc_id * 37) % 101) / 100.0::DOUBLE + quality * 0.2::DOUBLE AS s FROM labels), gg AS (SELECT *, (s >= 0.6)::INTEGER AS g FROM sc)"


def _scored(t: Tables) -> DataFrame:
    s = ((F.col("doc_id") * 37) % 101) / 100.0 + F.col("quality") * 0.2
    return t.labels.select("doc_id", F.col("quality").alias("y"), s.alias("s"), (s >= 0.6).cast("int").alias("g"))


@q(f"{_SCORED}, rk AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM gg), m AS (SELECT count(*) FILTER (y = 1 AND g = 1) AS tp, count(*) FILTER (y = 0 AND g = 1) AS fp, count(*) FILTER (y = 1 AND g = 0) AS fn, count(*) FILTER (y = 0 AND g = 0) AS tn, sum(r) FILTER (y = 1) AS rs FROM rk) SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, round((rs - (tp + fn) * (tp + fn + 1) / 2.0::DOUBLE) / ((tp + fn) * (fp + tn)), 6) AS roc_auc FROM m")
def m08_binary_metrics(t: Tables) -> DataFrame:
    return stats.binary_metrics(_scored(t), "y", "g", "s")


@q(f"{_SCORED}, b AS (SELECT s, count(*) AS c, count(*) FILTER (y = 1) AS p FROM gg GROUP BY s), w AS (SELECT p, sum(p) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cp, sum(c) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cc FROM b), tk AS (SELECT y, row_number() OVER (ORDER BY s DESC, doc_id) AS r FROM gg) SELECT (SELECT round(sum(p * cp / cc::DOUBLE) / sum(p), 6) FROM w) AS average_precision, {', '.join(f'(SELECT round(count(*) FILTER (y = 1 AND r <= {k}) / {k}::DOUBLE, 6) FROM tk) AS precision_at_{k}' for k in (50, 100, 200))}")
def m09_ranking_metrics(t: Tables) -> DataFrame:
    return stats.ranking_metrics(_scored(t), "y", "s", "doc_id", (50, 100, 200))


@q("SELECT 'coders' AS task, unnest(['n', 'positive']) AS metric, unnest([count(*)::VARCHAR, sum(quality)::BIGINT::VARCHAR]) AS value FROM labels")
def m16_long_report(t: Tables) -> DataFrame:
    return stats.long_report(t.labels.agg(F.count("*").alias("n"), F.sum("quality").alias("positive")), "coders")


@q("s AS (SELECT source, count(*)::DOUBLE AS n, avg(quality) AS p FROM labels JOIN documents USING (doc_id) GROUP BY source) SELECT source, round((p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS low, round((p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS high FROM s")
def m18_wilson(t: Tables) -> DataFrame:
    s = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum("quality").alias("h"))
    low, high = stats.wilson(F.col("h"), F.col("n"))
    return s.select("source", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@q("v AS (SELECT doc_id, quality AS v FROM labels UNION ALL SELECT doc_id, toxic FROM labels), c AS (SELECT doc_id, v, count(*) AS c FROM v GROUP BY ALL), s AS (SELECT sum(c * (c - 1) / 1.0::DOUBLE) AS ag, sum(c)::DOUBLE AS n FROM c), q AS (SELECT sum(t * (t - 1))::DOUBLE AS tt FROM (SELECT v, sum(c) AS t FROM c GROUP BY v)) SELECT n::BIGINT AS n, round(1 - (1 - ag / n) / (1 - tt / (n * (n - 1))), 6) AS alpha FROM s, q")
def m19_krippendorff(t: Tables) -> DataFrame:
    v = t.labels.select("doc_id", F.col("quality").alias("v")).unionByName(t.labels.select("doc_id", F.col("toxic").alias("v")))
    return stats.krippendorff(v, "doc_id", "v")


def _rules(texts: DataFrame, *more: str) -> DataFrame:
    """Texts with the rules' features, strata and more of their columns."""
    from lodeframe.operators import ml

    signals = _signals_of(texts, "text", *more).withColumn("labels", sum(topics.holds(F.col("text"), terms).cast("int") for terms in LEXICON.values()))
    rules = ml.rule_features(F.col("hits"), F.col("actor"), F.col("labels"), F.col("vocabulary"), F.col("shared"), F.col("place"))
    found = F.struct("candidate", "stratum", *(c.alias(k) for k, c in rules.items()))
    # A generator: a filter on strata isn't pushed below it, where it would scan the texts once more.
    return signals.select("doc_id", "text", *more, F.inline(F.array(found)))


def _labelled(t: Tables) -> DataFrame:
    """Labelled texts with the rules' features, which only these texts are scanned for."""
    labels = t.labels.where("quality is not null").select("doc_id", F.col("quality").alias("label"))
    return _rules(t.texts.join(few(labels, 2_000_000), "doc_id"), "label")


@q()
def m10_m12_text_classifier(t: Tables) -> DataFrame:
    """Character n-grams of 500 characters, 50,000 of them, log tf; scored on rows that weren't fitted."""
    from lodeframe.operators import ml

    rows = t.labels.join(t.texts.select("doc_id", F.substring("text", 1, 500).alias("text")), "doc_id").select("doc_id", F.col("quality").alias("label"), ml.char_grams(F.col("text")).alias("grams"))
    model = ml.fit(rows.where("doc_id % 5 <> 0"), grams="grams", sublinear=True)
    return ml.score(model, rows.where("doc_id % 5 = 0")).select("doc_id", "label", "oda_prob", "oda_relevant")


@q()
def t31_sentiment_batch(t: Tables) -> DataFrame:
    """Sentiment of every document by a model that is trained here, on 300 characters of the labelled ones."""
    from lodeframe.operators import ml

    texts = t.texts.select("doc_id", ml.word_grams(F.substring("text", 1, 300), 1).alias("grams"))
    model = ml.fit(texts.join(t.labels.select("doc_id", F.col("quality").alias("label")), "doc_id"), grams="grams", vocabulary=2000)
    return ml.sentiment(model, texts).drop("grams")


@q("x AS (SELECT date_trunc('day', ts) AS start, event_type, value FROM events) SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM x GROUP BY ALL")
def x01_windowed_counts(t: Tables) -> DataFrame:
    from lodeframe.streaming.ingest import windowed_counts

    out = windowed_counts(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "value")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@q()
def m15_compare_scorers(t: Tables) -> DataFrame:
    """Three scorers, each fitted out of fold: frame columns, all rules, rules and words."""
    from lodeframe.operators import ml

    rows = written(_labelled(t).withColumn("words", ml.word_grams(F.substring("text", 1, 1000), 1)).drop("text"), "scorers")
    return ml.compare_scorers(rows, ml.three_scorers("words", pairs=True), "label", "doc_id", (50, 100), k=3)


@q(f"{_SIGNALS}, rc AS (SELECT candidate, CASE WHEN doc_id % 7 = 0 THEN 'negative' ELSE stratum END AS recorded FROM st) SELECT count(*) AS n, round(avg((candidate = (recorded = 'candidate'))::INTEGER), 6) AS agreement FROM rc")
def m15_stratum_agreement(t: Tables) -> DataFrame:
    from lodeframe.operators import ml

    recorded = F.when(F.col("doc_id") % 7 == 0, "negative").otherwise(F.col("stratum"))
    return ml.stratum_agreement(_signals(t).withColumn("recorded", recorded), "candidate", "recorded")


@q("SELECT 'documents' AS name, unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS column_name")
def s14_header_peek(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("documents", c) for c in t.documents.columns], "name string, column_name string")


@q("SELECT 'topic' AS member, topic::VARCHAR AS label, n FROM (VALUES (1, 2), (2, 2), (3, 3), (4, 2), (5, 3)) v(topic, n)")
def t01_lexicon_file(t: Tables) -> DataFrame:
    """A dictionary file, read and checked, as a table of its sizes."""
    known = _reference(t)
    return t.spark.createDataFrame([("topic", str(k), len(v)) for k, v in known.topics.items()], "member string, label string, n int")


@q("SELECT doc_id::VARCHAR AS doc_id, lang, 2020 AS year FROM documents WHERE doc_id < 300 AND doc_id % 10 <> 3 UNION ALL SELECT doc_id::VARCHAR, NULL, 2021 FROM documents WHERE doc_id BETWEEN 300 AND 399")
def s02_s04_csv_files_by_name(t: Tables) -> DataFrame:
    """Year folders, one with rows of too many fields, one without a column, and one that was derived."""
    path = scratch(t.spark, "files")
    raw = lambda rows, to: rows.write.option("header", True).option("quote", "\u0000").csv(f"{path}/{to}")
    rows = t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("doc_id") % 10 == 3, F.concat("lang", F.lit(",too many"))).otherwise(F.col("lang")).alias("lang"))
    raw(rows.where("doc_id < 300"), "2020")
    raw(rows.where("doc_id between 300 and 399").select("doc_id"), "2021")
    raw(rows.limit(5), "2020_oda")
    out = None
    for year, found in by_year.article_files(t.spark, path, [2020, 2021]).items():
        one = by_year.read_files(t.spark, found, ["doc_id", "lang"]).withColumn("year", F.lit(year))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out.select("doc_id", "lang", "year")


@q("SELECT doc_id, lang, (doc_id % 3)::VARCHAR AS part FROM documents")
def s13_parts(t: Tables) -> DataFrame:
    """Three parts, one written before: the run skips it, and all are merged."""
    path = scratch(t.spark, "parts")
    make = {str(k): (lambda k=k: t.documents.where(F.col("doc_id") % 3 == k).select("doc_id", "lang")) for k in range(3)}
    by_year.process_parts(t.spark, path, {"1": make["1"]})
    ran = by_year.process_parts(t.spark, path, make)
    return by_year.merge_parts(t.spark, path).where(F.lit(ran == {"0": True, "1": False, "2": True}))


@q("SELECT event_id, event_type, (ts::DATE)::VARCHAR AS day FROM events WHERE event_id < 400")
def s05_json_day_files(t: Tables) -> DataFrame:
    path = scratch(t.spark, "days")
    rows = t.events.where("event_id < 400").select("event_id", "event_type", F.col("ts").cast("date").cast("string").alias("day"))
    rows.groupBy("day").agg(F.to_json(F.collect_list(F.struct("event_id", "event_type", "day"))).alias("value")).select("value", "day").write.partitionBy("day").text(path)
    return files.read_json_days(t.spark, f"{path}/*", rows.schema)


@q("SELECT doc_id, trim(source || ' ' || substr(text, 1, 500)) AS scorer_text, substr(source || ' ' || text, 1, 512) AS model_text, round_even(n_chars / 8.0::DOUBLE, 0) AS half_even, round(n_chars / 8.0::DOUBLE, 0) AS half_up FROM documents")
def p10_p18_builders_and_rounding(t: Tables) -> DataFrame:
    eighth = F.col("n_chars") / 8.0
    return t.documents.select("doc_id", F.trim(F.concat("source", F.lit(" "), F.substring("text", 1, 500))).alias("scorer_text"), F.substring(F.concat("source", F.lit(" "), "text"), 1, 512).alias("model_text"), F.bround(eighth, 0).alias("half_even"), F.round(eighth, 0).alias("half_up"))


@q(f"{ART}, {PROJECTS}, h AS (SELECT year, sdg, count(*) AS hand FROM art WHERE id % 2 = 0 GROUP BY ALL), m AS (SELECT year, sdg, count(*) AS ml FROM art WHERE id % 3 <> 0 GROUP BY ALL) SELECT year, sdg, hand, ml FROM h JOIN m USING (year, sdg)")
def j10_hand_and_model_cells(t: Tables) -> DataFrame:
    a = t.art()
    hand = a.where("id % 2 = 0").groupBy("year", "sdg").agg(F.count("*").alias("hand"))
    model = a.where("id % 3 <> 0").groupBy("year", "sdg").agg(F.count("*").alias("ml"))
    return hand.join(model, ["year", "sdg"]).dropna()


@q()
def m13_score_corpus(t: Tables) -> DataFrame:
    """Rules and words of whole texts: fitted on the labelled rows, scored on all that aren't negative."""
    from lodeframe.operators import ml

    words = ml.word_grams(F.col("text"), 1)
    model = ml.fit(_labelled(t).withColumn("words", words), grams="words", extra=ml.RULE_FEATURES, vocabulary=3000, pairs=True)
    return ml.score_corpus(model, _rules(t.texts).withColumn("words", words), "stratum").select("doc_id", "stratum", "precision_prob", "precision_relevant")
