"""Files in and out, upserts and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from lodeframe import config
from lodeframe.sources import articles, files, lexicons
from lodeframe.streaming import ingest


def test_csv_keeps_text_and_drops_the_byte_order_mark(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿news_id,title\n1,"a ""b"", c\nd"\n2,\n', encoding="utf-8")
    rows = articles.read_csv(spark, str(p)).collect()
    assert [(r.news_id, r.title) for r in rows] == [("1", 'a "b", c\nd'), ("2", None)]


def test_articles_resolve_aliases_and_drop_rows_without_date(spark):
    df = spark.createDataFrame([("1", "2024-01-05", "o", "a|b"), ("2", "abc", "o", None), (None, "20240101", "o", None)], "news_id string, pub_date string, provider string, keywords string")
    rows = articles.articles(df).collect()
    assert [(r.article_id, r.year, r.month, r.keywords) for r in rows] == [("1", 2024, 1, ["a", "b"])]


def test_last_write_wins(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, seq int, v string")
    new = spark.createDataFrame([("a", 2, "z")], "k string, seq int, v string")
    assert {r.k: r.v for r in articles.upsert(old, new, "k", "seq").collect()} == {"a": "z", "b": "y"}


def test_months_are_partitions(spark, tmp_path):
    df = spark.createDataFrame([("1", 2024, 1), ("2", 2024, 2)], "article_id string, year int, month int")
    articles.write_months(df, str(tmp_path / "t"))
    assert (tmp_path / "t" / "year=2024" / "month=2").is_dir()
    assert spark.read.parquet(str(tmp_path / "t")).where("month = 2").count() == 1


def test_stream_upsert_is_the_batch_upsert(spark, tmp_path):
    schema = "k string, seq int, day string, v string"
    rows = [[("a", 1, "d1", "x"), ("b", 1, "d1", "y")], [("a", 2, "d1", "z"), ("c", 1, "d2", "w")]]
    for r in rows:
        spark.createDataFrame(r, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = ingest.stream_files(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        ingest.upsert_stream(s, str(tmp_path / "out"), str(tmp_path / "cp"), "k", "seq", "day").awaitTermination()
    got = {r.k: r.v for r in spark.read.parquet(str(tmp_path / "out")).select(F.col("k"), F.col("v")).collect()}
    assert got == {"a": "z", "b": "y", "c": "w"}


def test_spreadsheets_are_text_tables(spark, tmp_path):
    import zipfile

    from lodeframe.sources.xlsx import read_xlsx

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>id</t></si><si><t>제목</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><v>7</v></c><c r="B2" t="s"><v>2</v></c></row><row r="3"><c r="B3" t="inlineStr"><is><t>c</t></is></c></row></sheetData></worksheet>')
    rows = read_xlsx(spark, str(tmp_path), renamed={"제목": "title"}).collect()
    assert [(r.id, r.title) for r in rows] == [("7", "ab"), (None, "c")]


def test_article_files_by_year(spark, tmp_path):
    """Year folders and flat files; derived ones, others and what has more fields than its header are left out."""
    (tmp_path / "2016").mkdir()
    (tmp_path / "2016" / "news_2016_01.csv").write_text("﻿article_id,title,x\n1,a,1\n2,b,2,too many\n3\n", encoding="utf-8")
    (tmp_path / "2016" / "news_2016_01_classified.csv").write_text("article_id,title\n9,z\n")
    (tmp_path / "news_2017_01.csv").write_text('article_id,body\n4,"c, d\ne"\n5,f\n6,g\n')
    (tmp_path / "news_2017_02_oda.csv").write_text("article_id\n9\n")
    (tmp_path / "other.csv").write_text("q\n9\n")
    (tmp_path / "news_2017_03.csv").write_text("q\n9\n")
    found = files.article_files(spark, str(tmp_path))
    assert {y: [p.rsplit("/", 1)[-1] for p in ps] for y, ps in found.items()} == {2016: ["news_2016_01.csv"], 2017: ["news_2017_01.csv", "news_2017_03.csv"]}
    assert list(files.article_files(spark, str(tmp_path), [2017])) == [2017]
    paths = [p for ps in found.values() for p in ps]
    assert files.header(spark, paths[0]) == ["article_id", "title", "x"]
    rows = files.read_files(spark, paths, ["article_id", "title", "body"])
    assert sorted((r.article_id, r.title, r.body, r.source_file) for r in rows.collect() if r.article_id != "3") == [("1", "a", None, "news_2016_01.csv"), ("4", None, "c, d\ne", "news_2017_01.csv"), ("5", None, "f", "news_2017_01.csv"), ("6", None, "g", "news_2017_01.csv")]
    assert {r.title for r in rows.where("article_id = '3'").collect()} == {None}
    assert sorted(r.article_id for r in files.read_files(spark, paths, ["article_id"], most_rows=1).collect()) == ["1", "4"]
    assert files.read_files(spark, paths[-1:], ["article_id"]).count() == 0


def test_parts_are_written_once(spark, tmp_path):
    seen = []

    def make(k):
        def run():
            seen.append(k)
            return spark.range(k)

        return run

    root = str(tmp_path / "parts")
    assert files.process_parts(spark, root, {"a": make(2)}) == {"a": True}
    assert files.process_parts(spark, root, {"a": make(2), "b": make(3)}) == {"a": False, "b": True} and seen == [2, 3]
    (tmp_path / "parts" / "part=a" / "_SUCCESS").unlink()  # a run that was broken off
    assert files.process_parts(spark, root, {"a": make(4), "b": make(3)}) == {"a": True, "b": False}
    assert sorted((r.part, r.id) for r in files.merge_parts(spark, root).collect()) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0), ("b", 1), ("b", 2)]
    files.export_csv(files.merge_parts(spark, root), str(tmp_path / "out"), ["part", "id"])
    (one,) = (tmp_path / "out").glob("*.csv")
    assert one.read_text().splitlines()[:3] == ["id,part", "0,a", "1,a"]


def test_paths_of_the_environment():
    p = config.paths("/data", {"LABELS_DIR": "s3a://x/labels/", "MAX_RETRIES": "5"})
    assert (p.news_data_dir, p.labels_dir, p.max_retries, p.models_dir) == ("/data/src/news", "s3a://x/labels", 5, "/data/models")


def test_reference_files_are_checked(spark, tmp_path):
    data = {
        "topics": {"1": ["빈곤"], "17": ["ODA"]}, "places": {"베트남": "VNM"}, "recipients": ["VNM"], "sectors": {"12220": 3}, "sector_prefixes": {"122": 3},
        "terms": [{"holder": "A", "side": "left", "start": "2003-02-25", "end": "2008-02-24"}], "acting": [{"start": "2004-03-12", "end": "2004-05-14"}],
        "events": [{"year": 2010, "month": 11, "label": "summit"}], "crisis_events": [{"year": 2011, "month": 3, "kind": "disaster", "severity": 3, "topics": [1, 17]}],
        "outlets": [{"code": "01", "outlet": "o", "media_category": "daily"}],
    }
    (tmp_path / "r.json").write_text(json.dumps(data, ensure_ascii=False), encoding="utf-8")
    r = lexicons.read_reference(spark, str(tmp_path / "r.json"))
    assert r.topics == {1: ["빈곤"], 17: ["ODA"]} and r.severity == []
    assert [tuple(x) for x in r.table(spark, "sectors").collect()] == [("12220", 3)]
    assert str(r.table(spark, "terms").first().start) == "2003-02-25" and r.table(spark, "events").first().seq == 0
    assert r.table(spark, "crisis_events").first().topics == [1, 17] and r.table(spark, "acting").count() == r.table(spark, "outlets").count() == 1
    row = r.classify(spark.createDataFrame([("빈곤과 ODA, 빈곤",)], "t string"), F.col("t"), F.col("t")).first()
    assert (row.sdg_label, row.sdg_secondary, row.kw_hits) == (1, 17, 3)
    for wrong in ({"topics": {"18": ["x"]}}, {"topics": {"1": ["x"], "2": ["x"]}}, {"topics": {"1": [""]}}, {"what": []}, {"sectors": {"1": 99}}, {"events": [{"year": 2010, "month": 13, "label": "x"}]}, {"terms": [{"holder": "A", "side": "l", "start": "2010-01-01", "end": "2009-01-01"}]}, {"acting": [{"start": "x", "end": "y"}]}, {"places": {"a": "A"}, "recipients": ["B"]}, {"crisis_events": [{"year": 1}]}, {"severity": "x"}):
        with pytest.raises(ValueError):
            lexicons.reference(wrong)
    rows = spark.createDataFrame([(2, "b"), (1, "z"), (1, "a"), (1, None), (1, "a")], "topic int, term string")
    assert lexicons.lexicon(rows) == {1: ["a", "z"], 2: ["b"]}
