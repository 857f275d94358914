"""Each operator and pipeline stage on awkward and empty tables has the result its docstring names."""

import html

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodeframe.llm import _shared as S
from lodeframe.llm import bpe, chat, decontam, imatch, langid, licenses, near_join, pii, repeats, warc
from tests.llm import tables as T


@pytest.fixture(scope="module")
def docs(spark):
    return T.awkward(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return T.empty(spark)


def test_near_pairs(docs, none):
    got = {(r.doc_id_a, r.doc_id_b): r.jaccard for r in near_join.near_pairs(docs).collect()}
    assert got.keys() == {(1, 8), (6, 7), (11, 12)} and got[1, 8] == got[6, 7] == 1.0 and 0.55 < got[11, 12] < 1
    kept = near_join.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.select("doc_id").collect())
    assert ids == [-1, -1, 1, 2, 3, 4, 5, 6, 9, 10, 11]
    assert near_join.near_pairs(none).count() == near_join.drop_near_copies(none).count() == 0


def test_leaks(spark, docs, none):
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(docs, T.benchmark(spark)).collect()}
    assert got.keys() == {(11, 1), (12, 1)}
    assert got[11, 1].score == 1.0 and (got[11, 1].first_word, got[11, 1].end_word) == (0, 23)
    kept = decontam.drop_leaks(docs, T.benchmark(spark))
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert decontam.leaks(none, T.benchmark(spark)).count() == 0
    assert decontam.leaks(docs, T.benchmark(spark).limit(0)).count() == 0
    assert decontam.drop_leaks(docs, T.benchmark(spark).limit(0)).count() == docs.count()


def test_language(docs, none):
    prototypes = langid.fit(docs)
    assert list(prototypes) == ["en"]
    rows = langid.identify(docs, prototypes).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    for k in (2, 3, 4, 5):
        assert (by[k].pred_lang, by[k].cosine, by[k].margin, by[k].accepted) == (None, 0.0, 0.0, False)
    assert by[1].pred_lang == "en" and by[1].accepted and by[9].accepted
    kept = langid.keep_identified(docs, prototypes)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, None, 6, 7, 8, 9, 10, 11, 12}
    assert langid.fit(none) == {} and langid.identify(none, prototypes).count() == 0
    assert {r.accepted for r in langid.identify(docs, {}).collect()} == {False}


def test_bpe(docs, none):
    rows = bpe.encode(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id == 2:
            assert (r.n_tokens, r.token_ids, r.round_trip) == (None, None, None)
        elif r.doc_id == 3:
            assert (r.n_tokens, r.token_ids, r.round_trip) == (0, [], True)
        elif r.doc_id is not None:
            assert r.round_trip and r.n_tokens == len(r.token_ids) > 0
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back[2] is None and back[6] == T.LONG
    assert bpe.encode(none).count() == 0


def test_fingerprints(docs, none):
    rows = imatch.fingerprints(docs, max_share=0.5).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].fp_0 == by[8].fp_0 is not None and by[6].fp_1 == by[7].fp_1
    assert (by[2].n_terms, by[2].fp_0, by[3].fp_0, by[5].fp_0) == (0, None, None, None)
    assert imatch.fingerprints(none).count() == 0


def test_chat(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", None), (1, 2, "assistant", "a " * 5000), (1, 2, "assistant", "a " * 5000), (1, 3, "user", "hi"), (1, 3, "user", "hi again"), (2, 0, "system", "alone"), (None, 1, "user", "x"), (3, None, "user", "x"), (3, 1, None, "x"), (4, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as tokens", "2 as turns", "3 as window")
    got = sorted(chat.chat_windows(df).collect(), key=lambda r: (r.conv_id, r.window))
    assert [(r.conv_id, r.window, r.first_turn, r.last_turn, r.over_budget, r.mask) for r in got] == [(1, 0, 1, 1, False, "00"), (1, 1, 2, 2, True, "01"), (1, 2, 3, 3, False, "000"), (4, 0, 0, 0, False, "0")]
    assert all(r.text.startswith("<|system|>\nbe brief\n") for r in got if r.conv_id == 1)
    assert chat.chat_windows(df.limit(0)).count() == 0


def test_licenses(spark, docs, none):
    extra = spark.createDataFrame([(20, "x. Released under the\nMIT  license! Released under the MIT License"), (None, "Licensed under the Apache License, Version 2.0.")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.license_id, r.first_word, r.end_word) for r in licenses.scan(docs.select("doc_id", "text").unionByName(extra)).collect())
    assert got == [(0, "Apache-2.0", 0, 8), (20, "MIT", 1, 6), (20, "MIT", 6, 11)]
    assert licenses.scan(none).count() == 0 and licenses.scan(docs).count() == 0


def test_pii(docs, none):
    got = [(r.doc_id, r.kind, r.entity, r.score) for r in pii.identifiers(docs).collect()]
    assert got == [(10, "email", "a.b@c.org", 1.0)]
    masked = pii.mask(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    by = {r.doc_id: r.text for r in masked.collect() if r.doc_id is not None}
    assert by[10] == "mail [EMAIL] now" and by[6] == T.LONG and by[2] is None
    assert pii.identifiers(none).count() == pii.mask(none).count() == 0


def test_repeats(docs, none):
    got = sorted((r.doc_id, r.first_word, r.end_word) for r in repeats.repeated_passages(docs, min_words=20).collect())
    n = len(T.LONG.split())
    assert got == [(6, 0, n), (7, 0, n)]
    # A shorter minimum also finds what the edited copy shares.
    got = {(r.doc_id, r.first_word, r.end_word) for r in repeats.repeated_passages(docs.where("doc_id > 10"), min_words=6).collect()}
    assert got == {(11, 0, 7), (12, 0, 7), (11, 8, 23), (12, 8, 23)}
    assert repeats.repeated_passages(none).count() == 0


def test_warc(spark):
    rows = [(1, "http://a/", "<html lang=\"en\"><head><title>T &amp; x</title></head><body><p>Hi<b>!</b></p><script>x</script></body>"), (2, None, None), (3, "http://b/", ""), (None, "u", "x"), (1, "http://a/", "<p>again"), (4, "http://c/", "<p>" * 50_000 + "end")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as record_id", "2 as block")
    got = sorted((r.page_id, r.record_type, r.block) for r in warc.derivatives(warc.as_responses(pages)).collect())
    assert got == [(1, "conversion", "Hi!"), (1, "conversion", "again"), (1, "metadata", ""), (1, "metadata", "title: T & x\r\nlanguage: en\r\n"), (2, "metadata", ""), (3, "metadata", ""), (4, "conversion", "end"), (4, "metadata", "")]
    assert warc.derivatives(warc.as_responses(pages.limit(0))).count() == 0


def test_character_references(spark):
    """All names and numbers, decoded once, as the standard library does."""
    texts = ["&amp;lt; &#38;lt; &#x1F600; &#8217; &eacute;x &#146; &nosuch; &; &#; &#x; && &#99999999999999999999; &#xD800; &#0;", None, "", "no", "&", "&" * 50, " ".join(f"&{n};" for n in warc.ENTITIES)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", warc._entities(F.col("t")).alias("t")).collect()
    assert {r.i: r.t for r in rows} == {i: None if t is None else html.unescape(t) for i, t in enumerate(texts)}


def test_attributes_in_any_quotation_marks(spark):
    page = "<html class=x lang='pt-BR'><a href='/one'>1</a> <a class=\"c\" href = /two>2</a> <A HREF=\"/th&amp;ree\">3</A> <a data-href='/no'>4</a> &nbsp;caf&eacute; &#8217; &#x2014;&nbsp;"
    rows = {r.record_type: r.block for r in warc.derivatives(warc.as_responses(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"))).collect()}
    assert rows["metadata"] == "language: pt-BR\r\noutlink: /one L a/@href\r\noutlink: /two L a/@href\r\noutlink: /th&ree L a/@href\r\n"
    assert rows["conversion"] == "1 2 3 4 caf\u00e9 \u2019 \u2014"


def test_warc_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").limit(5)
    responses = warc.as_responses(pages)
    records = warc.derivatives(responses)
    data = b"".join(bytes(r.warc) for r in warc.serialise(records).collect())
    got = {h["WARC-Record-ID"]: (h, b) for h, b in warc.parse(data)}
    assert len(got) == records.count()
    for r in records.collect():
        h, b = got[r.record_id]
        assert (h["WARC-Refers-To"], h["WARC-Target-URI"], h["WARC-Block-Digest"], b.decode()) == (r.refers_to, r.target_uri, r.block_digest, r.block)
        assert h["X-Source-Digest"] == r.source_digest and h["X-Source-Header"].split("\n") == [x for x in r.source_headers.split("\r\n") if x]
        assert "WARC-Payload-Digest" not in h
    assert {r.refers_to for r in records.collect()} == {r.record_id for r in responses.collect()}


def test_null_headers_are_left_out(spark):
    row = spark.sql("select 'metadata' as record_type, '<urn:x>' as record_id, cast(null as string) as refers_to, cast(null as string) as target_uri, cast(null as string) as warc_date, 'text/plain' as content_type, 0L as content_length, 'd' as block_digest, cast(null as string) as source_digest, cast(null as string) as source_headers, '' as block")
    ((h, b),) = warc.parse(bytes(warc.serialise(row).first().warc))
    assert set(h) == {"WARC-Type", "WARC-Record-ID", "WARC-Block-Digest", "Content-Type", "Content-Length"} and b == b"" and warc.parse(b"") == []
    with pytest.raises(ValueError):
        warc.parse(bytes(warc.serialise(row).first().warc).replace(b"Content-Length: 0", b"Content-Length: 9"))


def test_responses_of_warc_files(spark, tmp_path):
    """Plain, and gzip by record: what derivatives() needs comes back, and goes on to the derived records."""
    import gzip

    def record(kind, number, head, body):
        block = head + body
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{number}>\r\nWARC-Target-URI: http://a/{number}\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:{number}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n"
    one = [record("warcinfo", 0, b"", b"software: x"), record("response", 1, head, "<p>caf\u00e9".encode("latin-1")), record("request", 2, b"GET / HTTP/1.1\r\n\r\n", b"")]
    (tmp_path / "a.warc").write_bytes(b"".join(one))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in [record("response", 3, b"HTTP/1.1 200 OK\r\n\r\n", b"<title>t</title>"), record("response", 4, head, b"")]))
    responses = warc.read_responses(spark, str(tmp_path))
    got = {r.record_id: r for r in responses.collect()}
    assert set(got) == {f"<urn:uuid:{k}>" for k in (1, 3, 4)}
    assert (got["<urn:uuid:1>"].payload, got["<urn:uuid:1>"].http_headers.encode(), got["<urn:uuid:1>"].payload_digest) == ("<p>caf\u00e9", head, "sha1:1")
    made = {(r.refers_to, r.record_type): r for r in warc.derivatives(responses).collect()}
    assert made["<urn:uuid:1>", "conversion"].block == "caf\u00e9" and made["<urn:uuid:3>", "metadata"].block == "title: t\r\n" and ("<urn:uuid:4>", "conversion") not in made
    assert made["<urn:uuid:1>", "metadata"].source_digest == "sha1:1" and made["<urn:uuid:1>", "metadata"].source_headers.encode() == head


def test_ids_are_integers(spark, none):
    docs = spark.createDataFrame([("a1", "some text")], "doc_id string, text string")
    numbers = spark.createDataFrame([(1, "some text")], "doc_id int, text string")
    for f in (near_join.near_pairs, near_join.drop_near_copies, bpe.encode, imatch.fingerprints, licenses.scan, pii.identifiers, repeats.repeated_passages, lambda d: langid.identify(d, {}), lambda d: decontam.leaks(d, T.benchmark(spark)), lambda d: chat.chat_windows(d.selectExpr("doc_id as conv_id", "1 as turn", "'user' as role", "text")), lambda d: warc.as_responses(d.selectExpr("doc_id as page_id", "text as url", "text as html"))):
        with pytest.raises(TypeError, match="ids must be integers"):
            f(docs)
    assert bpe.encode(numbers).first().doc_id == licenses.scan(numbers).count() + 1 == 1
    assert pii.mask(docs).count() == langid.keep_identified(docs, {}).count() + 1 == 1  # these two need no id


def test_one_id_with_several_texts(spark):
    """It is paired by each of its texts, once for each partner and with the highest similarity."""
    w = T.WORDS
    rows = [(1, w), (2, w.replace("lazy", "sleepy")), (3, w), (3, "something else that nobody repeats anywhere"), (4, "something else that nobody repeats anywhere else"), (3, w.replace("lazy", "sleepy"))]
    for _ in range(2):
        got = {(r.doc_id_a, r.doc_id_b): round(r.jaccard, 3) for r in near_join.near_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
        assert got == {(1, 2): 0.833, (1, 3): 1.0, (2, 3): 1.0, (3, 4): 0.833}
        rows.reverse()
    found = sorted((r.doc_id, r.n_words) for r in repeats.repeated_passages(spark.createDataFrame([(1, w), (2, w), (2, "x " + T.LONG[:900]), (3, "y " + T.LONG[:900])], "doc_id long, text string"), min_words=20).collect())
    assert {i for i, _ in found} == {1, 2, 3} and max(n for i, n in found if i == 3) > 100


def test_decoding_odd_tokens(spark):
    rows = [(1, [262]), (2, [10**6]), (3, None), (4, []), (5, [None]), (6, [bpe.encoder(bpe.VOCABULARY).ranks[b"\xff"]]), (None, [262])]
    got = {r.doc_id: r.text for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, token_ids array<int>")).collect()}
    assert got == {1: " the", 2: None, 3: None, 4: "", 5: None, 6: "\ufffd", None: " the"}
    assert bpe.encode(spark.createDataFrame([(1, "x")], "doc_id long, text string"), verify=False).columns == ["doc_id", "n_tokens", "token_ids"]


def test_written_tables_are_deleted(spark):
    S.clean(spark)
    near_join.near_pairs(T.awkward(spark)).collect()
    assert S.clean(spark) > 0 and S.clean(spark) == 0


#: The ids that each stage keeps of the awkward table, as its docstring says; None for rows without one.
KEPT = {
    "language_id": [None, 1, 6, 7, 8, 8, 9, 10, 11, 12],
    "ngram_jaccard_join": [None, None, 1, 2, 3, 4, 5, 6, 9, 10, 11],
    "benchmark_decontamination": [None, None, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9, 10, 11, 12],
    "pii_masking": [None, None, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9, 10, 11, 12],
    "bpe_encoding": [None, None, 1, 2, 3, 4, 5, 6, 7, 8, 8, 9, 10, 11, 12],
}


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_awkward_and_empty_tables(spark, sf, docs, none, name, stage):
    out = stage(spark, docs, sf)
    rows = out.collect()
    last = (name, stage) == corpus_pipeline.STAGES[-1]
    assert out.columns == (["doc_id", "n_tokens", "token_ids", "round_trip"] if last else docs.columns)
    assert sorted((r.doc_id for r in rows), key=lambda i: i or 0) == KEPT[name]
    by, before = ({r.doc_id: r for r in x if r.doc_id is not None} for x in (rows, docs.collect()))
    for i, r in by.items():
        if last:
            assert r.round_trip is (None if i == 2 else True)
        elif i == 10 and name == "pii_masking":
            assert (r.text, r.n_chars) == ("mail [EMAIL] now", 16)
        else:
            assert r == before[i]
    assert stage(spark, none, sf).count() == 0
