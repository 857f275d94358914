"""Operator 10: WARC derivatives.

Each response record gives
* a metadata record (application/warc-fields: title, language, links of the page), and
* a conversion record (text/plain, the page's visible text),
both naming the response in WARC-Refers-To, and carrying on its target URI, date, HTTP
header block (source_headers) and payload digest (source_digest), with a block digest and
length of their own. Record ids are derived from the response's id, so a run that is
repeated after a loss gives the same records.

Page ids are integers; other types raise a TypeError. A response with a null or empty payload has a metadata record of length 0 and no
conversion record, and so has no one whose text is empty. A null URI or header stays null.
Responses with a null id are left out; repeated rows give repeated records. An empty table
gives an empty result. Columns other than those named aren't read; very long payloads are
converted whole. Everything is built-in expressions: no shuffle, no Python.

Character references end with a semicolon: all names of HTML, and decimal and hexadecimal
numbers, decoded once (&amp;lt; is &lt;), with the standard's replacements for numbers that
name no character. Others stay as they are. A no-break space counts as a blank. Attribute
values may stand in double, single or no quotation marks.

serialise() renders records as WARC/1.1 bytes: the response's header lines are fields
X-Source-Header, its digest X-Source-Digest; null fields are left out. parse() reads such
bytes, read_responses() the response records of WARC files.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.llm import _shared as S

#: Patterns work in Java's and RE2's dialect alike.
#: Comments and elements that aren't seen, whichever begins first.
DROPPED = r"(?is)<(?:!--.*?--|script\b[^>]*>.*?</script\s*|style\b[^>]*>.*?</style\s*|noscript\b[^>]*>.*?</noscript\s*|head\b[^>]*>.*?</head\s*)>"
BREAKS = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|tr|ul)\b[^>]*>"
TAGS = r"(?s)</?[a-zA-Z][^>]*>|<![^>]*>"
_FREQUENT = ("amp", "quot", "lt", "gt", "nbsp", "copy", "middot")
#: Characters by name, the frequent ones first: a map is searched from its begin.
ENTITIES = {n: html5[f"{n};"] for n in dict.fromkeys((*_FREQUENT, *(k[:-1] for k in html5 if k.endswith(";"))))}
ENTITY = r"^(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);"
#: What numbers of the C1 range stand for, as browsers read them (windows-1252).
C1 = {n: ord(bytes([n]).decode("cp1252")) for n in range(128, 160) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
BLANKS = "[ \\t\\r\\f\u00a0]+"
_VALUE = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""
QUOTES = """^["']|["']$"""
TITLE = r"(?is)<title[^>]*>(.*?)</title\s*>"
LANGUAGE = r"(?is)<html\s(?:[^>]*\s)?lang\s*=\s*" + _VALUE
LINK = r"(?is)<a\s(?:[^>]*\s)?href\s*=\s*" + _VALUE


def _character(n: Column) -> Column:
    """The character of a code point; U+FFFD if there is none."""
    utf16 = lambda x: F.lpad(F.hex(x), 4, "0")
    above = n - 0x10000
    pair = F.concat(utf16(F.shiftright(above, 10) + 0xD800), utf16(above.bitwiseAND(0x3FF) + 0xDC00))
    text = lambda digits: F.decode(F.unhex(digits), "UTF-16BE")
    none = n.isNull() | (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    return F.when(none, F.lit("\ufffd")).when(n < 0x10000, text(utf16(n))).otherwise(text(pair))


def _any_entities(c: Column) -> Column:
    """c with its character references decoded: what follows each '&' is looked at once."""
    known = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in ENTITIES.items())), F.lit("\x01"), F.lit("\x02"))
    c1 = F.create_map(*(F.lit(x) for kv in C1.items() for x in kv))

    def piece(x: Column) -> Column:
        name = F.regexp_extract(x, ENTITY, 1)
        number = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 1 << 20), 16, 10)).otherwise(F.substring(name, 2, 1 << 20)).try_cast("long")
        number = F.coalesce(F.try_element_at(c1, number.try_cast("int")).cast("long"), number)
        value = F.when(F.startswith(name, F.lit("#")), _character(number)).otherwise(F.try_element_at(known, name))
        return F.when(value.isNotNull(), F.concat(value, F.substring(x, F.length(name) + 2, F.length(x)))).otherwise(F.concat(F.lit("&"), x))

    parts = F.split(c, "&")
    rest = F.transform(F.slice(parts, 2, F.size(parts)), piece)
    return F.concat(parts[0], F.array_join(rest, ""))


def _entities(c: Column) -> Column:
    """c with its character references decoded.

    The frequent ones are replaced one name at a time, &amp; last so that nothing is decoded
    twice; texts in which another '&' is left go the general way.
    """
    plain = c
    for name in _FREQUENT[1:]:
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(ENTITIES[name]))
    more = F.contains(F.replace(plain, F.lit("&amp;"), F.lit("")), F.lit("&"))
    return F.when(more, _any_entities(c)).otherwise(F.replace(plain, F.lit("&amp;"), F.lit("&")))


def _without_tags(html: Column) -> Column:
    """A page's text with blocks on lines of their own, references not yet decoded."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, DROPPED, " "), BREAKS, "\n"), TAGS, "")


def _tidy(text: Column) -> Column:
    """Blanks and empty lines collapsed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, BLANKS, " "), r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def uuid_of(text: Column) -> Column:
    """A record id made of a text's digest."""
    d = F.md5(text)
    return F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(d, a, n), F.lit("-" if a < 21 else ">"))))


def digest_of(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def as_responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages as response records: what a crawl would have stored for them."""
    html = F.col(html_col).cast("string")
    return pages.where(F.col(id_col).isNotNull()).select(
        S.id_of(pages, id_col).alias("page_id"),
        uuid_of(F.concat(F.lit("response|"), F.col(id_col).cast("string"), F.lit("|"), F.coalesce(F.col(url_col), F.lit("")))).alias("record_id"),
        F.col(url_col).cast("string").alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.coalesce(F.octet_length(html), F.lit(0)).cast("string"), F.lit("\r\n\r\n")).alias("http_headers"),
        html.alias("payload"),
        digest_of(F.coalesce(html, F.lit(""))).alias("payload_digest"),
    )


def derivatives(responses: DataFrame) -> DataFrame:
    """Metadata and conversion records of response records."""
    field = lambda name, value: F.when(value != "", F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    value = lambda x: F.regexp_replace(x, QUOTES, "")
    kept = responses.where(F.col("record_id").isNotNull()).select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "warc_date", F.col("http_headers").alias("source_headers"), F.col("payload_digest").alias("source_digest"), F.coalesce(F.col("payload").cast("string"), F.lit("")).alias("html"))
    # Columns of their own, one step after the other, so that what decoding looks at more than once is made once.
    html, links = F.col("html"), F.col("links")
    made = kept.select("*", _without_tags(html).alias("text"), F.regexp_extract(html, TITLE, 1).alias("title"), value(F.regexp_extract(html, LANGUAGE, 1)).alias("language"), F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), value)).alias("links")).drop("html")
    made = made.withColumns({"text": _entities(F.col("text")), "title": F.trim(F.regexp_replace(_entities(F.col("title")), "[\\s\u00a0]+", " "))})
    made = made.withColumns({
        "text": _tidy(F.col("text")),
        "metadata": F.concat(field("title", F.col("title")), field("language", F.col("language")), F.array_join(F.transform(links, lambda x: F.concat(F.lit("outlink: "), _entities(x), F.lit(" L a/@href\r\n"))), "")),
    })
    records = F.array(
        F.struct(F.lit("metadata").alias("type"), F.lit("application/warc-fields").alias("content_type"), F.col("metadata").alias("block")),
        F.struct(F.lit("conversion").alias("type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    rows = made.select("page_id", "refers_to", "target_uri", "warc_date", "source_headers", "source_digest", F.explode(records).alias("r"))
    return rows.where("r.type = 'metadata' or r.block <> ''").select(
        "page_id", F.col("r.type").alias("record_type"), uuid_of(F.concat("r.type", F.lit("|"), "refers_to")).alias("record_id"), "refers_to", "target_uri", "warc_date", F.col("r.content_type").alias("content_type"),
        F.octet_length("r.block").cast("long").alias("content_length"), digest_of(F.col("r.block")).alias("block_digest"), "source_digest", "source_headers", F.col("r.block").alias("block"),
    )


def serialise(records: DataFrame) -> DataFrame:
    """record_id, warc: each record's bytes in WARC/1.1."""
    head = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\r\n"))).otherwise("")
    names = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("X-Source-Digest", "source_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    lines = F.filter(F.split(F.coalesce("source_headers", F.lit("")), "\r\n"), lambda x: x != "")
    source = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("X-Source-Header: "), x, F.lit("\r\n"))), "")
    text = F.concat(F.lit("WARC/1.1\r\n"), *(head(n, c) for n, c in names), source, F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n"))
    return records.select("record_id", F.encode(text, "utf-8").alias("warc"))


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC file's bytes; the values of a repeated field stand on lines of their own."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        headers: dict[str, str] = {}
        for x in lines[1:]:
            name, _, value = x.partition(":")
            headers[name] = f"{headers[name]}\n{value.strip()}" if name in headers else value.strip()
        stop = end + 4 + int(headers["Content-Length"])
        if stop > len(data):
            raise ValueError(f"the record at byte {at} is cut off")
        out.append((headers, data[end + 4 : stop]))
        at = stop + 4
    return out


def unpacked(data: bytes) -> bytes:
    """The bytes of a file that may be gzip, in one member or one for each record."""
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(data) + d.flush())
        data = d.unused_data
    return b"".join(out) if out else data


_RESPONSE = ("record_id", "target_uri", "warc_date", "http_headers", "payload", "payload_digest")
_CHARSET = re.compile(rb"(?im)^content-type:.*?charset=[\"']?([\w.-]+)")


def _responses_of(data: bytes) -> list[tuple]:
    rows = []
    for headers, block in parse(unpacked(data)):
        if headers.get("WARC-Type") == "response":
            head, gap, body = block.partition(b"\r\n\r\n")
            named = _CHARSET.search(head)
            try:
                payload = body.decode(named[1].decode() if named else "utf-8", "replace")
            except LookupError:
                payload = body.decode("utf-8", "replace")
            rows.append((headers.get("WARC-Record-ID"), headers.get("WARC-Target-URI"), headers.get("WARC-Date"), (head + gap).decode("utf-8", "replace"), payload, headers.get("WARC-Payload-Digest")))
    return rows


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files (plain or gzip), as derivatives() takes them; page_id is a hash of the record id.

    A file is one task's work and is held in memory; bytes that aren't of the page's charset
    become U+FFFD. Files without responses give no rows; a file that is cut off fails.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = _responses_of(content)
                for at in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows[at : at + 1000], strict=True)], names=list(_RESPONSE))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"{c} string" for c in _RESPONSE)).withColumn("page_id", F.xxhash64("record_id"))
