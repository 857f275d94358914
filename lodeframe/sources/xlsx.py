"""Spreadsheets (.xlsx) as text tables, without any spreadsheet library.

A file is one task's work: its first sheet's rows, the first of which are the headers.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_rows(data: bytes) -> list[list[str | None]]:
    """The first sheet's cells as text; cells that are absent are None."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{_NS}t")))
        first = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))[0]
        out = []
        for row in ElementTree.fromstring(z.read(first)).iter(f"{_NS}row"):
            cells: dict[int, str | None] = {}
            for k, c in enumerate(row.iter(f"{_NS}c")):
                at = _column(c.get("r")) if c.get("r") else k
                kind, v = c.get("t"), c.find(f"{_NS}v")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                elif v is not None and v.text is not None:
                    cells[at] = shared[int(v.text)] if kind == "s" else v.text
            out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
        return out


def read_xlsx(spark: SparkSession, path: str, columns: list[str] | None = None, renamed: dict[str, str] | None = None) -> DataFrame:
    """All files below path, columns by header; without columns, those of the first file. Unknown headers stay as they are."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", True).load(path)
    if columns is None:
        head = files.select("content").limit(1).collect()
        columns = [h for h in sheet_rows(bytes(head[0][0]))[0] if h] if head else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = sheet_rows(content)
                at = {h: i for i, h in enumerate(rows[0])} if rows else {}
                cols = [[r[at[c]] if c in at and at[c] < len(r) else None for r in rows[1:]] for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=columns)

    df = files.select("content").mapInArrow(run, ", ".join(f"`{c}` string" for c in columns))
    return df.withColumnsRenamed(renamed or {})
