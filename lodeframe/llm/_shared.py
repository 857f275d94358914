"""Helpers of the training-data operators: tables, the shared folder, vectorised words.

Words are maximal runs of letters and digits of the lower-cased text. They are never
built as Python strings here: a batch's UTF-8 buffer is cut and hashed with numpy.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeframe.session import spread

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_GRAM = 0xD6E8FEB86659FD93 | 1
_GRAM_INV = pow(_GRAM, -1, 1 << 64)
#: Bytes of text cut and hashed at once; bounds a worker's memory.
CHUNK_BYTES = 1 << 18
#: Bytes (estimated) that may be broadcast; a larger side is joined by a shuffle.
BROADCAST_BYTES = 128_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder; one that operators work on row by row is spread over the cores if it is one small file."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, df.columns[0]) if name in ("documents", "pages", "conversations") else df


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Only where the session doesn't name one (local tests) a temporary folder is set.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_lodeframe_dir", None)
    if not root:
        root = sc._lodeframe_dir = tempfile.mkdtemp(prefix="lodeframe-")
    return f"{root.rstrip('/')}/lodeframe-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of df from a table in the shared folder: cuts lineage, survives lost executors.

    The result reads the table whenever it runs, so tables stay until clean() or discard().
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    spark.sparkContext.__dict__.setdefault("_lodeframe_tables", set()).add(path)
    out = spark.read.parquet(path)
    out._lodeframe_table = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    spark.sparkContext._lodeframe_tables.discard(path)


def discard(df: DataFrame) -> None:
    """Deletes the table of a written() that nothing reads any more, such as the round before in an iteration."""
    _delete(df.sparkSession, df._lodeframe_table)


def clean(spark: SparkSession) -> int:
    """Deletes all tables that written() has left. Call it once the results that depend on them are stored; returns their number."""
    paths = list(getattr(spark.sparkContext, "_lodeframe_tables", ()))
    for path in paths:
        _delete(spark, path)
    return len(paths)


def id_of(df: DataFrame, name: str) -> Column:
    """The id column as a long. Ids are integers (or all null); others raise a TypeError before anything runs."""
    kind = df.select(F.col(name)).schema[0].dataType
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"column {name} holds {kind.simpleString()}: ids must be integers, so number the rows first")
    return F.col(name).cast("long")


def filter_ids(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """left_semi or left_anti of df by key; ids is a written table of distinct keys.

    Its size is counted first: up to BROADCAST_BYTES it is broadcast, so that df (wide
    texts) doesn't move; beyond that it is an ordinary shuffled join.
    """
    return df.join(F.broadcast(ids) if small(ids, 64) else ids.hint("merge"), key, how)


def small(rows: DataFrame, row_bytes: int, lists: str | None = None, entry_bytes: int = 0) -> bool:
    """Whether a written table is at most BROADCAST_BYTES in memory: so many bytes for each row and each entry of its lists."""
    entries = F.lit(0) if lists is None else F.coalesce(F.size(lists), F.lit(0))
    total = rows.agg(F.sum(row_bytes + entries.cast("long") * entry_bytes)).first()[0]
    return (total or 0) <= BROADCAST_BYTES


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, CHUNK_BYTES + 4096), base, dtype=U64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if len(known) <= 4 * CHUNK_BYTES:
            _powers[base] = known
    return known[:n]


@dataclass
class Words:
    """The words of some documents: hashes, byte ranges, and each document's first word."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    data: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _unicode_separators(data: np.ndarray, word: np.ndarray) -> None:
    """Clears word where data holds punctuation beyond ASCII (U+0080-BF, U+2000-206F, U+3000-303F)."""
    for at in np.flatnonzero(data == 0xC2):
        if at + 1 < len(data) and data[at + 1] not in (0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE):
            word[at : at + 2] = False
    lead = np.flatnonzero((data == 0xE2) | (data == 0xE3))
    for at in lead:
        if at + 2 < len(data) and (data[at], data[at + 1]) in ((0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80)):
            word[at : at + 3] = False


def words(column: pa.Array) -> Words:
    """Cuts and hashes the words of a string column; nulls have no words."""
    column = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), none, none, np.zeros(n + 1, np.int64), data)
    word = _WORD_BYTE[data]
    _unicode_separators(data, word)
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    begin[edge] = word[edge]
    end[:-1] &= ~word[1:]
    end[edge - 1] = word[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(_BASE, len(data)), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * powers(_BASE_INV, len(data))[starts] + (ends - starts).astype(U64))
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets), data)


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of length words, over document borders too: callers mask those."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(len(hashes) + 1, dtype=U64)
    np.cumsum(hashes * powers(_GRAM, len(hashes)), out=total[1:])
    return mix((total[length:] - total[:-length]) * powers(_GRAM_INV, len(hashes))[:n] + U64(length))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about most bytes of text each; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        # From the buffer: to_numpy() would import pandas, 23 MB in each worker.
        column = batch.column(batch.schema.get_field_index(text))
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        begin = 0
        while begin < batch.num_rows:
            stop = max(begin + 1, int(np.searchsorted(at, at[begin] + most, side="right")) - 1)
            yield batch.slice(begin, stop - begin)
            begin = stop
    # Workers are used again by other stages: what this one no longer needs goes back.
    pa.default_memory_pool().release_unused()


def flat(column: pa.Array, kind: type) -> np.ndarray:
    """The bytes of a binary column without nulls, one row's after the other, as numbers."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(kind)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column of the given kind from flat values and each row's count."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def blobs(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column: each row's values as raw bytes."""
    offsets = np.concatenate([[0], np.cumsum(counts)]) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def together(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Joins small batches to batches of at least rows rows."""
    held, count = [], 0
    for b in batches:
        held.append(b)
        count += b.num_rows
        if count >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, count = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
