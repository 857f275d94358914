"""Operator 1: benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

1. Seeds: all word n-grams of the test items. None is left out for being frequent in the
   corpus: copies of an item raise the frequency of the n-grams they share, so a choice by
   frequency would let a full copy hide an edited one.
2. Join: a seed in a document gives a candidate (document, item, diagonal). An alignment that
   scores min_score * 2 * L for an item of L words has G = 2 L (1 - min_score) gaps at most,
   so all of it lies within G diagonals of its seeds, and the passage from G words before the
   item's begin on the diagonal to G words after its end holds it, whatever was inserted.
   Diagonals up to G apart share a passage. Passages with too few of the item's words to
   reach min_score by any alignment end here.
3. Alignment: the item's words against the passage, local alignment with match +2,
   mismatch -1, gap -1. score = best / (2 * words of the item): 1 for an exact copy, about
   1 - 1.5 e for a share e of edited words. What is found is what an alignment with the whole
   document finds, provided that one seed is in the aligned passage.

Result of leaks(): doc_id, item_id, score, first_word, end_word (of the aligned passage,
0-based, end excluded), the best alignment of each (document, item) at or above
min_score. Ties go to the earlier passage.

Ids are integers; other types raise a TypeError. Nulls and texts or items without words have
no rows; rows with a null id have none in leaks() and stay in drop_leaks(). Repeated rows of a
table count once; an id that names several texts has the best alignment of any. Items shorter
than n words are one seed. Empty tables give an empty result (or all documents in
drop_leaks). Columns other than ids and texts are not read. Very long texts are scanned whole.

The test items are sent to the executors, part_words words of them at a time: a benchmark
that is larger takes several passes over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.llm import _shared as S

_BITS = 1 << 20
#: Cells of the score matrix's row that are held for all passages aligned at once.
CELLS = 1 << 18


def item_words(texts: list[str]) -> list[np.ndarray]:
    w = S.words(pa.array(texts, pa.string()))
    return [w.hashes[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]


def seeds_of(items: list[np.ndarray], n: int) -> tuple[dict[int, np.ndarray], pa.Table]:
    """Distinct seed hashes by length, ascending, and (seed, item, at): seeds are numbered through the lengths.

    Items of fewer than n words are one seed.
    """
    sizes = np.array([len(x) for x in items])
    found: dict[int, list[tuple[np.ndarray, int]]] = {}
    for k in np.flatnonzero(sizes):
        length = min(n, int(sizes[k]))
        found.setdefault(length, []).append((S.windows(items[k], length), int(k)))
    keys, parts, base = {}, [], 0
    for length, own in sorted(found.items()):
        keys[length], number = np.unique(np.concatenate([h for h, _ in own]), return_inverse=True)
        parts.append((number + base, np.repeat([k for _, k in own], [len(h) for h, _ in own]), np.concatenate([np.arange(len(h)) for h, _ in own])))
        base += len(keys[length])
    cols = [np.concatenate(c) if parts else np.zeros(0) for c in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 3
    return keys, pa.table({name: pa.array(c.astype(np.int32)) for name, c in zip(("seed", "item", "at"), cols, strict=True)})


def _hits(keys_of: dict[int, np.ndarray]):
    """Finds seeds: doc, seed (its number), pos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, base = {}, 0
        for length, keys in keys_of.items():
            marks = np.zeros(_BITS, dtype=bool)
            marks[(keys & np.uint64(_BITS - 1)).astype(np.int64)] = True
            marked[length] = (keys, marks, base)
            base += len(keys)
        for part in S.chunks(batches):
            w = S.words(part.column(1))
            doc = w.doc()
            ids = part.column(0).to_numpy(zero_copy_only=False)
            for length, (keys, marks, base) in marked.items():
                grams = S.windows(w.hashes, length)
                at = np.flatnonzero(marks[(grams & np.uint64(_BITS - 1)).astype(np.int64)])
                place = np.minimum(np.searchsorted(keys, grams[at]), len(keys) - 1)
                good = (keys[place] == grams[at]) & (at + length <= w.first[1:][doc[at]])
                at, place = at[good], place[good]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[doc[at]], pa.int64()), pa.array((base + place).astype(np.int32)), pa.array((at - w.first[doc[at]]).astype(np.int32))], names=["doc", "seed", "pos"])

    return run


def smith_waterman(item: np.ndarray, passages: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of item with each row of passages: score, first and end column.

    One numpy row of the score matrix at a time for all passages. A gap in the item's
    direction along a row is a running maximum of (score + column).
    """
    rows, width = passages.shape
    column = np.arange(width, dtype=np.int32)
    above = np.zeros((rows, width + 1), dtype=np.int32)
    begin = np.tile(np.arange(width + 1, dtype=np.int32), (rows, 1))
    best = np.zeros(rows, dtype=np.int32)
    first, end = np.zeros(rows, dtype=np.int32), np.zeros(rows, dtype=np.int32)
    every = np.arange(rows)
    for word in item:
        same = (passages == word) & valid
        diagonal = above[:, :-1] + np.where(same, 2, -1)
        up = above[:, 1:] - 1
        score = np.maximum(diagonal, up)
        origin = np.where(diagonal >= up, begin[:, :-1], begin[:, 1:])
        origin = np.where(score > 0, origin, column + 1)
        score = np.maximum(score, 0)
        # Packed so that the running maximum also carries the origin; later origins lose ties.
        packed = ((score + column).astype(np.int64) << 32) - origin
        run = np.maximum.accumulate(packed, axis=1)
        value = (run + ((1 << 32) - 1)) >> 32
        score = (value - column).astype(np.int32)
        origin = ((value << 32) - run).astype(np.int32)
        above = np.concatenate([np.zeros((rows, 1), np.int32), score], axis=1)
        begin = np.concatenate([np.zeros((rows, 1), np.int32), origin], axis=1)
        top = score.argmax(axis=1)
        better = score[every, top] > best
        best = np.where(better, score[every, top], best)
        first = np.where(better, origin[every, top], first)
        end = np.where(better, top + 1, end)
    return best, first, end


def most_gaps(words: int, min_score: float) -> int:
    """The most gaps of an alignment that reaches min_score: 2 for each matched word, less one for each gap."""
    return int(2 * words * (1 - min_score) + 1e-9)


def able(item: np.ndarray, passages: np.ndarray, valid: np.ndarray, min_score: float) -> np.ndarray:
    """Passages that could reach min_score: a word scores 2 at most, so that takes min_score * words matches.

    Matches are at most as many as the item's words that the passage has, and as the
    passage's words that the item has.
    """
    known, which = np.unique(item, return_inverse=True)
    place = np.minimum(np.searchsorted(known, passages), len(known) - 1)
    row, column = np.nonzero((known[place] == passages) & valid)
    there = np.zeros((len(passages), len(known)), dtype=np.float32)
    there[row, place[row, column]] = 1
    matches = np.minimum(there @ np.bincount(which).astype(np.float32), np.bincount(row, minlength=len(passages)))
    return matches >= min_score * len(item) - 1e-6


def _align(items: list[np.ndarray], min_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in S.chunks(batches):
            w = S.words(part.column(1))
            ids = part.column(0).to_pylist()
            found = part.column(2)
            flat = found.flatten()
            of = np.repeat(np.arange(len(ids)), found.value_lengths().to_numpy(zero_copy_only=False))
            item, diagonal = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            order = np.lexsort((diagonal, of, item))
            of, item, diagonal = of[order], item[order], diagonal[order]
            out = []
            edges = np.concatenate([[0], np.flatnonzero(item[1:] != item[:-1]) + 1, [len(item)]])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                words = items[item[a]]
                gaps = most_gaps(len(words), min_score)
                # The first diagonal of each passage: those up to gaps further on are in it too.
                docs, starts = [], []
                last_doc, last = -1, 0
                for d, x in zip(of[a:b].tolist(), diagonal[a:b].tolist(), strict=True):
                    if d != last_doc or x > last + gaps:
                        docs.append(d)
                        starts.append(x - gaps)
                        last_doc, last = d, x
                width = len(words) + 3 * gaps
                step = max(1, CELLS // max(width, 1))
                for at in range(0, len(docs), step):
                    doc = np.array(docs[at : at + step])
                    start = w.first[doc] + np.array(starts[at : at + step])
                    where = start[:, None] + np.arange(width)
                    valid = (where >= w.first[doc][:, None]) & (where < w.first[doc + 1][:, None])
                    passages = w.hashes[np.clip(where, 0, len(w.hashes) - 1)]
                    good = able(words, passages, valid, min_score)
                    if not good.any():
                        continue
                    doc, start, passages, valid = doc[good], start[good], passages[good], valid[good]
                    score, first, end = smith_waterman(words, passages, valid)
                    begin = start - w.first[doc]
                    for k in np.flatnonzero(score >= min_score * 2 * len(words)):
                        out.append((ids[doc[k]], int(item[a]), score[k] / (2 * len(words)), int(begin[k] + first[k]), int(begin[k] + end[k])))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "score", "first_word", "end_word"])

    return run


LEAKS = "doc_id long, item_id long, score double, first_word int, end_word int"


def _leaks_of(texts: DataFrame, ids: list[int], items: list[np.ndarray], n: int, min_score: float) -> DataFrame:
    """Every alignment with some items that is good enough; an item may have several in a document."""
    spark = texts.sparkSession
    keys, places = seeds_of(items, n)
    hits = S.written(texts.mapInArrow(_hits(keys), "doc long, seed int, pos int"))
    # As many rows as the items have words, which the caller bounds.
    seeds = F.broadcast(spark.createDataFrame(places))
    candidates = S.written(hits.join(seeds, "seed").groupBy("doc").agg(F.collect_set(F.struct("item", (F.col("pos") - F.col("at")).alias("diagonal"))).alias("found")))
    near = texts.join(F.broadcast(candidates) if S.small(candidates, 64, "found", 24) else candidates, "doc").select("doc", "text", "found")
    aligned = near.mapInArrow(_align(items, min_score), LEAKS)
    names = spark.createDataFrame(pa.table({"item_id": pa.array(range(len(ids)), pa.int64()), "name": pa.array(ids, pa.int64())}))
    return aligned.join(F.broadcast(names), "item_id")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 3, min_score: float = 0.5, part_words: int = 500_000) -> DataFrame:
    """The test items that documents hold, as a copy or edited."""
    texts = docs.select(S.id_of(docs, id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null and text is not null")
    rows = benchmark.select(S.id_of(benchmark, item_col).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item is not null and text is not null").distinct().toArrow()
    items = item_words(rows.column(1).to_pylist())
    some = [(i, x) for i, x in zip(rows.column(0).to_pylist(), items, strict=True) if len(x)]
    if not some:
        return docs.sparkSession.createDataFrame([], LEAKS)
    part = (np.cumsum([len(x) for _, x in some]) - 1) // part_words
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(some)]
    found = reduce(DataFrame.unionByName, (_leaks_of(texts, [i for i, _ in some[a:b]], [x for _, x in some[a:b]], n, min_score) for a, b in zip(edges[:-1], edges[1:], strict=True)))
    best = Window.partitionBy("doc_id", "name").orderBy(F.desc("score"), "first_word", "end_word")
    return found.withColumn("r", F.row_number().over(best)).where("r = 1").select("doc_id", F.col("name").alias("item_id"), "score", "first_word", "end_word")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without those that leaks() names."""
    gone = S.written(leaks(docs, benchmark, id_col, **options).select(F.col("doc_id").alias(id_col)).distinct())
    return S.filter_ids(docs, gone, id_col, "left_anti").select(docs.columns)
