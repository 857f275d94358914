"""Operator 9: repeated passages by level-wise doubling.

Finds each run of min_words words (an even number) that stands in two documents or more,
and how long it goes on.

1. Copies of whole texts are found by a 128-bit signature of their words; one of them goes
   on, and all of them are repeated from end to end.
2. Windows of half = min_words / 2 words are hashed. Of each half consecutive windows the
   one of the lowest hash is a sample (winnowing), so every passage of min_words - 1 words
   holds a sample, the same one wherever it stands: about 2 / half of all windows move,
   and none is missed.
3. Samples that stand in two documents are extended to twice their length: the windows of
   min_words that begin up to half words before one. Those that repeat, and whose
   neighbour min_words further repeats too, are joined to windows of twice the length, and
   so on, until no window repeats.

Result of repeated_passages(): doc_id, first_word, end_word (0-based, end excluded) of each
maximal stretch covered by repeated windows, n_words, and longest, the length of the
longest window min_words * 2**k in it that repeats.

Only repeats across documents count: a document that repeats itself isn't listed for it,
nor are rows that repeat an id; the texts of an id that names several are one document's.
Ids are integers; other types raise a TypeError. Nulls, and texts of fewer than min_words words, have no
rows; rows with a null id are left out. Ties need no rule. An empty table gives an empty
result. Columns other than id and text are not read. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm import _shared as S


def winnow(hashes: np.ndarray, run: int) -> np.ndarray:
    """Places of the lowest hash of each run consecutive windows; of all, if fewer."""
    n = len(hashes)
    if n <= run:
        return np.flatnonzero(hashes == hashes.min()) if n else np.zeros(0, np.int64)
    # Lowest of each run from running minima within blocks of run places, forwards and backwards.
    pad = -n % run
    full = np.concatenate([hashes, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, run)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    lowest = np.minimum(back[: n - run + 1], ahead[run - 1 : n])
    # A window is a sample if it is the lowest of one of the runs it is in.
    return np.flatnonzero(hashes == _range_max(lowest, run, n))


def _range_max(lowest: np.ndarray, run: int, n: int) -> np.ndarray:
    """For each of n places the highest of lowest[i - run + 1 .. i]: it equals the place's hash
    exactly where that hash is the lowest of some run."""
    padded = np.concatenate([np.zeros(run - 1, np.uint64), lowest, np.zeros(run - 1, np.uint64)])
    m = len(padded)
    pad = -m % run
    full = np.concatenate([padded, np.zeros(pad, np.uint64)]).reshape(-1, run)
    ahead = np.maximum.accumulate(full, axis=1).ravel()
    back = np.maximum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.maximum(back[:n], ahead[run - 1 : run - 1 + n])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in S.chunks(batches):
        w = S.words(part.column(1))
        marks = []
        doc, place = w.doc(), np.arange(len(w.hashes)).astype(np.uint64)
        local = place - w.first[doc].astype(np.uint64)
        for salt in (np.uint64(3), np.uint64(9)):
            total = np.zeros(len(w.hashes) + 1, dtype=np.uint64)
            np.cumsum(S.mix(w.hashes * (salt + np.uint64(2)) + S.mix(local + salt)), out=total[1:])
            marks.append((total[w.first[1:]] - total[w.first[:-1]]).view(np.int64))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(w.first).astype(np.int32)), *map(pa.array, marks)], names=["doc", "n", "m1", "m2"])


def _samples(half: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in S.chunks(batches):
            w = S.words(part.column(1))
            grams = S.windows(w.hashes, half)
            marks, local, ids = [], [], []
            for d, i in enumerate(part.column(0).to_pylist()):
                a, b = int(w.first[d]), int(w.first[d + 1])
                if b - a < 2 * half:
                    continue
                own = grams[a : b - half + 1]
                at = winnow(own, half)
                marks.append(own[at])
                local.append(at.astype(np.int32))
                ids.append(np.full(len(at), i, np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(marks).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(local))], names=["mark", "doc", "pos"])

    return run


def _doubled(half: int):
    """Windows of 2 * half words that begin up to half words before a sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in S.chunks(batches):
            w = S.words(part.column(1))
            grams = S.windows(w.hashes, 2 * half)
            found = part.column(2)
            for d, i in enumerate(part.column(0).to_pylist()):
                a, n = int(w.first[d]), int(w.first[d + 1] - w.first[d]) - 2 * half + 1
                if n <= 0:
                    continue
                at = np.asarray(found[d].values, dtype=np.int64)
                cover = np.zeros(n + 1, dtype=np.int64)
                np.add.at(cover, np.maximum(np.minimum(at - half, n), 0), 1)
                np.add.at(cover, np.minimum(at + 1, n), -1)
                pos = np.flatnonzero(np.cumsum(cover[:n]) > 0)
                if len(pos):
                    yield pa.RecordBatch.from_arrays([pa.array(grams[a + pos].view(np.int64)), pa.array(np.full(len(pos), i, np.int64)), pa.array(pos.astype(np.int32))], names=["mark", "doc", "pos"])

    return run


def _joined(f):
    return lambda batches: S.together(f(batches))


def _in_two_documents(rows: DataFrame) -> DataFrame:
    """Distinct rows (mark, doc, pos) whose mark stands in two documents or more, as a written table.

    Marks are counted map-side, and rows meet them by a semi-join, which Spark can split: a
    passage that millions of documents share is no task of its own.
    """
    rows = S.written(rows)
    marks = S.written(rows.groupBy("mark").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high").select("mark"))
    out = S.written(S.filter_ids(rows, marks, "mark", "left_semi").distinct())
    S.discard(rows)
    S.discard(marks)
    return out


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """Stretches of min_words words or more that stand in two documents or more."""
    half = min_words // 2
    if min_words != 2 * half or half < 1:
        raise ValueError("min_words is an even number of 2 or more")
    triple = "mark long, doc long, pos int"
    texts = docs.select(S.id_of(docs, id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null and text is not null")
    whole = S.written(texts.mapInArrow(_signatures, "doc long, n int, m1 long, m2 long").where(f"n >= {min_words}"))
    # Counted map-side: thousands of copies are one row of each task.
    known = S.written(whole.groupBy("m1", "m2").agg(F.min("doc").alias("rep"), F.max("doc").alias("other")).where("rep <> other").drop("other"))
    marked = whole.join(F.broadcast(known) if S.small(known, 64) else known, ["m1", "m2"], "left").withColumn("alone", F.coalesce(F.col("doc") == F.col("rep"), F.lit(True)))
    copies = S.written(marked.where("not alone").select("doc").distinct())
    # An id that also names another text goes on with all of them.
    others = S.written(S.filter_ids(marked.where("alone").select("doc"), copies, "doc", "left_semi").distinct())
    single = S.filter_ids(texts, S.written(S.filter_ids(copies, others, "doc", "left_anti")), "doc", "left_anti")
    whole = marked.where("rep is not null")
    samples = _in_two_documents(single.mapInArrow(_joined(_samples(half)), triple))
    seeds = S.written(samples.groupBy("doc").agg(F.collect_set("pos").alias("found")))
    S.discard(samples)
    near = single.join(F.broadcast(seeds) if S.small(seeds, 64, "found", 4) else seeds, "doc").select("doc", "text", "found")
    level = _in_two_documents(near.mapInArrow(_joined(_doubled(half)), triple))
    found, length = level.select("doc", "pos", F.lit(min_words).alias("len")), min_words
    while True:
        on = level.select("doc", (F.col("pos") - length).cast("int").alias("pos"), F.col("mark").alias("next"))
        longer = level.join(on, ["doc", "pos"]).select(F.xxhash64("mark", "next").alias("mark"), "doc", "pos")
        level, length = _in_two_documents(longer), 2 * length
        if level.isEmpty():
            break
        found = found.unionByName(level.select("doc", "pos", F.lit(length).alias("len")))
    # Copies: the whole text, and the longest window that fits it.
    doubled = f"cast({min_words} * pow(2, floor(log2(n / {min_words}D) + 1e-9D)) as int)"
    ends = found.selectExpr("doc", "pos", "pos + len as stop", "len").unionByName(whole.selectExpr("doc", "0 as pos", "n as stop", f"{doubled} as len").distinct())
    began = ends.selectExpr("*", "max(stop) over (partition by doc order by pos, stop rows between unbounded preceding and 1 preceding) as before")
    part = began.selectExpr("*", "sum(case when before >= pos then 0 else 1 end) over (partition by doc order by pos, stop rows unbounded preceding) as part")
    return part.groupBy("doc", "part").agg(F.min("pos").alias("first_word"), F.max("stop").alias("end_word"), F.max("len").alias("longest")).selectExpr("doc as doc_id", "first_word", "end_word", "end_word - first_word as n_words", "longest")
