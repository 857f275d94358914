"""Operator 3: language identification with hyperdimensional profiles.

Each letter (code point) has a random vector of +1 and -1 of its own (dim entries, made of
hashes). A letter n-gram is the product of its letters' vectors, the i-th rotated by i
places; a text's profile is the sum of its n-grams' vectors, and a language's prototype the
sum of the unit profiles of sample texts. A text gets the language whose prototype has the
highest cosine; ties go to the language that comes first in the alphabet.

Letters are lower-cased; anything that isn't a letter is one blank, and each text begins and
ends with a blank. Whole texts are read.

fit() reads at most per_language labelled texts of each language, those of the lowest hashed
id (the documented bound of the sample; it needs no label elsewhere).

Result of identify(): doc_id, pred_lang, cosine, margin (to the second language, or the
cosine itself if there is only one), accepted. A text without letters, or null, has
pred_lang null, cosine and margin 0, and isn't accepted. A text is accepted if its cosine
reaches min_cosine, or a smaller one (by the square root of the share) for fewer than
full_ngrams n-grams: short texts have low cosines even in their language. Texts of fewer
than min_ngrams n-grams can't be judged and are accepted. Ids are integers in identify() (other
types raise a TypeError) and of any type in fit() and keep_identified(). Rows with a null id
are kept; repeated rows give repeated rows; columns other than those named aren't read.
Without any labelled text every text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeframe.llm import _shared as S

DOCS_AT_ONCE = 256
#: Entries of the counts and bound vectors that are held at once (4 bytes each).
HELD = 1 << 22
#: Up to so many possible n-grams are counted in a table, more are sorted.
TABLE = 1 << 20
BLANK = 32


def _letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


_cache: dict[object, np.ndarray] = {}


def letters(points: np.ndarray, dim: int, n: int, seed: int) -> np.ndarray:
    """n x len(points) x dim: each code point's own vector of +1 and -1, rotated by 0..n-1 places.

    The signs are the bits of hashes of (seed, code point, word), so that every code point
    has an independent vector and every worker makes the same ones. dim is a multiple of 64.
    """
    word = np.arange(dim // 64, dtype=np.uint64)
    key = S.mix(points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + S.mix(word + np.uint64(seed * 1_000_003 + 1))[None, :])
    base = np.unpackbits(S.mix(key).view(np.uint8), axis=1, bitorder="little").astype(np.float32) * 2 - 1
    return np.stack([np.roll(base, i, axis=1) for i in range(n)])


def gram_ids(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-grams of all texts as numbers in base len(points), each text's count of them, and the code points that occur.

    points[0] is the blank; digit d of a number stands for points[d].
    """
    if "letters" not in _cache:
        _cache["letters"] = _letter_table()
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    sizes = pc.utf8_length(lower).to_numpy(zero_copy_only=False)
    code = np.frombuffer("".join(lower.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    far = code >= 1 << 16
    keep = _cache["letters"][np.minimum(code, (1 << 16) - 1)]
    if far.any():
        keep = np.where(far, [chr(c).isalpha() if c >= 1 << 16 else False for c in code.tolist()], keep)
    masked = np.where(keep, code, np.uint32(BLANK))
    if far.any():
        points, slot = np.unique(masked, return_inverse=True)
    else:
        there = np.zeros(1 << 16, dtype=bool)
        there[masked] = True
        points = np.flatnonzero(there).astype(np.uint32)
        slot = (np.cumsum(there) - 1)[masked]
    if not len(points) or points[0] != BLANK:
        points, slot = np.concatenate([np.array([BLANK], code.dtype), points]), slot + 1
    doc = np.repeat(np.arange(len(sizes)), sizes)
    new_doc = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    # A blank stays if the letter run before it ended there; each text's first place is a blank.
    before = np.concatenate([[False], keep[:-1]])[: len(keep)] & ~new_doc
    keep = keep | before
    slot, doc = slot[keep], doc[keep]
    counts = np.bincount(doc, minlength=len(sizes))
    first = np.concatenate([[0], np.cumsum(counts)])
    at = first[:-1] + 2 * np.arange(len(sizes))
    padded = np.zeros(len(slot) + 2 * len(sizes), dtype=np.int64)
    place = np.arange(len(slot)) + 1 + 2 * doc
    padded[place] = slot
    # Letters, then a closing blank unless one is there already.
    length = np.where(counts > 0, counts + 1, 0)
    last = at + length
    closed = (counts > 0) & (padded[np.minimum(last - (counts > 0), len(padded) - 1)] == 0) if len(padded) else counts > 0
    length = length + np.where(closed, 0, 1) * (counts > 0)
    grams = np.maximum(length - n + 1, 0)
    starts = np.repeat(at - np.concatenate([[0], np.cumsum(grams)[:-1]]), grams) + np.arange(grams.sum())
    ids = np.zeros(len(starts), dtype=np.int64)
    for i in range(n):
        ids = ids * len(points) + padded[starts + i]
    return ids, grams, points


def profiles(texts: pa.Array, dim: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts' profiles (not normalised), and their numbers of n-grams.

    The distinct n-grams are bound some at a time, so that memory doesn't grow with their number.
    """
    ids, grams, points = gram_ids(texts, n)
    vectors = letters(points, dim, n, seed)
    doc = np.repeat(np.arange(len(grams)), grams)
    if len(points) ** n <= TABLE:
        used = np.flatnonzero(np.bincount(ids, minlength=1)) if len(ids) else ids
        number = np.zeros(len(points) ** n, dtype=np.int64)
        number[used] = np.arange(len(used))
        place = number[ids]
    else:
        used, place = np.unique(ids, return_inverse=True)
    out = np.zeros((len(grams), dim), dtype=np.float32)
    step = max(1, HELD // max(dim, len(grams)))
    if len(used) > step:
        order = np.argsort(place, kind="stable")
        doc, place = doc[order], place[order]
    for a in range(0, len(used), step):
        some = used[a : a + step]
        bound = np.ones((len(some), dim), dtype=np.float32)
        for i in range(n):
            bound *= vectors[i][(some // len(points) ** (n - 1 - i)) % len(points)]
        x, y = (0, len(place)) if len(used) <= step else np.searchsorted(place, [a, a + len(some)])
        counts = np.bincount(doc[x:y] * len(some) + place[x:y] - a, minlength=len(grams) * len(some)).astype(np.float32)
        out += counts.reshape(len(grams), len(some)) @ bound
    return out, grams


def _groups(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for part in S.chunks(batches, text):
        for at in range(0, part.num_rows, DOCS_AT_ONCE):
            yield part.slice(at, DOCS_AT_ONCE)


def _bundles(dim: int, n: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for part in _groups(batches, "text"):
            found, _ = profiles(part.column(1), dim, n, seed)
            norm = np.linalg.norm(found, axis=1, keepdims=True)
            unit = found / np.maximum(norm, 1e-9)
            for k, lang in enumerate(part.column(0).to_pylist()):
                sums[lang] = sums.get(lang, 0) + unit[k].astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], names=["lang", "bundle"])

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, dim: int = 1024, n: int = 3, seed: int = 7) -> dict[str, np.ndarray]:
    """Language prototypes of unit length, from at most per_language texts of each label."""
    named = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and text is not null and lang is not null")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    # Ranks narrow rows; a limit on the rank is applied before the shuffle too.
    chosen = named.select("id", "lang").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).select("id", "lang")
    sample = named.join(F.broadcast(S.written(chosen)), ["id", "lang"]).select("lang", "text").distinct()
    sums: dict[str, np.ndarray] = {}
    # The sample is bounded, and moved to a few tasks; the scan before it keeps its parallelism.
    for row in sample.repartition(8).mapInArrow(_bundles(dim, n, seed), "lang string, bundle array<double>").collect():
        sums[row.lang] = sums.get(row.lang, 0) + np.array(row.bundle)
    return {k: (v / (np.linalg.norm(v) or 1)).astype(np.float32) for k, v in sorted(sums.items())}


def _identify(prototypes: dict[str, np.ndarray], dim: int, n: int, seed: int, min_cosine: float, full_ngrams: int, min_ngrams: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*prototypes, ""], dtype=object)
        matrix = np.stack(list(prototypes.values())) if prototypes else np.zeros((0, dim), np.float32)
        for part in _groups(batches, "text"):
            found, grams = profiles(part.column(1), dim, n, seed)
            cosine = (found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)) @ matrix.T
            rows = np.arange(len(grams))
            if len(names) > 1:
                best = cosine.argmax(axis=1)
                top = cosine[rows, best].astype(np.float64)
                rest = cosine.copy()
                rest[rows, best] = -2
                margin = top - np.where(len(names) > 2, rest.max(axis=1), 0)
            else:
                best, top, margin = np.zeros(len(grams), int), np.zeros(len(grams)), np.zeros(len(grams))
            known = (grams > 0) & (len(names) > 1)
            need = min_cosine * np.minimum(1, np.sqrt(grams / full_ngrams))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.where(known, names[best], None), pa.string()), pa.array(np.where(known, np.round(top, 6), 0.0)), pa.array(np.where(known, np.round(margin, 6), 0.0)), pa.array(known & ((top >= need) | (grams < min_ngrams)))],
                names=["doc_id", "pred_lang", "cosine", "margin", "accepted"],
            )

    return run


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", dim: int = 1024, n: int = 3, seed: int = 7, min_cosine: float = 0.2, full_ngrams: int = 200, min_ngrams: int = 20) -> DataFrame:
    """The language of each document."""
    texts = docs.select(S.id_of(docs, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_identify(prototypes, dim, n, seed, min_cosine, full_ngrams, min_ngrams), "doc_id long, pred_lang string, cosine double, margin double, accepted boolean")


def keep_identified(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", **options) -> DataFrame:
    """docs whose text is accepted, all columns kept. One pass: the text is judged where it is read."""
    dim, n, seed, low, full, few = (options.get(k, v) for k, v in (("dim", 1024), ("n", 3), ("seed", 7), ("min_cosine", 0.2), ("full_ngrams", 200), ("min_ngrams", 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _identify(prototypes, dim, n, seed, low, full, few)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            pair = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), text], names=["id", "text"])
            verdicts = [x.column(4) for x in judge(iter([pair]))]
            yield batch.filter(pa.concat_arrays(verdicts)) if verdicts else batch

    return docs.mapInArrow(run, docs.schema)
