"""n-grams of Arrow batches in numpy: counted, looked up in a vocabulary, weighted. Workers import no more than this."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: n-grams that are looked at together: what numpy holds of a batch at a time.
PART = 1 << 17


def _slices(lists: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The first row and the rows of parts of some PART n-grams; a longer row is a part of its own."""
    ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(lists):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART, "right")))
        yield at, lists.slice(at, to - at)
        at = to


def _coded(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The row and the number of each n-gram of a batch's arrays, and the n-grams by number; nulls are left out."""
    flat, row = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    if flat.null_count:
        row, flat = row[flat.is_valid().to_numpy(zero_copy_only=False)], flat.drop_null()
    coded = flat.dictionary_encode()
    return row, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _sums(lists: pa.Array, pairs: bool) -> list[pa.Table]:
    """gram, tf, df of the arrays; pairs are a table of their own."""
    row, i, names = _coded(lists)
    n = max(len(names), 1)

    def table(row: np.ndarray, code: np.ndarray, gram) -> pa.Table:
        known, at, tf = np.unique(code, return_inverse=True, return_counts=True)
        size = max(len(known), 1)
        return pa.table({"gram": gram(known), "tf": tf, "df": np.bincount(np.unique(row * size + at) % size, minlength=len(known))})

    out = [table(row, i, lambda known: names.take(pa.array(known)))]
    if pairs:
        near = row[1:] == row[:-1]
        out.append(table(row[1:][near], i[:-1][near] * n + i[1:][near], lambda known: pc.binary_join_element_wise(names.take(pa.array(known // n)), names.take(pa.array(known % n)), " ")))
    return out


def counted(batches: Iterator[pa.RecordBatch], pairs: bool, most: int) -> Iterator[pa.RecordBatch]:
    """gram, tf, df of the batches' first column, added up while there are at most so many n-grams."""
    held, n = [], 0

    def summed() -> pa.Table:
        sums = pa.concat_tables(held).group_by("gram", use_threads=False).aggregate([("tf", "sum"), ("df", "sum")])
        return sums.select(["gram", "tf_sum", "df_sum"]).rename_columns(["gram", "tf", "df"])

    for batch in batches:
        for _, lists in _slices(batch.column(0)):
            new = _sums(lists, pairs)
            held, n = held + new, n + sum(map(len, new))
            if n > most:
                held = [summed()]
                n = len(held[0])
                if n > most // 2:
                    yield from held[0].to_batches(100_000)
                    held, n = [], 0
    if held:
        yield from summed().to_batches(100_000)


def weighted(i: np.ndarray, v: np.ndarray, of: np.ndarray, rows: int, idf: np.ndarray, sublinear: bool) -> np.ndarray:
    """The weights of counts v of the terms i in the rows of: tf times idf, of unit length in each row."""
    w = (1 + np.log(v) if sublinear else v) * idf[i]
    norm = np.sqrt(np.bincount(of, w * w, rows))
    return w / np.where(norm, norm, 1)[of]


@dataclass
class Terms:
    """A vocabulary; with pairs, its terms are words and two neighbouring words, joined by a blank."""

    vocabulary: list[str]
    pairs: bool = False

    def lookup(self):
        """A function of a batch's arrays: for the terms that its rows have, the places in the vocabulary, how often, and the rows."""
        parts = [t.split(" ") if self.pairs else [t] for t in self.vocabulary]
        words = pa.array(sorted({w for p in parts for w in p}), pa.string())
        number, size = {w: k for k, w in enumerate(words.to_pylist())}, len(words) + 1
        single = np.full(size, -1)
        for k, p in enumerate(parts):
            if len(p) == 1:
                single[number[p[0]]] = k
        double = sorted((number[p[0]] * size + number[p[1]], k) for k, p in enumerate(parts) if len(p) == 2)
        keys, places = np.array([x for x, _ in double], dtype=np.int64), np.array([k for _, k in double], dtype=np.int64)

        def part(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            row, i, names = _coded(lists)
            # Words of no term have the last number.
            word = pc.index_in(names, words).fill_null(size - 1).to_numpy(zero_copy_only=False).astype(np.int64)[i]
            rows, terms = [row], [single[word]]
            if len(keys):
                near = (row[1:] == row[:-1]) & (word[1:] < size - 1) & (word[:-1] < size - 1)
                key = word[:-1][near] * size + word[1:][near]
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                rows.append(row[1:][near])
                terms.append(np.where(keys[at] == key, places[at], -1))
            row, term = np.concatenate(rows), np.concatenate(terms)
            n = len(self.vocabulary)
            both, v = np.unique(row[term >= 0] * n + term[term >= 0], return_counts=True)
            return both % max(n, 1), v.astype(float), both // max(n, 1)

        def found(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            parts = [(at, part(some)) for at, some in _slices(lists)]
            i, v = (np.concatenate([x[k] for _, x in parts]) if parts else np.array((), dtype=kind) for k, kind in ((0, np.int64), (1, float)))
            return i, v, np.concatenate([at + x[2] for at, x in parts]) if parts else np.array((), dtype=np.int64)

        return found
