"""Operator 2: n-gram Jaccard self-join by parity sketches.

A document's set is its distinct word n-grams (a shorter text is one gram). For
J(A, B) >= t the symmetric difference is at most d = (|A| + |B|)(1 - t)/(1 + t).
XOR-ing each gram into a block of a wide bit vector gives a parity sketch: its Hamming
distance never exceeds the symmetric difference. The join has these steps:

1. Equal sets are collapsed by a 128-bit signature, counted map-side; only the lowest id
   goes on.
2. Sets of up to some 60 grams meet by prefix filtering: grams are ordered by how rare they
   are in a count of the short texts (buckets, so ties and errors only cost time), and a
   pair that reaches t shares one of each set's first n - ceil(t n) + 1. This is certain.
   Larger sets fall into size bands of ratio 1/t; each enters its own band and the next,
   so any pair that can reach t meets in a band (the larger one's). Per band the sketch is
   cut into k blocks and pairs meet where a whole block agrees. Grams are first sampled by
   hash; d differences fall into blocks at random, so about k * exp(-d/k) blocks stay
   untouched, of which those with one gram or none aren't used. k is made for the largest
   d and the fewest shared grams of a band (see met), so that all pairs right at t,
   contained ones too, are met with a probability of SURE or more; tests measure it.
3. Where documents meet, 256-bit sketches of the grams of their band are compared: a pair
   whose Hamming distance is too high for d (see most_apart) goes. Documents
   that what is left connects are a group; only edges that span it move on. Keys that very
   many documents share are split to squares of comparisons.
4. The groups' sets are made again from the texts, each moves to where its group is
   compared, and there all pairs of the group are compared. Squares are cut by the work that
   they are, documents * grams, so that no family of copies is one task.

Result: doc_id_a < doc_id_b, jaccard. Documents with equal sets are paired with the lowest
id among them (jaccard 1), and only that one is paired with others, so thousands of
copies give rows in proportion; expand_pairs() gives every pair. Pairs of a family of near
copies still grow with its square: near_classes(), which the query gives, has one row for
each document, with its class and the number of its links, all of them counted.

Ids are integers; other types raise a TypeError. Nulls, empty texts and texts without words
have empty sets and no partner. Rows with a null id are left out; rows that repeat an id and
text count once, and an id is never paired with itself. An id that names several texts is
paired by each of them, once for each partner, with the highest Jaccard of them. Ties need no rule: every pair at or above t is a row. An empty table
gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm import _shared as S

#: Sampled grams of a set at its band's lower edge, the largest set that meets by its prefix, and the least probability that a larger pair meets.
SAMPLE, SMALL, SURE = 96, 60, 0.96
#: Buckets of the count that orders grams, and the longest text (in characters) counted.
BUCKETS, COUNTED = 1 << 18, 2000
SKETCH_WORDS = 4
#: Documents of a key that are compared in one task; of more, the key is split.
MET = 20_000
#: Of one side of a square of comparisons: its grams (8 bytes each), and documents * grams.
GRAMS, WORK = 2_000_000, 1e9


def gram_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes (48 bits) of each text, ascending within it, and their counts."""
    w = S.words(column)
    docs, sizes = len(w.first) - 1, np.diff(w.first)
    grams = S.windows(w.hashes, n)
    doc = w.doc()
    whole = np.arange(len(grams)) + n <= w.first[1:][doc[: len(grams)]]
    parts = [(doc[: len(grams)][whole], grams[whole])]
    for length in range(1, n):
        (short,) = np.nonzero(sizes == length)
        if len(short):
            parts.append((short, S.windows(w.hashes, length)[w.first[short]]))
    owner = np.concatenate([p[0] for p in parts]).astype(np.uint64)
    key = (owner << np.uint64(48)) | (np.concatenate([p[1] for p in parts]) >> np.uint64(16))
    key = np.unique(key)
    counts = np.bincount((key >> np.uint64(48)).astype(np.int64), minlength=docs)
    return key & np.uint64((1 << 48) - 1), counts


def signatures(grams: np.ndarray, sizes: np.ndarray, salt: int) -> np.ndarray:
    """A sum of hashes of each set's grams."""
    total = np.zeros(len(grams) + 1, dtype=np.uint64)
    np.cumsum(S.mix(grams * np.uint64(2 * salt + 1) + np.uint64(salt)), out=total[1:])
    at = np.concatenate([[0], np.cumsum(sizes)])
    return (total[at[1:]] - total[at[:-1]]).view(np.int64)


def met(k: int, shared: float, apart: float) -> float:
    """The probability that two sets with so many shared and differing grams agree in a block of two grams or more."""
    load = shared / k
    return 1 - math.exp(-k * math.exp(-apart / k) * (1 - math.exp(-load) * (1 + load)))


def small_bands(t: float) -> int:
    """The number of bands whose sets meet by prefixes: those that begin at SMALL grams or fewer."""
    return int(math.log(SMALL) / -math.log(t) + 1e-9) + 1


def bands_of(sizes: np.ndarray, t: float) -> np.ndarray:
    return np.floor(np.log(np.maximum(sizes, 1)) / -math.log(t) + 1e-9).astype(np.int64)


@functools.cache
def band_plan(band: int, t: float) -> tuple[int, int]:
    """Sampling modulus and number of blocks of a band: the larger set of a pair has t**-band to t**-(band + 1) grams."""
    low = t**-band
    modulus = max(1, int(low // SAMPLE))
    pairs = []
    for larger in (low, low / t):
        for smaller in (larger, larger * t):
            shared = (larger + smaller) * t / (1 + t)
            pairs.append((shared / modulus, (larger + smaller - 2 * shared) / modulus))
    # Samples vary: two standard deviations more differences and fewer shared grams.
    if modulus > 1:
        pairs += [(max(s - 2 * math.sqrt(s), 1), d + 2 * math.sqrt(d)) for s, d in pairs]
        sure = [SURE] * 4 + [SURE / 2] * 4
    else:
        sure = [SURE] * 4
    k = 8
    while any(met(k, s, d) < p for (s, d), p in zip(pairs, sure, strict=True)) and k < 4 * SAMPLE:
        k += 1
    return modulus, k


def prefix_keys(grams: np.ndarray, owner: np.ndarray, sizes: np.ndarray, t: float, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the rarest grams of each set, as many as a partner must share one of, and their owners."""
    key = S.mix(grams + np.uint64(29))
    order = np.lexsort((key, counts[(key & np.uint64(BUCKETS - 1)).astype(np.int64)], owner))
    at = np.arange(len(grams)) - np.concatenate([[0], np.cumsum(sizes)])[owner]
    first = order[at < (sizes - np.ceil(t * sizes - 1e-9) + 1)[owner]]
    return key[first], owner[first]


def _counted(n: int):
    """(bucket, count) of the grams of some texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for part in S.chunks(batches):
            grams, _ = gram_sets(part.column(0), n)
            total += np.bincount((S.mix(grams + np.uint64(29)) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        (some,) = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "count"])

    return run


def gram_counts(texts: DataFrame, n: int) -> np.ndarray:
    """How often the short texts hold the grams of each bucket."""
    rows = texts.where(F.length("text") <= COUNTED).select("text").mapInArrow(_counted(n), "bucket int, count long").groupBy("bucket").agg(F.sum("count").alias("count")).toArrow()
    out = np.zeros(BUCKETS, np.int32)
    out[rows.column(0).to_numpy()] = np.minimum(rows.column(1).to_numpy(), np.iinfo(np.int32).max)
    return out


def sampled_blocks(grams: np.ndarray, owner: np.ndarray, sizes: np.ndarray, t: float, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each set's own band (step 0) or the next (1): the keys of its sketch's non-empty
    blocks and their owners, and each set's sampled grams and their number by set.

    A block's parity bits are held as the XOR of its grams' hashes: the same for equal bits.
    """
    band = bands_of(sizes, t) + step
    plan = {int(b): band_plan(int(b), t) for b in np.unique(band)}
    modulus = np.array([plan[int(b)][0] for b in band], dtype=np.uint64)
    blocks = np.array([plan[int(b)][1] for b in band], dtype=np.uint64)
    spread = S.mix(grams)
    kept = (spread >> np.uint64(40)) % modulus[owner] == 0
    g, o = spread[kept], owner[kept]
    block = (S.mix(g + np.uint64(77)) >> np.uint64(20)) % blocks[o]
    order = np.lexsort((block, o))
    g, o, block = g[order], o[order], block[order]
    if not len(g):
        return np.zeros(0, np.uint64), o, g, o
    first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (block[1:] != block[:-1])]))
    content = np.bitwise_xor.reduceat(S.mix(g + np.uint64(13)), first)
    count = np.diff(np.append(first, len(g)))
    key = S.mix(content + S.mix(block[first] * np.uint64(1009) + band[o[first]].astype(np.uint64)))
    # A lone gram says little, and phrases that many share would meet in it: met() leaves them out.
    telling = count > 1
    return key[telling], o[first][telling], g, o


def sketches(grams: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """docs x SKETCH_WORDS words of parity bits."""
    width = 64 * SKETCH_WORDS
    bit = (S.mix(grams + np.uint64(5)) >> np.uint64(20)) % np.uint64(width)
    odd = np.bincount(owner * width + bit.astype(np.int64), minlength=docs * width)[: docs * width] & 1
    return np.packbits(odd.astype(np.uint8).reshape(docs, width), axis=1).view(np.uint64)


def most_apart(sizes: np.ndarray, t: float, sampled: bool) -> np.ndarray:
    """The highest Hamming distance of the sketches of two sets of sizes (their sum) that reach t.

    For whole sets the symmetric difference bounds it. For samples two standard deviations
    are added to their difference d, and to the distance that d random bits give.
    """
    d = sizes * ((1 - t) / (1 + t)) + 1e-6
    if not sampled:
        return d
    width = 64 * SKETCH_WORDS
    d = d + 2 * np.sqrt(d)
    return width / 2 * (1 - np.exp(-2 * d / width)) + np.sqrt(width * (1 - np.exp(-4 * d / width)))


def _profile(n: int, t: float, counts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in S.chunks(batches):
            grams, sizes = gram_sets(part.column(1), n)
            docs = len(sizes)
            owner = np.repeat(np.arange(docs), sizes)
            marks = [signatures(grams, sizes, salt) for salt in (1, 2)]
            columns = []
            for step in (0, 1):
                small = bands_of(sizes, t) + step < small_bands(t)
                own = small[owner]
                keys, of, sample, by = sampled_blocks(grams[~own], owner[~own], sizes, t, step)
                if step == 0:
                    rare, has = prefix_keys(grams[own], owner[own], np.where(small, sizes, 0), t, counts)
                    of = np.concatenate([of, has])
                    order = np.argsort(of, kind="stable")
                    keys, of = np.concatenate([keys, rare])[order], of[order]
                    sample, by = np.concatenate([sample, S.mix(grams[own])]), np.concatenate([by, owner[own]])
                number = np.bincount(by, minlength=docs)
                # Exact sets carry their size below zero: their bound needs no deviations.
                number = np.where(number == sizes, -number, number).astype(np.int32)
                columns += [S.lists(keys.view(np.int64), np.bincount(of, minlength=docs), pa.int64()), pa.array(number), S.blobs(sketches(sample, by, docs).ravel(), np.full(docs, SKETCH_WORDS))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes.astype(np.int32)), *map(pa.array, marks), *columns], names=["doc", "n", "m1", "m2", "keys0", "k0", "s0", "keys1", "k1", "s1"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch | int]:
    """The rows of a partition sorted by its first column, in batches that end where a value of it ends.

    A value of more than most rows is yielded itself, in place of its rows, which aren't held.
    """
    held: list[pa.RecordBatch] = []
    count, hot = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column(0).to_numpy(zero_copy_only=False)
        if hot is not None:
            skip = int(np.searchsorted(block, hot, side="right"))
            if skip == len(block):
                continue
            batch, block, hot = batch.slice(skip), block[skip:], None
        if held and held[0].column(0)[0].as_py() != block[0]:
            yield from held if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()
            held, count = [], 0
        last = int(np.searchsorted(block, block[-1]))
        if last:
            yield from pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches()
            held, count = [], 0
        held.append(batch.slice(last))
        count += batch.num_rows - last
        if most is not None and count > most:
            hot = int(block[-1])
            yield hot
            held, count = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _linked(t: float, most: int | None):
    """Edges (u, v) that connect what is likely similar among the documents of each block.

    Rows are (block, side, doc, k, s); side 0 and 1: only pairs across, 2: all pairs. A block
    of more than most rows gives a row (null, null, block) instead.
    """
    kinds = (pa.int64(), pa.int64(), pa.int64())

    def near(size: np.ndarray, exact: np.ndarray, bits: np.ndarray, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1)
        both = size[j] + size[i]
        return apart <= np.where(exact[j] & exact[i], most_apart(both, t, False), most_apart(both, t, True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, most):
            if isinstance(rows, int):
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((None, None, rows), kinds, strict=True)], names=["u", "v", "hot"])
                continue
            block, side, doc, k = (rows.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            edges = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
            count = np.diff(edges)
            if count.max() < 2:
                continue
            size, exact = np.abs(k).astype(np.int64), k < 0
            bits = S.flat(rows.column(4), np.uint64).reshape(-1, SKETCH_WORDS)
            # Blocks of two documents all at once; of more, one after the other.
            i = edges[:-1][count == 2]
            i = i[(side[i] == 2) | (side[i] != side[i + 1])]
            i = i[near(size, exact, bits, i, i + 1)]
            us, vs = [i], [i + 1]
            for a, b in zip(edges[:-1][count > 2], edges[1:][count > 2], strict=True):
                todo, left = [], np.arange(a, b)
                while len(left):
                    if not todo:
                        todo, left = [left[0]], left[1:]
                    x = todo.pop()
                    met = left if side[x] == 2 else left[side[left] != side[x]]
                    met = met[near(size, exact, bits, x, met)]
                    if len(met):
                        us.append(np.full(len(met), x))
                        vs.append(met)
                        todo += met.tolist()
                        left = np.setdiff1d(left, met, assume_unique=True)
            u, v = doc[np.concatenate(us)], doc[np.concatenate(vs)]
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64())], names=["u", "v", "hot"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in S.chunks(batches):
            grams, sizes = gram_sets(part.column(1), n)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(signatures(grams, sizes, 1)), S.blobs(grams, sizes)], names=["doc", "mark", "grams"])

    return run


def similar_pairs(grams: np.ndarray, sizes: np.ndarray, side: np.ndarray, t: float, spanning: bool, found: Callable[[int, np.ndarray], None] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of two sets whose Jaccard similarity is t or more, and it; grams are flat, sizes their numbers.

    The grams of one set are marked, and those of all sets of a size that can reach t are
    looked up at once. spanning: only pairs that connect what isn't connected by others.
    found: gets a place and all its partners (each pair once) in place of the result, which isn't held.
    """
    order = np.lexsort((sizes, side))
    first = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.unique(grams, return_inverse=True)[1]
    size = sizes[order]
    at = np.concatenate([[0], np.cumsum(size)])
    flat = np.concatenate([flat[first[i] : first[i + 1]] for i in order]) if len(order) else flat
    marks = np.zeros(int(flat.max()) + 1 if len(flat) else 1, dtype=np.uint8)
    cut = int(np.searchsorted(side[order], 1)) if len(side) and side.max() < 2 else -1
    us, vs, js = [], [], []

    def partners(i: int, after: bool) -> tuple[np.ndarray, np.ndarray]:
        """Those that reach t with i, and how similar they are."""
        a, b = (0, len(size)) if cut < 0 else (cut, len(size)) if i < cut else (0, cut)
        low, high = np.searchsorted(size[a:b], [size[i] * t - 1e-6, size[i] / t + 1e-6]) + a
        if after:
            low = max(low, i + 1)
        if low >= high:
            return np.zeros(0, np.int64), np.zeros(0)
        own = flat[at[i] : at[i + 1]]
        marks[own] = 1
        shared = np.add.reduceat(marks[flat[at[low] : at[high]]], at[low:high] - at[low], dtype=np.int64)
        marks[own] = 0
        similar = shared / (size[low:high] + size[i] - shared)
        good = np.flatnonzero(similar >= t)
        return good + low, similar[good]

    if not spanning:
        for i in range(len(size) if cut < 0 else cut):
            j, similar = partners(i, cut < 0)
            if found is not None:
                found(int(order[i]), order[j])
                continue
            us.append(np.full(len(j), i))
            vs.append(j)
            js.append(similar)
    else:
        free, todo, n = np.ones(len(size), dtype=bool), [], 0
        while True:
            if not todo:
                n += int(np.argmax(free[n:])) if n < len(free) else 0
                if n >= len(free) or not free[n]:
                    break
                todo.append(n)
                free[n] = False
            if not free.any():
                break
            i = todo.pop()
            j, similar = partners(i, False)
            new = free[j]
            j, similar = j[new], similar[new]
            free[j] = False
            todo += j.tolist()
            us.append(np.full(len(j), i))
            vs.append(j)
            js.append(similar)
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return order[np.concatenate(us).astype(np.int64)], order[np.concatenate(vs).astype(np.int64)], np.concatenate(js)


def _compare(t: float, spanning: bool):
    """Pairs of each block (block, side, doc, grams); side 0 and 1: only pairs across, 2: all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            block, side, doc = (rows.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            sizes = pc.binary_length(rows.column(3)).to_numpy(zero_copy_only=False).astype(np.int64) // 8
            first = np.concatenate([[0], np.cumsum(sizes)])
            grams = S.flat(rows.column(3), np.uint64)
            edges = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a > 1:
                    i, j, similar = similar_pairs(grams[first[a] : first[b]], sizes[a:b], side[a:b], t, spanning)
                    x, y = doc[a + i], doc[a + j]
                    good = x != y
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[good]), pa.array(np.maximum(x, y)[good]), pa.array(similar[good])], names=["doc_id_a", "doc_id_b", "jaccard"])

    return lambda batches: S.together(run(batches))


def _links(t: float):
    """Of each block (block, side, doc, mark, grams) the links that each set has in it (doc, mark, links), and those
    that connect what isn't connected by others (doc, other): rows as many as sets, not as pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            block, side, doc, mark = (rows.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            sizes = pc.binary_length(rows.column(4)).to_numpy(zero_copy_only=False).astype(np.int64) // 8
            first = np.concatenate([[0], np.cumsum(sizes)])
            grams = S.flat(rows.column(4), np.uint64)
            edges = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a < 2:
                    continue
                links, part, us, vs = np.zeros(b - a, np.int64), np.arange(b - a), [], []

                def found(i: int, j: np.ndarray, links=links, part=part, us=us, vs=vs) -> None:
                    links[i] += len(j)
                    links[j] += 1
                    other, at = np.unique(part[j], return_index=True)
                    new = other != part[i]
                    if new.any():
                        us.append(np.full(int(new.sum()), i))
                        vs.append(j[at[new]])
                        part[np.isin(part, other[new])] = part[i]

                similar_pairs(grams[first[a] : first[b]], sizes[a:b], side[a:b], t, False, found)
                (has,) = np.nonzero(links)
                u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
                nulls = lambda n: pa.nulls(n, pa.int64())
                columns = [np.concatenate([doc[a + has], doc[a + u]]), [pa.array(mark[a + has]), nulls(len(u))], [pa.array(links[has]), nulls(len(u))], [nulls(len(has)), pa.array(doc[a + v])]]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), *(pa.concat_arrays(x) for x in columns[1:])], names=["doc", "mark", "links", "other"])

    return lambda batches: S.together(run(batches))


def _squares(rows: DataFrame, key: str, parts: DataFrame) -> DataFrame:
    """rows (with key) once for each square of blocks that they are in: block and side instead of key.

    parts: key, parts. The documents of a key fall into so many parts, each of which meets
    itself (side 2) and each other (sides 0 and 1), so that every pair meets exactly once.
    """
    split = rows.join(parts, key).withColumn("c", F.expr("cast(pmod(xxhash64(doc), parts) as int)"))
    split = split.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.expr("case when c = o then 2 when c < o then 0 else 1 end")
    return split.select(F.xxhash64(key, F.least("c", "o"), F.greatest("c", "o")).alias("block"), side.alias("side"), *(c for c in rows.columns if c != key))


def _met(docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The profiles (doc, n, m1, m2, ...) with rep, the lowest id of an equal set; and the sets of those that are likely
    similar, in blocks where each pair meets once (block, side, doc, mark, marks, grams). marks are the m1 of the sets
    that doc goes on with."""
    texts = docs.select(S.id_of(docs, id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null and text is not null")
    counts = gram_counts(texts, n)
    bands = ", ".join(f"keys{i} array<long>, k{i} int, s{i} binary" for i in (0, 1))
    profiles = S.written(texts.mapInArrow(_profile(n, threshold, counts), f"doc long, n int, m1 long, m2 long, {bands}").where("n > 0"))
    # Copies are counted map-side, so that thousands of them are a row of each task, and wide rows don't move.
    copies = S.written(profiles.groupBy("m1", "m2").agg(F.min("doc").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"))
    marked = profiles.join(F.broadcast(copies) if S.small(copies, 64) else copies, ["m1", "m2"], "left").withColumn("rep", F.coalesce("rep", "doc"))
    alone = marked.where("doc = rep")
    # One shuffle of (key, id, sketch). Where documents meet, their sketches are compared at
    # once, and only edges that connect likely pairs go on: as many as documents at most.
    keyed = alone.select(F.explode("keys0").alias("block"), "doc", F.col("k0").alias("k"), F.col("s0").alias("s")).unionByName(alone.select(F.explode("keys1").alias("block"), "doc", F.col("k1").alias("k"), F.col("s1").alias("s")))
    link = lambda rows, most: rows.select("block", "side", "doc", "k", "s").repartition("block").sortWithinPartitions("block").mapInArrow(_linked(threshold, most), "u long, v long, hot long")
    edges = S.written(link(keyed.withColumn("side", F.lit(2)), MET))
    hot = S.written(edges.where("hot is not null").select(F.col("hot").alias("block")))
    if not hot.isEmpty():
        # Keys that more than MET documents share are split to squares.
        many = S.written(S.filter_ids(keyed, hot, "block", "left_semi"))
        parts = many.groupBy("block").agg(F.ceil(F.count("*") / (MET // 2)).cast("int").alias("parts"))
        edges = edges.where("hot is null").unionByName(link(_squares(many, "block", parts), None))
    group = components(edges, "u", "v")
    # A group is compared in squares of some WORK: a set moves once for each square it is in,
    # not once for each pair.
    group = S.written(group.join(alone.groupBy("doc").agg(F.max("n").alias("n"), F.collect_set("m1").alias("marks")), "doc"))
    grams = F.sum(F.col("n").cast("double"))
    parts = group.groupBy("root").agg(F.greatest(F.ceil(grams / GRAMS), F.ceil(F.sqrt(F.count("*") * grams / WORK))).cast("int").alias("parts"))
    squares = S.written(_squares(group.select("doc", "marks", "root"), "root", parts))
    sets = S.filter_ids(texts, group.select("doc"), "doc", "left_semi").mapInArrow(_sets(n), "doc long, mark long, grams binary")
    sets = sets.repartition("doc").dropDuplicates(["doc", "mark"])
    return marked, sets.join(squares, "doc")


def near_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 2, threshold: float = 0.55, spanning: bool = False) -> DataFrame:
    """Pairs of documents whose n-gram sets have a Jaccard similarity of threshold or more.

    spanning: only as many pairs as connect what is connected.
    """
    marked, blocks = _met(docs, id_col, text_col, n, threshold)
    equal = marked.where("doc <> rep").select(F.col("rep").alias("doc_id_a"), F.col("doc").alias("doc_id_b"), F.lit(1.0).alias("jaccard"))
    near = blocks.select("block", "side", "doc", "grams").repartition("block").sortWithinPartitions("block").mapInArrow(_compare(threshold, spanning), "doc_id_a long, doc_id_b long, jaccard double")
    # Texts of the same id may give a pair more than once.
    return near.unionByName(equal).groupBy("doc_id_a", "doc_id_b").agg(F.max("jaccard").alias("jaccard"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 2, threshold: float = 0.55) -> DataFrame:
    """doc_id, class_id and n_links of each id: a row for each, whatever the size of a family of near copies.

    Texts are linked if the Jaccard similarity of their n-gram sets is threshold or more. class_id is the lowest id that
    links, and copies, lead to. n_links is the number of other sets that the document's is linked to, each counted once
    however many documents have it; of an id that names several texts it is the sum over their sets. Ids without words
    are classes of their own, without links; rows with a null id are left out.
    """
    marked, blocks = _met(docs, id_col, text_col, n, threshold)
    own = blocks.where("array_contains(marks, mark)").select("block", "side", "doc", "mark", "grams")
    met = S.written(own.repartition("block").sortWithinPartitions("block").mapInArrow(_links(threshold), "doc long, mark long, links long, other long"))
    edges = met.where("other is not null").select(F.col("doc").alias("a"), F.col("other").alias("b")).unionByName(marked.where("doc <> rep").select(F.col("rep").alias("a"), F.col("doc").alias("b")))
    classes = components(edges, "a", "b")
    links = met.where("other is null").groupBy(F.col("doc").alias("rep"), F.col("mark").alias("m1")).agg(F.sum("links").alias("links"))
    links = marked.select("doc", "rep", "m1").distinct().join(links, ["rep", "m1"]).groupBy("doc").agg(F.sum("links").alias("links"))
    ids = docs.select(S.id_of(docs, id_col).alias("doc")).where("doc is not null").distinct()
    return ids.join(classes, "doc", "left").join(links, "doc", "left").select(F.col("doc").alias("doc_id"), F.coalesce("root", "doc").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"))


def expand_pairs(pairs: DataFrame) -> DataFrame:
    """Every pair of near_pairs(), those between copies too; grows with the square of a group of copies."""
    copies = pairs.where("jaccard = 1").selectExpr("doc_id_a as rep", "doc_id_b as doc")
    reps = pairs.selectExpr("explode(array(doc_id_a, doc_id_b)) as rep").distinct().join(copies.selectExpr("doc as rep"), "rep", "left_anti")
    members = copies.unionByName(reps.selectExpr("rep", "rep as doc"))
    across = pairs.join(copies.selectExpr("doc as doc_id_b"), "doc_id_b", "left_anti")
    x = members.selectExpr("rep as doc_id_a", "doc as x")
    y = members.selectExpr("rep as doc_id_b", "doc as y")
    across = across.join(x, "doc_id_a").join(y, "doc_id_b").selectExpr("least(x, y) as doc_id_a", "greatest(x, y) as doc_id_b", "jaccard")
    within = members.alias("l").join(members.alias("r"), "rep").where("l.doc < r.doc").selectExpr("l.doc as doc_id_a", "r.doc as doc_id_b", "1D as jaccard")
    return across.unionByName(within)


def components(pairs: DataFrame, a: str = "doc_id_a", b: str = "doc_id_b") -> DataFrame:
    """(doc, root): each document of a pair with the lowest id of its group.

    Large-star and small-star steps by turns until nothing changes; each round is a written table.
    """
    edges = S.written(pairs.selectExpr(f"greatest({a}, {b}) as u", f"least({a}, {b}) as v").where("u <> v").distinct())
    while True:
        around = edges.unionByName(edges.selectExpr("v as u", "u as v"))
        low = around.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        large = around.join(low, "u").where("v > u").selectExpr("v as u", "m as v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("explode(array(struct(v as u, m as v), struct(u as u, m as v))) as e").select("e.*").where("u <> v").distinct()
        small = S.written(small)
        before, after = (x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (edges, small))
        S.discard(edges)
        edges = small
        if tuple(before) == tuple(after):
            return edges.select(F.col("u").alias("doc"), F.col("v").alias("root")).unionByName(edges.selectExpr("v as doc", "v as root").distinct())


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 2, threshold: float = 0.55) -> DataFrame:
    """docs without those that have a near copy of lower id in their group; rows with a null id stay."""
    gone = components(near_pairs(docs, id_col, text_col, n, threshold, spanning=True)).where("doc <> root").select(F.col("doc").alias(id_col))
    return S.filter_ids(docs, S.written(gone.distinct()), id_col, "left_anti").select(docs.columns)
