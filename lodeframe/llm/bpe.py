"""Operator 4: BPE encoding and decoding with a given vocabulary.

A text is cut into pieces by the vocabulary's pattern. A piece's bytes are a doubly linked
list of symbols; a priority queue holds each adjacent pair that the vocabulary can merge,
lowest rank first and the leftmost of equals. A popped entry is skipped as stale if one of
its symbols has been merged since. That is how long pieces are merged; the others are merged
side by side with numpy by the same rule (Pairs). A worker cuts a megabyte of text at
once, by the kinds of their characters (Cutter), and keeps the tokens of the pieces that it
has met, up to a bound. Decoding concatenates the tokens' byte strings.

The vocabulary is a file of lines "base64(token) rank" (path is a parameter; it is never
trained or copied here). Every byte is a token of it, so any text can be encoded; special
tokens' strings are ordinary text. The ids are those of other encoders of that vocabulary.

Result of encode(): doc_id, n_tokens, token_ids and, with verify, round_trip (decoding gives
the text's bytes again). A null text has null in all three; an empty text has no tokens.
Document ids are integers; other types raise a TypeError. Rows with a null id and repeated
rows stay as they are. An empty table gives an empty result. Columns other than id and text
aren't read. decode() is the inverse; token ids that the vocabulary lacks, and null ones,
make the text null, bytes that aren't UTF-8 become U+FFFD.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm import _shared as S

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the public byte-level vocabularies cut texts into pieces.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text that are encoded at once.
ENCODED = 1 << 20
#: Distinct pieces whose tokens a worker keeps; beyond that it begins anew.
KEPT = 1 << 18
#: Pieces that are merged at once, and the bytes of the longest of them; longer ones are merged one by one.
ROWS, WIDEST = 8192, 64
_NONE = np.iinfo(np.int32).max
#: Kinds of characters: others than these (0), white space, letters, digits, and the mark behind each text.
_SPACE, _LETTER, _DIGIT, _END = 1, 2, 3, 4


def load_vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The tokens of one piece.

    A queue entry is one number: rank, left symbol's begin, bytes of both symbols.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get = len(piece), ranks.get
    bits = 20 if n < 1 << 20 else 40
    low = (1 << bits) - 1
    # A symbol is named by its first byte; end[i] is where it ends and the next begins, 0 once merged away.
    end, before = list(range(1, n + 1)), list(range(-1, n))
    queue = [(rank << bits | i) << bits | 2 for i in range(n - 1) if (rank := get(piece[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        entry = heapq.heappop(queue)
        i, length = entry >> bits & low, entry & low
        j = end[i]
        if not j or j >= n or end[j] - i != length:
            continue  # stale: one of the two has been merged since
        stop = end[i] = end[j]
        end[j] = 0
        before[stop] = i
        if stop < n and (rank := get(piece[i : end[stop]])) is not None:
            heapq.heappush(queue, (rank << bits | i) << bits | end[stop] - i)
        h = before[i]
        if h >= 0 and (rank := get(piece[h:stop])) is not None:
            heapq.heappush(queue, (rank << bits | h) << bits | stop - h)
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return out


class Pairs:
    """Merges of many short pieces at once, by the rule of merge()."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        get, left, right, both = ranks.get, [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = get(token[:i]), get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    both.append(rank)
        key = self._key(np.array(left, np.int64), np.array(right, np.int64))
        # A hash table: a pair lies in its slot or, if others were there before, in one behind it.
        self.mask = (1 << max(4, int(4 * len(key)).bit_length())) - 1
        self.keys, self.ranks = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, _NONE, np.int32)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]] = key[free]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = slot[todo] + 1 & self.mask
        self.ranks[slot] = both

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a << 32 | b

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (S.mix(key.view(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, _NONE if there is none; -1 is no symbol."""
        key = self._key(a.astype(np.int64), b.astype(np.int64))
        key[(a < 0) | (b < 0)] = -2
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], _NONE)
        (more,) = np.nonzero((found != key) & (found != -1) & (key != -2))
        while len(more):
            slot[more] = slot[more] + 1 & self.mask
            found = self.keys[slot[more]]
            same = found == key[more]
            out[more[same]] = self.ranks[slot[more[same]]]
            more = more[~same & (found != -1)]
        return out

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tokens of some pieces, of two bytes or more each: which piece, their number, and
        the tokens of all in that order.

        Pieces have a row of symbols each, and every round merges one pair in each row, so that
        all rows are one symbol shorter; those without a pair are ready.
        """
        rows, which, count, flat = np.arange(len(pieces)), [], [], []
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        inside = np.arange(sizes.max()) < sizes[:, None]
        symbols = np.full(inside.shape, -1, np.int32)
        symbols[inside] = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(pieces), -1)
        while len(rows):
            each, n = np.arange(len(rows)), symbols.shape[1]
            at = ranks.argmin(axis=1) if n > 1 else np.zeros(len(rows), np.int64)
            low = ranks[each, at] if n > 1 else np.full(len(rows), _NONE)
            if (low == _NONE).any():
                ready, go = symbols[low == _NONE], low != _NONE
                which.append(rows[~go])
                count.append((ready >= 0).sum(axis=1))
                flat.append(ready[ready >= 0])
                rows, symbols, ranks, at, low = rows[go], symbols[go], ranks[go], at[go], low[go]
                each = each[: len(rows)]
                if not len(rows):
                    break
            symbols[each, at] = low
            stay = np.arange(n) != at[:, None] + 1
            symbols, ranks = symbols[stay].reshape(-1, n - 1), ranks[stay[:, 1:]].reshape(-1, n - 2)
            for has, left in ((at > 0, at - 1), (at < n - 2, at)):
                i, j = each[has], left[has]
                ranks[i, j] = self.rank(symbols[i, j], symbols[i, j + 1])
        return np.concatenate(which), np.concatenate(count), np.concatenate(flat)


def _gathered(flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists that which names, one after the other, and their sizes; flat holds all lists, begin where each begins."""
    size = sizes[which]
    at = np.repeat(begin[which] - (np.cumsum(size) - size), size)
    at += np.arange(len(at))
    return flat[at], size


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each list's values; counts are the lists' lengths."""
    total = np.concatenate([[0], np.cumsum(values)])
    at = np.concatenate([[0], np.cumsum(counts)])
    return total[at[1:]] - total[at[:-1]]


def _array(values: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """Truth values or 32-bit numbers as an Arrow array; pa.array(), to_numpy() and to_pandas_dtype() import pandas, 23 MB in each worker."""
    bits = lambda x: pa.py_buffer(np.packbits(x, bitorder="little"))
    kind, data = (pa.bool_(), bits(values)) if values.dtype == bool else (pa.int32(), pa.py_buffer(np.ascontiguousarray(values, np.int32)))
    return pa.Array.from_buffers(kind, len(values), [None if null is None else bits(~null), data])


class Cutter:
    """Cuts texts into the pieces that PATTERN finds, all texts at once."""

    def __init__(self):
        points = np.arange(0x110000, dtype="<u4")
        points[0xD800:0xE000] = 0
        points = points.tobytes().decode("utf-32-le")
        self.kinds = np.zeros(len(points), np.uint8)
        for kind, pattern in ((_SPACE, r"\s+"), (_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+")):
            for run in regex.finditer(pattern, points):
                self.kinds[run.start() : run.end()] = kind
        self.ascii = self.kinds[:128].tobytes() + bytes(128)

    def _kinds(self, joined: str, data: bytes) -> np.ndarray:
        """The kind of each byte's character."""
        kinds = np.frombuffer(bytearray(data.translate(self.ascii)), np.uint8)
        if len(joined) < len(data):
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            points = points[points >= 0x80]
            (lead,) = np.nonzero(np.frombuffer(data, np.uint8) >= 0xC0)
            kind = self.kinds[points]
            for more, least in enumerate((0, 0x80, 0x800, 0x10000)):
                long = points >= least
                kinds[lead[long] + more] = kind[long]
        return kinds

    def cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Pieces, which of them are of a text (the others are marks), and each text's number of pieces.

        A piece is a run of one kind, with the blank before it. Of white space before another
        kind the last character stands alone, and a contraction ends within the letters that follow.
        """
        joined = "\0".join([*texts, ""])
        data = joined.encode("utf-8")
        size = map(len, texts if len(joined) == len(data) else map(str.encode, texts))
        ends = np.cumsum(np.fromiter(size, np.int64, len(texts)) + 1) - 1
        kinds, chars = self._kinds(joined, data), np.frombuffer(data, np.uint8)
        kinds[ends] = _END
        begin = np.ones(len(kinds), bool)
        np.not_equal(kinds[1:], kinds[:-1], out=begin[1:])
        begin[ends] = True
        space = kinds == _SPACE
        (last,) = np.nonzero(space[:-1] & ~space[1:] & (kinds[1:] != _END))
        begin[last[chars[last] == 32] + 1] = False
        while (inside := chars[last] & 0xC0 == 0x80).any():  # to the character's first byte
            last[inside] -= 1
        begin[last] = True
        (quote,) = np.nonzero((chars[:-1] == 39) & begin[:-1] & (kinds[1:] == _LETTER))
        one, two = chars[quote + 1], chars[np.minimum(quote + 2, len(chars) - 1)]
        short = np.isin(one, np.frombuffer(b"sdmt", np.uint8))
        long = (one == 108) & (two == 108) | ((one == 118) | (one == 114)) & (two == 101)
        begin[quote[short | long] + 1] = False
        begin[quote[short] + 2] = True
        begin[quote[long] + 3] = True
        (at,) = np.nonzero(begin)
        of_text = kinds[at] != _END
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)])
        return pieces, of_text, np.diff(np.flatnonzero(~of_text), prepend=-1) - 1


class Encoder:
    def __init__(self, path: str):
        self.ranks = load_vocabulary(path)
        self.tokens = {r: t for t, r in self.ranks.items()}
        known = [self.tokens.get(i, b"") for i in range(max(self.tokens) + 1)]
        ends = np.cumsum([0, *map(len, known)], dtype=np.int32)
        self.by_id = pa.Array.from_buffers(pa.binary(), len(known), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(known))])
        self.pairs, self.cutter = Pairs(self.ranks), Cutter()
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.flat, self.begin, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _keep(self, pieces: list[bytes]) -> None:
        """Adds the tokens of distinct pieces to those that are kept."""
        whole = np.fromiter(map(self.ranks.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        (parts,) = np.nonzero(whole < 0)
        sizes = np.fromiter((len(pieces[i]) for i in parts), np.int64, len(parts))
        parts, sizes = parts[np.argsort(sizes, kind="stable")], np.sort(sizes)
        short = int(np.searchsorted(sizes, WIDEST, side="right"))
        which, count, flat = [np.flatnonzero(whole >= 0)], [np.ones(len(whole) - len(parts), np.int64)], [whole[whole >= 0]]
        for i in range(0, short, ROWS):
            of, n, ids = self.pairs.merge([pieces[j] for j in parts[i : min(i + ROWS, short)]])
            which.append(parts[i + of])
            count.append(n)
            flat.append(ids)
        for j in parts[short:]:
            ids = merge(pieces[j], self.ranks)
            which.append(np.array([j]))
            count.append(np.array([len(ids)]))
            flat.append(np.array(ids))
        first = len(self.numbers)
        self.numbers.update(zip((pieces[i] for i in np.concatenate(which).tolist()), itertools.count(first), strict=False))
        size = np.concatenate(count)
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
        self.sizes = np.concatenate([self.sizes, size])
        self.flat = np.concatenate([self.flat, *flat], dtype=np.int32, casting="unsafe")

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of texts, one text's after the other, and their numbers."""
        pieces, of_text, counts = self.cutter.cut(texts)
        coded = pieces.dictionary_encode()
        _, at, data = coded.dictionary.buffers()
        data = data.to_pybytes()
        distinct = [data[a:b] for a, b in itertools.pairwise(np.frombuffer(at, np.int64)[: len(coded.dictionary) + 1].tolist())]
        new = [piece for piece in distinct if piece not in self.numbers]
        if len(self.numbers) + len(new) > KEPT:
            self._forget()
            new = distinct
        if new:
            self._keep(new)
        number = np.fromiter(map(self.numbers.__getitem__, distinct), np.int64, len(distinct))
        flat, sizes = _gathered(self.flat, self.begin, self.sizes, number[np.frombuffer(coded.indices.buffers()[1], np.int32)[: len(of_text)][of_text]])
        return flat, _sums(sizes, counts)

    def encode(self, text: str) -> list[int]:
        return self.ids([text])[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The same for many texts: ids one text's after the other, and where each text's end."""
        out = self.by_id.take(_array(ids))
        at = np.frombuffer(out.buffers()[1], np.int32)[: len(ids) + 1]
        data = memoryview(out.buffers()[2] or b"")
        stops = at[ends].tolist() if len(ids) else [0] * len(ends)
        return [bytes(data[a:b]) for a, b in zip([0, *stops], stops, strict=False)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _encode(path: str, verify: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for part in S.chunks(batches, most=ENCODED):
            texts = part.column(1).to_pylist()
            flat, counts = e.ids([text or "" for text in texts])
            if verify:
                back = e.decoded(flat, np.cumsum(counts))
                same = np.array([(text or "").encode("utf-8", "surrogatepass") == x for text, x in zip(texts, back, strict=True)], bool)
            null = np.array([text is None for text in texts], bool)
            offsets = np.concatenate([[0], np.cumsum(counts)])
            ids = pa.ListArray.from_arrays(_array(offsets), _array(flat), mask=_array(null))
            columns = {"doc_id": part.column(0), "n_tokens": _array(counts, null), "token_ids": ids}
            if verify:
                columns["round_trip"] = _array(same, null)
            yield pa.RecordBatch.from_pydict(columns)

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, verify: bool = True) -> DataFrame:
    """Each text's tokens and, with verify, whether they decode to it."""
    texts = docs.select(S.id_of(docs, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_encode(vocabulary, verify), "doc_id long, n_tokens int, token_ids array<int>" + ", round_trip boolean" * verify)


def decode(tokens: DataFrame, id_col: str = "doc_id", tokens_col: str = "token_ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text of each row of token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in batches:
            out = []
            for ids in batch.column(1).to_pylist():
                try:
                    out.append(None if ids is None else e.decode(ids).decode("utf-8", "replace"))
                except KeyError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return tokens.select(S.id_of(tokens, id_col).alias("doc_id"), F.col(tokens_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
