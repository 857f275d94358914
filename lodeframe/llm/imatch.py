"""Operator 5: I-Match fingerprints.

Terms (runs of letters and digits of the lower-cased text) are counted by the number of
documents they stand in. A document keeps its distinct terms whose document frequency lies
in a band, min_share * N <= df <= max_share * N (that is, idf = ln(N / df) between
-ln(max_share) and -ln(min_share)) with df >= 2, sorts them and hashes them. Beside that
fingerprint, fp_0, each of lexicons - 1 random subsets of the lexicon gives another: a
term is in subset k if the first two hexadecimal digits of md5(term + '|' + k) are below
keep / 256. Two documents are candidates for copies if they agree in one of them: an edit
changes fp_k only if one of its terms is in subset k.

N and df are counted over all documents. The lexicon that is sent to the executors doesn't
grow with the corpus: terms of df >= min_share * N number at most (mean distinct terms of
a document) / min_share; max_lexicon checks it.

Result: doc_id, n_terms (distinct terms in the band), fp_0 .. fp_{lexicons-1}. A
fingerprint without terms is null: so for null and empty texts. Ids are integers; other types
raise a TypeError. Rows with a null id stay;
each row counts as a document of its own. Order and repetition of terms don't matter. An
empty table gives an empty result. Columns other than id and text aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm import _shared as S

_TERM = re.compile(r"[^\W_]+")
#: Terms a task counts before it hands the counts on.
HELD_TERMS = 200_000


def terms(text: str | None) -> set[str]:
    return set(_TERM.findall(text.lower())) if text else set()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["term", "df"])

    for part in S.chunks(batches):
        for text in part.column(0).to_pylist():
            held.update(terms(text))
        if len(held) > HELD_TERMS:
            yield out()
            held = Counter()
    if held:
        yield out()


def subsets(term: str, lexicons: int, keep: int) -> int:
    """Bit k is set if the term is in lexicon k."""
    return sum(1 << k for k in range(lexicons) if not k or int(hashlib.md5(f"{term}|{k}".encode()).hexdigest()[:2], 16) < keep)


def _fingerprints(lexicon, lexicons: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lexicon.value
        for part in S.chunks(batches):
            counts, prints = [], [[] for _ in range(lexicons)]
            for text in part.column(1).to_pylist():
                own = sorted(known.keys() & terms(text))
                counts.append(len(own))
                masks = [known[t] for t in own]
                for k in range(lexicons):
                    some = [t for t, m in zip(own, masks, strict=True) if m >> k & 1] if k else own
                    prints[k].append(hashlib.md5(" ".join(some).encode()).hexdigest() if some else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), *(pa.array(p, pa.string()) for p in prints)], names=["doc_id", "n_terms", *(f"fp_{k}" for k in range(lexicons))])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = 0.002, max_share: float = 0.05, lexicons: int = 4, keep: int = 192, max_lexicon: int = 2_000_000) -> DataFrame:
    """The I-Match fingerprints of each document."""
    texts = docs.select(S.id_of(docs, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = docs.count()
    counted = texts.select("text").mapInArrow(_frequencies, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    band = counted.where((F.col("df") >= 2) & (F.col("df") >= F.lit(min_share) * n) & (F.col("df") <= F.lit(max_share) * n)).select("term")
    rows = band.limit(max_lexicon + 1).toArrow().column(0).to_pylist()
    if len(rows) > max_lexicon:
        raise ValueError(f"the lexicon has over {max_lexicon} terms: raise min_share")
    lexicon = docs.sparkSession.sparkContext.broadcast({t: subsets(t, lexicons, keep) for t in rows})
    schema = "doc_id long, n_terms long, " + ", ".join(f"fp_{k} string" for k in range(lexicons))
    return texts.mapInArrow(_fingerprints(lexicon, lexicons), schema)
