"""Operator 8: personal and secret identifiers by bootstrapped contextual extraction.

1. Candidates are the white-space separated strings that hold a digit or '@', without the
   punctuation around them, and groups of digits with single blanks between them. A string
   is cut at its separators (: = , / quotes, brackets, ...) where it isn't a seed itself and
   a part is one or a label of letters stands first, as in email:jo@ex.com. Seeds are those that a strict validator accepts (addresses of
   mail and of hosts, card numbers by check digit, long keys, ...).
   Strings without a digit or '@' (names, street names, word-like passwords) are never
   candidates.
2. Each occurrence induces lexical patterns: its shape (letters a, digits 9, runs of both x,
   with and without lengths) and the shape with the word before, the two words before, or
   the word after it, at any distance and of any length. Candidates and patterns form a
   bipartite graph.
3. Spark scores the graph by turns: a pattern's score for a kind is the sum of its
   instances' scores for the kind / (number of its instances + 1); a pattern of
   min_support instances or more and a score of min_confidence or more is trusted, and an
   instance's score is the highest of its trusted patterns, 1 for a seed. It ends when a
   round finds no new instance.

Result of identifiers(): doc_id, begin, stop (in characters, stop excluded), kind, entity,
score, for every occurrence of an instance that scored. Kinds in a tie: the later in the
alphabet. Ids are integers; other types raise a TypeError. Nulls and empty texts have no rows; rows with a null id have theirs, with a null
id; repeated rows have theirs once for each id. An empty table gives an empty result.
Columns other than id and text aren't read. Texts are read whole. mask() replaces each
occurrence by [KIND] and keeps all rows and columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm import _shared as S

_FOUND = re.compile(r"(?<!\S)(?=\S*[0-9@])\S+")
#: Groups of digits with blanks between them, such as a telephone number: one candidate.
_PHRASE = re.compile(r"(?<![\w.-])\+?\(?\d{1,4}\)?(?: \(?\d{2,4}\)?(?:[.-]\d{2,4}){0,2}(?![\w-]|\.\d))+")
_CUT, _PATH = re.compile(r"[^:=,;|&?<>()\[\]{}\"'`]+"), re.compile(r"[^/\\]+")
_LABEL = re.compile(r"[\"'`<({\[]*[^\W\d_]+(?:[_-][^\W\d_]+)*[\"'`]?[:=]")
_WORD = re.compile(r"[^\W_]+")
_AROUND = "\"'`.,;:!?()[]{}<>&%$#*|=~^/\\-_+"
_RUN = re.compile(r"[^\W_]+")
_EMAIL = re.compile(r"[\w.+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_IP = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}")
_CARD = re.compile(r"\d(?:[ -]?\d){12,18}")
_KEY = re.compile(r"(?=.*\d)(?=.*[A-Za-z])[A-Za-z0-9_+/-]{32,}")
_PHONE = re.compile(r"(?:\+?\d{1,3}[ .-])?\(?\d{3}\)?[ .-]?\d{3}[.-]\d{4}|\+\d{1,3}(?: \(?\d{2,4}\)?){2,4}")
_SOCIAL = re.compile(r"\d{3}-\d{2}-\d{4}")
_IBAN = re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}")


def _luhn(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return len(set(digits)) > 1 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def seed_kind(text: str) -> str | None:
    """The kind of identifier that a strict validator finds in text, or None."""
    if "@" in text:
        return "email" if _EMAIL.fullmatch(text) else None
    if _IP.fullmatch(text):
        return "ip" if all(int(x) < 256 for x in text.split(".")) else None
    if _CARD.fullmatch(text) and _luhn(text):
        return "card"
    if _SOCIAL.fullmatch(text):
        return "social"
    if _PHONE.fullmatch(text):
        return "phone"
    if _IBAN.fullmatch(text) and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1:
        return "iban"
    return "key" if _KEY.fullmatch(text) else None


def shape(text: str, lengths: bool) -> str:
    def run(m: re.Match[str]) -> str:
        s = m[0]
        kind = "9" if s.isdigit() else "a" if s.isalpha() else "x"
        return f"{kind}{len(s)}" if lengths and kind != "a" else kind

    return _RUN.sub(run, text)


def _core(text: str, begin: int, stop: int) -> tuple[int, int]:
    # What is set off by quotation marks or noise inside the string is cut off too.
    while begin < stop and text[begin] in _AROUND:
        begin += 1
    while stop > begin and text[stop - 1] in _AROUND:
        stop -= 1
    return begin, stop


def _parts(text: str, begin: int, stop: int) -> list[tuple[int, int]]:
    """The candidates of a string: its core, or the parts between separators."""
    whole = _core(text, begin, stop)
    if seed_kind(text[slice(*whole)]):
        return [whole]
    out = []
    for m in _CUT.finditer(text, begin, stop):
        part = _core(text, *m.span())
        steps = [] if seed_kind(text[slice(*part)]) else [_core(text, *x.span()) for x in _PATH.finditer(text, *part)]
        out += steps if any(seed_kind(text[slice(*x)]) for x in steps) else [part]
    cut = _LABEL.match(text, begin, stop) or any(seed_kind(text[slice(*x)]) for x in out)
    return out if cut else [whole]


def words_before(text: str, place: int) -> list[str]:
    """The two words (or fewer) that end before a place, whole whatever their length."""
    width = 60
    while True:
        words = _WORD.findall(text[max(0, place - width) : place].lower())
        # The first of three or more may be cut where the slice begins, the last two aren't.
        if len(words) > 2 or width >= place:
            return words[-2:]
        width *= 4


def word_after(text: str, place: int) -> list[str]:
    """The word that begins after a place, whole, or none."""
    width = 40
    while True:
        words = _WORD.findall(text[place : place + width].lower())
        if len(words) > 1 or place + width >= len(text):
            return words[:1]
        width *= 4


def occurrences(text: str) -> list[tuple[int, int, str, str | None, list[str]]]:
    """(begin, stop, entity, seed kind, patterns) of each candidate of a text."""
    out = []
    # A group goes as a whole unless one of its parts is known by itself and the whole isn't.
    phrases = [m.span() for m in _PHRASE.finditer(text) if seed_kind(m[0]) or not any(seed_kind(x.strip(_AROUND)) for x in m[0].split(" "))]
    taken = set()
    for a, b in phrases:
        taken.update(range(a, b))
    alone = (x for m in _FOUND.finditer(text) if m.start() not in taken and m.end() - 1 not in taken for x in _parts(text, *m.span()))
    for begin, stop in sorted([*phrases, *(x for x in alone if x[0] not in taken)]):
        entity = text[begin:stop]
        if not any(c.isdigit() or c == "@" for c in entity):
            continue
        before, after = words_before(text, begin), word_after(text, stop)
        loose, exact = shape(entity, False), shape(entity, True)
        patterns = {f"S {exact}", f"s {loose}"}
        if before:
            patterns.add(f"L {before[-1]} _ {loose}")
        if len(before) == 2:
            patterns.add(f"LL {before[0]} {before[1]} _ {loose}")
        if after:
            patterns.add(f"R {loose} _ {after[0]}")
        out.append((begin, stop, entity, seed_kind(entity), sorted(patterns)))
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in S.chunks(batches):
        rows = [(i, *x) for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for x in occurrences(text)]
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "begin", "stop", "entity", "seed", "patterns"])


def identifiers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_confidence: float = 0.85, min_support: int = 10) -> DataFrame:
    """Every occurrence of an identifier."""
    texts = docs.select(S.id_of(docs, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    places = S.written(texts.mapInArrow(_extract, "doc_id long, begin int, stop int, entity string, seed string, patterns array<string>").distinct())
    edges = S.written(places.select(F.explode("patterns").alias("pattern"), "entity").distinct())
    support = S.written(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= min_support))
    seeds = S.written(places.where("seed is not null").select("entity", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct())
    scores, known = seeds, seeds.count()
    while True:
        share = edges.join(scores, "entity").groupBy("pattern", "kind").agg(F.sum("score").alias("sum")).join(support, "pattern")
        share = share.select("pattern", "kind", F.round(F.col("sum") / (F.col("n") + 1), 6).alias("score")).where(F.col("score") >= min_confidence)
        trusted = share.groupBy("pattern").agg(F.max(F.struct("score", "kind")).alias("best")).select("pattern", "best.*")
        found = edges.join(trusted, "pattern").select("entity", "kind", "score").unionByName(seeds)
        scores = S.written(found.groupBy("entity").agg(F.max(F.struct("score", "kind")).alias("best")).select("entity", "best.kind", "best.score"))
        count = scores.count()
        if count <= known:
            break
        known = count
    return places.join(scores, "entity").select("doc_id", "begin", "stop", "kind", "entity", "score")


def mask_text(text: str, spans: list[tuple[int, int, str, str]]) -> str:
    """text with each (begin, stop, kind, entity) that stands in it replaced by [KIND]."""
    out, at = [], 0
    for begin, stop, kind, entity in sorted(spans):
        if begin >= at and text[begin:stop] == entity:
            out += [text[at:begin], f"[{kind.upper()}]"]
            at = stop
    return "".join(out) + text[at:]


def mask(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs with identifiers replaced; occurrences come back to a text by its hash, so ids may be null or repeat."""
    # Names that no column of docs has.
    key, places = (next(n for i in range(10**6) if (n := f"{base}{i}") not in docs.columns) for base in ("text_hash_", "text_spans_"))
    hashed = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    spans = identifiers(hashed, "h", "t", **options).groupBy("doc_id").agg(F.collect_set(F.struct("begin", "stop", "kind", "entity")).alias(places))
    spans = S.written(spans.withColumnRenamed("doc_id", key))
    joined = docs.withColumn(key, F.xxhash64(text_col)).join(F.broadcast(spans) if S.small(spans, 64, places, 96) else spans, key, "left").drop(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            found = batch.column(batch.schema.get_field_index(places))
            texts = batch.column(place)
            if found.null_count < len(found):
                new = [t if s is None or t is None else mask_text(t, [(x["begin"], x["stop"], x["kind"], x["entity"]) for x in s]) for t, s in zip(texts.to_pylist(), found.to_pylist(), strict=True)]
                texts = pa.array(new, texts.type)
            keep = [i for i, name in enumerate(batch.schema.names) if name != places]
            yield pa.RecordBatch.from_arrays([texts if i == place else batch.column(i) for i in keep], names=[batch.schema.names[i] for i in keep])

    return joined.select(*docs.columns, places).mapInArrow(run, docs.schema)
