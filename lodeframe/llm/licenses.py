"""Operator 7: license scans by template markup.

A template is text with marked regions:
    <<beginOptional>> ... <<endOptional>>           may be left out, may be nested
    <<var;name="n";original="o";match="m">>         any words that match
match is ".+" (one word or more), ".*", ".{a,b}" (a to b words), or a regular expression that
each of one or more words matches in full. A template compiles to a token automaton: its
states are places between words, with edges for words, for leaving an optional region out,
and for the words of a variable (a loop where their number is open, so there is no limit).
Words are runs of letters and digits in lower case, so white space, punctuation and case
don't matter, and every mandatory word has to stand exactly where the template has it.

scan() finds accepted stretches in texts: the first place where one begins, there the one
whose variables have as few words and whose optional regions stand where they can (as lazy
and greedy parts of a regular expression), then on after it. All places are tried in one
pass: states keep the earliest begin. A template is tried only in texts that hold its longest
mandatory word, which Spark filters in the scan, and then all its mandatory words (exact: no
other text can match). Templates of the same stretch all give rows.

TEMPLATES are the files of license_templates, one for each template: whole texts of short
licenses, standard notices and one-line references of the long ones. read_templates() reads
others.

Result: doc_id, license_id, first_word, end_word (end excluded). Ids are integers; other
types raise a TypeError. Nulls and texts without a match have no rows; rows with a null id
have rows with a null id; repeated rows give repeated rows. An empty table gives an empty
result. Columns other than id and text aren't read. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm import _shared as S

_WORD = re.compile(r"[^\W_]+")
_MARK = re.compile(r"<<(beginOptional|endOptional|var)(.*?)>>", re.S)


def read_templates(folder: str | Path) -> dict[str, str]:
    """{file name without .txt: template} of the files of a folder on the driver."""
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted(Path(folder).glob("*.txt"))}


TEMPLATES = read_templates(Path(__file__).parent / "license_templates")

#: ("word", w), ("optional", nodes) or ("var", (low, high or None, pattern or None)).
Node = tuple[str, object]


def parse_template(template: str) -> list[Node]:
    open_, at = [[]], 0
    for m in [*_MARK.finditer(template), None]:
        open_[-1] += [("word", w) for w in _WORD.findall(template[at : m.start() if m else None].lower())]
        if m is None:
            break
        at = m.end()
        if m[1] == "beginOptional":
            open_.append([])
        elif m[1] == "endOptional":
            if len(open_) == 1:
                raise ValueError("endOptional without beginOptional")
            region = open_.pop()
            open_[-1].append(("optional", region))
        else:
            match = re.search(r'match="(.*?)"', m[2])
            rule = match[1] if match else ".+"
            counted = re.fullmatch(r"\.\{(\d+),(\d+)\}", rule)
            if counted:
                open_[-1].append(("var", (int(counted[1]), int(counted[2]), None)))
            else:
                open_[-1].append(("var", (0 if rule == ".*" else 1, None, None if rule in (".+", ".*") else re.compile(rule))))
    if len(open_) > 1:
        raise ValueError("beginOptional without endOptional")
    if not any(kind == "word" for kind, _ in open_[0]):
        raise ValueError("a template needs a mandatory word")
    return open_[0]


@dataclass
class Automaton:
    """A state takes a word (words, or classes for any word or a pattern) or goes on to others, the preferred first (skips).

    next[s]: what follows a state that took a word, as states that take one, in order of
    preference; the last state is the accepting one.
    """

    words: list[str | None] = field(default_factory=list)
    classes: list[re.Pattern | bool] = field(default_factory=list)
    skips: list[list[int] | None] = field(default_factory=list)
    mandatory: list[str] = field(default_factory=list)
    next: list[list[int]] = field(default_factory=list)
    begin: list[int] = field(default_factory=list)

    def add(self, word: str | None = None, kind: re.Pattern | bool = False, skip: list[int] | None = None) -> int:
        self.words.append(word)
        self.classes.append(kind)
        self.skips.append(skip)
        return len(self.words) - 1

    def emit(self, nodes: list[Node]) -> None:
        for kind, x in nodes:
            if kind == "word":
                self.add(word=x)
            elif kind == "optional":
                fork = self.add(skip=[])
                self.emit(x)
                self.skips[fork] = [fork + 1, len(self.words)]
            else:
                low, high, pattern = x
                for _ in range(low):
                    self.add(kind=pattern or True)
                if high is None:
                    fork = self.add(skip=[])
                    self.add(kind=pattern or True)
                    self.add(skip=[fork])
                    self.skips[fork] = [len(self.words), fork + 1]
                else:
                    forks = []
                    for _ in range(high - low):
                        forks.append(self.add(skip=[]))
                        self.add(kind=pattern or True)
                    for fork in forks:
                        self.skips[fork] = [len(self.words), fork + 1]

    def reached(self, state: int) -> list[int]:
        """The states that take a word, or accept, from a state on, in order of preference."""
        out, seen, todo = [], set(), [state]
        while todo:
            s = todo.pop()
            if s in seen:
                continue
            seen.add(s)
            if self.skips[s] is None:
                out.append(s)
            else:
                todo += reversed(self.skips[s])
        return out

    def takes(self, state: int, word: str) -> bool:
        kind = self.classes[state]
        return self.words[state] == word if kind is False else kind is True or kind.fullmatch(word) is not None


def compile_template(template: str) -> Automaton:
    nodes = parse_template(template)
    a = Automaton(mandatory=[x for kind, x in nodes if kind == "word"])
    a.emit(nodes)
    accept = a.add()
    a.begin = a.reached(0)
    a.next = [a.reached(s + 1) if a.skips[s] is None and s != accept else [] for s in range(len(a.words))]
    return a


def find(words: list[str], a: Automaton) -> list[tuple[int, int]]:
    """(first, end) of accepted stretches without overlap, in one pass but for what is looked at beyond an end."""
    accept = len(a.words) - 1
    free = any(a.classes[s] is not False for s in a.begin)
    first = {a.words[s] for s in a.begin}
    out: list[tuple[int, int]] = []
    live: list[tuple[int, int]] = []
    found, i = None, 0
    while i < len(words) or found:
        if not live:
            if found:
                out.append(found)
                i, found = found[1], None
            while i < len(words) and not free and words[i] not in first:
                i += 1
        if i == len(words):
            if found:
                live = []
                continue
            break
        word, seen, after = words[i], set(), []
        # A stretch that begins here comes after all that began before, and only while none is found.
        for s, start in live if found else [*live, *((s, i) for s in a.begin)]:
            if not a.takes(s, word):
                continue
            if accept in a.next[s]:
                for t in a.next[s]:
                    if t == accept:
                        found = (start, i + 1)
                        break
                    if t not in seen:
                        seen.add(t)
                        after.append((t, start))
                break
            for t in a.next[s]:
                if t not in seen:
                    seen.add(t)
                    after.append((t, start))
        live = after
        i += 1
    return out


def _scan(templates: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = {k: compile_template(t) for k, t in templates.items()}
        for part in S.chunks(batches):
            rows = []
            for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = _WORD.findall(text.lower())
                there = set(words)
                for name, a in automata.items():
                    if there.issuperset(a.mandatory):
                        rows += [(i, name, x, y) for x, y in find(words, a)]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "license_id", "first_word", "end_word"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """License wording in texts."""
    templates = TEMPLATES if templates is None else templates
    telling = sorted({max(compile_template(t).mandatory, key=lambda w: (len(w), w)) for t in templates.values()})
    texts = docs.select(S.id_of(docs, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lower = F.lower("text")
    held = reduce(lambda a, b: a | b, (F.contains(lower, F.lit(w)) for w in telling), F.lit(False))
    return texts.where(held).mapInArrow(_scan(templates), "doc_id long, license_id string, first_word int, end_word int")
