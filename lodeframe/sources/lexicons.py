"""Dictionaries and reference tables as data: read from a JSON file, checked, and handed to the operators.

The file is an object with any of these members:
    topics                       {"1": ["term", ...], ...}: terms by topic number
    severity, supportive, opposed, problems, solutions, actors, shared, seeds      ["term", ...]
    frames, crises, vocabulary   {"name": ["term", ...], ...}, in order of preference
    places                       {"name": "code", ...}; recipients: ["code", ...]; english: {"name": "name", ...}
    sectors, sector_prefixes     {"code": topic, ...}
    outlets                      [{"code", "outlet", "media_category"}, ...]
    terms                        [{"holder", "side", "start", "end"}, ...]: terms of office, dates as yyyy-mm-dd
    acting                       [{"start", "end"}, ...]
    events                       [{"year", "month", "label"}, ...]: in order, the last of a month counts
    crisis_events                [{"year", "month", "kind", "severity", "topics": [...]}, ...]
Members that are absent are empty. Unknown members, and values that can't be right, are errors that name them all.
"""

from __future__ import annotations

import datetime
import json
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions import topics as T


@dataclass
class Reference:
    topics: dict[int, list[str]] = field(default_factory=dict)
    severity: list[str] = field(default_factory=list)
    supportive: list[str] = field(default_factory=list)
    opposed: list[str] = field(default_factory=list)
    problems: list[str] = field(default_factory=list)
    solutions: list[str] = field(default_factory=list)
    actors: list[str] = field(default_factory=list)
    shared: list[str] = field(default_factory=list)
    seeds: list[str] = field(default_factory=list)
    frames: dict[str, list[str]] = field(default_factory=dict)
    crises: dict[str, list[str]] = field(default_factory=dict)
    vocabulary: dict[str, list[str]] = field(default_factory=dict)
    places: dict[str, str] = field(default_factory=dict)
    english: dict[str, str] = field(default_factory=dict)
    recipients: list[str] = field(default_factory=list)
    sectors: dict[str, int] = field(default_factory=dict)
    sector_prefixes: dict[str, int] = field(default_factory=dict)
    outlets: list[dict] = field(default_factory=list)
    terms: list[dict] = field(default_factory=list)
    acting: list[dict] = field(default_factory=list)
    events: list[dict] = field(default_factory=list)
    crisis_events: list[dict] = field(default_factory=list)

    def classify(self, df: DataFrame, short: Column, long: Column) -> DataFrame:
        """topics.classify with these dictionaries."""
        return T.classify(df, short, long, self.topics, self.severity, self.supportive, self.opposed, self.frames, self.problems, self.solutions, self.crises, self.actors)

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """A member as a table: sectors and sector_prefixes (key, value), outlets, terms, acting, events (with seq) or crisis_events."""
        if name in ("sectors", "sector_prefixes"):
            return spark.createDataFrame(list(getattr(self, name).items()), "key string, value int")
        kinds = {"outlets": "code string, outlet string, media_category string", "terms": "holder string, side string, start date, end date", "acting": "start date, end date", "events": "year int, month int, seq int, label string", "crisis_events": "year int, month int, kind string, severity int, topics array<int>"}
        names = [x.split()[0] for x in kinds[name].split(", ")]
        day = lambda x: datetime.date.fromisoformat(x)
        rows = [tuple(day(r[c]) if c in ("start", "end") else k if c == "seq" else r[c] for c in names) for k, r in enumerate(getattr(self, name))]
        return spark.createDataFrame(rows, kinds[name])


_FIELDS = {
    "outlets": {"code": str, "outlet": str, "media_category": str},
    "terms": {"holder": str, "side": str, "start": "day", "end": "day"},
    "acting": {"start": "day", "end": "day"},
    "events": {"year": int, "month": "month", "label": str},
    "crisis_events": {"year": int, "month": "month", "kind": str, "severity": int, "topics": "topics"},
}


def _fits(value: object, kind: object, most: int) -> bool:
    whole = isinstance(value, int) and not isinstance(value, bool)
    if kind == "day":
        try:
            return isinstance(value, str) and bool(datetime.date.fromisoformat(value))
        except ValueError:
            return False
    if kind == "month":
        return whole and 1 <= value <= 12
    if kind == "topics":
        return isinstance(value, list) and all(_fits(x, "topic", most) for x in value)
    if kind == "topic":
        return whole and 1 <= value <= most
    return whole if kind is int else isinstance(value, kind)


def reference(data: dict, most_topics: int = 17) -> Reference:
    """The members of a parsed file, checked."""
    wrong: list[str] = []
    kinds = {f.name: str(f.type) for f in fields(Reference)}
    wrong += [f"{k}: no such member" for k in data if k not in kinds]
    terms = lambda x: isinstance(x, list) and all(isinstance(t, str) and t for t in x)
    out: dict = {}
    for name, value in data.items():
        if name == "topics":
            good = isinstance(value, dict) and all(str(k).isdigit() and 1 <= int(k) <= most_topics and terms(v) for k, v in value.items())
            out[name] = {int(k): list(v) for k, v in value.items()} if good else {}
            held = [t for v in out[name].values() for t in v]
            wrong += [f"topics: {t!r} stands in two topics, or twice" for t in sorted({t for t in held if held.count(t) > 1})]
        elif name in ("sectors", "sector_prefixes"):
            good = isinstance(value, dict) and all(k and _fits(v, "topic", most_topics) for k, v in value.items())
        elif name in _FIELDS:
            good = isinstance(value, list) and all(isinstance(r, dict) and set(r) == set(_FIELDS[name]) and all(_fits(r[c], kind, most_topics) for c, kind in _FIELDS[name].items()) for r in value)
            if good and "start" in _FIELDS[name]:
                wrong += [f"{name}: {r['start']} is after {r['end']}" for r in value if r["start"] > r["end"]]
        elif kinds.get(name) == "dict[str, list[str]]":
            good = isinstance(value, dict) and all(k and terms(v) for k, v in value.items())
        elif kinds.get(name) == "dict[str, str]":
            good = isinstance(value, dict) and all(k and isinstance(v, str) and v for k, v in value.items())
        elif name in kinds:
            good = terms(value)
        else:
            continue
        if not good:
            wrong.append(f"{name}: not what it should hold")
        out.setdefault(name, value)
    unknown = sorted(set(data.get("recipients") or ()) - set((data.get("places") or {}).values())) if not wrong and data.get("places") else []
    wrong += [f"recipients: no place has the code {c}" for c in unknown]
    if wrong:
        raise ValueError("; ".join(wrong))
    return Reference(**out)


def read_reference(spark: SparkSession, path: str, most_topics: int = 17) -> Reference:
    """reference() of a JSON file anywhere that Spark reads."""
    return reference(json.loads(spark.read.option("wholetext", True).text(path).first()[0].lstrip("﻿")), most_topics)


def lexicon(rows: DataFrame, label: str = "topic", term: str = "term") -> dict:
    """{label: [term, ...]} of a table, labels and terms in order; rows with a null are left out."""
    rows = rows.where(F.col(label).isNotNull() & F.col(term).isNotNull()).groupBy(label).agg(F.array_sort(F.collect_set(term)).alias("terms"))
    return {r[0]: list(r[1]) for r in sorted(rows.collect(), key=lambda r: r[0])}
