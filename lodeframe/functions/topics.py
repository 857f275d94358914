"""Dictionary classification of text. Lexicons are data: {label: [term, ...]}.

Two ways of counting exist side by side: occurrence counts (alternation, case-sensitive,
leftmost first, without overlap) and distinct terms that occur as substrings.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Lexicon = dict[int, list[str]]


def alternation(terms: Sequence[str]) -> str:
    """Terms as a regular expression, in list order: the first that fits at a place wins."""
    return "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", t) for t in terms)


def occurrences(text: Column, terms: Sequence[str]) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(alternation(terms))), F.lit(0)) if terms else F.lit(0)


def holds(text: Column, terms: Sequence[str], any_case: bool = False) -> Column:
    """Whether a term occurs; null text holds none."""
    return F.coalesce(text.rlike(("(?i)" if any_case else "") + f"(?:{alternation(terms)})"), F.lit(False)) if terms else F.lit(False)


def trie(terms: Sequence[str]) -> str:
    """A pattern that takes the longest of the terms at a place; common beginnings are tried once."""
    tree: dict = {}
    for t in terms:
        node = tree
        for c in t:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [alternation([c]) + pattern(rest) for c, rest in sorted(node.items()) if c]
        if not ways:
            return ""
        if len(ways) == 1 and "" not in node:
            return ways[0]
        return f"(?:{'|'.join(ways)})" + ("?" if "" in node else "")

    return pattern(tree)


def found_terms(text: Column, terms: Sequence[str], behind: str = "") -> Column:
    """The distinct terms that are substrings of text, in one scan of it whatever their number.

    At each place a look-ahead takes the longest term; those that begin it are there too.
    behind: a look-behind that every term has to pass.
    """
    terms = sorted({t for t in terms if t})
    if not terms:
        return F.array().cast("array<string>")
    held = F.array_distinct(F.regexp_extract_all(text, F.lit(f"{behind}(?=({trie(terms)}))"), F.lit(1)))
    begun = {t: [x for x in terms if t.startswith(x)] for t in terms}
    if all(len(xs) == 1 for xs in begun.values()):
        return held
    with_inner = F.create_map(*(x for t, xs in begun.items() for x in (F.lit(t), F.array(*map(F.lit, xs)))))
    return F.array_distinct(F.flatten(F.transform(held, lambda t: F.element_at(with_inner, t))))


def occurrence_counts(text: Column, lexicon: Lexicon) -> Column:
    """Counts for the topics 1..max, as an array."""
    return F.array(*(occurrences(text, lexicon.get(k, [])) for k in range(1, max(lexicon) + 1)))


def primary(counts: Column) -> Column:
    """The topic of the highest count, the lowest of equals; 0 if all are 0."""
    return F.when(F.array_max(counts) > 0, F.array_position(counts, F.array_max(counts))).otherwise(0).cast("int")


def secondary(counts: Column, first: Column) -> Column:
    """The primary topic of the others."""
    return primary(F.transform(counts, lambda x, i: F.when(i == first - 1, F.lit(-1)).otherwise(x)))


def score(counts: Column) -> Column:
    top = F.array_max(counts)
    return F.when(top > 0, F.round(top / (top + 3), 4)).otherwise(0.0)


def intensity(counts: Column) -> Column:
    top = F.array_max(counts)
    return F.when(top <= 0, 0).when(top < 3, 1).when(top < 6, 2).otherwise(3)


def issue_intensity(counts: Column, severity: Column) -> Column:
    top = F.array_max(counts)
    base = F.when(top <= 1, top).when(top <= 3, 2).when(top <= 6, 3).otherwise(4)
    return F.when(top <= 0, 0).otherwise(F.least(base + F.least(severity, F.lit(1)), F.lit(5))).cast("int")


def stance(supportive: Column, opposed: Column) -> Column:
    return F.when(supportive > opposed, "supportive").when(opposed > supportive, "opposed").otherwise("neutral")


def favourability(stance_: Column) -> Column:
    return F.when(stance_ == "supportive", "positive").when(stance_ == "opposed", "negative").otherwise("neutral")


def frame_counts(text: Column, frames: dict[str, list[str]]) -> Column:
    return F.array(*(occurrences(text, t) for t in frames.values()))


def frame(counts: Column, names: Sequence[str], mixed_from: int = 3) -> Column:
    """The frame of the highest of its frame_counts, the first of equals; mixed if many are active, '' if none."""
    if not names:
        return F.lit("")
    active = F.size(F.filter(counts, lambda x: x > 0))
    best = F.element_at(F.array(*map(F.lit, names)), F.array_position(counts, F.array_max(counts)).cast("int"))
    return F.when(active == 0, "").when(active >= mixed_from, "mixed").otherwise(best)


def problem_or_solution(problems: Column, solutions: Column) -> Column:
    return (
        F.when((problems == 0) & (solutions == 0), "neutral")
        .when(solutions == 0, "problem")
        .when(problems == 0, "solution")
        .when(problems > 2 * solutions, "problem")
        .when(solutions > 2 * problems, "solution")
        .otherwise("mixed")
    )


def matching(text: Column, kinds: dict[str, list[str]]) -> Column:
    """The kinds that occur, in the dictionary's order."""
    if not kinds:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*(F.when(holds(text, terms), F.lit(k)) for k, terms in kinds.items())))


def distinct_terms(text: Column, terms: Sequence[str], legacy_case: bool = False) -> Column:
    """How many different terms are substrings of the lower-cased text.

    legacy_case leaves the terms as they are, so those with capitals never match.
    """
    known = terms if legacy_case else [t.lower() for t in terms]
    there = found_terms(F.lower(F.coalesce(text, F.lit(""))), known)
    # Terms that only differ in case are two terms, which are there together.
    weight = {t: n for t in known if (n := len({x for x, k in zip(terms, known, strict=True) if k == t})) > 1}
    return F.size(there) + sum((F.array_contains(there, t).cast("int") * (n - 1) for t, n in weight.items()), F.lit(0))


def term_scores(text: Column, lexicon: Lexicon, legacy_case: bool = False) -> Column:
    """{topic: distinct terms}, only topics that have one: one scan of the text for all topics."""
    of: dict[str, list[int]] = {}
    for k in sorted(lexicon):
        for t in dict.fromkeys(lexicon[k]):
            of.setdefault(t if legacy_case else t.lower(), []).append(k)
    topics = F.create_map(*(x for t, ks in of.items() for x in (F.lit(t), F.array(*map(F.lit, ks)))))
    there = F.flatten(F.transform(found_terms(F.lower(F.coalesce(text, F.lit(""))), list(of)), lambda t: F.element_at(topics, t)))
    # A map of counts, built up term by term: the text's terms are scanned once.
    none = F.map_from_arrays(F.array(*map(F.lit, sorted(lexicon))), F.array(*(F.lit(0) for _ in lexicon)))
    counts = F.aggregate(there, none, lambda acc, k: F.transform_values(acc, lambda key, v: v + (key == k).cast("int")))
    return F.map_filter(counts, lambda _, v: v > 0)


def top_of_scores(scores: Column) -> Column:
    """The topic of the highest score, the lowest of equals; 0 without scores."""
    best = F.array_max(F.transform(F.map_entries(scores), lambda e: F.struct(e["value"].alias("v"), (-e["key"]).alias("k"))))
    return F.coalesce(-best["k"], F.lit(0))


def topics_of_scores(scores: Column) -> Column:
    """The topics that have a score, ascending."""
    return F.array_sort(F.map_keys(scores))


def topic_hits(text: Column, lexicon: Lexicon, legacy_case: bool = False) -> Column:
    """The topics with a term in the lower-cased text, ascending."""
    return topics_of_scores(term_scores(text, lexicon, legacy_case))


def places(text: Column, names: dict[str, str], short: int = 3, letter: str = "가-힣", skip: str = "---") -> Column:
    """Distinct codes of the place names in text, sorted.

    Names of at most short characters must not follow a letter, so that they don't match
    inside other words; longer ones match anywhere. Names of the code skip are left out. Two
    scans of the text, one for short names and one for long ones.
    """
    text = F.coalesce(text, F.lit(""))
    used = {n: c for n, c in names.items() if c != skip}
    brief, long = [n for n in used if len(n) <= short], [n for n in used if len(n) > short]
    there = [found_terms(text, part, behind) for part, behind in ((brief, f"(?<![{letter}])"), (long, "")) if part]
    if not there:
        return F.array().cast("array<string>")
    code = F.create_map(*(F.lit(x) for kv in used.items() for x in kv))
    return F.array_sort(F.array_distinct(F.transform(F.concat(*there), lambda n: F.element_at(code, n))))


def code_of(name: Column, codes: dict[str, str]) -> Column:
    """The code (or any other value) of a whole name, null if it isn't known."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in codes.items() for x in kv)), name) if codes else F.lit(None).cast("string")


def names_of_code(code: Column, codes: dict[str, str]) -> Column:
    """The names that have a code, in the dictionary's order; empty if it isn't known."""
    by: dict[str, list[str]] = {}
    for n, c in codes.items():
        by.setdefault(c, []).append(n)
    none = F.array().cast("array<string>")
    return F.coalesce(F.try_element_at(F.create_map(*(x for c, ns in by.items() for x in (F.lit(c), F.array(*map(F.lit, ns))))), code), none) if by else none


def recipients_only(names: dict[str, str], recipients: set[str] | None) -> dict[str, str]:
    """Names whose code is a recipient; all names if the recipients aren't known (None)."""
    return names if recipients is None else {n: c for n, c in names.items() if c in recipients}


def classify(df: DataFrame, short: Column, long: Column, lexicon: Lexicon, severity: list[str], supportive: list[str], opposed: list[str], frames: dict[str, list[str]], problems: list[str], solutions: list[str], crises: dict[str, list[str]], actors: list[str]) -> DataFrame:
    """df with the twelve dictionary columns, in one pass: counts are made once, the rest follows from them."""
    df = df.withColumns({"__short": short, "__long": long})
    df = df.withColumns({
        "__counts": occurrence_counts(F.col("__short"), lexicon), "__severity": occurrences(F.col("__long"), severity),
        "__for": occurrences(F.col("__long"), supportive), "__against": occurrences(F.col("__long"), opposed),
        "__problems": occurrences(F.col("__short"), problems), "__solutions": occurrences(F.col("__short"), solutions), "__frames": frame_counts(F.col("__long"), frames),
    })
    c = F.col("__counts")
    df = df.withColumns({"sdg_label": primary(c), "aid_stance": stance(F.col("__for"), F.col("__against"))})
    df = df.withColumns({
        "sdg_secondary": secondary(c, F.col("sdg_label")), "sdg_score": score(c), "sdg_intensity": intensity(c), "issue_intensity": issue_intensity(c, F.col("__severity")),
        "sdg_favorability": favourability(F.col("aid_stance")), "issue_frame": frame(F.col("__frames"), list(frames)), "problem_solution": problem_or_solution(F.col("__problems"), F.col("__solutions")),
        "crisis_type": F.array_join(matching(F.col("__long"), crises), ","), "policy_actor": holds(F.col("__long"), actors, any_case=True).cast("int"), "kw_hits": F.aggregate(c, F.lit(0), lambda a, x: a + x),
    })
    return df.drop(*(x for x in df.columns if x.startswith("__")))


def stratum(candidate: Column, any_place: Column) -> Column:
    return F.when(candidate, "candidate").when(any_place, "borderline").otherwise("negative")


def candidate(actor: Column, hits: Column, recipient: Column, vocabulary: Column, shared_sector: Column, min_hits: int = 1) -> Column:
    """An actor, or enough topic hits with a recipient, or the vocabulary, or a shared sector with a place."""
    return F.coalesce(actor | ((hits >= min_hits) & recipient) | vocabulary | shared_sector, F.lit(False))
