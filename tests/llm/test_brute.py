"""Operators against SQL, brute force, exact round trips or held-out labels."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from lodeframe.llm import bpe, chat, decontam, imatch, langid, licenses, near_join, pii, repeats
from lodeframe.llm.queries import ORACLE, QUERIES
from tests.support import rows_of, rows_of_sql

WORD = re.compile(r"[^\W_]+")


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, duck, sf, name):
    assert rows_of(QUERIES[name](spark, sf)) == rows_of_sql(duck, ORACLE[name])


def sets_of(texts, n=2):
    out = {}
    for i, t in texts.items():
        w = WORD.findall(t.lower())
        if w:
            out[i] = frozenset(zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)])
    return out


def all_near(texts, t=0.55):
    s = sets_of(texts)
    return {(a, b) for a, b in itertools.combinations(sorted(s), 2) if len(s[a] & s[b]) >= t * len(s[a] | s[b]) - 1e-12}


def test_every_pair_of_the_jaccard_join(spark, texts):
    """Edited copies at every rate beside the real documents: recall 0.9 or more, no false pair."""
    rng = random.Random(5)
    more = dict(texts)
    for k, (i, t) in enumerate(list(texts.items())[:120]):
        w = t.split()
        for j in range(max(1, int(len(w) * rng.choice([0.02, 0.05, 0.1, 0.15])))):
            w[rng.randrange(len(w))] = f"new{j}"
        more[10_000 + k] = " ".join(w)
    df = spark.createDataFrame(list(more.items()), "doc_id long, text string")
    want = all_near(more)
    got = {(r.doc_id_a, r.doc_id_b) for r in near_join.expand_pairs(near_join.near_pairs(df)).select("doc_id_a", "doc_id_b").collect()}
    assert got <= want and len(got) >= 0.97 * len(want)


def test_parity_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (set(rng.integers(0, 400, rng.integers(1, 300)).tolist()) for _ in "ab")
        x, y = (near_join.sketches(np.array(sorted(s), np.uint64), np.zeros(len(s), np.int64), 1) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(a ^ b)


def test_similar_pairs_against_sets():
    """All pairs, pairs across two sides, and as many as connect, of random sets of few grams."""
    rng = random.Random(14)
    for _ in range(150):
        sets = [frozenset(rng.sample(range(14), rng.randrange(1, 12))) for _ in range(rng.randrange(2, 14))]
        side = np.array([rng.randrange(2) for _ in sets]) if rng.random() < 0.5 else np.full(len(sets), 2)
        flat = np.array([x for s in sets for x in sorted(s)], np.uint64)
        sizes = np.array([len(s) for s in sets])
        want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(sets[i] & sets[j]) >= 0.55 * len(sets[i] | sets[j]) and (side[i] == 2 or side[i] != side[j])}
        i, j, similar = near_join.similar_pairs(flat, sizes, side, 0.55, False)
        got = {tuple(sorted(x)) for x in zip(i.tolist(), j.tolist(), strict=True)}
        assert got == want and len(i) == len(want)
        for x, y, v in zip(i, j, similar, strict=True):
            assert v == len(sets[x] & sets[y]) / len(sets[x] | sets[y])
        i, j, _ = near_join.similar_pairs(flat, sizes, side, 0.55, True)
        some = {tuple(sorted(x)) for x in zip(i.tolist(), j.tolist(), strict=True)}
        assert some <= want and components_of(some) == components_of(want) and len(some) == len(components_of(want)) - len(set(components_of(want).values()))


def test_split_keys_and_squares_give_the_same_pairs(spark, texts, monkeypatch):
    """Keys of over 6 documents, and groups of over a few grams, are cut to pieces: no pair is lost or doubled."""
    base = "one two three four five six seven eight nine ten".split()
    more = {k: t for k, t in texts.items() if len(t) < 2000}
    more |= {90_000 + k: " ".join(base[: k % 7] + [f"x{k}"] + base[k % 7 :]) for k in range(70)}
    df = spark.createDataFrame(list(more.items()), "doc_id long, text string")
    plain = sorted(tuple(r) for r in near_join.near_pairs(df).collect())
    assert {(a, b) for a, b, _ in plain if b >= 90_000} == {x for x in all_near({k: t for k, t in more.items() if k >= 90_000})}
    for name, value in (("MET", 6), ("GRAMS", 50), ("WORK", 300)):
        monkeypatch.setattr(near_join, name, value)
    assert sorted(tuple(r) for r in near_join.near_pairs(df).collect()) == plain
    spanning = {(r.doc_id_a, r.doc_id_b) for r in near_join.near_pairs(df, spanning=True).collect()}
    assert components_of(spanning) == components_of([(a, b) for a, b, _ in plain])


def components_of(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    df = spark.createDataFrame([(a, b) for a, b in pairs if a != b], "doc_id_a long, doc_id_b long")
    assert {r.doc: r.root for r in near_join.components(df).collect()} == components_of([(a, b) for a, b in pairs if a != b])


def plain_alignment(a, b):
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(3)
    for _ in range(40):
        a = rng.integers(0, 6, rng.integers(1, 15)).astype(np.uint64)
        p = rng.integers(0, 6, (4, 25)).astype(np.uint64)
        score, first, end = decontam.smith_waterman(a, p, np.ones(p.shape, bool))
        for k in range(4):
            assert score[k] == plain_alignment(a, p[k]) == plain_alignment(a, p[k][first[k] : end[k]])


def test_leaks_against_brute_force(spark, sf, texts):
    """Every item against every document, exact and with a fifth of the words edited."""
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r.item_id: WORD.findall(r.text.lower()) for r in bench.collect()}
    rng = random.Random(4)
    more = dict(list(texts.items())[:60])
    for k, w in items.items():
        w = [x if rng.random() > 0.2 else f"edit{rng.randrange(99)}" for x in w]
        more[20_000 + k] = "before it " + " ".join(w) + " and after it"
    df = spark.createDataFrame(list(more.items()), "doc_id long, text string")
    want = set()
    for d, t in more.items():
        w = WORD.findall(t.lower())
        for k, item in items.items():
            if len(set(w) & set(item)) >= len(item) / 3 and plain_alignment(item, w) >= 0.5 * 2 * len(item):
                want.add((d, k))
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) >= 0.8 * len(items)


def test_leaks_with_insertions_and_deletions(spark):
    """Items with stretches of new words inside, words left out and words changed, in the midst of other text."""
    rng = random.Random(15)
    items = {k: [f"w{rng.randrange(400)}" for _ in range(rng.randrange(8, 90))] for k in range(12)}
    docs = {}
    for k, item in items.items():
        for c in range(8):
            new = list(item)
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(new) + 1)
                new[at:at] = [f"new{rng.randrange(99)}" for _ in range(rng.randrange(1, len(item) // 2 + 2))]
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(new))
                del new[at : at + rng.randrange(1, 6)]
            new = [x if rng.random() > 0.08 else f"edit{rng.randrange(9)}" for x in new]
            docs[100 * k + c] = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(40))] + new + [f"w{rng.randrange(400)}" for _ in range(rng.randrange(40))]
    threes = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    want = {}
    for d, w in docs.items():
        for k, item in items.items():
            best = plain_alignment(item, w)
            if best >= len(item) and threes(item) & threes(w):
                want[d, k] = best / (2 * len(item))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in items.items()], "item_id long, text string")
    rows = decontam.leaks(spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string"), bench, part_words=150).collect()
    got = {(r.doc_id, r.item_id): r.score for r in rows}
    assert got == want and len(rows) == len(want) > 60
    for r in rows:
        assert plain_alignment(items[r.item_id], docs[r.doc_id][r.first_word : r.end_word]) == round(r.score * 2 * len(items[r.item_id]))


def test_language_on_held_out_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 and n_chars > 40")
    rows = langid.identify(test, langid.fit(train)).join(test.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.pred_lang == r.lang for r in rows]) > 0.97
    assert np.mean([r.accepted for r in rows]) > 0.97


def profile_of(text, dim=256, n=3, seed=7):
    """A text's profile by the docstring: letters of n-grams bound one by one, rotated by their place, and summed."""
    spaced = "".join(c if c.isalpha() else " " for c in text.lower())
    padded = f" {' '.join(spaced.split())} "
    total, vectors = np.zeros(dim), {}
    for i in range(len(padded) - n + 1) if padded.strip() else ():
        bound = np.ones(dim)
        for k, c in enumerate(padded[i : i + n]):
            if c not in vectors:
                vectors[c] = langid.letters(np.array([ord(c)]), dim, 1, seed)[0, 0]
            bound *= np.roll(vectors[c], k)
        total += bound
    return total


def test_profiles_are_bound_and_bundled_letters():
    import pyarrow as pa

    odd = ["Ab", None, "1!", "", "a", "Ab  c-d", "\u043f\u0440\u0438\u0432\u0435\u0442 \u043c\u0438\u0440", "".join(map(chr, range(0x4E00, 0x4E00 + 500))), "\U00010400\U00010401 x", "stra\u00dfe \u00c9t\u00e9"]
    found, grams = langid.profiles(pa.array(odd), 256, 3, 7)
    for k, t in enumerate(odd):
        assert np.array_equal(found[k], profile_of(t or ""))
    assert grams.tolist()[:5] == [2, 0, 0, 0, 1]


def test_letters_have_their_own_vectors():
    """No two letters of any alphabet share a vector or are far from orthogonal."""
    points = np.array([32, *range(97, 123), *range(0xE0, 0xFF), *range(0x391, 0x3CA), *range(0x410, 0x450), *range(0x5D0, 0x5EB), *range(0x4E00, 0x4F00)])
    v = langid.letters(points, 1024, 1, 7)[0]
    same = v @ v.T / 1024
    assert np.abs(same - np.eye(len(points))).max() < 0.2


def test_nearest_prototype_by_brute_force(spark, sf, texts):
    """The language, cosine and margin of each text by plain arithmetic; Greek and Cyrillic beside the four languages."""
    rng = random.Random(13)
    alphabets = {"el": range(0x3B1, 0x3CA), "ru": range(0x430, 0x450)}
    more = [(50_000 + k, " ".join("".join(chr(rng.choice(alphabets[lang])) for _ in range(rng.randrange(2, 9))) for _ in range(60)), lang) for k, lang in enumerate(["el", "ru"] * 20)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").where("doc_id % 3 = 0").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    prototypes = langid.fit(docs, dim=256)
    assert set(prototypes) >= {"el", "ru", "en"}
    rows = {r.doc_id: r for r in langid.identify(docs, prototypes, dim=256).collect()}
    for i, t, lang in more[:10] + [(i, texts[i], None) for i in list(texts)[::60] if i % 3 == 0 and len(texts[i]) < 3000]:
        p = profile_of(t)
        cosines = sorted(((float(p @ v) / max(np.linalg.norm(p), 1e-9), k) for k, v in prototypes.items()), key=lambda x: (-x[0], x[1]))
        if abs(cosines[0][0] - cosines[1][0]) > 1e-5 and p.any():
            assert rows[i].pred_lang == cosines[0][1] and lang in (None, rows[i].pred_lang)
        assert abs(rows[i].cosine - cosines[0][0]) < 1e-4 and abs(rows[i].margin - (cosines[0][0] - cosines[1][0])) < 1e-4


def test_tokens_are_those_of_another_encoder(texts):
    import tiktoken

    e = bpe.encoder(bpe.VOCABULARY)
    other = tiktoken.Encoding("x", pat_str=bpe.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    rng = random.Random(6)
    odd = ["".join(rng.choice(["a", " ", "  ", "\n", "\t", "'ll", "é", "1", "!", "日", "<|endoftext|>"]) for _ in range(rng.randrange(14))) for _ in range(3000)]
    for t in [*texts.values(), *odd]:
        ids = e.encode(t)
        assert ids == other.encode_ordinary(t) and e.decode(ids).decode() == t


def expression(nodes):
    """A parsed template as a regular expression over words with a blank behind each."""
    out = ""
    for kind, x in nodes:
        if kind == "word":
            out += re.escape(x) + " "
        elif kind == "optional":
            out += f"(?:{expression(x)})?"
        else:
            low, high, pattern = x
            out += f"(?:(?:{pattern.pattern if pattern else '[^ ]+'}) ){{{low},{'' if high is None else high}}}?"
    return out


def found_by_expression(template, words):
    text = "".join(f"{w} " for w in words)
    spans = [m.span() for m in re.finditer("(?<![^ ])" + expression(licenses.parse_template(template)), text)]
    return [(text[:a].count(" "), text[:b].count(" ")) for a, b in spans]


def render(tree):
    out = []
    for kind, x in tree:
        out.append(x if kind == "word" else f"<<beginOptional>> {render(x)} <<endOptional>>" if kind == "optional" else f'<<var;name="v";original="o";match="{x}">>')
    return " ".join(out)


def test_automata_against_expressions():
    """Nested optional regions and bounded, open and patterned variables, at the begin and the end too."""
    rng = random.Random(7)

    def tree(depth):
        out = [("word", rng.choice("ab"))]
        for _ in range(rng.randrange(1, 4)):
            k = rng.random()
            out.append(("word", rng.choice("ab")) if k < 0.5 else ("var", rng.choice([".+", ".*", ".{0,2}", ".{1,3}", "[ac]"])) if k < 0.75 or not depth else ("optional", tree(depth - 1)))
        rng.shuffle(out)
        return out

    for _ in range(3000):
        x = tree(2)
        if any(kind == "word" for kind, _ in x):
            words = [rng.choice("abc") for _ in range(rng.randrange(1, 14))]
            assert licenses.find(words, licenses.compile_template(render(x))) == found_by_expression(render(x), words)


def test_scan_against_expressions(spark):
    """Every template in generated texts: regions left out, variables of up to 150 words, altered words, several in a text."""
    rng = random.Random(17)

    def written(nodes):
        out = []
        for kind, x in nodes:
            if kind == "word":
                out.append(x)
            elif kind == "optional":
                out += written(x) if rng.random() < 0.5 else []
            else:
                low, high, pattern = x
                fit = pattern and next(w for w in ("alike", "2024") if pattern.fullmatch(w))
                out += [fit or f"name{rng.randrange(9)}" for _ in range(1 if pattern else rng.randint(low, min(high or 150, 150)))]
        return out

    docs = []
    for name, template in licenses.TEMPLATES.items():
        for k in range(6):
            words = []
            for part in [name, *([] if k < 3 else [rng.choice(list(licenses.TEMPLATES))])]:
                words += [f"w{rng.randrange(50)}" for _ in range(rng.randrange(4))] + written(licenses.parse_template(licenses.TEMPLATES[part]))
            if k % 3 == 2:
                words[rng.randrange(len(words))] = "altered"
            docs.append((len(docs), " ".join(words).title() + "."))
    want = {(i, name, a, b) for i, t in docs for name, template in licenses.TEMPLATES.items() for a, b in found_by_expression(template, WORD.findall(t.lower()))}
    got = [tuple(r) for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert set(got) == want and len(got) == len(want) and {x[1] for x in got} == set(licenses.TEMPLATES)


def test_license_lines_are_found(spark, sf, texts):
    want = Counter()
    for i, t in texts.items():
        for line, name in (("Released under the MIT License.", "MIT"), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0")):
            if line in t:
                want[i, name] += t.count(line)
    got = Counter((r.doc_id, r.license_id) for r in QUERIES["op7_license_scan"](spark, sf).collect())
    assert got == want


def bootstrap(texts, confidence=0.85, support=10):
    """The pattern-instance graph in plain Python."""
    seen = [(i, *o) for i, t in texts.items() if t for o in pii.occurrences(t)]
    patterns = defaultdict(set)
    for _, _, _, entity, _, ps in seen:
        for p in ps:
            patterns[p].add(entity)
    seeds = {(e, k) for _, _, _, e, k, _ in seen if k}
    scores = {e: (1.0, k) for e, k in seeds}
    while True:
        known, trusted = len(scores), {}
        for p, es in patterns.items():
            total = Counter()
            for e in es:
                if e in scores:
                    total[scores[e][1]] += scores[e][0]
            good = [(round(v / (len(es) + 1), 6), k) for k, v in total.items() if len(es) >= support and round(v / (len(es) + 1), 6) >= confidence]
            if good:
                trusted[p] = max(good)
        new = {}
        for p, s in trusted.items():
            for e in patterns[p]:
                new[e] = max(new.get(e, s), s)
        for e, k in seeds:
            new[e] = max(new.get(e, (1.0, k)), (1.0, k))
        scores = new
        if len(scores) <= known:
            return {(i, b, s, scores[e][1], e, scores[e][0]) for i, b, s, e, _, _ in seen if e in scores}


def plain_occurrences(text):
    """Candidates, shapes and contexts by the docstring, for texts without joined strings and digit groups."""
    out, at = [], 0
    for string in text.split(" "):
        core = string.strip("\"'.,;:!?()")
        begin = at + string.index(core) if core else at
        at += len(string) + 1
        if not any(c.isdigit() or c == "@" for c in core):
            continue

        def shape(lengths, core=core):
            done = ""
            for run in re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9]", core):
                kind = "9" if run.isdigit() else "a" if run.isalpha() else "x" if run.isalnum() else run
                done += f"{kind}{len(run)}" if lengths and kind in "9x" else kind
            return done

        before, after = WORD.findall(text[:begin].lower())[-2:], WORD.findall(text[begin + len(core) :].lower())[:1]
        patterns = {f"S {shape(True)}", f"s {shape(False)}", *(f"R {shape(False)} _ {x}" for x in after)}
        patterns |= {f"L {before[-1]} _ {shape(False)}"} if before else set()
        patterns |= {f"LL {before[0]} {before[1]} _ {shape(False)}"} if len(before) == 2 else set()
        out.append((begin, begin + len(core), core, sorted(patterns)))
    return out


def test_candidates_and_contexts_against_plain_ones():
    rng = random.Random(18)
    parts = ["the", "Account", "x" * 90, "no.", "mail", "jo@ex.com", "(al.b@ex.org)", "4471-QX", "A12b;", "v2,", "10.0.0.7", "!", "card"]
    for _ in range(400):
        text = " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))
        assert [(b, e, x, p) for b, e, x, _, p in pii.occurrences(text)] == plain_occurrences(text)


def card(rng, valid=True):
    digits = [4, *(rng.randrange(10) for _ in range(14))]
    for last in range(10):
        number = "".join(map(str, [*digits, last]))
        if pii.seed_kind(number) == "card":
            return number if valid else "".join(map(str, [*digits, (last + 1) % 10]))


def test_identifiers_against_brute_force(spark, texts):
    """Card numbers with a wrong check digit become known by their context."""
    rng = random.Random(8)
    more = dict(texts)
    for k in range(40):
        more[30_000 + k] = f"text {k} with employee card {card(rng, k % 8 != 7)} in it"
    got = {tuple(r) for r in pii.identifiers(spark.createDataFrame(list(more.items()), "doc_id long, text string")).collect()}
    want = bootstrap(more)
    assert {(x[:5], round(x[5], 5)) for x in got} == {(x[:5], round(x[5], 5)) for x in want}


def test_identifiers_that_are_no_seeds_are_discovered(spark):
    """A number with a wrong check digit, and then a member number that only shares a context with such ones."""
    rng = random.Random(19)
    rows = [(k, f"paid with card {card(rng)} today") for k in range(40)]
    unseen = {100 + k: card(rng, False) for k in range(3)}
    rows += [(k, f"paid with card {x} today") for k, x in unseen.items()]
    rows += [(200 + k, f"order {k} of version 2.{k} took {k * 7} minutes") for k in range(60)]
    got = {r.doc_id: r for r in pii.identifiers(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.keys() == {*range(40), *unseen}
    for k, x in unseen.items():
        assert pii.seed_kind(x) is None and got[k].entity == x and got[k].kind == "card" and 0.85 <= got[k].score < 1


def test_known_identifiers_of_several_kinds(spark):
    rows = [(k, f"my phone +1 (0{k % 90 + 10}) 555-{1000 + k} is here") for k in range(30)] + [(100, "version 2.0 and 3.1"), (101, "token = \"" + "ab12" * 10 + "\"")]
    got = {r.doc_id: r.kind for r in pii.identifiers(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got.keys() >= {*range(30), 101} and 100 not in got and got[0] == "phone" and got[101] == "key"


def test_spans_are_whole_turns_within_budget():
    rng = random.Random(9)
    for _ in range(200):
        tokens = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 15))]
        prefix = np.concatenate([[0], np.cumsum(tokens)])
        room, history = rng.randrange(20, 120), rng.randrange(0, 50)
        got = chat.spans(prefix, room, history)
        assert [x for _, b, e, _ in got for x in range(b, e)] == list(range(len(tokens)))
        for h, b, e, over in got:
            assert sum(tokens[h:b]) <= history and over == (sum(tokens[h:e]) > room)
            assert e == len(tokens) or over or sum(tokens[h : e + 1]) > room


def test_winnowing_keeps_the_lowest_of_each_run():
    rng = np.random.default_rng(10)
    for n in (0, 1, 5, 24, 25, 26, 200):
        h = rng.integers(0, 50 if n == 200 else 1 << 60, n).astype(np.uint64)
        got = repeats.winnow(h, 25)
        want = {i for s in range(max(1, n - 24)) for i in range(s, min(s + 25, n)) if h[i] == h[s : s + 25].min()}
        assert set(got.tolist()) == (want if n else set())


def test_fingerprints_of_copies_agree(spark, sf, texts):
    rows = {r.doc_id: r for r in QUERIES["op5_imatch_fingerprints"](spark, sf).collect()}
    by = defaultdict(list)
    for i, t in texts.items():
        by[" ".join(sorted(imatch.terms(t)))].append(i)
    assert any(len(x) > 1 for x in by.values())
    for group in by.values():
        assert len({tuple(rows[i])[1:] for i in group}) == 1


def test_pipeline_against_brute_force(spark, sf, texts):
    """The rows of run(): what a plain reading of the stages' rules leaves, with masked and encoded texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ok = {r.doc_id for r in langid.identify(docs, langid.fit(docs)).where("accepted").collect()}
    left = {i: texts[i] for i in ok}
    root = components_of(all_near(left))
    left = {i: t for i, t in left.items() if root.get(i, i) == i}
    items = [WORD.findall(r.text.lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = set()
    for i, t in left.items():
        w = WORD.findall(t.lower())
        have = set(w)
        if any(len(have & set(x)) >= len(set(x)) / 3 and plain_alignment(x, w) >= len(x) for x in items):
            held.add(i)
    left = {i: t for i, t in left.items() if i not in held}
    spans = defaultdict(list)
    for i, b, s, kind, e, _ in bootstrap(left):
        spans[i].append((b, s, kind, e))
    e = bpe.encoder(bpe.VOCABULARY)
    want = {i: e.encode(pii.mask_text(t, spans[i])) for i, t in left.items()}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.token_ids for r in rows} == want and all(r.round_trip for r in rows) and len(rows) == len(want)
