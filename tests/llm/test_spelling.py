"""Spelling variants against all pairs of words by plain edit distance."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import spelling
from graphloom.llm.spelling import LETTERS, hashes, matrices, neighbourhood, near_pairs, spelling_variants, symbols

LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def near(a, b):
    """One insertion, deletion or replacement apart."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected(rows, every=None):
    count = Counter()
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    others = {w: [v for v in words if near(v, w)] for w in words}
    form = {}
    for w, some in others.items():
        best = min(some, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(others[w]), words.get(form[w])))
    return out


def found(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdéß") for _ in range(rng.randrange(5, 9))) for _ in range(40)]
    out = []
    for k in range(160):
        words = []
        for _ in range(60):
            w = base[int(rng.random() ** 2 * len(base))]
            if rng.random() < 0.4:
                p, c = rng.randrange(len(w)), rng.choice("abcdéß")
                w = rng.choice([w[:p] + w[p + 1 :], w[:p] + c + w[p + 1 :], w[:p] + c + w[p:]])
            words.append(rng.choice([w, w.title(), w.upper()]))
        out.append((k, " ".join(words) + rng.choice(["", ".", "\n9x9", "×÷ÀÿŸ"])))
    long = "q" * 3000
    out += [(900, None), (901, ""), (None, "Apples apples apples apple"), (902, f"{long} {long} {long} {long}q {long}q {long}q"), (0, out[0][1]), (0, out[0][1]), (903, "école École ÉCOLE ecole ecole ecole ecole éCole")]
    return out


@pytest.mark.parametrize("every", [None, 7, 97])
def test_equals_all_pairs(spark, texts, every):
    df = spark.createDataFrame([(k, t, "z", 1, 2) for k, t in texts], "doc_id long, text string, word string, n int, k int").repartition(5)
    assert found(spelling_variants(df, every=every)) == expected(texts, every)


def test_chain_and_ties(spark):
    counts = {"abcde": 3, "abcdef": 6, "abcdefg": 12, "abcdefgh": 24, "abcdefghi": 48, "zzzzz": 4, "zzzzy": 8, "zzzzx": 8, "lonely": 5}
    rows = [(1, " ".join(w for w, n in counts.items() for _ in range(n)))]
    got = found(spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == expected(rows)
    assert {(w, f, r) for w, f, r, *_ in got} >= {("abcde", "abcdef", "abcdefghi"), ("zzzzz", "zzzzx", "zzzzx"), ("lonely", None, "lonely")}


def test_crowded_reduced_words_take_a_larger_alphabet(spark):
    """Hundreds of words that share one word over the smallest alphabet still meet only near ones."""
    rng = random.Random(1)
    same = [c for c in LETTERS[:26] if symbols(4)[LETTERS.index(c)] == symbols(4)[0]]
    words = {"".join(rng.choice(same) for _ in range(7)) for _ in range(400)}
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    reduced, alphabet = spelling.reduced_to(df)
    assert len(alphabet) > 4
    got = {frozenset((r["word"], r["other"])) for r in near_pairs(df).collect()}
    assert got == {frozenset((a, b)) for a in words for b in words if a < b and near(a, b)}


def test_neighbourhood_is_full_and_has_no_string_twice():
    alphabet = "abc"
    for w in ("a", "aab", "abcab", "ccccc"):
        strings = {w} | {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k + j :] for k in range(len(w) + 1) for c in alphabet for j in (0, 1)}
        [(_, m)] = matrices([w], 100)
        rows, got = neighbourhood(m, np.array([ord(c) for c in alphabet], np.uint64))
        want = [int(hashes(np.array([[ord(c) for c in s]], np.uint64).reshape(1, len(s)))[0]) for s in strings]
        assert sorted(map(int, got)) == sorted(want)


def test_empty(nothing, spark):
    assert spelling_variants(nothing).count() == 0
    assert spelling_variants(spark.createDataFrame([(1, "a b c"), (2, "word")], "doc_id long, text string")).count() == 0
