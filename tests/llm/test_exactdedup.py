"""Exact dedup against a plain dictionary, with tries too small for the data, odd rows and clashing names."""

import hashlib
import random
from collections import Counter

import pytest

from graphloom.llm.exactdedup import Trie, drop_copies, exact_copies

GONE = str.maketrans("", "", " \t\n\v\f\r")


def expected(rows):
    """(id, keep_id, size, kept, digest) of (id, text) rows, as a multiset."""
    groups = {}
    for key, text in rows:
        groups.setdefault((text or "").translate(GONE), []).append((key, len(text or "")))
    out = Counter()
    for body, members in groups.items():
        key, chars = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        for k, n in members:
            out[k, key, len(members), (k, n) == (key, chars), hashlib.sha256(body.encode()).hexdigest()] += 1
    return out


def found(df):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())


@pytest.mark.parametrize("trie_bytes", [16 << 20, 300])
def test_equals_a_dictionary(docs, rows, trie_bytes):
    """Nulls in every column, empty, blank and long texts, repeated rows, a null id, extra columns; also when subtrees leave all the time."""
    assert found(exact_copies(docs, trie_bytes=trie_bytes)) == expected([(r[0], r[1]) for r in rows])


def test_hot_text_blank_edits_and_shared_heads(spark):
    rng = random.Random(5)
    head = "shared head " * 40
    rows = [(k, head + str(k % 7)) for k in range(300)] + [(1000 + k, "one hot text") for k in range(3000)] + [(5000 + k, "one  hot\ttext" + " " * (k % 3)) for k in range(30)]
    rows += [(9000 + k, "".join(rng.choice("ab ") for _ in range(6))) for k in range(400)] + [(20000, "\x1c a"), (20001, "a"), (20002, "  a"), (20003, "x" * 200_000), (20004, "x" * 199_999 + "\ny")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(exact_copies(df, trie_bytes=2000, part_bytes=5000)) == expected(rows)


def test_ids_of_another_kind_and_empty_table(spark, nothing):
    df = spark.createDataFrame([("b", "t  t"), ("a", "t t "), (None, "tt  "), ("c", None)], "owner string, rows string")
    got = {(r["owner"], r["keep_id"], r["kept"]) for r in exact_copies(df, "owner", "rows").collect()}
    assert got == {("b", "a", False), ("a", "a", True), (None, "a", False), ("c", "c", True)}
    assert exact_copies(nothing).count() == 0 and drop_copies(nothing).count() == 0


def test_drop_copies_keeps_all_columns_and_one_row_of_each_text(spark):
    rows = [(1, "a b", {"k": 1}, "p"), (1, "a b", {"k": 1}, "p"), (2, "ab", None, None), (3, "c", {}, "q"), (None, "d", None, "r"), (4, "", None, None), (5, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, copy__id map<string,int>, copy__0 string")
    got = drop_copies(df)
    assert got.columns == df.columns
    assert Counter((r["doc_id"], r["text"], r["copy__0"]) for r in got.collect()) == Counter([(1, "a b", "p"), (3, "c", "q"), (None, "d", "r"), (4, "", None)])


def test_trie_equals_a_dictionary():
    rng = random.Random(2)
    trie, plain = Trie(), {}
    for k in range(3000):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randrange(12)))
        trie.insert(text, k % 5, k, 1)
        best = plain.setdefault(text, [k % 5, k, 0])
        if k % 5 > best[0]:
            best[:2] = k % 5, k
        best[2] += 1
    got = dict(trie.take(ord("a"))) | dict(trie.take())
    assert {t: o[:3] for t, o in got.items()} == plain and trie.held == 0
