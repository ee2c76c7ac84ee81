"""The near-dedup stage against groups of Jaccard similarity 0.8 or more, found by comparing all pairs of plain shingle sets."""

import random
import time
from collections import Counter

import corpus_pipeline as P
from conftest import SCHEMA, words
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint
from graphloom.llm.jaccard import keep_one_similar


def plain_set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def plain_survivors(pairs):
    """(id, text) -> the smallest id of each group, and how many pairs of different sets are similar."""
    of = {}
    for k, t in pairs:
        of.setdefault(plain_set(t), []).append((k is None, k or 0))
    sets = list(of)
    root, similar = list(range(len(sets))), 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 10 * min(len(a), len(b)) >= 8 * max(len(a), len(b)) and 10 * len(a & b) >= 8 * len(a | b):
                root[find(i)], similar = find(j), similar + bool(a)
    best = {}
    for i, s in enumerate(sets):
        best[find(i)] = min([best.get(find(i), (True, 10**18)), *of[s]])
    return Counter(None if none else k for none, k in best.values()), similar


def test_edge_cases(docs, rows):
    kept = keep_one_similar(docs)
    assert Counter(r["doc_id"] for r in kept.collect()) == plain_survivors([(r[0], r[1]) for r in rows])[0]
    assert kept.columns == docs.columns


def test_edited_copies(spark):
    """Copies with spread edits, at and around 0.8, in chains and in one large group."""
    rng = random.Random(5)
    pairs = []
    for k in range(150):
        base = words(100 + k, rng.choice([6, 12, 60, 200, 700]))
        for _ in range(rng.choice([1, 2, 4])):
            edited = list(base)
            for at in rng.sample(range(len(base)), min(len(base), round(len(base) * rng.choice([0, 0.005, 0.015, 0.02, 0.03])))):
                edited[at] = f"e{rng.randrange(10**6)}"
            pairs.append((len(pairs), " ".join(edited)))
    hot = words(99, 300)
    pairs += [(1000 + k, " ".join([*hot[:at], f"x{k}", *hot[at:]])) for k, at in enumerate(rng.choices(range(300), k=120))]
    pairs += [(2000, "a b c d e f g h"), (2001, "a b c d e f g h i")]  # 4 of 5 shingles: 0.8 itself
    docs = spark.createDataFrame([(k, t, *[None] * 10) for k, t in pairs], SCHEMA).repartition(5)
    want, similar = plain_survivors(pairs)
    assert similar > 1000
    assert Counter(r["doc_id"] for r in P.near_dedup(spark, docs.select(P.COLUMNS), "").collect()) == want


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, similar = plain_survivors([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert similar >= 5
    assert Counter(r["doc_id"] for r in P.near_dedup(spark, docs, "").collect()) == want


def test_shuffle_files_go_with_their_query(spark):
    """Before, those of all the steps stayed until the driver collected its garbage, over four times the input in all."""

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {f for f in found if "/shuffle_" in f}

    spark.conf.unset("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    assert keep_one_similar(spark.createDataFrame([(k, f"a b c d e f {k}") for k in range(20)], "doc_id bigint, text string")).count() == 20
    before = files()
    sums = spark.range(1000).repartition(5, "id").groupBy(F.col("id") % 7).count()
    assert checkpoint(sums).count() == 7 and sums.count() == 7
    for _ in range(25):  # they go in the background
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before
