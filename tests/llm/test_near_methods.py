"""SimHash's part in the near-dedup stage: with no band at all, close fingerprints still link similar sets, and only these."""

from conftest import SCHEMA, words
from pyspark.sql import functions as F

import corpus_pipeline as P
from graphloom.llm import jaccard
from graphloom.llm.simhash import fingerprint


def test_fingerprints_link_without_bands(spark):
    base = words(7, 900)
    near = [*base[:450], "edited", *base[451:]]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, "a b c d e f"), (4, "a b c d e f g"), (5, " ".join(words(8, 900))), (6, "q r q r q r q"), (7, "q r q r q r q r q r q r q")]
    assert bin((fingerprint(rows[0][1], 5) ^ fingerprint(rows[1][1], 5)) & (2**64 - 1)).count("1") <= 4
    docs = spark.createDataFrame([(k, t, *[None] * 10) for k, t in rows], SCHEMA).select(P.COLUMNS)
    own = jaccard.set_keys(docs, 5, "doc_id", "text")
    key = {r["doc_id"]: r["key"] for r in own.collect()}
    found = {(r["u"], r["v"]) for r in jaccard.fingerprint_pairs(own, 4).collect()}
    assert tuple(sorted((key[1], key[2]))) in found
    sets = own.select("key", "n", "bands", "sketch").dropDuplicates(["key"]).withColumn("bands", F.array().cast("array<bigint>"))
    text = own.select("doc_id", "key").join(docs.select("doc_id", "text"), "doc_id")
    first, second = jaccard.jaccard_roots(sets, jaccard.fingerprint_pairs(own, 4), lambda keys: jaccard.grams_of(text.join(keys, "key").dropDuplicates(["key"]), 5), 0.8)
    assert {r["node"] for r in first.collect()} == {key[1], key[2]} and second.count() == 0
