"""Exact search over large components, mixed lengths and repeated ids, against Python's integers; url verdicts that don't hang on a table's size."""

import math

import pytest

from graphloom.llm.urltree import judge_urls
from graphloom.llm.vafile import exact_top_k

SCHEMA = "vec_id long, embedding array<float>"


def expected(rows, k):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    out = []
    for i, q in whole:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


def found(df, k):
    return sorted(tuple(r) for r in exact_top_k(df, df.where("vec_id % 50 = 0"), k).select("query_id", "rank", "vec_id", "score").collect())


def test_large_components_are_not_cut(spark):
    """All scores fit a long, so they must be right, at 64 components."""
    rows = [(0, [1.0] + [0.0] * 63)] + [(k + 1, [float(x)] + [0.5] * 63) for k, x in enumerate([4e7, 2e6, 1.5e6, -4e7, 3e12, 1e13])]
    df = spark.createDataFrame(rows, SCHEMA)
    import numpy as np

    exact = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert found(df, 3) == expected(exact, 3)


def test_a_score_beyond_a_long_is_an_error(spark):
    df = spark.createDataFrame([(0, [1e15, 0.0]), (1, [1e15, 1.0]), (2, [0.0, 1.0])], SCHEMA)
    with pytest.raises(Exception, match="(?i)overflow|out of range|cannot be represented"):
        found(df, 2)


def test_mixed_lengths_and_one_id_with_two_vectors(spark):
    rows = [(50, [1.0, 2.0]), (50, [3.0, -1.0]), (1, [1.0, 1.0]), (2, [0.0, 5.0]), (3, [1.0]), (4, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(df, 5)
    assert {r[2] for r in got} == {1, 2} and len(got) == 4
    assert sorted(r[3] for r in got) == sorted(256 * 256 * s for s in (3, 10, 2, -5))


def test_good_templates_stay_and_verdicts_hold_for_half_a_table(spark):
    rules = [("block", "net", "/es/"), ("block", "net", "/fr/")]
    urls = [f"http://h{h}.net/{lang}/{k}" for h in range(6) for lang in ("de", "en", "es", "fr") for k in range(7)]
    for n in (1, 2):
        pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls) if k % n == 0], "page_id long, url string")
        got = judge_urls(pages, rules).collect()
        assert all(r["verdict"] == ("block" if r["path"][:4] in ("/es/", "/fr/") else "allow") for r in got)
    pages = spark.createDataFrame([(k, f"http://bad.org/spam/{k}") for k in range(60)] + [(100 + k, f"http://good.org/a/{k}") for k in range(12)] + [(None, "http://good.org/a/x")], "page_id long, url string")
    labels = spark.createDataFrame([(k, 0) for k in range(60)] + [(100, 1), (101, 1), (102, 1)], "page_id long, good int")
    got = judge_urls(pages, [("block", "net", "/es/")], labels).collect()
    assert {r["verdict"] for r in got if r["host"] == "good.org"} == {"allow"} and {r["verdict"] for r in got if r["host"] == "bad.org"} == {"block"}
