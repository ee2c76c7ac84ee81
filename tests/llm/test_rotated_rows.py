"""How many pairs op8 reranks, and that sure bounds lose none of them."""

import numpy as np

from graphloom.llm.rotated import coarse, refine


def test_sure_bounds_hold():
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((500, 64)) * rng.choice([1e-6, 1, 1e6], (500, 1)), rng.standard_normal((20, 64))
    row, col = np.repeat(np.arange(20), 500), np.tile(np.arange(500), 20)
    level, step, far = coarse(x)
    low, high = refine(q, level, step.astype(float), far.astype(float), row, col)
    exact = ((q[row] - x[col]) ** 2).sum(axis=1)
    assert (low <= exact).all() and (exact <= high).all()


def test_reranked_pairs_follow_the_queries(spark):
    from graphloom.llm.rotated import candidates
    from graphloom.llm.vectors import distinct_rows, valid

    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.standard_normal((4000, 64)))], "vec_id long, embedding array<double>")
    own = distinct_rows(valid(df, "vec_id", "embedding"), 64)
    asked = distinct_rows(valid(df.where("vec_id % 100 = 0"), "vec_id", "embedding"), 64)
    assert 400 <= candidates(own, asked, 10, 64, 1.5, 7, 4096).count() <= 40 * 20
