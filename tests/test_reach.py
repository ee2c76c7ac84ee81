"""Reachability under random changes equals recomputation; numbering in more than one task."""

import random

import pytest

from graphloom.operators import reach
from graphloom.operators.scan import numbered

PAIRS = "a string, b string"


def plain(steps, roots):
    out = {}
    for r in roots:
        todo, seen = [r], {r}
        while todo:
            x = todo.pop()
            for a, b in steps:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
        for x in seen:
            out.setdefault(x, set()).add(r)
    return {x: sorted(rs) for x, rs in out.items()}


def named(state):
    return {r["id"]: r["roots"] for r in state.named().collect()}


@pytest.mark.parametrize("seed", [1])
def test_random_changes_with_cycles(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{k}" for k in range(14)]
    steps = {(rng.choice(nodes), rng.choice(nodes)) for _ in range(22)}
    roots = set(rng.sample(nodes, 4))
    frame = lambda rows, schema: spark.createDataFrame(sorted(rows), schema)
    state = reach.build(frame(steps, PAIRS), frame([(r,) for r in roots], "id string"))
    assert named(state) == plain(steps, roots)
    for _ in range(2):
        gone, new = set(rng.sample(sorted(steps), 5)), {(rng.choice(nodes), rng.choice(nodes)) for _ in range(2)}
        lost, fresh = {rng.choice(sorted(roots))}, {rng.choice(nodes)}
        steps, roots = (steps - gone) | new, (roots - lost) | fresh
        state = reach.update(state, frame(new, PAIRS), frame(gone, PAIRS), frame([(r,) for r in fresh], "id string"), frame([(r,) for r in lost], "id string"))
        assert named(state) == plain(steps, roots)


def test_cycle_that_loses_its_only_entry_is_gone(spark):
    state = reach.build(spark.createDataFrame([("r", "x"), ("x", "y"), ("y", "x"), ("r", "z")], PAIRS), spark.createDataFrame([("r",)], "id string"))
    none = spark.createDataFrame([], PAIRS)
    state = reach.update(state, none, spark.createDataFrame([("r", "x")], PAIRS))
    assert named(state) == {"r": ["r"], "z": ["r"]}


def test_more_roots_than_a_word(spark):
    roots = [(f"r{k:03}",) for k in range(150)]
    state = reach.build(spark.createDataFrame([(r[0], "hub") for r in roots] + [("hub", "end")], PAIRS), spark.createDataFrame(roots, "id string"))
    assert state.bits.where("id = 'end'").count() == 3
    assert named(state)["end"] == sorted(r[0] for r in roots)
    empty = reach.build(spark.createDataFrame([], PAIRS), spark.createDataFrame([], "id string"))
    assert named(empty) == {}


def test_numbers_follow_the_order_in_several_tasks(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(50), f"v{rng.randrange(9)}", k) for k in range(5000)] + [(None, "x", -1)]
    df = spark.createDataFrame(rows, "a int, b string, k int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are read by one task
    out = numbered(df, ["a", "b", "k"], "place", first=1)
    assert out.rdd.getNumPartitions() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = [(r["a"], r["b"], r["k"]) for r in sorted(out.collect(), key=lambda r: r["place"])]
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r)) and sorted(r["place"] for r in out.collect()) == list(range(1, 5002))
    assert numbered(df.limit(0), ["a"], "place").count() == 0
