"""Mixing sources to target weights: raking by iterative proportional fitting, then calibrated sampling."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import WORD, checkpoint, remove, salted_join, written

#: Topics by what a text is full of: the marks of each, counted per thousand words.
TOPICS = {"symbols": ["%%%", " | ", "# ", "* "], "contact": ["@"], "licence": ["icense", "icence"], "settings": ["password", "="], "question": ["?"]}
OTHER, LEAST_MARKS = "prose", 5
MARGINS = ("source", "lang", "topic")
#: Cells of one partition; below it a round needs no exchange.
CELLS = 1_000_000


def topic_of(text: Column, tokens: Column, topics: dict[str, list[str]] = TOPICS, other: str = OTHER, least: float = LEAST_MARKS) -> Column:
    """The topic with the most marks, the first of equals; `other` with fewer than `least` marks in a thousand words."""
    count = lambda mark: F.floor((F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark))
    marks = {name: reduce(lambda a, b: a + b, map(count, some)) for name, some in topics.items()}
    best = F.greatest(*marks.values(), F.lit(0))
    found = F.lit(other)
    for name in reversed(marks):
        found = F.when(marks[name] == best, name).otherwise(found)
    return F.when((best > 0) & (best * 1000 >= F.greatest(tokens, F.lit(1)) * least), found).otherwise(other)


def unit(key: Column) -> Column:
    """A number in [0, 1) from 60 bits of a key's MD5: a sample that is the same in every run."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint").cast("double") / float(1 << 60)


def targets_of(cells: DataFrame, margin: str, power: float, given: dict[str, float] | None) -> DataFrame:
    """(margin, target) of the values that have tokens, summing to 1.

    Values in `given` get their weight; what these leave of 1 goes to the others in proportion to
    their tokens raised to `power`. Weights of values without tokens fall to all the rest.
    """
    given = given or {}
    shares = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0")
    named = F.lit(None).cast("double")
    for value, weight in given.items():
        named = F.when(F.col(margin) == value, F.lit(float(weight))).otherwise(named)
    shares = shares.withColumn("named", named).withColumn("t", F.when(F.col("named").isNull(), F.pow("t", F.lit(power))).otherwise(0.0))
    shares = shares.crossJoin(F.broadcast(shares.agg(F.sum("t").alias("rest"))))  # one row
    raw = shares.select(margin, F.coalesce("named", F.coalesce(F.try_divide("t", "rest"), F.lit(0.0)) * max(0.0, 1 - sum(given.values()))).alias("raw"))
    return raw.crossJoin(F.broadcast(raw.agg(F.sum("raw").alias("all")))).select(margin, F.coalesce(F.try_divide("raw", "all"), F.lit(0.0)).alias("target"))


def totals(cells: DataFrame, margin: str, alone: bool) -> DataFrame:
    """cells with `have`, the weight of their value of a margin: by a window where all cells are in one partition, else by a join."""
    if alone:
        return cells.withColumn("have", F.sum("weight").over(Window.partitionBy(margin)))
    return cells.join(cells.groupBy(margin).agg(F.sum("weight").alias("have")), margin)


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float, max_rounds: int) -> tuple[DataFrame, float]:
    """(cells (margins, tokens, ...) with weight, error): tokens fitted to the targets of one margin after another.

    Rounds go on until no margin is further than `tolerance` from a target, as a share of all
    weight, or max_rounds have passed, as where targets contradict each other; `error` is what is
    left. The cells are the combinations of margin values that occur: far fewer than documents.
    They are written to the checkpoint folder after every few rounds; up to CELLS of them are one
    partition, in which a round needs no exchange, and beyond they are aggregated and joined.
    """
    parts = max(1, math.ceil(cells.count() / CELLS))
    rounds, columns, old, error = 8 if parts == 1 else 1, [*cells.columns, "weight"], None, 0.0
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for margin, target in targets.items():
        now = now.join(target.withColumnRenamed("target", f"target_{margin}"), margin, "left").withColumn(f"target_{margin}", F.coalesce(f"target_{margin}", F.lit(0.0)))
    for done in range(0, max_rounds, rounds):
        now = now.coalesce(parts)
        for _ in range(rounds):
            for margin in targets:
                now = totals(now, margin, parts == 1).withColumn("weight", F.col("weight") * F.coalesce(F.try_divide(f"target_{margin}", "have"), F.lit(0.0))).drop("have")
        now, path = written(now)
        if old:
            remove(cells.sparkSession, old)
        old, off = path, now.coalesce(parts)
        for margin in targets:
            off = totals(off, margin, parts == 1).withColumn(f"off_{margin}", F.abs(F.col("have") - F.col(f"target_{margin}"))).drop("have")
        error = off.agg(F.coalesce(F.greatest(*(F.max(f"off_{m}") for m in targets)), F.lit(0.0))).first()[0]
        if error <= tolerance:
            break
    now = checkpoint(now.select(*columns))
    remove(cells.sparkSession, old)
    return now, error


def calibrate(cells: DataFrame, budget: float) -> DataFrame:
    """cells with prob = min(1, s * weight / tokens), s such that the expected tokens meet the budget.

    Each step settles the cells that are full at the present s and gives the rest of the budget to
    the others; s only grows, and the steps end when no further cell is full.
    """
    ratio = F.coalesce(F.try_divide("weight", F.col("tokens").cast("double")), F.lit(0.0))
    cells, scale, before = cells.withColumn("ratio", ratio), float(budget), None
    while True:
        full = F.col("ratio") * scale >= 1
        fixed, rest, n = cells.agg(F.sum(F.when(full, F.col("tokens").cast("double")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("ratio"))), F.count_if(full)).first()
        if not rest or n == before:
            return cells.withColumn("prob", F.least(F.lit(1.0), F.col("ratio") * scale))
        scale, before = max(0.0, (budget - fixed) / rest), n


def mix(
    docs: DataFrame,
    keep_share: float = 0.9,
    power: float = 0.7,
    tolerance: float = 1e-10,
    max_rounds: int = 200,
    targets: dict[str, dict[str, float]] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
) -> DataFrame:
    """docs and mix__source, mix__lang, mix__topic, mix__tokens, mix__prob, mix__kept, mix__error for every row.

    Tokens are words. Their counts per (source, language, topic) are raked to target shares of each
    margin: targets[margin][value] where given, the rest shared by the other values in proportion
    to their tokens raised to `power`, which lifts the small ones (targets_of). Raking ends at
    `tolerance`; mix__error is the largest distance from a target that is left. A document is kept
    with its cell's probability, in proportion to weight over tokens, at most 1, such that
    keep_share of all tokens are expected to stay; a hash of its id decides, so runs agree and
    repeated rows share a fate.

    The topic is that of the marks a text is full of (topic_of), a rule rather than a learned model.
    A null source or language is the value ''; a null text has no tokens and topic prose. Documents
    without words weigh nothing and are kept if their cell is (with probability 1 if the cell has no
    tokens). A null id hashes as ''. Other columns pass through; columns named mix__... are
    replaced. No rows give no rows.
    """
    rest = docs.select(*(F.col(f"`{c}`") for c in docs.columns if not c.startswith("mix__")))
    tokens = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("bigint")
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    marked = rest.select("*", name(source_col).alias("mix__source"), name(lang_col).alias("mix__lang"), tokens.alias("mix__tokens"))
    marked = marked.withColumn("mix__topic", topic_of(F.coalesce(F.col(text_col), F.lit("")), F.col("mix__tokens")))
    cells = checkpoint(marked.groupBy(*(F.col(f"mix__{m}").alias(m) for m in MARGINS)).agg(F.sum("mix__tokens").alias("tokens")))
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    aims = {m: checkpoint(targets_of(cells.coalesce(max(1, math.ceil(cells.count() / CELLS))), m, power, (targets or {}).get(m))) for m in MARGINS}
    raked, error = rake(cells, aims, tolerance, max_rounds)
    probs = calibrate(raked, keep_share * total)
    probs = probs.select(*(F.col(m).alias(f"mix__{m}") for m in MARGINS), F.when(F.col("tokens") > 0, F.col("prob")).otherwise(1.0).alias("mix__prob"))
    return salted_join(marked, probs, [f"mix__{m}" for m in MARGINS], id_col).select(
        *(F.col(f"`{c}`") for c in rest.columns), *(f"mix__{c}" for c in ("source", "lang", "topic", "tokens", "prob")), (unit(F.col(id_col)) < F.col("mix__prob")).alias("mix__kept"), F.lit(error).alias("mix__error")
    )
