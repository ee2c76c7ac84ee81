"""Which roots reach what, kept under changes: roots as bits, deletions by over-deleting and deriving again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.session import stored
from graphloom.operators.scan import numbered

BITS = 64


@dataclass(frozen=True)
class Reach:
    """roots (id, number), steps (a, b), and bits (id, word, bits): bit number % 64 of word number / 64 is set where that root reaches the node.

    A node has a row for each 64 roots of which some reach it, not one for each root.
    """

    roots: DataFrame
    steps: DataFrame
    bits: DataFrame

    def settled(self) -> Reach:
        return Reach(stored(self.roots), stored(self.steps), stored(self.bits))

    def named(self) -> DataFrame:
        """(id, roots): the sorted roots of every node that any root reaches."""
        each = self.bits.select("id", "word", "bits", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("k")).where(F.expr("shiftright(bits, k) & 1 = 1"))
        met = each.select("id", (F.col("word") * BITS + F.col("k")).alias("number")).join(self.roots.withColumnRenamed("id", "root"), "number")
        return met.groupBy("id").agg(F.array_sort(F.collect_list("root")).alias("roots"))


def own_bits(roots: DataFrame) -> DataFrame:
    """Each root reaches itself."""
    one = F.expr(f"shiftleft(CAST(1 AS BIGINT), CAST(number % {BITS} AS INT))")
    return merged(roots.select("id", F.floor(F.col("number") / BITS).alias("word"), one.alias("bits")))


def merged(bits: DataFrame) -> DataFrame:
    return bits.groupBy("id", "word").agg(F.bit_or("bits").alias("bits"))


def minus(bits: DataFrame, other: DataFrame) -> DataFrame:
    """The bits that other lacks, rows without any left out."""
    met = bits.join(other.withColumnRenamed("bits", "had"), ["id", "word"], "left")
    return met.select("id", "word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("bigint")))).alias("bits")).where("bits <> 0")


def common(bits: DataFrame, other: DataFrame) -> DataFrame:
    met = bits.join(other.withColumnRenamed("bits", "had"), ["id", "word"])
    return met.select("id", "word", F.col("bits").bitwiseAND(F.col("had")).alias("bits")).where("bits <> 0")


def moved(bits: DataFrame, steps: DataFrame) -> DataFrame:
    """bits one step on."""
    return merged(bits.select(F.col("id").alias("a"), "word", "bits").join(steps, "a").select(F.col("b").alias("id"), "word", "bits"))


def spread(steps: DataFrame, seen: DataFrame, fresh: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """seen and all that fresh bits reach along steps, if within is given only as far as it has the bits; one table a step, to the fixpoint."""
    fresh = stored(minus(merged(fresh), seen))
    while fresh.take(1):
        seen = stored(merged(seen.unionByName(fresh)))
        onward = moved(fresh, steps)
        fresh = stored(minus(onward if within is None else common(onward, within), seen))
    return seen


def build(steps: DataFrame, roots: DataFrame) -> Reach:
    """roots (id) numbered in order; nodes on cycles are reached once, what no root reaches has no row."""
    steps = stored(steps.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct())
    known = stored(numbered(roots.select("id").where("id IS NOT NULL").distinct(), ["id"], "number"))
    first = own_bits(known)
    return Reach(known, steps, spread(steps, first.limit(0), first))


def update(state: Reach, added: DataFrame, removed: DataFrame, new_roots: DataFrame | None = None, lost_roots: DataFrame | None = None) -> Reach:
    """The state after steps (a, b) and roots (id) came and went; equal to build() of what is left, but for the roots' numbers.

    Deletion: bits that a removed step or root may have carried are taken away as far as they went along the old steps; then each node gets back what
    a step from a node outside that region, or the node being a root, still gives it, and this spreads within the region. Additions spread what is new. Work follows
    the region that the removed bits had reached, not the graph. A step both removed and added stays.
    """
    removed = stored(removed.select("a", "b").distinct().join(added, ["a", "b"], "left_anti").join(state.steps, ["a", "b"], "left_semi"))
    left = stored(state.steps.join(removed, ["a", "b"], "left_anti"))
    steps = stored(left.unionByName(added.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")).distinct())
    gone = state.roots.join(lost_roots.select("id"), "id", "left_semi") if lost_roots is not None else state.roots.limit(0)
    gone = stored(gone)
    doubted = common(moved(state.bits, removed), state.bits).unionByName(own_bits(gone))
    region = spread(state.steps, state.bits.limit(0), doubted, within=state.bits)
    sure = stored(minus(state.bits, region))
    roots = state.roots.join(gone, "id", "left_anti")
    if new_roots is not None:
        fresh = new_roots.select("id").where("id IS NOT NULL").distinct().join(roots.select("id"), "id", "left_anti")
        most = roots.agg(F.max("number")).first()[0]
        roots = roots.unionByName(numbered(fresh, ["id"], "number").withColumn("number", F.col("number") + (0 if most is None else most + 1)))
    roots = stored(roots)
    again = common(moved(sure, left), region).unionByName(common(own_bits(roots), region))
    back = spread(left, sure, again, within=region)
    new = moved(back, steps.join(left, ["a", "b"], "left_anti")).unionByName(own_bits(roots))
    return Reach(roots, steps, spread(steps, back, new)).settled()
