"""SimHash near-duplicates, found by meeting in the middle of Hamming balls."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import packed
from graphloom.llm.common import checkpoint, mix64, parallelism, salted_join, short_batches, trim
from graphloom.llm.components import connected_components

SEED = 42
#: Bits of a variant's hash beyond log2 of all variants: 2^-SPARE of these, some eight a fingerprint, meet another by chance and become rows.
SPARE = 8


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The XXH64 of every shingle of a text, repeats included; a text of fewer words is one shingle, a blank one has none."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and white space as the contract has it
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64)


def folded(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes: a bit is set if over half of them have it set; 0 without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(text: str | None, shingle: int) -> int:
    """The SimHash of one text."""
    return folded(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp bigint) for every row; a null or empty text has fingerprint 0."""

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], pa.int64())], names=[id_col, "fp"])
        trim()

    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


def ball(radius: int) -> np.ndarray:
    """The bit patterns of weight 0 to radius, by weight."""
    return np.array([sum(1 << b for b in bits) for w in range(radius + 1) for bits in combinations(range(64), w)], np.uint64)


def near_links(fps: DataFrame, radius: int = 4, per_block: int = 1024, per_bucket: int = packed.PER_BUCKET) -> DataFrame:
    """fps (fp), distinct -> links (u, v) whose components are those of all pairs within the radius.

    Every fingerprint emits all variants within half the radius, rounded up. Two fingerprints are
    within the radius exactly if one of them has a variant within half the radius, rounded down
    (an inner one), that is any variant of the other. Each one that has a variant is linked to the
    smallest one that has it as an inner variant, if there is one: components stay whole without
    the pairs inside a group, and every link is within the radius.

    The variants meet twice. First as packed hashes (packed.py), which tell each block of
    fingerprints which of its variants may occur elsewhere; then those as rows, with their
    fingerprints, whole: a hash that two variants share costs a little traffic and no link. At
    most as many fingerprints as a ball holds have one variant, so no variant is hot.
    """
    if radius < 0:
        raise ValueError("a radius is 0 or more bits")
    masks, inner = ball(radius - radius // 2), len(ball(radius // 2))
    n = fps.count()
    blocks = max(1, parallelism(fps.sparkSession) if n > 2000 else 1, math.ceil(n / per_block))
    at = packed.layout(n * len(masks), blocks, per_bucket, SPARE)
    # the rows are few and the work behind each is large, so the number of tasks is stated
    fps = fps.select("fp", F.pmod(F.xxhash64("fp"), F.lit(blocks)).cast("int").alias("block")).repartition(blocks, "block")

    def variants(group: pa.Table):
        own = np.sort(group["fp"].to_numpy().astype(np.int64).view(np.uint64))
        every = own[:, None] ^ masks[None, :]
        return own, every, mix64(every.reshape(-1)) >> np.uint64(64 - at.bits)

    def first(group: pa.Table) -> pa.Table:
        return packed.requests(group["block"][0].as_py(), packed.distinct(variants(group)[2]), at)

    def second(group: pa.Table, replies: pa.Table) -> pa.Table:
        own, every, hashes = variants(group)
        known, _, inverse, count = packed.distinct_with(hashes)
        row, mask = np.nonzero((packed.flags(known, replies, at) | (count > 1))[inverse].reshape(every.shape))
        return pa.table({"variant": every[row, mask].view(np.int64), "fp": own[row].view(np.int64), "inner": mask < inner})

    tasks = min(at.buckets, blocks)
    replies = fps.groupBy("block").applyInArrow(first, packed.REQUEST).repartition(tasks, "bucket").groupBy("bucket").applyInArrow(packed.shared(at), packed.REPLY)
    met = fps.groupBy("block").cogroup(replies.repartition(blocks, "block").groupBy("block")).applyInArrow(second, "variant bigint, fp bigint, inner boolean")
    least = F.min(F.when(F.col("inner"), F.col("fp"))).over(Window.partitionBy("variant"))
    return met.withColumn("least", least).where("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct()


def simhash_components(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row of docs; component_id is the smallest id that is reachable.

    Null, empty and blank texts have fingerprint 0 and link like any other. Equal texts and
    repeated rows share a fingerprint and so a component. A null id keeps its row and is the
    smallest id of no component that has another one. Only the two named columns are read, so
    other columns never clash; no rows give no rows.
    """
    own = checkpoint(fingerprints(docs, shingle, id_col, text_col).withColumnRenamed(id_col, "doc__id"))
    per_fp = own.groupBy("fp").agg(F.min("doc__id").alias("first"))
    roots = connected_components(near_links(per_fp.select("fp"), radius))
    of_fp = per_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    linked = checkpoint(of_fp.where("root IS NOT NULL"))
    named = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    alone = of_fp.where("root IS NULL").select("fp", F.col("first").alias("component_id"))
    all_ = alone.unionByName(salted_join(linked.select("fp", "root"), named, "root", "fp").select("fp", "component_id"))
    return salted_join(own, all_, "fp", "doc__id").select(F.col("doc__id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which one stays for each component: the one of the smallest id, a null id being the largest.

    Among rows of one id the text's hash decides; rows equal in id and text count as one and stay
    once. All columns pass through. Other cases are those of simhash_components.
    """
    of = F.xxhash64(text_col)
    own = checkpoint(fingerprints(docs.select(F.struct(F.col(id_col).alias("id"), of.alias("of")).alias("row"), F.col(text_col).alias("text")), shingle, "row", "text"))
    per_fp = own.groupBy("fp").agg(F.min(F.struct(F.col("row.id").isNull().alias("none"), "row.id", "row.of")).alias("first"))
    roots = connected_components(near_links(per_fp.select("fp"), radius))
    of_fp = per_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("first", F.coalesce("root", "fp").alias("root"))
    stay = of_fp.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.id").alias("stay__id"), F.col("first.of").alias("stay__of"))
    kept = docs.join(stay, F.col(id_col).eqNullSafe(F.col("stay__id")) & (of == F.col("stay__of")))
    return kept.dropDuplicates(["stay__id", "stay__of"]).drop("stay__id", "stay__of")
