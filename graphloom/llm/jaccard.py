"""Near copies by the Jaccard similarity of word shingles: SimHash fingerprints within a Hamming ball and MinHash bands give candidates, exact sets decide."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint, drop_shuffles, mix64, remove, salted_join, short_batches, trim, unused, written
from graphloom.llm.components import connected_components
from graphloom.llm.simhash import folded, near_links, shingle_hashes

SEED = 42
#: A pair of similarity s shares no band with probability (1 - s^ROWS)^BANDS: 5e-6 at 0.8, 3e-11 at 0.9.
BANDS, ROWS = 40, 6
CHUNK = 1024
#: Of a pair's BANDS * ROWS minima each keeps one bit, and (1 - s) / 2 of these differ on average. At similarity 0.8 more
#: than SLACK above that share of all bits differ with probability below 1e-7.
SLACK = 0.125
#: Sets of one bucket that a task compares with all sets of the bucket.
TILE = 256
#: Members of a bucket up to which its pairs, at most half as many a set, are told by sizes and sketches alone.
CROWD = 32


def shingles(text: str | None, size: int) -> np.ndarray:
    """The distinct XXH64 hashes of a text's shingles, sorted; a text of fewer words is one shingle, a blank one has none."""
    return np.unique(shingle_hashes(text, size))


def coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**32, (BANDS * ROWS, 1), np.uint32), rng.integers(0, 2**31, (BANDS * ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)


def bands(hashes: np.ndarray, xor: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One 64-bit value a band, of the band's number and the least of each of its ROWS hash orders, and a sketch of one bit for each least; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for at in range(0, len(short), CHUNK):
        np.minimum(least, ((short[None, at : at + CHUNK] ^ xor) * times).min(axis=1), out=least)
    value = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + row.astype(np.uint64))
    bits = np.zeros(-len(least) % 64 + len(least), bool)
    bits[: len(least)] = mix64(least.astype(np.uint64)) >> np.uint64(63)
    return value.view(np.int64), np.packbits(bits).view(np.int64)


def lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64()))


def set_keys(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key, n, bands, sketch, fp) for every row; key is the hash of the whole set of shingles, so equal sets have one key, and fp the SimHash, which counts repeats.

    The sets themselves are as large as the texts and are not kept: few of them are ever compared (grams_of).
    """
    xor, times = coefficients()

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 100):  # the sets of long texts are as large as the texts
                part = b.slice(at, 100)
                all_ = [shingle_hashes(t.as_py(), size) for t in part.column(1)]
                sets = [np.unique(h) for h in all_]
                key = pa.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) - 2**63 for s in sets], pa.int64())
                banded, sketches = zip(*(bands(s, xor, times) for s in sets))
                out = [part.column(0), key, pa.array([len(s) for s in sets], pa.int32()), *map(lists, (banded, sketches)), pa.array([folded(h) for h in all_], pa.int64())]
                yield pa.record_batch(out, names=[id_col, "key", "n", "bands", "sketch", "fp"])
        trim()

    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, key bigint, n int, bands array<bigint>, sketch array<bigint>, fp bigint")


def grams_of(texts: DataFrame, size: int) -> DataFrame:
    """texts (key, text) -> (key, grams): the sets themselves."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                yield pa.record_batch([part.column(0), lists([shingles(t.as_py(), size).view(np.int64) for t in part.column(1)])], names=["key", "grams"])
        trim()

    return texts.select("key", "text").mapInArrow(run, "key bigint, grams array<bigint>")


def alike(pairs: DataFrame, grams: DataFrame, least: float) -> DataFrame:
    """Of pairs (u, v) those whose sets have at least this Jaccard similarity, by the sets themselves."""
    left = grams.select(F.col("key").alias("u"), F.col("grams").alias("a"))
    right = grams.select(F.col("key").alias("v"), F.col("grams").alias("b"))
    both = F.size(F.array_intersect("a", "b")).cast("bigint")
    # in whole thousandths: a pair of just the least similarity is in, whatever floating point makes of it
    enough = both * 1000 >= F.lit(round(least * 1000)) * (F.size("a") + F.size("b") - both)
    return pairs.join(left, "u").join(right, "v").where(enough).select("u", "v")


def unlike_bits(a: str, b: str) -> Column:
    """How many bits two sketches differ in."""
    return reduce(add, (F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(-(-BANDS * ROWS // 64))))


def hubs(met: DataFrame) -> DataFrame:
    """met (bucket, key, members) -> (bucket, hub), the set of each bucket that meets most others over all of its buckets.

    In a group of edited copies that is one with few edits, to which more of the others are similar than to any chance one.
    """
    weight = met.groupBy("key").agg(F.sum("members").alias("weight"))
    return met.join(weight, "key").groupBy("bucket").agg(F.max(F.struct("weight", "key")).alias("hub")).select("bucket", F.col("hub.key").alias("hub"))


def foreign_counts(rooted_sets: DataFrame, grams: DataFrame) -> DataFrame:
    """rooted_sets (key, root), distinct -> (key, foreign): how many of a set's shingles some set of another component has.

    Two of these sets whose components differ share no other shingles, so neither can share more
    than it has foreign ones. A set without any is left out.
    """
    rows = rooted_sets.join(grams, "key").select("key", "root", F.explode("grams").alias("gram"))
    common = rows.groupBy("gram").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("gram")
    return salted_join(rows.select("gram", "key"), common, "gram", "key").groupBy("key").agg(F.count("*").alias("foreign"))


def open_pairs(open_: DataFrame, least: float) -> DataFrame:
    """open_ (bucket, members, key, n, root, foreign, bands, sketch) -> (u, v), the pairs of a bucket that may still matter, each once.

    A pair is in doubt if its components differ, its sizes and, where both sets have them counted
    (none null), their foreign shingles allow the similarity, and its sketches don't rule it out. It is told in the least of the buckets that it shares. A large
    bucket is cut into tiles, each held against the whole bucket in a task of its own.
    """
    tiles, t = F.ceil(F.col("members") / TILE).cast("int"), round(least * 1000)
    cols = ("key", "n", "root", "foreign", "bands", "sketch")
    one = open_.select("bucket", F.pmod(F.hash("key"), tiles).alias("tile"), *(F.col(c).alias(f"{c}_u") for c in cols))
    two = open_.select("bucket", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("tile"), *(F.col(c).alias(f"{c}_v") for c in cols))
    small, large = F.least("n_u", "n_v"), F.greatest("n_u", "n_v")
    doubt = (F.col("key_u") < F.col("key_v")) & (F.col("root_u") != F.col("root_v")) & (small * 1000 >= large * t)
    # what they share is t / (1000 + t) of both sizes at least
    uncounted = F.col("foreign_u").isNull() | F.col("foreign_v").isNull()
    doubt &= uncounted | (F.least("foreign_u", "foreign_v") * (1000 + t) >= (small + large) * t)
    doubt &= unlike_bits("sketch_u", "sketch_v") <= math.floor(BANDS * ROWS * ((1 - least) / 2 + SLACK))
    doubt &= F.array_min(F.array_intersect("bands_u", "bands_v")) == F.col("bucket")
    return one.join(two, ["bucket", "tile"]).where(doubt).select(F.col("key_u").alias("u"), F.col("key_v").alias("v"))


def rooted(rows: DataFrame, roots: DataFrame, key: str, by: str) -> DataFrame:
    """rows with `key` replaced by its root, where it has one."""
    found = salted_join(rows, roots.select(F.col("node").alias(key), F.col("root").alias("new__root")), key, by, "left")
    return found.withColumn(key, F.coalesce("new__root", key)).drop("new__root")


def fingerprint_pairs(own: DataFrame, radius: int) -> DataFrame:
    """own (key, fp) -> (u, v), keys in order: each fingerprint's other keys with its least one, and the least ones of fingerprints that near_links links within the radius."""
    keys = checkpoint(own.select("key", "fp").distinct())
    first = keys.groupBy("fp").agg(F.min("key").alias("first"))
    same = salted_join(keys, first, "fp", "key").select(F.col("key").alias("a"), F.col("first").alias("b"))
    ends = near_links(first.select("fp"), radius)
    near = ends.join(first.toDF("u", "a"), "u").join(first.toDF("v", "b"), "v").select("a", "b")
    return checkpoint(same.union(near).where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())


def jaccard_roots(sets: DataFrame, close: DataFrame, grams_for, least: float) -> tuple[DataFrame, DataFrame]:
    """sets (key, n, bands, sketch), distinct -> (node, root) twice: a key's root by the first, and that one's by the second, name its component.

    Components are those of all pairs that are close (u, v), by their fingerprints, or share a band, and have the similarity. grams_for(keys) gives the (key, grams) of keys (key).

    First the close pairs are compared, and every set of a band's bucket with the bucket's hub, which joins most of a
    group without the pairs inside it. Then the pairs of a bucket whose components still differ are
    compared by size, sketch and, for crowded buckets, foreign shingles, and those left by the sets themselves (open_pairs);
    pairs of one component can add nothing. What these link are roots of the first step, far fewer than sets.
    """
    spread = sets.select("key", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    met = checkpoint(spread.join(shared, "bucket"))
    grams = checkpoint(grams_for(met.select("key").union(close.select("u")).union(close.select("v")).distinct()))
    stars = met.join(hubs(met), "bucket").where("key <> hub")
    stars = checkpoint(stars.select(F.least("hub", "key").alias("u"), F.greatest("hub", "key").alias("v")).union(close).distinct())
    roots = checkpoint(connected_components(checkpoint(alike(stars, grams, least))))
    placed = met.join(roots.withColumnRenamed("node", "key"), "key", "left").select("bucket", "members", "key", F.coalesce("root", "key").alias("root"))
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("bucket")
    places = checkpoint(placed.join(mixed, "bucket"))
    # all sets of a crowded bucket are counted, so there a set with too few foreign shingles has no partner
    crowded = checkpoint(places.where(F.col("members") > CROWD).select("key", "root").distinct())
    counted = sets.select("key", F.col("n").cast("bigint").alias("n"), "bands", "sketch").join(foreign_counts(crowded, grams), "key", "left")
    possible = (F.col("members") <= CROWD) | F.col("foreign").isNull() | (F.col("foreign") * 1000 >= F.col("n") * round(least * 1000))
    open_ = checkpoint(places.join(counted, "key").where(possible))
    rest = checkpoint(open_pairs(open_, least))
    late = checkpoint(alike(rest.join(stars, ["u", "v"], "left_anti"), grams, least))
    return roots, checkpoint(connected_components(rooted(rooted(late, roots, "u", "v"), roots, "v", "u")))


def similar_components(docs: DataFrame, shingle: int, least: float, id_col: str, text_col: str, radius: int = 4) -> DataFrame:
    """(row, key, root) with row a struct (id, of): the components of all rows whose shingle sets are equal or similar."""
    drop_shuffles(docs.sparkSession)
    of = F.xxhash64(text_col)
    rows = docs.select(F.struct(F.col(id_col).alias("id"), of.alias("of")).alias("row"), F.col(text_col).alias("text"))
    own, path = written(set_keys(rows, shingle, "row", "text"))
    close = fingerprint_pairs(own, radius)
    sets = own.select("key", "n", "bands", "sketch").dropDuplicates(["key"])

    def grams_for(keys: DataFrame) -> DataFrame:
        """One row of each key is read again."""
        first = own.join(keys, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.struct(F.col("row.id").isNull(), "row.id", "row.of")).alias("row"))
        asked = first.select("key", F.col("row.id").alias("i"), F.col("row.of").alias("o"))
        texts = rows.join(asked, (F.col("row.of") == F.col("o")) & F.col("row.id").eqNullSafe(F.col("i"))).select("key", "text")
        return grams_of(texts.dropDuplicates(["key"]), shingle)

    first, second = jaccard_roots(sets, close, grams_for, least)
    found = checkpoint(rooted(rooted(own.select("row", "key", F.col("key").alias("root")), first, "root", "row"), second, "root", "row"))
    remove(docs.sparkSession, path)
    return found


def keep_one_similar(docs: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """The rows of docs of which one stays for each group of near copies: the one of the smallest id, a null id being the largest.

    Rows are linked if the sets of their shingles have at least this Jaccard similarity; groups are
    the components. SimHash fingerprints within the radius propose pairs, MinHash bands those that the radius doesn't reach. Null, empty and blank texts have the empty set and are one group. Among rows of
    one id the text's hash decides; rows equal in id and text stay once. All columns pass through.
    """
    found = similar_components(docs, shingle, least, id_col, text_col, radius)
    stay = found.groupBy("root").agg(F.min(F.struct(F.col("row.id").isNull().alias("none"), "row.id", "row.of")).alias("first"))
    own_id, own_of = unused("stay__id", docs), unused("stay__of", docs)
    stay = stay.select(F.col("first.id").alias(own_id), F.col("first.of").alias(own_of))
    kept = docs.join(stay, F.col(id_col).eqNullSafe(F.col(own_id)) & (F.xxhash64(text_col) == F.col(own_of)))
    return kept.dropDuplicates([own_id, own_of]).drop(own_id, own_of)
