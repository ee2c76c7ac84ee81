"""Sharding by extendible hashing: only oversized buckets split on another bit of the hash."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint

#: A row's path has 30 bits of its key's hash, then 30 bits of the hash of key and text, by which
#: the rows of one hot key part.
KEY_BITS, BITS = 30, 60


def hash_bits(text: Column) -> Column:
    """The leading 60 bits of the MD5, as a number."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def hash_path(key: Column, text: Column) -> Column:
    own = F.coalesce(key.cast("string"), F.lit(""))
    rest = F.shiftright(hash_bits(F.concat(own, F.lit("\n"), F.coalesce(text, F.lit("")))), BITS - KEY_BITS)
    return F.shiftleft(F.shiftright(hash_bits(own), KEY_BITS), KEY_BITS).bitwiseOR(rest)


def prefix(path: Column, depth) -> Column:
    """The leading `depth` bits of a path."""
    return F.call_function("shiftright", path, F.lit(BITS) - depth) if isinstance(depth, Column) else F.shiftright(path, BITS - depth)


def directory(rows: DataFrame, low: int, high: int, limit_bytes: int) -> DataFrame:
    """(at, depth, shard_bytes, shard_rows) for each used entry `at`, the leading `high` bits of rows' paths.

    Byte sums per entry roll up into sums for every depth from low to high. A bucket of depth d is
    split on bit d + 1 exactly if it's over the limit, so the shard of an entry is its first
    prefix that fits; depth is null where none does.
    """
    cells = rows.groupBy(prefix(F.col("path"), high).alias("at")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
    steps = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("bucket", F.call_function("shiftright", F.col("at"), F.lit(high) - F.col("depth")))
    sums = steps.groupBy("depth", "bucket").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    fits = sums.where((F.col("bytes") <= limit_bytes) | (F.col("depth") == BITS))
    best = F.min(F.struct("depth", fits["bytes"], fits["rows"]))
    found = steps.select("at", "depth", "bucket").join(fits, ["depth", "bucket"]).groupBy("at").agg(best.alias("s"))
    return cells.select("at").join(found, "at", "left").select("at", F.col("s.depth").alias("depth"), F.col("s.bytes").alias("shard_bytes"), F.col("s.rows").alias("shard_rows"))


def assign_shards(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """(id, n_bytes, shard, depth, shard_bytes, shard_rows, oversized) for every row of docs.

    A shard is named by its hash-prefix bits, as text; depth is their number. Shards are disjoint
    and, but for those marked oversized, hold at most limit_bytes bytes of text. A bucket splits
    only if it's over the limit; without rows over the limit all rows are in the shard ''.

    The directory is indexed by as many bits as the total needs and some more; entries over the
    limit get a page of further bits in another round over their rows alone, until all fit or all
    bits are used. The driver sees only counts.

    key_col (the id by default) decides a row's first 30 bits. The rows of one key part by the
    hash of their text, so a hot key spreads over shards as any other rows do. Rows equal in key
    and text can't part: where they, or a single text, are over the limit, the shard is marked
    oversized. A null text has 0 bytes, a null key hashes as ''. Repeated rows keep their rows.
    Only the named columns are read; no rows give no rows.
    """
    key = F.col(key_col or id_col)
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint")
    rows = checkpoint(docs.select(F.col(id_col).alias("id"), hash_path(key, F.col(text_col)).alias("path"), size.alias("bytes")))
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(1, math.ceil(math.log2(total / limit_bytes + 1)) + 3))
    pending, done = rows, []
    while True:
        entries = checkpoint(directory(pending, low, high, limit_bytes))
        settled = entries.where("depth IS NOT NULL")
        done.append(rows.withColumn("at", prefix(F.col("path"), high)).join(settled, "at").drop("at"))
        over = entries.where("depth IS NULL").select("at")
        if high == BITS or not over.take(1):
            break
        pending = pending.withColumn("at", prefix(F.col("path"), high)).join(over, "at", "left_semi").drop("at")
        low, high = high + 1, min(BITS, high + 10)
    found = reduce(DataFrame.unionByName, done)
    bits = F.lpad(F.bin(F.call_function("shiftright", F.col("path"), F.lit(BITS) - F.col("depth"))), BITS, "0")
    shard = F.substring(bits, F.lit(BITS + 1) - F.col("depth"), F.col("depth"))
    return found.select(
        F.col("id").alias(id_col),
        F.col("bytes").alias("n_bytes"),
        shard.alias("shard"),
        "depth",
        "shard_bytes",
        "shard_rows",
        (F.col("shard_bytes") > limit_bytes).alias("oversized"),
    )
