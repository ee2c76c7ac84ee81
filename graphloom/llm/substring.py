"""Exact-substring deduplication over fixed-length word windows (Rabin-Karp hashes)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import packed
from graphloom.llm.common import mix64, parallelism, short_batches

#: Odd, so that multiplying by it is a bijection of the 64-bit integers; one for each half of a digest.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def window_hashes(words: np.ndarray, window: int, multiplier: int = BASES[0]) -> np.ndarray:
    """The Rabin-Karp hash, modulo 2^64, of every `window` consecutive word hashes, by doubling."""
    n = len(words) - window + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out, done = None, 0
    part, size, base = words, 1, np.uint64(multiplier)
    while True:
        if window & size:
            if out is None:
                out, done = part, size
            else:  # the `done` words so far, then `size` more
                m = len(part) - done
                out, done = out[:m] * base + part[done : done + m], done + size
        if done == window:
            return out[:n]
        part = part[: len(part) - size] * base + part[size:]
        base, size = np.uint64(int(base) ** 2 % 2**64), size * 2


class Block:
    """The words and windows of a block of documents, in order of id (nulls last)."""

    def __init__(self, group: pa.Table, window: int):
        group = group.sort_by([("id", "ascending")])
        self.window, self.ids = window, group["id"]
        self.words = [(t.as_py() or "").encode().split() for t in group["text"]]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(self.sizes)
        digests = b"".join(xxhash.xxh3_128_digest(w) for ws in self.words for w in ws)
        self.halves = np.frombuffer(digests, "<u8").reshape(-1, 2).T
        owner = np.repeat(np.arange(len(self.words)), self.sizes)
        whole = owner[: max(0, len(owner) - window + 1)] == owner[window - 1 :]
        self.starts = np.flatnonzero(whole)
        self.owner = owner[self.starts]
        self.low = self.half(0)

    def half(self, k: int) -> np.ndarray:
        """One 64-bit half of every window's digest."""
        return window_hashes(np.ascontiguousarray(self.halves[k]), self.window, BASES[k])[self.starts]

    def short(self, at: packed.Layout) -> np.ndarray:
        return mix64(self.low) >> np.uint64(64 - at.bits)

    def digest_runs(self):
        """(low, high, where each stands first, every window's place) of the distinct digests, sorted; the first place is the smallest id's."""
        high = self.half(1)
        order = np.argsort(self.low, kind="stable")
        low = self.low[order]
        new = np.concatenate((np.ones(min(1, len(low)), bool), low[1:] != low[:-1]))
        if (high[order][1:] != high[order][:-1])[~new[1:]].any():  # a low half that two digests share
            order = np.lexsort((high, self.low))
            new = np.concatenate(([True], (self.low[order][1:] != self.low[order][:-1]) | (high[order][1:] != high[order][:-1])))
        first = order[np.flatnonzero(new)]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        return self.low[first], high[first], first, place

    def rank(self) -> np.ndarray:
        """The rank of every window's document among the block's ids; equal ids rank equal."""
        ids = self.ids.to_pylist()
        rank = np.cumsum([k > 0 and ids[k] != ids[k - 1] for k in range(len(ids))], dtype=np.int64)
        return rank[self.owner] if len(self.owner) else np.zeros(0, np.int64)

    def removed(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """A flag for each word. low, high: the block's digests that a smaller id of another block has."""
        known_low, known_high, first, place = self.digest_runs()
        seen = np.zeros(len(first), bool)
        at = np.searchsorted(known_low, low)
        while len(off := np.flatnonzero(known_high[at] != high)):  # each of them is known
            at[off] += 1
        seen[at] = True
        rank = self.rank()
        bad = self.starts[seen[place] | (rank > rank[first][place])] if len(first) else self.starts
        depth = np.zeros(int(self.sizes.sum()) + 1, np.int64)
        np.add.at(depth, bad, 1)
        np.add.at(depth, bad + self.window, -1)
        return np.cumsum(depth)[:-1] > 0


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
OUT = "n_words bigint, n_removed bigint, spans array<struct<start:bigint,length:bigint>>, kept_text string"


def remove_repeats(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 6 << 20, per_bucket: int = packed.PER_BUCKET // 2) -> DataFrame:
    """(id, n_words, n_removed, spans, kept_text) for every row of docs.

    A window is `window` consecutive words of one document. Every word covered by a window whose
    words also start somewhere in a document with a smaller id goes; overlapping windows merge
    into maximal spans (start and length in words of the input). Windows are judged on the input.

    Documents are dealt into blocks by a hash of id and text. Each block sends the hashes of its
    windows, packed and cut short (packed.py), and learns which of them may occur in another
    block. Only those windows become rows, with their whole digest, 128 bits of two Rabin-Karp
    hashes, and the smallest id that has them in the block; Spark takes the smallest id of each
    digest over all blocks and tells every block in which windows it is undercut. A digest has at
    most one row a block. All passes read the same exchange of the texts.

    Digests stand for word sequences: among n windows two different ones share a digest with a
    probability below n^2 / 2^129, which is 10^-12 at n = 10^13, some 100 TB.

    A null text counts as an empty one (no words, nothing removed, kept_text ''). Texts shorter
    than a window stay whole. Ids are of any type that Spark orders. Rows with equal ids never
    remove one another's words; a null id comes after all others, and null ids are equal to each
    other. Only the two named columns are read; no rows give no rows. The session's Arrow batches
    are cut to 1000 rows.
    """
    short_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(parallelism(docs.sparkSession), math.ceil(total / block_bytes))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).cast("int").alias("block")).repartition(blocks, "block")
    at = packed.layout(max(1, total // 6), blocks, per_bucket)
    tasks = min(blocks, at.buckets)

    def ask(group: pa.Table) -> pa.Table:
        return packed.requests(group["block"][0].as_py(), packed.distinct(Block(group, window).short(at)), at)

    def name(group: pa.Table, replies: pa.Table) -> pa.Table:
        own = Block(group, window)
        short, _, place, _ = packed.distinct_with(own.short(at))
        elsewhere = packed.flags(short, replies, at)[place]
        low, high, first, _ = own.digest_runs()
        keep = elsewhere[first]
        return pa.table(
            {
                "block": pa.array([group["block"][0].as_py() if group.num_rows else 0] * int(keep.sum()), pa.int32()),
                "low": pa.array(low[keep].view(np.int64)),
                "high": pa.array(high[keep].view(np.int64)),
                "id": own.ids.take(pa.array(own.owner[first[keep]])),
            }
        )

    def cut(group: pa.Table, undercut: pa.Table) -> pa.Table:
        own = Block(group, window)
        gone = own.removed(*(undercut[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("low", "high")))
        spans, kept, removed = [], [], []
        for words, end, size in zip(own.words, own.ends, own.sizes):
            mine = gone[end - size : end]
            removed.append(int(mine.sum()))
            if not removed[-1]:
                spans.append([])
                kept.append(b" ".join(words).decode())
                continue
            turn = np.flatnonzero(np.diff(np.concatenate(([0], mine.view(np.int8), [0]))))
            spans.append([{"start": int(a), "length": int(b - a)} for a, b in zip(turn[::2], turn[1::2])])
            kept.append(b" ".join(w for w, g in zip(words, mine) if not g).decode())
        return pa.table({"id": own.ids, "n_words": pa.array(own.sizes), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, SPANS), "kept_text": pa.array(kept, pa.string())})

    replies = rows.groupBy("block").applyInArrow(ask, packed.REQUEST).repartition(tasks, "bucket").groupBy("bucket").applyInArrow(packed.shared(at), packed.REPLY)
    named = rows.groupBy("block").cogroup(replies.repartition(blocks, "block").groupBy("block")).applyInArrow(name, f"block int, low bigint, high bigint, id {kind}")
    least = named.withColumn("least", F.min("id").over(Window.partitionBy("low", "high")))
    undercut = least.where(F.col("least").isNotNull() & (F.col("id").isNull() | (F.col("least") < F.col("id")))).select("block", "low", "high")
    out = rows.groupBy("block").cogroup(undercut.repartition(blocks, "block").groupBy("block")).applyInArrow(cut, f"id {kind}, {OUT}")
    return out.withColumnRenamed("id", id_col)
