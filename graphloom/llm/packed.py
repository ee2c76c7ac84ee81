"""Packed hash exchange: find hashes that several blocks of rows share, at a few bytes a hash.

A block (one group of rows) holds a sorted set of hashes. Sent as rows they would cost some 16
bytes each in a shuffle, over ten times the input where a document has thousands; here each block
sends, for every range of hash values (a bucket), one binary value: the counts of the values'
leading bits and the trailing bytes. A bucket's task merges what all blocks sent and answers each
block with one bit for each hash, in the block's own order: another block has it. The hashes are
cut to as many bits as leave some three per cent of chance meetings, so an answer only selects
what is then compared as a whole by plain joins.

The number of buckets follows the number of values, without a ceiling: a bucket gets some
PER_BUCKET of them whatever the input. Messages are at most blocks times buckets and at most the
values; where blocks send few values to a bucket, a message costs what a row would.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard

REQUEST = "block int, bucket int, n int, payload binary"
REPLY = "block int, bucket int, mask binary"
#: Values that one bucket's task merges.
PER_BUCKET = 1 << 21
#: Bits beyond log2 of all values: a value meets another by chance with a probability of 2^-SPARE.
SPARE = 5


@dataclass(frozen=True)
class Layout:
    """A hash value has bucket_bits, then inner_bits that are sent as counts, then low_bytes."""

    bucket_bits: int
    inner_bits: int
    low_bytes: int

    @property
    def bits(self) -> int:
        return self.bucket_bits + self.inner_bits + 8 * self.low_bytes

    @property
    def buckets(self) -> int:
        return 1 << self.bucket_bits


def layout(values: int, blocks: int, per_bucket: int = PER_BUCKET, spare: int | None = None) -> Layout:
    """The layout for so many values from so many blocks: cells of about one value a message, and whole bytes below.

    With `spare` a hash has just so many bits beyond log2 of all values, so that chance meetings are the same share of any number of values; else SPARE or up to seven more, which the bytes give.
    """
    bucket_bits = max(4, math.ceil(math.log2(max(values, 1) / per_bucket + 1)))
    inner_bits = max(0, round(math.log2(max(1, values / max(1, blocks)))) - bucket_bits)
    if spare is not None:
        want = min(64, math.ceil(math.log2(max(values, 2))) + spare)
        low_bytes = max(1, round((want - bucket_bits - inner_bits) / 8))
        return Layout(bucket_bits, max(0, want - bucket_bits - 8 * low_bytes), low_bytes)
    want = math.ceil(math.log2(max(values, 2))) + SPARE
    low_bytes = min((64 - bucket_bits - inner_bits) // 8, max(1, math.ceil((want - bucket_bits - inner_bits) / 8)))
    return Layout(bucket_bits, inner_bits, low_bytes)


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each once. (np.unique hashes instead of sorting, which is some 30 times slower here.)"""
    values = np.sort(values)
    return values[np.concatenate((np.ones(min(1, len(values)), bool), values[1:] != values[:-1]))]


def distinct_with(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct values, where each stands first, each value's place among them, and their counts."""
    order = np.argsort(values, kind="stable")
    run = values[order]
    new = np.concatenate((np.ones(min(1, len(run)), bool), run[1:] != run[:-1]))
    at = np.flatnonzero(new)
    inverse = np.empty(len(run), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return run[at], order[at], inverse, np.diff(np.append(at, len(run)))


def split(values: np.ndarray, at: Layout) -> tuple[np.ndarray, np.ndarray]:
    """(buckets in which the sorted values lie, positions at which these begin and the last one ends)."""
    bucket = (values >> np.uint64(at.bits - at.bucket_bits)).astype(np.int64)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    return bucket[starts], np.append(starts, len(values))


def pack(values: np.ndarray, bucket: int, at: Layout) -> bytes:
    low = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : at.low_bytes]
    cells = (values >> np.uint64(8 * at.low_bytes)).astype(np.int64) - (int(bucket) << at.inner_bits)
    counts = np.bincount(cells, minlength=1 << at.inner_bits).astype("<u4")
    wide = bool(counts.max() > 255)
    head = zstandard.ZstdCompressor(level=1).compress(counts.tobytes() if wide else counts.astype(np.uint8).tobytes())
    return bytes([wide]) + len(head).to_bytes(4, "little") + head + low.tobytes()


def unpack(payload: bytes, n: int, bucket: int, at: Layout) -> np.ndarray:
    size = int.from_bytes(payload[1:5], "little")
    counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload[5 : 5 + size]), "<u4" if payload[0] else np.uint8)
    cells = np.repeat(np.arange(len(counts), dtype=np.uint64), counts) + np.uint64(bucket << at.inner_bits)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, : at.low_bytes] = np.frombuffer(payload, np.uint8, n * at.low_bytes, 5 + size).reshape(n, at.low_bytes)
    return wide.view("<u8").reshape(-1) | (cells << np.uint64(8 * at.low_bytes))


def requests(block: int, values: np.ndarray, at: Layout) -> pa.Table:
    """What a block sends: one row for each bucket in which it has values. values: sorted, each once, of at.bits bits."""
    buckets, cuts = split(values, at)
    return pa.table(
        {
            "block": pa.array([block] * len(buckets), pa.int32()),
            "bucket": pa.array(buckets, pa.int32()),
            "n": pa.array(np.diff(cuts), pa.int32()),
            "payload": pa.array([pack(values[lo:hi], b, at) for b, lo, hi in zip(buckets, cuts[:-1], cuts[1:])], pa.binary()),
        }
    )


def shared(at: Layout):
    """The bucket's task: a hash's bit is set if another block has it."""

    def merge(group: pa.Table) -> pa.Table:
        bucket, sizes = group["bucket"][0].as_py(), group["n"].to_numpy()
        values = np.concatenate([unpack(p, n, bucket, at) for p, n in zip(group["payload"].to_pylist(), sizes)])
        order = np.argsort(values, kind="stable")  # merges sorted runs
        same = values[order]
        same = same[1:] == same[:-1]
        found = np.zeros(len(values), bool)
        found[order[1:][same]] = True
        found[order[:-1][same]] = True
        masks = [np.packbits(x).tobytes() for x in np.split(found, np.cumsum(sizes)[:-1])]
        return pa.table({"block": group["block"].cast(pa.int32()), "bucket": group["bucket"].cast(pa.int32()), "mask": pa.array(masks, pa.binary())})

    return merge


def flags(values: np.ndarray, replies: pa.Table, at: Layout) -> np.ndarray:
    """A block's bits, in the order of its sorted values."""
    buckets, cuts = split(values, at)
    place, out = dict(zip(buckets.tolist(), range(len(buckets)))), np.zeros(len(values), bool)
    for bucket, mask in zip(replies["bucket"].to_pylist(), replies["mask"].to_pylist()):
        lo, hi = cuts[place[bucket]], cuts[place[bucket] + 1]
        out[lo:hi] = np.unpackbits(np.frombuffer(mask, np.uint8), count=hi - lo)
    return out
