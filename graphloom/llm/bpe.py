"""Byte-level BPE by a distinct-word table: each distinct word is encoded once, ids join back by position."""

from __future__ import annotations

import functools
import json
import math
import os
import re
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import parallelism, short_batches, trim

#: White space as Unicode has it (Python's own \s also takes in U+001C to U+001F).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word is a run without white space with one space before it, if there is one. The merges'
#: own pieces never cross the ends of such a word, so a word's ids don't depend on its neighbours.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def read_tokenizer(path: str) -> str:
    """The tokenizer's JSON, after a check that it is byte-level BPE of the kind that splits at white space."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    pre = spec["pre_tokenizer"]
    if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
        raise ValueError("a byte-level BPE tokenizer without normalizer and prefix space is needed")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that take in neighbouring text are not supported")
    return text


@functools.lru_cache(2)
def added_pattern(text: str):
    """What finds added tokens in a text, None without any."""
    added = sorted((t["content"] for t in json.loads(text)["added_tokens"]), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None


@functools.lru_cache(2)
def loaded(text: str):
    """The tokenizer, once a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(text)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@functools.lru_cache(2)
def pieces(text: str) -> pa.Array:
    """The bytes of each id, and at the end an empty piece for ids that the vocabulary lacks."""
    spec = json.loads(text)
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    known = {i: bytes(letters[c] for c in piece) for piece, i in spec["model"]["vocab"].items()}
    known |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return pa.array([known.get(i, b"") for i in range(max(known) + 2)], pa.large_binary())


def words_of(text: str | None, added) -> list[str]:
    if not text:
        return []
    if added is None or not added.search(text):
        return CHUNK.findall(text)
    return [w for k, part in enumerate(added.split(text)) for w in ([part] if k % 2 else CHUNK.findall(part))]


def freeze(*arrays: np.ndarray | bytes) -> bytes:
    parts = [x if isinstance(x, bytes) else x.tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([np.array([len(p) for p in parts], "<i8").tobytes(), *parts]))


def thaw(blob: bytes, n: int) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    ends = 8 * n + np.concatenate(([0], np.cumsum(np.frombuffer(raw, "<i8", n))))
    return [raw[a:b] for a, b in zip(ends[:-1], ends[1:])]


def parcels(batches):
    """Rows (id, text, block) -> rows (block, ids, texts): what some 16 MB of rows have for one block, compressed together."""

    def filled():
        held, size = [], 0
        for b in batches:
            held, size = [*held, b], size + b.nbytes
            if size > 16 << 20:
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    for b in filled():
        block = b["block"].to_numpy()
        order = np.argsort(block, kind="stable")
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(block[order])) + 1, [len(order)]))
        out = {"block": [], "ids": [], "texts": []}
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo == hi:
                continue
            texts = [(t or "").encode() for t in b["text"].take(pa.array(order[lo:hi])).to_pylist()]
            out["block"].append(int(block[order[lo]]))
            out["ids"].append(b["id"].take(pa.array(order[lo:hi])).to_pylist())
            out["texts"].append(freeze(np.array([len(t) for t in texts], "<u4"), b"".join(texts)))
        yield pa.record_batch({"block": pa.array(out["block"], pa.int32()), "ids": pa.array(out["ids"], pa.list_(b.schema.field("id").type)), "texts": pa.array(out["texts"], pa.binary())})


def texts_of(group: pa.Table):
    """The texts of a block's parcels, one after the other."""
    for blob in group["texts"]:
        sizes, data = thaw(blob.as_py(), 2)
        ends = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64)))
        for a, z in zip(ends[:-1], ends[1:]):
            yield data[a:z].decode()


def distinct_words(texts, added, buckets: int) -> tuple[list[str], np.ndarray]:
    """A block's distinct words by (bucket, word), and where each bucket begins."""
    seen: set[str] = set()
    for t in texts:
        seen.update(words_of(t, added))
    return in_buckets(seen, buckets)


def placed_words(texts, added, buckets: int) -> list[np.ndarray]:
    """For each text of a block its words' places in distinct_words, in one pass over the texts."""
    met: defaultdict[str, int] = defaultdict()
    met.default_factory = met.__len__  # a new word's number is how many there were
    numbers = [np.fromiter(map(met.__getitem__, w), np.int32, len(w)) for w in (words_of(t, added) for t in texts)]
    words, _ = in_buckets(met, buckets)
    place = np.empty(len(words), np.int32)
    place[np.fromiter(map(met.__getitem__, words), np.int32, len(words))] = np.arange(len(words), dtype=np.int32)
    return [place[n] for n in numbers]


def in_buckets(distinct: Iterable[str], buckets: int) -> tuple[list[str], np.ndarray]:
    """Distinct words by (bucket, word), and where each bucket begins."""
    words = sorted(distinct)
    at = np.fromiter((xxhash.xxh64_intdigest(w.encode()) % buckets for w in words), np.int64, len(words))
    order = np.argsort(at, kind="stable")
    return [words[k] for k in order], np.searchsorted(at[order], np.arange(buckets + 1))


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """(id, ids array<int>) for every row of docs, as the tokenizers library encodes whole texts without adding tokens.

    Documents are dealt into blocks, compressed. Each block sends its distinct words to the tasks that own
    them by hash, compressed; there each distinct word is encoded once for all blocks and its ids
    go back to the blocks that asked, in the order in which they asked. A block then numbers its words again, in
    one pass, and looks up each position's ids. Both passes over the texts read the same exchange, and the corpus-wide
    word table is never in one place.

    A null or empty text has no ids. Added tokens that stand in a text become their own ids, as
    the library has it. Repeated rows and null ids keep their rows; only the two named columns are
    read; no rows give no rows. A text is held whole by one task, as any single value is.
    """
    spark = docs.sparkSession
    short_batches(spark)
    spec = spark.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(parallelism(spark), math.ceil(total / block_bytes))
    buckets = 2 * blocks
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).cast("int").alias("block"))
    rows = rows.mapInArrow(parcels, f"block int, ids array<{kind}>, texts binary").repartition(blocks, "block")

    def ask(group: pa.Table) -> pa.Table:
        words, cuts = distinct_words(texts_of(group), added_pattern(spec.value), buckets)
        full = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
        raw = [[w.encode() for w in words[cuts[b] : cuts[b + 1]]] for b in full]
        return pa.table(
            {
                "block": pa.array([group["block"][0].as_py()] * len(full), pa.int32()),
                "bucket": pa.array(full, pa.int32()),
                "words": pa.array([freeze(np.array([len(w) for w in r], "<u4"), b"".join(r)) for r in raw], pa.binary()),
            }
        )

    def answer(group: pa.Table) -> pa.Table:
        tokenizer = loaded(spec.value)
        place: dict[bytes, int] = {}
        asked = []
        for blob in group["words"].to_pylist():
            sizes, data = thaw(blob, 2)
            ends = np.concatenate(([0], np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64)))
            asked.append(np.array([place.setdefault(data[a:b], len(place)) for a, b in zip(ends[:-1], ends[1:])], np.int64))
        words, ids, sizes = list(place), [], []
        for k in range(0, len(words), 10_000):
            for e in tokenizer.encode_batch([w.decode() for w in words[k : k + 10_000]], add_special_tokens=False):
                ids.extend(e.ids)
                sizes.append(len(e.ids))
        table = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(ids, pa.int32()))
        out = []
        for a in asked:
            got = table.take(pa.array(a))
            out.append(freeze(np.diff(got.offsets.to_numpy()).astype("<u4"), got.flatten().to_numpy().astype("<u4")))
        return pa.table({"block": group["block"].cast(pa.int32()), "bucket": group["bucket"].cast(pa.int32()), "ids": pa.array(out, pa.binary())})

    def join(group: pa.Table, replies: pa.Table) -> pa.Table:
        added = added_pattern(spec.value)
        wanted = placed_words(texts_of(group), added, buckets)
        parts = [thaw(blob, 2) for blob in replies.sort_by("bucket")["ids"].to_pylist()]
        sizes = np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(p[0], "<u4") for p in parts)])
        flat = np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(p[1], "<u4") for p in parts)]).astype(np.int32)
        table = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat))
        del parts, sizes, flat
        ends = np.concatenate(([0], np.cumsum([len(w) for w in wanted], dtype=np.int64)))
        found = table.take(pa.array(np.concatenate([np.zeros(0, np.int32), *wanted])))
        ids = pa.ListArray.from_arrays(pa.array(found.offsets.to_numpy()[ends], pa.int32()), found.flatten())
        del wanted, found
        trim()
        own = group["ids"].combine_chunks().flatten() if group.num_rows else pa.array([], group["ids"].type.value_type)
        return pa.table({"id": own, "ids": ids})

    asked = rows.groupBy("block").applyInArrow(ask, "block int, bucket int, words binary")
    answers = asked.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(answer, "block int, bucket int, ids binary")
    joined = rows.groupBy("block").cogroup(answers.repartition(blocks, "block").groupBy("block")).applyInArrow(join, f"id {kind}, ids array<int>")
    return joined.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded and a column of decoded text: every id joins its piece, pieces concatenate by position.

    The id-to-piece table is as large as the vocabulary file, whatever the corpus, so it is
    broadcast and the join is a look-up by position in it (an Arrow take), which keeps the order
    of ids without a shuffle of every token; ids that it lacks have no bytes. Bytes that aren't UTF-8 become U+FFFD. A null list
    gives null.
    """
    spec = encoded.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    at = encoded.columns.index(ids_col)

    def run(batches):
        table = pieces(spec.value)
        for b in batches:
            lists = b.column(at)
            known = lists.flatten().to_numpy(zero_copy_only=False)
            known = np.where((known >= 0) & (known < len(table) - 1), known, len(table) - 1).astype(np.int64)
            joined = table.take(pa.array(known))
            _, offsets, data = joined.buffers()
            starts = np.frombuffer(offsets, "<i8", len(known) + 1)
            data = memoryview(data or b"")
            ends = np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))))
            texts = [None if null else bytes(data[starts[a] : starts[z]]).decode("utf-8", "replace") for null, a, z in zip(lists.is_null().to_pylist(), ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, `{out_col}` string")


def digests(encoded: DataFrame, tokenizer_path: str, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, with keep_ids also ids) of encoded rows, decoded anew from the ids."""
    both = decode(encoded.select(id_col, "ids"), tokenizer_path)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select(id_col, F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *(["ids"] if keep_ids else []))


def default_path(spark: SparkSession) -> str:
    import public_tokenizers

    return spark.conf.get("graphloom.tokenizer", None) or public_tokenizers.path("byte_bpe_50k.json")
