"""Two tokenizers' tokens of one text held against each other: covering tokens by merge_asof, overlaps, groups of equal ends, corpus-wide link counts."""

from __future__ import annotations

import functools
import hashlib
import os
import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe
from graphloom.llm.bpe import SPACE, freeze, thaw
from graphloom.llm.common import checkpoint, short_batches, trim, written

#: A space that both tokenizers always start a token at: never after a space, nor within other white space.
CUT = re.compile(f"(?<=[^{SPACE}]) |(?<![ ])(?<=[{SPACE}]) (?=[^{SPACE}])")
#: Where a plain split at every space could be wrong.
ODD = re.compile(f"^ |[{SPACE}] | [{SPACE}]")
#: A block is aligned in spans of so many characters, which bounds the token tables.
SPAN = 2 << 20


class Pair:
    """Tokenizer A (byte-level BPE, JSON) and B (pieces with byte fallback, model file): ids and byte lengths of chunks."""

    def __init__(self, spec: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(spec)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in names):
            raise ValueError("a piece that goes on after a space is not supported")
        self.a_bytes = [p.as_py() for p in bpe.pieces(spec)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)]
        self.a_len, self.b_len = (np.array([len(p) for p in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id("▁")

    def encode(self, chunks: list[str]) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """A's and B's ids of ' ' + chunk, each chunk once, and whether both sides' bytes give it back."""
        kind, sides, fine = pa.list_(pa.int32()), ([], []), []
        for k in range(0, len(chunks), 10_000):
            some = chunks[k : k + 10_000]
            a = [e.ids for e in self.a.encode_batch([" " + c for c in some], add_special_tokens=False)]
            b = [i or [self.space] for i in self.b.encode(some, num_threads=1)]
            fine += [b"".join(map(self.b_bytes.__getitem__, y)) == (raw := b" " + c.encode()) and b"".join(map(self.a_bytes.__getitem__, x)) == raw for c, x, y in zip(some, a, b)]
            sides[0].append(pa.array(a, kind))
            sides[1].append(pa.array(b, kind))
        return *(pa.concat_arrays(s or [pa.array([], kind)]) for s in sides), np.array(fine, bool)

    def whole(self, words: list[int], chunks: list[str], a: pa.Array, b: pa.Array) -> bool:
        """Whether all chunks of a text together give its bytes back on both sides."""
        raw = b" " + " ".join(chunks[k] for k in words).encode()
        return all(b"".join(piece[i] for k in words for i in x[k].as_py()) == raw for x, piece in ((a, self.a_bytes), (b, self.b_bytes)))


@functools.lru_cache(2)
def loaded(spec: str, model: bytes) -> Pair:
    return Pair(spec, model)


@functools.lru_cache(1)
def decimals(n: int) -> pa.Array:
    """The ids below n as text, followed by ',', '|' and ';': id k with mark m is at 3 * k + m."""
    return pa.array([f"{k}{m}".encode() for k in range(n) for m in ",|;"], pa.large_binary())


def chunks_of(text: str) -> list[str]:
    """A text cut where both tokenizers cut in any case; with a space before each it is ' ' + text."""
    return CUT.split(text) if ODD.search(text) else text.split(" ")


def taken(table: pa.Array, at: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of chunks `at` in a row, and where each text begins, texts being runs of chunks that begin at `cuts`."""
    got = table.take(pa.array(at))
    return got.flatten().to_numpy(), got.offsets.to_numpy().astype(np.int64)[cuts]


def covering(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """left (doc, start, ...) with the token of right that covers its start: the last one of the document that begins at or before it."""
    return pd.merge_asof(left, right, on="start", by="doc", suffixes=("", "_other"))


def aligned(ids_a: np.ndarray, from_a: np.ndarray, len_a: np.ndarray, ids_b: np.ndarray, from_b: np.ndarray, len_b: np.ndarray, b_size: int):
    """Links and groups of texts whose tokens lie one after the other; text d has A's tokens from_a[d] to from_a[d + 1], likewise B's.

    Returns the links as two arrays (text, pair of ids), the number of groups of each text, and for each token, in the order of groups, its place in decimals().
    """
    n = len(from_a) - 1
    start_a, start_b = np.cumsum(len_a) - len_a, np.cumsum(len_b) - len_b
    a = pd.DataFrame({"start": start_a, "doc": np.repeat(np.arange(n), np.diff(from_a)), "a": ids_a})
    b = pd.DataFrame({"start": start_b, "doc": np.repeat(np.arange(n), np.diff(from_b)), "b": ids_b})
    b["begin"] = b["start"]
    over_a = covering(a, b)  # each A token with the B token that covers its start
    over_b = covering(b, a.assign(begin_a=start_a))
    over_b = over_b[over_b["begin_a"] != over_b["start"]]  # equal starts were found from the other side
    doc = np.concatenate((over_a["doc"].to_numpy(), over_b["doc"].to_numpy()))
    pair = np.concatenate((over_a["a"].to_numpy().astype(np.int64) * b_size + over_a["b"].to_numpy(), over_b["a"].to_numpy().astype(np.int64) * b_size + over_b["b"].to_numpy()))
    both = (over_a["begin"] == over_a["start"]).to_numpy()  # tokens that begin together: those before them end together
    groups = np.bincount(over_a["doc"].to_numpy()[both], minlength=n)
    heads_a = np.flatnonzero(both)
    heads_b = np.searchsorted(start_b, start_a[heads_a])
    group_a = np.cumsum(both) - 1
    is_head = np.zeros(len(ids_b), bool)
    is_head[heads_b] = True
    group_b = np.cumsum(is_head) - 1
    ends_a, ends_b = np.append(heads_a[1:], len(ids_a)), np.append(heads_b[1:], len(ids_b))
    at_a = np.arange(len(ids_a)) + heads_b[group_a]
    at_b = np.arange(len(ids_b)) + ends_a[group_b]
    text = np.empty(len(ids_a) + len(ids_b), np.int64)
    mark_a, mark_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    mark_a[ends_a - 1], mark_b[ends_b - 1] = 1, 2
    text[at_a], text[at_b] = 3 * ids_a.astype(np.int64) + mark_a, 3 * ids_b.astype(np.int64) + mark_b
    return doc, pair, groups, text


def align_block(ids: list, texts: list, pair: Pair) -> dict:
    """One row of the link table: what a block of texts has for each text and for each pair of ids."""
    place: dict[str, int] = {}
    at = [[place.setdefault(w, len(place)) for w in chunks_of(t)] if t else [] for t in texts]
    chunks = list(place)
    del place
    table_a, table_b, fine = pair.encode(chunks)
    at = [w if not w or fine[w].all() or pair.whole(w, chunks, table_a, table_b) else [] for w in at]
    del chunks
    n_a, n_b, n_groups, n_links = ([0] * len(at) for _ in range(4))
    digests = [""] * len(at)
    bits = (len(pair.a_len) * len(pair.b_len)).bit_length()
    runs, docs, lo = [], [], 0
    names = decimals(max(len(pair.a_len), len(pair.b_len)))
    while lo < len(at):
        hi, size = lo, 0
        while hi < len(at) and (hi == lo or size + len(texts[hi] or "") <= SPAN and hi - lo < SPAN):
            size += len(texts[hi] or "")
            hi += 1
        cuts = np.concatenate(([0], np.cumsum([len(w) for w in at[lo:hi]])))
        some = np.fromiter((k for w in at[lo:hi] for k in w), np.int64, cuts[-1])
        if len(some):
            (ids_a, from_a), (ids_b, from_b) = taken(table_a, some, cuts), taken(table_b, some, cuts)
            doc, links, groups, text = aligned(ids_a, from_a, pair.a_len[ids_a], ids_b, from_b, pair.b_len[ids_b], len(pair.b_len))
            n_a[lo:hi], n_b[lo:hi], n_groups[lo:hi] = np.diff(from_a).tolist(), np.diff(from_b).tolist(), groups.tolist()
            n_links[lo:hi] = np.bincount(doc, minlength=hi - lo).tolist()
            _, offsets, data = names.take(pa.array(text)).buffers()
            ends, data = np.frombuffer(offsets, "<i8", len(text) + 1)[from_a + from_b], memoryview(data)
            digests[lo:hi] = [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends[:-1], ends[1:])]
            key = np.sort(doc << bits | links)
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            runs.append((key[first] & ((1 << bits) - 1), np.diff(np.append(first, len(key)))))
            docs.append(np.bincount(key[first] >> bits, minlength=hi - lo))
        else:
            docs.append(np.zeros(hi - lo, np.int64))
        lo = hi
    links = np.concatenate([np.zeros(0, np.int64), *(r[0] for r in runs)])
    times = np.concatenate([np.zeros(0, np.int64), *(r[1] for r in runs)])
    pairs, which = np.unique(links, return_inverse=True)
    totals = np.bincount(which, times, len(pairs)).astype(np.int64)
    held = freeze(which.astype("<u4"), times.astype("<u4"), np.concatenate(docs).astype("<u4"))
    return {"block": uuid.uuid4().hex, "id": ids, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": digests, "held": held, "pairs": pairs, "totals": totals}


def link_table(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """One row a block of texts, written to the shared folder, and the size of B's vocabulary (pair = A's id * size + B's id)."""
    spark = docs.sparkSession
    short_batches(spark)
    with open(b_path, "rb") as f:
        files = spark.sparkContext.broadcast((bpe.read_tokenizer(a_path), f.read()))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        pair = loaded(*files.value)
        ids, texts, size, id_type = [], [], 0, None

        def row():
            found = align_block(ids, texts, pair)
            types = {"block": pa.string(), "id": pa.list_(id_type), "groups_sha256": pa.list_(pa.string()), "held": pa.binary()}
            return pa.record_batch({k: pa.array([v], types.get(k, pa.list_(pa.int64()))) for k, v in found.items()})

        for b in batches:
            id_type = b.schema.field("id").type
            for key, text in zip(b["id"].to_pylist(), b["text"].to_pylist()):
                ids.append(key)
                texts.append(text)
                size += len(text or "")
                if size >= block_bytes:
                    yield row()
                    ids, texts, size = [], [], 0
        if ids:
            yield row()
        trim()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    numbers = ", ".join(f"{c} array<bigint>" for c in ("n_a", "n_b", "n_groups", "n_links"))
    table, _ = written(rows.mapInArrow(run, f"block string, id array<{kind}>, {numbers}, groups_sha256 array<string>, held binary, pairs array<bigint>, totals array<bigint>"))
    return table, len(loaded(*files.value).b_len)


def pair_counts(table: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best): how many links of the whole corpus hold each pair of ids, and whether no pair has more links with this B id."""
    seen = table.select(F.explode(F.arrays_zip("pairs", "totals")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.totals").alias("n"))
    seen = checkpoint(seen)
    most = seen.groupBy(F.pmod("pair", F.lit(b_size)).alias("b")).agg(F.max("n").alias("most"))
    return seen.join(most, F.pmod("pair", F.lit(b_size)) == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    Blocks of whole texts are encoded (each distinct chunk between safe spaces once), and pandas merge_asof,
    keyed by document, finds for each token start the other side's covering token; both directions together are the overlaps,
    equal ends cut groups. A block keeps each text's distinct pairs of ids, and sends one row a
    distinct pair to be counted corpus-wide; the counts come back to the block by a join, so no text and no token crosses
    an exchange. Vocabularies bound the pairs, and a pair is in a block once, so no key is hotter than the number of blocks.

    A null or empty text, or one whose tokens don't give ' ' + text back in bytes (a text with U+2581, say), has zeros and
    ''. Null ids and repeated rows keep their rows, each counted; other columns aren't read; no rows give no rows. A text is
    held whole by one task. B must have no piece that goes on after a space, else it raises.
    """
    table, b_size = link_table(docs, a_path, b_path, id_col, text_col, block_bytes)
    counts = pair_counts(table, b_size)
    asked = table.select("block", F.posexplode("pairs").alias("pos", "pair"))
    told = asked.join(counts, "pair").groupBy("block").agg(F.collect_list(F.struct("pos", "n", "best")).alias("told"))
    told = told.select("block", F.col("told.pos").alias("pos"), F.col("told.n").alias("n"), F.col("told.best").alias("best"))
    both = table.select("block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "held").join(told, "block", "left").drop("block")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                which, times, docs_of = (np.frombuffer(x, "<u4").astype(np.int64) for x in thaw(b["held"][k].as_py(), 3))
                n, best = np.zeros(len(which) + 1, np.int64), np.zeros(len(which) + 1, np.int64)
                if b["pos"][k].is_valid:
                    pos = b["pos"][k].values.to_numpy()
                    n[pos], best[pos] = b["n"][k].values.to_numpy(), b["best"][k].values.to_numpy(zero_copy_only=False)
                ends = np.concatenate(([0], np.cumsum(docs_of)))
                sums = [np.concatenate(([0], np.cumsum(times * x[which])))[ends] for x in (n, best)]
                flat = {c: b[c][k].values for c in ("id", "n_a", "n_b", "n_groups", "n_links")}
                yield pa.record_batch(flat | {"n_best": np.diff(sums[1]), "count_sum": np.diff(sums[0]), "groups_sha256": b["groups_sha256"][k].values})

    out = both.mapInArrow(run, f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
    return out.withColumnRenamed("id", id_col)


def default_paths(spark: SparkSession) -> tuple[str, str]:
    import public_tokenizers

    return bpe.default_path(spark), spark.conf.get("graphloom.pieces", None) or public_tokenizers.path("piece_bpe_32k.model")
