"""Exact dedup by Patricia tries: partitions by length and content hash, whole byte strings in compressed radix tries, terminal nodes with the owner."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint, parallelism, short_batches, trim, written

#: What is deleted before texts are compared.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: A text with more than this share of all rows is hot: by counting there are fewer such texts than HOT, however large the table.
HOT = 4096


class Node:
    """A node of a compressed radix trie: the bytes on its edge, children by their first byte, and what ends here."""

    __slots__ = ("edge", "children", "owner")

    def __init__(self, edge: bytes, owner: list | None = None):
        self.edge, self.owner = edge, owner
        self.children: dict[int, Node] = {}


def common(a: bytes, b: bytes, at: int) -> int:
    """How many bytes a shares with b[at:], by bisection over slices, which compare as memory."""
    lo, hi = 0, min(len(a), len(b) - at)
    if a[:hi] == b[at : at + hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[at + lo : at + mid] else (lo, mid)
    return lo


def better(owner: list, chars: int, key) -> bool:
    """Whether a row with so many code points and this id owns a text rather than the owner so far; a null id comes last."""
    return chars > owner[0] or chars == owner[0] and key is not None and (owner[1] is None or key < owner[1])


class Trie:
    """Byte strings in a Patricia trie; a terminal node has [code points, id, rows, digest] of its smallest owner."""

    def __init__(self):
        self.root, self.held = Node(b""), 0

    def insert(self, text: bytes, chars: int, key, rows: int, digest: bytes | None = None) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = Node(text[at:])
                self.held += len(text) - at
                node, at = child, len(text)
                break
            same = common(child.edge, text, at)
            if same < len(child.edge):
                upper = Node(child.edge[:same])
                child.edge = child.edge[same:]
                upper.children[child.edge[0]] = child
                node.children[text[at]] = child = upper
            node, at = child, at + same
        if node.owner is None:
            node.owner = [chars, key, rows, digest]
            self.held += 200
        else:
            node.owner[2] += rows
            if better(node.owner, chars, key):
                node.owner[:2] = chars, key

    def take(self, first: int | None = None):
        """(string, owner) of every terminal, or of those below the root's child `first`; what is taken leaves the trie."""
        if first is None:
            todo, self.root, self.held = [(b"", self.root)], Node(b""), 0
        else:
            todo = [(b"", self.root.children.pop(first))]
        while todo:
            above, node = todo.pop()
            here = above + node.edge
            if node.owner:
                yield here, node.owner
                if first is not None:
                    self.held -= 200
            if first is not None:
                self.held -= len(node.edge)
            todo += [(here, c) for c in node.children.values()]


def normalised(texts: pa.Array):
    """(bytes without blanks, code points of the text) of each; null counts as empty."""
    for t in texts.to_pylist():
        raw = (t or "").encode("utf-8", "surrogatepass")
        yield raw.translate(None, BLANKS), len(t or "")


def text_owners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = 16 << 20, part_bytes: int = 32 << 20) -> DataFrame:
    """(length, digest, chars, owner, rows) of every distinct normalised text: its owner has most code points, then the smallest id.

    Each task first inserts its own rows into a trie, so a text crosses the exchange once a task however
    many copies it has; a trie over trie_bytes sends off its largest subtree. The texts are then dealt by length
    and content hash and sorted within a partition by length and first bytes: equal heads are a subtree, so one
    is complete when the next begins, leaves the trie and frees its memory, while Spark's sort spills what waits.
    A text's final task gets at most one row a task (and a subtree sent off). Two different texts with one length
    and SHA-256 would raise an error, since digests label the result.
    """
    spark = docs.sparkSession
    short_batches(spark)
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))
    fields = f"length bigint, digest binary, chars bigint, id {kind.simpleString()}, n bigint"

    def record(found, schema: pa.Schema) -> pa.RecordBatch:
        names = schema.names
        return pa.record_batch([pa.array([f[k] for f in found], schema.field(k).type) for k in range(len(names))], names=names)

    def own(batches):
        trie, schema = Trie(), None

        def rows_of(terminals):
            out, size = [], 0
            for body, (chars, key, n, _) in terminals:
                out.append((len(body), hashlib.sha256(body).digest(), chars, key, n, body))
                size += len(body) + 100
                if size > 4 << 20:
                    yield record(out, schema)
                    out, size = [], 0
            if out:
                yield record(out, schema)

        for b in batches:
            if schema is None:
                types = [pa.int64(), pa.binary(), pa.int64(), b.schema.field("id").type, pa.int64(), pa.binary()]
                schema = pa.schema(list(zip(("length", "digest", "chars", "id", "n", "body"), types)))
            for key, (body, chars) in zip(b["id"].to_pylist(), normalised(b["text"])):
                trie.insert(body, chars, key, 1)
                while trie.held > trie_bytes and trie.root.children:
                    yield from rows_of(trie.take(max(trie.root.children, key=lambda c: weight(trie.root.children[c]))))
        if schema is not None:
            yield from rows_of(trie.take())
        trim()

    def settle(batches):
        trie, seen, at, schema = Trie(), set(), None, None
        for b in batches:
            out = []
            if schema is None:
                schema = pa.schema([(n, b.schema.field(n).type) for n in ("length", "digest", "chars", "id", "n")])
            for length, digest, chars, key, n, body in zip(*(b[c].to_pylist() for c in ("length", "digest", "chars", "id", "n", "body"))):
                if (length, body[:16]) != at:
                    out += [(at[0], o[3], *o[:3]) for _, o in trie.take()] if at else []
                    seen = seen if at and at[0] == length else set()
                    at = (length, body[:16])
                before = trie.held
                trie.insert(body, chars, key, n, digest)
                if trie.held != before and (digest in seen or seen.add(digest)):
                    raise ValueError(f"two texts of {length} bytes share the SHA-256 {digest.hex()}")
            yield record(out, schema)
        if at:
            yield record([(at[0], o[3], *o[:3]) for _, o in trie.take()], schema)
        trim()

    texts = rows.mapInArrow(own, f"{fields}, body binary").repartition(parts, "length", "digest").sortWithinPartitions("length", F.substring("body", 1, 16))
    return texts.mapInArrow(settle, fields).select("length", "digest", "chars", F.col("id").alias("owner"), F.col("n").alias("rows"))


def weight(node: Node) -> int:
    """Bytes on the edges of a subtree."""
    total, todo = 0, [node]
    while todo:
        node = todo.pop()
        total += len(node.edge)
        todo += node.children.values()
    return total


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = 16 << 20, part_bytes: int = 32 << 20) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row: which row of the equal texts stays.

    Texts are equal when identical after space and tab to carriage return are deleted; tries over the whole byte
    strings decide it (text_owners). Rows then find their text's owner by length and SHA-256: texts with over 1/4096 of all rows
    are fewer than 4096, so their owners are broadcast and their rows don't move; others are joined by an exchange in which no key is hot.

    A null text counts as empty, and empty texts are equal. A null id comes after all others; keep_id is null only where a whole
    group has null ids. Rows that are alike in id and text all count as kept, since nothing tells them apart (drop_copies leaves one).
    Of docs only the two named columns are read, so others can have any name; no rows give no rows.
    """
    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def digest(batches):
        for b in batches:
            bodies = [*normalised(b["text"])]
            yield pa.record_batch(
                {
                    "id": b["id"],
                    "length": pa.array([len(t) for t, _ in bodies], pa.int64()),
                    "digest": pa.array([hashlib.sha256(t).digest() for t, _ in bodies], pa.binary()),
                    "chars": pa.array([n for _, n in bodies], pa.int64()),
                }
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows, _ = written(rows.mapInArrow(digest, f"id {kind}, length bigint, digest binary, chars bigint"))
    owners = checkpoint(text_owners(docs, id_col, text_col, trie_bytes, part_bytes).withColumnRenamed("chars", "most"))
    total = owners.agg(F.sum("rows")).first()[0] or 0
    hot = F.broadcast(owners.where(F.col("rows") * HOT > total))
    key = ["length", "digest"]
    few = rows.join(hot.select(*key), key, "left_anti").join(owners.where(F.col("rows") * HOT <= total), key)
    both = rows.join(hot, key).unionByName(few)
    kept = F.col("id").eqNullSafe(F.col("owner")) & (F.col("chars") == F.col("most"))
    return both.select(F.col("id").alias(id_col), F.col("owner").alias("keep_id"), F.col("rows").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, all columns as they were; one of rows alike in id and text stays."""
    kept = exact_copies(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("copy__id"), F.col("text_sha256").alias("copy__of")).distinct()
    names = [f"copy__{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at_id, at_text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    body = F.sha2(F.regexp_replace(F.coalesce(F.col(at_text), F.lit("")), r"[\x20\x09-\x0D]", ""), 256)
    found = plain.withColumn("copy__body", body).join(kept, F.col(at_id).eqNullSafe(F.col("copy__id")) & (F.col("copy__body") == F.col("copy__of")), "left_semi")
    return found.dropDuplicates([at_id, "copy__body"]).select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
