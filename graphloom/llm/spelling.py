"""Spelling variants: words over a reduced alphabet, their full one-edit neighbourhoods joined to the reduced vocabulary, pairs verified on the words."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint, parallelism, salted_join, short_batches, trim

#: Letters after A-Z are lower-cased: a-z and U+00C0 to U+00FF.
LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))
#: A run of letters in lower-cased UTF-8, where U+00C0 to U+00FF is C3 and a byte from 80 to BF.
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
#: Sizes of reduced alphabets, tried in this order; the last has a symbol for each letter.
SIZES = (4, 6, 8, 12, 16, 24, 32, 48, len(LETTERS))
#: An alphabet is large enough when a word shares its reduced word with so many on average.
CROWD = 8
#: Bytes of text for each file of what is kept of the vocabulary: a file costs more than its few words.
PART_BYTES = 16 << 20
#: Odd multiplier of the polynomial hash that stands for a reduced word; pairs are verified, so a collision costs a comparison.
BASE = np.uint64(0x9E3779B97F4A7C15)


def symbols(size: int) -> str:
    """The symbol of each of LETTERS: letters hashed to `size` symbols."""
    if size >= len(LETTERS):
        return LETTERS
    return "".join(chr(ord("a") + zlib.crc32(c.encode()) % size) if size <= 26 else LETTERS[zlib.crc32(c.encode()) % size] for c in LETTERS)


def word_counts(docs: DataFrame, id_col: str, text_col: str, every: int | None, flush: int = 400_000) -> DataFrame:
    """(word, n): how often each word occurs, A-Z lower-cased; with `every`, words whose crc32 with the document's id it divides have lost a letter."""
    short_batches(docs.sparkSession)

    def run(batches):
        held, words = Counter(), []

        def rows():
            found = [(w.decode(), n) for w, n in held.items() if n]
            held.clear()
            return pa.record_batch({"word": pa.array([w for w, _ in found], pa.string()), "n": pa.array([n for _, n in found], pa.int64())})

        for b in batches:
            for key, text in zip(b["id"].to_pylist(), b["text"].to_pylist()):
                if not text:
                    continue
                own = RUN.findall(text.encode().lower())
                words += own
                if every:
                    seed = zlib.crc32(f"{'' if key is None else key}:".encode())
                    for w in set(own):
                        if not (h := zlib.crc32(w, seed)) % every:
                            plain, n = w.decode(), own.count(w)
                            at = h % len(plain)
                            held[w] -= n
                            held[(plain[:at] + plain[at + 1 :]).encode()] += n
                if len(words) > 1_000_000:
                    held.update(words)
                    words = []
                    if len(held) > flush:
                        yield rows()
        held.update(words)
        yield rows()
        trim()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def matrices(words: list[str], most: int):
    """Words by length as matrices of code points, at most so many cells each, with their rows."""
    by: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by.setdefault(len(w), []).append(k)
    for length, at in by.items():
        step = max(1, most // max(length, 1))
        for lo in range(0, len(at), step):
            some = at[lo : lo + step]
            raw = "".join(words[k] for k in some).encode("utf-32-le")
            yield np.array(some), np.frombuffer(raw, "<u4").reshape(len(some), length).astype(np.uint64)


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, BASE))), dtype=np.uint64)


def hashes(m: np.ndarray) -> np.ndarray:
    """The polynomial hash of each row: the sum of letter times BASE to its position."""
    return (m * powers(m.shape[1])[:-1]).sum(1, dtype=np.uint64)


def neighbourhood(m: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all strings over the alphabet within one edit of each row of m, the row itself included, each once.

    Of edits that give the same string one is taken: a letter is deleted at the head of its run alone, and inserted
    only before a different letter.
    """
    n, length = m.shape
    p = powers(length + 1)
    terms = m * p[:length]
    zero = np.zeros((n, 1), np.uint64)
    before = np.concatenate((zero, np.cumsum(terms, 1, dtype=np.uint64)), 1)  # hash of the first k letters
    after = before[:, -1:] - before  # what letters from k on add
    unshift = np.uint64(pow(int(BASE), -1, 1 << 64))
    own = np.arange(n)
    rows, found = [own], [before[:, -1]]
    head = np.concatenate((np.ones((n, 1), bool), m[:, 1:] != m[:, :-1]), 1)[:, :length]
    rows.append(np.nonzero(head)[0])
    found.append((before[:, :-1] + after[:, 1:] * unshift)[head])
    follows = np.concatenate((m, zero), 1)
    for s in alphabet:
        other = m != s
        rows.append(np.nonzero(other)[0])
        found.append((before[:, :-1] + s * p[:length] + after[:, 1:])[other])
        other = follows != s
        rows.append(np.nonzero(other)[0])
        found.append((before + s * p[: length + 1] + after * BASE)[other])
    return np.concatenate(rows), np.concatenate(found)


def reduced_to(words: DataFrame) -> tuple[DataFrame, str]:
    """words with `reduced`, over the smallest alphabet that spreads them, and that alphabet.

    The size follows from counts alone: the mean number of words that a word shares its reduced word with, over all words, must be CROWD at most.
    With the last alphabet nothing is reduced and the mean is 1, so no crowd of words is ever compared pair by pair.
    """
    for size in SIZES:
        letters = symbols(size)
        out = words.withColumn("reduced", F.translate("word", LETTERS, letters))
        n, squares = out.groupBy("reduced").count().agg(F.sum("count"), F.sum(F.col("count").cast("double") * F.col("count"))).first()
        if size == SIZES[-1] or (squares or 0) <= CROWD * (n or 1):
            return out, "".join(sorted(set(letters)))


def near_pairs(words: DataFrame, parts: int = 8) -> DataFrame:
    """(word, n, other, other_n) of the distinct words (word, n) that differ by exactly one inserted, deleted or replaced code point, each pair once.

    Each distinct reduced word sends the hashes of its whole one-edit neighbourhood, which are joined to the hashes of the reduced vocabulary;
    two words within one edit have reduced words within one edit, or the same. What meets is verified by the edit distance of the words themselves.
    The vocabulary is kept in `parts` files.
    """
    words, letters = reduced_to(words)
    alphabet = np.array([ord(c) for c in letters], np.uint64)

    def spread(batches):
        for b in batches:
            words = b["reduced"].to_pylist()
            for at, m in matrices(words, max(1, 400_000 // len(alphabet))):
                own = hashes(m)
                rows, near = neighbourhood(m, alphabet)
                yield pa.record_batch({"k": pa.array(own[rows].view(np.int64)), "near": pa.array(near.view(np.int64))})

    def hashed(batches):
        for b in batches:
            words, out = b["reduced"].to_pylist(), np.zeros(b.num_rows, np.uint64)
            for at, m in matrices(words, 1_000_000):
                out[at] = hashes(m)
            yield pa.record_batch({"word": b["word"], "n": b["n"], "k": pa.array(out.view(np.int64))})

    keyed = checkpoint(words.select("word", "n", "reduced").mapInArrow(hashed, "word string, n bigint, k bigint").coalesce(parts))
    keys = keyed.select(F.col("k").alias("near")).distinct()
    around = words.select("reduced").distinct().mapInArrow(spread, "k bigint, near bigint").where("k <= near")
    met = around.join(keys, "near").distinct()
    left = met.join(keyed, "k").select("k", "near", "word", "n")
    right = keyed.select(F.col("k").alias("near"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    both = left.join(right, "near").where("(k <> near OR word < other) AND abs(length(word) - length(other)) <= 1")
    return both.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n").where("word <> other")


def roots(forms: DataFrame, parts: int = 8) -> DataFrame:
    """(word, root) for (word, form): forms are followed to the last by doubling, one salted join a round."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        table = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        both = checkpoint(salted_join(now, table, "root", "word", "left").coalesce(parts))
        if both.where("next IS NOT NULL").isEmpty():
            return now
        now = both.select("word", F.coalesce("next", "root").alias("root"))


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5, min_count: int = 3, factor: int = 2, every: int | None = None
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least min_length letters that occurs min_count times.

    Words are runs of a-z (A-Z lower-cased) and U+00C0 to U+00FF in whole texts. A word's form is the most frequent word one edit
    away (ties: the smallest in code-point order) if it is at least `factor` times as frequent, else null; its root is what forms lead to in the end, itself
    without any. With `every`, a word whose crc32 with its document's id (empty for null) it divides loses a letter first: planted misspellings.

    A null or empty text has no words; repeated rows count each; words of any length are whole, and their hashes alone travel. Other columns aren't
    read; no rows, or no frequent words, give no rows. Frequencies at least double along forms, so there is no cycle (factor must be over 1).
    """
    if factor <= 1:
        raise ValueError("factor must be over 1")
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(parallelism(docs.sparkSession), -(-total // PART_BYTES))
    words = word_counts(docs, id_col, text_col, every).where((F.col("n") >= min_count) & (F.length("word") >= min_length))
    words = checkpoint(words.coalesce(parts))
    pairs = checkpoint(near_pairs(words, parts).coalesce(parts))
    each = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    near = each.groupBy("word").agg(F.max("n").alias("own"), F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("rank"), "other")).alias("best"))
    strong = -F.col("best.rank") >= factor * F.col("own")
    near = near.select("word", "n_near", F.when(strong, F.col("best.other")).alias("form"), F.when(strong, -F.col("best.rank")).alias("form_n"))
    near = checkpoint(near.coalesce(parts))
    last = roots(near.where("form IS NOT NULL"), parts)
    out = words.join(near, "word", "left").join(last, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
