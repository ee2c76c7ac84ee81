"""Alignment of two tokenizers against a plain version that encodes whole texts and compares all byte ranges of a text."""

import hashlib
import os
from collections import Counter

import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from graphloom.llm import align as module
from graphloom.llm.align import CUT, align, chunks_of
from graphloom.llm.bpe import pieces

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "foo \nbar", "foo\n bar", "foo\n\n \n bar", "x\t y  z ", "tab\t \t end", "one   two    three ",
    "naïve café 漢字かな交じり文 🙂 é", "a▁b", "▁", "<|endoftext|> <s> </s> <unk> <0x41>", "ALL CAPS don't 12345 3.14", " wide  space  x", "\x00nul \x1c y",
    "The quick brown fox jumps over the lazy dog, unbelievably internationalisation! ", "l'été  dernier\n\n\tàé" * 3, "x" * 500, "ab" * 3000 + " tail", "  lead", "\n lead", "a ́b", "﻿bom", "ﬁ ligature Ⅷ",
]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    table = [p.as_py() for p in pieces(open(A, encoding="utf-8").read())]

    def tokens(text):
        if not text:
            return [], []
        x = a.encode(" " + text, add_special_tokens=False).ids
        y = b.encode(text)
        name = [b.id_to_piece(k) for k in y]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(y, name)]
        bytes_a = [table[k] for k in x]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return [], []
        spans = []
        for ids, raw in ((x, bytes_a), (y, bytes_b)):
            at, out = 0, []
            for k, r in zip(ids, raw):
                out.append((at, at + len(r), k))
                at += len(r)
            spans.append(out)
        return spans

    return tokens


def expected(rows, tokens):
    held = [(key, *tokens(t)) for key, t in rows]
    links = [[(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]] for _, a, b in held]
    count = Counter(p for each in links for p in each)
    most = {}
    for (_, y), n in count.items():
        most[y] = max(n, most.get(y, 0))
    out = Counter()
    for (key, a, b), own in zip(held, links):
        ends = sorted({x[1] for x in a} & {y[1] for y in b})
        lo, groups = 0, []
        for e in ends:
            groups.append("|".join(",".join(str(x[2]) for x in side if lo < x[1] <= e) for side in (a, b)))
            lo = e
        text = ";".join(groups)
        out[key, len(a), len(b), len(ends), len(own), sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if a else ""] += 1
    return out


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("block,span", [(16 << 20, 2 << 20), (60, 25)])
def test_equals_whole_texts(spark, plain, monkeypatch, block, span):
    """Also in blocks of a text or two, so that counts must meet across blocks."""
    monkeypatch.setattr(module, "SPAN", span)
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (3, "a  b"), (None, "a b"), (None, None)]
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, block int, n_a string").repartition(3)
    got = Counter(tuple(r[c] for c in COLUMNS) for r in align(df, A, B, block_bytes=block).collect())
    assert got == expected(rows, plain)


def test_odd_rows_and_documents(docs, rows, spark, plain):
    got = Counter(tuple(r[c] for c in COLUMNS) for r in align(docs, A, B).collect())
    assert got == expected([(r[0], r[1]) for r in rows], plain)
    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet") if os.path.exists("/root/testdata/sf0.001") else docs
    texts = [(r["doc_id"], r["text"]) for r in some.collect()]
    short = [(k, t) for k, t in texts if len(t or "") < 4000]
    df = spark.createDataFrame(short, "doc_id long, text string")
    assert Counter(tuple(r[c] for c in COLUMNS) for r in align(df, A, B, block_bytes=20_000).collect()) == expected(short, plain)


def test_empty_table(nothing):
    assert align(nothing, A, B).count() == 0


def test_chunks_join_back():
    for t in TEXTS:
        if t:
            assert " ".join(chunks_of(t)) == t and chunks_of(t) == CUT.split(t)
