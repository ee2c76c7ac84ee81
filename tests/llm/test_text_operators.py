import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from graphloom.llm import bpe
from graphloom.llm.linedup import remove_boilerplate
from graphloom.llm.simhash import keep_one, simhash_components
from graphloom.llm.substring import remove_repeats, window_hashes

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute_fingerprint(text, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(pairs):
    """(id, fp) -> id's component by comparing all pairs."""
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= 4:
                root[find(a)] = find(b)
    least = {}
    for k, f in pairs:
        if k is not None:
            least[find(f)] = min(k, least.get(find(f), k))
    return Counter((k, f, least.get(find(f))) for k, f in pairs)


def test_simhash_matches_all_pairs(docs, rows):
    got = Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash_components(docs).collect())
    assert got == brute_components([(r[0], brute_fingerprint(r[1], 4)) for r in rows])


def test_simhash_random_balls(spark):
    """Fingerprints planted 1 to 6 bits apart, through the links alone."""
    from graphloom.llm.components import connected_components
    from graphloom.llm.simhash import near_links

    rng = np.random.default_rng(3)
    fps = []
    for _ in range(60):
        f = int(rng.integers(0, 2**63)) * 2
        fps.append(f)
        for bits in (1, 3, 4, 5, 6):
            fps.append(f ^ sum(1 << int(b) for b in rng.choice(64, bits, replace=False)))
    fps = sorted(set(fps))
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    found = {r["node"]: r["root"] for r in connected_components(near_links(spark.createDataFrame(signed, "fp long"), per_block=50)).collect()}
    want = brute_components([(k, f) for k, f in enumerate(fps)])
    groups = {}
    for (k, f, c), _ in want.items():
        groups.setdefault(c, set()).add(f)
    mine = {}
    for (s,) in signed:
        mine.setdefault(found.get(s, s), set()).add(s % 2**64)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in mine.values()}


def test_keep_one_leaves_one_of_each_group(docs, rows):
    kept = [(r["doc_id"], r["text"]) for r in keep_one(docs).collect()]
    parts = brute_components([(r[0], brute_fingerprint(r[1], 5)) for r in rows])
    assert Counter(k for k, _ in kept) == Counter({c for _, _, c in parts})
    assert set(keep_one(docs).columns) == set(docs.columns)


def test_window_hashes_tell_windows_apart():
    x = np.array([1, 2, 3, 1, 2, 3, 4], np.uint64)
    for n in (1, 2, 3, 5, 7, 8):
        h = window_hashes(x, n)
        grams = [tuple(x[i : i + n]) for i in range(len(x) - n + 1)]
        assert len(h) == max(0, len(grams))
        assert len(set(h.tolist())) == len(set(grams))


@pytest.mark.parametrize("window", [5, 50])
def test_substring_matches_brute_force(docs, rows, window):
    order = lambda k: (k is None, k or 0)
    first = {}
    for r in sorted(rows, key=lambda r: order(r[0])):
        w = (r[1] or "").encode().split()
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), order(r[0]))
    want = Counter()
    for r in rows:
        w = (r[1] or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < order(r[0]):
                gone[i : i + window] = [True] * window
        want[(r[0], len(w), sum(gone), b" ".join(a for a, g in zip(w, gone) if not g).decode())] += 1
    got = remove_repeats(docs, window, block_bytes=4000).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == want
    assert all(sum(s["length"] for s in r["spans"]) == r["n_removed"] for r in got)


def test_bpe_equals_the_library_and_round_trips(docs, rows):
    t = Tokenizer.from_file(PATH)
    want = Counter()
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        want[(r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
    got = bpe.digests(bpe.encode(docs, PATH, block_bytes=3000), PATH).collect()
    assert Counter(tuple(r) for r in got) == want


def test_decode_of_odd_ids(spark):
    df = spark.createDataFrame([(1, [50256, 15496]), (2, []), (3, None), (4, [10**6])], "k int, ids array<int>")
    assert {r["k"]: r["decoded"] for r in bpe.decode(df, PATH).collect()} == {1: "<|endoftext|>Hello", 2: "", 3: None, 4: ""}


def brute_lines(rows, least):
    sites, first = {}, {}
    for r in rows:
        for pos, line in enumerate((r[1] or "").split("\n")):
            t = line.strip(" \t\r\x0b\x0c")
            if t and r[1] is not None:
                sites.setdefault(t, set()).update([r[3]] if r[3] is not None else [])
                at = (r[0] is not None, r[0] or 0, pos)
                first[t] = min(first.get(t, at), at)
    want = Counter()
    for r in rows:
        if r[1] is None:
            want[(r[0], None, 0)] += 1
            continue
        kept, gone = [], 0
        for pos, line in enumerate(r[1].split("\n")):
            t = line.strip(" \t\r\x0b\x0c")
            if t and len(sites[t]) >= least and first[t] != (r[0] is not None, r[0] or 0, pos):
                gone += 1
            else:
                kept.append(line)
        want[(r[0], "\n".join(kept), gone)] += 1
    return want


@pytest.mark.parametrize("least", [3, 10, 15])
def test_lines_match_brute_force(docs, rows, least):
    out = remove_boilerplate(docs, min_sites=least)
    assert Counter((r["doc_id"], r["text"], r["line__removed"]) for r in out.collect()) == brute_lines(rows, least)
    assert out.columns[: len(docs.columns)] == docs.columns


def test_lines_near_the_threshold_with_coarse_sketches(spark):
    """200 lines on 60 to 140 of 150 sites, sketches of 16 registers: they only sort out what is far from 100."""
    rng = np.random.default_rng(4)
    rows, sites = [], rng.integers(60, 141, 200)
    for k, n in enumerate(sites):
        rows += [(int(s), f"line {k}") for s in rng.choice(150, n, replace=False)]
    docs = spark.createDataFrame([(j, t, "en", f"s{s}", 1) for j, (s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    out = remove_boilerplate(docs, min_sites=100, lg_k=4).groupBy().sum("line__removed").first()[0]
    assert out == sum(int(n) - 1 for n in sites if n >= 100)


def test_empty_tables(nothing):
    assert simhash_components(nothing).count() == 0
    assert keep_one(nothing).count() == 0
    assert remove_repeats(nothing).count() == 0
    assert remove_boilerplate(nothing).count() == 0
    assert bpe.digests(bpe.encode(nothing, PATH), PATH).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_links_of_any_radius(spark, radius):
    from graphloom.llm.components import connected_components
    from graphloom.llm.simhash import near_links

    rng = np.random.default_rng(radius)
    fps = [7, 0] + [int(x) for x in rng.integers(0, 2**62, 12)]
    for f in fps[:12]:
        fps += [f ^ sum(1 << int(b) for b in rng.choice(62, k, replace=False)) for k in (1, 2, 3, 5, 6)]
    fps = sorted(set(fps))
    links = near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), radius, per_block=30, per_bucket=500)
    assert all(bin(r["u"] ^ r["v"]).count("1") <= radius for r in links.collect())
    found = {r["node"]: r["root"] for r in connected_components(links).collect()}
    least = {f: f for f in fps}
    while True:  # the smallest fingerprint that is reachable, by all pairs
        new = {f: min(least[g] for g in fps if bin(f ^ g).count("1") <= radius) for f in fps}
        if new == least:
            break
        least = new
    assert {f: found.get(f, f) for f in fps} == least


def test_layout_has_no_ceiling():
    from graphloom.llm import packed

    for values in (1, 10**6, 10**9, 10**12, 10**14):
        at = packed.layout(values, max(1, values // 10**6))
        assert values / at.buckets <= packed.PER_BUCKET and at.bits <= 64
        assert at.bits >= min(64, np.log2(max(values, 2)) + packed.SPARE - 1)
    rng = np.random.default_rng(0)
    at = packed.layout(5000, 5, per_bucket=20)
    values = packed.distinct(rng.integers(0, 2**at.bits, 1000, np.uint64))
    sent = packed.requests(3, values, at)
    back = [packed.unpack(p, n, b, at) for p, n, b in zip(sent["payload"].to_pylist(), sent["n"].to_pylist(), sent["bucket"].to_pylist())]
    assert np.array_equal(np.concatenate(back), values)


def test_repeats_with_text_ids_and_shared_low_halves(spark, monkeypatch):
    """Ids as text, many small buckets, and digests whose low halves all agree: the high halves decide."""
    passage = " ".join(f"p{k}" for k in range(12))
    rows = [("b", f"x {passage} y"), ("a", f"{passage} z z z z z z z z"), (None, passage), ("c", " ".join(f"q{k}" for k in range(30))), ("a", passage)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    want = [("a", 0), ("a", 0), ("b", 12), ("c", 0), (None, 12)]
    key = lambda t: (t[0] is None, str(t[0]), t[1])
    got = sorted(((r["doc_id"], r["n_removed"]) for r in remove_repeats(docs, 5, block_bytes=40, per_bucket=3).collect()), key=key)
    assert got == want

    from graphloom.llm.substring import Block
    import pyarrow as pa

    block = Block(pa.table({"id": [1, 2], "text": ["a b c d e f", "g h a b c d"]}), 3)
    block.low = np.zeros(len(block.starts), np.uint64)
    low, high, first, place = block.digest_runs()
    assert len(high) == 6 and len(set(high.tolist())) == 6
    assert block.removed(np.zeros(0, np.uint64), np.zeros(0, np.uint64)).tolist() == [False] * 6 + [False, False, True, True, True, True]
    assert block.removed(low[:1], high[:1]).sum() >= 5


def test_bpe_reads_a_block_once_to_place_its_words(monkeypatch):
    """Before, the way back split every text twice."""
    texts, read = ["b a b", "", "a b", "<|endoftext|> c a"], []
    spec = bpe.read_tokenizer(PATH)
    added, real = bpe.added_pattern(spec), bpe.words_of
    words, _ = bpe.distinct_words(texts, added, 5)
    monkeypatch.setattr(bpe, "words_of", lambda t, a: read.append(t) or real(t, a))
    placed = bpe.placed_words(iter(texts), added, 5)
    assert read == texts
    assert [[words[k] for k in p] for p in placed] == [real(t, added) for t in texts]
