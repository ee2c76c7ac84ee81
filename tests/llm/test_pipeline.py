"""Each stage against a plain version of what its own input calls for, on the smallest tables and on odd rows."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from graphloom.llm.mixing import LEAST_MARKS, OTHER, TOPICS
from graphloom.llm.queries import ORACLE_SQL, QUERIES
from graphloom.llm.toxicity import score_toxicity

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\r\x0b\x0c"


def lines_kept(docs, least=10):
    """id -> text without the lines of `least` sources, but for the first occurrence of each."""
    sites, first = defaultdict(set), {}
    for r in sorted(docs, key=lambda r: r["doc_id"]):
        for pos, line in enumerate((r["text"] or "").split("\n")):
            t = line.strip(SPACE)
            first.setdefault(t, (r["doc_id"], pos))
            sites[t] |= {r["source"]} - {None}
    keep = lambda r, pos, t: not t or len(sites[t]) < least or first[t] == (r["doc_id"], pos)
    return {r["doc_id"]: None if r["text"] is None else "\n".join(x for pos, x in enumerate(r["text"].split("\n")) if keep(r, pos, x.strip(SPACE))) for r in docs}


def near_kept(docs):
    """The smallest ids of the groups by all pairs: Jaccard similarity of five-word shingle sets 0.8 or more."""

    def shingles(text):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets, least = {r["doc_id"]: shingles(r["text"]) for r in docs}, {r["doc_id"]: r["doc_id"] for r in docs}
    alike = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    links = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= (least[a], least[b]) != (m, m)
            least[a] = least[b] = m
    return set(least.values())


def mix_kept(docs, keep=0.9, power=0.7):
    """The ids that raking to tempered margins and sampling by MD5 leave."""

    def cell(r):
        x, n = r["text"] or "", len((r["text"] or "").encode().split())
        marks = {t: sum(x.count(m) for m in some) for t, some in TOPICS.items()}
        best = max(marks.values())
        topic = next(t for t in marks if marks[t] == best) if best and best * 1000 >= max(n, 1) * LEAST_MARKS else OTHER
        return (r["source"] or "", r["lang"] or "", topic), n

    cells, tokens = {r["doc_id"]: cell(r) for r in docs}, Counter()
    for c, n in cells.values():
        tokens[c] += n
    total, weight, aims = sum(tokens.values()), {c: float(n) for c, n in tokens.items()}, []
    for m in range(3):
        t = Counter()
        for c, n in tokens.items():
            t[c[m]] += n
        raw = {v: n**power for v, n in t.items() if n}
        aims.append({v: x / sum(raw.values()) for v, x in raw.items()})
    for _ in range(400):
        for m in range(3):
            have = Counter()
            for c, w in weight.items():
                have[c[m]] += w
            weight = {c: w * aims[m].get(c[m], 0) / have[c[m]] if have[c[m]] else 0.0 for c, w in weight.items()}
    ratio, scale = {c: weight[c] / n if n else 0.0 for c, n in tokens.items()}, float(total)
    for _ in range(100):
        full = {c for c in tokens if ratio[c] * scale >= 1}
        rest = sum(tokens[c] * ratio[c] for c in tokens if c not in full)
        scale = max(0.0, (keep * total - sum(tokens[c] for c in full)) / rest) if rest else scale
    unit = lambda k: int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16) / 2**60
    return {k for k, (c, n) in cells.items() if unit(k) < (min(1.0, ratio[c] * scale) if tokens[c] else 1.0)}


def check(name, before, after):
    rows = {r["doc_id"]: r for r in before}
    got = {r["doc_id"]: r for r in after}
    assert len(got) == len(after) and got.keys() <= rows.keys()
    if name == "line_dedup":
        assert {k: r["text"] for k, r in got.items()} == lines_kept(before)
    if name == "near_dedup":
        assert got.keys() == near_kept(before)
    if name == "mixing":
        assert got.keys() == mix_kept(before)
    if name in ("toxicity", "near_dedup", "mixing"):
        assert all(got[k] == rows[k] for k in got)
    if name == "tokenise":
        t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        ids = {k: t.encode(r["text"] or "", add_special_tokens=False).ids for k, r in rows.items()}
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert {k: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for k, r in got.items()} == {k: (len(i), digest(",".join(map(str, i))), digest(rows[k]["text"] or "")) for k, i in ids.items()}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == len(P.STAGES) - 1 or out.columns == columns
        check(name, docs.collect(), out.collect())
        if name == "toxicity":
            scores = score_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in scores if r["score"] < P.TOXIC_FROM}
        docs = out


def test_stages_on_odd_rows(spark):
    """Nulls in every column but the id, empty and blank texts, ties, columns with clashing names, and no rows at all."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text, "en", "a", 1), (2, text, None, None, None), (3, None, "de", "b", 0), (4, "", "de", None, 0), (5, " \n\t", None, "b", 3), (6, text.replace("w30", "x"), "en", "b", 1), (7, "same line\n" + " ".join("abc" for _ in range(9)), "fr", "c", 9)]
    rows += [(10 + k, f"same line\nown {k}", "en", f"s{k}", 5) for k in range(11)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, "t", 1, 2.0) for r in rows], kind + ", topic string, tokens int, weight double")
    empty = spark.createDataFrame([], kind)
    for name, stage in P.STAGES[1:]:
        assert stage(spark, empty, SF).count() == 0
        check(name, docs.collect() if name not in ("near_dedup", "mixing") else docs.select(*P.COLUMNS).collect(), stage(spark, docs, SF).collect())


def test_one_query_for_each_operator():
    numbers = [int(n[2:].split("_")[0]) for n in QUERIES]
    assert sorted(numbers) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)
