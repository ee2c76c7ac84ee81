"""The registered queries opN_<name> and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe
from graphloom.llm.align import align, default_paths
from graphloom.llm.common import table
from graphloom.llm.exactdedup import exact_copies
from graphloom.llm.linedup import remove_boilerplate
from graphloom.llm.mixing import LEAST_MARKS, OTHER, TOPICS, mix
from graphloom.llm.rotated import nearest
from graphloom.llm.sharding import assign_shards
from graphloom.llm.simhash import simhash_components
from graphloom.llm.spelling import spelling_variants
from graphloom.llm.substring import remove_repeats
from graphloom.llm.toxicity import score_toxicity
from graphloom.llm.urltree import judge_urls
from graphloom.llm.vafile import exact_top_k


SHARD_BYTES = 1 << 20

URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)


TOXIC_FROM = 0.3


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


MIX_KEEP = 0.6
MIX_TARGETS = {"lang": {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15}, "topic": {"prose": 0.6, "symbols": 0.05, "contact": 0.05}}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"), keep_share=MIX_KEEP, targets=MIX_TARGETS)
    return found.select("doc_id", *(F.col(f"mix__{c}").alias(c) for c in ("source", "lang", "topic", "tokens")), F.round("mix__prob", 5).alias("prob"), F.col("mix__kept").alias("kept"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256.0)


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), window=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_urltree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return found.withColumn("bad_share", F.round("bad_share", 9))


def op8_rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = bpe.default_path(spark)
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), path), path)


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_boilerplate(table(spark, sf_dir, "documents"), min_sites=10)
    return found.select("doc_id", F.col("line__count").alias("n_lines"), F.col("line__removed").alias("n_removed"), F.sha2("text", 256).alias("text_sha256"))


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(table(spark, sf_dir, "documents"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), *default_paths(spark))


#: Words whose hash with their document's id this divides lose a letter.
MISSPELT = 97


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), every=MISSPELT)


QUERIES = {f.__name__: f for f in (op1_sharding, op2_toxicity, op3_mixing, op4_simhash, op5_vafile, op6_substring, op7_urltree, op8_rotated, op9_bpe, op10_lines, op11_exact, op12_align, op13_spelling)}

#: Lines of documents with the spread of their trimmed text over sites, and who has it first.
LINES_SQL = r"""
cut AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
trimmed AS (SELECT *, trim(regexp_replace(line, '[\x09-\x0D]', ' ', 'g')) AS t FROM cut),
spread AS (SELECT t, min(struct_pack(a := doc_id, b := pos)) AS first FROM trimmed WHERE t <> '' GROUP BY t HAVING count(DISTINCT source) >= 10),
judged AS (SELECT c.*, s.t IS NOT NULL AND struct_pack(a := c.doc_id, b := c.pos) IS DISTINCT FROM s.first AS gone FROM trimmed c LEFT JOIN spread s ON c.t = s.t)
"""



def url_sql(depth: int = 8, support: int = 10) -> str:
    """Loops written out to a depth; deeper paths than that end in an error."""
    rules = ", ".join(f"('{h}{p}', '{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    steps = [
        f"""rules(rule, verdict, h, pre) AS (VALUES {rules}),
p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY 1),
s0 AS (SELECT p.*, rule, verdict, CASE verdict WHEN 'block' THEN 0 ELSE 1 END AS good, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs, CAST([] AS VARCHAR[]) AS tpl FROM p LEFT JOIN fit USING (page_id))"""
    ]
    for k in range(1, depth + 1):
        steps.append(f"""l{k} AS (SELECT host, tpl, segs[{k}] AS seg FROM s{k - 1} WHERE len(segs) >= {k} GROUP BY 1, 2, 3 HAVING count(*) >= {support}),
s{k} AS (SELECT s.* EXCLUDE (tpl), CASE WHEN len(segs) >= {k} THEN list_append(s.tpl, coalesce(l.seg, '*')) ELSE s.tpl END AS tpl
 FROM s{k - 1} s LEFT JOIN l{k} l ON s.host = l.host AND s.tpl = l.tpl AND s.segs[{k}] = l.seg)""")
    steps.append(f"""t AS (SELECT *, CASE WHEN len(segs) > {depth} THEN error('deeper than {depth}') ELSE '' END AS deep FROM s{depth}),
m{depth + 1} AS (SELECT host, tpl, tpl AS c, CAST(count(good) AS DOUBLE) AS n, CAST(coalesce(sum(1 - good), 0) AS DOUBLE) AS bad FROM t GROUP BY 1, 2)""")
    for k in range(depth, 0, -1):
        steps.append(f"""g{k} AS (SELECT *, sum(n) OVER w AS nc, sum(bad) OVER w AS bc, CASE WHEN len(c) >= {k} THEN list_concat(list_append(c[1:{k - 1}], '*'), c[{k + 1}:]) ELSE c END AS par FROM m{k + 1} WINDOW w AS (PARTITION BY host, c)),
h{k} AS (SELECT *, sum(bad) OVER w / nullif(sum(n) OVER w, 0) AS common, min(CASE WHEN nc > 0 THEN c END) OVER w <> max(CASE WHEN nc > 0 THEN c END) OVER w AS siblings FROM g{k} WINDOW w AS (PARTITION BY host, par)),
m{k} AS (SELECT host, tpl, n, bad, CASE WHEN nc > 0 AND siblings AND abs(bc / nc - common) <= 1.96 * sqrt(common * (1 - common) / nc) THEN par ELSE c END AS c FROM h{k})""")
    steps.append("""f AS (SELECT *, (sum(bad) OVER w + 10 * (SELECT coalesce(avg(1 - good), 0) FROM t)) / (sum(n) OVER w + 10) AS share, sum(n) OVER w AS n_f, sum(bad) OVER w AS bad_f FROM m1 WINDOW w AS (PARTITION BY host, c))
SELECT page_id, t.host, path, rule, coalesce(verdict, CASE WHEN bad_f * 2 > n_f AND share - 1.96 * sqrt(share * (1 - share) / (n_f + 10)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
 CASE WHEN len(c) = 0 THEN '' ELSE '/' || array_to_string(c, '/') END || deep AS template, round(share, 9) AS bad_share
FROM t JOIN f ON t.host = f.host AND t.tpl = f.tpl""")
    return "WITH " + ",\n".join(steps)


def mix_sql(keep: float = MIX_KEEP, power: float = 0.7, rounds: int = 104, fills: int = 16) -> str:
    """Loops that end on convergence, written out to numbers of rounds at which they have converged."""
    marks = {name: " + ".join(f"CAST(floor((length(x) - length(replace(x, '{m}', ''))) / {len(m)}) AS BIGINT)" for m in some) for name, some in TOPICS.items()}
    best = ", ".join(f"t_{name}" for name in marks)
    topic = f"CASE WHEN greatest({best}) > 0 AND greatest({best}) * 1000 >= greatest(tokens, 1) * {LEAST_MARKS} THEN CASE " + " ".join(f"WHEN t_{n} = greatest({best}) THEN '{n}'" for n in marks) + f" END ELSE '{OTHER}' END"
    steps = [
        f"""c0 AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS x,
 coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS tokens FROM documents),
c1 AS (SELECT *, {", ".join(f"{e} AS t_{n}" for n, e in marks.items())} FROM c0),
d AS (SELECT doc_id, source, lang, {topic} AS topic, tokens FROM c1)""",
        "w0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) AS DOUBLE) AS weight FROM d GROUP BY 1, 2, 3)",
    ]
    for m in ("source", "lang", "topic"):
        given = MIX_TARGETS.get(m, {})
        named = "CASE " + " ".join(f"WHEN {m} = '{v}' THEN {w}::DOUBLE" for v, w in given.items()) + " END" if given else "NULL::DOUBLE"
        steps.append(f"""u_{m} AS (SELECT {m}, {named} AS named, CASE WHEN {named} IS NULL THEN pow(t, {power}) ELSE 0 END AS t FROM (SELECT {m}, sum(tokens)::DOUBLE AS t FROM w0 GROUP BY 1) WHERE t > 0),
v_{m} AS (SELECT {m}, coalesce(named, coalesce(t / nullif(sum(t) OVER (), 0), 0) * {max(0.0, 1 - sum(given.values()))}) AS raw FROM u_{m}),
t_{m} AS MATERIALIZED (SELECT {m}, raw / sum(raw) OVER () AS target FROM v_{m})""")
    k = 0
    for _ in range(rounds):
        for m in ("source", "lang", "topic"):
            k += 1
            steps.append(f"""w{k} AS MATERIALIZED (SELECT w.source, w.lang, w.topic, tokens, coalesce(weight * target / nullif(sum(weight) OVER (PARTITION BY w.{m}), 0), 0) AS weight
 FROM w{k - 1} w LEFT JOIN t_{m} USING ({m}))""")
    steps.append(f"r AS MATERIALIZED (SELECT *, coalesce(weight / nullif(tokens, 0), 0) AS ratio, {keep} * sum(tokens) OVER () AS budget FROM w{k})")
    steps.append("f0 AS MATERIALIZED (SELECT max(budget) AS s FROM r)")
    for i in range(1, fills + 1):
        steps.append(f"""f{i} AS MATERIALIZED (SELECT coalesce(greatest(0, (max(budget) - sum(CASE WHEN ratio * s >= 1 THEN tokens ELSE 0 END)) / nullif(sum(CASE WHEN ratio * s >= 1 THEN 0 ELSE tokens * ratio END), 0)), max(s)) AS s
 FROM r, f{i - 1})""")
    steps.append(f"c AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(1.0, ratio * s) ELSE 1.0 END AS p FROM r, f{fills})")
    return "WITH " + ",\n".join(steps) + """
SELECT doc_id, source, lang, topic, tokens, round(p, 5) AS prob, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT / pow(2, 60) < p AS kept
FROM d JOIN c USING (source, lang, topic)"""


ORACLE_SQL: dict[str, str] = {
    "op3_mixing": mix_sql(),
    "op1_sharding": f"""
WITH h AS (SELECT doc_id, coalesce(strlen(text), 0) AS n, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT AS a,
           ('0x' || substr(md5(CAST(doc_id AS VARCHAR) || chr(10) || coalesce(text, '')), 1, 15))::BIGINT AS b FROM documents),
r AS (SELECT doc_id, n, ((a >> 30) << 30) | (b >> 30) AS p FROM h),
e AS (SELECT r.*, d, p >> (60 - d) AS bucket FROM r, (SELECT unnest(range(61)) AS d)),
s AS (SELECT d, bucket, CAST(sum(n) AS BIGINT) AS bytes, count(*) AS c FROM e GROUP BY ALL),
l AS (SELECT doc_id, n, min(d) FILTER (WHERE bytes <= {SHARD_BYTES} OR d = 60) AS depth, p FROM e JOIN s USING (d, bucket) GROUP BY doc_id, n, p)
SELECT doc_id, n AS n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(p >> (60 - depth)), CAST(depth AS INTEGER), '0') END AS shard,
 CAST(depth AS INTEGER) AS depth, bytes AS shard_bytes, c AS shard_rows, bytes > {SHARD_BYTES} AS oversized
FROM l JOIN s ON l.depth = s.d AND p >> (60 - depth) = bucket
""",
    "op7_urltree": url_sql(),
    "op5_vafile": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS e FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op11_exact": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM r
""",
    "op10_lines": f"""
WITH {LINES_SQL}
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE n END AS n_lines, coalesce(gone, 0) AS n_removed, sha256(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept, '') END) AS text_sha256
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS gone, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM judged GROUP BY doc_id) j ON d.doc_id = j.doc_id
""",
}
