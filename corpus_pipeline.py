"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing, tokenisation.

Every stage takes (spark, docs, sf_dir) and gives the documents that it keeps, with the columns of
documents; the last gives each kept document's token ids and their digests. Every stage works on
all that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe
from graphloom.llm.common import table, written
from graphloom.llm.jaccard import keep_one_similar
from graphloom.llm.linedup import remove_boilerplate
from graphloom.llm.mixing import mix
from graphloom.llm.toxicity import score_toxicity

TOXIC_FROM = 0.3
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches TOXIC_FROM go. Null and empty texts are scored as any."""
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), carry=True)
    return scored.where(F.col("score") < TOXIC_FROM).select("row.*").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on ten or more sources go but for their first occurrence; n_chars follows the text. No document goes."""
    cleaned = remove_boilerplate(docs, min_sites=10)
    size = F.when(F.col("line__removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", size).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one of the smallest doc_id: SimHash fingerprints at 4 or fewer differing bits, and MinHash bands beyond, propose pairs; five-word shingle sets of Jaccard similarity 0.8 or more decide."""
    return keep_one_similar(docs, shingle=5, least=0.8, radius=4).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled towards tempered source, language and topic shares, 0.9 of the tokens in all."""
    return mix(docs).where("mix__kept").select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every document."""
    path = bpe.default_path(spark)
    encoded, _ = written(bpe.encode(docs, path))  # else a task would hold workers for both ways at once
    return bpe.digests(encoded, path, keep_ids=True)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("tokenise", tokenise)]

#: Trained trees, components of similar sets and byte-pair merges are not SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
