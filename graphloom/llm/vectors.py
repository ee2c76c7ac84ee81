"""What the vector searches share: valid vectors, blocks of their codes, exact reads and the best of each query."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import parallelism

QUERY, VECTOR = ["query_id", "qh"], ["vec_id", "h"]


def valid(vectors: DataFrame, id_col: str, vec_col: str, drop_zero: bool = False) -> DataFrame:
    """(id, vec) of the vectors that are not null or empty and hold no null, NaN or infinity.

    drop_zero leaves out vectors whose components are all zero. Rows without an id leave too.
    """
    inside = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", inside))
    return rows.where(F.exists("vec", lambda x: x != 0)) if drop_zero else rows


def common_length(rows: DataFrame) -> int:
    """The length that most vectors have, the smaller of two as common; 0 without rows."""
    found = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return found["d"] if found else 0


def distinct_rows(rows: DataFrame, dim: int) -> DataFrame:
    """(id, h, vec, times) of the rows of that length: equal rows once, with their number; (id, h) names a row."""
    return rows.where(F.size("vec") == dim).groupBy("id", "vec").agg(F.count("*").alias("times")).withColumn("h", F.xxhash64("vec"))


def matrix(group: pa.Table) -> np.ndarray:
    lists = group["vec"].combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def blocks_of(rows: DataFrame, size: int, prepare) -> DataFrame:
    """Rows (block, ids, hs, data): about `size` rows packed in each, dealt by a hash of id and vector.

    prepare turns a block's matrix into the bytes that the scan wants.
    """
    n = max(1, math.ceil(rows.count() / size))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("id", "ascending"), ("h", "ascending")])
        packed = lambda c: pa.array([group[c].to_numpy().astype("<i8").tobytes()], pa.binary())
        return pa.table({"block": group["block"][:1].cast(pa.int32()), "ids": packed("id"), "hs": packed("h"), "data": pa.array([prepare(matrix(group))], pa.binary())})

    dealt = rows.select("id", "h", "vec", F.pmod(F.xxhash64("id", "h"), F.lit(n)).cast("int").alias("block"))
    return dealt.groupBy("block").applyInArrow(run, "block int, ids binary, hs binary, data binary")


def meet(codes: DataFrame, queries: DataFrame, scan, schema: str) -> DataFrame:
    """Every block of queries against every block of codes: (query_id, qh, vec_id, h) and the columns of `schema` of what scan leaves.

    The queries are a stated share of the table, so the number of meetings is that of a scan of all
    codes for each block of queries; a task holds two blocks. scan(codes, q, same, state) gives rows,
    columns and values; `state` is the query block's own dictionary while the task goes on, by
    which a later block knows the bounds of the earlier ones.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    q = queries.select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("hs").alias("q_hs"), F.col("data").alias("q_data"))

    def search(batches):
        states: dict[int, dict] = {}
        for b in batches:
            for i in range(b.num_rows):
                ids, hs, own, own_hs = (np.frombuffer(b[c][i].as_py(), "<i8") for c in ("ids", "hs", "q_ids", "q_hs"))
                vectors = np.frombuffer(b["q_data"][i].as_py(), "<f8").reshape(len(own), -1)
                state = states.setdefault(b["q_block"][i].as_py(), {})
                row, col, values = scan(b["data"][i].as_py(), len(ids), vectors, own[:, None] == ids[None, :], state)
                yield pa.record_batch({"query_id": own[row], "qh": own_hs[row], "vec_id": ids[col], "h": hs[col]} | dict(zip(names, values)))

    pairs = codes.repartition(2 * parallelism(codes.sparkSession), "block").crossJoin(q)
    return pairs.mapInArrow(search, f"query_id bigint, qh bigint, vec_id bigint, h bigint, {schema}")


def kth(rows: DataFrame, k: int, value: str, ascending: bool) -> DataFrame:
    """rows with `edge`: the kth best of `value` among each query's rows, null with fewer than k."""
    order = F.col(value).asc() if ascending else F.col(value).desc()
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(*QUERY).orderBy(order, *VECTOR)))
    return placed.withColumn("edge", F.max(F.when(F.col("place") == k, F.col(value))).over(Window.partitionBy(*QUERY))).drop("place")


def read(pairs: DataFrame, data: DataFrame, asked: DataFrame, term, start: Column, keep=lambda x: x) -> DataFrame:
    """pairs with the vectors' `times` and `sum`, of term(q, v) over the components, each sum in the type that keep casts to: the exact vectors by a join on (vec_id, h)."""
    vectors = data.select(F.col("id").alias("vec_id"), "h", F.col("vec").alias("v"), "times")
    queries = asked.select(F.col("id").alias("query_id"), F.col("h").alias("qh"), F.col("vec").alias("q"))
    both = pairs.join(vectors, VECTOR).join(queries, QUERY)
    return both.withColumn("sum", F.aggregate(F.zip_with("q", "v", term), start, lambda a, b: keep(a + b))).drop("q", "v")


def best(scored: DataFrame, k: int, ascending: bool) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best, ties to the smaller vec_id; a row that stands `times` times counts so often."""
    every = scored.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)).cast("int"))))
    order = [F.col("score").asc() if ascending else F.col("score").desc(), F.col("vec_id").asc()]
    rank = F.row_number().over(Window.partitionBy(*QUERY).orderBy(*order))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
