"""Exact top-k inner-product search over integer vectors by vector-approximation files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint
from graphloom.llm.vectors import QUERY, best, blocks_of, common_length, distinct_rows, kth, meet, read, valid

CELLS = 256


def approximate(x: np.ndarray) -> bytes:
    """A block's file: each component's least value and cell width in the block, then one byte a component, its cell."""
    low = x.min(axis=0)
    width = np.floor((x.max(axis=0) - low) / CELLS) + 1
    cell = np.minimum(np.floor((x - low) / width), CELLS - 1)  # beyond 2^53 the division can round up
    return low.astype("<f8").tobytes() + width.astype("<f8").tobytes() + cell.astype(np.uint8).tobytes()


def bounds(data: bytes, n: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the inner products of queries with a file's n vectors.

    A component lies in [low + cell * width, low + cell * width + width - 1]. The cells' products
    are in single precision unless they would leave its range; its rounding, and that of the rest, widens the bounds.
    """
    dim = q.shape[1]
    low, width = np.frombuffer(data, "<f8", 2 * dim).reshape(2, dim)
    cells = np.frombuffer(data, np.uint8, n * dim, 16 * dim).reshape(n, dim)
    step, base = q * width, q @ low
    kind = np.float32 if np.abs(step).max(initial=0) * CELLS * dim < 1e37 else np.float64
    centre = base[:, None] + (step.astype(kind) @ cells.T.astype(kind)).astype(np.float64)
    slack = (dim + 8) * 2.0**-23 * np.abs(step).sum(axis=1) * CELLS + 1e-12 * np.abs(q) @ (np.abs(low) + CELLS * width) + 1e-9
    lower = centre + (np.minimum(q, 0) @ (width - 1) - slack)[:, None]
    return lower, centre + (np.maximum(q, 0) @ (width - 1) + slack)[:, None]


def scanner(k: int):
    def scan(data: bytes, n: int, q: np.ndarray, same: np.ndarray, state: dict):
        lower, upper = bounds(data, n, q)
        lower[same] = -np.inf
        seen = np.concatenate((state.get("best", np.full((len(q), k), -np.inf)), lower), axis=1)
        state["best"] = np.partition(seen, seen.shape[1] - k, axis=1)[:, -k:]
        row, col = np.nonzero((upper >= state["best"].min(axis=1)[:, None]) & ~same)
        return row, col, (lower[row, col], upper[row, col])

    return scan


def candidates(data: DataFrame, asked: DataFrame, k: int, block_rows: int = 4096) -> DataFrame:
    """(query_id, qh, vec_id, h, lower, upper) of the vectors that the bounds alone can't rule out: the scan of the file."""
    exact = lambda x: x.astype("<f8").tobytes()
    found = meet(blocks_of(data, block_rows, approximate), blocks_of(asked, 256, exact), scanner(k), "lower double, upper double")
    return kth(found, k, "lower", False).where(F.col("edge").isNull() | (F.col("upper") >= F.col("edge"))).drop("edge")


def whole(rows: DataFrame, scale: float) -> DataFrame:
    """Components as whole numbers; one that no long holds is an error."""
    return rows.withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("bigint")))


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k largest integer inner products, ties to the smaller id.

    A component x counts as floor(scale * x), x as double. The file holds one byte a component, the
    number of its cell between the least and largest value of its block. Every block of the file
    meets every block of queries; what the bounds can't rule out goes on, ids and bounds only.
    Exact vectors are then read in the order of their upper bounds: the first 2k of each query,
    then those whose bound reaches the kth score so far; with these the kth result is certain.
    The scan is queries times vectors, as any exact search of this kind is.

    queries and vectors have the same columns; a vector is no candidate of a query with its own
    id. Vectors that are null, empty, of another length than most, or hold null or non-finite
    components take no part on either side, nor do rows without an id. Scores are summed as 38-digit decimals; a component or a
    score that no long holds ends the job with an overflow error, nothing is cut. Repeated rows are candidates each for themselves and one query;
    rows of one id with different vectors are queries each for themselves. With fewer than k
    candidates all are returned. Only the two named columns are read; no queries or no vectors
    give no rows.
    """
    own, ask = valid(vectors, id_col, vec_col), valid(queries, id_col, vec_col)
    dim = common_length(own)
    data, asked = distinct_rows(whole(own, scale), dim), distinct_rows(whole(ask, scale), dim)
    near = kth(candidates(data, asked, k, block_rows), 2 * k, "upper", False)
    near = checkpoint(near.withColumn("first", F.col("edge").isNull() | (F.col("upper") >= F.col("edge"))).drop("edge"))
    digits = lambda x: x.cast("decimal(38,0)")
    score = lambda pairs: read(pairs, data, asked, lambda a, b: digits(a.cast("decimal(19,0)") * b.cast("decimal(19,0)")), digits(F.lit(0)), digits).withColumn("score", F.col("sum").cast("bigint")).drop("sum")
    one = checkpoint(score(near.where("first")))
    sure = kth(one, k, "score", False).groupBy(*QUERY).agg(F.max("edge").alias("edge"))
    two = score(near.where("NOT first").join(sure, QUERY).where(F.col("edge").isNull() | (F.col("upper") >= F.col("edge"))).drop("edge"))
    return best(one.unionByName(two), k, ascending=False)
