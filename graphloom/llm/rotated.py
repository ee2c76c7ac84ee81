"""Approximate nearest neighbours by randomly rotated one-bit codes with error bounds and reranking."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.vectors import best, blocks_of, common_length, distinct_rows, kth, meet, read, valid

#: Bits of a query's components, which meet the codes bit plane by bit plane.
PLANES = 6


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix: the Q of a normal matrix, with the signs that make it uniform."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def words_of(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words, the last one filled up with zeros."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view("<u8")


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray):
    """(packed sign bits of the rotated residuals, their norms, their inner products with their codes)."""
    turned = (x - centre) @ turn
    norm = np.linalg.norm(turned, axis=1)
    unit = turned / np.where(norm > 0, norm, 1)[:, None]
    agree = np.abs(unit).sum(axis=1) / math.sqrt(x.shape[1])  # <o, code>, code = +-1/sqrt(dim)
    return words_of(unit > 0), norm, np.where(norm > 0, agree, 1.0)


def sign_products(turned: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inner products of the queries with the codes' signs, how far each query's may be off).

    A query's components become whole numbers of PLANES bits; bit plane and code are and-ed and
    counted word by word, so the codes are never unpacked.
    """
    low = turned.min(axis=1, keepdims=True)
    step = np.maximum((turned.max(axis=1, keepdims=True) - low) / (2**PLANES - 1), 1e-300)
    level = np.rint((turned - low) / step).astype(np.int64)
    total = np.zeros((len(turned), len(codes)), np.int32)
    for plane in range(PLANES):
        bits = words_of(level >> plane & 1)
        for w in range(codes.shape[1]):
            total += np.bitwise_count(bits[:, w, None] & codes[None, :, w]).astype(np.int32) << plane
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    at = low + level * step
    return 2 * (low * ones[None, :] + step * total) - at.sum(axis=1, keepdims=True), np.abs(turned - at).sum(axis=1)


def estimate(q: np.ndarray, centre: np.ndarray, turn: np.ndarray, codes: np.ndarray, norm: np.ndarray, agree: np.ndarray, epsilon: float):
    """Squared distances of every query to every coded vector: (estimate, half width of its bound)."""
    dim = q.shape[1]
    turned = (q - centre) @ turn
    q_norm = np.linalg.norm(turned, axis=1)
    signs, off = sign_products(turned, codes)
    inner = signs / math.sqrt(dim) / agree[None, :]  # |q| <q, o>
    error = epsilon * q_norm[:, None] * (np.sqrt(np.maximum(1 - agree**2, 0)) / agree / math.sqrt(max(1, dim - 1)))[None, :]
    error = error + off[:, None] / math.sqrt(dim) / agree[None, :]
    return q_norm[:, None] ** 2 + norm[None, :] ** 2 - 2 * norm[None, :] * inner, 2 * norm[None, :] * error


def coarse(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(components in one byte, each vector's step, how far it is from what these say): sure bounds for what the one-bit codes leave."""
    step = (np.maximum(np.abs(turned).max(axis=1), 1e-30) / 127).astype("<f4")
    step = np.nextafter(step, np.float32(np.inf))
    level = np.clip(np.rint(turned / step[:, None].astype(np.float64)), -127, 127).astype(np.int8)
    far = np.linalg.norm(turned - level * step[:, None].astype(np.float64), axis=1) * (1 + 1e-6)
    return level, step, np.nextafter(far.astype("<f4"), np.float32(np.inf))


def refine(turned: np.ndarray, level: np.ndarray, step: np.ndarray, far: np.ndarray, row: np.ndarray, col: np.ndarray):
    """(lower, upper) bounds of the squared distances of pairs (row of turned, col of level): the distance to the coarse vector, give or take how far that is off."""
    d = np.empty(len(row))
    for at in range(0, len(row), 1 << 15):
        r, c = row[at : at + (1 << 15)], col[at : at + (1 << 15)]
        d[at : at + (1 << 15)] = np.linalg.norm(turned[r] - level[c] * step[c, None], axis=1)
    slack = far[col] + 1e-9 * d  # rounding
    return np.maximum(d - slack, 0) ** 2 * (1 - 1e-9), (d + slack) ** 2 * (1 + 1e-9)


def scanner(k: int, centre: np.ndarray, turn: np.ndarray, epsilon: float):
    words = (len(centre) + 63) // 64

    def scan(data: bytes, n: int, q: np.ndarray, same: np.ndarray, state: dict):
        codes = np.frombuffer(data, "<u8", n * words).reshape(n, words)
        norm, agree, step, far = np.frombuffer(data, "<f4", 4 * n, 8 * n * words).reshape(4, n).astype(np.float64)
        level = np.frombuffer(data, np.int8, n * len(centre), (8 * words + 16) * n).reshape(n, -1)
        about, half = estimate(q, centre, turn, codes, norm, agree, epsilon)
        upper = about + half
        upper[same] = np.inf
        seen = np.concatenate((state.get("best", np.full((len(q), k), np.inf)), upper), axis=1)
        state["best"] = np.partition(seen, k - 1, axis=1)[:, :k]
        row, col = np.nonzero((about - half <= state["best"].max(axis=1)[:, None]) & ~same)
        low, high = refine((q - centre) @ turn, level, step, far, row, col)
        sure = state.get("sure", np.full((len(q), k), np.inf))
        order = np.lexsort((high, row))  # the kth smallest sure upper bound of each query, this block's and earlier ones'
        place = np.arange(len(row)) - np.searchsorted(row, row[order])
        few = place < k
        new = np.full((len(q), k), np.inf)
        new[row[order][few], place[few]] = high[order][few]
        state["sure"] = np.partition(np.concatenate((sure, new), axis=1), k - 1, axis=1)[:, :k]
        near = low <= state["sure"].max(axis=1)[row]
        return row[near], col[near], (low[near], high[near])

    return scan


def candidates(data: DataFrame, asked: DataFrame, k: int, dim: int, epsilon: float, seed: int, block_rows: int) -> DataFrame:
    """(query_id, qh, vec_id, h) of the vectors that the codes' error bounds choose for reranking."""
    means = data.select(F.posexplode("vec").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("m")).orderBy("d").collect()  # one row a component
    centre, turn = np.array([r["m"] for r in means]), rotation(dim, seed)

    def prepare(x: np.ndarray) -> bytes:
        codes, norm, agree = encode(x, centre, turn)
        level, step, far = coarse((x - centre) @ turn)
        return codes.tobytes() + norm.astype("<f4").tobytes() + agree.astype("<f4").tobytes() + step.tobytes() + far.tobytes() + level.tobytes()

    exact = lambda x: x.astype("<f8").tobytes()
    found = meet(blocks_of(data, block_rows, prepare), blocks_of(asked, 256, exact), scanner(k, centre, turn, epsilon), "lower double, upper double")
    return kth(found, k, "upper", True).where(F.col("edge").isNull() | (F.col("lower") <= F.col("edge"))).select("query_id", "qh", "vec_id", "h")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, epsilon: float = 1.5, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest vectors found, by Euclidean distance.

    Every vector is coded: its difference from the centre of all is rotated at random and kept as
    one bit a component, packed, with its norm and its inner product with the code as correction
    scalars, 16 bytes at 64 components. Codes estimate distances with a bound that holds with a
    probability set by epsilon (in standard widths). A vector is chosen if its lower
    bound is no worse than the query's kth smallest upper bound. Codes of one byte a component give the chosen ones sure bounds
    in the same task, which leave little more than the k nearest for reranking; only these are fetched
    as they are, by a join, and their scores are exact, in double precision.

    Vectors that are null, empty, zero, of another length than most, or hold null or non-finite
    components take no part on either side, nor do rows without an id; a vector is no candidate
    of a query with its own id. Repeated rows are candidates each for themselves and one query;
    rows of one id with different vectors are queries each for themselves. With fewer than k
    candidates all are returned. Only the two named columns are read; no queries or no vectors
    give no rows.
    """
    own, ask = valid(vectors, id_col, vec_col, drop_zero=True), valid(queries, id_col, vec_col, drop_zero=True)
    dim = common_length(own)
    data, asked = distinct_rows(own, dim), distinct_rows(ask, dim)
    if not dim:
        return asked.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    chosen = candidates(data, asked, k, dim, epsilon, seed, block_rows)
    scored = read(chosen, data, asked, lambda a, b: (a - b) * (a - b), F.lit(0.0))
    return best(scored.withColumn("score", F.sqrt("sum")), k, ascending=True)
