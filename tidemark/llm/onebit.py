"""Nearest neighbours by randomly rotated one-bit codes with error bounds and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .caps import usable
from .common import save


class OneBit:
    """Codes of ``bits`` signs of the zero-padded, randomly rotated vector, with what is needed to undo their bias.

    For a unit vector o with signs s / sqrt(bits), <o, q> is estimated by <s, q> / (sqrt(bits) <o, s / sqrt(bits)>); the
    error is below ``sigmas`` * sqrt((1 - c^2) / c^2 / (bits - 1)) with c = <o, s / sqrt(bits)>, up to a probability that
    falls as exp(-sigmas^2 / 2).
    """

    def __init__(self, dim: int, bits: int = 512, sigmas: float = 3.0, seed: int = 9):
        self.bits = 64 * -(-max(bits, dim) // 64)
        self.sigmas = sigmas
        self.rotation = np.linalg.qr(np.random.default_rng(seed).standard_normal((self.bits, self.bits)))[0][:dim]

    def code(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed sign words, and c of each vector."""
        y = unit @ self.rotation
        return np.packbits(y > 0, axis=1).view(np.uint64), np.abs(y).sum(axis=1) / np.sqrt(self.bits)

    def planes(self, unit_queries: np.ndarray, depth: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rotated queries in ``depth`` bit planes: (planes, low, step, total), so that <s, q> is a few popcounts."""
        y = unit_queries @ self.rotation
        low = y.min(axis=1, keepdims=True)
        step = np.maximum((y.max(axis=1, keepdims=True) - low) / ((1 << depth) - 1), 1e-300)
        level = np.rint((y - low) / step).astype(np.uint8)
        return np.stack([np.packbits(level >> p & 1, axis=1).view(np.uint64) for p in range(depth)]), low[:, 0], step[:, 0], level.sum(axis=1, dtype=np.int64)

    def bounds(self, query: tuple, words: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of <o, q> of one query to every code, and how far off they may be."""
        planes, low, step, total = query
        inner = sum(np.bitwise_count(words & planes[p]).sum(axis=1, dtype=np.int64) << p for p in range(len(planes)))
        ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        signed = 2 * (low * ones + step * inner) - (low * self.bits + step * total)
        return signed / np.sqrt(self.bits) / c, self.sigmas * np.sqrt(np.maximum(1 - c * c, 0) / (c * c) / (self.bits - 1)) + self.sigmas * 0.29 * step / c  # the last from the planes' rounding


def measured(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of unit length, and their lengths as m * 2**e, which holds the length of any finite vector."""
    most = np.abs(x).max(axis=1)
    m, e = np.frexp(most)
    x = x / most[:, None]
    n = np.linalg.norm(x, axis=1)
    return x / n[:, None], m * n, e.astype(np.int64)


def distance_bounds(m: np.ndarray, e: np.ndarray, query: tuple[float, int], est: np.ndarray, err: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances from one query, in units of its length, to vectors of lengths m * 2**e whose
    cosine is est +- err."""
    r = np.ldexp(m / query[0], np.clip(e - query[1], -1000, 1000).astype(np.int32))
    far = r > 1e100  # squares overflow
    near = np.where(far, 0.0, r)
    least, most = (np.sqrt(np.maximum(1 + near * near - 2 * near * t, 0.0)) for t in (np.minimum(est + err, 1.0), np.maximum(est - err, -1.0)))
    return np.where(far, r - 1, least), np.where(far, r + 1, most)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows, each pair scaled by a power of two where its squares would leave the range of doubles."""
    p = np.frexp(np.maximum(np.abs(x).max(axis=1), np.abs(y).max(axis=1)))[1]
    p = np.where(np.abs(p) > 400, p, 0)
    d = np.ldexp(x, -p[:, None]) - np.ldexp(y, -p[:, None])
    return np.ldexp(np.sqrt((d * d).sum(axis=1)), p)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    v = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def codes(good: DataFrame, bits: int) -> DataFrame:
    """(row, dim, words, c, m, e) of good(row, dim, v): a vector's code and scalars, 170 bytes or so at 1,024 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders: dict[int, OneBit] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = batch.take(pa.array(np.nonzero(dims == dim)[0]))
                u, m, e = measured(_matrix(own.column("v")))
                words, c = coders.setdefault(int(dim), OneBit(int(dim), bits)).code(u)
                yield pa.RecordBatch.from_arrays([own.column("row"), own.column("dim"), pa.array([w.tobytes() for w in words], pa.binary()), pa.array(c), pa.array(m), pa.array(e)], names=["row", "dim", "words", "c", "m", "e"])

    return good.select("row", "dim", "v").mapInArrow(run, "row long, dim int, words binary, c double, m double, e long")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, part: int = 20_000, query_block: int = 4096, bits: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k nearest other vectors by Euclidean distance.

    vectors(vec_id, embedding, ...); queries are the rows where is_query holds. Vectors that are null, empty or zero or
    hold null or non-finite components take no part, nor do rows with a null vec_id. Every row is a vector of its own: rows
    that repeat a vec_id are candidates each, for each other too, and queries each. Ties go to the smaller vec_id. Queries
    only meet vectors of their own dimension. With fewer than k candidates all are returned; an empty table gives an empty
    result. Other columns are ignored.

    Codes are computed once and dealt into parts of about ``part``, queries into blocks of about ``query_block``, so a task
    holds a part's codes and a block whatever the sizes; vectors stay where they are. The codes give every candidate a lower
    and upper bound; those whose lower bound is within the k-th smallest upper bound, of their part and then of all, are
    joined with their vectors and reranked exactly, in double precision, whatever the magnitudes.
    """
    good = save(usable(vectors).withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    queries = good.where(is_query)
    coded = save(codes(good, bits), "codes")
    n, q = coded.count(), queries.count()
    n_parts, n_blocks = max(1, -(-n // part)), max(1, -(-q // query_block))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    rows = coded.withColumn("p", F.pmod(F.xxhash64("row"), F.lit(n_parts)).cast("int")).withColumn("b", every(n_blocks))
    asked = queries.select("row", "dim", "v", F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(n_blocks)).cast("int").alias("b")).withColumn("p", every(n_parts))
    schema = pa.schema([("q", pa.int64()), ("row", pa.int64()), ("least", pa.float64()), ("most", pa.float64())])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return schema.empty_table()
        ids, qids, qx = left.column("row").to_numpy(), right.column("row").to_numpy(), _matrix(right.column("v"))
        coder = OneBit(qx.shape[1], bits)
        words = np.frombuffer(b"".join(left.column("words").to_pylist()), np.uint64).reshape(len(ids), -1)
        c, m, e = (left.column(x).to_numpy() for x in ("c", "m", "e"))
        qu, qm, qe = measured(qx)
        planes, low, step, total = coder.planes(qu)
        found: list[tuple] = []
        for i in range(len(qids)):
            est, err = coder.bounds((planes[:, i], low[i], step[i], total[i]), words, c)
            least, most = distance_bounds(m, e, (qm[i], qe[i]), est, err)
            other = ids != qids[i]
            limit = np.partition(most[other], k - 1)[k - 1] if other.sum() > k else np.inf
            at = np.nonzero(other & (least <= limit))[0]
            found.append((np.full(len(at), qids[i]), ids[at], least[at], most[at]))
        return pa.table([np.concatenate(c) for c in zip(*found)], schema=schema)

    hits = rows.groupBy("dim", "p", "b").cogroup(asked.groupBy("dim", "p", "b")).applyInArrow(search, "q long, row long, least double, most double")
    hits = save(hits, "hits")
    place = F.row_number().over(Window.partitionBy("q").orderBy("most"))
    limits = hits.select("q", "most", place.alias("n")).where(F.col("n") == k).select(F.col("q").alias("_q"), F.col("most").alias("limit"))
    left = hits.join(limits, F.col("q") == F.col("_q"), "left").where(F.col("limit").isNull() | (F.col("least") <= F.col("limit"))).select("q", F.col("row").alias("x"))
    near = left.join(good.select("row", "vec_id", "v"), F.col("x") == F.col("row")).drop("row", "x")
    both = near.join(queries.select("row", F.col("vec_id").alias("query_id"), F.col("v").alias("w")), F.col("q") == F.col("row")).select("q", "query_id", "vec_id", "v", "w", F.size("v").alias("dim"))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = batch.take(pa.array(np.nonzero(dims == dim)[0]))
                score = distances(_matrix(own.column("v")), _matrix(own.column("w")))
                yield pa.RecordBatch.from_arrays([*(own.column(x) for x in ("q", "query_id", "vec_id")), pa.array(score)], names=["q", "query_id", "vec_id", "score"])

    scored = both.mapInArrow(rerank, "q long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
