"""Whitening of embeddings: principal components by spectral divide and conquer over polar decompositions (QDWH)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import save

SCALE, SHIFT = 64, 1_000_000  # x = floor(SCALE * c) + SHIFT
_EPS = np.finfo(float).eps


# --- eigenvectors of a symmetric matrix, on the driver: as large as the vectors are long, whatever the table


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, its matrix sign, by dynamically weighted Halley steps in QR form.

    The weights follow the bound ``low`` on the least singular value of the scaled matrix; a start at machine precision is
    right for every matrix that has one, and takes six steps.
    """
    n = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    low, eye = _EPS / 4, np.eye(n)
    for _ in range(30):
        d = np.cbrt(4 * (1 - low * low) / low**4)
        s = math.sqrt(1 + d)
        p = s + 0.5 * math.sqrt(max(8 - 4 * d + 8 * (2 - low * low) / (low * low * s), 0.0))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        stack = np.linalg.qr(np.vstack([math.sqrt(r) * x, eye]))[0]
        y = q / r * x + (p - q / r) / math.sqrt(r) * stack[:n] @ stack[n:].T
        y = (y + y.T) / 2
        moved, x = np.linalg.norm(y - x), y
        low = min(low * (p + q * low * low) / (1 + r * low * low), 1.0)
        if abs(1 - low) < 10 * _EPS and moved < 10 * _EPS ** (1 / 3):  # the next step would change nothing: cubic convergence
            break
    return x


def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two complementary invariant subspaces of a symmetric matrix, of the larger eigenvalues first;
    None if all eigenvalues are the same to working precision.

    The sign of the matrix less a shift gives the projector on the eigenvalues above the shift. A shift that meets an
    eigenvalue gives no projector, or one that does not commute with the matrix: then the next one is tried.
    """
    n, scale = len(a), np.linalg.norm(a)
    centre = np.trace(a) / n
    spread = np.linalg.norm(a - centre * np.eye(n))
    if spread <= 4 * _EPS * n * scale:
        return None
    best = None
    diagonal = np.sort(np.diag(a))
    shifts = [float(np.median(diagonal)), centre, *(centre + spread / math.sqrt(n) * f for f in (0.03, -0.03, 0.11, -0.11, 0.29, -0.29, 0.61, -0.61)), *((diagonal[1:] + diagonal[:-1]) / 2)]
    for shift in shifts:
        projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        rank = round(float(np.trace(projector)))
        if not 0 < rank < n:
            continue
        basis = np.linalg.qr(projector @ np.random.default_rng(n).standard_normal((n, rank)))[0]
        basis = np.linalg.qr(projector @ basis)[0]
        whole = np.linalg.qr(np.hstack([basis, np.eye(n)]))[0]
        upper, lower = whole[:, :rank], whole[:, rank:n]
        off = np.linalg.norm(upper.T @ a @ lower)
        if best is None or off < best[0]:
            best = off, upper, lower
        if off <= 16 * _EPS * n * scale:
            break
    return best and (best[1], best[2])


def principal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its eigenvectors as columns: invariant subspaces are split until each
    has one direction, then all directions are refined together."""
    leaves: list[np.ndarray] = []
    open_ = [np.eye(len(a))] if len(a) else []
    while open_:
        basis = open_.pop()
        own = basis.T @ a @ basis
        parts = split((own + own.T) / 2) if basis.shape[1] > 1 else None
        if parts is None:
            leaves.append(basis)
        else:
            open_ += [basis @ parts[0], basis @ parts[1]]
    x = np.hstack(leaves) if leaves else np.zeros((0, 0))
    for _ in range(2):
        x = refine(a, x)
    values = np.einsum("ij,ik,kj->j", x, a, x)
    order = np.argsort(-values, kind="stable")
    return values[order], np.linalg.qr(x[:, order])[0]


def refine(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One step towards exact eigenvectors from near ones: each takes off its share of the others, to first order; between
    nearly equal eigenvalues only the angle is mended."""
    if not len(x):
        return x
    r, s = np.eye(len(a)) - x.T @ x, x.T @ a @ x
    values = np.diag(s) / np.maximum(1 - np.diag(r), 0.5)
    gap = values[None, :] - values[:, None]
    off = s - np.diag(np.diag(s))
    close = np.abs(gap) <= 2 * (np.linalg.norm(off) + np.linalg.norm(a) * np.linalg.norm(r)) + 1e-300
    e = np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1.0, gap))
    return x + x @ e


# --- the table


def whole_numbers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, dim, x array<long>): rows whose vector has neither nulls nor non-finite entries, nor any whose x no long holds."""
    v = F.col(column).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= 2.0**56))
    x = F.transform("v", lambda c: (F.floor(c * SCALE) + SHIFT).cast("long"))
    good = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)))
    return good.select("vec_id", F.size("v").alias("dim"), x.alias("x"))


def _matrix(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The rows of each dimension of a batch (.., dim, x): (dim, row numbers, a matrix of longs)."""
    dims, x = batch.column("dim").to_numpy(), batch.column("x")
    for dim in np.unique(dims):
        at = np.nonzero(dims == dim)[0]
        yield int(dim), at, x.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(dim))


def sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By dimension: how many vectors fit(dim, x) has, and their exact sums. Tasks hand on a row for a dimension's entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in _matrix(batch):
                own = np.array([[int(h), int(l)] for h, l in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))], object).reshape(-1, 2)
                total[dim] = total.get(dim, 0) + np.vstack([own, np.array([[0, len(x)]], object)])
        rows = [(d, k, str(int(h) * (1 << 32) + int(l))) for d, t in total.items() for k, (h, l) in enumerate(t)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 3, (pa.int32(), pa.int32(), pa.string()))], names=["dim", "k", "s"])

    got = fit.select("dim", "x").mapInArrow(run, "dim int, k int, s string").groupBy("dim", "k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out: dict[int, list[int]] = {}
    for r in sorted(got, key=lambda r: (r["dim"], r["k"])):
        out.setdefault(r["dim"], []).append(int(r["s"]))
    return {d: (s[-1], s[:-1]) for d, s in out.items()}


def moments(fit: DataFrame, centre: dict[int, np.ndarray], turn: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """By dimension the covariance (divisor: the number of rows) of fit(dim, x), centred first, then turned by a matrix.

    A task adds up products of its own rows and hands on a row for each entry of the upper triangle, which Spark adds: what
    comes to the driver is as large as the matrix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in _matrix(batch):
                y = centred(x, centre[dim])
                y = y if turn is None else y @ turn[dim]
                y = np.hstack([y, np.ones((len(y), 1))])
                total[dim] = total.get(dim, 0) + y.T @ y
        for dim, t in total.items():
            i, j = np.triu_indices(len(t))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(t[i, j])], names=["dim", "i", "j", "s"])

    rows = fit.select("dim", "x").mapInArrow(run, "dim int, i int, j int, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).collect()
    out: dict[int, np.ndarray] = {}
    for dim in {r["dim"] for r in rows}:
        own = [r for r in rows if r["dim"] == dim]
        m = np.zeros((max(r["j"] for r in own) + 1,) * 2)
        for r in own:
            m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["s"]
        mean = m[:-1, -1] / m[-1, -1]
        out[dim] = m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean)  # the mean of what is centred: only its rounding
    return out


Centre = tuple[np.ndarray, np.ndarray]


def centred(x: np.ndarray, centre: Centre) -> np.ndarray:
    """x less its centre, which is a long and a rest of at most a half: no digits are lost while the difference is exact."""
    return (x - centre[0]).astype(float) - centre[1]


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """sum((n * x - total)^2) of each row, exactly; None where no long holds it."""
    most = max((abs(n * int(v) - s) for lim in (x.min(axis=0), x.max(axis=0)) for v, s in zip(lim, total)), default=0)
    if most * most * max(x.shape[1], 1) < 1 << 63 and n * max(abs(int(x.min())), abs(int(x.max()))) < 1 << 63:
        u = n * x - np.array(total, np.int64)
        return (u * u).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, total)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def whiten(vectors: DataFrame, most: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row of vectors(vec_id,
    embedding, ...) and each of its first ``most`` components.

    Rows whose vector is null or has null or non-finite entries are dropped, as are those with an entry of 2**56 or more,
    whose x no long holds; a zero vector stays. Each entry c becomes x = floor(64 c) + 1000000, and each distinct x counts
    once in all sums. Vectors of different dimensions are tables of their own, each with its n, components and identity_error.
    A component along which the distinct vectors do not differ, to working precision, has no whitened values and is left out;
    so a single distinct vector gives no rows, and nor does an empty one. Repeated rows, and rows with a null vec_id, stay.
    deviation is null where no long holds it. An empty table gives an empty result; other columns are ignored.

    Sums and products come from two passes over the distinct vectors and a third measures identity_error; a matrix as wide as
    the vectors is all that the driver holds, for each dimension that occurs, and what it sends to the tasks.
    """
    rows = whole_numbers(vectors)
    fit = save(rows.select("dim", "x").distinct(), "fit")
    counted = {d: v for d, v in sums(fit).items() if d}
    centre = {d: _centre(n, s) for d, (n, s) in counted.items()}
    turn: dict[int, np.ndarray] = {}
    explained: dict[int, np.ndarray] = {}
    fit = fit.where(F.col("dim") > 0)
    for d, v in (moments(fit, centre) if centre else {}).items():
        values, x = principal(v)
        ok = values > d * _EPS * max(values[0], 0.0)
        k = min(int(ok.sum()), most)
        turn[d], explained[d] = x[:, :k] / np.sqrt(values[:k]), values[:k] / np.trace(v) if k else values[:0]
    error = {d: float(np.abs(v - np.eye(len(v))).max(initial=0.0)) for d, v in (moments(fit, centre, turn) if turn else {}).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id")
            for dim, at, x in _matrix(batch):
                if not dim or not turn[dim].shape[1]:
                    continue
                n, total = counted[dim]
                y = centred(x, centre[dim]) @ turn[dim]
                k = y.shape[1]
                rep = pa.array(np.repeat(np.arange(len(at)), k))
                deviation = pa.array(deviations(x, n, total), pa.int64())
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(at)).take(rep), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(k * len(at), n)),
                    deviation.take(rep), pa.array(y.ravel()), pa.array(np.tile(explained[dim], len(at))), pa.array(np.full(k * len(at), error[dim])),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def _centre(n: int, total: list[int]) -> Centre:
    whole = [(2 * s + n) // (2 * n) for s in total]
    return np.array(whole, np.int64), np.array([float(Fraction(s, n) - w) for s, w in zip(total, whole)])
