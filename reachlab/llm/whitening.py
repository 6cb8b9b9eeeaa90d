"""PCA whitening of embeddings from exact polarised covariances.

Vectors become integers (floor(64 c) + 1000000) and are centred before anything is
squared. Only squares are ever summed: of each dimension and of each sum of two
dimensions, as whole numbers. Cross-covariances are differences of variances,

    cov(i, j) = (var(x_i + x_j) - var(x_i) - var(x_j)) / 2,

so every entry of the matrix is one exact fraction, rounded once, before the
eigenvectors are taken.

Centring happens at the whole number nearest to the mean, which the sums of what
is left correct exactly: n sum(z^2) - sum(z)^2 is n^2 times the variance.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, rows_of

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 16
# Scaled entries beyond this count as this: sums of squares of 10^9 rows then fit into 38 digits.
LARGEST = 1 << 46
ROWS = 1024  # rows of one block of arithmetic
_WHOLE = pa.decimal128(38, 0)
_MAX = (1 << 63) - 1


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x): the vectors that take part, as whole numbers."""
    c = F.col("c")
    sound = F.col("c").isNotNull() & F.forall("c", lambda v: F.coalesce(
        ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), F.lit(False)))
    near = lambda v: F.greatest(F.least(F.lit(float(SCALE)) * v, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))
    return rows_of(embeddings, ["vec_id", "embedding"]).select(
        "vec_id", F.col("embedding").cast("array<double>").alias("c")).where(sound).select(
        "vec_id", F.transform(c, lambda v: F.floor(near(v)).cast("long") + F.lit(SHIFT)).alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, dict[int, np.ndarray]]]:
    """Batches of at most ROWS rows with, for each length of vector, the numbers of its rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            lengths = part.column(column).value_lengths().to_numpy(zero_copy_only=False)
            yield part, {int(d): np.flatnonzero(lengths == d) for d in np.unique(lengths)}


def _matrix(part: pa.RecordBatch, column: int, at: np.ndarray, dims: int) -> np.ndarray:
    return part.column(column).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dims)


def _whole(x: np.ndarray, bound: int) -> np.ndarray:
    """``x`` as it is if results up to ``bound`` fit into 64 bits, else as Python integers."""
    return x if bound <= _MAX else x.astype(object)


def _sums_of_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dims, i, n, total) per partition: how many vectors, and the sum of their dimension ``i``."""
    count: dict[int, int] = defaultdict(int)
    total: dict[int, np.ndarray] = {}
    for part, lengths in _blocks(batches, 0):
        for dims, at in lengths.items():
            x = _matrix(part, 0, at, dims)
            count[dims] += len(at)
            total[dims] = total.get(dims, 0) + x.sum(axis=0).astype(object)
    rows = [(d, i, count[d], s) for d in count for i, s in enumerate(total[d])]
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
         pa.array([r[2] for r in rows], pa.int64()), pa.array([Decimal(int(r[3])) for r in rows], _WHOLE)],
        names=["dims", "i", "n", "total"])


def _sums_of_squares(centres: dict[int, np.ndarray]) -> Callable:
    """(dims, i, j, total, squares) per partition, of z_i where i = j, else of z_i + z_j."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        squares: dict[tuple[int, int], np.ndarray] = {}
        for part, lengths in _blocks(batches, 0):
            for dims, at in lengths.items():
                if not dims:
                    continue
                z = _matrix(part, 0, at, dims) - centres[dims]
                largest = int(np.abs(z).max())
                z = _whole(z, len(at) * (2 * largest) ** 2)
                for i in range(dims):
                    pair = z[:, i:] + z[:, i:i + 1]
                    pair[:, 0] = z[:, i]
                    key = (dims, i)
                    total[key] = total.get(key, 0) + pair.sum(axis=0).astype(object)
                    squares[key] = squares.get(key, 0) + (pair * pair).sum(axis=0).astype(object)
        for (dims, i), s in squares.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dims] * len(s), pa.int32()), pa.array([i] * len(s), pa.int32()),
                 pa.array(range(i, dims), pa.int32()), pa.array([Decimal(int(v)) for v in total[dims, i]], _WHOLE),
                 pa.array([Decimal(int(v)) for v in s], _WHOLE)],
                names=["dims", "i", "j", "total", "squares"])
    return sums


def covariance(n: int, total: dict[tuple[int, int], int], squares: dict[tuple[int, int], int], dims: int) -> np.ndarray:
    """The matrix from the sums of values and squares of z_i (at (i, i)) and of z_i + z_j (at (i, j))."""
    spread = {k: n * squares[k] - total[k] ** 2 for k in squares}  # n^2 times a variance
    out = np.zeros((dims, dims))
    for i in range(dims):
        out[i, i] = spread[i, i] / (n * n)
        for j in range(i + 1, dims):
            out[i, j] = out[j, i] = (spread[i, j] - spread[i, i] - spread[j, j]) / (2 * n * n)
    return out


def components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and their unit vectors (columns); the largest entry of each is positive.

    Eigenvalues are the vectors' Rayleigh quotients in extended precision, whose
    error is the square of the vectors'. What is zero to the matrix's precision is 0.
    """
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    fine = vectors.astype(np.longdouble)
    quotients = np.einsum("ik,ij,jk->k", fine, v.astype(np.longdouble), fine) / (fine * fine).sum(axis=0)
    floor = np.abs(v).max(initial=0.0) * len(v) * np.finfo(float).eps
    values = np.where(quotients > floor, quotients, 0).astype(float)
    flip = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * flip


class _Fit:
    """One length of vector: how its rows are centred, rotated and scaled."""

    def __init__(self, n: int, sums: list[int], v: np.ndarray, centre: np.ndarray, k: int):
        self.n, self.centre = n, centre
        self.rest = np.array([s - n * int(m) for s, m in zip(sums, centre, strict=True)], dtype=object)
        self.offset = np.array([int(r) / n for r in self.rest])  # of the mean from the centre
        self.values, vectors = components(v, k)
        self.explained = self.values / max(np.trace(v), np.finfo(float).tiny)
        self.live = self.values > 0
        self.project = np.where(self.live, vectors / np.sqrt(np.where(self.live, self.values, 1)), 0)
        self.identity_error = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.centre).astype(float) - self.offset) @ self.project

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum of (n x - S)^2 of each row, exact, held within 64 bits."""
        z = x - self.centre
        largest = self.n * int(np.abs(z).max(initial=0)) + max(map(abs, self.rest), default=0)
        if x.shape[1] * largest ** 2 <= _MAX:
            d = self.n * z - self.rest.astype(np.int64)
            return (d * d).sum(axis=1).tolist()
        d = self.n * z.astype(object) - self.rest
        return [min(int(s), _MAX) for s in (d * d).sum(axis=1)]


def _moments(fits: dict[int, _Fit]) -> Callable:
    """(dims, a, b, total, product) per partition, of the whitened vectors' components."""
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        product: dict[int, np.ndarray] = {}
        for part, lengths in _blocks(batches, 0):
            for dims, at in lengths.items():
                if dims:
                    w = fits[dims].whiten(_matrix(part, 0, at, dims))
                    total[dims] = total.get(dims, 0) + w.sum(axis=0)
                    product[dims] = product.get(dims, 0) + w.T @ w
        for dims, p in product.items():
            a, b = np.indices(p.shape).reshape(2, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([dims] * p.size, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()),
                 pa.array(total[dims][a]), pa.array(p.ravel())], names=["dims", "a", "b", "total", "product"])
    return moments


def _fitted(fit_list: DataFrame, k: int) -> dict[int, _Fit]:
    sums: dict[int, list] = defaultdict(list)
    rows = fit_list.mapInArrow(_sums_of_values, "dims int, i int, n long, total decimal(38,0)") \
        .groupBy("dims", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    for r in rows.orderBy("dims", "i").collect():  # one number per dimension
        sums[r["dims"]].append((r["n"], int(r["total"])))
    centres = {d: np.array([(2 * s + n) // (2 * n) for n, s in found], dtype=np.int64) for d, found in sums.items()}
    total: dict[int, dict] = defaultdict(dict)
    squares: dict[int, dict] = defaultdict(dict)
    rows = fit_list.mapInArrow(_sums_of_squares(centres),
                               "dims int, i int, j int, total decimal(38,0), squares decimal(38,0)") \
        .groupBy("dims", "i", "j").agg(F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    for r in rows.collect():  # one number per pair of dimensions
        total[r["dims"]][r["i"], r["j"]] = int(r["total"])
        squares[r["dims"]][r["i"], r["j"]] = int(r["squares"])
    fits = {}
    for d, found in sums.items():
        n = found[0][0]
        v = covariance(n, total[d], squares[d], d)
        fits[d] = _Fit(n, [s for _, s in found], v, centres[d], min(k, d))
    if fits:
        _measure(fit_list, fits)
    return fits


def _measure(fit_list: DataFrame, fits: dict[int, _Fit]) -> None:
    """Set each fit's ``identity_error`` from the whitened fit list itself."""
    rows = fit_list.mapInArrow(_moments(fits), "dims int, a int, b int, total double, product double") \
        .groupBy("dims", "a", "b").agg(F.sum("total").alias("total"), F.sum("product").alias("product")).collect()
    means = {(r["dims"], r["a"]): r["total"] / fits[r["dims"]].n for r in rows}
    for r in rows:
        fit, a, b = fits[r["dims"]], r["a"], r["b"]
        if fit.live[a] and fit.live[b]:
            covered = r["product"] / fit.n - means[r["dims"], a] * means[r["dims"], b]
            fit.identity_error = max(fit.identity_error, abs(covered - (a == b)))


def whiten(embeddings: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """Whitened vectors: (vec_id, component, n, deviation, whitened, explained, identity_error).

    ``embeddings``: vec_id, embedding (further columns play no part). Each
    distinct vector counts once in the fit, so copies do not weigh on it; every
    row that takes part is returned with its first ``k`` components.

    Null vectors and vectors with null or non-finite entries take no part.
    Repeated rows, also with one id, and null ids each get their own rows.
    Vectors of different lengths are fitted each length on its own, with at most
    as many components as dimensions; a vector without entries gives no row. A
    component without variance (eigenvalue 0 to double precision: a single
    vector, constant or dependent dimensions) has whitened and explained 0 and
    is left out of ``identity_error``. Scaled entries saturate at 2^46 either
    way, ``deviation`` at the largest 64-bit integer. An empty table gives none.

    What reaches the driver are sums per dimension and per pair of dimensions;
    the tasks get the centre and ``k`` vectors.
    """
    rows = integer_vectors(embeddings)
    fit_list = materialise(rows.select("x").distinct(), "fit-list")
    fits = _fitted(fit_list, k)

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, lengths in _blocks(batches, 1):
            for dims, at in lengths.items():
                if not dims:
                    continue
                fit, x = fits[dims], _matrix(part, 1, at, dims)
                m = len(fit.values)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.repeat(at, m))),
                     pa.array(np.tile(np.arange(1, m + 1), len(at)), pa.int32()),
                     pa.array(np.full(len(at) * m, fit.n), pa.int64()),
                     pa.array(np.repeat(np.array(fit.deviation(x), dtype=np.int64), m)),
                     pa.array(fit.whiten(x).ravel()), pa.array(np.tile(fit.explained, len(at))),
                     pa.array(np.full(len(at) * m, fit.identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(out, "vec_id long, component int, n long, deviation long, whitened double, "
                                "explained double, identity_error double")
