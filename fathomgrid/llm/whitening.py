"""Embedding whitening by QDWH spectral divide-and-conquer.

Vectors become whole numbers on a grid. The fit list holds each distinct vector once; its sums and its covariance's products
are summed by Spark as whole numbers, centred at the rounded mean before they are multiplied, so that the covariance is exact
up to its last rounding, whatever the partitions. The covariance, a square matrix of the vectors' dimension, is all that comes
to the driver. There the polar factor of the shifted covariance, found by the QR-based dynamically weighted Halley iteration,
gives the projector on the eigenvectors above the shift; a basis of either side compresses the matrix, and both parts are
split again until they are single numbers. Parts that hold no wanted component aren't split. Components and means are
broadcast, and every row is projected in its task.

Defined cases: rows whose vector is null, empty, or holds a null or non-finite entry are dropped, and those whose number of
entries isn't the most frequent one (of equally frequent ones the largest). Entries over 2^52 / 64 in size count as that.
Equal vectors teach once and are each returned; null and repeated ids are ordinary values. A component without variance (an eigenvalue
of less than 1e-12 of the trace) has `whitened` and `explained` 0 and no part in `identity_error`. `deviation` is null where it isn't within 64 bits.
Equal eigenvalues share a subspace, of which some orthonormal basis is taken. An empty table, or one without a
usable row, gives an empty result. Columns besides vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Steps of the grid for a unit, and what is added to make the numbers positive.
STEPS, SHIFT = 64, 1_000_000
#: Components that are returned, at most.
MOST = 16
#: Whole numbers that are exact as doubles are below this.
EXACT = 1 << 52
#: Share of the trace under which an eigenvalue counts as none.
NONE = 1e-12
ROWS = 4096


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows have entries that are all finite, their lengths, and the entries of all rows as doubles."""
    at = column.offsets.to_numpy()
    flat = column.values[at[0] : at[-1]]
    entries = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    lengths = np.diff(at)
    good = (lengths > 0) & column.is_valid().to_numpy(zero_copy_only=False)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(entries))))
    good &= bad[at[1:] - at[0]] == bad[at[:-1] - at[0]]
    return good, lengths, entries


def gridded(embeddings: DataFrame, length: int | None = None) -> DataFrame:
    """vec_id, x array<long> of the rows whose vector is whole and, if given, of that length."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, lengths, entries = _lists(batch.column(1))
            if length is not None:
                good &= lengths == length
            with np.errstate(over="ignore"):
                x = np.floor(np.clip(np.where(np.isfinite(entries), entries, 0) * STEPS, -EXACT, EXACT)).astype(np.int64) + SHIFT
            x = x[np.repeat(good, lengths)]
            at = np.concatenate(([0], np.cumsum(lengths[good]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.ListArray.from_arrays(pa.array(at), pa.array(x))], names=["vec_id", "x"])

    return embeddings.select("vec_id", "embedding").mapInArrow(grid, f"vec_id {kind}, x array<long>")


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column whose lists are equally long."""
    at = column.offsets.to_numpy()
    return column.values[at[0] : at[-1]].to_numpy().reshape(len(column), -1)


def _whole(rows: DataFrame, name: str) -> dict:
    """The sums of `value`, whole numbers as decimals, by the other columns; of the order of the dimension's square."""
    keys = [c for c in rows.columns if c != "value"]
    found = rows.groupBy(*keys).agg(F.sum("value").alias(name)).toArrow()
    return dict(zip(zip(*(found.column(k).to_pylist() for k in keys), strict=True), map(int, found.column(name).to_pylist()), strict=True))


def sums(fit: DataFrame) -> list[int]:
    """The sum of each dimension over the fit list's vectors x."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | int = 0
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column(0))
                total = total + np.array([int(a) * (1 << 24) + int(b) for a, b in zip((x >> 24).sum(0), (x & ((1 << 24) - 1)).sum(0), strict=True)], object)
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array([str(v) for v in total])], names=["i", "value"])

    found = _whole(fit.select("x").mapInArrow(add, "i int, value string").withColumn("value", F.col("value").cast("decimal(38,0)")), "total")
    return [found[(i,)] for i in range(len(found))]


def products(fit: DataFrame, centre: list[int]) -> dict[tuple[int, int], int]:
    """The sums of (x_i - centre_i) * (x_j - centre_j) over the fit list, for i <= j, exact."""
    middle = np.array(centre, np.int64)

    def gram(y: np.ndarray) -> np.ndarray:
        most = int(np.abs(y).max(initial=0))
        if most * most * len(y) < EXACT:  # every partial sum is a whole number that doubles hold
            z = y.astype(np.float64)
            return (z.T @ z).astype(np.int64).astype(object)
        if most * most < EXACT and len(y) > 1:
            half = len(y) // 2
            return gram(y[:half]) + gram(y[half:])
        z = y.astype(object)
        return z.T.dot(z)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                g = gram(_matrix(batch.column(0).slice(k, ROWS)) - middle)
                total = g if total is None else total + g
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(v) for v in total[i, j]])], names=["i", "j", "value"])

    return _whole(fit.select("x").mapInArrow(add, "i int, j int, value string").withColumn("value", F.col("value").cast("decimal(38,0)")), "total")


def polar(a: np.ndarray) -> np.ndarray:
    """The unitary polar factor of a symmetric matrix, by the QR-based dynamically weighted Halley iteration.

    Singular values are brought from [l, 1] to 1 by rational steps whose weights follow from l, a lower bound that is taken
    as small as doubles allow where nothing better is known; each step is one QR factorisation of [sqrt(c) X; I]."""
    n = len(a)
    x = a / np.linalg.norm(a)
    low = np.finfo(float).eps / n
    for _ in range(30):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        root = np.sqrt(1 + d)
        p = root + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - low**2) / (low**2 * root))
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        factors, _ = np.linalg.qr(np.vstack((np.sqrt(r) * x, np.eye(n))))
        after = (q / r) * x + (p - q / r) / np.sqrt(r) * (factors[:n] @ factors[n:].T)
        after = (after + after.T) / 2
        moved = np.linalg.norm(after - x)
        x, low = after, min(1.0, low * (p + q * low**2) / (1 + r * low**2))
        if moved < 1e-15 * n**0.5 or (1 - low < 1e-15 and moved < 1e-6):
            break
    return x


def _split(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the subspaces above and below some shift, or None if the matrix is one number times the identity."""
    n = len(a)
    scale = np.linalg.norm(a)
    middle = np.trace(a) / n
    if np.linalg.norm(a - middle * np.eye(n)) <= 4 * np.finfo(float).eps * max(scale, np.finfo(float).tiny):
        return None
    for shift in (middle, *(middle + (np.linalg.norm(a - middle * np.eye(n)) / n**0.5) * t for t in (0.3, -0.3, 0.7, -0.7, 0.1, -0.1, 0.05, -0.05))):
        projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = round(float(np.trace(projector)))
        if not 0 < k < n or np.linalg.norm(projector @ projector - projector) > 1e-10 * n:
            continue  # the shift is an eigenvalue, or beyond all of them
        # a subspace iteration on the projector: one step from a random start is exact, the second takes away its rounding
        basis = np.linalg.qr(projector @ rng.normal(size=(n, k)))[0]
        basis = np.linalg.qr(np.hstack((projector @ basis, rng.normal(size=(n, n - k)))))[0]
        above, below = basis[:, :k], basis[:, k:]
        if np.linalg.norm(below.T @ a @ above) <= 1e-12 * scale:
            return above, below
    return None


def spectrum(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and their eigenvectors as columns."""
    rng = np.random.default_rng(0)

    def divide(basis: np.ndarray, wanted: int) -> list[np.ndarray]:
        part = basis.T @ a @ basis
        part = (part + part.T) / 2
        halves = _split(part, rng) if len(part) > 1 else None
        if halves is None:
            return list(basis.T)
        above = divide(basis @ halves[0], wanted)
        return above + (divide(basis @ halves[1], wanted - len(above)) if len(above) < wanted else [])

    vectors = np.array(divide(np.eye(len(a)), most)).T
    vectors = np.linalg.qr(vectors)[0]
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")[:most]
    return values[order], vectors[:, order]


class Whitening:
    """Means and components of a fit list of n distinct vectors."""

    def __init__(self, n: int, totals: list[int], products: dict[tuple[int, int], int], centre: list[int], most: int = MOST):
        d = len(totals)
        self.n, self.totals, self.centre = n, totals, np.array(centre, np.int64)
        off = [t - n * c for t, c in zip(totals, centre, strict=True)]
        #: What is left of the mean beside the centre.
        self.rest = np.array([float(Fraction(o, n)) for o in off])
        self.covariance = np.zeros((d, d))
        for (i, j), v in products.items():
            self.covariance[i, j] = self.covariance[j, i] = float(Fraction(n * v - off[i] * off[j], n * n))
        trace = float(np.trace(self.covariance))
        values, vectors = spectrum(self.covariance, min(most, d))
        self.good = values > NONE * trace
        self.explained = np.where(self.good, values / (trace or 1.0), 0.0)
        self.project = np.where(self.good, vectors / np.sqrt(np.where(self.good, values, 1.0)), 0.0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        y = (x - self.centre).astype(np.float64) - self.rest
        return np.einsum("ij,jk->ik", y, self.project)  # the same sums in every batch

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - S)^2 for each row, exact."""
        off = [t - self.n * int(c) for t, c in zip(self.totals, self.centre, strict=True)]
        y = x - self.centre
        most = max(int(np.abs(y).max(initial=0)) * self.n + max(map(abs, off)), 1)
        if most < 1 << 31 and most * most * x.shape[1] < 1 << 63:
            return (((y * self.n - np.array(off, np.int64)) ** 2).sum(1)).tolist()
        whole = ((y.astype(object) * self.n - np.array(off, object)) ** 2).sum(1)
        return [int(v) if v < 1 << 63 else None for v in whole]


def fitted(fit: DataFrame, most: int = MOST) -> Whitening | None:
    """The whitening of a stored fit list (x); None if it is empty."""
    n = fit.count()
    if not n:
        return None
    totals = sums(fit)
    centre = [(2 * t + n) // (2 * n) for t in totals]
    return Whitening(n, totals, products(fit, centre), centre, most)


def identity_error(fit: DataFrame, whitening: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance less the identity, over components with variance."""
    good = np.flatnonzero(whitening.good)
    if not len(good):
        return 0.0
    shared = fit.sparkSession.sparkContext.broadcast(whitening)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(good)
        total = np.zeros((k + 1, k))
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                w = shared.value.whitened(_matrix(batch.column(0).slice(a, ROWS)))[:, good]
                total[0] += w.sum(0)
                total[1:] += w.T @ w
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "value"])

    found = fit.select("x").mapInArrow(add, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow()
    total = np.zeros((len(good) + 1, len(good)))
    total[found.column("i").to_numpy(), found.column("j").to_numpy()] = found.column("value").to_numpy()
    mean = total[0] / whitening.n  # as good as zero, since whitened vectors are centred
    return float(np.abs(total[1:] / whitening.n - np.outer(mean, mean) - np.eye(len(good))).max())


def whitened(embeddings: DataFrame, most: int = MOST) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each usable row of embeddings (vec_id,
    embedding) and component."""
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    lengths = gridded(embeddings).groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if lengths is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    rows = gridded(embeddings, lengths["d"])
    fit = stored(rows.select("x").distinct(), "fit")
    model = fitted(fit, most)
    error = identity_error(fit, model)
    shared = embeddings.sparkSession.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.good)
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                some = batch.slice(a, ROWS)
                x = _matrix(some.column(1))
                size = len(x) * k
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))),
                        pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                        pa.array(np.full(size, m.n)),
                        pa.array([v for v in m.deviations(x) for _ in range(k)], pa.int64()),
                        pa.array(m.whitened(x).ravel()),
                        pa.array(np.tile(m.explained, len(x))),
                        pa.array(np.full(size, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(project, schema)
