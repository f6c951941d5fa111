"""Whitening of vectors by an eigendecomposition with cyclic Jacobi rotations.

Components become whole numbers floor(scale * c). A constant that is added to all of them falls out of everything here, since only
differences from the mean are used; so none is added, and no digits are lost to one. Two passes over the vectors give exact integers:
the sums of each dimension, then the scatter of the vectors centred at the whole numbers next to the mean (what is left of the mean is
taken out exactly, in integers, on the driver). The covariance is then rounded once.

The driver, which holds one matrix of the vectors' width, rotates pairs of dimensions until every off-diagonal entry is negligible
beside the two diagonal entries that it joins, which keeps small eigenvalues accurate too. A sweep visits every pair once, in rounds of
disjoint pairs that are rotated at the same time. Components are sorted by eigenvalue; the matrix that whitens, components over the roots
of their eigenvalues, goes to the workers.

A last pass measures the covariance of what was whitened. Sums are of wholes and the driver's part is deterministic, so components do not
depend on how rows are dealt.

Defined cases: vectors that are null or hold a null or non-finite component take no part; a component of
2^500 or more when scaled counts as non-finite. Repeated rows count row by row, rows with null ids too. Vectors of several lengths are filled up with zeros.
A component without variance has whitened null and explained 0 (null if nothing varies at all), and stays out of the identity error,
which is null if none is left. A deviation beyond 63 bits is reported as the end of the range of longs. Equal eigenvalues come in the
order of the dimensions that they grew from. Without rows the result is empty. Other columns are not looked at.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fields_of, stored
from .vectors import SUMS, as_integers, extent, limbs, matrix, parts_of, summed, to_long, whole_numbers

#: Rows that a task multiplies at a time, and numbers up to which products of so many are exact in doubles.
STEP, EXACT = 1024, float(1 << 21)
#: Numbers of this size or more have no square among doubles.
MOST = 2.0**500


def rotate(matrix: np.ndarray, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (as columns) of a symmetric matrix, by cyclic Jacobi rotations."""
    a, n = np.array(matrix, np.float64), len(matrix)
    vectors, tiny = np.eye(n), np.finfo(np.float64).eps
    seats = list(range(n + n % 2))  # a tournament: in each round every dimension meets another one
    for _ in range(most_sweeps):
        rotated = False
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(min(x, y), max(x, y)) for x, y in zip(seats[:half], seats[half:][::-1]) if max(x, y) < n]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            p, q = np.array(pairs, np.int64).reshape(-1, 2).T
            some = np.abs(a[p, q]) > tiny * np.sqrt(np.abs(a[p, p] * a[q, q]))
            p, q = p[some], q[some]
            if not len(p):
                continue
            rotated = True
            with np.errstate(over="ignore"):
                theta = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.sqrt(theta * theta + 1))
            c = 1 / np.sqrt(t * t + 1)
            s = t * c
            off, pp, qq = a[p, q].copy(), a[p, p].copy(), a[q, q].copy()
            rows_p, rows_q = a[p].copy(), a[q].copy()
            a[p], a[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
            cols_p, cols_q = a[:, p].copy(), a[:, q].copy()
            a[:, p], a[:, q] = c * cols_p - s * cols_q, s * cols_p + c * cols_q
            a[p, p], a[q, q], a[p, q], a[q, p] = pp - t * off, qq + t * off, 0.0, 0.0
            v_p, v_q = vectors[:, p].copy(), vectors[:, q].copy()
            vectors[:, p], vectors[:, q] = c * v_p - s * v_q, s * v_p + c * v_q
        if not rotated:
            break
    else:
        raise RuntimeError("rotations did not settle")
    values = np.diag(a).copy()
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


class Whitening:
    """What the workers need: the whole numbers at the centre, what is left of the mean, and the whitening matrix."""

    def __init__(self, n: int, sums: list[int], centre: list[int], scatter: list[int], most: int):
        width = len(sums)
        rest = [s - n * m for s, m in zip(sums, centre)]
        cov = np.empty((width, width))
        at = 0
        for i in range(width):
            for j in range(i, width):
                cov[i, j] = cov[j, i] = float(Fraction(n * scatter[at] - rest[i] * rest[j], n * n))
                at += 1
        self.n, self.sums, self.centre = n, sums, centre
        self.rest = np.array([float(Fraction(r, n)) for r in rest])
        values, vectors = rotate(cov)
        self.values, self.vectors = values[:most], vectors[:, :most]
        trace = float(np.trace(cov))
        # what rounding alone can leave of an eigenvalue of zero
        self.varies = self.values > width * np.finfo(np.float64).eps * max(values[0] if width else 0.0, 0.0)
        self.explained = np.where(self.varies, self.values / trace, 0.0) if trace > 0 else None
        self.matrix = np.where(self.varies, self.vectors / np.sqrt(np.where(self.varies, self.values, 1.0)), 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Distances of whole numbers from the mean: exact up to one rounding."""
        if not len(self.centre) or max(map(abs, self.centre)) < 1 << 52:
            return x - np.array(self.centre, np.float64) - self.rest
        return (as_integers(x) - np.array(self.centre, object)).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray, largest: int) -> pa.Array:
        """The sum over dimensions of (n * x - sum)^2, exact."""
        if 4 * self.n * self.n * max(1, largest) ** 2 * max(1, x.shape[1]) < 1 << 63:
            y = self.n * x.astype(np.int64) - np.array(self.sums, np.int64)
            return pa.array((y * y).sum(1))
        y = self.n * as_integers(x) - np.array(self.sums, object)
        return to_long((y * y).sum(1))


def _sums(rows: DataFrame, width: int, n: int, largest: int) -> list[int]:
    """The sum of each dimension."""
    n_limbs = limbs(n * max(1, largest))

    def run(batches):
        total = np.zeros(width, object if n_limbs > 1 else np.int64)
        for batch in batches:
            x = matrix(batch.column("v"), width)
            total += (as_integers(x) if n_limbs > 1 else x.astype(np.int64)).sum(0)
        yield from parts_of(total, n_limbs)

    return summed(rows.select("v").mapInArrow(run, SUMS), width, n_limbs)


def _scatter(rows: DataFrame, centre: list[int], n: int, largest: int) -> list[int]:
    """The upper triangle of the summed products of centred vectors, row by row."""
    width = len(centre)
    n_limbs = limbs(n * (2 * max(1, largest)) ** 2)
    shared = rows.sparkSession.sparkContext.broadcast(np.array(centre, object))

    def run(batches):
        centre = shared.value
        upper = np.triu_indices(width)
        total = np.zeros((width, width), object if n_limbs > 1 else np.int64)
        for batch in batches:
            whole = matrix(batch.column("v"), width)
            for a in range(0, len(whole), STEP):
                x = whole[a : a + STEP]
                if 2 * largest < EXACT:
                    z = x - centre.astype(np.float64)
                    total += (z.T @ z).astype(np.int64)
                else:
                    z = as_integers(x) - centre
                    total += z.T @ z
        yield from parts_of(total[upper], n_limbs)

    found = summed(rows.select("v").mapInArrow(run, SUMS), width * (width + 1) // 2, n_limbs)
    shared.destroy()
    return found


def fit(rows: DataFrame, components: int = 32) -> tuple[Whitening, int] | None:
    """Whitening of a stored table with vectors v, and the largest number in it; None without rows."""
    size = extent(rows)
    n, largest = size["n"], size["largest"]
    if not n:
        return None
    sums = _sums(rows, size["width"], n, largest)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    return Whitening(n, sums, centre, _scatter(rows, centre, n, largest), components), largest


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """The largest entry of the covariance of all whitened vectors minus the identity: products are summed by task, then by the driver."""
    some = np.flatnonzero(model.varies)
    if not len(some):
        return None
    shared = rows.sparkSession.sparkContext.broadcast(model)
    size = len(some) + 1

    def run(batches):
        model = shared.value
        total = np.zeros((size, size))  # a last dimension of ones sums up the vectors themselves
        for batch in batches:
            y = model.centred(matrix(batch.column("v"), len(model.sums))) @ model.matrix[:, some]
            y = np.concatenate([y, np.ones((len(y), 1))], 1)
            total += y.T @ y
        at = np.arange(size)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(at, size)), pa.array(np.tile(at, size)), pa.array(total.ravel())], names=["i", "j", "x"])

    parts = rows.select("v").mapInArrow(run, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    shared.destroy()
    total = np.zeros((size, size))
    total[parts.column("i").to_numpy(), parts.column("j").to_numpy()] = parts.column("x").to_numpy()
    mean = total[:-1, -1] / model.n
    return float(np.abs(total[:-1, :-1] / model.n - np.outer(mean, mean) - np.eye(size - 1)).max())


def whiten(vectors: DataFrame, components: int = 32, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """A row for each vector and component (numbered from 1): vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = stored(whole_numbers(vectors, scale, embedding, {"vec_id": vec_id}, MOST), "whitening-vectors")
    schema = ", ".join([*fields_of(rows, ["vec_id"]), "component int, n long, deviation long, whitened double, explained double, identity_error double"])
    fitted = fit(rows, components)
    if fitted is None:
        return rows.sparkSession.createDataFrame([], schema)
    model, largest = fitted
    error = identity_error(rows, model)
    shared = rows.sparkSession.sparkContext.broadcast((model, error))

    def run(batches):
        model, error = shared.value
        k = model.matrix.shape[1]
        for whole in batches:
            for a in range(0, whole.num_rows, STEP):
                batch = whole.slice(a, STEP)
                x = matrix(batch.column("v"), len(model.sums))
                m = len(x)
                each = pa.array(np.repeat(np.arange(m), k))
                y = (model.centred(x) @ model.matrix).ravel()
                explained = pa.nulls(m * k, pa.float64()) if model.explained is None else pa.array(np.tile(model.explained, m))
                columns = [batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), model.deviations(x, largest).take(each), pa.array(y, mask=np.tile(~model.varies, m)), explained, pa.array([error] * (m * k), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
