"""Compression of vectors to codes: a codebook for each part of the vectors, with annular norm pruning in the assignment.

Components become whole numbers floor(scale * x), so all distances are exact. Vectors are cut into equal consecutive parts; each part
position has a codebook that starts from the vectors with the smallest ids and is refined by a fixed number of rounds: every part is
assigned to its nearest entry (ties to the lower index), then each entry becomes the componentwise floor of the mean of its parts.

The assignment sorts a codebook's entries by norm. Since a distance is never below the difference of the norms, an entry as near as the
best one found so far lies in the ring of norms around the part's own, as wide as that best distance on either side. A part first looks
at the entries next to it in norm; a binary search then finds its ring, ends included, and only entries in the ring are compared.
Parts are taken in order of norm, so the rings of a block are one run of entries and are scored by one product of matrices.

Each round is one pass in which a task sums up its own rows; sums go to the driver, as many as the codebooks have numbers, whatever the
size of the table. Rows are written once and never shuffled.

Defined cases: vectors that are null or hold a null or non-finite component take no part; a component that leaves the range of doubles
when scaled counts as non-finite. Rows with a null id are coded and counted, after all others in the order of ids. Repeated rows and ids
count row by row; equal ids are ordered by their vectors. With fewer rows than entries the codebooks are shorter. Vectors of several
lengths, or of one that the parts do not divide, are filled up with zeros. Without rows the result is empty. Numbers of any size are
exact; an error beyond 63 bits is reported as the end of the range of longs. Null labels are one label. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fields_of, spread_join, stored
from .vectors import LONG, SUMS, as_integers, extent, limbs, matrix, parts_of, summed, to_long, whole_numbers

#: Parts of one block, and entries next to a block in norm that give the first best distances.
BLOCK, FIRST = 256, 16
#: Norm below which the distance of two vectors is exact in doubles.
NARROW = float(1 << 24)


class Ring:
    """A codebook with its entries in order of norm. entries: rows of integers (object)."""

    def __init__(self, entries: np.ndarray):
        square = (entries * entries).sum(1)
        order = np.array(sorted(range(len(entries)), key=lambda i: (square[i], i)), np.int64)
        self.index, self.rows, self.square = order, entries[order], square[order]
        self.norm = np.array([math.isqrt(s) for s in self.square], object)  # rounded down
        self.narrow = int(np.searchsorted(self.square, int(NARROW) ** 2))
        few = slice(0, self.narrow)
        self.f_rows, self.f_square = self.rows[few].astype(np.float64), self.square[few].astype(np.float64)
        self.f_norm = np.sqrt(self.f_square)

    def assign(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each point (whole numbers as doubles)."""
        with np.errstate(over="ignore"):
            norm = np.sqrt((points * points).sum(1))
        entry, far = np.zeros(len(points), np.int64), np.zeros(len(points), np.float64)
        small = np.flatnonzero(norm < NARROW) if self.narrow else np.zeros(0, np.int64)
        order = small[np.argsort(norm[small], kind="stable")]
        for a in range(0, len(order), BLOCK):
            at = order[a : a + BLOCK]
            entry[at], far[at] = self._block(points[at], norm[at], self.f_rows, self.f_square, self.f_norm, np.sqrt)
        # points whose ring reaches entries beyond exact doubles, and points that are themselves: integers of any length
        reach = int(self.norm[self.narrow]) if self.narrow < len(self.norm) else math.inf
        left = np.ones(len(points), bool)
        left[small] = norm[small] + np.sqrt(far[small]) + 1 >= reach
        left = np.flatnonzero(left)
        if not len(left):
            return entry, far
        far = as_integers(far)
        exact = as_integers(points[left])
        norms = np.array([math.isqrt(s) for s in (exact * exact).sum(1)], object)
        order = np.array(sorted(range(len(left)), key=lambda i: norms[i]), np.int64)
        for a in range(0, len(order), BLOCK):
            at = order[a : a + BLOCK]
            entry[left[at]], far[left[at]] = self._block(exact[at], norms[at], self.rows, self.square, self.norm, np.frompyfunc(lambda s: math.isqrt(s) + 1, 1, 1))
        return entry, far

    def _block(self, x: np.ndarray, norm: np.ndarray, rows: np.ndarray, square: np.ndarray, norms: np.ndarray, root) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entries of points in order of norm."""
        own = (x * x).sum(1)
        between = lambda a, b: own[:, None] + square[None, a:b] - 2 * (x @ rows[a:b].T)  # noqa: E731  exact: whole numbers
        near = np.searchsorted(norms, norm[[0, -1]])
        a = max(0, min(int(near[0]) - FIRST // 2, len(rows) - FIRST))
        reach = root(between(a, max(int(near[1]) + FIRST // 2, a + 1)).min(1))
        reach = reach + (1 if reach.dtype == object else 1e-9 * (1 + norm + reach))  # inclusive, whatever norms are rounded to
        low, high = np.searchsorted(norms, norm - reach, "left"), np.searchsorted(norms, norm + reach, "right")
        a, b = int(low.min()), int(high.max())
        found = between(a, b)
        inside = (np.arange(a, b) >= low[:, None]) & (np.arange(a, b) < high[:, None])
        best = np.where(inside, found, found.max() + 1)
        least = best.min(1)
        ties = np.where(best == least[:, None], self.index[None, a:b], len(self.index))
        return ties.min(1), least


class Codebooks:
    """A codebook for each part of vectors of one width."""

    def __init__(self, books: Sequence[np.ndarray]):
        self.books, self.rings = list(books), [Ring(b) for b in books]
        self.step = books[0].shape[1]

    @property
    def width(self) -> int:
        return self.step * len(self.books)

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries and squared distances (rows x parts) of some vectors."""
        found = [ring.assign(np.ascontiguousarray(x[:, p * self.step : (p + 1) * self.step])) for p, ring in enumerate(self.rings)]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    def numbers(self) -> str:
        """All numbers by part, entry and position, comma-joined."""
        return ",".join(str(int(v)) for b in self.books for v in b.ravel())


def _round(rows: DataFrame, books: Codebooks, n: int, largest: int) -> Codebooks:
    """Codebooks after one more assignment."""
    shared = rows.sparkSession.sparkContext.broadcast(books)  # parts x entries x step numbers
    parts, k, step = len(books.books), len(books.books[0]), books.step
    n_limbs = limbs(n * max(1, largest))

    def run(batches):
        books = shared.value
        total = np.zeros((parts, k, step + 1), object if n_limbs > 1 else np.int64)  # the last number counts
        for batch in batches:
            x = matrix(batch.column("v"), books.width)
            entry, _ = books.codes(x)
            for p in range(parts):
                order = np.argsort(entry[:, p], kind="stable")
                used, at = np.unique(entry[order, p], return_index=True)
                if len(used):
                    mine = x[order, p * step : (p + 1) * step]
                    mine = as_integers(mine) if n_limbs > 1 else mine.astype(np.int64)
                    total[p, used, :step] += np.add.reduceat(mine, at, axis=0)
                    total[p, used, step] += np.diff([*at, len(order)])
        yield from parts_of(total, n_limbs)

    size = parts * k * (step + 1)
    found = np.array(summed(rows.select("v").mapInArrow(run, SUMS), size, n_limbs), object).reshape(parts, k, step + 1)
    shared.destroy()
    counts = found[:, :, step]
    means = found[:, :, :step] // np.where(counts > 0, counts, 1)[:, :, None]
    return Codebooks([np.where((counts[p] > 0)[:, None], means[p], books.books[p]) for p in range(parts)])


def train(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> Codebooks | None:
    """Codebooks of a stored table of vec_id and v; None without rows."""
    size = extent(rows)
    if not size["n"]:
        return None
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow().column("v").combine_chunks()
    width = max(1, -(-size["width"] // parts)) * parts
    start = as_integers(matrix(first, width))
    books = Codebooks([start[:, p * width // parts : (p + 1) * width // parts] for p in range(parts)])
    for _ in range(rounds):
        books = _round(rows, books, size["n"], size["largest"])
    return books


def encode(rows: DataFrame, books: Codebooks, keep: Sequence[str] = ("vec_id",)) -> DataFrame:
    """keep, code (two hex digits a part) and error, the exact squared distance from the coded vector."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    taken = rows.select(*keep, "v")

    def run(batches):
        books = shared.value
        for batch in batches:
            entry, far = books.codes(matrix(batch.column("v"), books.width))
            error = pa.array(far.sum(1).astype(np.int64)) if far.dtype != object else to_long(far.sum(1))
            code = pa.array([row.tobytes().hex() for row in entry.astype(np.uint8)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), code, error], names=[*keep, "code", "error"])

    return taken.mapInArrow(run, ", ".join([*fields_of(taken, keep), "code string", "error long"]))


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (errors summed over rows of one label) and codebooks_sha256 (of all final entries). At most 256
    entries, so that one takes two hex digits."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry takes two hex digits: 1 to 256 entries")
    rows = stored(whole_numbers(vectors, scale, embedding, {"vec_id": vec_id, "label": label}), "codes-vectors")
    books = train(rows, parts, entries, rounds)
    if books is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    named = rows.withColumn("unlabelled", F.col("label").isNull()).withColumn("label", F.coalesce(F.col("label").cast("string"), F.lit("")))
    coded = stored(encode(named, books, ("vec_id", "label", "unlabelled")), "codes")
    discard(rows)
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    labels = stored(coded.groupBy("label", "unlabelled").agg(total.alias("label_error"), F.count("*").alias("n")), "codes-labels")
    digest = hashlib.sha256(books.numbers().encode()).hexdigest()
    joined = spread_join(coded, labels, ["label", "unlabelled"], "n", ["vec_id", "code"])
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
