"""Vectors as whole numbers, and sums of whole numbers of any size over the cluster."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers that one row of a sum carries, and bits of a number that one of them holds where a long can't hold the sum.
CHUNK, LIMB = 64, 30
LONG = (1 << 63) - 1


def whole_numbers(vectors: DataFrame, scale: int, embedding: str, keep: dict[str, str], most: float = float("inf")) -> DataFrame:
    """`keep` (new names of columns) and v array<double>, the whole numbers floor(scale * component), which doubles hold exactly. Rows are
    left out whose vector is null or holds a component that is null or not finite, or once it is scaled not below `most` in size."""
    x = F.col(f"`{embedding}`")
    scaled = F.transform(x, lambda c: c.cast("double") * scale)
    whole = lambda c: F.when(F.abs(c) < float(1 << 53), F.floor(c).cast("double")).otherwise(c)  # noqa: E731  a larger double has no fraction
    finite = F.forall(scaled, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < most))
    return vectors.where(x.isNotNull() & F.coalesce(finite, F.lit(False))).select(*[F.col(f"`{c}`").alias(n) for n, c in keep.items()], F.transform(scaled, whole).alias("v"))


def extent(rows: DataFrame, *more: Column) -> dict:
    """Rows, longest vector and largest absolute number (0 without any), and further aggregates, in one pass."""
    largest = F.max(F.array_max(F.transform("v", lambda c: F.abs(c))))
    found = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), largest.alias("largest"), *more).first().asDict()
    return found | {"width": found["width"] or 0, "largest": int(found["largest"] or 0)}


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column as rows of doubles, filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def as_integers(x: np.ndarray) -> np.ndarray:
    """Whole doubles as integers of any length."""
    out = np.empty(x.size, object)
    out[:] = [int(v) for v in x.ravel().tolist()]
    return out.reshape(x.shape)


def limbs(bound: int) -> int:
    """How many longs a sum takes whose absolute value is at most `bound`."""
    bits = bound.bit_length()
    return 1 if bits <= 62 else -(-bits // LIMB)


SUMS = ", ".join(["at long", *(f"s{i} long" for i in range(CHUNK))])


def parts_of(totals: np.ndarray, n_limbs: int) -> Iterator[pa.RecordBatch]:
    """A task's totals as rows of CHUNK numbers, in `n_limbs` longs each; rows of zeros are left out."""
    flat = totals.ravel()
    flat = np.concatenate([flat, np.zeros(-len(flat) % CHUNK, flat.dtype)])
    n = len(flat) // CHUNK
    for limb in range(n_limbs):
        part = flat
        if n_limbs > 1:
            part = flat.astype(object) >> LIMB * limb
            part = part & (1 << LIMB) - 1 if limb < n_limbs - 1 else part
        rows = part.astype(np.int64).reshape(n, CHUNK)
        some = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some + limb * n), *(pa.array(np.ascontiguousarray(rows[some, i])) for i in range(CHUNK))], names=["at", *(f"s{i}" for i in range(CHUNK))])


def summed(parts: DataFrame, size: int, n_limbs: int) -> list[int]:
    """The sums over all tasks: `size` integers on the driver, however many rows and tasks there were."""
    rows = parts.groupBy("at").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(CHUNK)]).toArrow()
    n, out = -(-size // CHUNK), [0] * size
    columns = [c.to_pylist() for c in rows.columns]
    for i, at in enumerate(columns[0]):
        limb, chunk = divmod(at, n)
        for j in range(min(CHUNK, size - chunk * CHUNK)):
            out[chunk * CHUNK + j] += columns[j + 1][i] << LIMB * limb
    return out


def to_long(values: Sequence[int]) -> pa.Array:
    """Integers as longs; what is beyond a long is the end of the range."""
    return pa.array([max(-LONG - 1, min(LONG, int(x))) for x in values], pa.int64())
