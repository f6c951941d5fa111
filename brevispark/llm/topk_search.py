"""Exact top-k search by distributed histogram selection.

Vectors become integers floor(scale * x), so scores are whole numbers and sums are exact. All candidates are scored against
all queries, again and again: each pass counts scores in bins of the interval that is known to hold a query's k-th best
score, the counts are summed over the cluster, and the interval shrinks to one bin; with 4096 bins a pass, two or three
passes find the exact k-th score of every query. A last pass keeps what reaches it, and ties at the k-th score go to the
smaller vec_id.

Queries are dealt with in blocks of at most `block` rows, each sent to the workers once (a stated query set against all
rows); candidates are never shuffled after they were spread evenly. From a batch of candidates only bins at or above its own
k-th best are reported, which is exact, since the overall k-th best is never below that of a part.

Components of any finite size count exactly. Vectors so large that an inner product may pass 62 bits (rare, and never of
normalised embeddings) are searched apart with integers of any length, so that one such row does not slow the others.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do rows with null vec_id; a
component that leaves the range of doubles when scaled counts as non-finite. Vectors of several lengths are compared as if the
shorter were filled with zeros. Rows that share a vec_id count as one, with the vector that sorts first. Scores are ranked
exactly; one beyond 63 bits is reported as the end of the range of longs. Without valid queries or candidates the result is
empty. Other columns of the input are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

#: Bits of a score that one pass settles: of 64-bit scores, and of those of any length (a batch reports its best k bins only).
BIN_BITS, WIDE_BITS = 12, 60
#: Squared length up to which inner products are taken in 64-bit integers (rounding of the length itself is far smaller).
SAFE_NORM = float(1 << 61)
LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v array<double> of whole numbers, and norm (squared length) of the rows that take part, one per vec_id."""
    x = F.col(embedding)
    scaled = F.transform(x, lambda c: c.cast("double") * scale)
    whole = lambda c: F.when(F.abs(c) < float(1 << 53), F.floor(c).cast("double")).otherwise(c)  # noqa: E731  a larger double has no fraction
    finite = F.forall(scaled, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col(vec_id).isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col(vec_id).cast("bigint").alias("vec_id"), F.transform(scaled, whole).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))


def _matrix(column: pa.Array, width: int, exact: type) -> np.ndarray:
    """The vectors of a list column as a matrix, filled up with zeros; `object` holds integers of any length."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    flat = np.array([int(x) for x in flat.tolist()], object) if exact == object else flat.astype(exact)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.full((len(column), width), 0, exact)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _scores(batch: pa.RecordBatch, ids: np.ndarray, queries: np.ndarray, step: int = 256) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of queries with their scores over a batch, and which of them count (all but the query's own row)."""
    own = batch.column("vec_id").to_numpy(zero_copy_only=False)
    rows = _matrix(batch.column("v"), queries.shape[1], queries.dtype)
    for a in range(0, len(ids), step):
        some = slice(a, min(a + step, len(ids)))
        score = queries[some] @ rows.T
        yield some, score if score.dtype == object else score.astype(np.int64), ids[some, None] != own[None, :], own


def _select(candidates: DataFrame, ids: np.ndarray, matrix: np.ndarray, bound: int, widest: int, k: int) -> DataFrame:
    """Rows (query_id, vec_id, score, key) that hold the best k of each query of one block, and at most ties beyond them. No score
    is beyond `bound`; keys are scores plus `widest` as bytes, which sort as the scores do."""
    sc = candidates.sparkSession.sparkContext
    queries = sc.broadcast((ids, matrix))
    whole = object if matrix.dtype == object else np.int64
    bits = WIDE_BITS if whole is object else BIN_BITS
    shift = max(0, (2 * bound).bit_length() - bits)
    low, need = np.full(len(ids), -bound, whole), np.full(len(ids), k, np.int64)
    span = 2 * bound + 1  # scores in [low, low + span) are still open
    while True:
        state = sc.broadcast((low, need, span, shift))

        def count(batches, state=state):
            ids, matrix = queries.value
            low, need, span, shift = state.value
            for batch in batches:
                found = []
                for some, score, valid, _ in _scores(batch, ids, matrix):
                    at = score - low[some, None]
                    valid &= (at >= 0) & (at < span)
                    at = np.where(valid, at >> shift, -1).astype(np.int64)
                    k_max = min(int(need[some].max(initial=1)), at.shape[1])
                    kth = np.partition(at, at.shape[1] - k_max, axis=1)[:, at.shape[1] - k_max]
                    q, c = np.nonzero((at >= kth[:, None]) & valid)
                    found.append(np.stack([q + some.start, at[q, c]], 1))
                if found:
                    pairs, n = np.unique(np.concatenate(found), axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(n)], names=["q", "bin", "n"])

        bins = candidates.mapInArrow(count, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        wide = Window.partitionBy("q").orderBy(F.desc("bin"))
        needs = bins.withColumn("above", F.sum("n").over(wide) - F.col("n"))
        # the bin that holds the k-th: fewer than needed above it, enough with it; a query with too few scores keeps all
        marks = sc.broadcast(need)

        def pick(batches, marks=marks):
            for batch in batches:
                q, b, n, above = (batch.column(c).to_numpy() for c in ("q", "bin", "n", "above"))
                hit = (above < marks.value[q]) & (above + n >= marks.value[q])
                yield pa.RecordBatch.from_arrays([pa.array(x[hit]) for x in (q, b, above)], names=["q", "bin", "above"])

        hits = needs.mapInArrow(pick, "q long, bin long, above long").toArrow()  # one row a query of the block at most
        q, b, above = (hits.column(c).to_numpy() for c in ("q", "bin", "above"))
        found = np.zeros(len(ids), bool)
        found[q] = True
        low, need = low.copy(), need.copy()
        low[q] += np.array([int(x) << shift for x in b], whole) if whole is object else b << shift
        need[q] -= above
        if shift == 0:
            break
        span, shift = 1 << shift, max(0, shift - bits)
    final = sc.broadcast((low, need))
    size = (2 * widest).bit_length() // 8 + 1

    def keep(batches):
        ids, matrix = queries.value
        low, need = final.value
        for batch in batches:
            for some, score, valid, own in _scores(batch, ids, matrix):
                q, c = np.nonzero((score >= low[some, None]) & valid)
                value = score[q, c]
                tie = value == low[some][q]
                order = np.lexsort((own[c], q, ~tie.astype(bool)))  # ties first, by query and vec_id
                n_tie = int(tie.sum())
                tq = q[order[:n_tie]]
                rank = np.arange(n_tie) - np.searchsorted(tq, tq)
                good = np.concatenate([order[:n_tie][rank < need[some][tq]], order[n_tie:]])
                exact = [int(x) for x in value[good]]
                score_ = pa.array([max(-LONG - 1, min(LONG, x)) for x in exact], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ids[some][q[good]]), pa.array(own[c[good]]), score_, pa.array([(x + widest).to_bytes(size, "big") for x in exact], pa.binary())], names=["query_id", "vec_id", "score", "key"])

    return candidates.mapInArrow(keep, "query_id long, vec_id long, score long, key binary")


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", block: int = 32_768) -> DataFrame:
    """The k best rows by integer inner product for each query row: query_id, rank (from 1), vec_id, score.

    is_query: a condition on `vec_id`. block: queries sent to the workers at a time (16 MB at 64 dimensions).
    """
    spark = vectors.sparkSession
    rows = stored(quantised(vectors, scale, vec_id, embedding), "topk-vectors")
    largest = F.max(F.array_max(F.transform("v", lambda c: F.abs(c))))
    size = rows.agg(F.max(F.size("v")).alias("width"), F.max(F.when(F.col("norm") < SAFE_NORM, F.col("norm"))).alias("norm"), largest.alias("largest"), F.count_if(is_query).alias("n"), F.count_if(F.col("norm") >= SAFE_NORM).alias("wide")).first()
    if not size.n:
        discard(rows)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    narrow, wide, width = F.col("norm") < SAFE_NORM, F.col("norm") >= SAFE_NORM, max(int(size.width), 1)
    bound = math.ceil((size.norm or 0.0) * (1 + 1e-9)) + 1
    most = width * math.ceil(size.largest or 0.0) ** 2  # of any two vectors
    parts = [(narrow, narrow, bound, np.float64 if bound < 1 << 53 else np.int64)]
    if size.wide:
        parts += [(narrow, wide, most, object), (wide, F.lit(True), most, object)]
    blocks = -(-size.n // block)
    out = None
    for which, others, limit, exact in parts:
        for b in range(blocks):  # blocks are dealt by a hash, so each stays near `block` rows
            part = rows.where(is_query & which & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)).select("vec_id", "v").toArrow()
            if not part.num_rows:
                continue
            table = part.combine_chunks().to_batches()[0]
            found = _select(rows.where(others).select("vec_id", "v"), table.column("vec_id").to_numpy(), _matrix(table.column("v"), width, exact), limit, max(limit, most if size.wide else 0), k)
            out = found if out is None else out.unionByName(found)
    best = Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

