"""Connected components by alternating large and small stars: each round is three shuffles of the edges, nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, spread_join, stored


def _least(edges: DataFrame) -> DataFrame:
    """The least neighbour of each node, with the number of its edges: the hub of a large component is dealt over several tasks."""
    return stored(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "components-least")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: (u, v) of any comparable type, without nulls. Returns (u, v): each node but the least of its component, and the least.

    Edges from a node to itself are ignored, repeated ones count once; no edges give no rows."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    before = None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
        if mark == before or not mark[0]:
            return now
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nearest = _least(both)
        large = spread_join(both, nearest, "u", "n", ["v"]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = stored(large.distinct(), "components-large")
        least = _least(large)
        small = spread_join(large, least, "u", "n", ["v"]).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        last, now = now, stored(small.distinct(), "components")
        discard(last, nearest, large, least)
    raise RuntimeError("components did not settle")
