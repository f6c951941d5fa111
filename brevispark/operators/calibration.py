"""The choice of redundancy by the text that is really built: nearest sums first, then exact counts of a few built texts.

Counters of models are not additive (what stands at a border may merge), so sums of the units' lengths only preselect. A case (a list of
unit lengths and a base length) is searched once however many rows share it; all built texts are counted in one pass.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevispark.functions import text as T

from . import plugins
from .prompts import CHECKED, TARGET


@lru_cache(maxsize=64)
def sums(sizes: tuple[int | None, ...], k: int, most: int | None, pairs: bool) -> list[tuple[int, list[tuple[int, ...]]]]:
    """For each sum that a choice of units reaches, ascending, its k best choices: fewest units, then the least. Units of no length
    (null) stay out. most: units at most. pairs: ordered pairs of different units instead of sets.

    A table of sums, which grows with the units and their lengths; not all subsets are listed, so there may be any number of units."""
    units = [i for i, s in enumerate(sizes) if s is not None]
    best: dict[tuple[int, int], list[tuple[int, ...]]] = {}
    if pairs:
        for i in units:
            for j in units:
                if i != j:
                    best.setdefault((2, sizes[i] + sizes[j]), []).append((i, j))
    else:
        # without a bound on the units, choices of one sum need not be told apart by their number before the end
        best[0, 0] = [()]
        for i in units:
            for (n, total), found in list(best.items()):
                if most is None or n < most:
                    at = (n + 1 if most is not None else 0, total + sizes[i])
                    best[at] = sorted([*best.get(at, []), *[(*u, i) for u in found]], key=lambda u: (len(u), u))[:k]
    by_sum: dict[int, list[tuple[int, ...]]] = {}
    for (_, total), found in best.items():
        by_sum.setdefault(total, []).extend(u for u in found if u)
    return [(s, sorted(found, key=lambda u: (len(u), u))[:k]) for s, found in sorted(by_sum.items()) if found]


def nearest_units(sizes: Sequence[int | None], goal: float, k: int = CHECKED, most: int | None = None, pairs: bool = False) -> list[tuple[int, ...]]:
    """The k choices whose summed length is nearest to the goal, then with fewest units, then the least."""
    table = sums(tuple(sizes), k, most, pairs)
    right = bisect_left(table, goal, key=lambda x: x[0])
    left, out = right - 1, []
    while (left >= 0 or right < len(table)) and len(out) < k:
        low = goal - table[left][0] if left >= 0 else float("inf")
        high = table[right][0] - goal if right < len(table) else float("inf")
        tier = []
        if low <= high:
            tier += table[left][1]
            left -= 1
        if high <= low:
            tier += table[right][1]
            right += 1
        out += sorted(tier, key=lambda u: (len(u), u))
    return out[:k]


def choices(df: DataFrame, sizes: str, base: str, k: int = CHECKED, most: int | None = None, pairs: bool = False, target: float = TARGET) -> DataFrame:
    """Adds `choices` array<array<int>>: the k choices of units whose summed length is nearest to target * base; empty without a base or
    units. sizes: array<int> of the units' lengths, null for units that are not there."""
    cases = df.select(F.col(sizes).alias("_sizes"), F.col(base).cast("bigint").alias("_base")).distinct()

    def run(batches):
        for batch in batches:
            found = [nearest_units(s, target * b, k, most, pairs) if s and b and b > 0 else [] for s, b in zip(batch.column("_sizes").to_pylist(), batch.column("_base").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([[list(u) for u in c] for c in found], pa.list_(pa.list_(pa.int32())))], names=["_sizes", "_base", "choices"])

    solved = cases.mapInArrow(run, "_sizes array<int>, _base bigint, choices array<array<int>>")
    same = df[sizes].eqNullSafe(solved["_sizes"]) & df[base].cast("bigint").eqNullSafe(solved["_base"])
    return df.join(solved, same, "left").drop("_sizes", "_base")


def words(df: DataFrame, text: str, name: str) -> DataFrame:
    """The counter without a model: tokens of the library."""
    return df.withColumn(name, F.size(T.tokens(F.col(text))).cast("bigint"))


def by_model(make: Callable) -> Callable[[DataFrame, str, str], DataFrame]:
    """A counter from a plug-in (`plugins.count_tokens_with`). A text that can't be counted has a null number."""
    return lambda df, text, name: plugins.count_tokens_with(df, make, text, name).drop("error")


def built_choice(df: DataFrame, key: Sequence[str], build: Callable[[Column], Column], count: Callable[[DataFrame, str, str], DataFrame], base: str, options: str = "choices", target: float = TARGET) -> DataFrame:
    """key, units, n_built and ratio of the choice whose built text is nearest to the target: by |(built - base) / base - target|, then
    fewest units, then the least. build: from a column of units to the text (null: can't be built). Rows without a choice that can be
    built are left out. Texts are built and counted once for each row and choice, in one pass."""
    each = df.withColumn("_units", F.explode(options)).withColumn("_text", build(F.col("_units"))).where("_text IS NOT NULL")
    counted = count(each.select(*key, "_units", F.col(base).alias("_base"), "_text"), "_text", "_n").where("_n IS NOT NULL AND _base > 0")
    ratio = (F.col("_n") - F.col("_base")) / F.col("_base")
    ranked = counted.select(*key, F.struct(F.abs(ratio - target).alias("off"), F.size("_units").alias("n"), F.col("_units").alias("units")).alias("_rank"), F.col("_n").alias("n_built"), ratio.alias("ratio"))
    best = ranked.groupBy(*key).agg(F.min_by(F.struct("_rank", "n_built", "ratio"), "_rank").alias("b"))
    return best.select(*key, F.col("b._rank.units").alias("units"), F.col("b.n_built").alias("n_built"), F.col("b.ratio").alias("ratio"))
