"""Running values that take in new rows only: mergeable states of means and variances, and of paired differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevispark.functions import stats as S

STATE = ("n", "mean", "m2")


def state(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys and the state of a value: number, mean and sum of squared distances from it (m2). Nulls do not count."""
    x = F.col(value).cast("double")
    return rows.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0)).alias("m2")).where("n > 0")


def combined(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of one key put together. Rows with a negative n are taken away instead (`taken`); keys of which nothing is left go."""
    total = states.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("_s"), F.collect_list(F.struct(*STATE)).alias("_parts")).where("n > 0")
    mean = F.col("_s") / F.col("n")
    spread = F.aggregate("_parts", F.lit(0.0), lambda a, p: a + F.when(p["n"] < 0, -p["m2"]).otherwise(p["m2"]) + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")))
    return total.withColumn("mean", mean).select(*keys, "n", "mean", F.when(F.col("n") > 1, F.greatest(spread, F.lit(0.0))).otherwise(0.0).alias("m2"))


def taken(states: DataFrame) -> DataFrame:
    """The same states, to be taken away."""
    return states.withColumn("n", -F.col("n"))


def update(old: DataFrame | None, keys: Sequence[str], added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """States after some were added and others removed: what is kept, however often it is updated, is one row a key."""
    all_ = added.select(*keys, *STATE)
    for more in (old, None if removed is None else taken(removed)):
        all_ = all_ if more is None else all_.unionByName(more.select(*keys, *STATE))
    return combined(all_, keys)


def interval(z: float = S.Z) -> dict[str, Column]:
    """Mean with its interval, from a state."""
    n, half = F.col("n"), F.lit(z) * F.sqrt(F.col("m2") / F.greatest(F.col("n") - 1, F.lit(1)) / F.col("n"))
    half = F.when(n > 1, half).otherwise(0.0)
    return {"mean": F.col("mean"), "lo": F.col("mean") - half, "hi": F.col("mean") + half, "n": n}


def differences(values: DataFrame, unit: str, name: str, by: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """by, contrast and d: for each unit (a task) that has both members of a pair, the difference of their values."""
    wide = values.groupBy(unit, *by).pivot(name, sorted({v for p in pairs for v in p})).agg(F.first("value"))
    each = F.array(*[F.struct(F.lit(f"{a} > {b}").alias("contrast"), (F.col(a) - F.col(b)).alias("d")) for a, b in pairs])
    return wide.select(unit, *by, F.explode(each).alias("x")).select(unit, *by, "x.*").where("d IS NOT NULL")


def update_pairs(old: DataFrame | None, before: DataFrame, new: DataFrame, unit: str, name: str, by: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """States of paired differences after new values came. before: all values so far, new: those that came (unit, name, by, value; one row
    a unit, name and by, and none that `before` has). Only units with a new value are paired anew: what they gave before goes, what they
    give now comes."""
    touched = new.select(unit).distinct()
    were = before.join(touched, unit, "left_semi")
    keys = [*by, "contrast"]
    now = state(differences(were.unionByName(new), unit, name, by, pairs), keys, "d")
    past = state(differences(were, unit, name, by, pairs), keys, "d")
    return update(old, keys, now, past)
