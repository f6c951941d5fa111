"""Resumable runs over immutable tables: work lists, keyed replacement, upserts, content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def open_work(items: DataFrame, levels: list[float], done: DataFrame, key: str) -> DataFrame:
    """All (item, level) conditions that `done` lacks."""
    wanted = items.select(key).withColumn("rho", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    return wanted.join(done.select(key, "rho").distinct(), [key, "rho"], "left_anti")


def work_list(items: DataFrame, levels: list[float], done: DataFrame, key: str, order: list[str], variants: list[str] | None = None, only: list[float] | None = None, repetition: int | None = None, redo: bool = False, limit: int | None = None) -> DataFrame:
    """Open conditions (item, level): of some variants and levels, for one repetition (then `done` has a column of that
    name), all of them again with `redo`, and the first `limit` in `order` (without a limit nothing is sorted). Every option that is not
    given is no condition at all."""
    wanted = items if variants is None else items.where(F.col("variant").isin(list(variants)))
    chosen = [x for x in levels if only is None or x in only]
    if not redo and repetition is not None:
        done = done.where(F.col("repetition") == repetition)
    wanted = wanted.withColumn("rho", F.explode(F.array(*[F.lit(float(x)) for x in chosen]))) if chosen else wanted.withColumn("rho", F.lit(0.0)).limit(0)
    if not redo:
        wanted = wanted.join(done.select(key, "rho").distinct(), [key, "rho"], "left_anti")
    return wanted if limit is None else wanted.orderBy(*order).limit(limit)


def update_columns(stored: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """stored with some columns taken from new, where new has the key; rows of new without a counterpart are left out. new: one row a
    key. A new null replaces an old value, as in an update."""
    fresh = new.select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = stored.join(fresh, keys, "left")
    old = lambda c: F.col(c) if c in stored.columns else F.lit(None)
    names = [*stored.columns, *(c for c in columns if c not in stored.columns)]
    return joined.select(*[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(old(c)).alias(c) if c in columns else F.col(c) for c in names])


def replace_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of old whose key is not in new, and all of new."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def cascade(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(*keys).distinct(), keys, "left_semi")


def upsert(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The last row of each key, by version columns."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(v) for v in version])
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def changed(new: DataFrame, old: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of new whose content differs from what old has under the key; unchanged ones need no write."""
    mark = lambda df: df.select(F.col(key), F.sha2(text, 256).alias("sha256"))
    return mark(new).join(mark(old), [key, "sha256"], "left_anti")


def changed_rows(new: DataFrame, old: DataFrame, keys: list[str], mark: str) -> DataFrame:
    """Rows of new that old lacks, or has with another mark (a content hash): only those need a write."""
    return new.join(old.select(*keys, mark), [*keys, mark], "left_anti")


def top_per_group(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)
