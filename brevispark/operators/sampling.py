"""Sampling by hash order: rank terciles, stratified quotas, balanced sub-samples, foreign demonstrations, paraphrase picks.

Draws are ordered by md5(seed|key...), so they are the same in every engine and for every partitioning.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brevispark.session import durable

#: Categories of a pool at most: each task is paired with all of them.
MOST_CATEGORIES = 10_000


def draw_key(seed: int | Column, *keys: str | Column) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", seed.cast("string"), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def ranked(df: DataFrame, category: str, *order: Column | str) -> DataFrame:
    """Adds _rank (from 1, by `order`) and _n (rows) within each category, however few categories there are or however large one is.

    Rows are dealt by ranges of (category, order), so a category lies in some neighbouring partitions; ranks within a partition are
    moved by what the ones before it hold: a row a partition and category in it, joined by hash or sent along, as its size has it."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    names = [f"_o{i}" for i in range(len(keys))]
    dealt = df.withColumns(dict(zip(names, keys))).repartitionByRange(category, *names)
    dealt = durable(dealt.withColumn("_p", F.spark_partition_id()))  # the ranges are drawn by sampling: they must not be drawn anew
    parts = dealt.groupBy("_p", category).agg(F.count("*").alias("_m"))
    whole = Window.partitionBy(category)
    before = parts.withColumn("_before", F.sum("_m").over(whole.orderBy("_p")) - F.col("_m")).withColumn("_n", F.sum("_m").over(whole))
    before = before.select("_p", F.col(category).alias("_c"), "_before", "_n")
    own = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("_p", category).orderBy(*names)))
    joined = own.join(before, (own["_p"] == before["_p"]) & own[category].eqNullSafe(before["_c"])).drop(before["_p"])  # a key has no more rows than a partition
    return joined.withColumn("_rank", F.col("_rank") + F.col("_before")).select(*df.columns, "_rank", "_n")


def terciles(df: DataFrame, category: str, value: str, key: str, name: str = "tercile") -> DataFrame:
    """Thirds of each category by rank of (value, key), cut at round(n / 3) and round(2 n / 3)."""
    rank, n = F.col("_rank"), F.col("_n")
    return ranked(df, category, value, key).withColumn(name, F.when(rank <= F.round(n / 3), 1).when(rank <= F.round(2 * n / 3), 2).otherwise(3)).drop("_rank", "_n")


def eligible(df: DataFrame, paraphrases: DataFrame, category: str, count: str = "n_paraphrases", least: int = 4) -> DataFrame:
    """Rows of the categories that have enough paraphrases, with their number. paraphrases: a row per category."""
    return df.join(paraphrases.where(F.col(count) >= least).select(category, count), category)


def stratified(df: DataFrame, strata: tuple[str, ...], quota: int | Column, key: str, seed: int, strict: bool = False) -> DataFrame:
    """`quota` rows of each stratum in hash order. The ranking is pruned before the shuffle, so large strata are cheap.

    strict: raises ValueError if a stratum cannot meet its quota, with the strata that cannot (a pass of its own)."""
    if strict:
        small = too_small(df, strata, quota).orderBy(*strata).limit(20).collect()
        if small:
            raise ValueError("strata too small: " + "; ".join(", ".join(str(r[c]) for c in strata) + f" has {r.n} of {r.quota}" for r in small))
    w = Window.partitionBy(*strata).orderBy(draw_key(seed, key), key)
    quota = quota if isinstance(quota, Column) else F.lit(quota)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= quota).drop("_rank")


def too_small(df: DataFrame, strata: tuple[str, ...], quota: int | Column) -> DataFrame:
    """Strata that cannot meet their quota."""
    quota = quota if isinstance(quota, Column) else F.lit(quota)
    return df.withColumn("_quota", quota).groupBy(*strata).agg(F.count("*").alias("n"), F.max("_quota").alias("quota")).where(F.col("n") < F.col("quota"))


def balanced_table(counts: Mapping[tuple[str, int], int], per_category: Mapping[str, int] | int, per_tercile: int, order: Callable[[str, int, int], str]) -> dict[tuple[str, int], int]:
    """How many rows to draw from each cell (category, tercile), so that every category fills its quota and every tercile `per_tercile`.

    It starts from the draw by `order` (a key of category, tercile and number) alone and moves rows between terciles, along ways through
    other terciles if need be, as long as one is over-full. If no way is left there is no such draw at all, and ValueError says so."""
    categories = sorted({c for c, _ in counts})
    quota = {c: per_category if isinstance(per_category, int) else per_category.get(c, 0) for c in categories}
    terciles = (1, 2, 3)
    have = lambda c, t: counts.get((c, t), 0)
    for c in categories:
        if sum(have(c, t) for t in terciles) < quota[c]:
            raise ValueError(f"category {c} has fewer rows than its quota of {quota[c]}")
    if sum(quota.values()) != 3 * per_tercile:
        raise ValueError(f"quotas of {sum(quota.values())} rows do not fill three terciles of {per_tercile}")
    drawn = {}
    for c in categories:
        first = sorted((order(c, t, i), t) for t in terciles for i in range(min(have(c, t), quota[c])))[: quota[c]]
        drawn |= {(c, t): sum(x == t for _, x in first) for t in terciles}
    total = {t: sum(drawn[c, t] for c in categories) for t in terciles}

    def step(a: int, b: int) -> str | None:
        """A category that can give up a row of tercile a for one of b."""
        able = [c for c in categories if drawn[c, a] > 0 and drawn[c, b] < have(c, b)]
        return min(able, key=lambda c: (order(c, b, drawn[c, b]), c)) if able else None

    while any(n != per_tercile for n in total.values()):
        full, empty = max(terciles, key=lambda t: total[t]), min(terciles, key=lambda t: total[t])
        third = 6 - full - empty
        for way in ([full, empty], [full, third, empty]):
            moves = []
            for a, b in zip(way, way[1:]):
                c = step(a, b)
                if c is None:
                    break
                drawn[c, a] -= 1
                drawn[c, b] += 1
                moves.append((c, a, b))
            if len(moves) == len(way) - 1:
                total[full] -= 1
                total[empty] += 1
                break
            for c, a, b in moves:
                drawn[c, a] += 1
                drawn[c, b] -= 1
        else:
            # what one tercile can't give, the third may: it lies between the two, and is as far from its share as they are together
            raise ValueError(f"no draw of {per_tercile} rows from each tercile fills the quotas of the categories")
    return drawn


def balanced_draw(sample: DataFrame, category: str, tercile: str, key: str, per_category: int | Mapping[str, int], per_tercile: int, seed: int = 42) -> DataFrame:
    """A sub-sample with a quota per category that fills each tercile equally. It finds a draw whenever there is one, and raises ValueError
    otherwise. Cells are counted by Spark, the table of counts (few categories, checked) is balanced on the driver, and rows of a cell are
    drawn in hash order."""
    rows = sample.groupBy(F.col(category).cast("string").alias("c"), F.col(tercile).alias("t")).agg(F.count("*").alias("n")).where("t IN (1, 2, 3) AND c IS NOT NULL").limit(3 * MOST_CATEGORIES + 1).collect()
    if len(rows) > 3 * MOST_CATEGORIES:
        raise ValueError(f"a sample of more than {MOST_CATEGORIES} categories")
    order = lambda c, t, i: hashlib.md5(f"{seed}|{c}|{t}|{i}".encode()).hexdigest()
    table = balanced_table({(r.c, r.t): r.n for r in rows}, per_category, per_tercile, order)
    wanted = sample.sparkSession.createDataFrame([(c, t, n) for (c, t), n in table.items() if n] or [("", 0, 0)], "_c string, _t int, _quota int")
    joined = sample.join(F.broadcast(wanted), (sample[category].cast("string") == wanted["_c"]) & (sample[tercile] == wanted["_t"]))
    w = Window.partitionBy(category, tercile).orderBy(draw_key(seed, key), key)
    most = max([n for n in table.values()] or [0])  # prunes large cells before the shuffle
    ranked_ = joined.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= most)
    return ranked_.where(F.col("_rank") <= F.col("_quota")).select(*sample.columns)


def balanced_subsample(sample: DataFrame, category: str, tercile: str, key: str, per_category: int, per_tercile: int, tries: int = 500) -> DataFrame:
    """A sub-sample with a quota per category that also fills each tercile equally: all candidate seeds are drawn at once as
    sets, and the least seed whose draw is balanced wins. If none of `tries` is, the draw is constructed (`balanced_draw`, with seed -1),
    which raises ValueError if there is none at all. `sample` is a drawn sample, hence small."""
    drawn = sample.select(category, tercile, key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(tries - 1).cast("bigint"))).alias("seed"))
    w = Window.partitionBy("seed", category).orderBy(draw_key(F.col("seed"), key), key)
    drawn = drawn.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= per_category)
    good = drawn.groupBy("seed").agg(*[F.count_if(F.col(tercile) == t).alias(f"t{t}") for t in (1, 2, 3)])
    best = good.where(" AND ".join(f"t{t} = {per_tercile}" for t in (1, 2, 3))).agg(F.min("seed").alias("seed")).first().seed
    if best is None:
        return balanced_draw(sample, category, tercile, key, per_category, per_tercile, -1).select(category, tercile, key, F.lit(-1).cast("bigint").alias("seed"))
    return drawn.where(F.col("seed") == best).select("seed", category, tercile, key)


def assign_foreign(tasks: DataFrame, pool: DataFrame, task: str, category: str, item: str, slots: int = 8, base: int = 4, seed: int = 42) -> DataFrame:
    """For each task `slots` different categories other than its own, in hash order, and one item of the pool from each; the
    first `base` slots have the role base, the others demonstration.

    Categories are few (checked). Items are ranked once per category by hash, and a task takes the one at its own hash's place, so the
    pool is never multiplied by the tasks."""
    items = ranked(pool.select(F.col(category).alias("demo_category"), F.col(item).alias("demo_item")), "demo_category", draw_key(seed, "demo_item"), "demo_item")
    sizes = items.groupBy("demo_category").agg(F.max("_n").alias("n"))
    if (n := sizes.count()) > MOST_CATEGORIES:
        raise ValueError(f"a pool of {n} categories: at most {MOST_CATEGORIES} are paired with every task")
    pairs = tasks.select(F.col(task), F.col(category)).join(F.broadcast(sizes), F.col(category) != F.col("demo_category"))
    order = Window.partitionBy(task).orderBy(draw_key(seed, task, "demo_category"), "demo_category")
    pairs = pairs.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= slots)
    number = F.conv(F.substring(draw_key(seed, task, "slot"), 1, 8), 16, 10).cast("bigint")
    pairs = pairs.withColumn("place", F.pmod(number, F.col("n")).cast("int")).drop("n")
    role = F.when(F.col("slot") <= base, "base").otherwise("demonstration")
    return pairs.join(items.select("demo_category", "demo_item", (F.col("_rank") - 1).alias("place")), ["demo_category", "place"]).select(task, "slot", role.alias("role"), "demo_category", "demo_item")


def rotating_pick(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Of each group's rows in `order` the one at place id mod n; ids that are no number count by the sum of their characters. Groups may be
    of any size (`ranked`)."""
    text = F.col(group).cast("string")
    code = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda a, c: a + F.ascii(c))
    number = F.coalesce(F.expr(f"try_cast({group} AS bigint)"), code)
    found = ranked(rows.select(group, order, value), group, order)
    return found.where(F.col("_rank") - 1 == F.pmod(number, F.col("_n"))).select(group, order, value)
