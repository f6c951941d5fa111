"""Retention of core and redundancy: rates, the corrected index over free words, sections, and the null model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevispark.functions.stats import clamp, log_or_null, ratio

from .words import CORE, REDUNDANT

#: Continuity correction: half a word kept, one word more.
ADD_KEPT, ADD_ALL = 0.5, 1.0


def counts(tokens: Column, mask: Column) -> dict[str, Column]:
    """Words and kept words by origin (n_core, n_red, e_core, e_red), and the same over free words (suffix _free)."""
    both = F.arrays_zip(tokens.alias("t"), mask.alias("m"))
    out = {}
    for suffix, free in (("", False), ("_free", True)):
        for name, origin in (("core", CORE), ("red", REDUNDANT)):
            out[f"n_{name}{suffix}"] = F.size(F.filter(tokens, _belongs(origin, free)))
            out[f"e_{name}{suffix}"] = F.size(F.filter(both, _lives(_belongs(origin, free))))
    return out


def _belongs(origin: str, free: bool):
    return lambda t: t["is_word"] & (t["origin"] == origin) & (~t["is_protected"] if free else F.lit(True))


def _lives(belongs):
    return lambda z: z["m"] & belongs(z["t"])


def rates(n_core: Column, n_red: Column, e_core: Column, e_red: Column) -> dict[str, Column]:
    """r_core, r_red, s (null if r_red is null or 0), ln_s and the flag of a redundancy that is gone."""
    r_core, r_red = ratio(e_core, n_core), ratio(e_red, n_red)
    s = ratio(r_core, r_red)
    return {"r_core": r_core, "r_red": r_red, "s": s, "ln_s": log_or_null(s), "r_red_null": F.when((n_red > 0) & (r_red == 0), 1).otherwise(0)}


def free_index(n_core: Column, n_red: Column, e_core: Column, e_red: Column) -> dict[str, Column]:
    """The corrected ratio over free words; null if either origin has none."""
    there = (n_core > 0) & (n_red > 0)
    r_core, r_red = (e_core + ADD_KEPT) / (n_core + ADD_ALL), (e_red + ADD_KEPT) / (n_red + ADD_ALL)
    s = F.when(there, r_core / r_red)
    return {"r_core_free": F.when(there, r_core), "r_red_free": F.when(there, r_red), "s_free": s, "ln_s_free": F.ln(s)}


def section_retention(rows: DataFrame, keys: tuple[str, ...], levels: list[float] | None = None) -> DataFrame:
    """Words, kept words and rate by section and origin. rows: a row per token with section, origin, is_word and lives: a flag or, with
    `levels`, one flag for each; then tokens are grouped once, and only the groups are multiplied by the levels."""
    flags = [F.col("lives")] if levels is None else [F.col("lives")[i] for i in range(len(levels))]
    words = rows.where("is_word").groupBy(*keys, "section", "origin").agg(F.count("*").alias("n_words"), *[F.count_if(f).alias(f"_{i}") for i, f in enumerate(flags)])
    own = [*keys, "section", "origin", "n_words"]
    if levels is None:
        long = words.withColumnRenamed("_0", "n_kept")
    else:
        each = F.array(*[F.struct(F.lit(float(x)).alias("rho"), F.col(f"_{i}").alias("n_kept")) for i, x in enumerate(levels)])
        long = words.select(*own, F.explode(each).alias("z")).select(*own, "z.*")
    return long.withColumn("rate", F.col("n_kept") / F.col("n_words"))


def expected(kept: Column, core: tuple[Column, Column], red: tuple[Column, Column]) -> dict[str, Column]:
    """Logs of the raw and the free index that a deleter blind to origin would give; core and red: (protected, free) words.

    Its survival chance is set so that the observed number of kept words is met; null where either origin has no free word."""
    (pc, fc), (pr, fr) = core, red
    there = (fc > 0) & (fr > 0)
    p = clamp(ratio((kept - (pc + pr)).cast("double"), fc + fr))
    r_core, r_red = ratio(pc + p * fc, pc + fc), ratio(pr + p * fr, pr + fr)
    ln_s = F.when(there & (r_red > 0), F.ln(ratio(r_core, r_red)))
    ln_free = F.when(there, F.ln(((p * fc + ADD_KEPT) / (fc + ADD_ALL)) / ((p * fr + ADD_KEPT) / (fr + ADD_ALL))))
    return {"p_survive": F.when(there, p), "ln_s_expected": ln_s, "ln_s_free_expected": ln_free}
