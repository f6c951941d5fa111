"""Scoring of answers against alias lists, and re-scoring of stored ones.

An answer is right if a whole-word form of one of its aliases stands in it; both are normalised alike. `normal` is a column
function: `functions.text.flat` (built-in) or `functions.text.normalise` (exact: compatibility forms, no accents, no articles).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevispark.functions import text as T

SCORES = ("output_normal", "correct", "matched_alias", "error_class")


def score(df: DataFrame, output: str, aliases: str, is_cut: Column, normal: Callable[[Column], Column] = T.flat) -> DataFrame:
    """Adds output_normal, correct (0/1), matched_alias (the first in the list's order, as written; null if wrong) and error_class
    (null if right). aliases: array<string>; null outputs and lists count as empty, and an alias without a word matches nothing.

    Aliases are normalised as one text, joined by line ends: normal forms have none, and keep their order."""
    kept = [c for c in df.columns if c not in SCORES]
    known = F.coalesce(F.col(aliases), F.array().cast("array<string>"))
    forms = normal_list(known, normal)
    rows = df.select(*kept, normal(F.coalesce(F.col(output), F.lit(""))).alias("output_normal"), F.arrays_zip(known.alias("alias"), forms.alias("form")).alias("_pairs"))
    hits = F.filter("_pairs", lambda p: T.contains_phrase(F.col("output_normal"), p["form"]))
    rows = rows.withColumn("matched_alias", F.try_element_at(hits["alias"], F.lit(1))).withColumn("_hit", F.exists("_pairs", lambda p: T.contains_phrase(F.col("output_normal"), p["form"])))
    wrong = T.error_class(F.col(output), F.col("output_normal"), is_cut)
    return rows.select(*kept, "output_normal", F.col("_hit").cast("int").alias("correct"), "matched_alias", F.when(~F.col("_hit"), wrong).alias("error_class"))


def normal_list(texts: Column, normal: Callable[[Column], Column]) -> Column:
    """The normal forms of a list. Vectorised functions can't stand inside a lambda, so one that is gets the whole list."""
    if normal is T.normalise:
        return T.normalise_list(texts)
    return F.transform(texts, normal)


def rescore(stored: DataFrame, tasks: DataFrame, task: str, output: str = "output", aliases: str = "aliases", is_cut: str = "is_cut", normal: Callable[[Column], Column] = T.flat) -> DataFrame:
    """Stored answers with new scores in place of the old ones: no model is asked again. tasks: a row per task with its aliases."""
    rows = stored.drop(*SCORES).join(tasks.select(task, F.col(aliases).alias("_aliases")), task)
    return score(rows, output, "_aliases", F.coalesce(F.col(is_cut).cast("boolean"), F.lit(False)), normal).drop("_aliases")
