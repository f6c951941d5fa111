"""Texts as arrays of labelled words, without a shuffle: each token carries form, key, place, section and origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevispark.functions import arrays as A
from brevispark.functions import text as T

CORE, REDUNDANT = "core", "redundant"
SECTIONS = ("instruction", "demonstration", "question", "filler")


def segments_of_lines(text: Column) -> Column:
    """A plain text as segments: its lines. The first is the instruction, the last of several the question, the others are
    demonstrations; every second line counts as inserted redundancy."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    return F.transform(lines, lambda line, i: F.struct(
        i.alias("ord"),
        F.when(i == 0, "instruction").when(i == n - 1, "question").otherwise("demonstration").alias("section"),
        F.when(i % 2 == 1, REDUNDANT).otherwise(CORE).alias("origin"),
        line.alias("text"),
    ))


def labelled_tokens(segments: Column) -> Column:
    """Segments as one array of tokens (form, key, is_word, is_digit, is_protected, section, origin, ord). Segments end at white
    space, so no token crosses one and no range join is needed."""
    def of(s: Column) -> Column:
        seen = F.transform(T.tokens(s["text"]), lambda form: F.struct(form.alias("form"), T.is_word(form).alias("w"), T.has_digit(form).alias("d")))  # patterns run once
        return F.transform(seen, lambda t: F.struct(
            t["form"].alias("form"), T.fold(t["form"]).alias("key"), t["w"].alias("is_word"), t["d"].alias("is_digit"),
            (t["w"] & (t["form"].isin(*T.PROTECTED_FORMS) | t["d"])).alias("is_protected"), s["section"].alias("section"), s["origin"].alias("origin"), s["ord"].alias("ord"),
        ))

    return F.flatten(F.transform(segments, of))


def word_marks(segments: Column) -> Column:
    """The words alone, in order, with what deletion asks of them: (form, is_protected, is_core)."""
    def of(s: Column) -> Column:
        return F.transform(T.words(s["text"]), lambda form: F.struct(form.alias("form"), T.is_protected(form).alias("is_protected"), (s["origin"] == CORE).alias("is_core")))

    return F.flatten(F.transform(segments, of))


def word_rows(df: DataFrame, tokens: str = "tokens", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per token: keep, pos, rel_pos (pos / (n - 1), 0 for one token) and the token's fields.

    Rows are exploded with their nulls, which then go: for a plain explode the optimiser would put a filter on the tokens below the
    shuffle that spreads the texts, and make the tokens there once more."""
    rows = df.select(*keep, F.col(tokens).alias("_t")).select(*keep, F.size("_t").alias("_n"), F.posexplode_outer("_t").alias("pos", "t")).where("pos IS NOT NULL")
    return rows.select(*keep, "pos", F.when(F.col("_n") > 1, F.col("pos") / (F.col("_n") - 1)).otherwise(F.lit(0.0)).alias("rel_pos"), "t.*")


def token_offsets(df: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """A row per token of a whole text: keep, pos, start (code points from 0) and form."""
    own = df.select(*keep, T.tokens(F.col(text)).alias("_forms"), F.transform(F.split(text, T.TOKEN, -1), F.length).alias("_between"))
    gaps = F.slice("_between", 1, F.size("_forms"))  # one more than tokens: the last one is behind all of them
    rows = A.with_starts(own, F.transform("_forms", F.length), gaps, "_starts")
    return rows.select(*keep, F.posexplode_outer(F.arrays_zip("_forms", "_starts")).alias("pos", "_z")).where("pos IS NOT NULL").select(*keep, "pos", F.col("_z._starts").alias("start"), F.col("_z._forms").alias("form"))


def line_offsets(df: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """A row per line of a text: keep, ord, start and end (code points; the line break is not part of it)."""
    own = df.select(*keep, F.transform(F.split(text, "\n"), F.length).alias("_n"))
    rows = A.with_starts(own, F.col("_n"), F.transform("_n", lambda x, i: F.when(i == 0, 0).otherwise(1)), "_starts")
    return rows.select(*keep, F.posexplode(F.arrays_zip("_n", "_starts")).alias("ord", "_z")).select(*keep, "ord", F.col("_z._starts").alias("start"), (F.col("_z._starts") + F.col("_z._n")).alias("end"))


def tokens_by_line(df: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """A row per line that has a token: keep, ord and its tokens' forms. Tokens are those of the whole text, and told to lines by their
    places alone; a line's are a run of the text's, so that nothing but the row is needed."""
    whole = df.select(*keep, T.tokens(F.col(text)).alias("_forms"), F.transform(F.split(text, T.TOKEN, -1), F.length).alias("_between"), F.transform(F.split(text, "\n"), F.length).alias("_lines"))
    points = F.transform("_forms", F.length), F.slice("_between", 1, F.size("_forms"))  # one more than tokens: the last one is behind all of them
    lines = F.col("_lines"), F.transform("_lines", lambda x, i: F.when(i == 0, 0).otherwise(1))
    lean = whole.select(*keep, "_forms", *[c.alias(f"_c{i}") for i, c in enumerate((*points, *lines))])
    rows = A.with_runs(lean, (F.col("_c0"), F.col("_c1")), (F.col("_c2"), F.col("_c3")), "_runs").select(*keep, "_forms", "_runs")
    made = F.filter(F.transform("_runs", lambda r, i: F.struct(i.alias("ord"), F.slice(F.col("_forms"), r["first"] + 1, r["n"]).alias("forms"))), lambda z: F.size(z["forms"]) > 0)
    return rows.select(*keep, F.explode_outer(made).alias("_z")).where("_z IS NOT NULL").select(*keep, "_z.*")  # a plain explode makes its list twice


def type_overlap(segments: Column) -> Column:
    """Share of the redundancy's distinct word forms that the core has too; null without redundancy."""
    forms = lambda origin: F.array_distinct(F.flatten(F.transform(F.filter(segments, lambda s: s["origin"] == origin), lambda s: F.transform(T.words(s["text"]), T.fold))))
    share = lambda red: F.size(F.array_intersect(red, forms(CORE))) / F.when(F.size(red) > 0, F.size(red))
    return F.transform(F.array(forms(REDUNDANT)), share)[0]  # forms are made once


def leakage(segments: Column, answers: Column) -> tuple[Column, Column]:
    """Whether an answer stands outside the question, as whole words, and the first section where; texts are compared flat."""
    flat = lambda texts: F.transform(texts, T.flat)
    return leaks_in(segments, flat(F.transform(segments, lambda s: s["text"])), flat(answers))


def leaks_in(segments: Column, forms: Column, sought: Column) -> tuple[Column, Column]:
    """The same with normal forms that were made before: of the segments' texts, and of the answers (neither an expression with a Python
    function in it, which can't stand inside a lambda)."""
    pairs = F.arrays_zip(F.transform(segments, lambda s: s["section"]).alias("section"), forms.alias("form"))
    hits = F.filter(pairs, lambda p: (p["section"] != "question") & F.exists(sought, lambda a: T.contains_phrase(p["form"], a)))
    return (F.size(hits) > 0).cast("int"), F.try_element_at(F.transform(hits, lambda p: p["section"]), F.lit(1))


def origin_counts(segments: Column) -> tuple[Column, Column]:
    """White-space words of the core and of the redundancy."""
    total = lambda origin: F.aggregate(F.filter(segments, lambda s: s["origin"] == origin), F.lit(0), lambda a, s: a + T.ws_count(s["text"]))
    return total(CORE), total(REDUNDANT)
