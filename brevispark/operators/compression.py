"""Compression by deletion: a deterministic stand-in for a model, and the plug-in point for a real one.

The stand-in keeps the order, keeps protected words always, and of the others the longest, `ceil(rate * n)` of them, ties to
the earlier place. A rate of 1 is the identity. `indifferent` picks by a hash instead and ignores what it deletes.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevispark.functions import text as T

from .plugins import plugged

LEVELS = (0.0, 0.25, 0.5, 0.75)


def _rank(t: Column, i: Column, seed: int | None) -> Column:
    """What free words are picked by, least first: length and place in one number, or a hash."""
    if seed is None:
        return i.cast("bigint") - F.length(t["form"]) * (1 << 32)
    return F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), i.cast("string"), t["form"])), i)


def pick_order(tokens: Column, seed: int | None = None) -> Column:
    """The ranks of the free words, ascending: computed once for all levels."""
    free = F.transform(tokens, lambda t, i: F.when(t["is_word"] & ~t["is_protected"], _rank(t, i, seed)))
    return F.sort_array(F.filter(free, lambda x: x.isNotNull()))


def survival(tokens: Column, rho: Column, order: Column, seed: int | None = None) -> Column:
    """Which tokens a deletion at level rho leaves, as array<boolean>; everything runs within the row."""
    n_kept = F.ceil((1 - rho) * F.size(order)).cast("int")
    cut = F.try_element_at(order, F.when(n_kept > 0, n_kept))

    def mask(row: Column) -> Column:
        return F.transform(row["tokens"], lambda t, i: t["is_word"] & (t["is_protected"] | F.coalesce(_rank(t, i, seed) <= row["cut"], F.lit(False))))

    # the cut is a field of a single row's struct, so that it is computed once and not for each token
    found = F.element_at(F.transform(F.array(F.struct(tokens.alias("tokens"), cut.alias("cut"))), mask), 1)
    return F.when(rho == 0, F.array_repeat(F.lit(True), F.size(tokens))).otherwise(found)


def kept_text(tokens: Column, mask: Column) -> Column:
    """The tokens that live, joined by spaces. (A mask must not stand inside a lambda: it would be computed for each token.)"""
    kept = F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda z: z["m"])
    return F.array_join(F.transform(kept, lambda z: z["t"]["form"]), " ")


def lean_tokens(tokens: Column, *fields: str) -> Column:
    """Tokens with some of their fields, whether they always live, and the rank that a free word is picked by."""
    rank = lambda t, i: F.when(t["is_word"] & ~t["is_protected"], _rank(t, i, None))
    return F.transform(tokens, lambda t, i: F.struct(*[t[f].alias(f) for f in fields], (t["is_word"] & t["is_protected"]).alias("always"), rank(t, i).alias("rank")))


def rank_order(lean: Column) -> Column:
    return F.sort_array(F.filter(lean["rank"], lambda r: r.isNotNull()))


def kept_at_levels(tokens: Column, field: str = "form", levels: tuple[float, ...] = LEVELS) -> Column:
    """What each level leaves, as array<struct<rho,kept array<string>>>, by one field of the tokens. All levels of a row are made at
    once from one ranking, so tokens are not copied for each level."""
    def of(row: Column) -> Column:
        def level(rho: float) -> Column:
            lives = lambda t: t["always"] | F.coalesce(t["rank"] <= _cut(row["order"], rho), F.lit(False))
            return F.struct(F.lit(float(rho)).alias("rho"), (F.filter(row["t"], lives) if rho else row["t"])[field].alias("kept"))

        return F.array(*[level(rho) for rho in levels])

    # one-element arrays bind a value once: ranks, then their order
    bound = F.transform(F.array(lean_tokens(tokens, field)), lambda t: F.struct(t.alias("t"), rank_order(t).alias("order")))
    return F.transform(bound, of)[0]


#: The mark of a protected word, below that of any free one.
ALWAYS = -(1 << 62)


def marks(forms: Column) -> Column:
    """What deletion asks of the tokens of a text, one number each: the rank of a free word, ALWAYS for a protected one, null for no word."""
    return F.transform(forms, lambda form, i: F.when(T.is_word(form), F.when(T.is_protected(form), ALWAYS).otherwise(i.cast("bigint") - F.length(form) * (1 << 32))))


def kept_by_marks(members: Column, marks: Column, levels: tuple[float, ...]) -> Column:
    """As `kept_at_levels`, of any list as long as the marks: the same words live, without the labels that deletion does not ask for."""
    some = [rho for rho in levels if rho]

    def of(row: Column) -> Column:
        lives = lambda i: lambda z: z["m"] <= row["cuts"][i]
        kept = lambda rho: F.filter(row["z"], lives(some.index(rho))) if rho else row["z"]
        return F.array(*[F.struct(F.lit(float(rho)).alias("rho"), kept(rho)["x"].alias("kept")) for rho in levels])

    # one-element arrays bind a value once: the order, then what it is cut to at each level
    order = F.array(F.sort_array(F.filter(marks, lambda m: m > ALWAYS)))
    cuts = F.transform(order, lambda o: F.array(*[F.coalesce(_cut(o, rho), F.lit(ALWAYS)) for rho in some]))[0]
    return F.transform(F.array(F.struct(F.arrays_zip(members.alias("x"), marks.alias("m")).alias("z"), cuts.alias("cuts"))), of)[0]


def each_level(df: DataFrame, levels: Column) -> DataFrame:
    """One row for each level, with the fields of its struct. Exploded with nulls, which then go: for a plain explode the optimiser
    would put a filter on the array below the shuffle that spreads the texts, and make it there once more."""
    keep = df.columns
    return df.select(*keep, levels.alias("_levels")).select(*keep, F.explode_outer("_levels").alias("_z")).where("_z IS NOT NULL").select(*keep, "_z.*")


def _cut(order: Column, rho: float) -> Column:
    """The last rank that a level keeps; null if it keeps none."""
    n = F.ceil((1 - F.lit(float(rho))) * F.size(order)).cast("int")
    return F.try_element_at(order, F.when(n > 0, n))


def counts_at_levels(words: Column, levels: tuple[float, ...] = LEVELS) -> Column:
    """Words and kept words by origin, of all words and of the free ones, for every level: array<struct<rho,n_core,...>>. words: as
    of `words.word_marks`. Free words are ranked once; a level only counts a slice of them."""
    def of(row: Column) -> Column:
        w, free = row["w"], row["free"]
        n = {f"{o}{s}": F.size(F.filter(w, _marked(o == "core", s))) for o in ("core", "red") for s in ("", "_free")}
        bound = F.struct(free.alias("free"), *[x.alias(k) for k, x in n.items()])

        def level(b: Column, rho: float) -> Column:
            some = F.slice(b["free"], 1, F.ceil((1 - F.lit(float(rho))) * F.size(b["free"])).cast("int"))
            core = F.size(F.filter(some, lambda r: r.bitwiseAND(1) == 1)) if rho else b["core_free"]
            red = F.size(some) - core if rho else b["red_free"]
            kept = {"core_free": core, "red_free": red, "core": b["core"] - b["core_free"] + core, "red": b["red"] - b["red_free"] + red}
            return F.struct(F.lit(float(rho)).alias("rho"), *[b[k].alias(f"n_{k}") for k in n], *[kept[k].alias(f"e_{k}") for k in n])

        return F.transform(F.array(bound), lambda b: F.array(*[level(b, rho) for rho in levels]))[0]

    ranks = lambda w: F.sort_array(F.filter(F.transform(w, lambda t, i: F.when(~t["is_protected"], _rank_and_origin(t, i))), lambda r: r.isNotNull()))
    bound = F.transform(F.array(words), lambda w: F.struct(w.alias("w"), ranks(w).alias("free")))
    return F.transform(bound, of)[0]


def _rank_and_origin(t: Column, i: Column) -> Column:
    """Rank and origin in one number: longest first, then place; the last bit tells the core."""
    return (i.cast("bigint") - F.length(t["form"]) * (1 << 31)) * 2 + t["is_core"].cast("bigint")


def unmixed_at_levels(words: Column, levels: tuple[float, ...]) -> Column:
    """Free words and kept ones by origin over the words whose folded form stands in one origin only, for every level above 0:
    array<struct<rho,n_core,n_red,e_core,e_red>>. words: as of `words.word_marks`. Sorted within their row, the words of a form are a
    run, the redundancy's before the core's, so that its first and its last word tell its origins; nothing is shuffled."""
    def in_order(row: Column) -> Column:
        return F.sort_array(F.transform(row["w"], lambda t, i: F.struct(row["keys"][i].alias("key"), t["is_core"].alias("core"), F.when(~t["is_protected"], _rank_and_origin(t, i)).alias("rank"))))

    def with_starts(s: Column) -> Column:
        first = F.transform(s, lambda t, i: F.when((i == 0) | (t["key"] != F.get(s, i - 1)["key"]), i))
        return F.struct(s["core"].alias("core"), s["rank"].alias("rank"), F.concat(F.filter(first, lambda i: i.isNotNull()), F.array(F.size(s))).alias("starts"))

    def unmixed(r: Column) -> Column:
        runs = F.transform(F.slice(r["starts"], 1, F.size(r["starts"]) - 1), lambda a, j: F.struct(a.alias("a"), r["starts"][j + 1].alias("b")))
        pure = F.filter(runs, lambda z: r["core"][z["a"]] == r["core"][z["b"] - 1])
        ranks = F.flatten(F.transform(pure, lambda z: F.slice(r["rank"], z["a"] + 1, z["b"] - z["a"])))
        return F.struct(F.filter(ranks, lambda x: x.isNotNull()).alias("ranks"), F.sort_array(F.filter(r["rank"], lambda x: x.isNotNull())).alias("free"))

    def parted(b: Column) -> Column:
        own = lambda bit: F.filter(b["ranks"], lambda x: x.bitwiseAND(1) == bit)
        return F.struct(own(1).alias("core"), own(0).alias("red"), F.array(*[_cut(b["free"], rho) for rho in levels]).alias("cuts"))

    def counted(b: Column) -> Column:
        kept = lambda o, i: F.size(F.filter(b[o], lambda x: x <= b["cuts"][i]))
        return F.array(*[F.struct(F.lit(float(rho)).alias("rho"), *[F.size(b[o]).alias(f"n_{o}") for o in ("core", "red")], *[kept(o, i).alias(f"e_{o}") for o in ("core", "red")]) for i, rho in enumerate(levels)])

    # one-element arrays bind a value once
    found = F.transform(F.array(words), lambda w: F.struct(w.alias("w"), T.fold_each(w["form"]).alias("keys")))
    for step in (in_order, with_starts, unmixed, parted, counted):
        found = F.transform(found, step)
    return found[0]


def _marked(core: bool, suffix: str):
    return lambda t: (t["is_core"] if core else ~t["is_core"]) & (~t["is_protected"] if suffix else F.lit(True))


def at_levels(df: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """Every row once for each level, in column rho."""
    return df.withColumn("rho", F.explode(F.array(*[F.lit(float(x)) for x in levels])))


def compress_with(df: DataFrame, make: Callable[[], Callable[[str, float], str]], text: str = "text", rate: str = "rate") -> DataFrame:
    """Adds `compressed` by a model, the seconds that its call took, `compress_s`, and `error`: `make` runs once per worker and returns
    text, rate -> text. A row that fails has no text and the reason in `error`, so that a broken model can be told from one that leaves
    nothing."""
    def call(model, t, r):
        start = time.perf_counter()
        found = model(t, r)
        return found, time.perf_counter() - start

    return plugged(df, make, (text, rate), "compressed string, compress_s double", call)


def shape_measures(original: Column, compressed: Column) -> dict[str, Column]:
    """Rates and structure of a compressed text against its original."""
    from brevispark.functions.stats import ratio

    n0, n1 = T.ws_count(original), T.ws_count(compressed)
    return {
        "n_ws": n1, "rho_real": 1 - ratio(n1, n0), "marks_kept": ratio(T.mark_count(compressed), T.mark_count(original)),
        "digits_kept": ratio(T.digit_count(compressed), T.digit_count(original)), "n_breaks": T.line_breaks(compressed),
    }
