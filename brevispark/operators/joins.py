"""Joins for keys of any heat, points in intervals, and phrases of a dictionary in texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevispark.session import durable

#: Rows of a key that one task takes at least, and parts that a side is cut into at most: fewer keys than that are dealt.
LEAST_ROWS, MOST_PARTS = 4096, 2048


def dealt_join(many: DataFrame, few: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Inner join. A key that has more rows in `many` than a part holds is dealt by a hash of `by` over several tasks, and the rows of `few`
    with that key go to each of them. Only such keys are listed (fewer than MOST_PARTS, however many keys there are)."""
    counts = durable(many.groupBy(*keys).agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    part = max(LEAST_ROWS, -(-total // MOST_PARTS))
    hot = F.broadcast(counts.where(F.col("_n") > part).select(*keys, F.ceil(F.col("_n") / part).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    left = many.join(hot, list(keys), "left").withColumn("_part", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("_parts")
    right = few.join(hot, list(keys), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [*keys, "_part"]).drop("_part")


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str) -> DataFrame:
    """Each point with each interval of its group (`keys`, without nulls) that holds it: start <= at < end. Intervals may overlap and be of
    any length; empty ones and nulls hold nothing.

    An interval is put into bins as wide as the next power of two of its length, so that it touches two at most, and points look into the
    bins of the widths that occur (a list of at most 63). A group, or a bin with many points, is dealt over several tasks."""
    length = F.col(end) - F.col(start)
    sized = intervals.where(length > 0).withColumn("_level", F.ceil(F.log2(length.cast("double"))).cast("int"))
    levels = [r[0] for r in sized.select("_level").distinct().collect()]
    if not levels:
        levels = [0]
    bin_of = lambda x, level: F.floor(x / F.pow(F.lit(2.0), level)).cast("bigint")
    first, last = bin_of(F.col(start), F.col("_level")), bin_of(F.col(end) - 1, F.col("_level"))
    binned = sized.withColumn("_bin", F.explode(F.sequence(first, last)))
    looking = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*[F.lit(x) for x in sorted(levels)]))).withColumn("_bin", bin_of(F.col(at), F.col("_level")))
    found = dealt_join(looking, binned, [*keys, "_level", "_bin"], [at])
    return found.where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_level", "_bin")


def phrases_in_texts(texts: DataFrame, phrases: DataFrame, text_keys: Sequence[str], phrase_keys: Sequence[str], text: str = "text", phrase: str = "phrase") -> DataFrame:
    """text_keys and phrase_keys of every text that holds a phrase as whole words; both in one normal form (words with one blank between).
    Keys are unique and share no name. Phrases without a word are in no text.

    Of a phrase's words the one that stands in the fewest texts is its index word; texts meet phrases over index words only, and each pair
    that meets is checked exactly. Texts travel once; what meets are keys."""
    words = lambda c: F.filter(F.array_distinct(F.split(c, " ")), lambda w: w != "")
    own = durable(phrases.select(*phrase_keys, F.col(phrase).alias("_phrase")).where(F.size(words(F.col("_phrase"))) > 0))
    wanted = own.select(F.explode(words(F.col("_phrase"))).alias("_word")).distinct()
    seen = durable(texts.select(*text_keys, F.explode(words(F.col(text))).alias("_word")).join(wanted, "_word", "left_semi"))
    frequency = seen.groupBy("_word").agg(F.count("*").alias("_texts"))
    # a phrase with a word that no text has is in no text: the inner join and the count of its words drop it
    each = own.select(*phrase_keys, "_phrase", F.size(words(F.col("_phrase"))).alias("_size"), F.explode(words(F.col("_phrase"))).alias("_word")).join(frequency, "_word")
    index = each.groupBy(*phrase_keys, "_phrase", "_size").agg(F.min(F.struct("_texts", "_word")).alias("_least"), F.count("*").alias("_found")).where("_found = _size")
    index = index.select(*phrase_keys, "_phrase", F.col("_least._word").alias("_word"))
    pairs = dealt_join(seen, index, ["_word"], list(text_keys)).select(*text_keys, *phrase_keys, "_phrase")
    whole = texts.select(*text_keys, F.concat(F.lit(" "), F.col(text), F.lit(" ")).alias("_whole"))
    return pairs.join(whole, list(text_keys)).where(F.contains("_whole", F.concat(F.lit(" "), "_phrase", F.lit(" ")))).select(*text_keys, *phrase_keys)


def first_hits(hits: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first hit of each key by an order (say, of segments and then of aliases), without a window."""
    rest = [c for c in hits.columns if c not in keys]
    rank = F.struct(*order)
    return hits.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_h")).select(*keys, "_h.*")
