"""URL filters: host and path rules, then a Bloom filter cascade over the corpus's complete key universe.

A cascade is a list of bit arrays. Level 0 encodes the listed keys; level 1 encodes those unlisted keys of the universe
that level 0 lets through; level 2 the listed keys that level 1 lets through; and so on until a level lets no key of the
other side through. A key of the universe belongs to the list exactly if the first level that lacks it has an odd number.
Everything runs as DataFrame expressions: the bit arrays are constants of the plan and no row is joined. A list whose bits
would outgrow a plan is dealt by key hash into shards with a cascade each; rows are judged by one shard after the other.

Keys are domain names. A host's keys are its endings of as many labels as some listed name has: no other ending can be listed.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule and has no keys (allowed).
Repeated rows are judged one by one. An empty table or list gives an empty or all-allowed result. Hosts of any length and
number of labels are read whole, in memory that grows with the listed names, not with the square of the host. Other columns of
the input are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Bits of the first level of one shard (4 MB in the plan); later levels are smaller.
MOST_BITS = 1 << 25
MOST_LEVELS = 64
#: Bits per key of later levels, and the fewest of the first.
LATER_BITS, FIRST_BITS = 6, 8


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL_PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict, both null without one. rules: (verdict, host and path) pairs."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def n_labels(name: Column) -> Column:
    return F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) + 1


def keys_of(host: Column, depths: Sequence[int]) -> Column:
    """The host's endings of so many labels; none for an empty host."""
    if not depths:
        return F.array().cast("array<string>")
    ending = lambda d: F.when((host != "") & (n_labels(host) >= d), F.call_function("substring_index", host, F.lit("."), -d))
    return F.filter(F.transform(F.array(*map(F.lit, depths)), ending), lambda k: k.isNotNull() & (k != ""))


def _bit(key: Column, level: int, j: int, bits: int) -> Column:
    """The j-th bit of a key at a level, by double hashing."""
    a, b = F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1))
    return F.pmod(F.pmod(a, F.lit(bits)) + F.lit(j) * F.pmod(b, F.lit(bits)), F.lit(bits))


def _within(key: Column, level: int, words: str, bits: int, hashes: int) -> Column:
    array = F.split(F.lit(words), ",").cast("array<bigint>")  # one constant, folded once
    out = F.lit(True)
    for j in range(hashes):
        at = _bit(key, level, j, bits)
        out = out & (F.getbit(F.element_at(array, (F.floor(at / 64) + 1).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1)
    return out


class Cascade:
    """Levels as (words, bits, hashes); `listed(key)` is exact for the keys of the universe it was built over."""

    def __init__(self, levels: list[tuple[str, int, int]]):
        self.levels = levels

    def passes(self, key: Column, upto: int | None = None) -> Column:
        out = F.lit(True)
        for n, level in enumerate(self.levels[:upto]):
            out = out & _within(key, n, *level)
        return out

    def listed(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for n in range(len(self.levels) - 1, -1, -1):
            out = F.when(~_within(key, n, *self.levels[n]), F.lit(n % 2 == 1)).otherwise(out)
        return out if self.levels else F.lit(False)

    def size_bits(self) -> int:
        return sum(bits for _, bits, _ in self.levels)


def bits_of(n_listed: int, n_unlisted: int) -> int:
    """Bits per key of the first level: so many that it lets through about as many unlisted keys as there are listed ones."""
    return max(FIRST_BITS, math.ceil(1.44 * math.log2(max(1.0, n_unlisted / max(1, n_listed)))))


def build_cascade(universe: DataFrame, bits_per_key: tuple[int, int] = (12, LATER_BITS)) -> Cascade:
    """universe: distinct (key, listed boolean). bits_per_key: of level 0 and of later levels. Each level costs two scans of the
    universe; only its bits come to the driver, as at most bits / 64 rows."""
    cascade = Cascade([])
    for level in range(MOST_LEVELS):
        side = universe.where((F.col("listed") == F.lit(level % 2 == 0)) & cascade.passes(F.col("key")))
        n = side.count()
        if not n:
            return cascade
        per_key = bits_per_key[min(level, 1)]
        bits = max(64, -(-n * per_key // 64) * 64)
        hashes = max(1, round(0.69 * per_key))
        at = side.select(F.explode(F.array(*[_bit(F.col("key"), level, j, bits) for j in range(hashes)])).alias("at"))
        word = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("at", F.lit(64)).cast("int"))).alias("bits"))
        filled = {r.word: r.bits for r in word.collect()}
        cascade.levels.append((",".join(str(filled.get(i, 0)) for i in range(bits // 64)), bits, hashes))
    raise RuntimeError("the cascade did not end: keys of both sides share all hashes")


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards))


def _within_shard(shard: int, shards: int):
    return lambda key: shard_of(key, shards) == shard


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], listed: DataFrame | Iterable[str], url: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """Judges every url. listed: blocked domain names, as rows of a column `key` or as a short list of strings.

    Returns the columns `keep`, host, path, rule (the longest fitting rule, else null), verdict (the rule's, else block if the
    host or a parent domain is listed, else allow) and method_verdict (by the cascade alone).
    """
    spark = pages.sparkSession
    if not isinstance(listed, DataFrame):
        listed = spark.createDataFrame([(k,) for k in sorted({*listed})], "key string")
    marks = listed.select(F.translate("key", UPPER, LOWER).alias("key")).where("key IS NOT NULL AND key <> ''").distinct()
    marks = stored(marks.withColumn("listed", F.lit(True)), "url-list")
    # names of n different depths hold n * n / 2 labels at least, so there are few; by the rules of DNS at most 127
    depths = sorted(r.n for r in marks.select(n_labels(F.col("key")).alias("n")).distinct().collect())
    hosts = pages.select(host_of(F.col(url)).alias("host")).distinct()
    keys = hosts.select(F.explode(keys_of(F.col("host"), depths)).alias("key")).distinct()
    universe = stored(keys.join(marks, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "url-keys")
    size = universe.agg(F.count_if("listed").alias("listed"), F.count_if(~F.col("listed")).alias("unlisted")).first()
    per_key = bits_of(size.listed, size.unlisted)
    shards = max(1, -(-size.listed * per_key // MOST_BITS))
    judged = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.lit(False).alias("hit"))
    for shard in range(shards):
        cascade = build_cascade(universe.where(shard_of(F.col("key"), shards) == shard), (per_key, LATER_BITS))
        mine = keys_of(F.col("host"), depths) if shards == 1 else F.filter(keys_of(F.col("host"), depths), _within_shard(shard, shards))
        before, judged = judged, judged.withColumn("hit", F.col("hit") | F.exists(mine, cascade.listed))
        if shard < shards - 1:
            judged = stored(judged, "url-judged")
            discard(before)
    discard(marks, universe)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), method.alias("method_verdict"))
