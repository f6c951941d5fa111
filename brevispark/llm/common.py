"""What the corpus operators share: tables, the shared scratch folder, word hashes and array helpers."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts' word rule, `[^\x20\x09-\x0D]+`: the bytes that bytes.split() splits at.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines see (spark.checkpoint.dir). Only a local session without the setting gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="brevispark-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder and reads them back, so a lost executor loses nothing. The files stay
    until they are discarded or the folder is cleared, as the result may be read at any time."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables made by `stored` that nothing reads any longer; others are left alone."""
    for t in tables:
        path = getattr(t, "stored_at", None)
        if path:
            jvm = t.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Rows of one key that a task of `spread_join` takes at least, and parts that all rows are cut into at most.
LEAST_PART, MOST_PARTS = 512, 4096


def spread_join(left: DataFrame, right: DataFrame, key: str | Sequence[str], count: str, by: Sequence[str]) -> DataFrame:
    """Inner join, for keys of any heat. right: few rows a key, with `count`, the number of left's rows of that key (a stored table:
    it is read several times). A key with more rows than one part is dealt by a hash of the columns `by` over several tasks, and
    right's rows go to each of them. A part holds at least 1/4096 of all rows, so fewer than 4096 keys are dealt: that bounds both
    the list of them, which is broadcast, and the rows that are repeated."""
    keys = [key] if isinstance(key, str) else list(key)
    total = right.agg(F.sum(count)).first()[0] or 0
    part = max(LEAST_PART, -(-total // MOST_PARTS))
    parts = F.greatest(F.lit(1), F.ceil(F.col(count) / part)).cast("int")
    hot = right.where(F.col(count) > part).groupBy(*keys).agg(F.max(parts).alias("_parts"))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("_part", F.pmod(F.xxhash64(*by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    return dealt.join(right.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))), [*keys, "_part"]).drop("_part")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler (wrapping arithmetic)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


class Memo(dict):
    """A bounded memory of a function of words: it empties itself when full, so results never depend on it."""

    def __init__(self, make, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.make(key)
        return value


def column_bytes(column: pa.Array) -> list:
    """The values of a string column as bytes (None for null), without decoding."""
    return column.cast(pa.large_binary()).to_pylist()


def column_texts(column: pa.Array) -> list[str | None]:
    """The values of a string column; bytes that are no UTF-8 count as U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if b is None else b.decode("utf-8", "replace") for b in column_bytes(column)]


def runs(lengths: np.ndarray) -> np.ndarray:
    """Offsets (one more than lengths) of consecutive runs."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each run, one after the other."""
    at = runs(lengths)
    return np.arange(at[-1]) + np.repeat(starts - at[:-1], lengths)


def carried(df: DataFrame, keep: Sequence[str], text: str) -> tuple[DataFrame, list[str], str]:
    """The columns to carry along as k0, k1, ... and the text, among them or after them: names can't clash, and the text travels
    once. Returns the frame, the new names and the text's."""
    names = [f"k{i}" for i in range(len(keep))]
    columns = [F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)]
    if text in keep:
        return df.select(*columns), names, names[list(keep).index(text)]
    return df.select(*columns, F.col(f"`{text}`").alias("_text")), names, "_text"


def fields_of(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Field definitions of some columns, for the schema of a function's result."""
    return [f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names]


def pieces(batch: pa.RecordBatch, column: str, most: int = 1 << 18):
    """Parts of a batch whose texts hold about `most` bytes each (always one row at least): bounds memory, not text length."""
    data = batch.column(column)
    sizes = np.array([0 if v is None else v for v in pc.binary_length(data).to_pylist()], np.int64)
    ends, total, start = [], 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            ends.append((start, i))
            start, total = i, 0
        total += int(n)
    ends.append((start, len(sizes)))
    for a, b in ends:
        if b > a:
            yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    """Returns memory that a worker no longer uses to the system: workers live as long as their executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_HELD: dict = {}


def held(key: str, make=dict):
    """What a worker remembers for one operator: made once, and kept until another operator comes to the same worker (they live as
    long as their executor, and must not hold the memory of all that ever ran in them)."""
    if key not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[key] = make()
    return _HELD[key]


#: Bits of a key filter; a longer key list saturates it, which costs speed but no row.
MOST_FILTER_BITS = 1 << 22


class KeyFilter:
    """A Bloom filter of keys as a constant of the plan: `may_hold` is true for every key, and false for most other values.

    It only decides which rows need a join at all; the join stays exact. Its size is bounded by MOST_FILTER_BITS."""

    def __init__(self, keys: DataFrame, *columns: str):
        n = keys.count()
        self.bits = min(MOST_FILTER_BITS, max(64, 1 << (12 * n - 1).bit_length() if n else 64))
        at = keys.select(F.explode(F.array(*[self._bit(list(map(F.col, columns)), j) for j in (0, 1, 2)])).alias("at"))
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("at", F.lit(64)).cast("int"))
        rows = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(one).alias("bits")).collect()  # at most bits / 64
        filled = {r.word: r.bits for r in rows}
        self.words = ",".join(str(filled.get(i, 0)) for i in range(self.bits // 64))

    def _bit(self, values: list[Column], j: int) -> Column:
        return F.pmod(F.xxhash64(*values, F.lit(j)), F.lit(self.bits))

    def may_hold(self, *values: Column) -> Column:
        array = F.split(F.lit(self.words), ",").cast("array<bigint>")
        out = F.lit(True)
        for j in (0, 1, 2):
            at = self._bit(list(values), j)
            out = out & (F.getbit(F.element_at(array, (F.floor(at / 64) + 1).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1)
        return out
