"""Benchmark decontamination by greedy string tiling.

Seeds are runs of `least` tokens (of all tokens, for items shorter than that).

1. Items give their seeds; a Bloom filter of them, of bounded size, goes to the workers. Documents are scanned once, whatever
   the size of the benchmark, and give the seeds that pass it. The filter only saves rows: the joins decide.
2. Document and item are candidates if they share a seed (a hash join). An item leaves out its most frequent seeds as long as
   the tokens under them stay below the threshold: a pair that shares no other seed cannot reach it. So a stem that many items
   and many documents have makes no candidates. Hot seeds and items are dealt over several tasks.
3. Candidates of a document travel in lists of bounded length. For each of them, the longest match between unmarked tokens of
   both is marked as a tile, again and again: its length is found by bisection over running Karp-Rabin hashes, down to `least`.
   Tiles never overlap and may lie in any order, so reordered passages count in full. The share of the item's tokens under tiles
   is its coverage; items covered by `threshold` or more have leaked.

Tokens are runs of letters, digits and underscores in lower case.

Defined cases: null or empty texts and items have no tokens and no result. An item of fewer than `least` tokens leaks where all
of them stand in a row. Repeated documents and repeated items are judged one by one. Ties between matches of one length go to
the earlier place in the item, then in the document. Texts of any length, repetitive ones too, are read whole; other columns are
ignored.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, as_long, column_texts, discard, held, mix, pieces, ranges, runs, spread_join, stored

TOKEN = re.compile(r"\w+")
ROOT = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the seeds' filter at most (4 MB); a larger benchmark saturates it, which costs rows of the join but no result.
MOST_FILTER_BITS = 1 << 25
#: Items of one list, near enough.
LIST = 256


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def token_hashes(words: list[str]) -> np.ndarray:
    return mix(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of so many token hashes."""
    out = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for j in range(size):
        out = out * np.uint64(0x100000001B3) + h[j : j + len(out)]
    return mix(out)


class _Running:
    """Karp-Rabin hashes of the runs of a token list, of any length, from two running sums; tokens below 0 are marked."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.marked = ids, ids < 0
        up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(ids), ROOT)]))
        self.down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(ids), np.uint64(pow(int(ROOT), -1, 1 << 64)))]))
        self.total = np.concatenate([[np.uint64(0)], np.cumsum(mix(ids.astype(np.uint64)) * up[:-1], dtype=np.uint64)])

    def free(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of unmarked runs of a length."""
        blocked = np.concatenate([[0], np.cumsum(self.marked)])
        start = np.flatnonzero(blocked[size:] == blocked[: max(0, len(blocked) - size)])
        return start, (self.total[start + size] - self.total[start]) * self.down[start]


def tile(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, length), by start in the item. Tokens below 0 match nothing.

    The longest length that both sides share falls from tile to tile; each length costs a bisection of linear steps, and there
    are fewer lengths than the square root of twice the item."""
    one, two = _Running(np.asarray(item, np.int64)), _Running(np.asarray(text, np.int64))
    out, top = [], min(len(one.ids), len(two.ids))

    def shared(size: int) -> bool:
        return bool(np.isin(one.free(size)[1], two.free(size)[1]).any())

    while top >= least and shared(least):
        low = least
        if shared(top):
            low = top
        while low < top:
            middle = (low + top + 1) // 2
            low, top = (middle, top) if shared(middle) else (low, middle - 1)
        (q_all, q_hash), (p_all, p_hash) = one.free(low), two.free(low)
        order = np.argsort(p_hash, kind="stable")
        p_all, p_hash = p_all[order], p_hash[order]
        next_, end = (np.searchsorted(p_hash, q_hash, side) for side in ("left", "right"))
        at: dict[int, int] = {}
        for i in np.flatnonzero(end > next_).tolist():
            q, value = int(q_all[i]), int(q_hash[i])
            if one.marked[q] or one.marked[q + low - 1]:  # tiles of this round are as long, so they cover an end of what they touch
                continue
            j = at.get(value, int(next_[i]))
            while j < end[i]:
                p = int(p_all[j])
                if two.marked[p] or two.marked[p + low - 1]:
                    j += 1
                elif (one.ids[q : q + low] == two.ids[p : p + low]).all():
                    one.marked[q : q + low] = two.marked[p : p + low] = True
                    out.append((q, p, low))
                    j += 1
                    break
                else:  # hashes equal by chance
                    j += 1
            at[value] = j
        top = low - 1
    return sorted(out)


def kept_seeds(seed: np.ndarray, size: int, n: int, frequency: dict[int, int], threshold: float) -> list[int]:
    """The seeds of an item (in order of place, each of `size` tokens, n tokens in all) without the most frequent ones, as long as
    the tokens under those stay below the threshold."""
    places: dict[int, list[int]] = {}
    for i, s in enumerate(seed.tolist()):
        places.setdefault(s, []).append(i)
    under, out = np.zeros(n, bool), []
    for s in sorted(places, key=lambda s: (-frequency.get(s, 0), s)):
        if not out:
            more = under.copy()
            for i in places[s]:
                more[i : i + size] = True
            if np.count_nonzero(more) < threshold * n:
                under = more
                continue
        out.append(s)
    return [s for s in out if s in frequency]


class Document:
    """A text's tokens, with its seeds in order."""

    def __init__(self, text: str):
        self.words = tokens(text)
        self.hashes = token_hashes(self.words)
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def tiles(self, item: list[str], least: int, threshold: float) -> list[tuple[int, int, int]]:
        """Tiles of one item, or none if its coverage stays below the threshold."""
        n = len(item)
        size = min(least, n)
        if size not in self.sorted:
            gram = grams(self.hashes, size)
            order = np.argsort(gram, kind="stable")
            self.sorted[size] = gram[order], order
        gram, order = self.sorted[size]
        own = grams(token_hashes(item), size)
        hit = np.flatnonzero(np.searchsorted(gram, own, "right") > np.searchsorted(gram, own, "left"))
        if len(np.unique(ranges(hit, np.full(len(hit), size)))) < threshold * n:  # tiles lie within seeds
            return []
        seed = np.unique(own[hit])
        a, b = np.searchsorted(gram, seed, "left"), np.searchsorted(gram, seed, "right")
        spots = np.sort(order[ranges(a, b - a)])
        # only words under seeds can be in tiles: the rest of the text is left out, gaps kept as breaks
        place = np.unique(ranges(spots, np.full(len(spots), size)))
        gaps = np.flatnonzero(np.diff(place) > 1) + 1
        number: dict[str, int] = {}
        item_ids = np.array([number.setdefault(w, len(number)) for w in item])
        ids = np.insert(np.array([number.get(self.words[i], -1) for i in place.tolist()]), gaps, -1)
        origin = np.insert(place, gaps, -1)
        found = [(q, int(origin[p]), m) for q, p, m in tile(item_ids, ids, size)]
        return found if sum(m for _, _, m in found) >= threshold * n else []


class SeedFilter:
    """A Bloom filter of seeds, two bits each, that workers test in numpy."""

    def __init__(self, seeds: DataFrame):
        n = seeds.count()
        self.bits = min(MOST_FILTER_BITS, 1 << max(10, (16 * n).bit_length()))
        at = seeds.select(F.explode(F.array(F.col("seed"), F.shiftrightunsigned("seed", 32))).alias("x")).select(F.col("x").bitwiseAND(self.bits - 1).alias("at"))
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("at", F.lit(64)).cast("int"))
        rows = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(one).alias("bits")).collect()  # at most bits / 64
        self.words = np.zeros(self.bits // 64, np.int64)
        self.words[[r.word for r in rows]] = [r.bits for r in rows]

    def may_hold(self, seed: np.ndarray) -> np.ndarray:
        words, out = self.words.view(np.uint64), np.ones(len(seed), bool)
        for x in (seed, seed >> np.uint64(32)):
            at = x & np.uint64(self.bits - 1)
            out &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def find_leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = 0.5, least: int = 5, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Returns a row per leaked (document, item): doc_id, text_hash, item_id, n_tokens (of the item), n_covered, coverage, and
    tiles as array<struct<item_start,doc_start,length>> in tokens, by place in the item."""
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.hash(F.col(text)).alias("text_hash"), F.col(text).alias("text")).where("text IS NOT NULL").withColumn("dk", F.xxhash64("doc_id", "text"))
    kind = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]))
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash int, item_id long, n_tokens long, n_covered long, coverage double, tiles array<struct<item_start:int,doc_start:int,length:int>>"
    items = benchmark.select(F.col(item_id).cast("bigint").alias("item_id"), F.make_valid_utf8(F.col(item_text)).alias("item")).where("item IS NOT NULL").groupBy("item_id", "item").agg(F.count("*").alias("copies"))
    items = stored(items.withColumn("ik", F.xxhash64("item_id", "item")), "leak-items")

    def item_seeds(batches):
        for batch in batches:
            ik, size, seed = [], [], []
            for k, t in zip(batch.column("ik").to_pylist(), column_texts(batch.column("item"))):
                if own := tokens(t):
                    found = np.unique(grams(token_hashes(own), n := min(least, len(own))))
                    ik.append(np.full(len(found), k))
                    size.append(np.full(len(found), n, np.int32))
                    seed.append(as_long(found))
            if ik:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ik, size, seed)], names=["ik", "size", "seed"])

    seeds = stored(items.select("ik", "item").mapInArrow(item_seeds, "ik long, size int, seed long"), "leak-seeds")
    sizes = sorted(r[0] for r in seeds.select("size").distinct().collect())  # at most `least` rows
    if not sizes:
        discard(items, seeds)
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(SeedFilter(seeds.select("seed").distinct()))

    def scan(batches):
        known = shared.value
        held("decontaminate")  # frees what other operators have left
        for whole in batches:
            for batch in pieces(whole, "text"):
                words = [tokens(t) for t in column_texts(batch.column("text"))]
                counts = np.array([len(w) for w in words], np.int64)
                h, at, key = token_hashes(list(chain.from_iterable(words))), runs(counts), batch.column("dk").to_numpy()
                for size in sizes:
                    n = np.maximum(counts - size + 1, 0)
                    here = ranges(at[:-1], n)
                    seed = grams(h, size)[here]
                    hit = np.flatnonzero(known.may_hold(seed))
                    if len(hit):
                        found = np.unique(np.stack([key[np.repeat(np.arange(len(n)), n)[hit]], as_long(seed[hit])], 1), axis=0)
                        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["dk", "seed"])

    hits = stored(docs.select("dk", "text").mapInArrow(scan, "dk long, seed long"), "leak-hits")
    frequency = stored(hits.groupBy("seed").agg(F.count("*").alias("df")).join(seeds.groupBy("seed").agg(F.count("*").alias("n_items")), "seed"), "leak-frequency")
    of_item = spread_join(seeds.select("ik", "seed"), frequency, "seed", "n_items", ["ik"]).groupBy("ik").agg(F.collect_list(F.struct("seed", "df")).alias("seen"))  # no longer than the item

    def keep(batches):
        for batch in batches:
            ik, seed, df = [], [], []
            for k, t, seen in zip(batch.column("ik").to_pylist(), column_texts(batch.column("item")), batch.column("seen").to_pylist()):
                own, known = tokens(t), {x["seed"]: x["df"] for x in seen}
                size = min(least, len(own))
                for s in kept_seeds(as_long(grams(token_hashes(own), size)), size, len(own), known, threshold):
                    ik.append(k)
                    seed.append(s)
                    df.append(known[s])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ik, seed, df)], names=["ik", "seed", "df"])

    kept = stored(items.select("ik", "item").join(of_item, "ik").mapInArrow(keep, "ik long, seed long, df long"), "leak-kept")
    pairs = stored(spread_join(hits, kept, "seed", "df", ["dk"]).select("dk", "ik").distinct(), "leak-pairs")
    asked = stored(items.join(pairs.groupBy("ik").agg(F.count("*").alias("n_docs")), "ik"), "leak-asked")
    listed = pairs.groupBy("dk").agg(F.ceil(F.count("*") / LIST).cast("int").alias("lists"))
    listed = pairs.join(listed, "dk").withColumn("part", F.pmod(F.xxhash64("ik"), F.col("lists")))
    listed = spread_join(listed.select("dk", "part", "ik"), asked, "ik", "n_docs", ["dk"])
    listed = stored(listed.groupBy("dk", "part").agg(F.sort_array(F.collect_list(F.struct("item_id", "item", "copies"))).alias("items")), "leak-lists")
    discard(items, seeds, hits, frequency, kept, pairs, asked)

    def judge(batches):
        held("decontaminate")
        for whole in batches:
            for batch in pieces(whole, "text"):
                row, item, total, covered, tiles = [], [], [], [], []
                for i, (t, wanted) in enumerate(zip(column_texts(batch.column("text")), batch.column("items").to_pylist())):
                    doc = Document(t)
                    for x in wanted:
                        own = tokens(x["item"])
                        found = doc.tiles(own, least, threshold)
                        for _ in range(x["copies"] if found else 0):
                            row.append(i)
                            item.append(x["item_id"])
                            total.append(len(own))
                            covered.append(sum(m for _, _, m in found))
                            tiles.append([{"item_start": q, "doc_start": p, "length": m} for q, p, m in found])
                if row:
                    at = pa.array(row)
                    columns = [batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(item, pa.int64()), pa.array(total, pa.int64()), pa.array(covered, pa.int64()), pa.array([c / n for c, n in zip(covered, total)]), pa.array(tiles, kind)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "item_id", "n_tokens", "n_covered", "coverage", "tiles"])

    perhaps = docs.where(KeyFilter(listed, "dk").may_hold(F.col("dk")))
    return perhaps.join(listed, "dk").select("doc_id", "text_hash", "text", "items").mapInArrow(judge, schema)
