"""Exact substring deduplication by super-k-mers.

A window is k consecutive words of one document. Every word covered by a window whose word sequence also starts in a
document with a smaller id goes. Equal windows have the same minimiser, the least hash among their m-grams, so consecutive
windows with one minimiser travel together as a super-k-mer, a packed string, to the bucket of that minimiser.

1. Documents give their super-k-mers as (minimiser, digest of the packed words, place). Minimisers seen in one document only
   cannot hold a repeat; the rest stay. Hot minimisers and strings are dealt over several tasks in every join.
2. Equal packed strings are one row with their first document (summed before they are shuffled, so thousands of copies are
   one row). A bucket with a single string needs no comparison; for others the strings themselves are fetched.
3. Buckets are sorted window by window: words become numbers, and ranks of 1, 2, 4, ... words are combined until k, so
   windows are compared exactly. Each window's least document id is the bucket's answer.
4. Buckets whose different strings hold more than `most` words (a passage common to a large part of the corpus) do not fit one
   task: their windows, as words, are sorted and counted over the whole cluster instead. Windows are compared exactly in both
   cases, and no bucket is capped or sampled.
5. Answers go back to all places of a string; documents drop the words covered.

Packed strings with equal 64-bit minimiser and equal 128-bit digest (of the words' hashes, in order) count as equal; windows are
compared word by word.

Defined cases: a null text has no words. Rows with null doc_id keep all their words and are no source of repeats. Rows that
share a doc_id never remove each other's words. Documents shorter than k words keep everything. Other columns are ignored.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_long, column_bytes, discard, mix, pieces, ranges, runs, spread_join, stored

#: Windows of one super-k-mer at most; longer runs (a word repeated for pages) are split, which changes no result.
LONGEST = 1024
ROOTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))
#: Words compared at a time in a bucket task.
WORDS_AT_ONCE = 400_000


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    """64-bit hashes of words."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words) if seed else map(digest, words), np.uint64, len(words))


def span_digests(h: np.ndarray, start: np.ndarray, end: np.ndarray, root: np.uint64) -> np.ndarray:
    """A 64-bit digest of each span of hashes, the same wherever the span stands."""
    inverse = np.uint64(pow(int(root), -1, 1 << 64))
    up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(h), root, np.uint64)]))
    down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(h), inverse, np.uint64)]))
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h) * up[:-1], dtype=np.uint64)])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def super_kmers(h: np.ndarray, sizes: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of word hashes of several documents: the document, first window, number of windows and minimiser of each super-k-mer."""
    none = np.zeros(0, np.int64)
    at = runs(sizes)
    doc = np.repeat(np.arange(len(sizes)), np.maximum(sizes - k + 1, 0))
    if not len(doc):
        return none, none, none, none.astype(np.uint64)
    gram = np.zeros(len(h) - m + 1, np.uint64)
    for j in range(m):
        gram += mix(h[j : len(h) - m + 1 + j] + np.uint64((j + 1) * int(ROOTS[1]) % 2**64))
    gram = mix(gram)
    width, have = k - m + 1, 1
    while 2 * have <= width:
        gram = np.minimum(gram[:-have], gram[have:])
        have *= 2
    if have < width:
        gram = np.minimum(gram[: len(gram) - (width - have)], gram[width - have :])
    window = ranges(at[:-1], np.maximum(sizes - k + 1, 0))
    least = gram[window]
    new = np.ones(len(window), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(window)))
    parts = -(-count // LONGEST)  # long runs in equal steps
    step = ranges(np.zeros(len(parts), np.int64), parts) * LONGEST
    first = np.repeat(first, parts) + step
    count = np.minimum(np.repeat(count, parts) - step, LONGEST)
    return doc[first], window[first] - at[doc[first]], count, least[first]


def window_classes(words: list[bytes], sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For strings of words, one after the other: the positions of their windows and a number that equal windows share."""
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    position = np.arange(len(words))
    left = np.repeat(runs(sizes)[1:], sizes) - position  # words up to the end of the string
    have = 1
    while have < k:
        step = min(have, k - have)  # ranks of `have` words that stand `step` apart give ranks of have + step words
        full = np.zeros(len(words), np.int64)
        full[position] = rank
        keep = left >= have + step
        position, left = position[keep], left[keep]
        rank = np.unique(full[position] * (rank.max(initial=0) + 1) + full[position + step], return_inverse=True)[1]
        have += step
    return position, rank


def _answers(rows: list[tuple[int, int, int, int, bytes]], k: int) -> pa.RecordBatch:
    """Bucket rows (minimiser, digest in two halves, first document, packed words): the least document of each window, as runs."""
    words = [r[4].split() for r in rows]
    sizes = np.array([len(w) for w in words], np.int64)
    position, number = window_classes(list(chain.from_iterable(words)), sizes, k)
    row = np.repeat(np.arange(len(rows)), np.maximum(sizes - k + 1, 0))
    doc = np.array([r[3] for r in rows], np.int64)[row]
    least = np.full(int(number.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, number, doc)
    least = least[number]
    offset = position - runs(sizes)[row]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    kind = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("doc", pa.int64())])
    spans = pa.StructArray.from_arrays([pa.array(offset[first].astype(np.int32)), pa.array((offset[last] + 1).astype(np.int32)), pa.array(least[first])], fields=list(kind))
    lists = pa.ListArray.from_arrays(pa.array(runs(np.bincount(row[first], minlength=len(rows))).astype(np.int32)), spans)
    return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), lists], names=[*STRING, "runs"])


#: What tells packed strings apart: the minimiser and the two halves of their digest.
STRING = ["mkey", "pid", "pid2"]
RUNS = "mkey long, pid long, pid2 long, runs array<struct<a:int,b:int,doc:bigint>>"


def covered_ranges(documents: DataFrame, k: int = 50, m: int = 6, most: int = 1_000_000, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents as (doc_id, text_hash, text), and the word ranges to drop as (doc_id, text_hash, ranges array<struct<a,b>>)."""
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.hash(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")

    def cut(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                words = [t.split() for t in column_bytes(batch.column("text"))]
                sizes = np.array([len(w) for w in words], np.int64)
                h = word_hashes(list(chain.from_iterable(words)))
                doc, start, n, least = super_kmers(h, sizes, k, m)
                begin = runs(sizes)[doc] + start
                pid, pid2 = (span_digests(mix(h + r), begin, begin + n + k - 1, r) for r in ROOTS)
                columns = [as_long(least), as_long(pid), as_long(pid2), batch.column("doc_id").to_numpy()[doc], batch.column("text_hash").to_numpy()[doc], (start << 16) + n]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*STRING, "doc_id", "text_hash", "place"])

    places = stored(known.mapInArrow(cut, "mkey long, pid long, pid2 long, doc_id long, text_hash int, place long"), "kmers")
    repeated = stored(places.groupBy("mkey").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("places")).where("lo < hi").select("mkey", "places"), "kmers-repeated")
    shared = stored(spread_join(places, repeated, "mkey", "places", ["doc_id", "place"]).drop("places"), "kmers-shared")
    strings = stored(shared.groupBy(*STRING).agg(F.min(F.struct("doc_id", "text_hash", "place")).alias("first"), F.count("*").alias("copies")), "kmer-first")
    buckets = stored(strings.groupBy("mkey").agg(F.count("*").alias("texts"), F.sum(F.col("first.place").bitwiseAND(0xFFFF) + (k - 1)).alias("words")), "kmer-buckets")
    first, strings = strings, stored(spread_join(strings, buckets, "mkey", "texts", ["pid"]).select(*STRING, "first.*", "copies", "texts", "words"), "kmer-strings")
    discard(places, repeated, first, buckets)
    whole = lambda rows: rows.select(*STRING, F.array(F.struct(F.lit(0).alias("a"), F.col("place").bitwiseAND(0xFFFF).cast("int").alias("b"), F.col("doc_id").alias("doc"))).alias("runs"))
    alone = whole(strings.where("texts = 1"))

    wanted = strings.where("texts > 1").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct(*STRING, "place", "words")).alias("wanted"))
    fetch = known.join(wanted, ["doc_id", "text_hash"])

    def pack(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                out: list[tuple] = []
                for d, t, want in zip(batch.column("doc_id").to_pylist(), column_bytes(batch.column("text")), batch.column("wanted").to_pylist()):
                    words = t.split()
                    for w in want:
                        a, n = w["place"] >> 16, w["place"] & 0xFFFF
                        out.append((*(w[c] for c in STRING), d, w["words"], b" ".join(words[a : a + n + k - 1])))
                kinds = (*[pa.int64()] * 5, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), x) for c, x in zip(zip(*out) if out else [()] * 6, kinds)], names=[*STRING, "doc_id", "words", "packed"])

    packed = stored(fetch.select("doc_id", "text", "wanted").mapInArrow(pack, "mkey long, pid long, pid2 long, doc_id long, words long, packed binary"), "kmer-packed")

    def sort(batches):
        rows, held = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*STRING, "doc_id", "packed"))):
                if held > WORDS_AT_ONCE and row[0] != rows[-1][0]:  # only whole buckets
                    yield _answers(rows, k)
                    rows, held = [], 0
                rows.append(row)
                held += row[4].count(b" ") + 1
        if rows:
            yield _answers(rows, k)

    small = packed.where(F.col("words") <= most).repartition("mkey").sortWithinPartitions("mkey").mapInArrow(sort, RUNS)

    def explode(batches):
        for batch in batches:
            for part in pieces(batch, "packed", 1 << 16):  # a window is some fifty times a word
                words = [p.split() for p in part.column("packed").to_pylist()]
                n = np.maximum(np.array([len(w) for w in words], np.int64) - k + 1, 0)
                row = np.repeat(np.arange(len(n)), n)
                windows = [b" ".join(w[i : i + k]) for w, m in zip(words, n.tolist()) for i in range(m)]
                columns = [pa.array(windows, pa.binary()), *(pa.array(part.column(c).to_numpy()[row]) for c in (*STRING, "doc_id")), pa.array(ranges(np.zeros(len(n), np.int64), n).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["window", *STRING, "doc_id", "a"])

    large = packed.where(F.col("words") > most).repartition("pid")  # few strings may carry many windows: dealt evenly
    windows = large.mapInArrow(explode, "window binary, mkey long, pid long, pid2 long, doc_id long, a int")
    least = windows.groupBy("window").agg(F.min("doc_id").alias("doc"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("doc < hi").select("window", "doc", "n")
    least = stored(least, "kmer-windows")
    beaten = spread_join(windows, least, "window", "n", ["pid", "a"]).where("doc < doc_id").groupBy(*STRING).agg(F.collect_list(F.struct("a", (F.col("a") + 1).alias("b"), "doc")).alias("runs"))

    answers = alone.unionByName(small).unionByName(whole(strings.where((F.col("words") > most) & (F.col("texts") > 1)))).unionByName(beaten)
    answers = stored(answers.join(strings.select(*STRING, "copies"), STRING), "kmer-answers")
    start = F.shiftright("place", 16)
    earlier = F.filter("runs", lambda r: r["doc"] < F.col("doc_id"))
    span = lambda r: F.struct((start + r["a"]).cast("int").alias("a"), (start + r["b"] + (k - 1)).cast("int").alias("b"))
    hit = spread_join(shared, answers, STRING, "copies", ["doc_id", "place"]).select("doc_id", "text_hash", F.transform(earlier, span).alias("ranges")).where(F.size("ranges") > 0)
    spans = stored(hit.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("ranges")).alias("ranges")), "kmer-ranges")
    discard(shared, strings, packed, least, answers)
    return docs, spans


def remove_repeats(documents: DataFrame, k: int = 50, m: int = 6, most: int = 1_000_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns a row per document: doc_id, n_words, n_removed, `kept` (the words left, joined by one space) and `removed`
    (the dropped word ranges, merged, as array<struct<a,b>>, end exclusive)."""
    docs, spans = covered_ranges(documents, k, m, most, doc_id, text)
    known = F.col("doc_id").isNotNull() & F.col("text").isNotNull()  # the others would all meet in one task
    joined = docs.where(known).join(spans, ["doc_id", "text_hash"], "left").select("doc_id", "text", "ranges")
    joined = joined.unionByName(docs.where(~known).select("doc_id", "text", F.lit(None).cast(spans.schema["ranges"].dataType).alias("ranges")))
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def drop(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                total, gone, kept, merged = [], [], [], []
                for t, spans in zip(column_bytes(batch.column("text")), batch.column("ranges").to_pylist()):
                    words = t.split() if t else []
                    parts, left, at = [], [], 0
                    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                        if parts and a <= parts[-1]["b"]:
                            parts[-1]["b"] = max(parts[-1]["b"], b)
                        else:
                            parts.append({"a": a, "b": b})
                    for s in parts:
                        left += words[at : s["a"]]
                        at = s["b"]
                    left += words[at:]
                    total.append(len(words))
                    gone.append(len(words) - len(left))
                    kept.append(b" ".join(left).decode("utf-8", "replace"))
                    merged.append(parts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(merged, kind)], names=["doc_id", "n_words", "n_removed", "kept", "removed"])

    return joined.mapInArrow(drop, "doc_id long, n_words long, n_removed long, kept string, removed array<struct<a:int,b:int>>")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
