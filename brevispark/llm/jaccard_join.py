"""N-gram Jaccard join by chosen paths.

Documents are sets of word shingles (five words). Documents with equal sets are one class from the start, represented by the
first of them. Sets are split recursively: at a node every set picks some of its tokens, each with probability 1 / (t n) for
threshold t and n tokens, by a hash that depends on node and token alone; two sets that share t of their tokens pick one in
common once on average, and meet in the child that this token names. A node with few sets is compared pair by pair; a larger
one is split again, down to `depth`, where whatever is left is compared in tiles. The whole is repeated with other hashes
until the chance to miss a pair at the threshold is below 1 - recall; more similar pairs are missed far less often.

Before sets travel to their nodes, sketches do (one permutation, 128 bins, a byte each): a set stays in a node only if sizes
and sketches leave room for a partner there. A pair at the threshold is cut by its sketch with a chance below 1e-9.

Nodes with the same sets are compared once, and a pair that meets in several nodes is counted in the least of them, so no
list of pairs is ever made: nodes emit, per set, its number of links and its least linked neighbour's star, and the
components of the stars are the near-duplicate groups. Within a node, pairs are found through the rarest tokens (a pair at
the threshold shares one among its first n - t n + 1) and verified by exact counts. Hot nodes and hot sets are dealt over
several tasks in every join.

Defined cases: a text of one to four words is one shingle of all its words. A text that is null or has no word has no set:
its class is the document alone, without links. Rows with null doc_id have a null class. Rows that share a doc_id are told
apart by a hash of their text; repeated rows are copies. Texts of any length enter whole. Other columns are ignored.
"""

from __future__ import annotations

import math
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeyFilter, as_long, column_bytes, discard, give_back, held, mix, pieces, ranges, runs, spread_join, stored
from .components import components
from .substring_dedup import ROOTS, word_hashes

#: Chance that a pair exactly at the threshold is met at full depth; a more similar one, or one met earlier, is missed far less.
RECALL = 0.9999
#: Sets of a node that are compared at once, and tokens of a tile; neither changes results.
NODE_SETS = 1024
TILE_TOKENS = 2_000_000
#: Sketches compared at once, bins of a sketch, and how many standard deviations a pair at the threshold may fall short.
TILE_SKETCHES = 4096
BINS = 128
DEVIATIONS = 6.5


def repetitions(recall: float, depth: int) -> int:
    """Runs after which a pair exactly at the threshold was met with the given probability, even at full depth."""
    meet = 1.0
    for _ in range(depth):
        meet = 1 - math.exp(-meet)
    return math.ceil(math.log(1 - recall) / math.log(1 - meet))


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text, ascending, one text after the other, and their numbers."""
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    h, at = mix(word_hashes(list(chain.from_iterable(words)))), runs(sizes)
    h = np.concatenate([h, np.zeros(width, np.uint64)])
    gram = np.zeros(len(h) - width, np.uint64)
    for j in range(width):
        part = mix(h + np.uint64((j + 1) * int(ROOTS[1]) % 2**64))
        gram += part[j : len(gram) + j]
    gram = mix(gram)
    out, counts = [], []
    for a, n in zip(at[:-1].tolist(), sizes.tolist()):
        if n >= width:
            own = np.unique(gram[a : a + n - width + 1])
        elif n:
            own = mix(np.array([sum(int(mix(h[a + j : a + j + 1] + np.uint64((j + 1) * int(ROOTS[1]) % 2**64))[0]) for j in range(n)) % 2**64], np.uint64))
        else:
            own = np.zeros(0, np.uint64)
        out.append(own)
        counts.append(len(own))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array(counts, np.int64)


def chance(n: np.ndarray, threshold: float) -> np.ndarray:
    """The picking probability 1 / (t n) as a bound on 64-bit hashes."""
    p = np.minimum(1 / (threshold * np.maximum(n, 1)), 1.0)
    return np.minimum(p * 2.0**64, 2.0**64 - 2048).astype(np.uint64)


def picked(tokens: np.ndarray, node: np.ndarray | np.uint64, bound: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens picked at a node, and the children they name."""
    value = mix(tokens ^ node)
    hit = np.flatnonzero(value <= bound)
    return hit, mix(value[hit] + ROOTS[0])


def roots(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * ROOTS[0])


def sketches(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each set (ascending tokens) and bin a byte of the least token in it, 0 for an empty bin."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = owner * BINS + (tokens >> np.uint64(57)).astype(np.int64)
    first = np.ones(len(place), bool)
    first[1:] = place[1:] != place[:-1]
    out = np.zeros(len(sizes) * BINS, np.uint8)
    out[place[first]] = (mix(tokens[first]) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return out.reshape(-1, BINS)


def with_partner(n: np.ndarray, sketch: np.ndarray, side: np.ndarray, across: bool, threshold: float, step: int = 48) -> np.ndarray:
    """Which sets may have a partner by size and sketch; with `across` one of another side."""
    order = np.argsort(n, kind="stable")
    n, sketch, side = n[order], sketch[order], side[order]
    filled = sketch > 0
    hit = np.zeros(len(n), bool)
    for a in range(0, len(n), step):
        b = min(a + step, len(n))
        end = int(np.searchsorted(n, n[b - 1] / threshold + 1e-9, "right"))
        x, y = slice(a, b), slice(a, end)
        either = (filled[x, None] | filled[None, y]).sum(2, dtype=np.int64)
        equal = ((sketch[x, None] == sketch[None, y]) & filled[x, None]).sum(2, dtype=np.int64)
        good = equal >= threshold * either - DEVIATIONS * np.sqrt(threshold * (1 - threshold) * either)
        good &= n[x, None] >= threshold * n[None, y] - 1e-9
        good &= np.arange(a, b)[:, None] < np.arange(a, end)[None]
        if across:
            good &= side[x, None] != side[None, y]
        hit[x] |= good.any(1)
        hit[y] |= good.any(0)
    out = np.zeros(len(n), bool)
    out[order] = hit
    return out


def linked_pairs(sets: list[np.ndarray], side: np.ndarray, across: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of sets (sorted arrays) with Jaccard similarity >= threshold; with `across` only those of different sides."""
    sizes = np.array([len(s) for s in sets], np.int64)
    token, number, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((number, df[number], owner))  # rarest first within each set
    number = number[order]
    rank = np.arange(len(number)) - np.repeat(runs(sizes)[:-1], sizes)
    prefix = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
    seen = (rank < prefix[owner]) & (df[number] > 1)
    some = np.zeros(len(sets), bool)
    hits = np.bincount(number[seen], minlength=len(token))
    some[owner[seen & (hits[number] > 1)]] = True  # shares a prefix token with another prefix
    posting_order = np.argsort(number, kind="stable")
    posting, start = owner[posting_order], runs(df)
    at = runs(sizes)
    left, right = [], []
    for i in np.flatnonzero(some):
        own = number[at[i] : at[i + 1]]
        own = own[df[own] > 1]
        shared = np.bincount(posting[ranges(start[own], df[own])], minlength=len(sets))
        shared[: i + 1] = 0
        if across:
            shared[side == side[i]] = 0
        j = np.flatnonzero(shared)
        j = j[shared[j] >= threshold * (sizes[i] + sizes[j] - shared[j]) - 1e-9]
        left.append(np.full(len(j), i))
        right.append(j)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(left), join(right)


def stars(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node it is connected with."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, left, label[right])
        np.minimum.at(least, right, label[left])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def near_duplicates(documents: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = RECALL, depth: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns a row per document: doc_id, text_hash, class_id (the least doc_id of its near-duplicate group), class_hash (that
    row's text hash), set_id (the first document with the same shingle set), n_copies (documents with that set), n_links (other
    sets with similarity >= threshold) and n_linked (documents with those sets)."""
    docs = documents.select(F.col(doc_id).cast("bigint").alias("d"), F.hash(F.col(text)).alias("h"), F.col(text).alias("text"))
    known = docs.where("d IS NOT NULL AND text IS NOT NULL")
    n_runs = repetitions(recall, depth)

    def first_level(batches):
        held("jaccard")
        for whole in batches:
            for batch in pieces(whole, "text"):
                tokens, sizes = shingle_sets(column_bytes(batch.column("text")), width)
                at = runs(sizes)
                bound, owner = np.repeat(chance(sizes, threshold), sizes), np.repeat(np.arange(len(sizes)), sizes)
                paths, owners = [], []
                for root in roots(n_runs):
                    hit, child = picked(tokens, root, bound)
                    paths.append(child)
                    owners.append(owner[hit])
                paths, owners = np.concatenate(paths), np.concatenate(owners)
                order = np.argsort(owners, kind="stable")
                lists = pa.ListArray.from_arrays(pa.array(runs(np.bincount(owners, minlength=len(sizes))).astype(np.int32)), pa.array(as_long(paths[order])))
                totals = [np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens ^ c), dtype=np.uint64)]) for c in ROOTS]
                one, two = (as_long(t[at[1:]] - t[at[:-1]]) for t in totals)
                drawn = pa.array([row.tobytes() for row in sketches(tokens, sizes)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("h"), pa.array(one), pa.array(two), pa.array(sizes.astype(np.int32)), lists, drawn], names=["d", "h", "one", "two", "n", "paths", "sketch"])

    sets = stored(known.mapInArrow(first_level, "d long, h int, one long, two long, n int, paths array<bigint>, sketch binary"), "jaccard-sets")
    classes = sets.where("n > 0").groupBy("one", "two").agg(F.min_by(F.struct("d", "h", "n", "paths", "sketch"), F.struct("d", "h")).alias("r"), F.count("*").alias("copies"))
    classes = stored(classes.select("one", "two", "r.*", "copies"), "jaccard-classes")

    nodes = classes.select("d", "h", "n", F.explode("paths").alias("node"))
    met = stored(nodes.groupBy("node").agg(F.count("*").alias("sets")).where("sets > 1"), "jaccard-met")
    level1 = stored(spread_join(nodes, met, "node", "sets", ["d", "h"]).select("node", "d", "h", "n", "sets"), "jaccard-nodes")
    large = level1.where(F.col("sets") > NODE_SETS) if depth > 1 else level1.limit(0)

    def deeper(batches):
        held("jaccard")
        for whole in batches:
            for batch in pieces(whole, "text"):
                tokens, sizes = shingle_sets(column_bytes(batch.column("text")), width)
                at, bounds = runs(sizes), chance(sizes, threshold)
                row, level, parent, children = [], [], [], []
                for i, parents in enumerate(batch.column("large").to_pylist()):
                    own = tokens[at[i] : at[i + 1]]
                    front = np.array(parents, np.int64).view(np.uint64)
                    for number in range(2, depth + 1):
                        found = [(p, kids) for p in front if len(kids := picked(own, p, bounds[i])[1])]
                        row += [i] * len(found)
                        level += [number] * len(found)
                        parent += [p for p, _ in found]
                        children += [kids for _, kids in found]
                        front = np.concatenate([kids for _, kids in found]) if found else front[:0]
                lists = pa.ListArray.from_arrays(pa.array(runs(np.array([len(c) for c in children], np.int64)).astype(np.int32)), pa.array(as_long(np.concatenate(children) if children else np.zeros(0, np.uint64))))
                row = np.array(row, np.int64)
                columns = [batch.column("d").to_numpy()[row], batch.column("h").to_numpy()[row], sizes[row].astype(np.int32), np.array(level, np.int32), as_long(np.array(parent, np.uint64))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], names=["d", "h", "n", "level", "parent", "children"])

    split = stored(large.groupBy("d", "h").agg(F.collect_set("node").alias("large")), "jaccard-split")
    below = stored(known.where(KeyFilter(split, "d", "h").may_hold(F.col("d"), F.col("h"))).join(split, ["d", "h"]).select("d", "h", "text", "large").mapInArrow(deeper, "d long, h int, n int, level int, parent long, children array<bigint>"), "jaccard-below")
    leaves = level1.where(F.col("sets") <= NODE_SETS) if depth > 1 else level1
    open_, used = None, [met, level1, split, below]  # open: nodes of the level before that are split; at level 1 all that `deeper` was given
    for level in range(2, depth + 1):
        rows = below.where(F.col("level") == level)
        if open_ is not None:
            rows = spread_join(rows, open_, "parent", "sets", ["d", "h"]).drop("sets")
        here = stored(rows.select("d", "h", "n", F.explode("children").alias("node")).distinct(), "jaccard-level")
        counted = stored(here.groupBy("node").agg(F.count("*").alias("sets")).where("sets > 1"), "jaccard-met")
        first, here = here, stored(spread_join(here, counted, "node", "sets", ["d", "h"]).select("node", "d", "h", "n", "sets"), "jaccard-nodes")
        leaves = leaves.unionByName(here if level == depth else here.where(F.col("sets") <= NODE_SETS))
        open_ = stored(here.where(F.col("sets") > NODE_SETS).groupBy(F.col("node").alias("parent")).agg(F.count("*").alias("sets")), "jaccard-open")
        used += [first, counted, here, open_]

    leaves = stored(leaves, "jaccard-leaves")
    discard(*used)

    def distinct_nodes(rows: DataFrame) -> DataFrame:
        """Of the nodes with the same two or more sets the least, with its number of sets and tokens."""
        sign = rows.groupBy("node").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens"), F.bit_xor(F.xxhash64("d", "h")).alias("a"), F.bit_xor(F.xxhash64("h", "d", F.lit(1))).alias("b"))
        return sign.where("sets > 1").groupBy("sets", "a", "b").agg(F.min("node").alias("node"), F.first("tokens").alias("tokens"))

    def sift(batches):
        held("jaccard")
        rows, key = [], None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("node", "i", "j", "tile", "d", "h", "n", "sketch"))):
                if row[:3] != key:
                    if len(rows) > 1:
                        yield from sifted(rows)
                    rows, key = [], row[:3]
                rows.append(row)
        if len(rows) > 1:
            yield from sifted(rows)
        del rows
        give_back()

    def sifted(rows):
        n = np.array([r[6] for r in rows], np.int64)
        sketch = np.frombuffer(b"".join([r[7] for r in rows]), np.uint8).reshape(len(rows), BINS)
        hit = np.flatnonzero(with_partner(n, sketch, np.array([r[3] for r in rows]), rows[0][1] != rows[0][2], threshold))
        if len(hit):
            node, d, h = ([rows[i][c] for i in hit] for c in (0, 4, 5))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(d, pa.int64()), pa.array(h, pa.int32()), pa.array(n[hit].astype(np.int32))], names=["node", "d", "h", "n"])

    chosen = stored(distinct_nodes(leaves).select("node", "sets", F.ceil(F.col("sets") / TILE_SKETCHES).cast("int").alias("tiles")), "jaccard-chosen")
    drawn = spread_join(leaves.select("node", "d", "h", "n"), chosen, "node", "sets", ["d", "h"]).drop("sets").join(classes.select("d", "h", "sketch"), ["d", "h"])
    tile = F.pmod(F.xxhash64("d", "h"), F.col("tiles")).cast("int")
    drawn = drawn.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    drawn = drawn.select("node", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "d", "h", "n", "sketch")
    near = stored(drawn.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j").mapInArrow(sift, "node long, d long, h int, n int").distinct(), "jaccard-near")
    once = stored(distinct_nodes(near).select("node", "sets", F.ceil(F.col("tokens") / TILE_TOKENS).cast("int").alias("tiles")), "jaccard-once")
    member = spread_join(near.select("node", "d", "h"), once, "node", "sets", ["d", "h"]).groupBy("d", "h").agg(F.sort_array(F.collect_set(F.struct("node", "tiles"))).alias("nodes"))
    member = stored(member.join(classes.select("d", "h", "copies"), ["d", "h"]), "jaccard-members")

    def spread(batches):
        held("jaccard")
        names = ["node", "i", "j", "tile", "d", "h", "copies", "set", "nodes"]
        for whole in batches:
            for batch in pieces(whole, "text"):
                tokens, sizes = shingle_sets(column_bytes(batch.column("text")), width)
                at, out = runs(sizes), []
                for r, (d, h, copies, nodes) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("d", "h", "copies", "nodes")))):
                    own, all_ = tokens[at[r] : at[r + 1]].tobytes(), np.array([x["node"] for x in nodes], np.int64).tobytes()
                    for x in nodes:
                        t = int(mix(np.array([d % 2**64], np.uint64) + np.uint64(h % 2**32))[0]) % x["tiles"]
                        out += [(x["node"], min(t, u), max(t, u), t, d, h, copies, own, all_) for u in range(x["tiles"])]
                for a in range(0, len(out), 256):
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out[a : a + 256]), kinds)], names=names)

    def compare(batches):
        held("jaccard")
        rows, key = [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != key:
                    if len(rows) > 1:
                        yield from links(rows)
                    rows, key = [], row[:3]
                rows.append(row)
        if len(rows) > 1:
            yield from links(rows)
        del rows
        give_back()

    def links(rows):
        rows = [r for _, r in sorted({(r[4], r[5]): r for r in rows}.items())]  # repeated rows are one
        mine = [np.frombuffer(r[7], np.uint64) for r in rows]
        left, right = linked_pairs(mine, np.array([r[3] for r in rows]), rows[0][1] != rows[0][2], threshold)
        if not len(left):
            return
        nodes, here = [frozenset(np.frombuffer(r[8], np.int64).tolist()) for r in rows], rows[0][0]
        single = [len(x) == 1 for x in nodes]
        owned = np.array([single[i] or single[j] or min(nodes[i] & nodes[j]) == here for i, j in zip(left.tolist(), right.tolist())], bool)
        copies, n = np.array([r[6] for r in rows], np.int64), len(rows)
        a, b = left[owned], right[owned]
        count = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        docs = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
        star = stars(n, left, right)
        hit = np.flatnonzero(np.bincount(left, minlength=n) + np.bincount(right, minlength=n))
        d, h = np.array([r[4] for r in rows], np.int64), np.array([r[5] for r in rows], np.int32)
        columns = [d[hit], h[hit], d[star[hit]], h[star[hit]], count[hit], docs[hit].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["d", "h", "to_d", "to_h", "n_links", "n_linked"])

    spread_rows = known.where(KeyFilter(member, "d", "h").may_hold(F.col("d"), F.col("h"))).join(member, ["d", "h"]).select("d", "h", "text", "copies", "nodes").mapInArrow(spread, "node long, i int, j int, tile int, d long, h int, copies long, set binary, nodes binary")
    found = stored(spread_rows.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j").mapInArrow(compare, "d long, h int, to_d long, to_h int, n_links long, n_linked long"), "jaccard-links")
    discard(leaves, chosen, near, once, member)

    grouped = components(found.select(F.struct("d", "h").alias("u"), F.struct(F.col("to_d").alias("d"), F.col("to_h").alias("h")).alias("v")))
    grouped = grouped.select(F.col("u.d").alias("d"), F.col("u.h").alias("h"), F.col("v.d").alias("class_id"), F.col("v.h").alias("class_hash"))
    totals = found.groupBy("d", "h").agg(F.sum("n_links").alias("n_links"), F.sum("n_linked").alias("n_linked"))
    facts = classes.select("one", "two", "d", "h", "copies").join(grouped, ["d", "h"], "left").join(totals, ["d", "h"], "left")
    facts = facts.select("one", "two", F.col("d").alias("set_id"), F.coalesce("class_id", "d").alias("class_id"), F.coalesce("class_hash", "h").alias("class_hash"), F.col("copies").alias("n_copies"), "n_links", "n_linked")
    facts = stored(facts, "jaccard-facts")
    discard(classes, found)
    with_set = spread_join(sets.where("n > 0").select("d", "h", "one", "two"), facts, ["one", "two"], "n_copies", ["d", "h"])
    bare = sets.where("n = 0").select("d", "h").unionByName(docs.where("d IS NULL OR text IS NULL").select("d", "h"))
    none = bare.select("d", "h", F.col("d").alias("set_id"), F.col("d").alias("class_id"), F.col("h").alias("class_hash"), F.lit(1).cast("bigint").alias("n_copies"), F.lit(0).cast("bigint").alias("n_links"), F.lit(0).cast("bigint").alias("n_linked"))
    out = with_set.select(*none.columns).unionByName(none)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(F.col("d").alias("doc_id"), F.col("h").alias("text_hash"), "class_id", "class_hash", "set_id", "n_copies", zero("n_links"), zero("n_linked"))
