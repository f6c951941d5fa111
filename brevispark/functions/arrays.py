"""Sequences: subsequence embedding from either side, survival masks, subsets of units."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def embed_left(small: list, big: list) -> list[int] | None:
    """Earliest positions of small as a subsequence of big, or None."""
    out, at = [], -1
    try:
        for want in small:
            out.append(at := big.index(want, at + 1))
    except ValueError:
        return None
    return out


def embed_right(small: list, big: list) -> list[int] | None:
    """Latest positions."""
    found = embed_left(small[::-1], big[::-1])
    return None if found is None else [len(big) - 1 - i for i in reversed(found)]


#: Runs of up to so many members are found for all rows at once, level by level; longer ones in what is left of a row.
LONGEST_LEVEL = 32
#: Members of both lists that are aligned at once.
PIECE = 1 << 17


def embed_blocks(small: Sequence[int], big: Sequence[int]) -> list[int]:
    """Places of small's members in big by matching blocks, for sequences that are no subsequence: the longest common run (the earliest of
    equal ones in small, then in big), then the same on either side of it. Members without a place are left out."""
    return np.flatnonzero(embed_blocks_each([small], [big])).tolist()


def embed_blocks_each(smalls: Sequence[Sequence[int]], bigs: Sequence[Sequence[int]], longest: int = LONGEST_LEVEL) -> np.ndarray:
    """The same for many rows at once: a mask of the bigs' members, one row behind the other. Members are numbers from -1.

    Levels go from long runs to short ones. At a level, what is left of a row has no longer common run, so its runs of this length are
    taken from left to right, each at the first place behind the one before; what lies between them is left to the next level. A member
    of small is looked up once a level at most, whatever the number of blocks."""
    levels, rows = _levels(smalls, bigs, longest)
    at_small, at_big = _starts(smalls), _starts(bigs)
    left = [[(a, b, c, d)] for a, b, c, d in zip(at_small[:-1].tolist(), at_small[1:].tolist(), at_big[:-1].tolist(), at_big[1:].tolist())]
    blocks: list[tuple[int, int]] = []
    for row in rows:
        left[row] = _long_blocks(smalls[row], bigs[row], left[row][0], longest, blocks)
    for size in range(len(levels), 0, -1):
        at, *found = levels.pop()
        row, first = np.unique(np.searchsorted(at_small, at, "right") - 1, return_index=True)
        lists = [x.tolist() for x in (at, *found)]
        for k, start, end in zip(row.tolist(), first.tolist(), [*first[1:].tolist(), len(at)]):
            left[k] = _blocks_of_size(size, left[k], *lists, start, end, blocks)
    mask = np.zeros(at_big[-1], bool)
    if blocks:
        start, n = np.array(blocks).T
        mask[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())] = True
    return mask


def _starts(lists: Sequence[Sequence]) -> np.ndarray:
    """Where each list begins if they stand one behind the other, and where the last one ends."""
    return np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)


def _levels(smalls: Sequence[Sequence[int]], bigs: Sequence[Sequence[int]], longest: int) -> tuple[list[tuple[np.ndarray, ...]], list[int]]:
    """For runs of 1, 2, .. members: where small has one that its big has too, ascending, and from where to where in a list of places in big
    it stands there, ascending too; and the rows that have longer common runs than the last level's."""
    n = np.array([len(x) for x in (*smalls, *bigs)], np.int64)
    many = int(n[: len(smalls)].sum())  # first all smalls, then all bigs
    row = np.repeat(np.tile(np.arange(len(smalls)), 2), n)
    room = np.repeat(np.cumsum(n), n) - np.arange(len(row))  # members up to the end of the own list
    key = np.fromiter(chain.from_iterable((*smalls, *bigs)), np.int64, len(row)) + 1
    key += row * (key.max(initial=0) + 1)
    at, run = np.arange(len(row)), np.full(len(row) + 1, -1)
    levels: list[tuple[np.ndarray, ...]] = []
    while True:
        at, which = _common(at, key, many)
        if not len(at) or len(levels) == longest:
            return levels, np.unique(row[at]).tolist()
        levels.append(_found(at, which, many))
        run[:] = -1
        run[at] = which
        at = at[room[at] > len(levels)]
        at = at[run[at + 1] >= 0]
        key = run[at] * (which.max(initial=0) + 1) + run[at + 1]  # two runs that overlap make the longer one


def _common(at: np.ndarray, key: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the places whose key stands below `many` and from there on too, and their keys, numbered."""
    which = np.unique(key, return_inverse=True)[1]
    cut = int(np.searchsorted(at, many))
    here, there = (np.bincount(x, minlength=which.max(initial=-1) + 1) for x in (which[:cut], which[cut:]))
    common = ((here > 0) & (there > 0))[which]
    return at[common], which[common]


def _found(at: np.ndarray, which: np.ndarray, many: int) -> tuple[np.ndarray, ...]:
    """A level, as of `_levels`, of places of common runs and their numbers."""
    cut = int(np.searchsorted(at, many))
    n = np.bincount(which[cut:])
    to = np.cumsum(n)
    places = at[cut:][np.argsort(which[cut:], kind="stable")] - many
    return tuple(x.astype(np.int32) for x in (at[:cut], (to - n)[which[:cut]], to[which[:cut]], places))


def _longest(small: np.ndarray, big: np.ndarray) -> tuple[int, tuple[np.ndarray, ...]]:
    """The length of the longest run that both have, and the level of that length: runs are doubled while there are common ones, then made
    longer by the powers of two below. Work goes with the members and the logarithm of the length."""
    many, n = len(small), len(small) + len(big)
    room = np.concatenate([np.arange(many, 0, -1), np.arange(len(big), 0, -1)])

    def longer(at, run, size, tail, more):
        at = at[room[at] >= size + more]
        at = at[tail[at + size] >= 0]
        at, which = _common(at, run[at] * (n + 1) + tail[at + size], many)
        run = np.full(n, -1)
        run[at] = which
        return at, run

    at, which = _common(np.arange(n), np.concatenate([small, big]), many)
    run = np.full(n, -1)
    run[at] = which
    powers, last, size = [], (at, run), 0
    while len(last[0]):
        powers.append(last)
        size = 1 << (len(powers) - 1)
        last = longer(*last, size, last[1], size)
    if not powers:
        return 0, ()
    at, run = powers.pop()
    while powers:
        more = 1 << (len(powers) - 1)
        last = longer(at, run, size, powers.pop()[1], more)
        if len(last[0]):
            (at, run), size = last, size + more
    return size, _found(at, run[at], many)


def _blocks_of_size(size: int, left: list, at: list, low: list, high: list, places: list, k: int, end: int, blocks: list) -> list:
    """Takes the runs of a size from what is left of a row, of which at[k:end] are candidates; returns what is left then."""
    out = []
    for a, b, c, d in left:
        while k < end and (i := at[k]) + size <= b:
            if i >= a:
                found = bisect_left(places, c, low[k], high[k])
                if found < high[k] and (j := places[found]) + size <= d:
                    blocks.append((j, size))
                    if i > a and j > c:
                        out.append((a, i, c, j))
                    a, c = i + size, j + size
            k += 1
        if a < b and c < d:
            out.append((a, b, c, d))
    return out


def _long_blocks(small: Sequence[int], big: Sequence[int], whole: tuple[int, int, int, int], longest: int, blocks: list) -> list:
    """The same for all runs of more than so many members: all longest ones of what is left at once, then those of each part that is left."""
    out, todo, (from_small, _, from_big, _) = [], [whole], whole
    small, big = np.array(small, np.int64), np.array(big, np.int64)
    while todo:
        a, b, c, d = todo.pop()
        size, level = _longest(small[a - from_small : b - from_small], big[c - from_big : d - from_big]) if min(b - a, d - c) > longest else (0, ())
        if size > longest:
            taken: list[tuple[int, int]] = []
            parts = _blocks_of_size(size, [(0, b - a, 0, d - c)], *[x.tolist() for x in level], 0, len(level[0]), taken)
            blocks += [(c + j, size) for j, _ in taken]
            todo += [(a + i, a + j, c + k, c + m) for i, j, k, m in parts]
        elif a < b and c < d:
            out.append((a, b, c, d))
    return sorted(out)


def _align(smalls: list[list], bigs: list[list]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Both masks, the rows one behind the other, and by row: whether small is a subsequence, how many places differ, how many of its
    members have no place, and how many places live in either mask."""
    start = _starts(bigs)
    found = [embed_left(a, b) for a, b in zip(smalls, bigs)]
    fits = np.array([x is not None for x in found], bool)
    masks = np.zeros((2, start[-1]), bool)
    odd = np.flatnonzero(~fits)
    masks[:, np.repeat(~fits, np.diff(start))] = embed_blocks_each([smalls[k] for k in odd], [bigs[k] for k in odd])
    for k in np.flatnonzero(fits):
        own = masks[:, start[k] : start[k + 1]]
        own[0, found[k]] = True
        own[1, embed_right(smalls[k], bigs[k])] = True
    left, right, apart = (np.diff(np.concatenate([[0], np.cumsum(m)])[start]) for m in (*masks, masks[0] != masks[1]))
    return masks, [fits, apart // 2, np.where(fits, 0, np.diff(_starts(smalls)) - left), left, right]


def _pieces(batch: pa.RecordBatch, *names: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, so many at once that these columns' lists have not many more members than PIECE, whatever a row's length."""
    n = sum(batch.column(batch.schema.get_field_index(x)).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in names)
    piece = np.cumsum(n) // PIECE
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(n)]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


ALIGNED = "left array<boolean>, right array<boolean>, is_subsequence int, n_ambiguous int, n_unassigned int, n_left int, n_right int"


def _codes(batch: pa.RecordBatch, *names: str) -> list[list[list[int]]]:
    """List columns with their members as numbers, equal ones alike; null lists are empty."""
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    flat = pa.concat_arrays([c.flatten() for c in columns]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).tolist()
    out, at = [], 0
    for c in columns:
        lists = []
        for n in c.value_lengths().fill_null(0).to_pylist():
            lists.append(flat[at : at + n])
            at += n
        out.append(lists)
    return out


def align(df: DataFrame, small: Column, big: Column, keep: tuple[str, ...]) -> DataFrame:
    """keep, and the survival masks of big under small, resolved to the left and to the right, with how far they differ and how
    many places live. Linear in the texts; block matching, of many rows at once, only where small is no subsequence. Null sequences
    count as empty."""
    taken = df.select(*keep, small.alias("_small"), big.alias("_big"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema.fields[:-2])

    def run(batches):
        for piece in (p for batch in batches for p in _pieces(batch, "_small", "_big")):
            smalls, bigs = _codes(piece, "_small", "_big")
            masks, counts = _align(smalls, bigs)
            at = pa.array(_starts(bigs).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(m)) for m in masks]
            names = [*piece.schema.names[:-2], *(f.split()[0] for f in ALIGNED.split(", "))]
            yield pa.RecordBatch.from_arrays([*piece.columns[:-2], *lists, *(pa.array(c.astype(np.int32)) for c in counts)], names=names)

    return taken.mapInArrow(run, f"{fields}, {ALIGNED}")


def embed_left_fold(small: Column, big: Column) -> Column:
    """The left mask by a fold of built-in functions; quadratic in the text, kept as a cross-check of `align`."""
    start = F.struct(F.lit(1).alias("k"), F.array().cast("array<boolean>").alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        hit = F.coalesce(F.try_element_at(small, acc["k"]) == x, F.lit(False))
        return F.struct((acc["k"] + hit.cast("int")).alias("k"), F.array_append(acc["hit"], hit).alias("hit"))

    return F.aggregate(big, start, step)["hit"]


def with_starts(df: DataFrame, own: Column, gaps: Column, name: str) -> DataFrame:
    """Adds where each member of a list begins (from 0), from the members' lengths and what lies in front of each: running sums, for all
    lists of a batch at once. Null lists are empty; the two lists of a row are of one length."""
    made = df.select("*", own.cast("array<bigint>").alias("_own"), gaps.cast("array<bigint>").alias("_gaps"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches):
        for batch in batches:
            own, gaps = batch.columns[-2:]
            n = own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            size, gap = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (own, gaps))
            ends = np.cumsum(n)
            total = np.concatenate([[0], np.cumsum(size + gap)])
            start = total[1:] - size - np.repeat(total[ends - n], n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(start))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], lists], names=[*batch.schema.names[:-2], name])

    return made.mapInArrow(run, f"{fields}, `{name}` array<bigint>")


def with_runs(df: DataFrame, points: tuple[Column, Column], intervals: tuple[Column, Column], name: str) -> DataFrame:
    """Adds which of a row's points lie in each of its intervals, as array<struct<first int,n int>> (first: place of the first one, from 0).
    Points and intervals are each given by lengths and what lies in front of each, as in `with_starts`, so that they ascend and those of
    an interval are a run. All rows of a batch are searched at once; nothing is shuffled. Null lists are empty."""
    lists = [*points, *intervals]
    made = df.select("*", *[c.cast("array<bigint>").alias(f"_list{i}") for i, c in enumerate(lists)])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def places(own, gaps):
        """Number of members, starts and ends of all rows' lists."""
        n = own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        size, gap = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (own, gaps))
        total = np.concatenate([[0], np.cumsum(size + gap)])
        start = total[1:] - size - np.repeat(total[np.cumsum(n) - n], n)
        return n, start, start + size

    def run(batches):
        for batch in batches:
            n, at, _ = places(*batch.columns[-4:-2])
            m, start, end = places(*batch.columns[-2:])
            apart = max(at.max(initial=0), end.max(initial=0)) + 1  # rows one behind the other on one line
            line = at + np.repeat(np.arange(len(n)) * apart, n)
            shift = np.repeat(np.arange(len(m)) * apart, m)
            first, last = np.searchsorted(line, start + shift), np.searchsorted(line, end + shift)
            found = pa.StructArray.from_arrays([pa.array((first - np.repeat(np.cumsum(n) - n, m)).astype(np.int32)), pa.array((last - first).astype(np.int32))], names=["first", "n"])
            runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(m)]).astype(np.int32)), found)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], runs], names=[*batch.schema.names[:-4], name])

    return made.mapInArrow(run, f"{fields}, `{name}` array<struct<first:int,n:int>>")


def subsets(n: int, most: int) -> Column:
    """All subsets of 0 .. n-1 with one to `most` members, each ascending, as array<array<int>>; for small n only."""
    units = lambda mask: F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(mask, i) == 1)
    masks = F.filter(F.sequence(F.lit(1).cast("bigint"), F.lit((1 << n) - 1).cast("bigint")), lambda m: F.bit_count(m) <= most)
    return F.transform(masks, units)


def ordered_pairs(n: int) -> Column:
    """All ordered pairs of different units."""
    one = F.sequence(F.lit(0), F.lit(n - 1))
    return F.filter(F.flatten(F.transform(one, lambda i: F.transform(one, lambda j: F.array(i, j)))), lambda p: p[0] != p[1])
