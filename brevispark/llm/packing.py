"""Packing of tokenised documents into sequences of a fixed length, by bin completion.

Texts are tokenised in batches: a byte-level tokenizer never joins what lies on both sides of a space that follows a character that is no
white space, so texts are cut there and each different word is encoded once a worker. Documents longer than a sequence are cut from their
end, so that only the first piece may be shorter than a sequence.

How pieces combine depends on their lengths alone. Spark counts the pieces of each length (fewer counts than a sequence has tokens, however
many documents there are), the driver packs the counts, and a table of what each length's pieces are dealt to, bounded in the same way,
goes back to the workers. A piece finds its place by its rank among the pieces of its length: its number within its task, plus the
pieces of that length in the tasks before it. Full pieces are sequences of their own and are never moved.

The counts are packed by bin completion, a branch and bound: take the largest piece that is left, enumerate fillings of the rest of its
sequence that no other filling dominates (one dominates another if the other's pieces fit into its own pieces), fullest first, apply one as
often as the counts allow (then less often), and go on. A branch ends when its waste leaves no way to use fewer sequences than the best
solution so far, which is the best-fit solution at first. Since a search over everything would only ever vary its last steps, it is
repeated over parts of the best solution: the sequences that waste most and some others. It ends when a lower bound is met, or after a
number of rounds; the work on the driver is bounded by the capacity and the rounds, not by the documents.

Defined cases: a null text counts as empty; an empty text is its end id alone. Bytes that are not UTF-8 count as U+FFFD. Texts of any
length are encoded whole. Repeated rows and ids are packed one by one, rows with null ids too. Names of special tokens inside a text
become these tokens, as the tokenizer has it. Without documents the result is empty. Columns are carried along only when named.
"""

from __future__ import annotations

import hashlib
import json
import os
import random
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, column_texts, fields_of, held, pieces, stored

#: A space that follows no white space, and white space before a space (without any, every space is such a place).
CUT, ODD = re.compile(r"(?<=\S) "), re.compile(r"\s ")
#: Words that are encoded many at a time, and words that are remembered (the memory empties itself when full).
PLAIN, LONG_WORD, MOST_WORDS = re.compile(r"[!-~\u00a1-\u024f][!-~\u00a1-\u024f\n]{0,255}"), 48, 300_000
# Fixed value: how byte-level tokenizers with a pattern of their own cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_ranks(model: dict) -> dict[bytes, int] | None:
    """A byte-level vocabulary as bytes with their ids, if merges come in the order of ids (then an id is a rank); else None."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocab[a + b] for a, b in merges]
    known = {t for t in vocab if len(t) == 1} | {a + b for a, b in merges}
    if model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or any(x >= y for x, y in zip(made, made[1:])) or not all(set(t) <= byte.keys() for t in known):
        return None
    return {bytes(byte[c] for c in t): vocab[t] for t in known}


class Words:
    """A tokenizer that encodes texts word by word. spec: the text of its JSON file.

    New words of common letters are encoded in one go, by the tokenizer's own ranks, in a text of these words: it comes apart again at the
    ids that begin with a space. All others go through the tokenizer itself."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        self.tokenizer = Tokenizer.from_str(spec)
        told = json.loads(spec)
        before, added = told.get("pre_tokenizer") or {}, told.get("added_tokens") or []
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.cuts = plain and not told.get("normalizer") and not told.get("truncation") and not told.get("padding") and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"]) for a in added)
        ranks = byte_ranks(told["model"]) if self.cuts else None
        self.added = re.compile("|".join(re.escape(a["content"]) for a in added)) if added else None
        self.many = None
        if ranks:
            self.many = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.begins = np.zeros(max(ranks.values()) + 1, bool)
            self.begins[[i for b, i in ranks.items() if b[:1] == b" "]] = True
        self.first: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def ids(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of texts, as they are encoded without special tokens, in little-endian unsigned 32-bit integers."""
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(e.ids, "<u4").tobytes() for e in encode(list(texts), add_special_tokens=False)]

    def together(self, words: list[str]) -> list[bytes]:
        """Ids of plain words, each with a space in front."""
        found = np.array(self.many.encode_ordinary(" " + " ".join(words)), "<u4")
        at = np.flatnonzero(self.begins[found])
        if len(at) != len(words):
            return self.ids([" " + w for w in words])
        data, ends = found.tobytes(), (4 * np.append(at, len(found))).tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def learn(self, known: dict[str, bytes], words: set[str], lead: str) -> dict[str, bytes]:
        """Adds the words that are not known; those that are too long to remember come back."""
        new = [w for w in words if w not in known]
        plain = [w for w in new if PLAIN.fullmatch(w) and not (self.added and self.added.search(w))] if self.many and lead else []
        others = list(set(new).difference(plain)) if len(plain) < len(new) else []
        if plain:
            known.update(zip(plain, self.together(plain)))
        found = dict(zip(others, self.ids([lead + w for w in others])))
        known.update((w, b) for w, b in found.items() if len(w) <= LONG_WORD)
        return {w: b for w, b in found.items() if len(w) > LONG_WORD}

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        if not self.cuts:
            return self.ids(texts)
        if len(self.first) + len(self.spaced) > MOST_WORDS:
            self.first.clear()
            self.spaced.clear()
        split = [CUT.split(t) if ODD.search(t) else t.split(" ") for t in texts]
        heads = [s.pop(0) for s in split]
        first = self.first | self.learn(self.first, set(heads), "") if heads else {}
        more = self.learn(self.spaced, set().union(*split), " ")
        spaced = self.spaced | more if more else self.spaced
        return [b"".join([first[h], *map(spaced.__getitem__, s)]) for h, s in zip(heads, split)]


# Packing of counts by length. A filling is a dict from length to number.


def least_sequences(counts: Sequence[int], capacity: int) -> int:
    """A lower bound: pieces of over half a sequence can't meet, and those below share what is left beside the ones that have room."""
    c = np.array(counts, object)
    size = np.arange(len(c)).astype(object)
    half = capacity // 2
    best = 0
    for k in range(half + 1):
        alone = int(c[capacity - k + 1 :].sum()) if k else 0
        large = slice(half + 1, capacity - k + 1)
        small = slice(max(k, 1), half + 1)
        room = int(c[large].sum()) * capacity - int((c[large] * size[large]).sum())
        over = int((c[small] * size[small]).sum()) - room
        best = max(best, alone + int(c[large].sum()) + max(0, -(-over // capacity)))
    return best


def best_fit(counts: Sequence[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing: (filling, how many sequences have it)."""
    by_room: dict[int, list[list]] = {}
    for size in range(capacity, 0, -1):
        left = counts[size]
        while left:
            room = min((r for r in by_room if r >= size), default=None)
            if room is None:
                each = capacity // size
                for n, copies in ((each, left // each), (left % each, 1)):
                    if n and copies:
                        by_room.setdefault(capacity - n * size, []).append([{size: n}, copies])
                break
            filling, copies = by_room[room].pop()
            used = min(copies, left)
            if copies > used:
                by_room[room].append([filling, copies - used])
            if not by_room[room]:
                del by_room[room]
            by_room.setdefault(room - size, []).append([filling | {size: filling.get(size, 0) + 1}, used])
            left -= used
    return [(f, n) for groups in by_room.values() for f, n in groups]


def dominates(one: dict[int, int], other: dict[int, int]) -> bool:
    """Whether the pieces of the other filling can be packed into the pieces of this one; large fillings are not compared."""
    bins = sorted((s for s, n in one.items() for _ in range(n)), reverse=True)
    items = sorted((s for s, n in other.items() for _ in range(n)), reverse=True)
    if len(bins) > 5 or len(items) > 7:
        return False

    def fits(i: int, rooms: tuple[int, ...]) -> bool:
        return i == len(items) or any(r >= items[i] and fits(i + 1, (*rooms[:b], r - items[i], *rooms[b + 1 :])) for b, r in enumerate(rooms))

    return fits(0, tuple(bins))


def fillings(counts: Sequence[int], room: int, waste: int, width: int) -> list[tuple[dict[int, int], int]]:
    """Undominated fillings of some room that waste no more than `waste`, fullest and then largest pieces first: at most `width`, with
    what each leaves empty."""
    if room == 0 or counts[room]:
        return [({room: 1} if room else {}, 0)]
    sizes = [s for s in range(1, room) if counts[s]]
    # sums of the first i sizes as bits, so that the search below has no dead ends
    sums = [1]
    for s in sizes:
        bits, left, step = sums[-1], min(counts[s], room // s), 1
        while left:
            n = min(step, left)
            bits |= bits << n * s
            left -= n
            step *= 2
        sums.append(bits & (1 << room + 1) - 1)

    def exact(target: int, i: int) -> Iterator[dict[int, int]]:
        """Fillings of exactly the target by the first i sizes, largest pieces first."""
        if target == 0:
            yield {}
            return
        while i and sums[i - 1] >> target & 1 and sizes[i - 1] > target:
            i -= 1
        if not i:
            return
        s = sizes[i - 1]
        for n in range(min(counts[s], target // s), -1, -1):
            if sums[i - 1] >> target - n * s & 1:
                for rest in exact(target - n * s, i - 1):
                    yield {s: n, **rest} if n else rest

    out: list[tuple[dict[int, int], int]] = []
    least = sizes[-1] if sizes else 0  # alone, it dominates all that is no longer than it
    for total in range(room, max(least, room - waste) - 1, -1):
        if total == least:
            alone = {least: 1} if least else {}
            if not any(dominates(f, alone) for f, _ in out):
                out.append((alone, room - total))
        elif sums[-1] >> total & 1:
            for tried, filling in enumerate(exact(total, len(sizes))):
                if len(out) >= width or tried >= 4 * width:
                    break
                if not any(dominates(f, filling) for f, _ in out):
                    out.append((filling, room - total))
        if len(out) >= width:
            break
    return out


def search(counts: Sequence[int], fewest: int, capacity: int, nodes: int, loose: int = 0, width: int = 12) -> list[tuple[dict[int, int], int]] | None:
    """A solution with fewer than `fewest` sequences, or None if `nodes` fillings did not show one. Of fillings that waste no more than
    `loose`, those with the largest pieces come first."""
    left = [int(x) for x in counts]
    allowed = (fewest - 1) * capacity - sum(s * n for s, n in enumerate(left))
    top = next((s for s in range(capacity, 0, -1) if left[s]), 0)
    if allowed < 0 or not top:
        return None
    chosen: list[tuple[dict[int, int], int, int]] = []  # filling, copies, waste of each
    waste = 0

    def choices(largest: int) -> Iterator[tuple[dict[int, int], int, int]]:
        left[largest] -= 1
        found = fillings(left, capacity - largest, allowed - waste, width)
        left[largest] += 1
        found.sort(key=lambda f: (f[1] > loose, -max(f[0], default=0), f[1]))
        found = [(f | {largest: f.get(largest, 0) + 1}, w) for f, w in found]
        most = [min(left[s] // n for s, n in f.items()) for f, _ in found]
        yield from ((f, m, w) for (f, w), m in zip(found, most))
        for (f, w), m in zip(found, most):
            yield from ((f, n, w) for n in range(m - 1, 0, -1))

    stack = [(top, choices(top))]
    while stack and nodes > 0:
        largest, more = stack[-1]
        step = next(more, None)
        if step is None:
            stack.pop()
            if chosen:
                filling, n, each = chosen.pop()
                waste -= n * each
                for s, k in filling.items():
                    left[s] += n * k
            continue
        filling, n, each = step
        if waste + n * each > allowed:
            continue
        nodes -= 1
        waste += n * each
        chosen.append(step)
        for s, k in filling.items():
            left[s] -= n * k
        largest = next((s for s in range(largest, 0, -1) if left[s]), 0)
        if not largest:
            return [(f, n) for f, n, _ in chosen]
        stack.append((largest, choices(largest)))
    return None


def complete(counts: Sequence[int], capacity: int, rounds: int = 150, nodes: int = 600) -> list[tuple[dict[int, int], int]]:
    """Sequences as few as found for counts[length] pieces of each length up to the capacity: (filling, how many have it).

    The incumbent is the best-fit solution. Each round takes some of its sequences apart (those that waste most, and others drawn by a
    fixed seed) and searches for a way to use fewer for their pieces; the first round takes all. It ends at the lower bound."""
    best, draw = best_fit([int(x) for x in counts], capacity), random.Random(1)
    bound = least_sequences(counts, capacity)
    spare = lambda f: capacity - sum(s * n for s, n in f.items())
    for number in range(rounds):
        if sum(n for _, n in best) <= bound:
            break
        best.sort(key=lambda x: (-spare(x[0]), sorted(x[0].items())))
        wasted, some = 0, 0
        goal = min(sum(spare(f) * n for f, n in best), capacity * draw.choice((1.3, 1.6, 1.95)))
        while some < len(best) and wasted < goal:
            wasted += spare(best[some][0]) * best[some][1]
            some += 1
        more = min(len(best) - some, len(best) if number == 0 else draw.choice((8, 16, 32, 64, 128)))
        taken = {*range(some), *draw.sample(range(some, len(best)), more)}
        part = [0] * (capacity + 1)
        for i in taken:
            for s, n in best[i][0].items():
                part[s] += n * best[i][1]
        found = search(part, sum(best[i][1] for i in taken), capacity, max(nodes, 2 * len(taken)), draw.choice((0, 2, 8, 32)), 4 if number == 0 else 12)
        if found:
            best = [x for i, x in enumerate(best) if i not in taken] + found
    return best


class Plan:
    """Where the pieces of each length go: runs of ranks, as arrays in order of (length, rank)."""

    def __init__(self, sequences: Sequence[tuple[dict[int, int], int]]):
        rows, used, at = [], {}, 0
        for filling, copies in sequences:
            offset = 0
            for size in sorted(filling, reverse=True):
                rows.append((size, used.get(size, 0), at, offset, filling[size]))
                used[size] = used.get(size, 0) + copies * filling[size]
                offset += size * filling[size]
            at += copies
        self.n = at
        rows.sort()
        self.size, self.rank, self.sequence, self.offset, self.each = np.array(rows, np.int64).reshape(-1, 5).T.copy()
        self.first = np.searchsorted(self.size, np.arange(int(self.size.max(initial=0)) + 2))

    def places(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by their length and their rank (from 0) within it."""
        sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for s in np.unique(size):
            mine = size == s
            run = slice(self.first[s], self.first[s + 1])
            i = run.start + np.searchsorted(self.rank[run], rank[mine], "right") - 1
            ahead = rank[mine] - self.rank[i]
            sequence[mine] = self.sequence[i] + ahead // self.each[i]
            offset[mine] = self.offset[i] + ahead % self.each[i] * s
        return sequence, offset


def cut_documents(documents: DataFrame, spec: str, capacity: int = 1024, end: int | None = 2, keep: Sequence[str] = ("doc_id",), text: str = "text", ids: bool = False) -> DataFrame:
    """A row for each piece: keep, piece, start, length, ids_crc32, with `ids` the ids themselves (little-endian 32-bit integers), and task
    and place, its number among the task's pieces of its length. spec: the tokenizer's JSON."""
    taken, names, read = carried(documents, keep, text)
    shared = documents.sparkSession.sparkContext.broadcast(spec)
    key = "packing-" + hashlib.sha256(spec.encode()).hexdigest()
    last = b"" if end is None else int(end).to_bytes(4, "little")
    made = ["piece int", "start long", "length long", "ids_crc32 long", "task int", "place long", *(["ids binary"] if ids else [])]

    def run(batches):
        words = held(key, lambda: Words(shared.value))
        seen, task = np.zeros(capacity + 1, np.int64).tolist(), TaskContext.get().partitionId()
        for whole in batches:
            for batch in pieces(whole, read):
                owner, rows = [], []
                for i, data in enumerate(words.encode([t or "" for t in column_texts(batch.column(read))])):
                    data += last
                    n = len(data) // 4
                    head = n % capacity or min(n, capacity)
                    for k, a in enumerate([0, *range(head, n, capacity)] if n else []):
                        b = head if k == 0 else a + capacity
                        part = data[4 * a : 4 * b]
                        owner.append(i)
                        rows.append((k, a, b - a, zlib.crc32(part), seen[b - a], part))
                        seen[b - a] += 1
                columns = [pa.array(c, kind) for c, kind in zip(list(zip(*rows)) or [[]] * 6, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                columns = [*columns[:4], pa.array([task] * len(rows), pa.int32()), columns[4], *([columns[5]] if ids else [])]
                at = pa.array(owner, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(n).take(at) for n in names), *columns], names=[*names, *(m.split()[0] for m in made)])

    out = taken.mapInArrow(run, ", ".join([*fields_of(taken, names), *made]))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *(m.split()[0] for m in made))


def pack(documents: DataFrame, spec: str, capacity: int = 1024, end: int | None = 2, keep: Sequence[str] = ("doc_id",), text: str = "text", ids: bool = False, rounds: int = 150) -> DataFrame:
    """A row for each piece: keep, piece (from 0), start (ids of its document before it), length, ids_crc32, sequence_id and offset; with
    `ids` the piece's ids. Sequences are numbered from 0, those that are one full piece downwards from -1."""
    names = [f"d{i}" for i in range(len(keep))]
    cut = stored(cut_documents(documents, spec, capacity, end, keep, text, ids).toDF(*names, "piece", "start", "length", "ids_crc32", "task", "place", *(["ids"] if ids else [])), "packing-pieces")
    short = cut.where(F.col("length") < capacity)
    by_task = stored(short.groupBy("task", "length").agg(F.count("*").alias("n")), "packing-counts")
    counts = [0] * (capacity + 1)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # fewer rows than a sequence has tokens
        counts[r.length] = r.n
    plan = documents.sparkSession.sparkContext.broadcast(Plan(complete(counts, capacity, rounds)))
    before = by_task.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = short.join(before, ["task", "length"]).select(*cut.columns, (F.col("before") + F.col("place")).alias("rank"))
    fields = ", ".join([*fields_of(ranked, cut.columns), "sequence_id long", "offset long"])

    def place(batches):
        for batch in batches:
            sequence, offset = plan.value.places(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            rest = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), pa.array(sequence), pa.array(offset)], names=[*rest, "sequence_id", "offset"])

    alone = -1 - (F.col("task").cast("long") * (1 << 32) + F.col("place"))
    full = cut.where(F.col("length") == capacity).select(*cut.columns, alone.alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = ranked.mapInArrow(place, fields).unionByName(full)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from `pack` with ids: sequence_id, ids, and the offsets at which pieces begin, for masks. A
    sequence is one row of at most the capacity's ids."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), F.transform("p", lambda x: x["offset"]).alias("starts"))
