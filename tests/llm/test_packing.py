import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brevispark.llm import packing as P
from brevispark.llm.common import table
from brevispark.llm.queries import byte_tokenizer

SPEC = byte_tokenizer()
TOKENIZER, WORDS = Tokenizer.from_str(SPEC), P.Words(SPEC)


def plain_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def used(solution):
    out = {}
    for filling, copies in solution:
        for s, n in filling.items():
            out[s] = out.get(s, 0) + n * copies
    return out


def check(counts, capacity, solution):
    assert used(solution) == {s: n for s, n in enumerate(counts) if n and s}
    assert all(sum(s * n for s, n in f.items()) <= capacity for f, _ in solution)
    return sum(n for _, n in solution)


def fewest(items, capacity):
    """Exhaustive search."""
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for b in range(len(rooms)):
            if rooms[b] >= items[i] and rooms[b] not in rooms[:b]:
                go(i + 1, [*rooms[:b], rooms[b] - items[i], *rooms[b + 1 :]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_as_few_as_an_exhaustive_search_finds(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice((10, 24, 50))
    items = sorted((rnd.randint(1, capacity) for _ in range(rnd.randint(1, 11))), reverse=True)
    counts = np.bincount(items, minlength=capacity + 1).tolist()
    bound, found = P.least_sequences(counts, capacity), check(counts, capacity, P.complete(counts, capacity))
    assert bound <= found == fewest(items, capacity)


def test_better_than_best_fit():
    rnd = np.random.default_rng(3)
    counts = rnd.poisson(3, 257).tolist()
    counts[0] = 0
    first, found = check(counts, 256, P.best_fit(counts, 256)), check(counts, 256, P.complete(counts, 256))
    assert P.least_sequences(counts, 256) <= found <= first and found - P.least_sequences(counts, 256) <= 1
    many = [1000 * c for c in counts]
    assert check(many, 256, P.complete(many, 256, rounds=10)) <= check(many, 256, P.best_fit(many, 256))


def test_domination():
    assert P.dominates({5: 1}, {2: 2, 1: 1}) and P.dominates({5: 1, 3: 1}, {5: 1, 2: 1, 1: 1})
    assert not P.dominates({2: 2, 1: 1}, {5: 1}) and not P.dominates({4: 2}, {3: 1, 5: 1})
    assert P.fillings([0, 3, 3, 3, 3, 3], 4, 9, 5) == [({4: 1}, 0)]
    found = P.fillings([0, 3, 3, 3, 0, 0, 3], 5, 9, 9)
    assert found[0] == ({3: 1, 2: 1}, 0) and all(not P.dominates(a, b) for (a, _), (b, _) in itertools.permutations(found, 2) if a != b)


def test_places_fill_without_gaps():
    counts = [0, 50, 3, 0, 9, 20, 1, 0, 0]
    solution = P.complete(counts, 8)
    plan = P.Plan(solution)
    size = np.repeat(np.arange(9), counts)
    rank = np.concatenate([np.arange(n) for n in counts])
    sequence, offset = plan.places(size, rank)
    rows = {}
    for q, o, s in zip(sequence, offset, size):
        rows.setdefault(q, []).append((o, s))
    assert sorted(rows) == list(range(plan.n)) == list(range(sum(n for _, n in solution)))
    for r in rows.values():
        at = 0
        for o, s in sorted(r):
            assert o == at
            at += s
        assert at <= 8


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "\r\n", " ", " ", "\x1c", "\x85", "é", "ß", "漢字", "🙂", "'s", "'ll", "don't", "12", "3.5", "%%", "_", "<|endoftext|>", "x" * 300, "Ġ", "ſ", "́", "​", "…"]), max_size=12))
def test_words_equal_the_tokenizer(parts):
    text = "".join(parts)
    assert WORDS.cuts and WORDS.many is not None
    assert WORDS.encode([text, "a " + text]) == [np.array(plain_ids(t), "<u4").tobytes() for t in (text, "a " + text)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text_equals_the_tokenizer(text):
    assert WORDS.encode([text]) == [np.array(plain_ids(text), "<u4").tobytes()]


def packed(documents, spec=SPEC, capacity=1024, **options):
    rows = P.pack(documents, spec, capacity, **options).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return rows


def test_documents(spark):
    documents = table(spark, "/root/testdata/sf0.001", "documents")
    rows = packed(documents)
    texts = {r.doc_id: r.text for r in documents.collect()}
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by.keys() == texts.keys()
    for i, mine in by.items():
        ids = [*plain_ids(texts[i]), 2]
        mine.sort(key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
        assert all(r.length == 1024 for r in mine[1:])
        for r in mine:
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert len(part) == 4 * r.length and zlib.crc32(part) == r.ids_crc32
    lengths = np.bincount([r.length for r in rows], minlength=1025).tolist()
    assert len({r.sequence_id for r in rows}) <= P.least_sequences(lengths, 1024) + 1


def test_small_capacity_and_sequences(spark, odd_documents):
    rows = packed(odd_documents, capacity=16, ids=True, keep=("doc_id", "source"))
    assert all(r.start % 16 == 0 or r.piece > 0 for r in rows) and {len(r.ids) // 4 - r.length for r in rows} == {0}
    empty = [r for r in rows if r.doc_id in (4, 5)]
    assert [(r.piece, r.start, r.length, r.ids_crc32) for r in empty] == [(0, 0, 1, zlib.crc32(b"\2\0\0\0"))] * 2
    whole = P.sequences(P.pack(odd_documents.where("length(text) < 1000"), SPEC, 16, ids=True)).collect()
    assert all(0 < len(r.ids) <= 64 and list(r.starts) == sorted(r.starts) for r in whole)


def test_exact_multiples_and_no_documents(spark, no_documents):
    text = " a" * 31  # 31 ids, and the end
    rows = packed(spark.createDataFrame([(1, text), (1, text), (2, " a" * 7)], "doc_id long, text string"), capacity=8)
    assert sorted((r.doc_id, r.piece, r.start, r.length) for r in rows) == sorted([(1, k, 8 * k, 8) for k in range(4)] * 2 + [(2, 0, 0, 8)]) and len({r.sequence_id for r in rows}) == 9
    assert packed(no_documents) == []
    assert P.pack(no_documents, SPEC).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
