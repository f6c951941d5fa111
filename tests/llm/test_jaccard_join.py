import random

import numpy as np
import pytest

from brevispark.llm import common
from brevispark.llm import jaccard_join as op
from brevispark.llm.components import components


def shingles(text, width=5):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)]) if w else frozenset()


def brute(docs, threshold=0.8):
    """docs: distinct doc_id -> text. Class and number of linked sets of each."""
    sets = {i: shingles(t) for i, t in docs.items()}
    first = {}
    for i in sorted(sets):
        if sets[i]:
            first.setdefault(sets[i], i)
    label = {i: first.get(sets[i], i) for i in sets}
    reps, links = sorted(first.values()), {}
    root = {i: i for i in reps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in reps:
        links[a] = 0
    for n, a in enumerate(reps):
        for b in reps[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common >= threshold * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (find(label[i]) if sets[i] else i, links[label[i]] if sets[i] else 0) for i in sets}


def corpus(seed=1, n=120):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = {}
    line = " ".join(rnd.choice(vocabulary) for _ in range(12))
    for i in range(n):
        kind = rnd.random()
        if docs and kind < 0.5:
            words = docs[rnd.choice(sorted(docs))].split()
            for _ in range(rnd.choice((0, 1, 2, 4))):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            docs[i] = " ".join(words)
        else:
            docs[i] = line + " " + " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(40, 160)))
    return docs


@pytest.mark.parametrize("limits, depth", [((1024, 2_000_000, 4096), 3), ((3, 400, 5), 3), ((3, 400, 5), 1)])
def test_equals_brute_force(spark, monkeypatch, limits, depth):
    monkeypatch.setattr(common, "LEAST_PART", 512 if limits[0] > 3 else 2)  # small parts: most keys are dealt over several tasks
    for name, value in zip(("NODE_SETS", "TILE_TOKENS", "TILE_SKETCHES"), limits):
        monkeypatch.setattr(op, name, value)
    docs = corpus()
    df = spark.createDataFrame(sorted(docs.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in op.near_duplicates(df, depth=depth).collect()}
    assert got == brute(docs)


def test_odd_rows(odd_documents):
    rows = op.near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, []).append(r)
    assert [r.class_id for r in of[1] + of[2] + of[3]] == [1, 1, 1, 1]
    assert {r.n_links for r in of[1] + of[2] + of[3]} == {1} and of[1][0].n_copies == 2 and of[3][0].n_linked == 2
    assert [r.class_id for r in of[11] + of[12]] == [11, 11] and of[4][0].class_id == 4 and of[6][0].class_id == 6
    assert all(r.class_id is None and r.n_links == 0 for r in of[None])
    assert len({r.text_hash for r in of[9]}) == 2


def test_empty_table(no_documents):
    assert op.near_duplicates(no_documents).count() == 0


def test_repetitions_reach_the_recall():
    rng = np.random.default_rng(0)
    n, runs, met = 100, op.repetitions(0.999, 1), 0
    bound = op.chance(np.array([n]), 0.8)[0]
    for _ in range(300):
        common = rng.integers(0, 2**63, 89, dtype=np.uint64)  # J = 89 / 111
        a, b = (np.concatenate([common, rng.integers(0, 2**63, 11, dtype=np.uint64)]) for _ in range(2))
        met += any(len(np.intersect1d(op.picked(a, r, bound)[1], op.picked(b, r, bound)[1])) for r in op.roots(runs))
    assert met >= 298


def test_sketches_keep_pairs_at_the_threshold():
    rng = np.random.default_rng(2)
    for n in (20, 120, 3000):
        for _ in range(50):
            common = rng.integers(0, 2**63, int(n * 0.9), dtype=np.uint64)
            sets = [np.unique(np.concatenate([common, rng.integers(0, 2**63, n - len(common), dtype=np.uint64)])) for _ in range(2)]
            sizes = np.array([len(s) for s in sets])
            assert op.with_partner(sizes, op.sketches(np.concatenate(sets), sizes), np.zeros(2), False, 0.8).all()


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 102), (7, 7), (100, 101)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
