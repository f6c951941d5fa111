import random

import pytest

from brevispark.llm import common
from brevispark.llm import substring_dedup as op


def brute(docs, k):
    """Row by row: kept words of (doc_id, text) rows."""
    words = [(i, (t or "").encode().split()) for i, t in docs]
    first = {}
    for i, w in words:
        if i is not None:
            for j in range(len(w) - k + 1):
                key = tuple(w[j : j + k])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        keep = [True] * len(w)
        for j in range(len(w) - k + 1):
            if i is not None and first[tuple(w[j : j + k])] < i:
                keep[j : j + k] = [False] * k
        out.append((i, len(w), len(w) - sum(keep), b" ".join(x for x, y in zip(w, keep) if y).decode()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=str)


@pytest.mark.parametrize("most, part", [(1_000_000, 512), (1_000_000, 2), (100, 2)])
def test_equals_brute_force(spark, monkeypatch, most, part):
    monkeypatch.setattr(common, "LEAST_PART", part)  # small parts: most keys are dealt over several tasks
    rnd = random.Random(3)
    text = lambda n, v: " ".join(rnd.choice(v) for _ in range(n))
    shared = [text(80, [f"s{i}" for i in range(500)]) for _ in range(3)]
    docs = [(i, " ".join([text(rnd.randint(0, 90), [f"w{j}" for j in range(300)]), rnd.choice([*shared, ""]), text(rnd.randint(0, 40), ["a", "b"])])) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert found(op.remove_repeats(df, k=50, most=most)) == brute(docs, 50)


def test_odd_rows(odd_documents):
    docs = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert found(op.remove_repeats(odd_documents)) == brute(docs, 50)


def test_empty_table(no_documents):
    assert op.remove_repeats(no_documents).count() == 0


def test_super_kmers_cover_all_windows():
    import numpy as np

    rng = np.random.default_rng(1)
    sizes = np.array([0, 3, 50, 200, 49, 3000])
    h = rng.integers(0, 5, sizes.sum()).astype(np.uint64)
    doc, start, n, _ = op.super_kmers(h, sizes, 50, 6)
    assert n.max() <= op.LONGEST
    for d, size in enumerate(sizes):
        covered = [w for a, m in zip(start[doc == d], n[doc == d]) for w in range(a, a + m)]
        assert covered == list(range(max(0, size - 49)))
