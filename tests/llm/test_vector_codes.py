import hashlib
import math

import numpy as np
import pytest

from brevispark.llm import vector_codes as C

SCHEMA = "vec_id long, embedding array<double>, label int, code string, v int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA)


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """The same in plain Python integers, every entry compared."""
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts)) * parts
    kept = sorted(((i, v + [0] * (width - len(v)), lab) for i, v, lab in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    step = width // parts
    cut = [[v[p * step : (p + 1) * step] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for c in cut:
                mine.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for k, xs in mine.items():
                books[p][k] = [sum(col) // len(xs) for col in zip(*xs)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    top = (1 << 63) - 1
    labels = {}
    for (_, _, lab), e in zip(kept, errors):
        labels[lab] = labels.get(lab, 0) + min(e, top)
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), min(e, top), min(labels[lab], top), digest) for (i, _, lab), f, e in zip(kept, found, errors)), key=str)


def got(df):
    return sorted(map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


@pytest.mark.parametrize("size,entries", [(300, 256), (60, 8), (5, 256)])
def test_equals_all_pairs(spark, size, entries):
    rng = np.random.default_rng(size)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 8)], int(i) % 3) for i in range(size)]
    assert got(C.compress(frame(spark, rows), entries=entries)) == plain(rows, entries=entries)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    base = [(int(i), [float(x) for x in rng.normal(0, 0.2, 8)], None if i % 4 == 0 else int(i) % 2) for i in range(40)]
    odd = [(None, [0.1] * 8, None), (None, [0.1] * 8, 1), (3, base[3][1], 1), (3, [0.0] * 8, 1), (50, None, 1), (51, [None] * 8, 1), (52, [nan] + [0.0] * 7, 1), (53, [inf] * 8, None), (54, [1e308] * 8, 1)]
    short = [(60, [], 5), (61, [0.5], 5), (62, [0.25] * 9, 5)]
    rows = base + odd + short
    assert got(C.compress(frame(spark, rows), entries=16)) == plain([r for r in rows if r[0] != 54], entries=16)


def test_numbers_of_any_size(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(0, 10.0 ** (3 * (i % 9)), 8)], 0) for i in range(60)]
    assert got(C.compress(frame(spark, rows), entries=12)) == plain(rows, entries=12)


def test_ties_copies_and_hot_labels(spark):
    rows = [(i, [float(i % 2)] * 8, 7) for i in range(1500)] + [(i, [0.5] * 8, i) for i in range(1500, 1520)]
    assert got(C.compress(frame(spark, rows), entries=4)) == plain(rows, entries=4)


def test_no_rows(spark):
    none = C.compress(frame(spark, [(1, None, 1)]))
    assert none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and none.count() == 0


def test_rings_skip_entries_and_lose_none():
    rng = np.random.default_rng(3)
    entries = rng.integers(-2000, 2000, (256, 3)) * (1 + np.arange(256)[:, None])
    points = (rng.integers(-2000, 2000, (2000, 3)) * rng.integers(1, 256, (2000, 1))).astype(float)
    entry, far = C.Ring(entries.astype(object)).assign(points)
    all_ = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (entry == all_.argmin(1)).all() and (far == all_.min(1)).all()
