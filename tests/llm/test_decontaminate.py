import random

from brevispark.llm import decontaminate as op


def greedy(a, b, least):
    mark_a, mark_b, out = [False] * len(a), [False] * len(b), []
    while True:
        best = []
        for q in range(len(a)):
            for p in range(len(b)):
                n = 0
                while q + n < len(a) and p + n < len(b) and a[q + n] == b[p + n] and not mark_a[q + n] and not mark_b[p + n]:
                    n += 1
                if n >= least:
                    best.append((-n, q, p))
        if not best:
            return sorted(out)
        n, q, p = min(best)
        out.append((q, p, -n))
        mark_a[q : q - n], mark_b[p : p - n] = [True] * -n, [True] * -n


def test_tiles_equal_plain_greedy_tiling():
    rnd = random.Random(4)
    for _ in range(150):
        a = [rnd.randrange(40) for _ in range(rnd.randrange(1, 25))]
        b = []
        for _ in range(3):
            start = rnd.randrange(len(a))
            b += [*a[start : start + rnd.randrange(9)], rnd.randrange(40)]
        assert op.tile(a, b, 3) == greedy(a, b, 3)


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma"


def test_leaks(spark, odd_documents):
    w = ITEM.split()
    reordered = " ".join([*w[9:], "and then", *w[:9]])
    docs = [(101, f"Before, {ITEM.upper()} after"), (102, f"x {reordered} y"), (103, " ".join(w[:7])), (104, " ".join(w[::-1])), (101, f"Before, {ITEM.upper()} after")]
    df = odd_documents.unionByName(spark.createDataFrame(docs, "doc_id bigint, text string"), allowMissingColumns=True)
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "the and of"), (None, ITEM)], "item_id bigint, text string")
    got = sorted((r.doc_id, str(r.item_id), r.n_covered) for r in op.find_leaks(df, bench).collect())
    assert got == sorted([*((d, i, 18) for d in (101, 101, 102) for i in ("1", "None")), (9, "4", 3)])  # item 4 is found as a whole


def brute(documents, items, threshold, least):
    """Plain greedy tiling of all pairs."""
    out = []
    for d, t in documents:
        for i, x in items:
            own = op.tokens(x or "")
            if own:
                number = {}
                a = [number.setdefault(w, len(number)) for w in own]
                b = [number.get(w, -1 - k) for k, w in enumerate(op.tokens(t or ""))]
                tiles = greedy(a, b, min(least, len(own)))
                if sum(n for _, _, n in tiles) >= threshold * len(own):
                    out.append((d, i, [tuple(x) for x in tiles]))
    return sorted(out, key=str)


def test_equals_plain_tiling_of_all_pairs(spark, monkeypatch):
    from brevispark.llm import common

    monkeypatch.setattr(common, "LEAST_PART", 3)  # every key is dealt over several tasks
    monkeypatch.setattr(op, "LIST", 2)
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    stem = [rnd.choice(words) for _ in range(7)]
    line = lambda n: [rnd.choice(words) for _ in range(n)]
    items = [(i, " ".join([*(stem if i % 2 else []), *line(rnd.randint(1, 14))])) for i in range(24)] + [(3, "w1"), (3, "w1"), (None, "w2 w3"), (5, "w1 " * 30), (6, None), (7, "")]
    docs = []
    for i in range(60):
        parts = [line(rnd.randint(0, 12))]
        for _ in range(rnd.randint(0, 3)):
            own = rnd.choice(items)[1] or ""
            own = own.split()
            cut = rnd.randint(0, len(own))
            parts += [own[cut:], line(rnd.randint(0, 2)), own[:cut]]
        docs.append((i if i % 7 else None, " ".join(w for p in parts for w in p)))
    docs += [docs[3], (99, " ".join(stem)), (100, "w1 " * 60), (101, None)]
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for threshold, least in ((0.5, 3), (0.8, 4)):
        got = [(r.doc_id, r.item_id, [tuple(t) for t in r.tiles]) for r in op.find_leaks(df, bench, threshold, least).collect()]
        assert sorted(got, key=str) == brute(docs, items, threshold, least)


def test_work_is_bounded():
    import time

    began = time.perf_counter()
    long = op.Document("word " * 40_000)
    assert op.Document("word " * 40_000).tiles(["word"] * 800, 5, 0.5) == [(0, 0, 800)]
    assert sum(n for _, _, n in long.tiles((["word"] * 30 + ["gap"]) * 25, 5, 0.5)) == 750
    stem = [f"s{i}" for i in range(12)]
    doc = op.Document(" ".join([*stem, *(f"t{i}" for i in range(170))]))
    assert not any(doc.tiles([*stem, *(f"x{j}y{i}" for i in range(28))], 5, 0.5) for j in range(4_000))
    assert time.perf_counter() - began < 8


def test_the_most_frequent_seeds_make_no_candidates():
    import numpy as np

    seed = np.arange(36)
    frequency = {i: 1000 if i < 15 else 1 for i in range(36)}
    kept = op.kept_seeds(seed, 5, 40, frequency, 0.5)
    assert not set(kept) & set(range(15)) and len(kept) >= 20
    assert op.kept_seeds(seed, 5, 40, {i: 1000 for i in range(36)}, 0.5)  # a document of nothing else is still found


def test_empty_tables(spark, no_documents, odd_documents):
    bench = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    assert op.find_leaks(no_documents, bench).count() == 0
    assert op.find_leaks(odd_documents, bench.limit(0)).count() == 0
