import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brevispark.llm import topk_search as op

def is_query():
    return F.col("vec_id") % 50 == 0


def brute(rows, k, single=True):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * (float(np.float32(x)) if single else x)) for x in v]
            ok[i] = min(ok.get(i, q), q)
    out = []
    for q in ok:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(ok[q], ok[c])), c) for c in ok if c != q)
            out += [(q, n + 1, c, max(-(2**63), min(2**63 - 1, -s))) for n, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("block", [32_768, 3])
def test_equals_brute_force_with_ties(spark, block):
    rnd = random.Random(2)
    hot = [0.25, -0.5, 0.125]
    rows = [(i, hot if i % 3 == 0 else [rnd.uniform(-1, 1) for _ in range(3)]) for i in range(400)]
    rows += [(401, None), (402, [0.1, None, 0.2]), (450, [float("nan"), 0.0, 0.0]), (None, hot), (403, [float("inf"), 0.0, 0.0]), (7, [0.9, 0.9, 0.9]), (50, rows[50][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, embedding array<float>, label string")
    assert found(op.exact_top_k(df, is_query(), k=5, block=block)) == brute(rows, 5)


def test_few_candidates_and_other_lengths(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0]), (2, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert found(op.exact_top_k(df, is_query(), k=5)) == brute(rows, 5)


def test_nothing_to_search(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert found(op.exact_top_k(df, is_query())) == []
    one = spark.createDataFrame([(0, [1.0])], "vec_id bigint, embedding array<float>")
    assert found(op.exact_top_k(one, is_query())) == []


def test_components_of_any_size(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.uniform(-1, 1) * 10.0 ** rnd.choice((0, 0, 0, 6, 15, 17, 30, 80)) for _ in range(3)]) for i in range(101)]
    rows += [(200, [1e30, 1e30, 0.0]), (201, [1e30, -1e30, 0.0]), (250, [1e17, 1.0, 1.0]), (251, [0.0, 0.0, 1.0]), (252, [1e307, 0.0, 0.0]), (300, [0.5, 0.5, 0.5]), (301, [0.5, 0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    rows = [r for r in rows if all(math.isfinite(256 * x) for x in r[1])]
    assert found(op.exact_top_k(df, is_query(), k=7)) == brute(rows, 7, single=False)
    small = [(i, [x if abs(x) < 1e7 else 3e8 for x in v]) for i, v in rows]  # beyond doubles, within longs
    df = spark.createDataFrame(small, "vec_id bigint, embedding array<double>")
    assert found(op.exact_top_k(df, is_query(), k=7)) == brute(small, 7, single=False)
    floats = [(0, [1e30, 1e30]), (1, [1e30, -1e30]), (2, [3e38, 0.0]), (50, [1e17, 1.0])]
    df = spark.createDataFrame(floats, "vec_id bigint, embedding array<float>")
    assert found(op.exact_top_k(df, is_query())) == brute(floats, 5)
