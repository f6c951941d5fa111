import math
import random

import pytest
from pyspark.sql import functions as F

from brevispark.functions import arrays as A
from brevispark.functions import stats as S
from brevispark.functions import text as T


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_tokens_and_counts(spark):
    text = F.lit("Sjösa don't 42_x ² ß")
    row = one(spark, t=T.tokens(text), n=T.ws_count(text), m=T.mark_count(F.lit("Q: a A: b Q:")), d=T.digit_count(F.lit("1²x")), f=T.fold(F.lit("Straße")))
    assert row.t == ["Sjösa", "don", "'", "t", "42_x", "²", "ß"] and row.n == 5 and row.m == 3 and row.d == 2 and row.f == "strasse"


def test_normalising_and_errors(spark):
    rows = [("The Détiège, a test!", "detiege test"), ("", ""), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [r.n for r in df.select(T.normalise("t").alias("n")).collect()] == [w for _, w in rows]
    kinds = [("I don't know", "refusal"), ("", "empty_or_cut"), (None, "empty_or_cut"), ("one two three four five six seven", "format"), ("Paris", "wrong_entity")]
    df = spark.createDataFrame(kinds, "o string, want string")
    assert [r.c for r in df.select(T.error_class(F.col("o"), T.flat(F.col("o")), F.lit(False)).alias("c")).collect()] == [w for _, w in kinds]
    assert one(spark, c=T.error_class(F.lit("Par"), F.lit("par"), F.lit(True))).c == "empty_or_cut"


def test_encoding_repair_and_aliases(spark):
    broken = "Detiège".encode().decode("mac_roman")
    df = spark.createDataFrame([(broken,), ("plain",), ("√ only",), (None,)], "t string")
    got = [tuple(r.r) for r in df.select(T.repair_encoding("t").alias("r")).collect()]
    assert got == [("Detiège", 1), ("plain", 0), ("√ only", 0), (None, 0)]
    raw = [('["a", "b"]', ["a", "b"]), ('"x"', ["x"]), ("no json", ["no json"]), ("", []), (None, []), ("7", ["7"])]
    df = spark.createDataFrame(raw, "raw string, want array<string>")
    assert [r.a for r in df.select(T.alias_list(F.col("raw")).alias("a")).collect()] == [w for _, w in raw]
    assert one(spark, a=T.number_or_null(F.lit(" 42 ")), b=T.number_or_null(F.lit("4x"))) == (42, None)


def test_an_alias_that_is_a_json_string_is_read_as_json(spark):
    """Its escapes stand for what they mean; quotes that belong to no JSON string stay as they are."""
    raw = [(r'"de.\nMention"', ["de.\nMention"]), (r'"a \"b\" \u00e9 \\"', ['a "b" é \\']), ('" x "', [" x "]), ('""', ['""']), ('"a", "b"', ['"a", "b"']), (r'"a\"', [r'"a\"']), (r'"\q"', [r'"\q"']), ('"a\u2028b"', ["a\u2028b"])]
    df = spark.createDataFrame(raw, "raw string, want array<string>")
    assert [r.a for r in df.select(T.alias_list(F.col("raw")).alias("a")).collect()] == [w for _, w in raw]


def test_an_alias_may_be_of_any_length(spark):
    """Longer too than the 20 million characters that a JSON string may have unless more are asked for."""
    long = F.concat(F.lit('["'), F.repeat(F.lit("b"), F.lit(20_000_001)), F.lit('", "x"]'))
    assert one(spark, n=F.transform(T.alias_list(long), F.length)).n == [20_000_001, 1]


def test_protected_words_are_counted_and_keys_made_at_once(spark):
    """As one word after the other, beyond the basic plane too; a long word without a digit takes no time that grows as its square."""
    texts = ["Q: A1 AQ Q_ Q a1b 12 x² \U0001d400Q \U0001d400\U0001d7ce \U0001f600Q Aé", "", "ΟΔΟΣ.x Σ İx Straße", ". ,", "y" * 300000 + " 7"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    kept = F.size(F.filter(T.words(F.col("t")), T.is_protected))
    rows = df.select(T.protected_count(F.col("t")).alias("n"), kept.alias("m"), T.fold_each(T.tokens(F.col("t"))).alias("k"), F.transform(T.tokens(F.col("t")), T.fold).alias("l")).collect()
    assert [(r.n, r.k) for r in rows] == [(r.m, r.l) for r in rows] and rows[0].n > 3


def test_phrases(spark):
    row = one(spark, a=T.contains_phrase(F.lit("new york city"), F.lit("york")), b=T.contains_phrase(F.lit("new yorker"), F.lit("york")), c=T.contains_phrase(F.lit("x"), F.lit("")))
    assert tuple(row) == (True, False, False)


@pytest.mark.parametrize("x", [-9.0, -1.96, -0.5, 0.0, 0.3, 1.0, 2.5, 5.9, 12.0])
def test_normal_cdf(spark, x):
    assert abs(one(spark, p=S.normal_cdf(F.lit(x))).p - (1 + math.erf(x / math.sqrt(2))) / 2) < 1e-12


def test_wilson_and_ratio(spark):
    p, lo, hi = S.wilson(F.lit(0), F.lit(10))
    row = one(spark, p=p, lo=lo, hi=hi, r=S.ratio(F.lit(1), F.lit(0)), none=S.wilson(F.lit(0), F.lit(0))[0])
    assert row.p == 0 and abs(row.lo) < 1e-12 and abs(row.hi - 0.27754) < 1e-5 and row.r is None and row.none is None


def test_holm(spark):
    df = spark.createDataFrame([("x", "a", 0.01), ("x", "b", 0.04), ("x", "c", 0.03), ("y", "a", 0.9)], "g string, k string, p double")
    got = {(r.g, r.k): round(r.p_holm, 6) for r in S.holm(df, "p", ("g",), ("k",)).collect()}
    assert got == {("x", "a"): 0.03, ("x", "c"): 0.06, ("x", "b"): 0.06, ("y", "a"): 0.9}


def test_paired_without_spread(spark):
    df = spark.createDataFrame([("up", 1.0), ("up", 1.0), ("flat", 0.0), ("one", 3.0), ("none", None)], "g string, d double")
    got = {r.g: (r.mean, r.lo, r.hi, r.n, r.p) for r in df.groupBy("g").agg(*[e.alias(n) for n, e in S.paired(F.col("d")).items()]).collect()}
    assert got["up"] == (1, 1, 1, 2, 0) and got["flat"] == (0, 0, 0, 1, 1) and got["one"] == (3, 3, 3, 1, 0) and got["none"][3:] == (0, None)


def test_embedding(spark):
    assert A.embed_left(["a", "b"], list("aabb")) == [0, 2] and A.embed_right(["a", "b"], list("aabb")) == [1, 3]
    assert A.embed_left(["z"], ["a"]) is None and A.embed_left([], ["a"]) == []
    rnd = random.Random(0)
    rows = []
    for i in range(60):
        big = [rnd.choice("abc") for _ in range(rnd.randrange(0, 14))]
        rows.append((i, [x for x in big if rnd.random() < 0.5] if i % 5 else ["z", *big[:3]], big))
    rows += [(98, None, ["a"]), (99, ["a"], None)]
    df = spark.createDataFrame(rows, "i int, s array<string>, b array<string>")
    out = A.align(df, F.col("s"), F.col("b"), ("i",)).join(df.select("i", A.embed_left_fold(F.col("s"), F.col("b")).alias("fold"), "s", "b"), "i")
    for r in out.collect():
        if r.is_subsequence and r.b is not None and r.s is not None:
            assert r.left == r.fold and r.n_left == r.n_right == len(r.s) and r.n_ambiguous == sum(x != y for x, y in zip(r.left, r.right)) // 2
        elif r.s and r.b:
            assert r.n_unassigned == len(r.s) - r.n_left


def test_subsets(spark):
    row = one(spark, s=A.subsets(5, 2), p=A.ordered_pairs(3), all=F.size(A.subsets(14, 4)))
    assert len(row.s) == 15 and [0, 4] in row.s and len(row.p) == 6 and [2, 0] in row.p and row.all == 1470


def test_an_alias_with_an_escape_is_found_in_an_answer(spark):
    from brevispark.operators import scoring as Q

    df = spark.createDataFrame([("he said de.\nMention", r'"de.\nMention"')], "output string, raw string").withColumn("aliases", T.alias_list(F.col("raw")))
    row = Q.score(df, "output", "aliases", F.lit(False)).first()
    assert (row.correct, row.matched_alias, row.error_class) == (1, "de.\nMention", None)


def test_forms_of_long_texts_are_made_by_pieces(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"t": [None, "x" * 100, "y" * (3 * T.PIECE), *["é" * 50_000] * 50, None]})
    parts = list(T._pieces(batch))
    assert pa.Table.from_batches(parts) == pa.Table.from_batches([batch]) and all(len(p) == 1 or p.nbytes <= T.PIECE for p in parts) and not list(T._pieces(batch.slice(0, 0)))
    texts = [None, "", "The ÉCOLE, a ﬁne Straße!", "Ä b " * 40_000, *["x the Y"] * 30, "A " * 600_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    want = [(None, None) if t is None else (T.normal_form(t), t.casefold()) for t in texts]
    forms = T.with_forms(df, "t", {"n": T.normal_form, "f": str.casefold})
    assert forms.columns == ["i", "n", "f"] and [(r.n, r.f) for r in forms.orderBy("i").collect()] == want
    rows = df.select("i", T.normalise("t").alias("n"), T.casefold("t").alias("f"), T.normalise_list(F.array("t", F.lit(None).cast("string"))).alias("l"), T.repair_encoding("t").alias("r")).orderBy("i").collect()
    assert [(r.n, r.f) for r in rows] == want and [r.l for r in rows] == [[n, None] for n, _ in want] and [tuple(r.r) for r in rows] == [(t, 0) for t in texts]
