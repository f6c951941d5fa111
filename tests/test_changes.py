"""Cascades, slices, running values, choices by built texts, joins by places and phrases, balanced draws, block alignment."""

import difflib
import itertools
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brevispark.functions import arrays as A
from brevispark.operators import calibration as G
from brevispark.operators import joins as J
from brevispark.operators import running as N
from brevispark.operators import sampling as M
from brevispark.operators import words as W
from brevispark.operators.cascade import Dependencies, Link, changed_keys
from brevispark.operators.slices import Ledger, in_slices

GRAPH = Dependencies({"a": ("x",), "b": ("y",), "c": ("x", "y"), "d": ("z",)}, [Link("c", "a", ("x",)), Link("c", "b", ("y",)), Link("d", "c", ("p", "q"))])


def test_dependencies():
    assert GRAPH.order.index("c") > max(GRAPH.order.index("a"), GRAPH.order.index("b")) and GRAPH.below("a") == ["c", "d"] and GRAPH.below("d") == []
    with pytest.raises(ValueError, match="circle"):
        Dependencies({"a": ("x",), "b": ("y",)}, [Link("a", "b", ("y",)), Link("b", "a", ("x",))])
    with pytest.raises(ValueError, match="fit"):
        Dependencies({"a": ("x",)}, [Link("a", "nothing", ("x",))])


def test_a_change_reaches_all_that_depends_on_it(spark):
    rnd = random.Random(3)
    c = [(rnd.randrange(6), rnd.choice([None, *range(5)]), i) for i in range(60)]
    d = [(i, *rnd.choice(c)[:2]) for i in range(80)]
    tables = {"a": spark.createDataFrame([(i,) for i in range(6)], "x int"), "c": spark.createDataFrame(c, "x int, y int, v int"), "d": spark.createDataFrame(d, "z int, p int, q int")}
    left = GRAPH.surviving(tables, {"a": spark.createDataFrame([(2,), (2,), (9,)], "x int"), "b": spark.createDataFrame([(4,), (None,)], "y int")}, kept=("a",))
    gone = {(x, y) for x, y, _ in c if x == 2 or y == 4}
    assert left["a"].count() == 6
    assert sorted(map(str, left["c"].collect())) == sorted(str(r) for r in tables["c"].collect() if (r.x, r.y) not in gone)
    # a key with a null is nobody's parent
    assert sorted(r.z for r in left["d"].collect()) == sorted(z for z, p, q in d if (p, q) not in gone or q is None)
    old, new = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "k int, m string"), spark.createDataFrame([(1, "a"), (2, "x"), (3, None)], "k int, m string")
    assert sorted(r.k for r in changed_keys(new, old, ("k",), "m").collect()) == [2, 4]


def test_slices_resume(spark, tmp_path):
    ledger, stored = Ledger(spark, str(tmp_path / "ledger")), []

    def step(die_after, seen):
        def run(rows):
            if len(seen) == die_after:
                raise KeyboardInterrupt
            seen.append(rows.count())
            return rows.select("id", (F.col("id") * 2).alias("v"))

        return run

    def store(rows):
        stored.extend(r.id for r in rows.collect())

    work = lambda: spark.range(100).where(~F.col("id").isin(stored) if stored else F.lit(True))
    first, second = [], []
    with pytest.raises(KeyboardInterrupt):
        in_slices(ledger, work, ["id"], step(4, first), store, 10)
    assert not stored and len(ledger.runs()) == 1 and len(ledger.committed(ledger.runs()[0])) == 4
    found = in_slices(ledger, work, ["id"], step(None, second), store, 10)
    assert found["resumed"] == sum(first) and sum(first) + sum(second) == 100 and sorted(stored) == list(range(100)) and ledger.runs() == []
    assert in_slices(ledger, work, ["id"], step(None, []), store, 10) == {"resumed": 0, "slices": 0}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(1, 9)), min_size=1, max_size=7), st.floats(0, 30), st.sampled_from([None, 2, 3]), st.booleans())
def test_nearest_units_equal_all_choices(sizes, goal, most, pairs):
    there = [i for i, s in enumerate(sizes) if s is not None]
    all_ = list(itertools.permutations(there, 2)) if pairs else [c for r in range(1, (most or len(sizes)) + 1) for c in itertools.combinations(there, r)]
    assert G.nearest_units(sizes, goal, 4, most, pairs) == sorted(all_, key=lambda u: (abs(sum(sizes[i] for i in u) - goal), len(u), u))[:4]


def test_any_number_of_units():
    sizes = [2 * i + 1 for i in range(40)]
    best = G.nearest_units(sizes, 801.0)[0]
    assert sum(sizes[i] for i in best) == 801 and len(best) == 13  # an odd number; the eleven largest make 759


def test_a_counter_that_is_not_additive(spark):
    """Borders between units cost a token each, so the nearest sum is not the nearest text."""
    rows = spark.createDataFrame([(1, "a a a a a a a a a a", ["x x x x", "y y y", "z z"]), (2, "a a", []), (3, None, ["x"])], "k int, base string, u array<string>")
    rows = rows.withColumn("n", F.size(F.split("base", " "))).withColumn("sizes", F.transform("u", lambda x: F.size(F.split(x, " "))))

    def make():
        return lambda text: len(text.split()) + 2 * text.count("|")

    best = G.built_choice(G.choices(rows, "sizes", "n"), ["k"], lambda u: F.concat_ws("|", "base", F.array_join(F.transform(u, lambda i: F.element_at("u", i + 1)), "|")), G.by_model(make), "n").collect()
    # sums of 5 are nearest ([1, 2]), but built texts count 10 + 4 - 1 + 2 for [0] and 10 + 3 - 1 + 2 for [1] ...
    plain = {}
    for units in G.nearest_units([4, 3, 2], 5.0):
        text = "|".join(["a a a a a a a a a a", *["x x x x", "y y y", "z z"][units[0] : units[0] + 1], *[["x x x x", "y y y", "z z"][i] for i in units[1:]]])
        plain[units] = abs((make()(text) - 10) / 10 - 0.5), len(units), units
    assert [(r.k, tuple(r.units)) for r in best] == [(1, min(plain, key=plain.get))] and min(plain, key=plain.get) != (1, 2)


def test_points_in_intervals_equal_all_pairs(spark):
    rnd = random.Random(5)
    points = [(rnd.choice("aaaab"), rnd.randrange(0, 5000)) for _ in range(3000)] + [("a", None), ("c", 3)]
    spans = [(rnd.choice("aaab"), a, a + rnd.choice([0, 1, 2, 7, 500, 4000]), i) for i in range(40) for a in [rnd.randrange(0, 5000)]] + [("a", None, 9, 98), ("a", 9, 3, 99)]
    got = J.points_in_intervals(spark.createDataFrame(points, "g string, at int"), spark.createDataFrame(spans, "g string, lo int, hi int, i int"), ["g"], "at", "lo", "hi")
    want = sorted((g, x, lo, hi, i) for g, x in points if x is not None for h, lo, hi, i in spans if g == h and lo is not None and lo <= x < hi)
    assert sorted((r.g, r.at, r.lo, r.hi, r.i) for r in got.collect()) == want
    assert J.points_in_intervals(spark.createDataFrame(points, "g string, at int"), spark.createDataFrame([], "g string, lo int, hi int"), ["g"], "at", "lo", "hi").count() == 0


def test_hot_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(J, "LEAST_ROWS", 50)
    many = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(900)], "k string, v int")
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("none", 4)], "k string, w int")
    got = sorted((r.k, r.v, r.w) for r in J.dealt_join(many, few, ["k"], ["v"]).collect())
    assert got == sorted((r.k, r.v, r.w) for r in many.join(few, "k").collect())


def test_places_of_tokens_and_lines(spark):
    from brevispark.functions import text as T

    texts = [(1, "  Q: é́ 𝒳x, don't\n\n a"), (2, ""), (3, None), (4, "\n"), (5, "x" * 5), (6, "a.b")]
    df = spark.createDataFrame(texts, "k int, text string")
    rows = W.token_offsets(df, "text", ("k",)).collect()
    by = dict(texts)
    assert all(by[r.k][r.start : r.start + len(r.form)] == r.form for r in rows)
    forms = {r.k: list(r.t or []) for r in df.select("k", T.tokens(F.col("text")).alias("t")).collect()}
    assert {k: [r.form for r in sorted(rows, key=lambda r: r.pos) if r.k == k] for k in by} == forms
    lines = [(r.k, r.ord, by[r.k][r.start : r.end]) for r in W.line_offsets(df, "text", ("k",)).collect()]
    assert sorted(lines) == sorted((k, i, x) for k, t in texts if t is not None for i, x in enumerate(t.split("\n")))


def test_phrases_equal_all_pairs(spark):
    rnd = random.Random(8)
    words = ["the"] * 6 + ["a", "b", "c", "d", "ee"]
    texts = [(i, rnd.randrange(3), " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 12)))) for i in range(200)]
    texts = [(i, o, t) for i, o, t in {(i, o): (i, o, t) for i, o, t in texts}.values()] + [(900, 0, None)]
    phrases = [(i, " ".join(rnd.choice([*words, "zz"]) for _ in range(rnd.randrange(0, 4)))) for i in range(60)] + [(99, None), (98, "the"), (97, "the the")]
    got = J.phrases_in_texts(spark.createDataFrame(texts, "i int, o int, text string"), spark.createDataFrame(phrases, "p int, phrase string"), ["i", "o"], ["p"])
    want = sorted((i, o, p) for i, o, t in texts for p, x in phrases if t and x and f" {x} " in f" {t} ")
    assert sorted(map(tuple, got.collect())) == want and want
    first = {(r.i, r.p): r.o for r in J.first_hits(got, ["i", "p"], ["o"]).collect()}
    assert first == {(i, p): min(o for j, o, q in want if (j, q) == (i, p)) for i, _, p in want}


def test_running_values_equal_a_recomputation(spark):
    rnd = random.Random(9)
    rows = [(t, v, r, rnd.gauss(3, 2) + 1e3) for t in range(40) for v in "abc" for r in (0.25, 0.5) if rnd.random() < 0.9]
    df = spark.createDataFrame(rows, "task int, variant string, rho double, value double")
    pairs, before, states, means = [("a", "b"), ("b", "c")], df.limit(0), None, None
    parts = [df.where((F.hash("task", "variant") % 4 + 4) % 4 == i) for i in range(4)]
    for new in parts:
        states = N.update_pairs(states, before, new, "task", "variant", ["rho"], pairs)
        means = N.update(means, ["variant"], N.state(new, ["variant"], "value"))
        before = before.unionByName(new)
    key = lambda rows, *k: {tuple(r[c] for c in k): (r.n, r["mean"], r.m2) for r in rows.collect()}
    whole, got = key(N.state(N.differences(df, "task", "variant", ["rho"], pairs), ["rho", "contrast"], "d"), "rho", "contrast"), key(states, "rho", "contrast")
    assert whole.keys() == got.keys() and all(got[k] == (pytest.approx(whole[k][0]), pytest.approx(whole[k][1]), pytest.approx(whole[k][2], rel=1e-6)) for k in whole)
    whole, got = key(N.state(df, ["variant"], "value"), "variant"), key(means, "variant")
    assert all(got[k] == (whole[k][0], pytest.approx(whole[k][1]), pytest.approx(whole[k][2], rel=1e-6)) for k in whole)
    less = N.update(means, ["variant"], N.state(df.limit(0), ["variant"], "value"), N.state(df.where("variant = 'a'"), ["variant"], "value"))
    assert sorted(r.variant for r in less.collect()) == ["b", "c"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(*[st.integers(0, 3)] * 3), min_size=1, max_size=4), st.integers(1, 3))
def test_a_balanced_draw_is_found_if_there_is_one(cells, quota):
    counts = {(f"c{i}", t + 1): n for i, cell in enumerate(cells) for t, n in enumerate(cell)}
    per = len(cells) * quota // 3
    ways = [[x for x in itertools.product(*[range(n + 1) for n in cell]) if sum(x) == quota] for cell in cells]
    possible = 3 * per == len(cells) * quota and any(all(sum(x[t] for x in combo) == per for t in range(3)) for combo in itertools.product(*ways))
    try:
        drawn = M.balanced_table(counts, quota, per, lambda c, t, i: f"{c}{t}{i}")
    except ValueError:
        assert not possible
        return
    assert possible and all(drawn[k] <= counts[k] for k in drawn)
    assert all(sum(drawn[f"c{i}", t] for t in (1, 2, 3)) == quota for i in range(len(cells))) and all(sum(drawn[f"c{i}", t] for i in range(len(cells))) == per for t in (1, 2, 3))


def test_balanced_rows(spark):
    # one draw only: no seed of hash order finds it among as many others
    rows = [(f"c{c}", t, 100 * c + 10 * t + i) for c in range(6) for t in (1, 2, 3) for i in range(40 if t == 1 else 1)]
    sample = spark.createDataFrame(rows, "c string, t int, k int")
    drawn = M.balanced_draw(sample, "c", "t", "k", 3, 6).collect()
    assert len(drawn) == 18 == len({r.k for r in drawn}) and all(sum(r.t == t for r in drawn) == 6 for t in (1, 2, 3)) and all(sum(r.c == f"c{c}" for r in drawn) == 3 for c in range(6))
    found = M.balanced_subsample(sample, "c", "t", "k", 3, 6, tries=3).collect()
    assert len(found) == 18 and {r.seed for r in found} == {-1}
    with pytest.raises(ValueError, match="no draw"):
        M.balanced_draw(sample.where("t = 1 OR c = 'c0'"), "c", "t", "k", 3, 6)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14))
def test_blocks_equal_the_plain_matcher(small, big):
    plain = difflib.SequenceMatcher(None, small, big, autojunk=False).get_matching_blocks()
    assert A.embed_blocks(small, big) == [j for x in plain for j in range(x.b, x.b + x.size)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(-1, 2), max_size=40), st.lists(st.integers(-1, 2), max_size=40)), max_size=4), st.integers(0, 5))
def test_blocks_of_many_rows_equal_the_plain_matcher(rows, longest):
    plain = [difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() for a, b in rows]
    want = [any(x.b <= j < x.b + x.size for x in found) for found, (_, b) in zip(plain, rows) for j in range(len(b))]
    assert A.embed_blocks_each([a for a, _ in rows], [b for _, b in rows], longest).tolist() == want


@pytest.mark.parametrize("every,part", [(7, 3), (50, 5)])
def test_blocks_cost_as_much_as_the_text_not_as_it_times_the_blocks(monkeypatch, every, part):
    """Short runs, and long ones of one length: automata were made for every block, of many times the text's members (here 23 and 30 times)."""
    big = [i * i % 101 for i in range(3000)] if part < 5 else list(range(3000))
    small = [x if i % every else -1 for i, x in enumerate(big) if i % 5 < part]
    read = []
    for name in ("Automaton", "_longest"):
        plain = getattr(A, name, None)
        monkeypatch.setattr(A, name, lambda *lists, plain=plain: read.append(sum(map(len, lists))) or plain(*lists), raising=False)
    blocks = difflib.SequenceMatcher(None, small, big, autojunk=False).get_matching_blocks()
    assert A.embed_blocks(small, big) == [j for x in blocks for j in range(x.b, x.b + x.size)] and sum(read) <= len(small) + len(big)


def test_pieces_keep_rows_and_their_order(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"s": [["a"], None, [], ["a", "b"], ["c"]], "b": [["a", "a"], ["b"], [], ["b", "a"], None]})
    whole = [A._align([s], [b]) for s, b in zip(*A._codes(batch, "s", "b"))]
    monkeypatch.setattr(A, "PIECE", 2)
    pieces = list(A._pieces(batch, "s", "b"))
    assert len(pieces) > 1 and pa.Table.from_batches(pieces).to_pylist() == batch.to_pylist()
    got = [A._align(*A._codes(p, "s", "b")) for p in pieces]
    for k in range(2):
        assert [x for masks, _ in got for x in masks[k].tolist()] == [x for masks, _ in whole for x in masks[k].tolist()]
    assert [x for _, counts in got for x in zip(*counts)] == [x for _, counts in whole for x in zip(*counts)]


def test_edited_texts_are_aligned(spark):
    rows = spark.createDataFrame([(1, list("abcxyz"), list("ab-cxyz")), (2, list("xyab"), list("abxy")), (3, [], ["a"]), (4, None, None)], "k int, s array<string>, b array<string>")
    got = {r.k: (r.is_subsequence, r.n_unassigned, r.n_left) for r in A.align(rows, F.col("s"), F.col("b"), ("k",)).collect()}
    assert got == {1: (1, 0, 6), 2: (0, 2, 2), 3: (1, 0, 0), 4: (1, 0, 0)}


def test_a_slice_is_dealt_over_the_cores(spark, tmp_path):
    """One file a slice is one task's work, whatever the machines."""
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    run = ledger.begin(spark.range(4000).withColumn("text", F.lit("a b")), ["id"], 2000)
    assert len(ledger.slices(run)) == 2 and all(len(list((tmp_path / "ledger" / run / "plan" / f"_slice={s}").glob("*.parquet"))) > 0 for s in ledger.slices(run))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with slices of many megabytes
    try:
        run = ledger.begin(spark.range(4000).withColumn("text", F.lit("a b")), ["id"], 2000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(len(list((tmp_path / "ledger" / run / "plan" / f"_slice={s}").glob("*.parquet"))) > 1 for s in ledger.slices(run))
    assert sum(ledger.work(run, s).count() for s in ledger.slices(run)) == 4000


def test_marks_keep_the_words_that_labels_keep(spark):
    from brevispark.functions import text as T
    from brevispark.operators import compression as C
    from brevispark.operators import words as W

    df = spark.createDataFrame([("Q: who, 7 men?\nA b ccc dd ccc",), ("",), (". ,",), ("Q 1",), ("one",), (None,)], "text string")
    forms = T.tokens(F.col("text"))
    rows = df.select(C.kept_by_marks(forms, C.marks(forms), C.LEVELS).alias("a"), C.kept_at_levels(W.labelled_tokens(W.segments_of_lines(F.col("text")))).alias("b")).collect()
    assert all([tuple(x) for x in r.a] == [tuple(x) for x in r.b] for r in rows)


def test_tokens_of_lines_need_no_shuffle_and_equal_the_join(spark):
    df = spark.createDataFrame([(1, "a b\n\n c, d"), (2, ""), (3, None), (4, "\nx"), (5, "one"), (6, " \n . y\n")], "k int, text string").coalesce(1)
    rows = W.tokens_by_line(df, "text", ("k",))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    tokens = W.token_offsets(df, "text", ("k",)).withColumnRenamed("start", "at")
    joined = J.points_in_intervals(tokens, W.line_offsets(df, "text", ("k",)), ["k"], "at", "start", "end")
    want = joined.groupBy("k", "ord").agg(F.array_sort(F.collect_list(F.struct("at", "form")))["form"].alias("forms"))
    assert sorted(map(tuple, rows.collect())) == sorted((r.k, r.ord, r.forms) for r in want.collect())
