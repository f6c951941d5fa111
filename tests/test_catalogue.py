"""Every query against its SQL twin over the smallest tables; queries without one must run."""

import datetime
import decimal
import os
import pathlib
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.datetime)):
        return str(v)
    return repr(round(float(v), 6)) if isinstance(v, (int, float, decimal.Decimal)) else str(v)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    rel = duck.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())


@pytest.mark.parametrize("name", ["tokenize_words", "word_positions", "compress_surrogate", "selectivity_index", "free_index", "null_model", "section_retention", "overlap_free_selectivity", "realised_rates", "embed_positions", "lexical_overlap"])
def test_texts_are_tokenised_once_and_after_they_are_spread(spark, name):
    """What stands below the shuffle that deals the texts runs in as few tasks as the table has files."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Repartition")
    passes = {"lexical_overlap": 2, "realised_rates": 3}.get(name, 1)  # over both origins apart; with the words of both texts counted
    assert below and "regexp_extract_all" not in below and above.count("regexp_extract_all") == passes


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("pipeline", [False, True])
def test_the_rest_works_without_the_corpus_operators(tmp_path, pipeline):
    """A copy of the whole repository without the two folders, with and without the pipeline's file: all that is left still imports,
    and every remaining test is collected."""
    root = pathlib.Path(entry.__file__).parent
    gone = ["llm", "__pycache__", ".git", ".pytest_cache", *([] if pipeline else ["corpus_pipeline.py"])]
    copy = shutil.copytree(root, tmp_path / "copy", ignore=shutil.ignore_patterns(*gone))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    # whatever this run can import, but nothing from the repository itself
    found = [p for p in sys.path if p and root not in (pathlib.Path(p).resolve(), *pathlib.Path(p).resolve().parents)]
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYTEST_")} | {"PYTHONPATH": os.pathsep.join(found)}
    for command in (["-c", code], ["-m", "pytest", "--collect-only", "-q", "tests", "-p", "no:cacheprovider"]):
        done = subprocess.run([sys.executable, *command], cwd=copy, timeout=300, env=env, capture_output=True, text=True)
        assert done.returncode == 0, f"{command}\n{done.stdout[-3000:]}\n{done.stderr[-3000:]}"


@pytest.mark.parametrize("name", ["prompt_build", "prompt_segments", "prompt_demos"])
def test_prompts_read_their_material_once(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Union" not in plan


def test_odd_answers_are_scored_as_in_sql(spark, tmp_path):
    """Places that are null or stand twice, null texts, words that look like JSON, letters of uncommon lower case or beside a refusal."""
    texts = [f"he {w} {w} more" for w in ("[1]", '"yes"', '["a","b"]', "[1]x", "a b", "ΟΔΟΣ", "İstanbul", "éunable", "cannoté", "not ſure")] + ["same place", "same place", "", None]
    rows = [(i, t, "user" if i % 2 else "assistant", text) for i, text in enumerate(texts) for t in (0, 1, 2, 5, None)] + [(0, 0, "user", "another text"), (None, 1, None, "one two three"), (0, 0, "user", texts[0])]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["score_outputs"]).fetchall()
    got = [tuple(r) for r in entry.queries()["score_outputs"](spark, str(tmp_path)).collect()]
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, want))


def test_letters_of_later_unicode_are_scored_as_in_sql(spark, tmp_path):
    """Letters and digits that Java 17 takes for unassigned, capitals that are too new for SQL, an İ or ı where a refusal has an i."""
    letters = ["ࡰ", "ࣈ", "Ꟁ", "ꟲ", "\U00010570", "\U00011f50", "\U0001e4f0", "\U000323af", "Ɤ", "Ƛ", "Ᲊ", "\U00010d50", "\U0001fae0"]
    texts = [f"he a{x}b {x} {x} more{x}" for x in letters] + ["no ınformation", "oh İ don't know", "as an aı", "Not ſure", "I don't Know"]
    rows = [(i, t, "user" if i % 2 else "assistant", text) for i, text in enumerate(texts) for t in (0, 1, 2, 3, 5)]
    spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    for name in ("score_outputs", "error_class"):
        want = con.execute(entry.oracle_sql()[name]).fetchall()
        got = [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
        assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, want))
