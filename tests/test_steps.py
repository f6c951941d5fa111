"""The steps over a small store: each works on what is open, and a repeated run changes nothing."""

import json

import pytest
from pyspark.sql import functions as F

from brevispark import steps
from brevispark.operators import plugins
from brevispark.sources import files

TASKS = """id\tprop\tsubj\tobj\ts_pop\tpop_tercile\tquestion\tpossible_answers
1\tcapital\tFrance\tParis\t100\t3\tWhat is the capital of France?\t"[""Paris"", ""City of Paris""]"
2\tcolor\tsky\tblue\t20\t1\tWhat is the color of the sky?\t"[""blue""]"
3\tsport\tPele\tfootball\tx\t2\tWhat sport does Pele play?\tfootball
"""
PARAPHRASES = "id,template_id,paraphrase\n1,0,What is the capital of France?\n1,1,Which city is the capital of France?\n1,2,France has which capital city?\n2,1,Which colour does the sky have?\nd0,1,Who was it that wrote Faust?\n"


def _model():
    def model():  # a function of a function goes to the workers by value
        return lambda prompt, most: {"output": " Paris " if "France" in prompt else "I don't know", "n_input": len(prompt), "n_output": 3, "total_s": 0.5}

    return model


model = _model()


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("study")
    (root / "tasks.tsv").write_text(TASKS)
    demos = ["task_id\tslot\trole\tdemo_id\tdemo_question\tdemo_answer"]
    demos += [f"{t}\t{i + 1}\t{'base' if i < 2 else 'demonstration'}\td{i}\tWho wrote book number {i}?\tAuthor {i}" for t in (1, 2, 3) for i in range(4)]
    (root / "demos.tsv").write_text("\n".join(demos) + "\n")
    (root / "paraphrases.csv").write_text(PARAPHRASES)
    (root / "subset.txt").write_text("1\n2\n")
    out = steps.Store(spark, str(root / "store"))
    with pytest.raises(ValueError, match="tasks"):
        out.read("tasks")
    assert steps.init(out, *(str(root / x) for x in ("tasks.tsv", "demos.tsv", "paraphrases.csv", "subset.txt"))) == 3
    assert steps.build(out) == 15
    assert steps.compress(out, limit=7) == 7
    assert steps.compress(out) == 60
    assert steps.measure(out) > 0
    assert steps.infer(out, model, levels=[0.0, 0.75], variants=["basis", "filler"]) == 8
    return out


def test_tasks_and_prompts(store):
    tasks = {r.task_id: r for r in store.read("tasks").collect()}
    assert tasks["1"].aliases == ["Paris", "City of Paris"] and tasks["1"].least_words == 1 and tasks["3"].s_pop is None and [tasks[k].in_subset for k in "123"] == [1, 1, 0]
    prompts = {r.prompt_id: r for r in store.read("prompts").collect()}
    assert "Q: What is the capital of France?\nQ: Which city is the capital of France?" in prompts["1/semantic"].text or "Q: France has which capital city?" in prompts["1/semantic"].text
    for r in prompts.values():
        assert r.n_units == len(r.units) and (r.variant != "basis" or r.calibration == 0)
    fillers = prompts["1/filler"]
    assert abs(fillers.calibration - 0.5) < 0.1 and fillers.in_band in (0, 1)


def test_steps_work_on_what_is_open(store, spark):
    before = {t: store.read(t).count() for t in ("prompts", "compressed", "inference")}
    assert steps.build(store) == 15 and steps.compress(store) == 60
    assert steps.infer(store, model, levels=[0.0, 0.75], variants=["basis", "filler"]) == 8
    assert {t: store.read(t).count() for t in before} == before
    assert steps.infer(store, model, repetition=2, levels=[0.0], variants=["basis"], limit=1) == 9
    assert steps.infer(store, model, levels=[0.5], variants=["basis"], all_tasks=True) == 12
    assert steps.evaluate(store)["determinism"].first() == (1, 1)


def test_measures_and_scores(store):
    measures = store.read("measures").collect()
    assert all(r.is_subsequence for r in measures) and all(r.r_core == 1 for r in measures if r.rho == 0 and r.n_core)
    assert store.read("sections").where("n_kept > n_words OR rate > 1").count() == 0
    right = {(r.task_id, r.correct, r.matched_alias, r.error_class) for r in store.read("inference").where("rho = 0").collect()}
    assert right == {("1", 1, "Paris", None), ("2", 0, None, "refusal")}
    store.write("inference", store.read("inference").withColumn("correct", F.lit(7)))
    steps.rescore(store)
    assert {r.correct for r in store.read("inference").collect()} <= {0, 1}


def test_export(store, spark, tmp_path):
    done = steps.export(store, str(tmp_path), words=True, texts=True)
    assert {*steps.EXPORTS, "accuracy", "contrasts", "null_model", "sensitivity_raw_contrasts", "efficiency", "errors"} < {*done} and done[-2:] == ["words", "texts"]
    assert files.read_csv(spark, str(tmp_path / "calibration"), ("variant", "share_leakage")).count() == 4
    tree = files.read_text_tree(spark, str(tmp_path / "texts" / "compressed"))
    want = store.read("compressed").where("rho > 0").join(store.read("prompts").select("prompt_id", "task_id", "variant"), "prompt_id").select("variant", F.col("task_id").alias("id"), "rho", F.col("compressed").alias("text"))
    assert sorted(map(tuple, tree.select("variant", "id", "rho", "text").collect())) == sorted(map(tuple, want.collect()))
    head = files.read_csv(spark, str(tmp_path / "words"), ("task_id", "variant", "rho", "pos", "form", "kept", "kept_mirror"))
    assert head.count() == store.read("words").where("is_word").count()


def _flaky(bad):
    def make():
        def model(text, rate):
            if bad in text:
                raise RuntimeError("no answer")
            return text[: int(len(text) * rate)]

        return model

    return make


@pytest.fixture
def small(spark, tmp_path):
    (tmp_path / "tasks.tsv").write_text(TASKS)
    demos = ["task_id\tslot\trole\tdemo_id\tdemo_question\tdemo_answer"]
    demos += [f"{t}\t{i + 1}\t{'base' if i < 2 else 'demonstration'}\td{i}\tWho wrote book number {i}?\t{'The blue' if t == 2 and i == 1 else 'Author'} {i}" for t in (1, 2, 3) for i in range(2 if t == 3 else 4)]
    (tmp_path / "demos.tsv").write_text("\n".join(demos) + "\n")
    out = steps.Store(spark, str(tmp_path / "store"))
    steps.init(out, str(tmp_path / "tasks.tsv"), str(tmp_path / "demos.tsv"))
    return out


def test_true_values(small):
    assert steps.build(small) == 11  # no paraphrases at all, no further demonstrations for task 3
    assert sorted((r.task_id, r.variant) for r in small.read("unbuilt").collect()) == sorted([*((t, "semantic") for t in "123"), ("3", "demonstration")])
    leaks = {r.prompt_id: (r.leakage, r.leakage_section) for r in small.read("prompts").collect()}
    assert leaks["2/basis"] == (1, "demonstration") and leaks["1/basis"] == (0, None) and leaks["2/filler"] == (1, "demonstration")
    steps.compress(small, levels=[0.0, 0.5], model=_flaky("Pele"))
    rows = small.read("compressed").collect()
    assert len(rows) == 11 + 8 and all((r.compress_s is not None and r.compress_s >= 0) == (r.rho > 0) for r in rows)
    assert {(r.step, r.prompt_id, r.rho, r.error) for r in small.read("errors").collect()} == {("compress", f"3/{v}", 0.5, "RuntimeError: no answer") for v in ("basis", "filler", "instruction")}
    steps.measure(small)
    steps.infer(small, model, all_tasks=True)
    for r in steps.runs(small).collect():
        assert r.pipeline_s == r.total_s + (r.compress_s or 0)
    share = {r.variant: r.share_leakage for r in steps.evaluate(small)["calibration"].collect()}
    assert share == {"filler": pytest.approx(1 / 3), "instruction": pytest.approx(1 / 3), "demonstration": pytest.approx(1 / 2)}
    steps.compress(small, levels=[0.0, 0.5], model=_flaky("nothing has this"))
    assert small.read("errors").where("step = 'compress'").count() == 0 and small.read("compressed").count() == 22
    assert steps.trial(small, _flaky("nothing has this"), levels=[0.5]).where("alike = 1 AND n_errors = 0").count() == 4


def test_what_depends_on_a_changed_prompt_goes(small):
    steps.build(small)
    steps.compress(small, levels=[0.0, 0.5])
    steps.measure(small)
    steps.infer(small, model, all_tasks=True)
    tables = ("compressed", "measures", "sections", "words", "inference")
    before = {t: small.read(t).where("prompt_id NOT LIKE '1/%'").count() for t in tables}
    small.write("tasks", small.read("tasks").withColumn("question", F.when(F.col("task_id") == "1", F.lit("Which town rules France?")).otherwise(F.col("question"))))
    assert steps.build(small) == 11
    for t in tables:
        assert small.read(t).where("prompt_id LIKE '1/%'").count() == 0 and small.read(t).count() == before[t] > 0, t
    assert steps.compress(small, levels=[0.0, 0.5]) == 22 and small.read("compressed").where("prompt_id = '1/basis' AND rho = 0 AND compressed LIKE '%Which town%'").count() == 1
    measured = small.read("measures").collect()
    steps.measure(small)
    assert small.read("measures").count() == 22 and {tuple(r) for r in measured} <= {tuple(r) for r in small.read("measures").collect()}
    steps.compress(small, levels=[0.0, 0.5], redo=True, model=_flaky("nothing has this"))
    assert small.read("inference").where("rho = 0.5").count() == 0 and small.read("inference").where("rho = 0").count() == 7  # texts of level 0 are the same


def test_a_run_that_dies_keeps_its_slices(small, spark, monkeypatch, tmp_path):
    from brevispark.operators import slices

    steps.build(small)
    calls = tmp_path / "calls"
    calls.mkdir()

    def make(folder=str(calls)):
        def model(text, rate):
            import hashlib
            import pathlib

            name = hashlib.sha256(f"{text}|{rate}".encode()).hexdigest()
            path = pathlib.Path(folder) / name
            path.write_text(path.read_text() + "x" if path.exists() else "x")
            return text[: int(len(text) * rate)]

        return model

    done, plain = [], slices.Ledger.work

    def dying(self, run, number):
        if len(done) == 3:
            raise KeyboardInterrupt
        done.append(number)
        return plain(self, run, number)

    monkeypatch.setattr(slices.Ledger, "work", dying)
    with pytest.raises(KeyboardInterrupt):
        steps.compress(small, model=make, commit_every=4)
    assert not small.has("compressed")
    first = len(list(calls.iterdir()))
    assert 0 < first < 33
    monkeypatch.setattr(slices.Ledger, "work", plain)
    assert steps.compress(small, model=make, commit_every=4) == 44
    assert len(list(calls.iterdir())) == 33 and all(p.read_text() == "x" for p in calls.iterdir())  # no call was made twice
    whole = steps.Store(spark, str(tmp_path / "other"))
    whole.write("prompts", small.read("prompts"))
    steps.compress(whole, model=make)
    same = lambda s: sorted((r.prompt_id, r.rho, r.compressed) for r in s.read("compressed").collect())
    assert same(small) == same(whole)


def test_a_version_counts_when_it_is_whole(spark, tmp_path):
    store = steps.Store(spark, str(tmp_path))
    for n in (3, 4, 5):
        assert store.write("t", spark.range(n)) == n
    (tmp_path / "t" / "v9").mkdir()  # a writer that died
    assert store.read("t").count() == 5 and store.write("t", store.read("t").limit(2)) == 2
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["v10", "v3"]


def test_commands(store, capsys):
    steps.main(["--store", store.root, "compress", "--levels", "0", "0.5", "--variants", "basis"])
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"compress": 60}
    steps.main(["--store", store.root, "evaluate"])
    assert set(json.loads(capsys.readouterr().out.splitlines()[-1])["evaluate"]) >= {"accuracy", "selectivity"}


def test_plugins_tell_failures_apart(spark):
    def make():
        return lambda text: len(text) if text != "bad" else 1 / 0

    rows = plugins.count_tokens_with(spark.createDataFrame([("abc",), ("bad",), (None,)], "text string"), make).collect()
    assert [(r.n_tokens, r.error) for r in rows] == [(3, None), (None, "ZeroDivisionError: division by zero"), (None, None)]
    import public_tokenizers

    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        row = plugins.count_tokens_with(spark.createDataFrame([("hello there world",)], "text string"), plugins.tokenizer_file(public_tokenizers.path(name))).first()
        assert row.n_tokens >= 3 and row.error is None
    cut = plugins.generate_with(spark.createDataFrame([("p",)], "prompt string"), lambda: lambda p, n: {"output": "x", "n_output": n}, most_tokens=4).first()
    assert cut.is_cut == 1 and cut.total_s is None
