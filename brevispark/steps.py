"""The study's steps as functions of a store, each resumable and with its options, and as commands: ``python -m brevispark.steps``.

A store is a folder of Parquet tables (any file system Spark reads). A step reads what earlier ones have written, works on the
conditions that are still open, and writes its own table; `redo` replaces them instead. A table is a folder of numbered versions; the
last one that was written to its end counts, so a step that dies leaves the old state. Rows that depend on a prompt or a compressed
prompt go when it changes (`DEPENDENCIES`). Model calls are made in slices: a step that dies keeps those that were committed.

    init       tasks, demos and paraphrases from files          build     prompts of every variant with calibrated redundancy
    compress   compressed prompts of all levels                 measure   selectivity, section retention and rates
    infer      answers of a language model, scored              rescore   new scores for stored answers
    export     named CSV files, word level and texts            evaluate  the evaluation's blocks as tables
    trial      a compressor on a few prompts, nothing stored    nullmodel what a deleter blind to origin would give
    sensitivity  the main results without some tasks or words
"""

from __future__ import annotations

import argparse
import importlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brevispark.functions import arrays as A
from brevispark.functions import stats as S
from brevispark.functions import text as T
from brevispark.operators import calibration as G
from brevispark.operators import compression as C
from brevispark.operators import evaluation as E
from brevispark.operators import incremental as I
from brevispark.operators import plugins, scoring
from brevispark.operators import prompts as P
from brevispark.operators import selectivity as R
from brevispark.operators import words as W
from brevispark.operators.cascade import Dependencies, Link, changed_keys
from brevispark.operators.sampling import rotating_pick
from brevispark.operators.slices import Ledger, in_slices
from brevispark.sources import files, sinks
from brevispark.sources.named_texts import write_named_texts

CONDITION = ["prompt_id", "rho"]


DEPENDENCIES = Dependencies(
    {"tasks": ("task_id",), "prompts": ("prompt_id",), **dict.fromkeys(("compressed", "measures", "sections", "words", "inference"), CONDITION), "demos": ("task_id",)},
    [Link("demos", "tasks", ("task_id",)), Link("prompts", "tasks", ("task_id",)), Link("compressed", "prompts", ("prompt_id",)), *[Link(t, "compressed", tuple(CONDITION)) for t in ("measures", "sections", "words", "inference")]],
)


class Store:
    """Tables of one study under a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self, name: str, whole: bool = True) -> list[int]:
        """Numbers of a table's versions, ascending: those that were written to their end, or all."""
        top = self._path(f"{self.root}/{name}")
        found = [x.getPath().getName() for x in self._fs.listStatus(top)] if self._fs.exists(top) else []
        return sorted(int(v[1:]) for v in found if v.startswith("v") and v[1:].isdigit() and (not whole or self._fs.exists(self._path(f"{self.root}/{name}/{v}/_SUCCESS"))))

    def has(self, name: str) -> bool:
        return bool(self._versions(name))

    def read(self, name: str) -> DataFrame:
        found = self._versions(name)
        if not found:
            raise ValueError(f"{self.root} has no table {name} yet: run the step that makes it")
        return self.spark.read.parquet(f"{self.root}/{name}/v{found[-1]}")

    def write(self, name: str, df: DataFrame) -> int:
        """Replaces a table, also by rows that were read from it. The version before stays for those who still read it."""
        whole, number = self._versions(name), max(self._versions(name, False), default=0) + 1
        df.write.parquet(f"{self.root}/{name}/v{number}")
        for old in self._versions(name, False):
            if old < number and old not in whole[-1:]:
                self._fs.delete(self._path(f"{self.root}/{name}/v{old}"), True)
        return self.read(name).count()

    def add(self, name: str, df: DataFrame, keys: Sequence[str]) -> int:
        """Puts rows in the place of those with the same keys."""
        return self.write(name, I.replace_keys(self.read(name), df, list(keys)) if self.has(name) else df)

    def forget(self, name: str, keys: DataFrame, itself: bool = True) -> None:
        """Takes away all rows that depend on rows of a table with some keys, and with `itself` those rows too: dependents first, so that
        a step that dies leaves no row without what it depends on."""
        touched = [t for t in [name, *DEPENDENCIES.below(name)] if self.has(t)]
        tables = {t: self.read(t) for t in touched}
        left = DEPENDENCIES.surviving(tables, {name: keys}, () if itself else (name,))
        for t in reversed(touched):
            if t != name or itself:
                self.write(t, left[t])

    def begin(self, step: str, **options) -> None:
        record = sinks.run_record(self.spark, step, __file__, options)
        record.write.mode("append").parquet(f"{self.root}/runs_log")


def init(store: Store, tasks: str, demos: str, paraphrases: str | None = None, subset: str | None = None) -> int:
    """tasks: TSV with id, prop, subj, obj, s_pop, pop_tercile, question, possible_answers. demos: TSV with task_id, slot, role, demo_id,
    demo_question, demo_answer. paraphrases: CSV with id, template_id, paraphrase. subset: ids of the smaller study."""
    store.begin("init", tasks=tasks, demos=demos)
    rows = files.read_tsv(store.spark, tasks)
    aliases = T.alias_list(F.col("possible_answers"))
    rows = rows.select(F.trim("id").alias("task_id"), F.col("prop").alias("relation"), F.col("subj").alias("subject"), F.col("obj").alias("object"), T.number_or_null(F.col("s_pop")).alias("s_pop"), T.number_or_null(F.col("pop_tercile")).cast("int").alias("tercile"), "question", aliases.alias("aliases"))
    rows = rows.withColumn("n_aliases", F.size("aliases")).withColumn("least_words", T.least_words(F.col("aliases"))).withColumn("n_ws", T.ws_count(F.col("question")))
    ids = files.read_ids(store.spark, subset, "task_id").withColumn("_in", F.lit(1)).distinct() if subset else None
    rows = rows.withColumn("in_subset", F.lit(0)) if ids is None else rows.join(ids, "task_id", "left").withColumn("in_subset", F.coalesce("_in", F.lit(0))).drop("_in")
    n = store.write("tasks", rows)
    used = files.read_tsv(store.spark, demos)
    used = used.select(F.trim("task_id").alias("task_id"), F.col("slot").cast("int").alias("slot"), "role", F.col("demo_question").alias("question"), F.col("demo_answer").alias("answer"), "demo_id")
    store.write("demos", used)
    if paraphrases:
        found = files.read_csv(store.spark, paraphrases, ("id", "template_id", "paraphrase"))
        fixed = T.repair_encoding("paraphrase")
        found = found.select(F.trim("id").alias("source_id"), F.col("template_id").cast("int").alias("template_id"), fixed.alias("r")).select("source_id", "template_id", F.col("r.text").alias("text"), F.col("r.repaired").alias("repaired"))
        needed = rows.select(F.col("task_id").alias("source_id")).union(used.select("demo_id")).distinct()
        store.write("paraphrases", files.needed_only(found.where("template_id > 0 AND text IS NOT NULL"), needed, "source_id"))
    return n


def _materials(store: Store) -> DataFrame:
    """Tasks with their demos of either role, by slot, and paraphrases picked by rotation."""
    picked = store.spark.createDataFrame([], "source_id string, text string")
    if store.has("paraphrases"):
        picked = rotating_pick(store.read("paraphrases"), "source_id", "template_id", "text").select("source_id", "text")
    demos = store.read("demos").join(picked.withColumnRenamed("source_id", "demo_id").withColumnRenamed("text", "paraphrase"), "demo_id", "left")
    pack = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("slot", "question", "answer", "paraphrase")))), lambda d: F.struct(d["question"].alias("question"), d["answer"].alias("answer"), d["paraphrase"].alias("paraphrase")))
    packed = demos.groupBy("task_id").agg(pack("base").alias("demos"), pack("demonstration").alias("extra"))
    own = picked.withColumnRenamed("source_id", "task_id").withColumnRenamed("text", "paraphrase")
    return store.read("tasks").join(packed, "task_id").join(own, "task_id", "left")


def build(store: Store, variants: Sequence[str] = P.VARIANTS, redo: bool = False, counter: Callable | None = None) -> int:
    """Prompts of each variant. Redundancy is chosen so that the prompt grows by half, by the length of the text that is really built.
    counter: a factory for `plugins.count_tokens_with`, the tokenizer of the model; without one, words count.

    A variant that has nothing to add for a task (no paraphrase, no further demonstration) makes no prompt; such cases are kept in the table
    `unbuilt`. What depends on a prompt that is changed or no longer made goes."""
    store.begin("build", variants=list(variants))
    count = G.by_model(counter) if counter else G.words
    material = _materials(store)
    made = [_built(material, v, count) for v in variants]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    store.write("_built", out)
    out = store.read("_built")
    wanted = material.select("task_id").withColumn("variant", F.explode(F.array(*map(F.lit, variants))))
    store.write("unbuilt", wanted.join(out, ["task_id", "variant"], "left_anti"))
    if store.has("prompts"):
        old = store.read("prompts").where(F.col("variant").isin(list(variants)))
        store.forget("prompts", old.select("prompt_id") if redo else changed_keys(out, old, ("prompt_id",), "sha256"))
        if not redo:
            out = I.changed_rows(out, store.read("prompts"), ["task_id", "variant"], "sha256")
    return store.add("prompts", out, ["task_id", "variant"])


def _sizes(rows: DataFrame, units: Column, count: Callable) -> DataFrame:
    """Adds _sizes: the counted lengths of a task's units (few texts), null for those that are not there."""
    if count is G.words:
        return rows.withColumn("_sizes", F.transform(units, lambda u: F.when(u.isNotNull(), F.size(T.tokens(u)))))
    each = rows.select("task_id", F.posexplode(units).alias("_at", "_unit"))
    counted = count(each, "_unit", "_n")
    packed = counted.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("_at", F.col("_n").cast("int").alias("n")))).alias("_s"))
    return rows.join(packed.select("task_id", F.transform("_s", lambda x: x["n"]).alias("_sizes")), "task_id", "left")


def _built(material: DataFrame, variant: str, count: Callable) -> DataFrame:
    rows = count(material.withColumn("_basis", P.prompt_text(P.build("basis"))), "_basis", "n_base").withColumn("n_base", F.col("n_base").cast("int"))
    if variant == "basis":
        rows = rows.withColumn("units", F.array().cast("array<int>"))
    else:
        pool = {"filler": P.FILLER_POOL, "instruction": P.INSTRUCTION_POOL}.get(variant)
        if pool:
            units = F.array(*map(F.lit, pool))
        elif variant == "semantic":
            units = F.concat(F.array("paraphrase"), F.transform("demos", lambda d: d["paraphrase"]))
        else:
            units = F.transform("extra", lambda d: F.concat(F.lit(P.QUESTION), d["question"], F.lit(P.LINE + P.ANSWER), d["answer"]))
        rows = G.choices(_sizes(rows, units, count), "_sizes", "n_base", most=P.MOST_FILLERS if variant == "filler" else None, pairs=variant == "instruction")
        best = G.built_choice(rows, ["task_id"], lambda u: P.prompt_text(P.build(variant, u)), count, "n_base")
        rows = rows.join(best.select("task_id", "units"), "task_id")
    rows = rows.withColumn("segments", P.numbered(P.build(variant, F.col("units"))))
    rows = rows.withColumn("_forms", T.normalise_list(F.transform("segments", lambda s: s["text"]))).withColumn("_sought", T.normalise_list("aliases"))
    leaks, where = W.leaks_in(F.col("segments"), F.col("_forms"), F.col("_sought"))
    rows = rows.withColumn("leakage", leaks).withColumn("leakage_section", where)
    rows = rows.select("task_id", "relation", F.lit(variant).alias("variant"), "n_base", "units", "segments", P.prompt_text(F.col("segments")).alias("text"), "leakage", "leakage_section")
    rows = rows.withColumn("sha256", F.sha2("text", 256)).withColumn("prompt_id", F.concat_ws("/", "task_id", "variant")).withColumn("n_ws", T.ws_count(F.col("text")))
    rows = count(rows, "text", "n_tokens").withColumn("n_tokens", F.col("n_tokens").cast("int"))
    return rows.withColumn("n_units", F.size("units")).withColumns(P.calibration(F.col("n_tokens"), F.col("n_base"), F.col("variant"))).withColumn("overlap", W.type_overlap(F.col("segments")))


def _errors(store: Store, step: str, rows: DataFrame, keys: Sequence[str]) -> None:
    """Keeps the reasons of rows that failed; those that worked this time lose an older one."""
    now = rows.select(F.lit(step).alias("step"), "prompt_id", "rho", (F.col("repetition") if "repetition" in keys else F.lit(0)).alias("repetition"), "error")
    old = store.read("errors").join(now, ["step", "prompt_id", "rho", "repetition"], "left_anti") if store.has("errors") else None
    failed = now.where("error IS NOT NULL")
    store.write("errors", failed if old is None else old.unionByName(failed))


def _put(store: Store, step: str, name: str, keys: Sequence[str]) -> Callable[[DataFrame], None]:
    """What is done with the rows of a step: failed ones go to the errors, the others to the table, and what depended on them goes."""
    def put(rows: DataFrame) -> None:
        _errors(store, step, rows, keys)
        good = rows.where("error IS NULL").drop("error")
        if DEPENDENCIES.below(name) and store.has(name):
            marks = lambda df: df.withColumn("_mark", F.sha2("compressed", 256))
            now = good.select(*keys).distinct()
            store.forget(name, changed_keys(marks(good), marks(store.read(name)).join(now, list(keys), "left_semi"), keys, "_mark"), itself=False)
        store.add(name, good, keys)

    return put


def compress(store: Store, levels: Sequence[float] = C.LEVELS, variants: Sequence[str] | None = None, limit: int | None = None, redo: bool = False, model: Callable | None = None, commit_every: int = 100_000) -> int:
    """Compressed prompts of open conditions. model: a factory for `compression.compress_with`; without one a deterministic deletion.
    commit_every: conditions of a slice; a slice that is done is not done again if the step dies. Level 0 is the prompt itself."""
    store.begin("compress", levels=list(levels), variants=variants and list(variants), limit=limit, redo=redo)
    prompts = store.read("prompts").select("prompt_id", "variant", "segments", "text")

    def work() -> DataFrame:
        done = store.read("compressed") if store.has("compressed") else store.spark.createDataFrame([], "prompt_id string, rho double")
        return I.work_list(prompts, list(levels), done, "prompt_id", CONDITION, variants=variants, redo=redo, limit=limit)

    def step(rows: DataFrame) -> DataFrame:
        plain = rows.where("rho = 0").select("prompt_id", "rho", F.col("text").alias("compressed"), F.lit(None).cast("double").alias("compress_s"), F.lit(None).cast("string").alias("error"))
        rows = rows.where("rho <> 0")
        if model is None:
            rows = rows.withColumn("tokens", W.labelled_tokens(F.col("segments"))).withColumn("order", C.pick_order(F.col("tokens")))
            text = C.kept_text(F.col("tokens"), C.survival(F.col("tokens"), F.col("rho"), F.col("order")))
            found = rows.select("prompt_id", "rho", text.alias("compressed"), F.lit(None).cast("double").alias("compress_s"), F.lit(None).cast("string").alias("error"))
        else:
            found = C.compress_with(rows.select("prompt_id", "rho", "text", (1 - F.col("rho")).alias("rate")), model).select("prompt_id", "rho", "compressed", "compress_s", "error")
        return plain.unionByName(found).withColumn("rate", 1 - F.col("rho"))

    in_slices(Ledger(store.spark, f"{store.root}/_compress"), work, CONDITION, step, _put(store, "compress", "compressed", CONDITION), commit_every)
    return store.read("compressed").count()


def trial(store: Store, model: Callable | None = None, n: int = 10, levels: Sequence[float] = C.LEVELS) -> DataFrame:
    """A compressor on `n` prompts of each variant, each text twice; nothing is stored. By variant and level: marks and digits kept, texts
    with an empty line, with a subsequence of the original, and those that came out alike both times."""
    rows = I.top_per_group(store.read("prompts").select("variant", "prompt_id", "segments", "text"), "variant", ["prompt_id"], n).drop("rank")
    rows = C.at_levels(rows, tuple(x for x in levels if x))
    if model is None:
        rows = rows.withColumn("tokens", W.labelled_tokens(F.col("segments"))).withColumn("order", C.pick_order(F.col("tokens")))
        text = C.kept_text(F.col("tokens"), C.survival(F.col("tokens"), F.col("rho"), F.col("order")))
        rows = rows.withColumn("compressed", text).withColumn("again", text).withColumn("error", F.lit(None).cast("string"))
    else:
        rows = C.compress_with(rows.withColumn("rate", 1 - F.col("rho")), model).drop("compress_s", "error")
        rows = C.compress_with(rows.withColumnRenamed("compressed", "again"), model).drop("compress_s")
    keys = lambda t: F.transform(T.tokens(F.col(t)), T.fold)
    rows = A.align(rows.select("variant", "rho", "text", "compressed", "again", "error"), keys("compressed"), keys("text"), ("variant", "rho", "text", "compressed", "again", "error"))
    rows = rows.withColumns(C.shape_measures(F.col("text"), F.col("compressed")))
    return rows.groupBy("variant", "rho").agg(
        F.count("*").alias("n"), F.avg("rho_real").alias("mean_real"), F.avg(F.coalesce("marks_kept", F.lit(0.0))).alias("marks_kept"), F.avg(F.coalesce("digits_kept", F.lit(1.0))).alias("digits_kept"),
        F.avg(F.contains("compressed", F.lit("\n\n")).cast("int")).alias("with_empty_line"), F.avg("is_subsequence").alias("subsequences"), F.avg((F.col("compressed") == F.col("again")).cast("int")).alias("alike"), F.count("error").alias("n_errors"),
    )


def measure(store: Store, redo: bool = False) -> int:
    """Adds alignment and selectivity of compressed prompts that have none yet, their sections' retention and their words; with `redo`, of
    all."""
    store.begin("measure", redo=redo)
    if redo:
        for name in ("measures", "sections", "words"):
            if store.has(name):
                store.write(name, store.read(name).limit(0))
    done = store.read("measures").select(*CONDITION) if store.has("measures") else store.spark.createDataFrame([], "prompt_id string, rho double")
    prompts = store.read("prompts").select("prompt_id", "variant", "task_id", "segments", F.col("text").alias("original"))
    rows = store.read("compressed").select("prompt_id", "rho", "compressed", "compress_s").join(done, CONDITION, "left_anti").join(prompts, "prompt_id").withColumn("tokens", W.labelled_tokens(F.col("segments")))
    keys = lambda t: F.transform(T.tokens(t), T.fold)
    aligned = A.align(rows, keys(F.col("compressed")), F.transform("tokens", lambda t: t["key"]), ("prompt_id", "rho", "variant", "task_id", "tokens", "original", "compressed", "compress_s"))
    store.write("_aligned", aligned)  # three tables come of it
    aligned = store.read("_aligned")
    counts = R.counts(F.col("tokens"), F.col("left"))
    found = aligned.withColumns(counts).withColumns(R.rates(*[F.col(c) for c in ("n_core", "n_red", "e_core", "e_red")]))
    found = found.withColumns(R.free_index(*[F.col(c) for c in ("n_core_free", "n_red_free", "e_core_free", "e_red_free")])).withColumns(C.shape_measures(F.col("original"), F.col("compressed")))
    long = aligned.where("rho > 0").select("prompt_id", "rho", "variant", "task_id", F.posexplode(F.arrays_zip(F.col("tokens").alias("t"), F.col("left").alias("kept"), F.col("right").alias("kept_mirror"))).alias("pos", "z"), F.size("tokens").alias("n"))
    words = long.select("prompt_id", "rho", "variant", "task_id", "pos", F.when(F.col("n") > 1, F.col("pos") / (F.col("n") - 1)).otherwise(0.0).alias("rel_pos"), "z.t.form", "z.t.key", "z.t.is_word", "z.t.is_digit", "z.t.is_protected", "z.t.origin", "z.t.section", "z.kept", "z.kept_mirror")
    store.add("words", words, CONDITION)
    new = store.read("words").join(aligned.select(*CONDITION), CONDITION, "left_semi")
    store.add("sections", R.section_retention(new.withColumnRenamed("kept", "lives"), ("prompt_id", "variant", "task_id", "rho")), CONDITION)
    return store.add("measures", found.drop("left", "right", "tokens", "original", "compressed"), CONDITION)


def infer(store: Store, model: Callable, repetition: int = 1, variants: Sequence[str] | None = None, levels: Sequence[float] | None = None, limit: int | None = None, redo: bool = False, all_tasks: bool = False, most_tokens: int = 32, commit_every: int = 100_000) -> int:
    """Answers of open conditions, scored. Only tasks of the smaller study, unless all are asked for. commit_every: as for `compress`."""
    store.begin("infer", repetition=repetition, variants=variants and list(variants), levels=levels and list(levels), limit=limit, redo=redo, all_tasks=all_tasks, most_tokens=most_tokens)
    tasks = store.read("tasks") if all_tasks else store.read("tasks").where("in_subset = 1")
    items = store.read("prompts").join(tasks.select("task_id"), "task_id", "left_semi").select("prompt_id", "variant", "task_id")
    keys = [*CONDITION, "repetition"]

    def work() -> DataFrame:
        done = store.read("inference") if store.has("inference") else store.spark.createDataFrame([], "prompt_id string, rho double, repetition int")
        open_ = I.work_list(items, [float(x) for x in C.LEVELS], done, "prompt_id", ["task_id", "variant", "rho"], variants, None if levels is None else [float(x) for x in levels], repetition, redo, limit)
        return open_.join(store.read("compressed").select("prompt_id", "rho", F.col("compressed").alias("prompt")), CONDITION)

    def step(rows: DataFrame) -> DataFrame:
        got = plugins.generate_with(rows, model, "prompt", most_tokens).drop("prompt").withColumn("repetition", F.lit(repetition))
        return scoring.rescore(got, store.read("tasks"), "task_id", normal=T.normalise)

    in_slices(Ledger(store.spark, f"{store.root}/_infer"), work, CONDITION, step, _put(store, "infer", "inference", keys), commit_every)
    return store.read("inference").count() if store.has("inference") else 0


def rescore(store: Store) -> int:
    store.begin("rescore")
    return store.write("inference", scoring.rescore(store.read("inference"), store.read("tasks"), "task_id", normal=T.normalise))


def conditions(store: Store) -> DataFrame:
    prompts = store.read("prompts").select("prompt_id", "relation", "n_units", "calibration", "in_band", "deviation", "leakage", "overlap", F.col("n_tokens").alias("n_prompt"))
    return store.read("measures").join(prompts, "prompt_id")


def runs(store: Store) -> DataFrame:
    """Model runs with their conditions and the time of compression and answer together."""
    rows = conditions(store).join(store.read("inference").drop("variant", "task_id"), CONDITION)
    return rows.withColumn("pipeline_s", F.col("total_s") + F.coalesce("compress_s", F.lit(0.0)))


#: Contrasts of the plan, and those of the sensitivity check.
PAIRS = [("filler", "semantic"), ("semantic", "instruction"), ("instruction", "demonstration")]
MORE_PAIRS = [*PAIRS, ("filler", "instruction")]
ERRORS = ("wrong_entity", "format", "refusal", "empty_or_cut")


def evaluate(store: Store) -> dict[str, DataFrame]:
    """The blocks of the evaluation, as far as tables are there."""
    c, against = conditions(store), [(v, "basis") for v in P.VARIANTS if v != "basis"]
    some = c.where("rho > 0 AND n_red > 0")
    values = E.per_task(some, F.col("ln_s_free"))
    core = store.read("sections").where("origin = 'core' AND rho > 0").groupBy("variant", "rho", "section").agg(F.count("*").alias("n"), F.avg("rate").alias("mean_rate"))
    ambiguous = F.col("n_ambiguous") / F.when(F.col("n_left") > 0, F.col("n_left"))
    controls = c.where("rho > 0").agg(F.count("*").alias("n"), F.count_if(F.col("n_ambiguous") > 0).alias("n_ambiguous"), F.avg(ambiguous).alias("share_ambiguous"), F.sum("r_red_null").alias("n_r_red_null"), F.count_if(F.col("is_subsequence") == 0).alias("n_no_subsequence"), F.sum("n_unassigned").alias("n_unassigned"))
    marks = store.read("words").where("is_word AND origin = 'redundant'").groupBy("variant").agg(F.avg(F.col("form").isin(*T.PROTECTED_FORMS).cast("int")).alias("share_marks"))
    out = {
        "rate_conformity": E.rate_conformity(c), "rate_intervals": E.mean_ci(c.where("rho > 0"), "rho_real"), "calibration": E.calibration_summary(store.read("prompts")), "controls": controls, "selectivity": E.selectivity(c),
        "selectivity_intervals": E.mean_ci(some, "ln_s_free"), "contrasts": E.holm_contrasts(values, PAIRS), "ranking": E.ranking(values), "section_rates": core, "redundancy_marks": marks,
    }
    if store.has("inference"):
        r = runs(store)
        right, cells = E.per_task(r.where("repetition = 1"), F.col("correct")), E.accuracy(r)
        kept = store.read("sections").withColumn("level_no", F.col("rho"))
        out |= {
            "accuracy": cells, "wilson": E.wilson_accuracy(r), "accuracy_differences": E.contrasts(right, against), "decline_differences": E.did(right), "tolerance": E.tolerance(cells), "errors": E.error_crosstab(r, ERRORS),
            "efficiency": E.efficiency(r), "question_survival": E.question_survival(kept, r.withColumn("level_no", F.col("rho"))), "determinism": E.determinism(store.read("inference"), CONDITION, "output"),
        }
    return out


def nullmodel(store: Store) -> DataFrame:
    """Geometric means of the raw and the free index that a deleter blind to origin would give, by variant and level."""
    c = lambda n: F.col(n)
    own = lambda n: c(f"n_{n}") - c(f"n_{n}_free")
    rows = conditions(store).where("rho > 0 AND variant <> 'basis'")
    rows = rows.withColumns(R.expected(c("e_core") + c("e_red"), (own("core"), c("n_core_free")), (own("red"), c("n_red_free")))).where("p_survive IS NOT NULL")
    return rows.groupBy("variant", "rho").agg(F.count("*").alias("n"), S.geometric_mean(c("ln_s_expected")).alias("geo_s_expected"), S.geometric_mean(c("ln_s_free_expected")).alias("geo_s_free_expected"))


def sensitivity(store: Store) -> dict[str, DataFrame]:
    """The main results with other indices and without some tasks or words: the raw index; without tasks whose answer leaks into a prompt;
    with redundant words only that have no counterpart in the core; declines against fillers instead of the base."""
    c = conditions(store).where("rho IN (0.25, 0.5)")
    leaky = store.read("prompts").where("leakage = 1").select("task_id").distinct()
    clean = lambda df: df.join(leaky, "task_id", "left_anti")
    index = lambda rows, column: (E.mean_ci(rows.where(f"{column} IS NOT NULL"), column), E.contrasts(E.per_task(rows.where(f"{column} IS NOT NULL"), F.col(column)), MORE_PAIRS))
    words = store.read("words").where("is_word AND rho IN (0.25, 0.5)")
    keys = words.groupBy("prompt_id", "rho", "variant", "task_id", "key").agg(F.max((F.col("origin") == W.CORE).cast("int")).alias("in_core"), *[F.count_if(~F.col("is_protected") & (F.col("origin") == o)).alias(f"n_{o}") for o in (W.CORE, W.REDUNDANT)], *[F.count_if(~F.col("is_protected") & F.col("kept") & (F.col("origin") == o)).alias(f"e_{o}") for o in (W.CORE, W.REDUNDANT)])
    new = lambda x: F.sum(F.when(F.col("in_core") == 0, F.col(x)).otherwise(0))
    fresh = keys.groupBy("prompt_id", "rho", "variant", "task_id").agg(F.sum("n_core").alias("nc"), new("n_redundant").alias("nr"), F.sum("e_core").alias("ec"), new("e_redundant").alias("er"), F.sum("n_redundant").alias("n_all"))
    fresh = fresh.withColumns(R.free_index(*[F.col(x) for x in ("nc", "nr", "ec", "er")]))
    shares = fresh.where("n_all > 0").groupBy("variant").agg(F.avg(F.col("nr") / F.col("n_all")).alias("share_new"))
    out = {"new_shares": shares}
    for name, rows, column in (("raw", c, "ln_s"), ("clean", clean(c), "ln_s_free"), ("new_words", fresh.where("variant <> 'basis'"), "ln_s_free")):
        out[f"{name}_index"], out[f"{name}_contrasts"] = index(rows, column)
    if store.has("inference"):
        r = runs(store).where("repetition = 1")
        right, tidy = E.per_task(r, F.col("correct")), E.per_task(clean(r), F.col("correct"))
        half = [(v, "basis") for v in P.VARIANTS if v != "basis"]
        out |= {"declines": E.did(right), "clean_declines": E.did(tidy), "clean_differences": E.contrasts(tidy.where("rho = 0.5"), half), "declines_against_filler": E.did(right.where("variant <> 'basis'"), "filler")}
    return out


#: What the parts of the export are ordered by; others by all their columns.
EXPORTS = {"conditions": ("task_id", "variant", "rho"), "runs": ("task_id", "variant", "rho", "repetition"), "sections": ("task_id", "variant", "rho", "section", "origin"), "runs_log": ("started", "step")}


def export(store: Store, out: str, words: bool = False, texts: bool = False) -> list[str]:
    """Named CSV files under a folder; with `words` the word level too, with `texts` prompts and compressed prompts as files, <variant>/<task>.txt and
    <variant>/<task>_<rate>.txt."""
    flat = lambda df: df.select(*[F.col(f.name) for f in df.schema.fields if f.dataType.typeName() not in ("array", "struct", "map", "binary")])
    tables = {"conditions": conditions(store), "sections": store.read("sections"), "runs_log": store.spark.read.parquet(f"{store.root}/runs_log"), **evaluate(store), "null_model": nullmodel(store), **{f"sensitivity_{k}": v for k, v in sensitivity(store).items()}}
    if store.has("inference"):
        tables["runs"] = runs(store)
    done = sorted(tables)
    for name in done:
        rows = flat(tables[name])
        sinks.write_csv(rows, f"{out}/{name}", EXPORTS.get(name, tuple(rows.columns)))
    if words:
        sinks.write_csv(store.read("words").where("is_word"), f"{out}/words", ("task_id", "variant", "rho", "pos"))
        done.append("words")
    if texts:
        prompts = store.read("prompts")
        write_named_texts(prompts, f"{out}/texts/prompts", name="task_id", overwrite=True)
        named = store.read("compressed").where("rho > 0").join(prompts.select("prompt_id", "task_id", "variant"), "prompt_id").withColumn("name", F.concat_ws("_", "task_id", sinks.rate_label("rate")))
        write_named_texts(named, f"{out}/texts/compressed", text="compressed", overwrite=True)
        done.append("texts")
    return done


def _factory(name: str) -> Callable:
    """A plug-in by its name, module:function."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def main(argv: Sequence[str] | None = None) -> None:
    top = argparse.ArgumentParser(description="Steps of a study over a store.")
    top.add_argument("--store", required=True)
    sub = top.add_subparsers(dest="step", required=True)
    one = {name: sub.add_parser(name) for name in ("init", "build", "compress", "measure", "infer", "rescore", "evaluate", "export", "trial", "nullmodel", "sensitivity")}
    for option in ("tasks", "demos"):
        one["init"].add_argument(f"--{option}", required=True)
    for option in ("paraphrases", "subset"):
        one["init"].add_argument(f"--{option}")
    for name in ("build", "compress", "infer"):
        one[name].add_argument("--variants", nargs="*", choices=P.VARIANTS)
        one[name].add_argument("--redo", action="store_true")
    for name in ("compress", "infer"):
        one[name].add_argument("--levels", nargs="*", type=float)
        one[name].add_argument("--limit", type=int)
        one[name].add_argument("--model", type=_factory, required=name == "infer", help="module:function that makes a model")
        one[name].add_argument("--commit-every", type=int, default=100_000)
    one["build"].add_argument("--counter", type=_factory, help="module:function that makes a counter of tokens")
    one["measure"].add_argument("--redo", action="store_true")
    one["trial"].add_argument("--n", type=int, default=10)
    one["trial"].add_argument("--model", type=_factory)
    one["infer"].add_argument("--repetition", type=int, default=1)
    one["infer"].add_argument("--all-tasks", action="store_true")
    one["infer"].add_argument("--most-tokens", type=int, default=32)
    one["export"].add_argument("--out", required=True)
    one["export"].add_argument("--words", action="store_true")
    one["export"].add_argument("--texts", action="store_true")
    given = {k: v for k, v in vars(top.parse_args(argv)).items() if v is not None}
    step, root = given.pop("step"), given.pop("store")
    from brevispark.session import session

    store = Store(session("brevispark"), root)
    found = globals()[step](store, **given)
    if isinstance(found, DataFrame):
        found = {step: found}
    if isinstance(found, dict):
        found = {name: [r.asDict() for r in df.collect()] for name, df in found.items()}  # a few cells each
    print(json.dumps({step: found}, default=str))


if __name__ == "__main__":
    main()
