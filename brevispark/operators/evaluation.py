"""The views over conditions and runs, and the blocks of the evaluation, each one grouped pass instead of a query per cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brevispark.functions import stats as S

CELL = ("variant", "rho")


def conditions(compressed: DataFrame, prompts: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row per task, variant and level: compressed texts with their prompt and task."""
    return compressed.join(prompts, "prompt_id").join(tasks, "task_id")


def runs(conditions_: DataFrame, inference: DataFrame) -> DataFrame:
    """Conditions with their model runs, and the time of the whole pipeline."""
    joined = conditions_.join(inference, ["prompt_id", "level_no"])
    return joined.withColumn("pipeline_s", F.col("total_s") + F.coalesce("compress_s", F.lit(0.0)))


def rate_conformity(c: DataFrame) -> DataFrame:
    real, off = F.col("rho_real"), F.col("rho_real") - F.col("rho")
    return c.where("rho > 0").groupBy(*CELL).agg(F.count("*").alias("n"), F.avg(real).alias("mean_real"), F.avg(off).alias("mean_delta"), F.min(real).alias("min_real"), F.max(real).alias("max_real"))


def selectivity(c: DataFrame) -> DataFrame:
    return c.where("rho > 0 AND n_red > 0").groupBy(*CELL).agg(
        F.count("*").alias("n"), F.avg("ln_s_free").alias("mean_ln_s_free"), S.geometric_mean(F.col("ln_s_free")).alias("geo_s_free"), F.avg("r_core").alias("mean_r_core"), F.avg("r_red").alias("mean_r_red"),
        S.geometric_mean(F.col("ln_s")).alias("geo_s"), F.sum(F.coalesce("r_red_null", F.lit(0))).alias("n_r_red_null"), F.sum(F.when(F.col("r_core") < F.col("r_red"), 1).otherwise(0)).alias("n_reversed"),
    )


def accuracy(r: DataFrame) -> DataFrame:
    return r.where("repetition = 1").groupBy(*CELL).agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"), F.avg("total_s").alias("mean_total_s"), F.avg("pipeline_s").alias("mean_pipeline_s"), F.avg("n_input").alias("mean_input"))


def calibration_summary(prompts: DataFrame) -> DataFrame:
    q = F.col("calibration")
    return prompts.where("variant <> 'basis'").groupBy("variant").agg(
        F.count("*").alias("n"), F.avg("n_units").alias("mean_units"), F.avg(q).alias("mean_ratio"), F.min(q).alias("min_ratio"), F.max(q).alias("max_ratio"),
        F.avg("deviation").alias("mean_deviation"), F.max("deviation").alias("max_deviation"), F.avg("in_band").alias("share_in_band"), F.avg("leakage").alias("share_leakage"),
    )


def wilson_accuracy(r: DataFrame, keys: tuple[str, ...] = CELL) -> DataFrame:
    cells = r.where("repetition = 1").groupBy(*keys).agg(F.sum("correct").alias("k"), F.count("*").alias("n"))
    p, lo, hi = S.wilson(F.col("k"), F.col("n"))
    return cells.select(*keys, "k", "n", p.alias("share"), lo.alias("lo"), hi.alias("hi"))


def mean_ci(c: DataFrame, value: str, keys: tuple[str, ...] = CELL) -> DataFrame:
    return c.groupBy(*keys).agg(*[e.alias(n) for n, e in S.mean_ci(F.col(value)).items()])


def per_task(rows: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """One value per task, variant and level."""
    return rows.groupBy("task_id", *CELL).agg(F.avg(value).alias(name))


def contrasts(values: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Paired differences high - low of a value per task, by level, over the tasks that have both; one pivot, no join."""
    names = sorted({v for p in pairs for v in p})
    wide = values.where(F.col("variant").isin(*names)).groupBy("task_id", "rho").pivot("variant", names).agg(F.first("value"))
    parts = F.array(*[F.struct(F.lit(f"{a} > {b}").alias("contrast"), (F.col(a) - F.col(b)).alias("d")) for a, b in pairs])
    long = wide.select("rho", F.explode(parts).alias("x")).select("rho", "x.*").where("d IS NOT NULL")
    return long.groupBy("rho", "contrast").agg(*[e.alias(n) for n, e in S.paired(F.col("d")).items()])


def holm_contrasts(values: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return S.holm(contrasts(values, pairs), "p", ("rho",), ("contrast",))


def did(values: DataFrame, base: str = "basis") -> DataFrame:
    """Difference in differences against the base variant and level 0, paired per task."""
    zero = values.where("rho = 0").select("task_id", "variant", F.col("value").alias("v0"))
    change = values.where("rho > 0").join(zero, ["task_id", "variant"]).select("task_id", "variant", "rho", (F.col("value") - F.col("v0")).alias("d"))
    ref = change.where(F.col("variant") == base).select("task_id", "rho", F.col("d").alias("d0"))
    rows = change.where(F.col("variant") != base).join(ref, ["task_id", "rho"])
    return rows.groupBy(*CELL).agg(*[e.alias(n) for n, e in S.paired(F.col("d") - F.col("d0")).items()])


def tolerance(cells: DataFrame, slack: float = 0.05) -> DataFrame:
    """The largest level whose accuracy is within `slack` of that at level 0; 0 if none is."""
    ref = F.max(F.when(F.col("rho") == 0, F.col("accuracy"))).over(Window.partitionBy("variant"))
    return cells.withColumn("ref", ref).groupBy("variant").agg(F.max("ref").alias("accuracy_0"), F.coalesce(F.max(F.when((F.col("rho") > 0) & (F.col("accuracy") >= F.col("ref") - slack), F.col("rho"))), F.lit(0.0)).alias("tau"))


def error_crosstab(r: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    wrong = r.where("repetition = 1 AND correct = 0")
    return wrong.groupBy(*CELL).pivot("error_class", list(classes)).count().na.fill(0, list(classes))


def efficiency(r: DataFrame) -> DataFrame:
    """Mean input, times, and the net gain against the variant's mean inference time at level 0."""
    first = r.where("repetition = 1")
    cells = first.groupBy(*CELL).agg(F.avg("n_input").alias("mean_input"), F.avg("total_s").alias("mean_total_s"), F.avg(F.coalesce("compress_s", F.lit(0.0))).alias("mean_compress_s"), F.avg("pipeline_s").alias("mean_pipeline_s"))
    ref = F.max(F.when(F.col("rho") == 0, F.col("mean_total_s"))).over(Window.partitionBy("variant"))
    return cells.withColumn("net_s", ref - F.col("mean_pipeline_s"))


def ranking(values: DataFrame) -> DataFrame:
    """Variants by mean value within each level, best first."""
    means = values.groupBy("rho", "variant").agg(F.avg("value").alias("m"))
    sorted_ = F.sort_array(F.collect_list(F.struct((-F.col("m")).alias("minus"), "variant")))
    return means.groupBy("rho").agg(F.array_join(F.transform(sorted_, lambda x: x["variant"]), " > ").alias("ranking"))


def question_survival(sections: DataFrame, r: DataFrame, share: float = 0.5, rho: float = 0.75, least: int = 10) -> DataFrame:
    """What accuracy at the highest level hangs on: whether the core of the test question survived the compression.

    sections: prompt_id, level_no, variant, rho, section, origin, rate. Three tables in one, by `block`: accuracy of all runs by
    whether the question kept `share` of its words (`stratum`), the share of conditions whose question did, by variant
    (`survival`), and accuracy among those, by variant (`survivors`; `enough` is 0 below `least` runs). Each with k, n and the
    share's interval."""
    tested = sections.where((F.col("section") == "question") & (F.col("origin") == "core") & (F.col("rho") == rho))
    tested = tested.select("prompt_id", "level_no", "variant", F.when(F.col("rate") >= share, 1).otherwise(0).alias("survived"))
    scored = tested.join(r.where("repetition = 1").select("prompt_id", "level_no", "correct"), ["prompt_id", "level_no"])
    cells = lambda df, block, keys, k: df.groupBy(*keys).agg(F.sum(k).alias("k"), F.count("*").alias("n")).select(F.lit(block).alias("block"), *[F.col(c) if c in keys else F.lit(None).cast(t).alias(c) for c, t in (("variant", "string"), ("survived", "int"))], "k", "n")
    out = cells(scored, "stratum", ["survived"], "correct").unionByName(cells(tested, "survival", ["variant"], "survived")).unionByName(cells(scored.where("survived = 1"), "survivors", ["variant"], "correct"))
    p, lo, hi = S.wilson(F.col("k"), F.col("n"))
    return out.select("block", "variant", "survived", "k", "n", p.alias("share"), lo.alias("lo"), hi.alias("hi"), (F.col("n") >= least).cast("int").alias("enough"))


def determinism(inference: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Conditions run twice, and how many agree: one grouped pass instead of a self join."""
    two = inference.where("repetition IN (1, 2)").groupBy(*keys).agg(F.max(F.when(F.col("repetition") == 1, F.col(value))).alias("a"), F.max(F.when(F.col("repetition") == 2, F.col(value))).alias("b"))
    return two.where("a IS NOT NULL AND b IS NOT NULL").agg(F.count("*").alias("n_twice"), F.count_if(F.col("a") == F.col("b")).alias("n_equal"))


def controls(c: DataFrame) -> DataFrame:
    """Counts over all compressed conditions, in one row."""
    return c.where("rho > 0").agg(F.count("*").alias("n"), F.sum(F.when(F.col("r_red_null") == 1, 1).otherwise(0)).alias("n_r_red_null"), F.avg("n_red").alias("mean_n_red"), F.sum(F.coalesce("compress_s", F.lit(0.0))).alias("sum_compress_s"))
