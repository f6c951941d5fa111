"""Queries of the study's relational part: views, evaluation blocks, sampling, incremental runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from brevispark.functions import stats as S
from brevispark.functions import text as T
from brevispark.operators import evaluation as E
from brevispark.operators import incremental as I
from brevispark.operators import sampling as M

from .study import CLASSES, STUDY, Catalogue, compressed, conditions, inference, p_sql, paired_sql, prompts, r6, rounded, runs, sections, table, tasks, wilson_sql

CATALOGUE = Catalogue()
PAIRS = [("filler", "semantic"), ("semantic", "instruction"), ("instruction", "demonstration")]
SEED = 42


@CATALOGUE.add(f"WITH {STUDY} SELECT prompt_id, level_no, task_id, relation, variant, rho, {r6('rho_real calibration s_free s')}, in_band, n_core, n_red, r_red_null FROM conditions")
def condition_view(spark, sf_dir):
    return rounded(conditions(spark, sf_dir).select("prompt_id", "level_no", "task_id", "relation", "variant", "rho", "rho_real", "calibration", "in_band", "n_core", "n_red", "s_free", "s", "r_red_null"))


@CATALOGUE.add(f"WITH {STUDY} SELECT prompt_id, level_no, task_id, variant, rho, repetition, correct, error_class, {r6('total_s pipeline_s')} FROM runs")
def study_view(spark, sf_dir):
    return rounded(runs(spark, sf_dir).select("prompt_id", "level_no", "task_id", "variant", "rho", "repetition", "correct", "error_class", "total_s", "pipeline_s"))


@CATALOGUE.add(f"WITH {STUDY} SELECT variant, rho, n, {r6('mean_real mean_delta min_real max_real')} FROM (SELECT variant, rho, count(*) AS n, avg(rho_real) AS mean_real, avg(rho_real - rho) AS mean_delta, min(rho_real) AS min_real, max(rho_real) AS max_real FROM conditions WHERE rho > 0 GROUP BY 1, 2)")
def rate_conformity(spark, sf_dir):
    return rounded(E.rate_conformity(conditions(spark, sf_dir)))


@CATALOGUE.add(f"WITH {STUDY} SELECT variant, n, {r6('mean_units mean_ratio min_ratio max_ratio mean_deviation max_deviation share_in_band share_leakage')} FROM (SELECT variant, count(*) AS n, avg(n_units) AS mean_units, avg(calibration) AS mean_ratio, min(calibration) AS min_ratio, max(calibration) AS max_ratio, avg(deviation) AS mean_deviation, max(deviation) AS max_deviation, avg(in_band) AS share_in_band, avg(leakage) AS share_leakage FROM prompts WHERE variant <> 'basis' GROUP BY 1)")
def calibration_summary(spark, sf_dir):
    return rounded(E.calibration_summary(prompts(spark, sf_dir)))


@CATALOGUE.add(f"WITH {STUDY} SELECT variant, rho, n, {r6('accuracy mean_total_s mean_pipeline_s mean_input')} FROM (SELECT variant, rho, count(*) AS n, avg(correct) AS accuracy, avg(total_s) AS mean_total_s, avg(pipeline_s) AS mean_pipeline_s, avg(n_input) AS mean_input FROM runs WHERE repetition = 1 GROUP BY 1, 2)")
def accuracy_summary(spark, sf_dir):
    return rounded(E.accuracy(runs(spark, sf_dir)))


@CATALOGUE.add(f"WITH {STUDY} SELECT variant, rho, n, {r6('mean_ln_s_free geo_s_free mean_r_core mean_r_red geo_s')}, n_r_red_null, n_reversed FROM (SELECT variant, rho, count(*) AS n, avg(ln_s_free) AS mean_ln_s_free, exp(avg(ln_s_free)) AS geo_s_free, avg(r_core) AS mean_r_core, avg(r_red) AS mean_r_red, exp(avg(ln_s)) AS geo_s, cast(sum(coalesce(r_red_null, 0)) AS bigint) AS n_r_red_null, cast(sum(CASE WHEN r_core < r_red THEN 1 ELSE 0 END) AS bigint) AS n_reversed FROM conditions WHERE rho > 0 AND n_red > 0 GROUP BY 1, 2)")
def geo_mean_selectivity(spark, sf_dir):
    return rounded(E.selectivity(conditions(spark, sf_dir)))


@CATALOGUE.add(f"WITH {STUDY}, c AS (SELECT variant, rho, cast(sum(correct) AS bigint) AS k, count(*) AS n FROM runs WHERE repetition = 1 GROUP BY 1, 2) SELECT variant, rho, k, n, {wilson_sql()} FROM c")
def wilson_accuracy(spark, sf_dir):
    return rounded(E.wilson_accuracy(runs(spark, sf_dir)))


@CATALOGUE.add(f"WITH {STUDY} SELECT variant, rho, {r6('mean lo hi')}, n FROM (SELECT variant, rho, {paired_sql('rho_real')} FROM conditions GROUP BY 1, 2)")
def mean_ci(spark, sf_dir):
    return rounded(E.mean_ci(conditions(spark, sf_dir), "rho_real"))


_VALUES = "vals AS (SELECT task_id, variant, rho, avg(ln_s_free) AS v FROM conditions WHERE n_red > 0 GROUP BY 1, 2, 3)"
_CORRECT = "corr AS (SELECT task_id, variant, rho, avg(correct) AS v FROM runs WHERE repetition = 1 GROUP BY 1, 2, 3)"


def _values(spark, sf_dir):
    return E.per_task(conditions(spark, sf_dir).where("n_red > 0"), F.col("ln_s_free"))


def _correct(spark, sf_dir):
    return E.per_task(runs(spark, sf_dir).where("repetition = 1"), F.col("correct"))


_DIFFS = " UNION ALL ".join(f"SELECT a.rho, '{a} > {b}' AS contrast, a.v - b.v AS d FROM vals a JOIN vals b USING (task_id, rho) WHERE a.variant = '{a}' AND b.variant = '{b}' AND a.v - b.v IS NOT NULL" for a, b in PAIRS)
_CONTRASTS = p_sql(f"SELECT rho, contrast, {paired_sql('d')} FROM diffs GROUP BY 1, 2", "rho, contrast")


@CATALOGUE.add(f"WITH {STUDY}, {_VALUES}, diffs AS ({_DIFFS}), c AS ({_CONTRASTS}) SELECT rho, contrast, n, {r6('mean lo hi p')} FROM c")
def paired_contrast(spark, sf_dir):
    return rounded(E.contrasts(_values(spark, sf_dir), PAIRS))


@CATALOGUE.add(f"""WITH {STUDY}, {_VALUES}, diffs AS ({_DIFFS}), c AS ({_CONTRASTS}), s AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY rho) - row_number() OVER (PARTITION BY rho ORDER BY p, contrast) + 1) * p) AS q, row_number() OVER (PARTITION BY rho ORDER BY p, contrast) AS i FROM c)
SELECT rho, contrast, n, {r6('mean lo hi p')}, round(max(q) OVER (PARTITION BY rho ORDER BY i), 6) AS p_holm FROM s""")
def holm_contrasts(spark, sf_dir):
    return rounded(E.holm_contrasts(_values(spark, sf_dir), PAIRS))


_BASIS = " UNION ALL ".join(f"SELECT a.rho, '{v} > basis' AS contrast, a.v - b.v AS d FROM corr a JOIN corr b USING (task_id, rho) WHERE a.variant = '{v}' AND b.variant = 'basis'" for v in ("filler", "semantic", "instruction", "demonstration"))


@CATALOGUE.add(f"WITH {STUDY}, {_CORRECT}, diffs AS ({_BASIS}), c AS ({_CONTRASTS}) SELECT rho, contrast, n, {r6('mean lo hi p')} FROM c")
def accuracy_against_basis(spark, sf_dir):
    return rounded(E.contrasts(_correct(spark, sf_dir), [(v, "basis") for v in ("filler", "semantic", "instruction", "demonstration")]))


@CATALOGUE.add(f"""WITH {STUDY}, {_CORRECT}, ch AS (SELECT a.task_id, a.variant, a.rho, a.v - b.v AS d FROM corr a JOIN corr b USING (task_id, variant) WHERE a.rho > 0 AND b.rho = 0),
x AS (SELECT a.variant, a.rho, a.d - b.d AS d FROM ch a JOIN ch b USING (task_id, rho) WHERE a.variant <> 'basis' AND b.variant = 'basis'), c AS ({p_sql(f"SELECT variant, rho, {paired_sql('d')} FROM x GROUP BY 1, 2", "variant, rho")})
SELECT variant, rho, n, {r6('mean lo hi p')} FROM c""")
def did(spark, sf_dir):
    return rounded(E.did(_correct(spark, sf_dir)))


_CELLS = "cells AS (SELECT variant, rho, avg(correct) AS accuracy FROM runs WHERE repetition = 1 GROUP BY 1, 2)"


@CATALOGUE.add(f"WITH {STUDY}, {_CELLS}, ref AS (SELECT variant, accuracy AS a0 FROM cells WHERE rho = 0) SELECT variant, round(max(a0), 6) AS accuracy_0, coalesce(max(rho) FILTER (WHERE rho > 0 AND accuracy >= a0 - 0.05::double), 0.0::double) AS tau FROM cells JOIN ref USING (variant) GROUP BY 1")
def tolerance(spark, sf_dir):
    return rounded(E.tolerance(E.accuracy(runs(spark, sf_dir))))


@CATALOGUE.add(f"WITH {STUDY} SELECT variant, rho, {', '.join(f'count(*) FILTER (WHERE error_class = {chr(39)}{c}{chr(39)}) AS {c}' for c in CLASSES.values())}, cast(0 AS bigint) AS empty_or_cut FROM runs WHERE repetition = 1 AND correct = 0 GROUP BY 1, 2")
def error_crosstab(spark, sf_dir):
    return E.error_crosstab(runs(spark, sf_dir), (*CLASSES.values(), "empty_or_cut"))


@CATALOGUE.add(f"""WITH {STUDY}, c AS (SELECT variant, rho, avg(n_input) AS mean_input, avg(total_s) AS mean_total_s, avg(coalesce(compress_s, 0)) AS mean_compress_s, avg(pipeline_s) AS mean_pipeline_s FROM runs WHERE repetition = 1 GROUP BY 1, 2)
SELECT variant, rho, {r6('mean_input mean_total_s mean_compress_s mean_pipeline_s')}, round(max(CASE WHEN rho = 0 THEN mean_total_s END) OVER (PARTITION BY variant) - mean_pipeline_s, 6) AS net_s FROM c""")
def efficiency(spark, sf_dir):
    return rounded(E.efficiency(runs(spark, sf_dir)))


@CATALOGUE.add(f"WITH {STUDY}, {_VALUES}, m AS (SELECT rho, variant, avg(v) AS m FROM vals GROUP BY 1, 2) SELECT rho, string_agg(variant, ' > ' ORDER BY m DESC, variant) AS ranking FROM m GROUP BY 1")
def variant_ranking(spark, sf_dir):
    return E.ranking(_values(spark, sf_dir))


_TESTED = "tested AS (SELECT s.prompt_id, s.level_no, p.variant, CASE WHEN s.rate >= 0.5 THEN 1 ELSE 0 END AS survived FROM sections s JOIN compressed c USING (prompt_id, level_no) JOIN prompts p USING (prompt_id) WHERE s.section = 'question' AND s.origin = 'core' AND c.rho = 0.75)"


@CATALOGUE.add(f"""WITH {STUDY}, {_TESTED}, scored AS (SELECT t.*, i.correct FROM tested t JOIN inference i USING (prompt_id, level_no) WHERE i.repetition = 1),
c AS (SELECT 'stratum' AS block, cast(NULL AS varchar) AS variant, survived, sum(correct) AS k, count(*) AS n FROM scored GROUP BY survived UNION ALL SELECT 'survival', variant, NULL, sum(survived), count(*) FROM tested GROUP BY variant
  UNION ALL SELECT 'survivors', variant, NULL, sum(correct), count(*) FROM scored WHERE survived = 1 GROUP BY variant)
SELECT block, variant, survived, cast(k AS bigint) AS k, n, {wilson_sql()}, cast(n >= 10 AS integer) AS enough FROM c""")
def question_survival(spark, sf_dir):
    return rounded(E.question_survival(sections(spark, sf_dir), inference(spark, sf_dir)))


@CATALOGUE.add(f"""WITH {STUDY}, done AS (SELECT DISTINCT prompt_id, rho FROM compressed JOIN inference USING (prompt_id, level_no) WHERE repetition = 2)
SELECT p.prompt_id, p.variant, l.rho FROM prompts p CROSS JOIN (VALUES (0.25::double), (0.75::double)) l(rho) LEFT JOIN done d ON d.prompt_id = p.prompt_id AND d.rho = l.rho WHERE d.rho IS NULL AND p.variant IN ('filler', 'semantic') ORDER BY p.prompt_id, p.variant, l.rho LIMIT 500""")
def filtered_worklist(spark, sf_dir):
    done = compressed(spark, sf_dir).join(inference(spark, sf_dir), ["prompt_id", "level_no"])
    items = prompts(spark, sf_dir).select("prompt_id", "variant")
    found = I.work_list(items, [0.0, 0.25, 0.5, 0.75], done, "prompt_id", ["prompt_id", "variant", "rho"], variants=["filler", "semantic"], only=[0.25, 0.75], repetition=2, limit=500)
    return found.select("prompt_id", "variant", "rho")


@CATALOGUE.add("""WITH new AS (SELECT l_orderkey AS o_orderkey, count(*) AS n_lines, max(l_shipdate) FILTER (WHERE l_returnflag = 'R') AS o_orderdate FROM lineitem WHERE l_discount > 0.05 GROUP BY 1)
SELECT o.o_orderkey, o.o_orderstatus, CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_orderdate ELSE o.o_orderdate END AS o_orderdate, n.n_lines FROM orders o LEFT JOIN new n USING (o_orderkey)""")
def update_measures(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_discount > 0.05").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    new = lines.agg(F.count("*").alias("n_lines"), F.max(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("o_orderdate"))
    return I.update_columns(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), new, ["o_orderkey"], ["o_orderdate", "n_lines"])


@CATALOGUE.add("""WITH c AS (SELECT p_type, count(DISTINCT p_brand) AS n_paraphrases FROM part GROUP BY 1) SELECT p_partkey, p_type, n_paraphrases FROM part JOIN c USING (p_type) WHERE n_paraphrases >= 4""")
def eligible_categories(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    counts = parts.groupBy("p_type").agg(F.count_distinct("p_brand").alias("n_paraphrases"))
    return M.eligible(parts.select("p_partkey", "p_type"), counts, "p_type").select("p_partkey", "p_type", "n_paraphrases")


@CATALOGUE.add(f"WITH {STUDY} SELECT count(*) AS n, cast(sum(r_red_null) AS bigint) AS n_r_red_null, round(avg(n_red), 6) AS mean_n_red, round(sum(coalesce(compress_s, 0)), 3) AS sum_compress_s FROM conditions WHERE rho > 0")
def alignment_controls(spark, sf_dir):
    return rounded(E.controls(conditions(spark, sf_dir)).withColumn("sum_compress_s", F.round("sum_compress_s", 3)))


@CATALOGUE.add("""WITH i AS (SELECT user_id, event_type, cast(event_id % 2 + 1 AS integer) AS repetition, floor(value) AS v FROM events),
t AS (SELECT user_id, event_type, max(v) FILTER (WHERE repetition = 1) AS a, max(v) FILTER (WHERE repetition = 2) AS b FROM i GROUP BY 1, 2)
SELECT count(*) AS n_twice, count(*) FILTER (WHERE a = b) AS n_equal FROM t WHERE a IS NOT NULL AND b IS NOT NULL""")
def determinism_check(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", (F.col("event_id") % 2 + 1).cast("int").alias("repetition"), F.floor("value").alias("v"))
    return E.determinism(rows, ["user_id", "event_type"], "v")


@CATALOGUE.add(f"WITH {STUDY}, done AS (SELECT DISTINCT prompt_id, rho FROM compressed) SELECT p.prompt_id, l.rho FROM prompts p CROSS JOIN (VALUES (0.0::double), (0.25::double), (0.5::double), (0.75::double)) l(rho) LEFT JOIN done d ON d.prompt_id = p.prompt_id AND d.rho = l.rho WHERE d.rho IS NULL")
def open_worklist(spark, sf_dir):
    return I.open_work(prompts(spark, sf_dir), [0.0, 0.25, 0.5, 0.75], compressed(spark, sf_dir), "prompt_id")


@CATALOGUE.add("SELECT o_custkey, o_orderkey, o_totalprice, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS integer) AS rank FROM orders QUALIFY rank <= 3")
def topn_per_group(spark, sf_dir):
    return I.top_per_group(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", [F.desc("o_totalprice"), "o_orderkey"], 3)


@CATALOGUE.add("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_upsert(spark, sf_dir):
    return I.upsert(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@CATALOGUE.add("""WITH new AS (SELECT l_orderkey, l_linenumber, l_quantity * 2 AS l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'), old AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem)
SELECT * FROM new UNION ALL SELECT old.* FROM old ANTI JOIN (SELECT DISTINCT l_orderkey FROM new) n ON old.l_orderkey = n.l_orderkey""")
def keyed_replace(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    new = rows.where("l_shipdate >= timestamp'1998-01-01'").withColumn("l_quantity", F.col("l_quantity") * 2).drop("l_shipdate")
    return I.replace_keys(rows.drop("l_shipdate"), new, ["l_orderkey"])


@CATALOGUE.add("SELECT l.l_orderkey, l.l_linenumber FROM lineitem l SEMI JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O') o ON l.l_orderkey = o.o_orderkey")
def cascade_delete(spark, sf_dir):
    alive = table(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    return I.cascade(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), alive, ["l_orderkey"])


@CATALOGUE.add("WITH new AS (SELECT doc_id, sha256(replace(text, '@', ' at ')) AS sha256 FROM documents), old AS (SELECT doc_id, sha256(text) AS sha256 FROM documents) SELECT n.doc_id, n.sha256 FROM new n ANTI JOIN old o ON n.doc_id = o.doc_id AND n.sha256 = o.sha256")
def content_hash_noop(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    new = docs.withColumn("text", F.replace("text", F.lit("@"), F.lit(" at ")))
    return I.changed(new, docs, "doc_id", "text")


_TERCILES = "terc AS (SELECT *, CASE WHEN rn <= round(n / 3.0) THEN 1 WHEN rn <= round(2 * n / 3.0) THEN 2 ELSE 3 END AS tercile FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY s_pop, task_id) AS rn, count(*) OVER (PARTITION BY relation) AS n FROM tasks))"
_SAMPLE = "samp AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY relation, tercile ORDER BY md5('42|' || task_id), task_id) AS k FROM terc) WHERE k <= 7)"


def _terciles(spark, sf_dir):
    return M.terciles(tasks(spark, sf_dir), "relation", "s_pop", "task_id")


def _sample(spark, sf_dir):
    return M.stratified(_terciles(spark, sf_dir), ("relation", "tercile"), 7, "task_id", SEED)


@CATALOGUE.add(f"WITH {STUDY}, {_TERCILES} SELECT task_id, relation, tercile FROM terc")
def tercile_strata(spark, sf_dir):
    return _terciles(spark, sf_dir).select("task_id", "relation", "tercile")


@CATALOGUE.add(f"WITH {STUDY}, {_TERCILES} SELECT relation, count(*) FILTER (WHERE tercile = 1) AS t1, count(*) FILTER (WHERE tercile = 2) AS t2, count(*) FILTER (WHERE tercile = 3) AS t3 FROM terc GROUP BY 1")
def tercile_pivot(spark, sf_dir):
    wide = _terciles(spark, sf_dir).groupBy("relation").pivot("tercile", [1, 2, 3]).count().na.fill(0)
    return wide.select("relation", *[F.col(str(t)).alias(f"t{t}") for t in (1, 2, 3)])


@CATALOGUE.add(f"WITH {STUDY}, {_TERCILES}, {_SAMPLE} SELECT task_id, relation, tercile FROM samp")
def stratified_sample(spark, sf_dir):
    return _sample(spark, sf_dir).select("task_id", "relation", "tercile")


_DRAWS = """draws AS (SELECT * FROM (SELECT s.task_id, s.relation, s.tercile, g.seed, row_number() OVER (PARTITION BY g.seed, s.relation ORDER BY md5(g.seed || '|' || s.task_id), s.task_id) AS k FROM samp s CROSS JOIN (SELECT unnest(range(500)) AS seed) g) WHERE k <= 3),
good AS (SELECT min(seed) AS seed FROM (SELECT seed FROM draws GROUP BY seed HAVING count(*) FILTER (WHERE tercile = 1) = 5 AND count(*) FILTER (WHERE tercile = 2) = 5 AND count(*) FILTER (WHERE tercile = 3) = 5))"""


def _subsample(spark, sf_dir):
    return M.balanced_subsample(_sample(spark, sf_dir), "relation", "tercile", "task_id", 3, 5)


@CATALOGUE.add(f"WITH {STUDY}, {_TERCILES}, {_SAMPLE}, {_DRAWS} SELECT task_id, relation, tercile, seed FROM draws JOIN good USING (seed)")
def balanced_subsample(spark, sf_dir):
    return _subsample(spark, sf_dir).select("task_id", "relation", "tercile", "seed")


@CATALOGUE.add(f"""WITH {STUDY}, {_TERCILES}, {_SAMPLE}, pool AS (SELECT t.relation AS demo_category, t.task_id AS demo_item FROM tasks t ANTI JOIN samp s ON t.task_id = s.task_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY demo_category ORDER BY md5('42|' || demo_item), demo_item) - 1 AS place FROM pool), sizes AS (SELECT demo_category, count(*) AS n FROM pool GROUP BY 1),
pairs AS (SELECT s.task_id, z.demo_category, z.n, cast(row_number() OVER (PARTITION BY s.task_id ORDER BY md5('42|' || s.task_id || '|' || z.demo_category), z.demo_category) AS integer) AS slot FROM samp s JOIN sizes z ON s.relation <> z.demo_category)
SELECT p.task_id, p.slot, CASE WHEN p.slot <= 2 THEN 'base' ELSE 'demonstration' END AS role, p.demo_category, r.demo_item FROM pairs p JOIN ranked r ON r.demo_category = p.demo_category AND r.place = cast('0x' || substr(md5('42|' || p.task_id || '|' || p.slot), 1, 8) AS bigint) % p.n WHERE p.slot <= 4""")
def demo_assignment(spark, sf_dir):
    sample, all_ = _sample(spark, sf_dir), tasks(spark, sf_dir)
    pool = all_.join(sample.select("task_id"), "task_id", "left_anti")
    return M.assign_foreign(sample, pool, "task_id", "relation", "task_id", slots=4, base=2, seed=SEED)


@CATALOGUE.add(f"""WITH {STUDY}, {_TERCILES}, {_SAMPLE}, {_DRAWS}, sub AS (SELECT * FROM draws JOIN good USING (seed))
SELECT (SELECT count(*) FROM samp) AS n_sample, (SELECT count(DISTINCT task_id) FROM samp) AS n_ids, (SELECT count(*) FROM sub) AS n_sub, (SELECT count(*) FROM sub ANTI JOIN samp USING (task_id)) AS n_outside,
(SELECT count(*) FROM (SELECT relation, tercile FROM samp GROUP BY 1, 2 HAVING count(*) <> 7)) AS n_bad_strata, (SELECT max(m) - min(m) FROM (SELECT count(*) AS m FROM sub GROUP BY tercile)) AS spread""")
def sample_invariants(spark, sf_dir):
    sample, sub = _sample(spark, sf_dir), _subsample(spark, sf_dir)
    one = lambda df, **kw: df.agg(*[v.alias(k) for k, v in kw.items()])
    parts = [
        one(sample, n_sample=F.count("*"), n_ids=F.count_distinct("task_id")), one(sub, n_sub=F.count("*")), one(sub.join(sample, "task_id", "left_anti"), n_outside=F.count("*")),
        one(sample.groupBy("relation", "tercile").count().where("count <> 7"), n_bad_strata=F.count("*")), one(sub.groupBy("tercile").agg(F.count("*").alias("m")), spread=F.max("m") - F.min("m")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p), F.lit(True))  # one row each
    return out


@CATALOGUE.add("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE place = conv_id % n")
def paraphrase_pick(spark, sf_dir):
    return M.rotating_pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@CATALOGUE.add("SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders")
def common_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").intersect(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")))


@CATALOGUE.add("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def pool_difference(spark, sf_dir):
    drawn = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(drawn, "c_custkey", "left_anti").distinct()


@CATALOGUE.add("SELECT c_custkey AS id FROM customer UNION SELECT s_suppkey FROM supplier")
def needed_union(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).union(table(spark, sf_dir, "supplier").select("s_suppkey")).distinct()


@CATALOGUE.add("SELECT p_partkey, CASE WHEN regexp_matches(trim(split_part(p_name, ' ', 2)), '^[0-9]{1,18}$') THEN cast(trim(split_part(p_name, ' ', 2)) AS bigint) END AS number FROM part")
def digit_guard(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.number_or_null(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("number"))


@CATALOGUE.add("SELECT event_type, round(sum(value) / nullif(count(*) FILTER (WHERE value > 50), 0), 6) AS guarded, count(*) AS n FROM events GROUP BY 1")
def guarded_ratio(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum("value").alias("s"), F.count_if(F.col("value") > 50).alias("k"), F.count("*").alias("n"))
    return rounded(rows.select("event_type", S.ratio(F.col("s"), F.col("k")).alias("guarded"), "n"))
