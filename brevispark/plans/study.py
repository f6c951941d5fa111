"""The study's tables over the warehouse tables: customers are tasks, orders are prompts, line items are compressed prompts and
their model runs. Each relation exists as DataFrames and, for the SQL twins, as common table expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from brevispark.functions import stats as S
from brevispark.operators import evaluation as E
from brevispark.operators import prompts as P
from brevispark.operators import selectivity as R

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
CLASSES = {"A": "wrong_entity", "N": "format", "R": "refusal"}


class Catalogue:
    """Queries by name with their SQL twins."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def put(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals a table of fewer scan partitions than cores over all cores, for work that is heavy by row; larger tables stay as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df  # the scan's own count; no file is listed anew


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles to a number of digits, so that sums taken in another order compare equal."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema.fields])


def r6(names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names.split())


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("task_id"), F.col("c_mktsegment").alias("relation"), F.col("c_acctbal").alias("s_pop"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    variant = F.element_at(F.create_map(*[F.lit(x) for p in zip(PRIORITIES, P.VARIANTS) for x in p]), F.col("o_orderpriority"))
    base = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("prompt_id"), F.col("o_custkey").alias("task_id"), variant.alias("variant"), F.lit(200).alias("n_base"),
        (200 + F.floor(F.col("o_totalprice") / 1500)).cast("int").alias("n_tokens"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("n_units"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("leakage"),
    )
    return base.withColumns(P.calibration(F.col("n_tokens"), F.col("n_base"), F.col("variant")))


def compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rho = (F.round(F.col("l_discount") * 100).cast("int") % 4) * 0.25
    base = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("prompt_id"), F.col("l_linenumber").alias("level_no"), rho.alias("rho"), (rho + F.col("l_tax") - 0.04).alias("rho_real"),
        F.col("l_quantity").cast("int").alias("n_core"), F.round(F.col("l_tax") * 100).cast("int").alias("n_red"), F.when(F.col("l_returnflag") != "N", F.col("l_extendedprice") / 1000).alias("compress_s"),
    )
    base = base.withColumn("e_core", F.floor(F.col("n_core") * (1 - F.col("rho") * 0.75)).cast("int")).withColumn("e_red", F.floor(F.col("n_red") * (1 - F.col("rho"))).cast("int"))
    args = [F.col(c) for c in ("n_core", "n_red", "e_core", "e_red")]
    return base.withColumns(R.rates(*args) | R.free_index(*args))


def inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.element_at(F.create_map(*[F.lit(x) for p in CLASSES.items() for x in p]), F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("prompt_id"), F.col("l_linenumber").alias("level_no"), (F.col("l_suppkey") % 2 + 1).cast("int").alias("repetition"), F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("correct"),
        F.col("l_quantity").alias("n_input"), (F.col("l_extendedprice") / 10000).alias("total_s"), error.alias("error_class"),
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retention of the core of the test question and of the instruction, for each compressed prompt."""
    rate = lambda add: (F.col("l_partkey") + add) % 11 / 10
    parts = F.array(F.struct(F.lit("question").alias("section"), rate(0).alias("rate")), F.struct(F.lit("instruction").alias("section"), rate(3).alias("rate")))
    long = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("prompt_id"), F.col("l_linenumber").alias("level_no"), F.explode(parts).alias("z"))
    rows = long.select("prompt_id", "level_no", "z.*", F.lit("core").alias("origin"))
    return rows.join(compressed(spark, sf_dir).select("prompt_id", "level_no", "rho"), ["prompt_id", "level_no"]).join(prompts(spark, sf_dir).select("prompt_id", "variant"), "prompt_id")


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.conditions(compressed(spark, sf_dir), prompts(spark, sf_dir), tasks(spark, sf_dir))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.runs(conditions(spark, sf_dir), inference(spark, sf_dir))


_CASES = " ".join(f"WHEN '{p}' THEN '{v}'" for p, v in zip(PRIORITIES, P.VARIANTS))
_ERRORS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLASSES.items())
STUDY = f"""
tasks AS (SELECT c_custkey AS task_id, c_mktsegment AS relation, c_acctbal AS s_pop FROM customer),
prompts0 AS (SELECT o_orderkey AS prompt_id, o_custkey AS task_id, CASE o_orderpriority {_CASES} END AS variant, 200 AS n_base, cast(200 + floor(o_totalprice / 1500) AS integer) AS n_tokens,
  cast(o_orderkey % 5 + 1 AS integer) AS n_units, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS leakage FROM orders),
prompts1 AS (SELECT *, CASE WHEN variant = 'basis' THEN 0.0 ELSE cast(n_tokens - n_base AS double) / n_base END AS calibration FROM prompts0),
prompts AS (SELECT *, CASE WHEN variant <> 'basis' THEN cast(abs(calibration - {P.TARGET}) <= cast({P.BAND} AS double) AS integer) END AS in_band, CASE WHEN variant <> 'basis' THEN abs(calibration - {P.TARGET}) END AS deviation FROM prompts1),
comp0 AS (SELECT l_orderkey AS prompt_id, l_linenumber AS level_no, cast((cast(round(l_discount * 100) AS integer) % 4) * 0.25 AS double) AS rho, l_tax, cast(l_quantity AS integer) AS n_core, cast(round(l_tax * 100) AS integer) AS n_red,
  CASE WHEN l_returnflag <> 'N' THEN l_extendedprice / 1000 END AS compress_s FROM lineitem),
comp1 AS (SELECT *, rho + l_tax - cast(0.04 AS double) AS rho_real, cast(floor(n_core * (1 - rho * 0.75)) AS integer) AS e_core, cast(floor(n_red * (1 - rho)) AS integer) AS e_red FROM comp0),
comp2 AS (SELECT *, cast(e_core AS double) / nullif(n_core, 0) AS r_core, cast(e_red AS double) / nullif(n_red, 0) AS r_red, CASE WHEN n_core > 0 AND n_red > 0 THEN ((e_core + 0.5::double) / (n_core + 1)) / ((e_red + 0.5::double) / (n_red + 1)) END AS s_free,
  CASE WHEN n_core > 0 AND n_red > 0 THEN (e_core + 0.5::double) / (n_core + 1) END AS r_core_free, CASE WHEN n_core > 0 AND n_red > 0 THEN (e_red + 0.5::double) / (n_red + 1) END AS r_red_free FROM comp1),
compressed AS (SELECT *, r_core / nullif(r_red, 0) AS s, ln(nullif(r_core / nullif(r_red, 0), 0)) AS ln_s, CASE WHEN n_red > 0 AND r_red = 0 THEN 1 ELSE 0 END AS r_red_null, ln(s_free) AS ln_s_free FROM comp2),
sections AS (SELECT l_orderkey AS prompt_id, l_linenumber AS level_no, 'question' AS section, 'core' AS origin, (l_partkey % 11) / 10.0::double AS rate FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, 'instruction', 'core', ((l_partkey + 3) % 11) / 10.0::double FROM lineitem),
inference AS (SELECT l_orderkey AS prompt_id, l_linenumber AS level_no, cast(l_suppkey % 2 + 1 AS integer) AS repetition, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS correct, l_quantity AS n_input,
  l_extendedprice / 10000 AS total_s, CASE l_returnflag {_ERRORS} END AS error_class FROM lineitem),
conditions AS (SELECT * EXCLUDE (l_tax) FROM compressed JOIN prompts USING (prompt_id) JOIN tasks USING (task_id)),
runs AS (SELECT *, total_s + coalesce(compress_s, 0) AS pipeline_s FROM conditions JOIN inference USING (prompt_id, level_no))"""

#: erf by its series, in logarithms of factorials, for the SQL twins of tests.
CDF = "(CASE WHEN {x} > 8.4 THEN 1.0 WHEN {x} < -8.4 THEN 0.0 ELSE (1 + 2 / sqrt(pi()) * exp(-({x}) * ({x}) / 2) * ({x}) / sqrt(2.0) * list_sum(list_transform(range(0, 121), lambda n: exp(n * ln(greatest(({x}) * ({x}), 1e-300)) + n * ln(2.0) + lgamma(n + 1) - lgamma(2 * n + 2))))) / 2 END)"


def paired_sql(d: str) -> str:
    """mean, lo, hi, n and p over differences d."""
    half = f"coalesce(1.96 * sqrt(var_samp({d}) / count({d})), 0)"
    return f"avg({d}) AS mean, avg({d}) - {half} AS lo, avg({d}) + {half} AS hi, count({d}) AS n, sqrt(var_samp({d}) / count({d})) AS se"


def p_sql(inner: str, keys: str) -> str:
    z = "(mean / nullif(se, 0))"
    return f"SELECT {keys}, mean, lo, hi, n, CASE WHEN se > 0 THEN 1 - {CDF.format(x=z)} WHEN mean > 0 THEN 0.0 ELSE 1.0 END AS p FROM ({inner})"


def wilson_sql(k: str = "k", n: str = "n") -> str:
    p = f"(cast({k} AS double) / {n})"
    base, half = f"(1 + {S.Z}::double * {S.Z} / {n})", f"({S.Z}::double * sqrt({p} * (1 - {p}) / {n} + {S.Z}::double * {S.Z} / (4.0::double * {n} * {n})))"
    centre = f"({p} + {S.Z}::double * {S.Z} / (2.0 * {n}))"
    return f"round({p}, 6) AS share, round(({centre} - {half}) / {base}, 6) AS lo, round(({centre} + {half}) / {base}, 6) AS hi"
