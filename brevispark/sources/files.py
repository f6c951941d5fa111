"""Readers: delimited text with a header, id lists, manifests, trees of compressed texts, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tsv(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = False) -> DataFrame:
    """Tab-separated rows with a header, all strings unless a schema is given. multi_line: for line breaks inside quotes; each file is
    then read by one task, otherwise large files are split."""
    reader = spark.read.option("header", True).option("sep", "\t").option("quote", '"').option("escape", '"').option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...] = (), multi_line: bool = False) -> DataFrame:
    """Comma-separated rows with a header; raises if a required column is missing. multi_line: as above."""
    df = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line).csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    return df


def needed_only(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is needed; which side is sent where is left to the optimiser."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def read_ids(spark: SparkSession, path: str, name: str = "id") -> DataFrame:
    """One id per line, blank lines dropped."""
    return spark.read.text(path).select(F.trim("value").alias(name)).where(F.col(name) != "")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def read_text_tree(spark: SparkSession, root: str) -> DataFrame:
    """Texts named <variant>/<id>_<rate>.txt, as variant, id, rate, rho and text; one row per file. Trees of `sinks.write_text_tree`
    (<variant=...>/<name=id_rate>/part file, with a line break after the text) read the same. An empty file has no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(root)
    name = lambda c: F.replace(F.replace(F.regexp_replace(F.regexp_replace(c, "^%2E", "."), "^%5F", "_"), F.lit("%2F"), F.lit("/")), F.lit("%25"), F.lit("%"))
    part = lambda i: F.regexp_extract("path", r"(?:variant=)?([^/=]+)/(?:name=)?([^/]+)_([0-9.]+)(?:\.txt|/part-[^/]+)$", i)
    value = F.decode("content", "UTF-8")
    text = F.when(F.rlike("path", F.lit(r"/name=[^/]+/part-[^/]+$")), F.regexp_replace(value, r"\n\z", "")).otherwise(value)
    out = files.select(name(part(1)).alias("variant"), name(part(2)).alias("id"), part(3).cast("double").alias("rate"), text.alias("text"))
    return out.select("variant", "id", "rate", (1 - F.col("rate")).alias("rho"), "text")
