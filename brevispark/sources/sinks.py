"""Writers: CSV exports, text trees, keyed replacement of stored tables, run provenance."""

from __future__ import annotations

import datetime
import hashlib
import json
import platform
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, order: tuple[str, ...] = (), single: bool = False) -> None:
    """CSV with a header; null is an empty field. `single`: one file, for results that are small by nature."""
    out = df.orderBy(*order) if order else df
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("escape", "\"").option("nullValue", "").option("emptyValue", "").csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", "\t").option("escape", "\"").option("lineSep", "\n").csv(path)


def write_ids(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def rate_label(rate: str) -> Column:
    """A rate as the shortest decimal, as in file names."""
    return F.regexp_replace(F.format_string("%.6f", F.col(rate)), r"\.?0+$", "")


def write_text_tree(df: DataFrame, root: str, variant: str = "variant", name: str = "name", text: str = "text") -> None:
    """Texts by variant and name, partitioned for readers: <root>/variant=<v>/name=<n>/part files,
    each text ended by a line break."""
    df.select(F.col(variant).alias("variant"), F.col(name).alias("name"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("variant", "name").text(root)


def replace_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def run_record(spark: SparkSession, step: str, script: str, configuration: dict | None = None) -> DataFrame:
    """One row about a run: time, commit, hash of the script, platform, configuration as JSON."""
    try:
        commit = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10).stdout.strip() or None
    except OSError:
        commit = None
    with open(script, "rb") as f:
        digest = hashlib.sha256(f.read()).hexdigest()
    now = datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")
    return spark.createDataFrame([(step, now, commit, digest, platform.platform(), json.dumps(configuration or {}, sort_keys=True))], "step string, started string, commit string, script_sha256 string, platform string, configuration string")
