"""Queries of the study's files: tables of the warehouse are written by the sinks and read again by the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brevispark.session import scratch
from brevispark.sources import files, records, sinks
from brevispark.sources.named_texts import read_named_texts, write_named_texts

from .study import Catalogue, table

CATALOGUE = Catalogue()


def _place(spark, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


@CATALOGUE.add("SELECT c_custkey, c_name, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer")
def tsv_scan(spark, sf_dir):
    """Typed rows of a tab-separated file; an empty field is null."""
    at = _place(spark, "tsv")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"))
    sinks.write_tsv(rows, at)
    return files.read_tsv(spark, at, "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string")


@CATALOGUE.add("SELECT conv_id, turn, role, replace(replace(text, chr(13), ' '), chr(10), ' ') || ', \"quoted\"' AS text FROM conversations")
def csv_scan(spark, sf_dir):
    """Rows of comma-separated files with commas and quotes in them, read with required columns."""
    at = _place(spark, "csv")
    text = F.concat(F.translate("text", "\r\n", "  "), F.lit(', "quoted"'))
    sinks.write_csv(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.alias("text")), at, ("conv_id", "turn"))
    rows = files.read_csv(spark, at, ("conv_id", "turn", "role", "text"))
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")


@CATALOGUE.add("SELECT conv_id, turn, role, length(text) AS n_chars, sha256(text) AS text_sha256 FROM conversations")
def quoted_records(spark, sf_dir):
    """Whole texts with their line breaks and quotes, written as comma-separated files and read again by many tasks a file."""
    at = _place(spark, "records")
    sinks.write_csv(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), at)
    rows = records.read_records(spark, at, "conv_id bigint, turn bigint, role string, text string")
    return rows.select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@CATALOGUE.add("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def id_list_semijoin(spark, sf_dir):
    """Rows whose key stands in a list of ids, one a line."""
    at = _place(spark, "ids")
    sinks.write_ids(table(spark, sf_dir, "customer").where("c_acctbal < 0"), "c_custkey", at)
    ids = files.read_ids(spark, at, "o_custkey").select(F.col("o_custkey").cast("bigint").alias("o_custkey"))
    return files.needed_only(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ids, "o_custkey")


@CATALOGUE.add("SELECT r_name AS variant, cast(n_nationkey AS varchar) AS id, (1 + n_nationkey % 3) / 4.0::double AS rate, 1 - (1 + n_nationkey % 3) / 4.0::double AS rho, n_name || chr(10) || 'of ' || r_name AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def text_tree(spark, sf_dir):
    """Texts by variant, id and rate in a tree of files."""
    at = _place(spark, "tree")
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("rate", (1 + F.col("n_nationkey") % 3) / 4)
    name = F.concat_ws("_", F.col("n_nationkey").cast("string"), sinks.rate_label("rate"))
    sinks.write_text_tree(rows.select(F.col("r_name").alias("variant"), name.alias("name"), F.concat("n_name", F.lit("\nof "), "r_name").alias("text")), at)
    return files.read_text_tree(spark, at)


@CATALOGUE.add("SELECT source AS variant, cast(doc_id AS varchar) AS id, (1 + doc_id % 3) / 4.0::double AS rate, 1 - (1 + doc_id % 3) / 4.0::double AS rho, sha256(text) AS text_sha256 FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 'turns', cast(conv_id AS varchar), 0.5::double, 0.5::double, sha256(text) FROM conversations WHERE turn = 0")
def named_texts(spark, sf_dir):
    """A file for each text, <variant>/<id>_<rate>.txt, and the texts read back from them."""
    at = _place(spark, "named")
    name = lambda key: F.concat_ws("_", F.col(key).cast("string"), sinks.rate_label("rate"))
    docs = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").withColumn("rate", (1 + F.col("doc_id") % 3) / 4)
    turns = table(spark, sf_dir, "conversations").where("turn = 0").withColumn("rate", F.lit(0.5))
    write_named_texts(docs.select(F.col("source").alias("variant"), name("doc_id").alias("name"), "text"), at)
    write_named_texts(turns.select(F.lit("turns").alias("variant"), name("conv_id").alias("name"), "text"), at)
    part = lambda i: F.regexp_extract("name", r"(?s)^(.+)_([0-9.]+)$", i)
    rows = read_named_texts(spark, at).select("variant", part(1).alias("id"), part(2).cast("double").alias("rate"), "text")
    return rows.select("variant", "id", "rate", (1 - F.col("rate")).alias("rho"), F.sha2("text", 256).alias("text_sha256"))


@CATALOGUE.add("SELECT count(*) AS n, cast(sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) AS bigint) AS n_large, min(p_type) AS first_type FROM part")
def manifest_scan(spark, sf_dir):
    """A manifest of a draw, as one JSON object."""
    at = _place(spark, "manifest")
    rows = table(spark, sf_dir, "part").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("n_large"), F.min("p_type").alias("first_type"))
    rows.coalesce(1).write.json(at)
    return files.read_manifest(spark, at).select("n", "n_large", "first_type")


@CATALOGUE.add("SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey + 1000000, upper(s_name) FROM supplier WHERE s_acctbal > 0")
def stored_table(spark, sf_dir):
    """A table that is replaced and then added to."""
    at = _place(spark, "table")
    rows = table(spark, sf_dir, "supplier")
    sinks.replace_table(rows.select("s_suppkey", "s_name").limit(3), at)
    sinks.replace_table(rows.select("s_suppkey", "s_name"), at)
    sinks.append_table(rows.where("s_acctbal > 0").select(F.col("s_suppkey") + 1000000, F.upper("s_name").alias("s_name")).toDF("s_suppkey", "s_name"), at)
    return spark.read.parquet(at)
