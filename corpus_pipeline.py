"""A corpus pipeline: language identification, near duplicates, decontamination, personal data, SentencePiece tokens.

Each stage takes (spark, docs, sf_dir), works on all that the one before it has kept, and returns the columns of documents
(the last one: tokens). Stages are written as Parquet in the shared folder and read again. Rows with null doc_id go through
every stage; a null text has no language and goes at the first. Rows equal in doc_id and text are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brevispark.llm import decontaminate, jaccard_join, language_id, pii, sentencepiece_codec
from brevispark.llm.common import KeyFilter, discard, stored, table
from brevispark.llm.queries import piece_model_path

#: A document is kept if one language holds this share of its words.
LEAST_SHARE = 0.5


def _renamed(docs: DataFrame) -> tuple[DataFrame, list[str], str]:
    """Documents with columns c0, c1, ..., which no result can clash with, their names and that of the text."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names, names[docs.columns.index("text")]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or without a main language. The models learn from the documents' own labels."""
    safe, names, text = _renamed(docs)
    found = language_id.identify(safe, language_id.train(docs), keep=names, text=text)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*names).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each near-duplicate group."""
    found = stored(jaccard_join.near_duplicates(docs), "near-duplicates")
    stays = F.col("class_id").isNull() | ((F.col("doc_id") == F.col("class_id")) & F.col("text_hash").eqNullSafe(F.col("class_hash")))
    # documents that go, and those that repeat; all others need no join: the filter tells most of them apart
    marked = found.groupBy("doc_id", "text_hash").agg(F.min(stays).alias("stays"), F.count("*").alias("rows")).where("doc_id IS NOT NULL AND (NOT stays OR rows > 1)")
    marked = stored(marked.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "stays"), "marked")
    key = F.col("doc_id").cast("bigint"), F.hash(F.col("text"))
    may_go = F.coalesce(KeyFilter(marked, "__id", "__hash").may_hold(*key), F.lit(False))
    perhaps = docs.where(may_go)
    same = lambda d, m: (d["doc_id"].cast("bigint") == m["__id"]) & (F.hash(d["text"]) == m["__hash"])
    kept = docs.where(~may_go).unionByName(perhaps.join(marked, same(perhaps, marked), "left_anti"))
    repeated = marked.where("stays")
    return kept.unionByName(perhaps.join(repeated, same(perhaps, repeated), "left_semi").dropDuplicates(["doc_id", "text"]))


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold half of a benchmark item or more."""
    leaks = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    leaks = stored(leaks.select(F.col("doc_id").cast("bigint").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "leaks")
    key = F.col("doc_id").cast("bigint"), F.hash(F.col("text"))
    may_go = KeyFilter(leaks, "__id", "__hash").may_hold(*key)
    perhaps = docs.where(may_go)
    gone = perhaps["doc_id"].cast("bigint").eqNullSafe(leaks["__id"]) & (F.hash(perhaps["text"]) == leaks["__hash"])
    return docs.where(~may_go).unionByName(perhaps.join(leaks, gone, "left_anti"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in place of each span of personal data; n_chars follows the text."""
    safe, names, text = _renamed(docs)
    found = pii.find_personal_data(safe, keep=names, text=text, redacted=True)
    new = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast("bigint")}
    return found.select(*[new.get(c, F.col(n)).alias(c) for n, c in zip(names, docs.columns)])


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (packed 32-bit integers), n_tokens and digests of the ids and of the decoded text."""
    found = sentencepiece_codec.encode_documents(docs, piece_model_path(), keep=("doc_id",), packed=True)
    return found.select("doc_id", "ids", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_documents),
    ("personal_data", redact_personal_data),
    ("sentencepiece", encode_tokens),
]

#: Mixture inference, chosen paths and the random field are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)  # the source table stays
    return STAGES[-1][1](spark, docs, sf_dir)
