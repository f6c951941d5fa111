"""Delimited files with line breaks inside quotes, read by many tasks.

Lines are read as Spark splits a file. A first pass counts the quotes of each split; their running sum tells whether a split begins inside
quotes. A second pass joins the lines of a record: those of whole records within a split, and what hangs over at the borders of splits
(two fragments a split at most), which is put together by file. Quotes inside quoted fields are doubled, so they do not change parity; a
quote inside a field that is not quoted is not allowed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _lines(spark: SparkSession, path: str) -> DataFrame:
    at = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select("value", at["file_path"].alias("file"), at["file_block_start"].alias("block"))


_PIECES = "file string, block bigint, part int, first boolean, last boolean, record string"


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, block and record: the text of each record, with its line breaks, and where it begins. Empty lines between records are kept
    out."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counts = _lines(spark, path).groupBy("file", "block").agg(F.sum(quotes).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = counts.select("file", "block", (before % 2 == 1).alias("inside")).where("inside").select("file", "block").collect()
    starts = spark.sparkContext.broadcast({(r.file, r.block) for r in inside})  # an entry for each split that begins inside quotes

    def run(batches):
        state = {"at": None, "open": [], "odd": False, "n": 0, "head": False}

        def close(done: bool) -> tuple | None:
            """The lines that are held, as a record or a fragment."""
            if not state["open"]:
                return None
            row = (*state["at"], state["n"], not state["head"], done, "\n".join(state["open"]))
            state["open"], state["head"] = [], False
            state["n"] += 1
            return row

        for batch in batches:
            out = []
            files, blocks = (batch.column(c).to_pylist() for c in ("file", "block"))
            values = batch.column("value")
            texts = values.to_pylist()
            odd = (pc.count_substring(values, '"').to_numpy(zero_copy_only=False) % 2).astype(bool)
            for i, text in enumerate(texts):
                at = (files[i], blocks[i])
                if at != state["at"]:
                    out.append(close(False) if state["odd"] else None)
                    inside = at in starts.value
                    state.update(at=at, open=[], odd=inside, n=0, head=inside)
                state["open"].append(text)
                state["odd"] ^= bool(odd[i])
                if not state["odd"]:
                    out.append(close(True))
            yield _batch(out)
        if state["at"] is not None and state["odd"]:
            yield _batch([close(False)])

    def _batch(rows):
        rows = [r for r in rows if r is not None]
        columns = list(zip(*rows)) if rows else [[]] * 6
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in _PIECES.split(", ")])

    found = _lines(spark, path).mapInArrow(run, _PIECES)
    whole = found.where("first AND last").select("file", "block", "record")
    # fragments: a record's first piece opens a number, the pieces up to its last one share it
    pieces = found.where("NOT (first AND last)")
    number = F.sum(F.col("first").cast("int")).over(Window.partitionBy("file").orderBy("block", "part"))
    joined = pieces.withColumn("_r", number).groupBy("file", "_r").agg(F.min("block").alias("block"), F.array_sort(F.collect_list(F.struct("block", "part", "record"))).alias("_p"))
    crossing = joined.select("file", "block", F.array_join(F.transform("_p", lambda p: p["record"]), "\n").alias("record"))
    return whole.unionByName(crossing).where("record <> '' AND record <> '\r'")


def read_records(spark: SparkSession, path: str, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """Typed rows of delimited files; each file begins with a header line unless there is none. Empty fields are null."""
    fields = StructType.fromDDL(schema)
    text = F.regexp_replace("record", r"\r$", "")
    rows = records(spark, path).select("file", "block", F.from_csv(text, schema, {"sep": sep, "escape": '"', "quote": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}).alias("r"))
    if header:
        names = F.to_csv(F.struct(*[F.lit(f.name).alias(f.name) for f in fields]), {"sep": sep})
        plain = F.from_csv(text, ", ".join(f"`{f.name}` string" for f in fields), {"sep": sep, "escape": '"', "quote": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
        is_head = (F.col("block") == 0) & (F.to_csv(plain, {"sep": sep}) == names)
        rows = records(spark, path).where(~is_head).select("file", "block", F.from_csv(text, schema, {"sep": sep, "escape": '"', "quote": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}).alias("r"))
    return rows.select("r.*")
