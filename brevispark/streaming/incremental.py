"""Resumable processing of an arriving text folder: each run takes what is new, once, and stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_new(spark: SparkSession, source: str, schema: str, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, per_batch: int | None = None) -> None:
    """Parquet files under `source` that earlier runs have not seen go through `step` into `out`, exactly once.

    `step` must not need rows of other batches; `per_batch` bounds the files of one batch."""
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    rows = step(reader.parquet(source))
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
